"""Evidence packs of registered fields, notes by task, and the validation of statements about a pack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sessionforge.operators.stocks import STATUS
from sessionforge.plans.registry import RELATIONS, Query, r
from sessionforge.sources.market import table

# Fields by surface with their units, kinds of statements, and words with digits that are no numbers.
FIELDS = {
    "morning_card": {
        "row.ticker": "text", "row.group": "text", "row.status": "enum", "row.trigger": "usd", "row.stop": "usd", "row.price": "usd", "row.open": "usd", "row.high": "usd", "row.low": "usd",
        "row.change": "pct", "row.atr": "usd", "row.atr_from_lod": "atr", "row.volatility_w": "pct", "row.pct_of_52w_high": "pct", "row.sma20_dist": "pct", "row.sma50_dist": "pct",
        "prior.status": "enum", "prior.price": "usd", "derived.sma20_ext_atr": "atr", "derived.sma50_ext_atr": "atr", "derived.stop_gap_pct": "pct", "derived.stop_gap_atr": "atr",
        "derived.trigger_gap_pct": "pct", "derived.r_at_price": "ratio", "derived.range_atr": "x", "derived.status_changed": "enum", "derived.price_change_since_prior": "pct",
        "group.rank_month": "rank", "group.rank_month_delta_5d": "int", "group.rs_month": "pp", "group.rs_score": "ratio", "group.rs_new_high": "enum", "group.momentum_score": "ratio",
    },
    "morning_triage": {
        "session.date": "text", "derived.n_rows": "int", "derived.n_actionable": "int", "derived.n_changed": "int", "derived.n_triggered": "int", "derived.n_gapped_through": "int", "derived.n_reclaim": "int",
        "derived.n_failed_breakout": "int", "derived.n_setting_up": "int", "derived.n_invalidated": "int", "derived.n_no_quote": "int", "derived.invalidated_ext_atr_median": "atr",
        "derived.actionable_ext_atr_median": "atr", "derived.n_groups_actionable": "int", "derived.top_group": "text", "derived.top_group_n": "int",
    },
}
#: Kinds with their caps, the cap of all, whether a catch must be there, whether subjects may be.
SURFACES = {"morning_card": ({"read": 1, "catch": 1}, 2, True, False), "morning_triage": ({"triage": 3, "pattern": 1, "catch": 1}, 5, True, True), "picks_card": ({"thesis": 1, "catch": 1}, 2, True, False), "brief_public": ({"regime": 1, "action": 1, "non_action": 1, "uncertainty": 1}, 4, False, False), "position": ({"hold_read": 1, "catch": 1}, 2, True, False)}
DIGIT_WORDS = ("52-week high", "52W High", "ATR(14)", "RSI(14)", "S&P 500", "RSI 14", "10:05", "15:30", "15:50", "200MA", "20MA", "50MA", "52W", "R:R")
ACTIONABLE = ("triggered", "gapped_through", "reclaim")
CONTRACT = "1"
#: Tasks: the levels they are written for, and the blocks of signals they are given.
TASKS = {
    "note": (("sector", "industry"), ("movers_up", "movers_down", "leaders", "laggards", "fading", "emerging")), "rotation_phase": (("sector",), ("leaders",)),
    "rotation_map": (("sector", "industry"), ("outflows", "inflows")), "watchlist": (("sector", "industry"), ("watch",)), "risk_radar": (("sector", "industry"), ("strength", "fading", "emerging")),
}
#: Blocks: rows, order, how many of a session.
BLOCKS = {
    "movers_up": ("rank_month_delta_5d is not null", "rank_month_delta_5d desc", 8), "movers_down": ("rank_month_delta_5d is not null", "rank_month_delta_5d", 8),
    "leaders": ("momentum_score is not null", "momentum_score desc", 5), "laggards": ("momentum_score is not null", "momentum_score", 5),
    "fading": ("momentum_score >= mid and momentum_accel < 0", "momentum_accel", 5), "emerging": ("momentum_score < mid and momentum_accel > 0", "momentum_accel desc", 5),
    "outflows": ("momentum_accel < 0", "momentum_accel", 5), "inflows": ("momentum_accel > 0", "momentum_accel desc", 5),
    "watch": ("rs_cross = 1 or rs_new_high = 1", "rs_confirmed desc nulls last", 8), "strength": ("rs_confirmed is not null", "rs_confirmed desc", 6),
}


class UnregisteredField(KeyError):
    """A pack names a field that its surface doesn't have."""


def entries(surface: str, values: dict[str, Column]) -> Column:
    """The fields of a pack in an array of (key, value: (unit, num, said)); numbers stand in num, all else in said. Unregistered fields are an error."""
    unknown = sorted(set(values) - set(FIELDS[surface]))
    if unknown:
        raise UnregisteredField(f"{surface} has no field {', '.join(unknown)}")
    out = []
    for field, value in values.items():
        unit = FIELDS[surface][field]
        is_text = unit in ("text", "enum")
        out.append(F.struct(F.lit(field).alias("key"), F.struct(F.lit(unit).alias("unit"), (F.lit(None) if is_text else value).cast("double").alias("num"), (value if is_text else F.lit(None)).cast("string").alias("said")).alias("value")))
    return F.array(*out)


def pack(surface: str, values: dict[str, Column]) -> Column:
    """A pack as a map from field to (unit, num, said)."""
    return F.map_from_entries(entries(surface, values))


def checked(rows: DataFrame) -> DataFrame:
    """rows (surface, field, ...) with the unit of each field; a row with an unregistered one stops the job."""
    known = F.create_map(*[F.lit(x) for s, fields in FIELDS.items() for f, unit in fields.items() for x in (f"{s}/{f}", unit)])
    unit = F.try_element_at(known, F.concat_ws("/", "surface", "field"))
    return rows.withColumn("unit", F.when(unit.isNull(), F.raise_error(F.concat(F.lit("unregistered field: "), F.coalesce("field", F.lit("null"))))).otherwise(unit))


def over(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def cards(stock: DataFrame, groups: DataFrame) -> DataFrame:
    """(session_date, ticker, entries, notes): the entries of a pack for each bar of stock, with the read before it and its group's row of groups.

    Groups have a row for each group and session, and are read from files whose size Spark knows: it may
    broadcast them, and then the bars are shuffled by ticker alone.
    """
    by_ticker = W.partitionBy("ticker").orderBy("sidx")
    c = stock.withColumn("status", F.expr(STATUS))
    c = c.withColumns({"prior_status": F.lag("status").over(by_ticker), "prior_price": F.lag("close").over(by_ticker), "has_prior": F.lag(F.lit(1)).over(by_ticker).isNotNull()})
    g = groups.select(F.col("session_date").alias("g_date"), F.col("name").alias("g_name"), "rank_month", "rank_month_delta_5d", "rs_month", "rs_score", "rs_new_high", "momentum_score")
    c = c.join(g, (c["session_date"] == g["g_date"]) & (c["industry"] == g["g_name"]), "left")
    close, trigger, stop, atr = (F.col(k) for k in ("close", "prior_high", "prior_low", "atr"))
    yes = lambda flag: F.when(flag, "Yes").when(~flag, "No")
    fields = {
        "row.ticker": F.col("ticker").cast("string"), "row.group": F.col("industry"), "row.status": F.col("status"), "row.trigger": trigger, "row.stop": stop, "row.price": close,
        "row.open": F.col("open"), "row.high": F.col("high"), "row.low": F.col("low"), "row.change": 100 * (over(close, F.col("prev_close")) - 1), "row.atr": atr, "row.atr_from_lod": over(close - F.col("low"), atr),
        "row.volatility_w": F.col("volatility_w"), "row.pct_of_52w_high": F.col("below_high_pct"), "row.sma20_dist": F.col("sma20_pct"), "row.sma50_dist": F.col("sma50_pct"),
        "prior.status": F.col("prior_status"), "prior.price": F.col("prior_price"), "derived.sma20_ext_atr": F.col("atr_ext_20"), "derived.sma50_ext_atr": F.col("atr_ext_50"),
        "derived.stop_gap_pct": 100 * over(close - stop, close), "derived.stop_gap_atr": over(close - stop, atr), "derived.trigger_gap_pct": 100 * over(close - trigger, trigger),
        "derived.r_at_price": F.when(trigger > stop, (close - trigger) / (trigger - stop)), "derived.range_atr": over(F.col("high") - F.col("low"), atr),
        "derived.status_changed": F.when(F.col("has_prior"), yes(~F.col("prior_status").eqNullSafe(F.col("status")))), "derived.price_change_since_prior": 100 * over(close - F.col("prior_price"), F.col("prior_price")),
        "group.rank_month": F.col("rank_month"), "group.rank_month_delta_5d": F.col("rank_month_delta_5d"), "group.rs_month": F.col("rs_month"), "group.rs_score": F.col("rs_score"),
        "group.rs_new_high": yes(F.col("rs_new_high") == 1), "group.momentum_score": F.col("momentum_score"),
    }
    notes = F.array_compact(F.array(F.when(~F.col("has_prior"), "no prior read"), F.when(F.col("g_name").isNull(), "no group row"), F.lit("no earnings date")))
    return c.select("session_date", "ticker", entries("morning_card", fields).alias("entries"), notes.alias("notes"))


def ext_evidence_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field of every card, and how many notes the card has."""
    c = cards(RELATIONS["stock"](spark, sf_dir), RELATIONS["panel"](spark, sf_dir))
    return c.select("session_date", "ticker", F.size("notes").alias("n_notes"), F.inline("entries").alias("field", "v")).selectExpr("session_date", "ticker", "n_notes", "field", "v.unit AS unit", r("v.num", "num"), "v.said AS said")


_CARD_FIELDS = {
    "row.trigger": "pick_high", "row.stop": "pick_low", "row.price": "close", "row.open": "open", "row.high": "high", "row.low": "low", "row.change": "100 * (close / nullif(prev_close, 0) - 1)", "row.atr": "atr",
    "row.atr_from_lod": "(close - low) / nullif(atr, 0)", "row.volatility_w": "100 * tr / nullif(close, 0)", "row.pct_of_52w_high": "100 * (close / nullif(high52, 0) - 1)", "row.sma20_dist": "sma20_pct", "row.sma50_dist": "sma50_pct",
    "prior.price": "before_close", "derived.sma20_ext_atr": "(close - close / nullif(1 + sma20_pct / 100, 0)) / nullif(atr, 0)", "derived.sma50_ext_atr": "(close - close / nullif(1 + sma50_pct / 100, 0)) / nullif(atr, 0)",
    "derived.stop_gap_pct": "100 * ((close - pick_low) / nullif(close, 0))", "derived.stop_gap_atr": "(close - pick_low) / nullif(atr, 0)", "derived.trigger_gap_pct": "100 * ((close - pick_high) / nullif(pick_high, 0))",
    "derived.r_at_price": "CASE WHEN pick_high > pick_low THEN (close - pick_high) / (pick_high - pick_low) END", "derived.range_atr": "(high - low) / nullif(atr, 0)",
    "derived.price_change_since_prior": "100 * ((close - before_close) / nullif(before_close, 0))", "group.rank_month": "rank_month", "group.rank_month_delta_5d": "rank_month_delta_5d", "group.rs_month": "rs_month", "group.rs_score": "rs_score", "group.momentum_score": "momentum_score",
}
_CARD_WORDS = {
    "row.ticker": "cast(ticker AS VARCHAR)", "row.group": "industry", "row.status": "status", "prior.status": "before_status", "derived.status_changed": "CASE WHEN before_close IS NULL THEN NULL WHEN before_status <> status THEN 'Yes' ELSE 'No' END",
    "group.rs_new_high": "CASE rs_new_high WHEN 1 THEN 'Yes' WHEN 0 THEN 'No' END",
}
_UNITS = " ".join(f"WHEN '{f}' THEN '{u}'" for f, u in FIELDS["morning_card"].items())
_CARD_SQL = Query(
    "ext_evidence_pack",
    f"""WITH b AS (SELECT *, lag(high) OVER (PARTITION BY ticker ORDER BY sidx) AS pick_high, lag(low) OVER (PARTITION BY ticker ORDER BY sidx) AS pick_low, lag(close) OVER (PARTITION BY ticker ORDER BY sidx) AS before_close FROM {{bars}}),
s AS (SELECT b.*, CASE WHEN pick_high IS NULL THEN 'no_quote' WHEN close <= pick_low THEN 'invalidated' WHEN open > pick_high THEN 'gapped_through' WHEN close >= pick_high THEN 'triggered'
  WHEN sma20_pct > 0 AND least(low, pick_low) < close / (1 + sma20_pct / 100) OR sma50_pct > 0 AND least(low, pick_low) < close / (1 + sma50_pct / 100) THEN 'reclaim' WHEN high >= pick_high THEN 'failed_breakout' ELSE 'setting_up' END AS status FROM b),
t AS (SELECT s.*, lag(status) OVER (PARTITION BY ticker ORDER BY s.sidx) AS before_status, p.name AS group_name, p.rank_month, p.rank_month_delta_5d, p.rs_month, p.rs_score, p.rs_new_high, p.momentum_score
  FROM s LEFT JOIN {{panel}} p ON p.session_date = s.session_date AND p.name = s.industry)
SELECT session_date, ticker, 1 + (before_close IS NULL)::INT + (group_name IS NULL)::INT AS n_notes, field, CASE field {_UNITS} END AS unit,
  {r(f"CASE field {' '.join(f"WHEN '{k}' THEN {v}" for k, v in _CARD_FIELDS.items())} END", 'num')}, CASE field {' '.join(f"WHEN '{k}' THEN {v}" for k, v in _CARD_WORDS.items())} END AS said
FROM t, (SELECT unnest({list(FIELDS['morning_card'])}) AS field) f""",
)


def ext_pack_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pack of each session over all its rows."""
    c = RELATIONS["stock"](spark, sf_dir).withColumn("status", F.expr(STATUS))
    c = c.withColumn("was", F.lag("status").over(W.partitionBy("ticker").orderBy("sidx")))
    acts = F.col("status").isin(*ACTIONABLE)
    of = c.groupBy("session_date", "industry").agg(F.sum(acts.cast("int")).alias("n")).where("n > 0").groupBy("session_date").agg(F.count("*").alias("n_groups"), F.min(F.struct((-F.col("n")).alias("less"), "industry")).alias("top")).withColumnRenamed("session_date", "d")
    n = lambda flag: F.sum(F.when(flag, 1).otherwise(0))
    counts = {s: n(F.col("status") == s).alias(f"n_{s}") for s in ("triggered", "gapped_through", "reclaim", "failed_breakout", "setting_up", "invalidated", "no_quote")}
    median = lambda flag: F.median(F.when(flag, F.col("atr_ext_50")))
    t = c.groupBy("session_date").agg(F.count("*").alias("n_rows"), n(acts).alias("n_actionable"), n(F.col("was") != F.col("status")).alias("n_changed"), median(F.col("status") == "invalidated").alias("invalidated_ext_atr_median"), median(acts).alias("actionable_ext_atr_median"), *counts.values())
    t = t.join(of.hint("shuffle_hash"), F.col("session_date") == F.col("d"), "left")
    fields = {f"derived.{k}": F.col(k) for k in ("n_rows", "n_actionable", "n_changed", "invalidated_ext_atr_median", "actionable_ext_atr_median", *[f"n_{s}" for s in counts])}
    fields |= {"session.date": F.col("session_date"), "derived.n_groups_actionable": F.coalesce("n_groups", F.lit(0)), "derived.top_group": F.col("top.industry"), "derived.top_group_n": F.coalesce(-F.col("top.less"), F.lit(0))}
    return t.select("session_date", F.explode(pack("morning_triage", fields)).alias("field", "v")).selectExpr("session_date", "field", "v.unit AS unit", r("v.num", "num"), "v.said AS said")


_counted = {**{f"derived.n_{s}": f"count(*) FILTER (status = '{s}')" for s in ("triggered", "gapped_through", "reclaim", "failed_breakout", "setting_up", "invalidated", "no_quote")}, "derived.n_rows": "count(*)", "derived.n_actionable": f"count(*) FILTER (status IN {ACTIONABLE})", "derived.n_changed": "count(*) FILTER (was <> status)", "derived.invalidated_ext_atr_median": "median(CASE WHEN status = 'invalidated' THEN atr_ext_50 END)", "derived.actionable_ext_atr_median": f"median(CASE WHEN status IN {ACTIONABLE} THEN atr_ext_50 END)", "derived.n_groups_actionable": f"count(DISTINCT CASE WHEN status IN {ACTIONABLE} THEN industry END)"}
_TRIAGE_SQL = Query(
    "ext_pack_triage",
    f"""WITH s AS (SELECT *, {STATUS} AS status FROM {{stock}}), c AS (SELECT *, lag(status) OVER (PARTITION BY ticker ORDER BY sidx) AS was FROM s),
g AS (SELECT session_date, industry, count(*) AS n FROM c WHERE status IN {ACTIONABLE} GROUP BY ALL), top AS (SELECT DISTINCT ON (session_date) * FROM g ORDER BY session_date, n DESC, industry),
{', '.join(f"f{i} AS (SELECT session_date, '{k}' AS field, cast({v} AS DOUBLE) AS v, NULL AS said FROM c GROUP BY session_date)" for i, (k, v) in enumerate(_counted.items()))},
d AS (SELECT DISTINCT session_date FROM c),
a AS ({' UNION ALL '.join(f'SELECT * FROM f{i}' for i in range(len(_counted)))} UNION ALL SELECT session_date, 'session.date', NULL, cast(session_date AS VARCHAR) FROM d
  UNION ALL SELECT d.session_date, 'derived.top_group', NULL, industry FROM d LEFT JOIN top USING (session_date) UNION ALL SELECT d.session_date, 'derived.top_group_n', coalesce(n, 0), NULL FROM d LEFT JOIN top USING (session_date))
SELECT session_date, field, CASE field {' '.join(f"WHEN '{f}' THEN '{u}'" for f, u in FIELDS['morning_triage'].items())} END AS unit, {r('v', 'num')}, said FROM a""",
)


def ext_field_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often packs hold each registered field, and how often with a value; an unregistered field stops the job."""
    c = cards(RELATIONS["stock"](spark, sf_dir), RELATIONS["panel"](spark, sf_dir))
    rows = checked(c.select(F.lit("morning_card").alias("surface"), F.inline("entries").alias("field", "v")))
    return rows.groupBy("surface", "field", "unit").agg(F.count("*").alias("n"), F.count(F.coalesce(F.col("v.num").cast("string"), F.col("v.said"))).alias("n_known"))


def blocks(panel: DataFrame, level: str) -> DataFrame:
    """(level, session_date, block, names): each block's names in order."""
    mid = panel.groupBy(F.col("session_date").alias("d")).agg(F.median("momentum_score").alias("mid"))
    p = panel.join(mid.hint("shuffle_hash"), F.col("session_date") == F.col("d"))
    out = []
    for block, (where, order, n) in BLOCKS.items():
        place = F.expr(f"row_number() over (partition by session_date order by {order}, name)")
        top = p.where(where).select("session_date", "name", place.alias("place")).where(F.col("place") <= n)
        out.append(top.withColumn("block", F.lit(block)))
    rows = out[0]
    for more in out[1:]:
        rows = rows.union(more)
    names = F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"])
    return rows.groupBy("session_date", "block").agg(names.alias("names")).select(F.lit(level).alias("level"), "session_date", "block", "names")


def ext_task_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each task is given for each level and session: its blocks as one JSON object."""
    wanted = spark.createDataFrame([(t, level, b) for t, (levels, bs) in TASKS.items() for level in levels for b in bs], "task string, level string, block string")
    rows = blocks(RELATIONS["panel"](spark, sf_dir), "industry").union(blocks(RELATIONS["spanel"](spark, sf_dir), "sector"))
    rows = rows.join(F.broadcast(wanted), ["level", "block"])  # a row a task, level and block
    given = F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("block", "names")))))
    return rows.groupBy("task", "level", "session_date").agg(given.alias("given"))


def _block_sql(level: str, relation: str) -> str:
    where = {k: v[0].replace("mid", "(SELECT median(m.momentum_score) FROM REL m WHERE m.session_date = p.session_date)") for k, v in BLOCKS.items()}
    return " UNION ALL ".join(f"SELECT '{level}' AS level, session_date, '{b}' AS block, list(name ORDER BY place) AS names FROM (SELECT session_date, name, row_number() OVER (PARTITION BY session_date ORDER BY {BLOCKS[b][1]}, name) AS place FROM {relation} p WHERE {where[b].replace('REL', relation)}) t WHERE place <= {BLOCKS[b][2]} GROUP BY session_date" for b in BLOCKS)


_TASK_SQL = Query(
    "ext_task_specs",
    f"""WITH b AS ({_block_sql('industry', '{panel}')} UNION ALL {_block_sql('sector', '{spanel}')}),
w(task, level, block) AS (VALUES {', '.join(f"('{t}', '{level}', '{b}')" for t, (levels, bs) in TASKS.items() for level in levels for b in bs)})
SELECT task, level, session_date, cast(to_json(map_from_entries(list((block, names) ORDER BY block))) AS VARCHAR) AS given FROM b JOIN w USING (level, block) GROUP BY ALL""",
)


def validated(statements: DataFrame) -> DataFrame:
    """(response, nth, kind, rule, confidence, card_dropped): the first rule that each statement breaks, null if it is kept.

    statements: (response, nth, version, surface, kind, text, slots map, cites array, subjects array, confidence,
    fields map of field to whether it has a value, context map of block to keys, notes). Rules in order: contract
    version, kind, empty text, slots that text and declaration don't share, slots and citations that resolve to
    nothing, digits outside slots and known words, subjects, then the caps by kind and in all, first come first
    kept. A kept statement on a null field, on fewer than two fields, or on a field that a note names has low
    confidence; a surface that needs a catch and keeps none is dropped whole. Null texts, slots, cites and
    subjects count as empty; statements of an unknown surface have no kind that is valid.
    """
    slots = F.coalesce("slots", F.create_map().cast("map<string,string>"))
    cites, subjects = (F.coalesce(c, F.array().cast("array<string>")) for c in ("cites", "subjects"))
    known, context = F.map_keys("fields"), F.coalesce("context", F.create_map().cast("map<string,array<string>>"))
    slot = r"\{([A-Za-z_][A-Za-z0-9_.]*)\}"
    text = F.coalesce("text", F.lit(""))
    used, declared = F.array_distinct(F.regexp_extract_all(text, F.lit(slot), F.lit(1))), F.map_keys(slots)
    ref = lambda c: F.substring(c, 9, 100_000)

    def resolves(c: Column) -> Column:
        block, row = F.substring_index(ref(c), "#", 1), F.when(F.instr(c, "#") > 0, F.regexp_replace(ref(c), "^[^#]*#", "")).otherwise("")
        keys = F.try_element_at(context, block)
        return F.coalesce(F.when(c.startswith("context:"), keys.isNotNull() & ((row == "") | F.array_contains(keys, row))).otherwise(F.array_contains(known, c)), F.lit(False))

    probe = F.regexp_replace(text, slot, " ")
    for word in DIGIT_WORDS:
        probe = F.replace(probe, F.lit(word), F.lit(" "))
    caps = F.create_map(*[F.lit(x) for s, (kinds, _, _, _) in SURFACES.items() for k, n in kinds.items() for x in (f"{s}/{k}", n)])
    of = lambda i: F.try_element_at(F.create_map(*[F.lit(x) for s, v in SURFACES.items() for x in (s, v[i])]), F.col("surface"))
    rule = (
        F.when((F.coalesce("version", F.lit("")) != "") & (F.substring_index("version", ".", 1) != CONTRACT), "contract_version")
        .when(F.col("cap").isNull(), "kind").when(F.trim(F.regexp_replace(text, r"\s", " ")) == "", "shape")
        .when(F.size(F.array_except(used, declared)) > 0, "slot_undeclared").when(F.size(F.array_except(declared, used)) > 0, "slot_unused")
        .when(F.exists(F.map_values(slots), lambda f: F.coalesce(f.startswith("context:") | ~F.array_contains(known, f), F.lit(True))), "slot_unresolved")
        .when((F.size(cites) == 0) | F.exists(cites, lambda c: ~resolves(c)), "cite_unresolved").when(probe.rlike("[0-9]"), "bare_digit")
        .when((F.size(subjects) > 0) & ~of(3), "subjects")
    )
    s = statements.withColumn("cap", F.try_element_at(caps, F.concat_ws("/", "surface", "kind"))).withColumn("total", of(1)).withColumn("needs_catch", F.coalesce(of(2), F.lit(False))).withColumn("rule", rule)
    fine = F.col("rule").isNull()
    upto = lambda *by: W.partitionBy("response", *by).orderBy("nth").rowsBetween(W.unboundedPreceding, W.currentRow)
    s = s.withColumn("of_kind", F.sum(F.when(fine, 1).otherwise(0)).over(upto("kind"))).withColumn("in_cap", fine & (F.col("of_kind") <= F.col("cap")))
    s = s.withColumn("in_all", F.sum(F.when(F.col("in_cap"), 1).otherwise(0)).over(upto())).withColumn("kept", F.col("in_cap") & (F.col("in_all") <= F.col("total")))
    s = s.withColumn("kept_kind", F.sum(F.when(F.col("kept"), 1).otherwise(0)).over(upto("kind")))
    s = s.withColumn("rule", F.when(fine & ~F.col("kept"), F.when(F.col("kept_kind") >= F.col("cap"), "cap_kind").otherwise("cap_total")).otherwise(F.col("rule")))
    own = F.filter(cites, lambda c: ~c.startswith("context:"))
    thin = F.exists(own, lambda c: ~F.coalesce(F.try_element_at("fields", c), F.lit(False))) | (F.size(F.array_distinct(own)) < 2)
    thin = thin | F.exists(own, lambda c: F.regexp_like(F.coalesce("notes", F.lit("")), F.concat(F.lit(r"\b"), F.substring_index(c, ".", -1), F.lit(r"\b"))))
    said = F.when(F.col("confidence").isin("high", "medium", "low"), F.col("confidence")).otherwise("low")
    dropped = F.col("needs_catch") & (F.max(F.when(F.col("kept") & (F.col("kind") == "catch"), 1).otherwise(0)).over(W.partitionBy("response")) == 0)
    dropped = dropped | (F.max(F.when(F.col("rule") == "contract_version", 1).otherwise(0)).over(W.partitionBy("response")) == 1)
    return s.select("response", "nth", "kind", "rule", F.when(F.col("kept"), F.when(thin, "low").otherwise(said)).alias("confidence"), dropped.alias("card_dropped"))


def statements_of(chat: DataFrame) -> DataFrame:
    """The turns of a conversation as one response about a pack with three fields, faults of every sort among them."""
    k = "((conv_id * 7 + turn * 3) % 13)"
    return chat.selectExpr(
        "conv_id AS response", "turn AS nth", "CASE WHEN conv_id % 25 = 7 THEN '2.0' WHEN conv_id % 2 = 0 THEN '1.4' END AS version", "CASE WHEN conv_id % 4 = 3 THEN 'morning_triage' ELSE 'morning_card' END AS surface",
        f"CASE WHEN {k} = 3 THEN 'musing' WHEN turn % 3 = 1 THEN 'catch' WHEN conv_id % 4 = 3 THEN 'triage' ELSE 'read' END AS kind",
        f"CASE {k} WHEN 1 THEN 'Up 5 at {{p}}' WHEN 2 THEN 'No slot' WHEN 4 THEN ' \n' WHEN 5 THEN 'Uses {{q}}' WHEN 6 THEN 'Plain' WHEN 7 THEN '{{p}} over the 50MA and 52-week high' WHEN 12 THEN NULL ELSE 'Price {{p}} holds' END AS text",
        f"CASE WHEN {k} IN (2, 4) THEN map() WHEN {k} = 8 THEN map('p', 'context:groups') WHEN {k} = 9 THEN map('p', 'row.unknown') ELSE map('p', 'row.price') END AS slots",
        f"CASE {k} WHEN 10 THEN array() WHEN 11 THEN array(concat('context:groups#', role), 'row.atr', 'row.price') WHEN 7 THEN array('row.price', CASE WHEN turn % 2 = 0 THEN 'context:none' ELSE 'row.change' END) WHEN 2 THEN array('row.atr') ELSE array('row.price', 'row.atr') END AS cites",
        f"CASE WHEN {k} = 0 AND turn % 2 = 0 THEN array('x') END AS subjects", "CASE turn % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'sure' END AS confidence",
        "map('row.price', text IS NOT NULL, 'row.change', conv_id % 2 = 1, 'row.atr', true) AS fields", "map('groups', array('user', 'assistant')) AS context", "CASE WHEN conv_id % 3 = 0 THEN 'the change is stale' ELSE 'exchanges' END AS notes",
    )


def dq_contract_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validated(statements_of(table(spark, sf_dir, "conversations")))


_CONTRACT_SQL = f"""WITH c AS (SELECT *, (conv_id * 7 + turn * 3) % 13 AS k, conv_id % 4 = 3 AS triage FROM conversations),
s AS (SELECT *, CASE WHEN k = 3 THEN 'musing' WHEN turn % 3 = 1 THEN 'catch' WHEN triage THEN 'triage' ELSE 'read' END AS kind,
  CASE WHEN k = 11 THEN ['row.atr', 'row.price'] WHEN k = 7 AND turn % 2 = 1 THEN ['row.price', 'row.change'] WHEN k = 2 THEN ['row.atr'] ELSE ['row.price', 'row.atr'] END AS own FROM c),
f AS (SELECT *, CASE WHEN conv_id % 25 = 7 THEN 'contract_version' WHEN kind = 'musing' THEN 'kind' WHEN k IN (4, 12) THEN 'shape' WHEN k = 5 THEN 'slot_undeclared' WHEN k = 6 THEN 'slot_unused' WHEN k IN (8, 9) THEN 'slot_unresolved'
  WHEN k = 10 OR k = 7 AND turn % 2 = 0 OR k = 11 AND role NOT IN ('user', 'assistant') THEN 'cite_unresolved' WHEN k = 1 THEN 'bare_digit' WHEN k = 0 AND turn % 2 = 0 AND NOT triage THEN 'subjects' END AS fault FROM s),
n AS (SELECT *, count(*) FILTER (fault IS NULL) OVER (PARTITION BY conv_id, kind ORDER BY turn) AS of_kind FROM f),
r AS (SELECT *, coalesce(fault, CASE WHEN of_kind > CASE WHEN kind = 'triage' THEN 3 ELSE 1 END THEN 'cap_kind' END) AS rule FROM n)
SELECT conv_id AS response, turn AS nth, kind, rule,
  CASE WHEN rule IS NULL THEN CASE WHEN len(own) < 2 OR list_contains(own, 'row.price') AND text IS NULL OR list_contains(own, 'row.change') AND (conv_id % 2 = 0 OR conv_id % 3 = 0) THEN 'low' WHEN turn % 4 = 0 THEN 'high' WHEN turn % 4 = 1 THEN 'medium' ELSE 'low' END END AS confidence,
  count(*) FILTER (rule IS NULL AND kind = 'catch') OVER (PARTITION BY conv_id) = 0 AS card_dropped FROM r"""

FUNCTIONS = {f.__name__: f for f in (ext_evidence_pack, ext_pack_triage, ext_field_registry, ext_task_specs, dq_contract_validate)}
SQL = {
    "ext_evidence_pack": _CARD_SQL.sql(),
    "ext_pack_triage": _TRIAGE_SQL.sql(),
    "ext_field_registry": f"SELECT 'morning_card' AS surface, field, unit, count(*) AS n, count(coalesce(cast(num AS VARCHAR), said)) AS n_known FROM ({_CARD_SQL.sql()}) t GROUP BY ALL",
    "ext_task_specs": _TASK_SQL.sql(),
    "dq_contract_validate": _CONTRACT_SQL,
}
