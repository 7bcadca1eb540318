"""Logs, nested trees, feeds, exports, text sections, header drift, bootstrap and owner actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionforge.operators.stocks import KEY
from sessionforge.plans.registry import RELATIONS, Query, r
from sessionforge.sources.files import displayed, embedded_rows, migrated, read_log, read_panel, table_rows
from sessionforge.sources.gated import Gate, GatedStore, attempt
from sessionforge.sources.market import LOOKBACKS, shared_folder, table

#: Date-level means are drawn in blocks of BLOCK sessions, RESAMPLES times.
BLOCK, RESAMPLES = 3, 20_000
#: Headers by the section that they open.
SECTIONS = {"headline": ("headline", "tl;dr"), "risks": ("risks", "what could go wrong")}
LISTED = 5


LINES = """concat(chr(123), '"event_id":', cast(event_id AS string), ',"month":"', cast(year(ts) AS string), '-', lpad(cast(month(ts) AS string), 2, '0'), '","cost":', cast(event_id % 100 AS string), CASE WHEN event_id % 10 = 3 THEN '' ELSE chr(125) END)"""


def src_jsonl_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log with a line for each event, every tenth of them cut short, written and read back."""
    at = shared_folder(spark)
    table(spark, sf_dir, "events").selectExpr(f"{LINES} AS line").write.text(at)
    return read_log(spark, at, "event_id long, cost double", "2024-01").select("event_id", "cost")


def src_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots as text files, with a percent sign behind each return, read back as dates and numbers."""
    numbers = ["stocks", "avg_volume", "px", *[f"perf_{m}" for m in (*LOOKBACKS, "ytd")]]
    at = shared_folder(spark)
    text = [F.concat(F.coalesce(F.col(c).cast("string"), F.lit("-")), F.lit("%" if c.startswith("perf") else "")).alias(c) for c in numbers]
    RELATIONS["snap"](spark, sf_dir).select(F.col("session_date").cast("string").alias("date"), "name", *text).write.option("header", True).csv(at)
    got = read_panel(spark, at, numbers)
    return got.selectExpr("date AS session_date", "name", "cast(stocks AS int) AS stocks", "cast(avg_volume AS bigint) AS avg_volume", "floor(px * 1e6) / 1e6 AS px", *[r(c) for c in numbers if c.startswith("perf")])


def src_page_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a table of a group's tickers and cents, one row in seventeen short of a cell, made of the bars and read."""
    row = F.concat(F.lit('<tr><td><a href="q?t='), "ticker", F.lit('">'), "ticker", F.lit("</a></td><td> "), F.floor(F.col("close") * 100 + 0.5), F.lit(" </td>"), F.when(F.col("ticker") % 17 == 0, "").otherwise("<td>x</td>"), F.lit("</tr>"))
    pages = RELATIONS["bars"](spark, sf_dir).groupBy("session_date", "industry").agg(F.array_join(F.collect_list(row), "\n").alias("rows"))
    html = F.concat(F.lit("<table><tr><th>Symbol</th><th><b>Last</b></th><th>Junk</th></tr>"), "rows", F.lit("</table>"))
    found = pages.select("session_date", "industry", F.explode(table_rows(html, {"Symbol": "Ticker", "Last": "Price"}, ["Ticker", "Price"])).alias("m"))
    return found.select("session_date", "industry", F.col("m")["Ticker"].try_cast("bigint").alias("ticker"), F.col("m")["Price"].try_cast("double").alias("cents"))


def src_embedded_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that hold a session's quotes as embedded JSON, made of the bars, back under their labels.

    Before the script with the quotes stand one that is cut short and one without rows; one behind it isn't read.
    """
    cents = lambda c: F.floor(F.expr(c) * 100 + 0.5) / 100
    values = {"price": cents("close"), "change": cents("100 * (close / prev_close - 1)"), "volume": F.col("volume").cast("double"), "averageVolume": (F.floor("avg_volume") * 10_000_000).cast("double"), "marketCap": cents("close * (ticker % 40)")}
    numbers = F.map_filter(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())
    earnings = F.concat(F.date_add("session_date", F.col("ticker").cast("int")).cast("string"), F.element_at(F.array(*map(F.lit, ("", "T08:30:00", "T16:30:00"))), (F.col("ticker") % 3 + 1).cast("int")))
    text = F.create_map(F.lit("ticker"), F.when(F.col("ticker") % 13 == 0, "").otherwise(F.col("ticker").cast("string")), F.lit("industry"), F.col("industry"), F.lit("earningsDate"), F.when(F.col("ticker") % 7 == 0, "soon").otherwise(earnings))
    pages = RELATIONS["bars"](spark, sf_dir).groupBy("session_date", F.col("ticker") % 64).agg(F.to_json(F.struct(F.struct(F.collect_list(F.struct(text.alias("text"), numbers.alias("numbers"))).alias("rows")).alias("data"))).alias("json"))
    script = lambda *c: F.concat(F.lit("<script data-ssr-props>"), *c, F.lit("</script>"))
    html = F.concat(F.lit("<html><script>var x=1</script>"), script(F.substring("json", 1, 30)), script(F.lit('{"data":{"rows":"later"}}')), script("json"), script(F.lit('{"data":{"rows":[{"text":{"ticker":"9"}}]}}')), F.lit("</html>"))
    got = embedded_rows(pages.select("session_date", html.alias("html")), ["Ticker", "Industry", "Price", "Change", "Volume", "Avg Volume", "Market Cap", "Earnings", "ATR"])
    return got.toDF("session_date", "ticker", "industry", "price", "change", "volume", "avg_volume", "market_cap", "earnings", "atr")


def fn_display_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and dates of the bars in each of the display forms."""
    bars = RELATIONS["bars"](spark, sf_dir)
    cents = lambda c: F.floor(F.expr(c) * 100 + 0.5) / 100
    values = {
        "f2": cents("close"), "pct": F.when(F.col("ticker") % 9 != 0, cents("sma20_pct")), "int": F.expr("volume * (ticker % 5) * pow(10, sidx % 6)"), "money": cents("close * (ticker % 40)"),
        "count": F.floor("avg_volume") * F.pow(F.lit(10), F.col("ticker") % 10), "earn": F.concat("session_date", F.element_at(F.array(*map(F.lit, ("", "T08:30", "T12:00", " soon"))), (F.col("ticker") % 4 + 1).cast("int"))),
    }
    return bars.select("ticker", "session_date", *[displayed(v.cast("string"), k).alias(k) for k, v in values.items()])


def snk_upsert_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stores after later writes of their last sessions, one with rows, one with none and one that the gate keeps out.

    In the first a date is replaced whole; in the second rows are replaced by date and name.
    """
    rows = RELATIONS["ssnap"](spark, sf_dir).select("session_date", "name", "stocks", "sidx")
    later = rows.where("sidx >= 80 AND length(name) % 3 <> 0").withColumn("stocks", F.col("stocks") + 1)
    gate = Gate(refused={"negative stocks": "stocks < 0"}, empty="skip")
    out = []
    for keys in (["session_date"], ["session_date", "name"]):
        store = GatedStore(spark, shared_folder(spark), "session_date date, name string, stocks int", keys)
        for batch in (rows, later, rows.where("stocks < 0")):
            store.upsert(batch, gate)
        kept = attempt(store, rows.withColumn("stocks", F.when(F.col("sidx") > 80, -1).otherwise(7)), gate)[0]
        out.append(store.read().select(F.lit("+".join(keys)).alias("keys"), "session_date", "name", "stocks", F.lit(kept).alias("last_write")))
    return out[0].union(out[1])


def snk_schema_migrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store whose later part has a column more, in another order."""
    rows = RELATIONS["ssnap"](spark, sf_dir)
    old = rows.where("sidx < 40").select("session_date", "name", "stocks")
    new = rows.where("sidx >= 40").select((F.col("stocks") * 2).alias("added"), "name", "stocks", "session_date")
    return migrated([old, new], ["session_date", "name", "stocks", "added"])


def taxonomy_rows(trees: DataFrame) -> DataFrame:
    """(sector, industry) of nested JSON trees (tree); a node without a sector or industries stops the job."""
    tree = F.from_json("tree", "sector string, industries array<struct<name string>>")
    whole = F.when(F.col("t.sector").isNull() | F.col("t.industries").isNull(), F.raise_error(F.concat(F.lit("malformed node: "), F.coalesce("tree", F.lit("null"))))).otherwise(F.col("t.industries"))
    return trees.withColumn("t", tree).select(F.col("t.sector").alias("sector"), F.explode(whole).alias("i")).select("sector", F.col("i.name").alias("industry"))


def src_nested_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts' types and brands, as trees and back; a tree holds each brand once."""
    pairs = table(spark, sf_dir, "part").select("p_type", "p_brand").distinct()
    trees = pairs.groupBy("p_type").agg(F.collect_list(F.struct(F.col("p_brand").alias("name"))).alias("industries"))
    return taxonomy_rows(trees.select(F.to_json(F.struct(F.col("p_type").alias("sector"), "industries")).alias("tree")))


def export_all(frames: dict[str, DataFrame], folder: str) -> list[str]:
    """Writes each relation that has rows under folder/kind=<name>; the names written."""
    written = []
    for name, df in frames.items():
        if not df.isEmpty():
            df.write.mode("overwrite").parquet(f"{folder}/kind={name}")
            written.append(name)
    return written


def snk_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of sectors and benchmarks, written and read back; what is empty leaves no folder."""
    columns, at = ("session_date", "name", "px"), shared_folder(spark)
    frames = {"sector": RELATIONS["ssnap"](spark, sf_dir), "benchmark": RELATIONS["bench"](spark, sf_dir), "none": RELATIONS["bench"](spark, sf_dir).where("name is null")}
    export_all({k: v.select(*columns) for k, v in frames.items()}, at)
    return spark.read.parquet(at).selectExpr("kind", "session_date", "name", r("px"))


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def without_first(c: Column) -> Column:
    return F.slice(c, F.lit(2), F.greatest(F.lit(0), F.size(c) - 1))


def sections(text: Column) -> dict[str, Column]:
    """The body of each section of a text in which lines of two and more # open one; of several the last, null if blank."""
    parts = without_first(F.split(F.concat(F.lit("\n"), text), r"\n[ \t]*#{2,}\s+"))
    heads = F.transform(parts, lambda p: F.struct(F.lower(F.regexp_replace(F.substring_index(p, "\n", 1), r"[\s:]+$", "")).alias("head"), stripped(F.regexp_replace(p, r"^[^\n]*", "")).alias("body")))

    def last(names: tuple[str, ...]) -> Column:
        bodies = F.transform(F.filter(heads, lambda h: h["head"].isin(*names) & (h["body"] != "")), lambda h: h["body"])
        return F.get(bodies, F.size(bodies) - 1)  # null where there is none

    return {key: last(names) for key, names in SECTIONS.items()}


def phase(text: Column) -> tuple[Column, Column]:
    """Label and reasoning of a two-line answer; without prefixes the first line and the rest."""
    lines = F.filter(F.transform(F.split(text, "\n"), stripped), lambda x: x != "")

    def told(prefix: str) -> Column:
        return stripped(F.regexp_extract(text, rf"(?im)^[ \t]*(?:{prefix}):(.*)$", 1))

    label, why = told("label"), told("why|reasoning")
    rest = F.array_join(without_first(lines), " ")
    return F.when(label != "", label).otherwise(F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(""))), F.when((label != "") | (why != ""), why).otherwise(rest)


def fn_split_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections and phase of texts made of the conversations' turns."""
    chat = table(spark, sf_dir, "conversations").selectExpr(
        "conv_id", "turn", "concat('preamble\n', CASE turn % 3 WHEN 0 THEN '## TL;DR:' WHEN 1 THEN '#### Headline' ELSE '## Chatter' END, '\n', coalesce(text, ''), '\n### What could go wrong\n', role) AS whole",
        "CASE WHEN turn % 2 = 0 THEN concat('Label: ', role, '\nWhy: ', cast(turn AS string)) ELSE concat(role, '\n\nturn\n', cast(turn AS string)) END AS answer",
    )
    label, why = phase(F.col("answer"))
    return chat.select("conv_id", "turn", *[c.alias(k) for k, c in sections(F.col("whole")).items()], label.alias("phase"), why.alias("reasoning"))


_places = "SELECT session_date, name, row_number() OVER (PARTITION BY session_date ORDER BY rank_half NULLS LAST, name) AS by_half, row_number() OVER (PARTITION BY session_date ORDER BY rank_month NULLS LAST, name) AS by_month, count(*) OVER (PARTITION BY session_date) AS n FROM {panel}"


def _feed(head: str, listed: str) -> str:
    lists = {k: listed.replace("PLACE", v) for k, v in {"leaders": "by_half", "movers": "by_month"}.items()}
    return f"SELECT session_date, {head.replace('LEADERS', lists['leaders']).replace('MOVERS', lists['movers'])} AS feed FROM ({_places}) t WHERE by_half <= {LISTED} OR by_month <= {LISTED} GROUP BY session_date"


def _bootstrap(blocks: str, offsets: str, chance: str, low: str, high: str) -> str:
    return f"""WITH d AS (SELECT sidx, avg(perf_quarter) AS m FROM {{ssnap}} WHERE perf_quarter IS NOT NULL GROUP BY sidx),
p AS (SELECT m, cast(row_number() OVER (ORDER BY sidx) - 1 AS bigint) AS pos FROM d), n AS (SELECT cast(count(*) AS int) AS n FROM p),
b AS (SELECT id, {blocks} AS k, (SELECT n FROM n) AS n FROM range({RESAMPLES}) t(id) WHERE (SELECT n FROM n) >= {BLOCK}),
s AS (SELECT id, k, n, {chance} % (n - {BLOCK - 1}) AS first_pos FROM b), o AS (SELECT id, k, n, first_pos, {offsets} AS i FROM s),
x AS (SELECT /*+ BROADCAST(p) */ o.id, avg(p.m) AS m FROM o JOIN p ON p.pos = o.first_pos + o.i WHERE o.k * {BLOCK} + o.i < o.n GROUP BY o.id)
SELECT cast(count(*) AS int) AS resamples, {r(low, 'ci_low')}, {r(high, 'ci_high')} FROM x"""


_raw = {"Ticker": "CASE WHEN ticker % 17 = 0 THEN '' ELSE cast(ticker AS string) END", "Price": "cast(cast(floor(close * 100 + 5e-1) AS bigint) AS string)", "ATR": "'-'", "Volume": "cast(volume AS string)"}
_projected = f"SELECT {KEY}, cast(raw_ticker AS string) AS quoted, try_cast(raw_price AS double) AS price, try_cast(raw_atr AS double) AS atr, try_cast(raw_volume AS double) AS volume, raw FROM (SELECT {KEY}, {', '.join(f'{v} AS raw_{k.lower()}' for k, v in _raw.items())}, RAW AS raw FROM {{bars}}) t WHERE raw_ticker <> ''"

#: What an owner may do: the event that stands for it, the state it needs and the state it leads to.
ACTIONS = {"purchase": ("confirm", "closing", "closed"), "view": ("still_holding", "closing", "managing"), "click": ("correct", "closed", "closed"), "signup": ("reopen", "closed", "managing"), "error": ("reopen", "closed", "managing")}


def owner_transitions(actions: DataFrame, states: DataFrame) -> DataFrame:
    """(position, nth, action, found, accepted, state): actions (position, nth, action) applied in order to states (position, state).

    An action is accepted if its position is in the state it needs, and refused otherwise; then, and where
    there is no position, nothing changes. What a batch does to one position is one array.
    """
    of = {action: (needs, leads) for action, needs, leads in ACTIONS.values()}
    pick = lambda a, i: F.try_element_at(F.create_map(*[F.lit(x) for k, v in of.items() for x in (k, v[i])]), a)
    seen = actions.groupBy(F.col("position").alias("of")).agg(F.sort_array(F.collect_list(F.struct("nth", "action"))).alias("asked"))
    seen = seen.join(states.hint("merge"), F.col("of") == F.col("position"), "left")
    told = "array<struct<nth:bigint,action:string,found:string,accepted:boolean,state:string>>"

    def step(acc: Column, a: Column) -> Column:
        fine = F.coalesce(acc["state"] == pick(a["action"], 0), F.lit(False))
        state = F.when(fine, pick(a["action"], 1)).otherwise(acc["state"])
        row = F.struct(a["nth"].alias("nth"), a["action"].alias("action"), acc["state"].alias("found"), fine.alias("accepted"), state.alias("state"))
        return F.struct(state.alias("state"), F.concat(acc["told"], F.array(row)).cast(told).alias("told"))

    end = F.aggregate("asked", F.struct(F.col("state").alias("state"), F.array().cast(told).alias("told")), step, lambda acc: acc["told"])
    return seen.select("of", F.explode(end).alias("t")).select(F.col("of").alias("position"), "t.*")


def sm_owner_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as an owner's action on the position that the ticker's last bar leaves, in the order of time."""
    last = RELATIONS["stock"](spark, sf_dir).groupBy(F.col("ticker").alias("position")).agg(F.max_by(F.struct("low", "prior_low", "close", "ma50"), "sidx").alias("b"))
    states = last.select("position", F.expr("CASE WHEN b.low <= b.prior_low THEN 'closed' WHEN b.close < b.ma50 THEN 'closing' ELSE 'managing' END").alias("state"))
    action = F.try_element_at(F.create_map(*[F.lit(x) for k, v in ACTIONS.items() for x in (k, v[0])]), F.col("event_type"))
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("position"), F.col("event_id").cast("long").alias("nth"), action.alias("action"))
    return owner_transitions(events.where("position is not null and action is not null"), states).withColumnsRenamed({"position": "user_id", "nth": "event_id"})


_OWNER_SQL = Query(
    "sm_owner_transitions",
    f"""WITH v(event_type, action, needs, leads) AS (VALUES {', '.join(f"('{k}', '{a}', '{n}', '{l}')" for k, (a, n, l) in ACTIONS.items())}),
e AS (SELECT user_id, event_id, v.*, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events JOIN v USING (event_type) WHERE user_id IS NOT NULL),
p AS (SELECT ticker, CASE WHEN low <= prior_low THEN 'closed' WHEN close < ma50 THEN 'closing' ELSE 'managing' END AS state FROM {{stock}} QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY sidx DESC) = 1),
f AS (SELECT e.user_id, e.event_id, e.nth, e.action, p.state AS found, coalesce(p.state = e.needs, false) AS accepted, CASE WHEN p.state = e.needs THEN e.leads ELSE p.state END AS state FROM e LEFT JOIN p ON p.ticker = e.user_id WHERE e.nth = 1
UNION ALL SELECT e.user_id, e.event_id, e.nth, e.action, f.state, coalesce(f.state = e.needs, false), CASE WHEN f.state = e.needs THEN e.leads ELSE f.state END FROM f JOIN e ON e.user_id = f.user_id AND e.nth = f.nth + 1)
SELECT user_id, event_id, action, found, accepted, state FROM f""",
)

QUERIES = [
    Query(
        "snk_signal_feed",
        _feed("to_json(named_struct('version', 2, 'as_of', cast(session_date AS string), 'n_rows', cast(max(n) AS int), 'leaders', LEADERS, 'movers', MOVERS))", f"transform(array_sort(collect_list(CASE WHEN PLACE <= {LISTED} THEN struct(PLACE, name) END)), x -> x.name)"),
        _feed("cast(to_json(struct_pack(version := 2, as_of := cast(session_date AS string), n_rows := cast(max(n) AS int), leaders := LEADERS, movers := MOVERS)) AS VARCHAR)", f"list(name ORDER BY PLACE) FILTER (PLACE <= {LISTED})"),
    ),
    Query("fn_quote_projection", _projected.replace("RAW", f"to_json(map({', '.join(f'{chr(39)}{k}{chr(39)}, {v}' for k, v in _raw.items())}))"), _projected.replace("RAW", f"cast(to_json(map([{', '.join(f'{chr(39)}{k}{chr(39)}' for k in _raw)}], [{', '.join(_raw.values())}])) AS VARCHAR)")),
    Query(
        "ag_block_bootstrap",
        _bootstrap(f"explode(sequence(0, cast(ceil((SELECT n FROM n) / {BLOCK}e0) AS int) - 1))", f"explode(sequence(0, {BLOCK - 1}))", "cast(conv(substr(md5(concat(cast(id AS string), '|', cast(k AS string))), 1, 7), 16, 10) AS bigint)", "percentile(m, 0.025)", "percentile(m, 0.975)"),
        _bootstrap(f"unnest(range(0, cast(ceil((SELECT n FROM n) / {BLOCK}e0) AS int)))", f"unnest(range(0, {BLOCK}))", "('0x' || substr(md5(concat(cast(id AS string), '|', cast(k AS string))), 1, 7))::BIGINT", "quantile_cont(m, 0.025)", "quantile_cont(m, 0.975)"),
    ),
]

FUNCTIONS = {f.__name__: f for f in (src_jsonl_log, src_snapshots, src_page_extract, src_embedded_json, fn_display_format, snk_upsert_date, snk_schema_migrate, src_nested_taxonomy, snk_export, fn_split_sections, sm_owner_transitions)}

_strip = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_size = lambda v: f"CASE WHEN {v} >= 1e9 THEN printf('%.2f', {v} / 1e9) || 'B' WHEN {v} >= 1e6 THEN printf('%.2f', {v} / 1e6) || 'M' WHEN {v} >= 1e3 THEN printf('%.2f', {v} / 1e3) || 'K' ELSE printf('%.2f', {v}) END"
_money = lambda v: f"CASE WHEN {v} >= 1e3 THEN printf('%.2f', {v} / 1e3) || 'B' ELSE printf('%.2f', {v}) || 'M' END"
SQL = {
    "src_jsonl_log": Query("src_jsonl_log", f"SELECT event_id, cast(json_extract(line, '$.cost') AS DOUBLE) AS cost FROM (SELECT event_id, {LINES} AS line FROM events) t WHERE CASE WHEN json_valid(line) THEN json_extract_string(line, '$.month') = '2024-01' END").sql(),
    "src_snapshots": Query("src_snapshots", f"SELECT session_date, name, stocks, avg_volume, floor(px * 1e6) / 1e6 AS px, {', '.join(r(f'perf_{m}') for m in (*LOOKBACKS, 'ytd'))} FROM {{snap}}").sql(),
    "src_page_extract": Query("src_page_extract", "SELECT session_date, industry, ticker, floor(close * 100 + 5e-1) AS cents FROM {bars} WHERE ticker % 17 <> 0").sql(),
    "src_embedded_json": Query(
        "src_embedded_json",
        f"""SELECT session_date, cast(ticker AS VARCHAR) AS ticker, industry, printf('%.2f', floor(close * 100 + 5e-1) / 100) AS price, coalesce(printf('%.2f', floor(100 * (close / prev_close - 1) * 100 + 5e-1) / 100) || '%', '-') AS change, format('{{:,}}', volume) AS volume,
{_size('floor(avg_volume) * 1e7')} AS avg_volume, {_money('floor(close * (ticker % 40) * 100 + 5e-1) / 100')} AS market_cap,
CASE WHEN ticker % 7 = 0 THEN '-' ELSE strftime(session_date + cast(ticker AS INT), '%b %d') || CASE ticker % 3 WHEN 0 THEN '' WHEN 1 THEN '/b' ELSE '/a' END END AS earnings, '-' AS atr FROM {{bars}} WHERE ticker % 13 <> 0""",
    ).sql(),
    "fn_display_format": Query(
        "fn_display_format",
        f"""SELECT ticker, session_date, printf('%.2f', floor(close * 100 + 5e-1) / 100) AS f2, CASE WHEN ticker % 9 = 0 OR sma20_pct IS NULL THEN '-' ELSE printf('%.2f%%', floor(sma20_pct * 100 + 5e-1) / 100) END AS pct, format('{{:,}}', cast(volume * (ticker % 5) * cast(pow(10, sidx % 6) AS BIGINT) AS BIGINT)) AS int,
{_money('floor(close * (ticker % 40) * 100 + 5e-1) / 100')} AS money, {_size('floor(avg_volume) * pow(10, ticker % 10)')} AS count, strftime(session_date, '%b %d') || CASE ticker % 4 WHEN 1 THEN '/b' WHEN 2 THEN '/a' ELSE '' END AS earn FROM {{bars}}""",
    ).sql(),
    "snk_upsert_date": Query(
        "snk_upsert_date",
        """SELECT 'session_date' AS keys, session_date, name, CASE WHEN sidx >= 80 THEN stocks + 1 ELSE stocks END AS stocks, 'abort: negative stocks' AS last_write FROM {ssnap} s WHERE sidx < 80 OR length(name) % 3 <> 0 OR session_date NOT IN (SELECT session_date FROM {ssnap} WHERE length(name) % 3 <> 0)
UNION ALL SELECT 'session_date+name', session_date, name, CASE WHEN sidx >= 80 AND length(name) % 3 <> 0 THEN stocks + 1 ELSE stocks END, 'abort: negative stocks' FROM {ssnap}""",
    ).sql(),
    "snk_schema_migrate": Query("snk_schema_migrate", "SELECT session_date, name, stocks, CASE WHEN sidx >= 40 THEN stocks * 2 END AS added FROM {ssnap}").sql(),
    "sm_owner_transitions": _OWNER_SQL.sql().replace("WITH", "WITH RECURSIVE", 1),
    "src_nested_taxonomy": "SELECT DISTINCT p_type AS sector, p_brand AS industry FROM part",
    "snk_export": Query("snk_export", f"SELECT 'sector' AS kind, session_date, name, {r('px')} FROM {{ssnap}} UNION ALL SELECT 'benchmark' AS kind, session_date, name, {r('px')} FROM {{bench}}").sql(),
    "fn_split_sections": f"""SELECT conv_id, turn, CASE WHEN turn % 3 < 2 THEN nullif({_strip.format("coalesce(text, '')")}, '') END AS headline, nullif(role, '') AS risks, role AS phase, CASE WHEN turn % 2 = 0 THEN cast(turn AS VARCHAR) ELSE 'turn ' || turn END AS reasoning FROM conversations""",
}
