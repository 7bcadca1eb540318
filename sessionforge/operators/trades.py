"""The trade lifecycle as a fold over a position's bars, in Catalyst expressions.

A position's bars after its opening, at most 30 of them, are one sorted array; the state is a struct.
A bar either signals an exit, after which the state stays, or moves the floor, the stop and the trims.
Settings are a struct too: a position's own, given as JSON, come before the engine's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionforge.plans.registry import RELATIONS, Query, r
from sessionforge.sources.market import tasks

# Engine settings by name, with their types.
SETTINGS = {
    "BREAKEVEN_R": ("double", 1.0), "BREAKEVEN_TRIGGER": ("string", "high"), "WIDEN_TRAIL_BASIS": ("boolean", True), "TRIM_START_ATR": ("int", 7), "TRIM_PCT": ("double", 0.1),
    "TWO_CLOSE_EXIT": ("int", 2), "HARD_EXIT_BASIS": ("string", "50ma"), "SEVERE_BREAKDOWN_ATR": ("double", 3.0), "EARNINGS_WARN_SESSIONS": ("int", 10),
}
MOST_BARS = 30
STATE = "struct<state:string,stop:double,floor:double,basis:string,caution:int,qty:double,trimmed:int,exit_price:double,exit_reason:string,advanced:int,earnings:int,warnings:int>"
BAR = ("sidx", "open", "high", "low", "close", "prev_close", "atr", "ma20", "ma50", "earnings_in")


def settings(own: Column) -> Column:
    """The engine's settings with a position's own (JSON, null if it has none) before them; malformed JSON changes nothing."""
    given = F.from_json(own, ", ".join(f"{k} {t}" for k, (t, _) in SETTINGS.items()))
    return F.struct(*[F.coalesce(given[k], F.lit(v).cast(t)).alias(k) for k, (t, v) in SETTINGS.items()])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """A value computed once and used in body."""
    return F.transform(F.array(value), body)[0]


def advance(s: Column, b: Column, entry: Column, risk: Column, cfg: Column) -> Column:
    """The state after a bar; entry and risk (entry less first stop) are the position's."""
    stopped, gapped = b["low"] <= s["stop"], b["open"] < s["stop"]
    below = F.coalesce(b["close"] < b["ma20"], F.lit(False))
    caution = F.when(below, s["caution"] + 1).when(b["ma20"].isNotNull(), 0).otherwise(s["caution"])
    by_20 = cfg["HARD_EXIT_BASIS"] == "20ma"
    reason = (
        F.when(stopped & gapped, "gap_down_below_stop").when(stopped, "stop_hit").when(by_20 & below, "close_below_20ma").when(~by_20 & (b["close"] < b["ma50"]), "close_below_50ma")
        .when((b["prev_close"] - b["close"]) / F.when(b["atr"] > 0, b["atr"]) >= cfg["SEVERE_BREAKDOWN_ATR"], "severe_breakdown").when(below & (caution >= cfg["TWO_CLOSE_EXIT"]), "two_close_below_20ma")
    )
    price = F.when(stopped, F.when(gapped, b["open"]).otherwise(s["stop"])).otherwise(b["close"])
    reached = F.when(cfg["BREAKEVEN_TRIGGER"] == "close", b["close"]).otherwise(b["high"])
    floor = F.when((risk > 0) & ((reached - entry) / risk >= cfg["BREAKEVEN_R"]), F.greatest(s["floor"], entry)).otherwise(s["floor"])
    wide = cfg["WIDEN_TRAIL_BASIS"] & F.coalesce(b["ma50"] > entry, F.lit(False))
    basis, trail = F.when(wide, "50ma").otherwise("20ma"), F.when(wide, b["ma50"]).otherwise(b["ma20"])
    ext = F.floor((b["close"] - b["ma50"]) / F.when(b["atr"] > 0, b["atr"])).cast("int")
    levels = F.greatest(F.lit(0), F.coalesce(ext, F.lit(0)) - F.greatest(cfg["TRIM_START_ATR"] - 1, s["trimmed"]))
    earnings = F.coalesce(b["earnings_in"], s["earnings"])
    warned = F.when((earnings >= 0) & (earnings <= cfg["EARNINGS_WARN_SESSIONS"]), 1).otherwise(0)

    def managed(f: Column) -> Column:
        stop = F.when(trail.isNull(), F.greatest(s["stop"], f)).when(basis != s["basis"], F.greatest(f, trail)).otherwise(F.greatest(s["stop"], trail, f))
        return F.struct(
            F.lit("managing").alias("state"), stop.alias("stop"), f.alias("floor"), F.when(trail.isNull(), s["basis"]).otherwise(basis).alias("basis"), caution.alias("caution"),
            (s["qty"] * F.pow(1 - cfg["TRIM_PCT"], levels)).alias("qty"), F.when(levels > 0, ext).otherwise(s["trimmed"]).alias("trimmed"),
            F.lit(None).cast("double").alias("exit_price"), F.lit(None).cast("string").alias("exit_reason"), b["sidx"].alias("advanced"), earnings.alias("earnings"), (s["warnings"] + warned).alias("warnings"),
        ).cast(STATE)

    def left(why: Column) -> Column:
        kept = [s[k] for k in ("stop", "floor", "basis", "caution", "qty", "trimmed")]
        return F.struct(F.lit("closing").alias("state"), *kept, price.alias("exit_price"), why.alias("exit_reason"), b["sidx"].alias("advanced"), s["earnings"], s["warnings"]).cast(STATE)

    moved = let(reason, lambda why: F.when(why.isNotNull(), left(why)).otherwise(let(floor, managed)))
    return F.when((s["state"] == "closing") | (b["sidx"] <= s["advanced"]) | b["close"].isNull(), s).otherwise(moved)


def opened_state(stop: Column, at: Column) -> Column:
    """The state of a position as it is opened."""
    none = F.lit(None)
    parts = {"state": F.lit("open"), "stop": stop, "floor": stop, "basis": F.lit("20ma"), "caution": F.lit(0), "qty": F.lit(100.0), "trimmed": F.lit(0), "exit_price": none, "exit_reason": none, "advanced": at, "earnings": none, "warnings": F.lit(0)}
    return F.struct(*[v.alias(k) for k, v in parts.items()]).cast(STATE)


def folded(positions: DataFrame, bars: DataFrame, most: int = MOST_BARS) -> DataFrame:
    """positions (ticker, opened, entry, first_stop, and config if they have their own) with their final state after the next bars, at most `most` of them.

    A bar is (ticker, *BAR); bars of one ticker and session are alike. Of positions with the same ticker
    and opening, entry, stop or config tell them apart. A ticker's bars are shuffled once, as one array, and
    each of its positions reads its part of that array where it is joined.
    """
    keys = ["opened", "entry", "first_stop", "config"]
    p = positions if "config" in positions.columns else positions.withColumn("config", F.lit(None).cast("string"))
    p = p.select("ticker", *keys)
    by_ticker = bars.groupBy(F.col("ticker").alias("b_ticker")).agg(F.sort_array(F.collect_list(F.struct(*BAR))).alias("all_bars"))
    later = F.filter("all_bars", lambda b: b["sidx"] > F.col("opened"))
    seen = p.join(by_ticker.hint("merge"), F.col("ticker") == F.col("b_ticker"), "left").withColumn("cfg", settings(F.col("config")))

    def end(after: Column) -> Column:
        state = F.aggregate(after, opened_state(F.col("first_stop"), F.col("opened")), lambda s, b: advance(s, b, F.col("entry"), F.col("entry") - F.col("first_stop"), F.col("cfg")))
        return F.struct(F.size(after).alias("n_bars"), state.alias("s"))

    after = F.coalesce(F.slice(later, 1, most), F.array())
    return seen.select("ticker", *keys, let(after, end).alias("r")).select("ticker", *keys, "r.n_bars", "r.s.*")


def shown(states: DataFrame) -> DataFrame:
    return states.selectExpr("ticker", "opened", "n_bars", "state", r("stop"), r("floor"), "basis", "caution", r("qty"), "trimmed", r("exit_price"), "exit_reason", "advanced", "earnings", "warnings")


def opened_and_bars(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A position opened at every session of every ticker whose close is above its low, and all bars."""
    stock = RELATIONS["stock"](spark, sf_dir)
    opened = stock.where("low < close").select("ticker", F.col("sidx").alias("opened"), F.col("close").alias("entry"), F.col("low").alias("first_stop"))
    n = tasks(spark, sf_dir)
    return opened.repartition(n, "ticker"), stock.select("ticker", *BAR).repartition(n, "ticker")


def sm_catchup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every position advanced through the bars it hasn't seen, at most 30; one without such bars stays open."""
    return shown(folded(*opened_and_bars(spark, sf_dir)))


def sm_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same positions after their next bar each."""
    return shown(folded(*opened_and_bars(spark, sf_dir), most=1))


#: Settings that positions of the queries on overrides have, by ticker.
OWN = {1: '{"HARD_EXIT_BASIS":"20ma"}', 2: '{"SEVERE_BREAKDOWN_ATR":0.5,"TWO_CLOSE_EXIT":1}', 3: '{"WIDEN_TRAIL_BASIS":false,"TRIM_START_ATR":2,"TRIM_PCT":0.25,"BREAKEVEN_TRIGGER":"close","BREAKEVEN_R":0.5,"EARNINGS_WARN_SESSIONS":2}', 4: "not JSON"}


def ext_config_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions with settings of their own, after at most ten bars."""
    opened, bars = opened_and_bars(spark, sf_dir)
    config = F.lit(None).cast("string")
    for k, v in OWN.items():
        config = F.when(F.col("ticker") % 5 == k, v).otherwise(config)
    return shown(folded(opened.withColumn("config", config), bars, most=10))


FUNCTIONS = {f.__name__: f for f in (sm_advance, sm_catchup, ext_config_overrides)}


def fold_sql(opened: str, bars: str, most: int, ctes: str = "") -> str:
    """The fold as a recursive query for the other engine: a round for each bar. opened: (ticker, opened, entry, first_stop, c_*), bars: (ticker, *BAR)."""
    cfg = ", ".join(f"c_{k}" for k in SETTINGS)
    text = f"""WITH {ctes}o AS ({opened}), b AS ({bars}),
n AS (SELECT o.ticker AS t, o.opened AS at, b.*, row_number() OVER (PARTITION BY o.ticker, o.opened ORDER BY b.sidx) AS bar FROM o JOIN b ON b.ticker = o.ticker AND b.sidx > o.opened QUALIFY bar <= {most}),
f AS (SELECT ticker, opened, entry, first_stop, {cfg}, CAST(0 AS BIGINT) AS bar, 'open' AS state, first_stop AS stop, first_stop AS floor, '20ma' AS basis, 0 AS caution, 100e0 AS qty, 0 AS trimmed, CAST(NULL AS DOUBLE) AS exit_price, CAST(NULL AS VARCHAR) AS exit_reason, CAST(opened AS INT) AS advanced, CAST(NULL AS INT) AS earnings, 0 AS warnings FROM o
UNION ALL
SELECT ticker, opened, entry, first_stop, {cfg}, bar, CASE WHEN done THEN state WHEN why IS NOT NULL THEN 'closing' ELSE 'managing' END,
  CASE WHEN done OR why IS NOT NULL THEN stop WHEN trail IS NULL THEN greatest(stop, floor2) WHEN basis2 <> basis THEN greatest(trail, floor2) ELSE greatest(stop, trail, floor2) END,
  CASE WHEN done OR why IS NOT NULL THEN floor ELSE floor2 END, CASE WHEN done OR why IS NOT NULL OR trail IS NULL THEN basis ELSE basis2 END, CASE WHEN done OR why IS NOT NULL THEN caution ELSE count2 END,
  CASE WHEN done OR why IS NOT NULL THEN qty ELSE qty * pow(1 - c_TRIM_PCT, levels) END, CAST(CASE WHEN NOT done AND why IS NULL AND levels > 0 THEN ext ELSE trimmed END AS INT),
  CASE WHEN done OR why IS NULL THEN exit_price WHEN why = 'gap_down_below_stop' THEN b_open WHEN why = 'stop_hit' THEN stop ELSE b_close END, CASE WHEN done OR why IS NULL THEN exit_reason ELSE why END,
  CAST(CASE WHEN done THEN advanced ELSE b_sidx END AS INT), CASE WHEN done OR why IS NOT NULL THEN earnings ELSE days END, CAST(CASE WHEN NOT done AND why IS NULL AND days BETWEEN 0 AND c_EARNINGS_WARN_SESSIONS THEN warnings + 1 ELSE warnings END AS INT)
FROM (SELECT *, greatest(0, coalesce(ext, 0) - greatest(c_TRIM_START_ATR - 1, trimmed)) AS levels, CASE WHEN entry > first_stop AND ((CASE c_BREAKEVEN_TRIGGER WHEN 'close' THEN b_close ELSE b_high END) - entry) / (entry - first_stop) >= c_BREAKEVEN_R THEN greatest(floor, entry) ELSE floor END AS floor2,
  CASE WHEN b_low <= stop THEN CASE WHEN b_open < stop THEN 'gap_down_below_stop' ELSE 'stop_hit' END WHEN c_HARD_EXIT_BASIS = '20ma' AND b_close < b_ma20 THEN 'close_below_20ma' WHEN c_HARD_EXIT_BASIS <> '20ma' AND b_close < b_ma50 THEN 'close_below_50ma'
    WHEN b_atr > 0 AND (b_prev - b_close) / b_atr >= c_SEVERE_BREAKDOWN_ATR THEN 'severe_breakdown' WHEN b_close < b_ma20 AND count2 >= c_TWO_CLOSE_EXIT THEN 'two_close_below_20ma' END AS why
FROM (SELECT f.* EXCLUDE (bar), n.bar, n.sidx AS b_sidx, n.open AS b_open, n.high AS b_high, n.low AS b_low, n.close AS b_close, n.prev_close AS b_prev, n.atr AS b_atr, n.ma20 AS b_ma20, n.ma50 AS b_ma50, coalesce(n.earnings_in, f.earnings) AS days, f.state = 'closing' OR n.close IS NULL AS done,
  CASE WHEN n.close < n.ma20 THEN caution + 1 WHEN n.ma20 IS NOT NULL THEN 0 ELSE caution END AS count2, CASE WHEN n.atr > 0 THEN CAST(floor((n.close - n.ma50) / n.atr) AS INT) END AS ext,
  CASE WHEN c_WIDEN_TRAIL_BASIS AND n.ma50 > entry THEN '50ma' ELSE '20ma' END AS basis2, CASE WHEN c_WIDEN_TRAIL_BASIS AND n.ma50 > entry THEN n.ma50 ELSE n.ma20 END AS trail
  FROM f JOIN n ON n.t = f.ticker AND n.at = f.opened AND n.bar = f.bar + 1) x) y)
SELECT ticker, opened, cast(bar AS INT) AS n_bars, state, {r('stop')}, {r('floor')}, basis, caution, {r('qty')}, trimmed, {r('exit_price')}, exit_reason, advanced, earnings, warnings FROM f QUALIFY row_number() OVER (PARTITION BY ticker, opened ORDER BY bar DESC) = 1"""
    return Query("fold", text).sql().replace("WITH", "WITH RECURSIVE", 1)


def settings_sql(**own: str) -> str:
    literal = lambda v: str(v).upper() if isinstance(v, bool) else repr(v)
    return ", ".join(f"{own.get(k, literal(v))} AS c_{k}" for k, (_, v) in SETTINGS.items())


_OPENED = "SELECT ticker, sidx AS opened, close AS entry, low AS first_stop, CFG FROM {stock} WHERE low < close"
_BARS = f"SELECT ticker, {', '.join(BAR)} FROM {{stock}}"
_five = lambda k, v, rest: f"CASE ticker % 5 WHEN {k} THEN {v} ELSE {rest} END"
SQL = {
    "sm_catchup": fold_sql(_OPENED.replace("CFG", settings_sql()), _BARS, MOST_BARS),
    "sm_advance": fold_sql(_OPENED.replace("CFG", settings_sql()), _BARS, 1),
    "ext_config_overrides": fold_sql(
        _OPENED.replace("CFG", settings_sql(HARD_EXIT_BASIS=_five(1, "'20ma'", "'50ma'"), SEVERE_BREAKDOWN_ATR=_five(2, "0.5e0", "3e0"), TWO_CLOSE_EXIT=_five(2, "1", "2"), WIDEN_TRAIL_BASIS="ticker % 5 <> 3", TRIM_START_ATR=_five(3, "2", "7"), TRIM_PCT=_five(3, "0.25e0", "0.1e0"), BREAKEVEN_TRIGGER=_five(3, "'close'", "'high'"), BREAKEVEN_R=_five(3, "0.5e0", "1e0"), EARNINGS_WARN_SESSIONS=_five(3, "2", "10"))),
        _BARS, 10,
    ),
}
