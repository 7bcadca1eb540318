"""What the day's provisional bar would do to open positions: exit warnings by position, and an advisory by owner.

The trade fold takes one more bar as a what-if; the position that comes of it is thrown away, so that
nothing is advanced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionforge.operators.trades import BAR, STATE, advance, fold_sql, folded, let, opened_and_bars, settings, settings_sql
from sessionforge.plans.registry import RELATIONS, Query, r
from sessionforge.sources.market import shared_folder

# Severities of exit reasons; others are heads-ups.
SEVERITY = {"stop_hit": "act", "gap_down_below_stop": "act", "severe_breakdown": "act", "close_below_50ma": "heads_up", "two_close_below_20ma": "heads_up"}
#: Bars that a position is advanced by before the provisional one.
ALL_BARS = 10_000
#: Owners that the positions of the queries belong to.
OWNERS = 9


def what_if(state: Column, bar: Column, entry: Column, risk: Column, cfg: Column) -> Column:
    """The warning that a bar gives: signal, severity, price and reference level; null where the position wouldn't be left."""

    def told(after: Column) -> Column:
        why = after["exit_reason"]
        level = F.when(why.isin("stop_hit", "gap_down_below_stop"), state["stop"]).when(why == "close_below_50ma", bar["ma50"]).when(why == "two_close_below_20ma", bar["ma20"])
        severity = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])
        return F.when(after["state"] == "closing", F.struct(why.alias("signal"), F.coalesce(F.try_element_at(severity, why), F.lit("heads_up")).alias("severity"), bar["close"].alias("price"), level.alias("ref_level")))

    return let(advance(state, bar, entry, risk, cfg), told)


def warnings(positions: DataFrame, quotes: DataFrame) -> DataFrame:
    """positions (ticker, opened, entry, first_stop, config, state columns) that aren't closing, with `item`, the warning of their ticker's quote.

    quotes has a row a ticker (ticker, *BAR). A quote that isn't later than the opening and the last bar that
    a position knows gives none, as the fold wouldn't take it either.
    """
    state = F.struct(*[F.col(c) for c in ("state", "stop", "floor", "basis", "caution", "qty", "trimmed", "exit_price", "exit_reason", "advanced", "earnings", "warnings")]).cast(STATE)
    bar = quotes.select(F.col("ticker").alias("_of"), F.struct(*BAR).alias("_bar"))
    rows = positions.where("state <> 'closing'").join(bar.hint("merge"), F.col("ticker") == F.col("_of"), "left")
    late = F.col("_bar.sidx") > F.greatest("opened", "advanced")
    item = what_if(state, F.col("_bar"), F.col("entry"), F.col("entry") - F.col("first_stop"), settings(F.col("config")))
    return rows.withColumn("item", F.when(late, item)).drop("_of", "_bar")


def standing(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All positions advanced through every bar but the last session's, and the bars of that session as provisional quotes; written once."""
    opened, bars = opened_and_bars(spark, sf_dir)
    last = RELATIONS["sess"](spark, sf_dir).agg(F.max("sidx").alias("last"))
    bars = bars.join(F.broadcast(last), F.col("sidx") <= F.col("last"))  # one row
    opened = opened.join(F.broadcast(last), F.col("opened") < F.col("last")).drop("last")
    before = folded(opened, bars.where("sidx < last").drop("last"), ALL_BARS)
    at = shared_folder(spark)
    before.write.parquet(at)
    return spark.read.schema(before.schema).parquet(at), bars.where("sidx = last").drop("last")


def sm_preclose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every position that isn't closing, with what the last session's bars would do to it."""
    rows = warnings(*standing(spark, sf_dir))
    return rows.selectExpr("ticker", "opened", "state", "advanced", "item.signal AS signal", "item.severity AS severity", r("item.price", "price"), r("item.ref_level", "ref_level"))


def advisory(rows: DataFrame, owner: Column) -> DataFrame:
    """(owner, checked, flagged, items): every owner of a position that isn't closing, flagged or not; items are in order of ticker and opening.

    An owner's positions are counted where they are; only warnings come together.
    """
    one = F.struct("ticker", "opened", F.col("item.severity").alias("severity"), F.col("item.signal").alias("signal"))
    return rows.groupBy(owner.alias("owner")).agg(F.count("*").alias("checked"), F.count("item").alias("flagged"), F.array_sort(F.collect_list(F.when(F.col("item").isNotNull(), one))).alias("items"))


def ag_advisory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The advisory of each owner before the last session's close."""
    rows = advisory(warnings(*standing(spark, sf_dir)), F.col("ticker") % OWNERS)
    shown = F.array_join(F.transform("items", lambda x: F.concat_ws(" ", x["ticker"].cast("string"), x["opened"].cast("string"), x["severity"], x["signal"])), "|")
    return rows.select("owner", "checked", "flagged", shown.alias("items"))


FUNCTIONS = {f.__name__: f for f in (sm_preclose, ag_advisory)}

_last = "(SELECT max(sidx) FROM {sess})"
_opened = f"SELECT ticker, sidx AS opened, close AS entry, low AS first_stop, {settings_sql()} FROM {{stock}} WHERE low < close AND sidx < {_last}"
_bars = f"SELECT ticker, {', '.join(BAR)} FROM {{stock}}"


def _folded(bars: str) -> str:
    return fold_sql(_opened, bars, ALL_BARS)


#: The recursive fold without the last session and with it: what closes in between would be left.
_both = f"""b0 AS MATERIALIZED ({_folded(f"{_bars} WHERE sidx < {_last}")}), b1 AS MATERIALIZED ({_folded(_bars)})"""
_items = f"""WITH k AS (SELECT ticker, close, ma20, ma50 FROM {{stock}} WHERE sidx = {_last}),
items AS (SELECT b.ticker, b.opened, b.state, b.advanced, a.exit_reason AS signal, CASE WHEN a.exit_reason IN ('stop_hit', 'gap_down_below_stop', 'severe_breakdown') THEN 'act' WHEN a.exit_reason IS NOT NULL THEN 'heads_up' END AS severity,
  CASE WHEN a.exit_reason IS NOT NULL THEN k.close END AS price, CASE WHEN a.exit_reason IN ('stop_hit', 'gap_down_below_stop') THEN b.stop WHEN a.exit_reason = 'close_below_50ma' THEN k.ma50 WHEN a.exit_reason = 'two_close_below_20ma' THEN k.ma20 END AS ref_level
FROM b0 b JOIN b1 a ON a.ticker = b.ticker AND a.opened = b.opened LEFT JOIN k ON k.ticker = b.ticker WHERE b.state <> 'closing') """


def _sql(select: str) -> str:
    return Query("preclose", _items + select).sql().replace("WITH", f"WITH {_both},", 1)


SQL = {
    "sm_preclose": _sql(f"SELECT ticker, opened, state, advanced, signal, severity, {r('price')}, {r('ref_level')} FROM items"),
    "ag_advisory": _sql(f"SELECT ticker % {OWNERS} AS owner, count(*) AS checked, count(signal) AS flagged, coalesce(string_agg(ticker || ' ' || opened || ' ' || severity || ' ' || signal, '|' ORDER BY ticker, opened) FILTER (signal IS NOT NULL), '') AS items FROM items GROUP BY 1"),
}
