"""The trading calendar, and what is looked up in it: an event's trading date, trading days between two dates.

The calendar has a row a day, also for closed ones, with the last open day up to it and the number of open
days up to it. Both look-ups are thus equalities on a day, whatever the span, and no range is joined.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from sessionforge.sources.market import table

ZONE, OPENS_AT = "America/New_York", 9
#: The longest run of closed days that a look-back has to get over.
LONGEST_CLOSURE = 14
#: A calendar of at most so many days is broadcast.
BROADCAST_DAYS = 100_000

#: Holidays by rule, for month m, day d, year y and weekday w (1 is Sunday). A holiday on a Saturday is kept the
#: day before and one on a Sunday the day after, but New Year's Day on a Saturday isn't kept.
_kept = lambda month, day: f"(m = {month} AND (d = {day} AND w BETWEEN 2 AND 6 OR d = {day - 1} AND w = 6 OR d = {day + 1} AND w = 2))"
_monday = lambda month, first, last: f"(m = {month} AND w = 2 AND d BETWEEN {first} AND {last})"
HOLIDAYS = " OR ".join(
    [
        "(m = 1 AND (d = 1 AND w BETWEEN 2 AND 6 OR d = 2 AND w = 2))",
        _monday(1, 15, 21), _monday(2, 15, 21), "(m = easter_month AND d = easter_day)", _monday(5, 25, 31),
        f"(y >= 2022 AND {_kept(6, 19)})", _kept(7, 4), _monday(9, 1, 7), "(m = 11 AND w = 5 AND d BETWEEN 22 AND 28)", _kept(12, 25),
    ]
)


def _good_friday(days: DataFrame) -> DataFrame:
    """Adds month and day of the year's Good Friday, by the Gregorian computus."""
    steps = [
        {"ce": "y div 100", "go": "y % 19"},
        {"ep": "(19 * go + ce - ce div 4 - (ce - (ce + 8) div 25 + 1) div 3 + 15) % 30"},
        {"wk": "(32 + 2 * (ce % 4) + 2 * ((y % 100) div 4) - ep - y % 4) % 7"},
        {"nr": "ep + wk - 7 * ((go + 11 * ep + 22 * wk) div 451) + 114"},
        {"gf": "date_sub(make_date(cast(y AS int), cast(nr div 31 AS int), cast(nr % 31 + 1 AS int)), 2)"},
        {"easter_month": "month(gf)", "easter_day": "day(gf)"},
    ]
    for step in steps:
        days = days.withColumns({k: F.expr(v) for k, v in step.items()})
    return days


def calendar(spark: SparkSession, first: date, last: date, closed: Iterable[date] = ()) -> DataFrame:
    """(day, is_open, last_open, n_open) of every day from first to last; closed: closings beside weekends and holidays.

    last_open is the last open day up to the day, and n_open counts open days up to it from the calendar's
    start. The windows have no key: they run over a row a day.
    """
    start = first - timedelta(days=LONGEST_CLOSURE)
    days = spark.range((last - start).days + 1).select(F.date_add(F.lit(start), F.col("id").cast("int")).alias("day"))
    days = _good_friday(days.withColumns({"y": F.year("day"), "m": F.month("day"), "d": F.dayofmonth("day"), "w": F.dayofweek("day")}))
    shut = F.expr(f"w IN (1, 7) OR {HOLIDAYS}")
    extra = sorted(closed)
    if extra:
        shut = shut | F.col("day").isin(extra)
    upto = W.orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    out = days.select("day", (~shut).alias("is_open"))
    out = out.withColumns({"last_open": F.last(F.when(F.col("is_open"), F.col("day")), ignorenulls=True).over(upto), "n_open": F.count(F.when(F.col("is_open"), 1)).over(upto)})
    return out.where(F.col("day") >= F.lit(first))


def span(rows: DataFrame, *days: str) -> tuple[date, date] | None:
    """The first and last of the days in some columns; two dates reach the driver."""
    some = F.explode(F.array(*days)).alias("day")
    got = rows.select(some).agg(F.min("day").alias("a"), F.max("day").alias("b")).collect()[0]
    return None if got["a"] is None else (got["a"], got["b"])


def looked_up(rows: DataFrame, days: DataFrame, n_days: int, key: str, **columns: str) -> DataFrame:
    """rows with columns of the calendar at the day that key holds, under new names; null where key is null."""
    found = days.select(F.col("day").alias("_day"), *[F.col(c).alias(name) for name, c in columns.items()])
    return rows.join(found.hint("broadcast" if n_days <= BROADCAST_DAYS else "merge"), F.col(key) == F.col("_day"), "left").drop("_day")


def wall_day(ts: Column, zone: str = ZONE, opens_at: int = OPENS_AT) -> Column:
    """The day on the exchange's clock whose data a UTC time sees: before the opening hour the day before."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), ts.cast("timestamp_ntz"))
    return F.date_sub(F.to_date(local), F.when(F.hour(local) < opens_at, 1).otherwise(0))


def trading_dates(rows: DataFrame, ts: str, name: str = "trading_date", closed: Iterable[date] = ()) -> DataFrame:
    """rows with the trading date of a UTC time: the last open day up to its day on the exchange's clock; null for null."""
    rows = rows.withColumn("_wall", wall_day(F.col(ts)))
    ends = span(rows, "_wall")
    if ends is None:
        return rows.drop("_wall").withColumn(name, F.lit(None).cast(T.DateType()))
    days = calendar(rows.sparkSession, *ends, closed=closed)
    return looked_up(rows, days, (ends[1] - ends[0]).days, "_wall", **{name: "last_open"}).drop("_wall")


def sessions_between(rows: DataFrame, start: str, end: str, name: str = "sessions", closed: Iterable[date] = ()) -> DataFrame:
    """rows with the number of open days after start up to end, from two look-ups; 0 where end isn't after start, null for null."""
    ends = span(rows, start, end)
    if ends is None:
        return rows.withColumn(name, F.lit(None).cast("int"))
    days, n = calendar(rows.sparkSession, *ends, closed=closed), (ends[1] - ends[0]).days
    out = looked_up(looked_up(rows, days, n, start, _from="n_open"), days, n, end, _to="n_open")
    return out.withColumn(name, F.greatest(F.col("_to") - F.col("_from"), F.when(F.col("_to").isNotNull() & F.col("_from").isNotNull(), 0)).cast("int")).drop("_from", "_to")


def fn_trading_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with its trading date."""
    return trading_dates(table(spark, sf_dir, "events").select("event_id", "ts"), "ts").select("event_id", "trading_date")


def fn_sessions_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item with the trading days from its order's date to its ship date, and back: the dates come in either order."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("ordered"))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.to_date("l_shipdate").alias("shipped"))
    pairs = items.join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    out = sessions_between(sessions_between(pairs, "ordered", "shipped"), "shipped", "ordered", "back")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "ordered", "shipped", "sessions", "back")


FUNCTIONS = {f.__name__: f for f in (fn_trading_day, fn_sessions_between)}

#: A calendar told in another way: holidays listed year by year, Easter by Gauss's rule for 1900 to 2099, look-ups by counting.
DAYS = """years AS (SELECT range AS y FROM range(1990, 2036)),
gauss AS (SELECT y, (19 * (y % 19) + 24) % 30 AS p FROM years),
easter AS (SELECT y, make_date(y, 3, 22) + CAST(p + q - CASE WHEN p = 29 AND q = 6 OR p = 28 AND q = 6 AND y % 19 > 10 THEN 7 ELSE 0 END AS INT) AS sunday FROM (SELECT *, (2 * (y % 4) + 4 * (y % 7) + 6 * p + 5) % 7 AS q FROM gauss) g),
fixed AS (SELECT make_date(y, m, d) AS day, m FROM years, (VALUES (1, 1), (6, 19), (7, 4), (12, 25)) f(m, d) WHERE m <> 6 OR y >= 2022),
nth AS (SELECT y, m, k, w, make_date(y, m, 1) AS first FROM years, (VALUES (1, 3, 1), (2, 3, 1), (9, 1, 1), (11, 4, 4)) f(m, k, w)),
holidays AS (SELECT sunday - 2 AS day FROM easter
  UNION ALL SELECT CASE isodow(day) WHEN 6 THEN day - 1 WHEN 7 THEN day + 1 ELSE day END FROM fixed WHERE NOT (m = 1 AND isodow(day) = 6)
  UNION ALL SELECT first + CAST((w - isodow(first) + 7) % 7 + 7 * (k - 1) AS INT) FROM nth
  UNION ALL SELECT make_date(y, 5, 31) - CAST(isodow(make_date(y, 5, 31)) - 1 AS INT) FROM years),
open_days AS (SELECT day FROM (SELECT CAST(DATE '1990-01-01' + CAST(range AS INT) AS DATE) AS day FROM range(0, 16500)) d WHERE isodow(day) < 6 AND day NOT IN (SELECT day FROM holidays))"""
SQL = {
    "fn_trading_day": f"""WITH {DAYS}, walls AS (SELECT event_id, CAST(CASE WHEN hour(t) < {OPENS_AT} THEN t - INTERVAL 1 DAY ELSE t END AS DATE) AS wall FROM (SELECT event_id, timezone('{ZONE}', timezone('UTC', ts)) AS t FROM events) e)
SELECT event_id, day AS trading_date FROM walls ASOF LEFT JOIN open_days ON wall >= day""",
    "fn_sessions_between": f"""WITH {DAYS}, items AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(o_orderdate AS DATE) AS ordered, CAST(l_shipdate AS DATE) AS shipped FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
spans AS (SELECT ordered AS a, shipped AS b FROM items UNION SELECT shipped, ordered FROM items),
counted AS (SELECT a, b, CAST(count(day) AS INT) AS n FROM spans LEFT JOIN open_days ON day > a AND day <= b GROUP BY a, b)
SELECT i.*, there.n AS sessions, back.n AS back FROM items i JOIN counted there ON there.a = ordered AND there.b = shipped JOIN counted back ON back.a = shipped AND back.b = ordered""",
}
