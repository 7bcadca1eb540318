"""The as-of join and the calendar against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sessionforge.operators import calendar
from sessionforge.operators.asof import as_of


@pytest.mark.parametrize(("width", "tolerance"), [(1, None), (7, None), (1000, None), (5, 6), (3, 0)])
def test_as_of_against_a_loop(spark, width, tolerance):
    rng = random.Random(width)
    left = [(i, rng.choice(["a", "a", "b", "c", None]), rng.choice([None, *range(-30, 60)]), "clash") for i in range(120)]
    right = [(rng.choice(["a", "b", "b", "d", None]), rng.choice([None, *range(-20, 50, 3)]), rng.choice([None, 1.5, 2.5]), rng.randrange(5)) for _ in range(60)]
    right += right[:5]
    got = as_of(spark.createDataFrame(left, "i int, k string, t int, v2 string"), spark.createDataFrame(right, "k string, t int, v double, n int"), ["k"], "t", ["v", "n"], width, tolerance)
    assert got.columns == ["i", "k", "t", "v2", "v", "n"]
    want = {}
    for i, k, t, _ in left:
        fit = [(u, v is not None, v or 0, n) for key, u, v, n in right if key == k and None not in (k, t, u) and u <= t and (tolerance is None or t - max(x for kk, x, _, _ in right if kk == k and x is not None and x <= t) <= tolerance)]
        best = max(fit, default=None)
        want[i] = (best[2] if best[1] else None, best[3]) if best else (None, None)
    assert {r.i: (r.v, r.n) for r in got.collect()} == want
    assert any(v != (None, None) for v in want.values())


def test_as_of_nothing(spark):
    one = spark.createDataFrame([(1, "a", 1)], "i int, k string, t int")
    none = spark.createDataFrame([], "k string, t int, v int")
    assert [tuple(r) for r in as_of(one, none, ["k"], "t", ["v"], 5).collect()] == [(1, "a", 1, None)]
    assert as_of(one.where("i > 1"), one.select("k", "t", F.lit(3).alias("v")), ["k"], "t", ["v"], 5).collect() == []


# Full-day holidays of the exchange in some years.
HOLIDAYS = """2026-01-01 2026-01-19 2026-02-16 2026-04-03 2026-05-25 2026-06-19 2026-07-03 2026-09-07 2026-11-26 2026-12-25
2027-01-01 2027-01-18 2027-02-15 2027-03-26 2027-05-31 2027-06-18 2027-07-05 2027-09-06 2027-11-25 2027-12-24 2028-01-17 2028-02-21 2028-04-14""".split()


def test_holidays_of_the_exchange(spark):
    days = calendar.calendar(spark, dt.date(2026, 1, 1), dt.date(2028, 4, 30)).collect()
    assert [str(r.day) for r in days if not r.is_open and r.day.weekday() < 5] == HOLIDAYS
    assert len(days) == (dt.date(2028, 4, 30) - dt.date(2026, 1, 1)).days + 1


def test_trading_dates_by_the_exchanges_clock(spark):
    # in summer New York is four hours behind, in winter five
    cases = [("2026-07-02 12:59:59", "2026-07-01"), ("2026-07-02 13:00:00", "2026-07-02"), ("2026-07-06 12:00:00", "2026-07-02"), ("2026-12-28 13:30:00", "2026-12-24"), ("2026-12-28 14:00:00", "2026-12-28"), ("2026-11-29 20:00:00", "2026-11-27"), ("2026-11-26 18:00:00", "2026-11-25"), (None, None)]
    df = spark.createDataFrame([(i, t and dt.datetime.fromisoformat(t)) for i, (t, _) in enumerate(cases)], "i int, ts timestamp_ntz")
    got = {r.i: r.trading_date and str(r.trading_date) for r in calendar.trading_dates(df, "ts").collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}
    closed = calendar.trading_dates(df, "ts", closed=[dt.date(2026, 7, 2)]).where("i = 1").collect()[0]
    assert str(closed.trading_date) == "2026-07-01"
    assert calendar.trading_dates(df.where("ts is null"), "ts").collect()[0].trading_date is None


def test_sessions_between_two_dates(spark):
    d = dt.date.fromisoformat
    cases = [("2026-07-02", "2026-07-06", 1), ("2026-07-01", "2026-07-03", 1), ("2026-07-06", "2026-07-06", 0), ("2026-07-06", "2026-07-02", 0), ("2026-01-01", "2026-12-31", 251), (None, "2026-07-06", None), ("2026-07-06", None, None), ("2026-07-04", "2026-07-05", 0)]
    df = spark.createDataFrame([(i, a and d(a), b and d(b)) for i, (a, b, _) in enumerate(cases)], "i int, a date, b date")
    assert [r.sessions for r in calendar.sessions_between(df, "a", "b").orderBy("i").collect()] == [n for _, _, n in cases]
