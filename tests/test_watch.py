"""The watch list's ticks and rules, and warnings before the close, on literal rows."""

import datetime as dt

from pyspark.sql import functions as F

from sessionforge.operators import preclose, watch

D = lambda n, month=1: dt.date(2024, month, n)


def tick(spark, entries, ticks, ledger, bars, **more):
    w = spark.createDataFrame(entries, "ticker string, added date, left_on date")
    t = spark.createDataFrame(ticks, "tick_date date, nth int")
    counts, left, now = watch.ticked(w, t, spark.createDataFrame([(d,) for d in ledger], "tick_date date"), spark.createDataFrame(bars, "ticker string, first_bar date"), **more)
    return {(r.tick_date, r.nth): (r.ticked, r.decremented, r.expired, r.purged, r.skipped_no_history) for r in counts.collect()}, {r.ticker: (r.status, r.expired_on, r.sessions_left) for r in left.collect()}, {r.tick_date for r in now.collect()}


def test_a_date_counts_once_and_new_tickers_wait(spark):
    entries = [("A", D(1), None), ("B", D(1), None), ("C", D(1), D(3)), ("N", D(2), None)]
    bars = [("A", D(1)), ("A", D(2)), ("B", D(3)), ("C", dt.date(2023, 1, 1)), ("X", D(1))]
    ticks = [(D(2), 1), (D(2), 2), (D(3), 1), (D(4), 1), (D(5), 1)]
    counts, left, ledger = tick(spark, entries, ticks, [D(5)], bars, sessions=3)
    assert counts == {(D(2), 1): (True, 2, 0, 0, 2), (D(2), 2): (False, 0, 0, 0, 0), (D(3), 1): (True, 2, 0, 0, 1), (D(4), 1): (True, 2, 1, 0, 1), (D(5), 1): (False, 0, 0, 0, 0)}
    assert left == {"A": ("expired", D(4), 0), "B": ("active", None, 1), "C": ("removed", None, 2), "N": ("active", None, 3)}
    assert ledger == {D(2), D(3), D(4), D(5)}
    # told again, all of it is refused
    counts, _, _ = tick(spark, entries, ticks, ledger, bars, sessions=3)
    assert set(counts.values()) == {(False, 0, 0, 0, 0)}


def test_entries_are_purged_after_two_weeks(spark):
    entries, bars = [("A", D(1), None), ("C", D(1), D(2)), ("K", D(1), None)], [("A", D(1)), ("C", D(1))]
    counts, left, _ = tick(spark, entries, [(D(n), 1) for n in (2, 3, 16, 17, 18, 19)], [], bars, sessions=2)
    assert [counts[D(n), 1][2:4] for n in (2, 3, 16, 17, 18, 19)] == [(0, 0), (1, 0), (0, 0), (0, 1), (0, 1), (0, 0)]  # C after the 16th, A after the 17th
    assert set(left) == {"K"} and left["K"] == ("active", None, 2)


def test_nothing_to_tick(spark):
    assert tick(spark, [], [], [], []) == ({}, {}, set())
    assert tick(spark, [], [(D(2), 1)], [], [])[0] == {(D(2), 1): (True, 0, 0, 0, 0)}


def test_rules_of_the_list(spark):
    at = lambda n: dt.datetime(2024, 1, 1, n)
    acts = [
        (1, 1, "renew", None, None), (1, 2, "add", "above", 5.0), (1, 3, "remove", None, None), (1, 4, "remove", None, None), (2, 1, "add", "reclaim_20ma", None), (2, 2, "remove", None, None), (2, 3, "restore", None, None), (2, 4, "edit", "below", 3.0), (2, 5, "edit", "below", -3.0),
        (3, 1, "add", None, None), (3, 2, "delete", None, None), (4, 1, "add", "above", 1.0), (4, 2, "delete", None, None), (4, 3, "edit", "below", 1.0), (4, 4, "add", "", None), (4, 5, "renew", None, None), (5, 1, "add", "above", None), (5, 2, "renew", None, None), (6, 1, "remove", None, None), (6, 2, "add", "above", 2.0), (6, 3, "add", "reclaim_50ma", None),
    ]
    df = spark.createDataFrame([(o, n, at(n), a, t, v) for o, n, a, t, v in acts], "owner int, nth int, acted timestamp, action string, level_type string, level_value double")
    got = {r.owner: (r.status, r.created.hour, r.updated.hour, r.removed and r.removed.hour, r.level_type, r.level_value, r.renewals) for r in watch.upserted(df).collect()}
    assert got == {1: ("removed", 2, 4, 4, "above", 5.0, 0), 2: ("active", 1, 4, None, "below", 3.0, 1), 4: ("active", 4, 5, None, None, None, 1), 6: ("active", 2, 3, None, "reclaim_50ma", None, 1)}


def test_levels(spark):
    nan = float("nan")
    cases = [(None, None, None), ("", None, None), ("", 1.0, "level_value requires a level_type"), ("up", 1.0, "unknown level_type"), ("above", 1.0, None), ("above", None, "level_value must be positive"), ("below", 0.0, "level_value must be positive"), ("below", nan, "level_value must be positive"), ("reclaim_20ma", None, None), ("reclaim_50ma", 2.0, "level_value must be omitted")]
    df = spark.createDataFrame([(i, t, v) for i, (t, v, _) in enumerate(cases)], "i int, t string, v double")
    assert [r.why for r in df.orderBy("i").select(watch.level_problem(F.col("t"), F.col("v")).alias("why")).collect()] == [w for _, _, w in cases]


STATES = "ticker int, opened int, entry double, first_stop double, config string, state string, stop double, floor double, basis string, caution int, qty double, trimmed int, exit_price double, exit_reason string, advanced int, earnings int, warnings int"
BARS = "ticker int, sidx int, open double, high double, low double, close double, prev_close double, atr double, ma20 double, ma50 double, earnings_in int"


def test_warnings_leave_positions_as_they_are(spark):
    own = lambda t, opened=1, advanced=5, state="managing", stop=90.0, caution=0, config=None: (t, opened, 100.0, 90.0, config, state, stop, 90.0, "20ma", caution, 100.0, 0, None, None, advanced, None, 0)
    bar = lambda t, sidx=6, o=100.0, low=95.0, close=101.0, prev=101.0, atr=2.0, ma20=99.0, ma50=98.0: (t, sidx, o, 103.0, low, close, prev, atr, ma20, ma50, None)
    positions = [own(1), own(2), own(3), own(4), own(5, caution=1), own(6), own(7, advanced=6), own(8, opened=6, advanced=0, state="open"), own(9, state="closing"), own(10), own(11, config='{"HARD_EXIT_BASIS":"20ma"}')]
    bars = [bar(1), bar(2, low=89.0), bar(3, o=85.0, low=84.0), bar(4, close=97.0, prev=97.0), bar(5, close=98.5, prev=99.0), bar(6, close=98.2, prev=105.0, ma20=98.0), bar(7, low=1.0), bar(8, low=1.0), bar(9, low=1.0), bar(11, close=98.5)]
    rows = preclose.warnings(spark.createDataFrame(positions, STATES), spark.createDataFrame(bars, BARS)).cache()
    got = {r.ticker: r.item and tuple(r.item) for r in rows.collect()}
    assert got == {
        1: None, 2: ("stop_hit", "act", 101.0, 90.0), 3: ("gap_down_below_stop", "act", 101.0, 90.0), 4: ("close_below_50ma", "heads_up", 97.0, 98.0), 5: ("two_close_below_20ma", "heads_up", 98.5, 99.0), 6: ("severe_breakdown", "act", 98.2, None),
        7: None, 8: None, 10: None, 11: ("close_below_20ma", "heads_up", 98.5, None),
    }
    assert {(r.state, r.stop, r.advanced) for r in rows.where("ticker = 2").collect()} == {("managing", 90.0, 5)}
    told = {r.owner: (r.checked, r.flagged, [x.ticker for x in r["items"]]) for r in preclose.advisory(rows, F.col("ticker") % 2).collect()}
    assert told == {0: (5, 3, [2, 4, 6]), 1: (5, 3, [3, 5, 11])}
