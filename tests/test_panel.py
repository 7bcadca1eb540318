"""Hand-computed cases of the panel's columns, and queries held against another engine."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from sessionforge import queries as panel
from sessionforge.operators.panel_columns import forward_steps
from sessionforge.operators.selection import rows_of, selector_steps
from sessionforge.plans import registry
from sessionforge.plans.panel import STEPS
from sessionforge.plans.registry import TABLES
from sessionforge.sources.market import METRICS, steps

SF = "/root/testdata/sf0.001"


def rows(spark, perf, bench=None):
    """perf: (sidx, name, value) for all metrics alike; bench: value by sidx."""
    data = [(dt.date(2020, 1 + s, 1), s, n, v, None if bench is None else bench.get(s)) for s, n, v in perf]
    df = spark.createDataFrame(data, "session_date date, sidx int, name string, v double, b double")
    return df.select("session_date", "sidx", "name", *[F.col("v").alias(f"perf_{m}") for m in METRICS], *[F.col("b").alias(f"bench_{m}") for m in METRICS])


def test_ranks_ties_and_nulls(spark):
    df = steps(rows(spark, [(0, "a", 3.0), (0, "b", 3.0), (0, "c", 1.0), (0, "d", None)]), STEPS)
    got = {r["name"]: r["rank_ytd"] for r in df.collect()}
    assert got == {"a": 1, "b": 1, "c": 3, "d": 4}


def test_all_null_metric_ranks_first_and_has_no_score(spark):
    df = steps(rows(spark, [(0, "a", None), (0, "b", None)]), STEPS)
    assert [(r["rank_week"], r["momentum_score"], r["rank_agreement"]) for r in df.collect()] == [(1, None, 1.0)] * 2


def test_one_group_has_no_percentile(spark):
    r = steps(rows(spark, [(0, "a", 5.0)]), STEPS).collect()[0]
    assert r["momentum_score"] is None and r["rank_ytd"] == 1


def test_lookback_is_by_session_not_by_row(spark):
    perf = [(s, n, float(s if n == "a" else 5)) for s in (0, 1, 3, 4, 5, 6) for n in "ab"]
    r = {x["sidx"]: x for x in steps(rows(spark, perf), STEPS).where("name = 'a'").collect()}
    assert r[5]["rank_ytd_delta_5d"] is not None and r[6]["rank_ytd_delta_5d"] is not None
    assert r[6]["perf_ytd_delta_5d"] == 5.0 and r[5]["perf_ytd_delta_5d"] == 5.0 and r[4]["perf_ytd_delta_5d"] is None


def test_new_high_and_cross_need_two_observations(spark):
    df = steps(rows(spark, [(0, "a", -1.0), (1, "a", 2.0)], {0: 0.0, 1: 0.0}), STEPS)
    assert [(r["rs_new_high"], r["rs_cross"]) for r in df.orderBy("sidx").collect()] == [(None, None), (1, 1)]


def test_no_benchmark_gives_null_strength(spark):
    r = steps(rows(spark, [(0, "a", 1.0), (0, "b", 2.0)]), STEPS).collect()
    assert all(x["rs_score"] is None and x["beats_benchmark_day"] is None for x in r)


def test_forward_returns_need_full_windows(spark):
    df = spark.createDataFrame([(s, "a", 10.0) for s in range(4)] + [(0, "g", 1.0), (3, "g", 2.0)], "sidx int, name string, perf_day double").withColumn("last_sidx", F.lit(3))
    r = {(x["name"], x["sidx"]): x for x in steps(df, forward_steps()).collect()}
    assert r["a", 0]["fwd_3"] == pytest.approx(33.1) and r["a", 3]["fwd_1"] is None
    assert r["a", 2]["fwd_3"] == pytest.approx(10.0) and r["a", 2]["log_3"] is None  # one session is left
    assert r["g", 0]["fwd_3"] is None


def greedy(day, cap):
    """The selector told as a loop over one day's rows: (name, bucket candidates in order)."""
    chosen, out = [], []

    def add(name, bucket):
        if name not in chosen:
            if len(chosen) >= cap:
                return False
            chosen.append(name)
        out.append((name, bucket))
        return True

    core = sorted(day, key=lambda r: (r["sum_mid"], r["name"]))[:11]
    for r in core:
        add(r["name"], "leaders")
    names = {r["name"] for r in core}
    fresh = sorted((r for r in day if r["name"] not in names and r["momentum_confirmed"] is not None), key=lambda r: (-r["momentum_confirmed"], r["name"]))[:2]
    for r in fresh:
        add(r["name"], "leaders")
    for k, (bucket, slots, key) in enumerate((("emerging", 4, "regime_short_long"), ("accel", 3, "momentum_accel"), ("rs_new_high", 3, "rs_slope"), ("all_green", 4, "momentum_score"))):
        pool = sorted((r for r in day if r[f"gate_{k}"] == 1), key=lambda r: (r[key] is None, -(r[key] or 0), r["name"]))
        new = 0
        for place, r in enumerate(pool, 1):
            fresh_name = r["name"] not in chosen
            if place <= slots:
                new += add(r["name"], bucket) and fresh_name
            elif new >= slots:
                break
            elif fresh_name and add(r["name"], bucket):
                new += 1
    return sorted(out)


@pytest.mark.parametrize("cap", [27, 16])
def test_selector_equals_the_greedy_loop(spark, cap):
    df = steps(registry.RELATIONS["panel"](spark, "/root/testdata/sf0.01").where("sidx between 30 and 45"), selector_steps(cap))
    days = {}
    for r in df.collect():
        days.setdefault(r["session_date"], []).append(r)
    tags = {"core": "leaders", "fresh": "leaders", "emerging": "emerging", "accel": "accel", "rs_new_high": "rs_new_high", "all_green": "all_green"}
    for day in days.values():
        got = sorted((r["name"], b) for r in day for t, b in tags.items() if r[f"tag_{t}"] == 1)
        assert got == greedy(day, cap)
    assert "list_category" in rows_of("selcols")


@pytest.mark.parametrize("name", ["w_ranks", "w_momentum_score", "tk_movers", "w_scoreboard", "sm_pick_status", "w_focus_score", "ag_daily_calls", "snk_keyed_dedup"])
def test_same_rows_as_another_engine(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = panel.queries()[name](spark, SF)
    other = con.sql(panel.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(other.columns)
    plain = lambda v: round(v, 5) if isinstance(v, float) else str(v)[:10] if isinstance(v, dt.date) else v
    mine = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    theirs = sorted((tuple(plain(r[other.columns.index(c)]) for c in cols) for r in other.fetchall()), key=str)
    assert mine == theirs


def other_engine():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_every_text_for_the_other_engine_runs():
    con, broken = other_engine(), {}
    for name, text in panel.oracle_sql().items():
        try:
            con.sql(text).fetchall()
        except duckdb.Error as e:
            broken[name] = str(e)[:200]
    assert not broken


def test_relations_come_behind_those_they_use():
    order = registry.needed("SELECT * FROM picks")
    assert order.index("sel") < order.index("picks") and order.index("panel") < order.index("sel") and order[-1] == "picks"


def test_entry_and_contract(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
