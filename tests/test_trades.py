"""The trade fold against a plain loop, and its invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionforge.operators.trades import folded


def plain(entry, stop0, bars):
    s = dict(state="open", stop=stop0, floor=stop0, basis="20ma", caution=0, qty=100.0, trimmed=0, exit_price=None, exit_reason=None)
    for b in bars:
        below = b["close"] < b["ma20"]
        count = s["caution"] + 1 if below else 0
        for hit, reason, price in (
            (b["low"] <= s["stop"] and b["open"] < s["stop"], "gap_down_below_stop", b["open"]), (b["low"] <= s["stop"], "stop_hit", s["stop"]), (b["close"] < b["ma50"], "close_below_50ma", b["close"]),
            (b["atr"] > 0 and (b["prev_close"] - b["close"]) / b["atr"] >= 3, "severe_breakdown", b["close"]), (below and count >= 2, "two_close_below_20ma", b["close"]),
        ):
            if hit:
                return s | dict(state="closing", exit_reason=reason, exit_price=price)
        s["caution"] = count
        if entry > stop0 and (b["high"] - entry) / (entry - stop0) >= 1:
            s["floor"] = max(s["floor"], entry)
        basis = "50ma" if b["ma50"] > entry else "20ma"
        trail = b["ma50"] if basis == "50ma" else b["ma20"]
        s["stop"] = max(s["floor"], trail) if basis != s["basis"] else max(s["stop"], trail, s["floor"])
        s["basis"] = basis
        for m in range(7, math.floor((b["close"] - b["ma50"]) / b["atr"]) + 1 if b["atr"] > 0 else 0):
            if m > s["trimmed"]:
                s["qty"], s["trimmed"] = s["qty"] * 0.9, m
        s["state"] = "managing"
    return s


def test_fold_equals_the_loop(spark):
    rng = np.random.default_rng(4)
    positions, rows, want = [], [], {}
    for t in range(60):
        price, bars = 100.0, []
        for i in range(1, 25):
            prev, price = price, price * (1 + rng.normal(0.012, 0.02))
            bars.append(dict(sidx=i, open=prev, high=max(prev, price) * 1.005, low=min(prev, price) * 0.995, close=price, prev_close=prev, atr=2.0, ma20=price * rng.uniform(0.94, 1.001), ma50=price * rng.uniform(0.8, 0.99)))
        positions.append((t, 0, 100.0, 94.0))
        rows += [(t, *b.values()) for b in bars]
        want[t] = plain(100.0, 94.0, bars)
    p = spark.createDataFrame(positions, "ticker long, opened int, entry double, first_stop double")
    b = spark.createDataFrame(rows, "ticker long, sidx int, open double, high double, low double, close double, prev_close double, atr double, ma20 double, ma50 double").withColumn("earnings_in", F.lit(None).cast("int"))
    got = {r["ticker"]: r for r in folded(p, b).collect()}
    assert len({w["exit_reason"] for w in want.values()}) > 2
    for t, w in want.items():
        for k, v in w.items():
            assert got[t][k] == (pytest.approx(v) if isinstance(v, float) else v), (t, k)
        assert got[t]["stop"] >= got[t]["floor"] >= 94.0 and 0 < got[t]["qty"] <= 100


def test_every_position_is_advanced_through_its_next_bars(spark):
    from sessionforge import queries  # noqa: F401  (registers the relations)
    from sessionforge.operators.trades import opened_and_bars

    sf = "/root/testdata/sf0.001"
    opened, bars = opened_and_bars(spark, sf)
    by = {}
    for b in sorted(bars.collect(), key=lambda b: b["sidx"]):
        by.setdefault(b["ticker"], []).append(b)
    want = {(b["ticker"], b["sidx"]) for of in by.values() for b in of if b["low"] < b["close"]}
    assert want == {(p["ticker"], p["opened"]) for p in opened.collect()}
    for most in (1, 30):
        got = folded(opened, bars, most).collect()
        assert len(got) == len(want) and {(r["ticker"], r["opened"]) for r in got} == want
        for r in got:
            nexts = [b for b in by[r["ticker"]] if b["sidx"] > r["opened"]][:most]
            assert r["n_bars"] == len(nexts)
            stopped = next((b for b in nexts[:1] if b["low"] <= r["first_stop"]), None)
            if stopped:
                gap = stopped["open"] < r["first_stop"]
                assert (r["exit_reason"], r["exit_price"], r["advanced"]) == (("gap_down_below_stop", stopped["open"]) if gap else ("stop_hit", r["first_stop"])) + (stopped["sidx"],)
            elif not nexts:
                assert (r["state"], r["stop"], r["advanced"]) == ("open", r["first_stop"], r["opened"])
            else:
                assert r["exit_reason"] not in ("stop_hit", "gap_down_below_stop") or r["advanced"] > nexts[0]["sidx"]


def test_streams_equal_their_batch_twins(spark):
    import duckdb

    from sessionforge.streaming import runs

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("events", "lineitem", "part"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for run, sql in ((runs.session_bars, runs.SESSION_BARS_SQL), (runs.quote_ingest, runs.QUOTE_INGEST_SQL), (runs.status, runs.STATUS_SQL), (runs.positions, runs.POSITIONS_SQL)):
        df = run(spark, sf)
        other = con.sql(sql)
        cols = sorted(df.columns)
        mine = sorted(tuple(str(r[c]) for c in cols) for r in df.collect())
        assert mine == sorted(tuple(str(r[other.columns.index(c)]) for c in cols) for r in other.fetchall()) and mine
