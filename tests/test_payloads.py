"""Rules on payloads: every rule on literal JSON, their order, and values in normal form."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from sessionforge.operators import payloads

TODAY = dt.date(2024, 2, 29)
FINE = {"ticker": "abc", "entry_price": 10, "initial_stop": 9.5, "qty": 3}


def told(spark, bodies, rule, *more):
    rows = [(i, b if b is None or isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)]
    df = spark.createDataFrame(rows, "i int, text string").withColumn("body", F.try_parse_json("text"))
    return [r[0] for r in df.orderBy("i").select(rule(F.col("body"), *more)).collect()]


def test_positions(spark):
    cases = [
        (FINE, None), (None, "body"), ("", "body"), ("{", "body"), ("[]", "body"), ("3", "body"), ("null", "body"), ("{}", "ticker"),
        ({"ticker": 7}, "ticker"), ({"ticker": "7A"}, "ticker"), ({"ticker": "A" * 11}, "ticker"), ({"ticker": "A b"}, "ticker"), (FINE | {"ticker": "\t abc\n"}, None), ({"ticker": " brk.b- "}, "entry_price"),
        (FINE | {"entry_price": "10"}, "entry_price"), (FINE | {"entry_price": 0, "qty": 0}, "entry_price"), (FINE | {"initial_stop": None}, "initial_stop"), (FINE | {"initial_stop": -1}, "initial_stop"),
        (FINE | {"qty": True}, "qty"), (FINE | {"qty": 0.5}, None), (FINE | {"initial_stop": 10}, "stop not below entry"), (FINE | {"initial_stop": 11, "stop_basis": "x"}, "stop not below entry"),
        (FINE | {"stop_basis": "x"}, "stop_basis"), (FINE | {"stop_basis": 5}, None), (FINE | {"stop_basis": "50ma"}, None), (FINE | {"meta": []}, "meta"), (FINE | {"meta": "x"}, "meta"), (FINE | {"meta": None}, None),
        (FINE | {"entry_date": "2024-02-29"}, None), (FINE | {"entry_date": "2023-02-29"}, "entry_date"), (FINE | {"entry_date": "2024-2-9"}, "entry_date"), (FINE | {"entry_date": 20240101}, "entry_date"),
        (FINE | {"entry_date": ""}, None), (FINE | {"entry_date": None}, None), (FINE | {"entry_date": "2024-03-01"}, "entry_date in the future"), (FINE | {"entry_date": "2024-13-01"}, "entry_date"),
    ]
    got = told(spark, [c for c, _ in cases], payloads.position_problem, F.lit(TODAY))
    assert got == [w for _, w in cases]


def test_positions_in_normal_form(spark):
    more = FINE | {"stop_basis": 5, "meta": {"source": "picks"}, "days_to_earnings": -3.7, "entry_date": "2024-01-31"}
    plain, full, odd = told(spark, [FINE, more, FINE | {"meta": {"source": ["picks"]}, "days_to_earnings": "3"}], payloads.position_value)
    assert tuple(plain) == ("ABC", 10.0, 9.5, 3.0, "manual", "manual", None, None)
    assert tuple(full) == ("ABC", 10.0, 9.5, 3.0, "manual", "picks", -3, dt.date(2024, 1, 31))
    assert odd.source == "manual" and odd.days_to_earnings is None


BATCH = {"trade_date": " 2024-01-02 ", "collected_at": "2024-01-02T21:00:00Z", "quotes": [{"ticker": "a", "close": 1.5, "volume": " 70 ", "open": "x", "note": None, "collected_at": "y"}]}


@pytest.mark.parametrize(
    "change, want",
    [({}, None), ({"trade_date": None}, "trade_date"), ({"trade_date": "2024-1-2"}, "trade_date"), ({"collected_at": " "}, "collected_at"), ({"collected_at": 5}, "collected_at"), ({"quotes": {}}, "quotes"), ({"quotes": []}, "quotes"),
     ({"quotes": [{"ticker": "A"}, [1], {"ticker": 5}]}, "quotes[1]"), ({"quotes": [{"ticker": "A"}, {}]}, "quotes[1].ticker"), ({"quotes": [{"ticker": "A", "raw": "x"}]}, "quotes[0].raw"), ({"quotes": [None]}, "quotes[0]"), ({"quotes": [{"ticker": "A", "raw": None}]}, None)],
)
def test_batches_of_quotes(spark, change, want):
    assert told(spark, [BATCH | change], payloads.quotes_problem) == [want]


def test_quotes_of_sound_batches_are_typed_and_kept_whole(spark):
    bad = BATCH | {"quotes": [{"ticker": "OK"}, {"ticker": "no way"}]}
    own = BATCH | {"quotes": [{"ticker": "B", "close": "", "raw": {"z": 1, "a": [2]}}, {"ticker": "B", "close": True}]}
    df = spark.createDataFrame([(json.dumps(b), "clash") for b in (BATCH, bad, own)] + [(None, "clash")], "text string, ticker string").withColumn("body", F.try_parse_json("text"))
    got = sorted(tuple(r) for r in payloads.quote_rows(df, numbers=("open", "close", "volume")).collect())
    at = ("2024-01-02", "2024-01-02T21:00:00Z")
    assert [g[:6] for g in got] == [(*at, "A", None, 1.5, 70.0), (*at, "B", None, None, None), (*at, "B", None, None, None)]
    assert json.loads(got[0][6]) == {"ticker": "a", "close": 1.5, "volume": " 70 ", "open": "x", "note": None}
    assert sorted(json.loads(g[6]).get("z", 0) for g in got[1:]) == [0, 1]
    assert payloads.quote_rows(df.where("false")).collect() == []


def test_watch_entries(spark):
    cases = [
        ({"ticker": "A"}, None), ({"ticker": "A", "level_type": ""}, None), ({"level_type": "above"}, "ticker"), ({"ticker": "A", "level_type": 5}, "unknown level_type"), ({"ticker": "A", "level_value": 5}, "level_value requires a level_type"),
        ({"ticker": "A", "level_type": "above", "level_value": 5}, None), ({"ticker": "A", "level_type": "above", "level_value": "5"}, "level_value must be positive"), ({"ticker": "A", "level_type": "below"}, "level_value must be positive"),
        ({"ticker": "A", "level_type": "reclaim_50ma"}, None), ({"ticker": "A", "level_type": "reclaim_50ma", "level_value": 1}, "level_value must be omitted"), ({"ticker": "A", "level_type": None, "level_value": "x"}, "level_value requires a level_type"), ("[", "body"),
    ]
    assert told(spark, [c for c, _ in cases], payloads.added_problem) == [w for _, w in cases]


def test_changes_of_watch_entries(spark):
    cases = [
        ({"renew": True, "remove": True}, "renew", None), ({"remove": True, "restore": True}, "remove", None), ({"renew": "true", "restore": True}, "restore", None), ({"renew": True, "level_type": "x"}, "renew", None), ({"renew": False}, None, "nothing to change"), ({}, None, "nothing to change"),
        ({"level_type": None}, "edit", None), ({"level_value": None}, "edit", None), ({"level_value": 2}, "edit", "level_value requires a level_type"), ({"level_type": "below", "level_value": 2}, "edit", None), ({"level_type": "x"}, "edit", "unknown level_type"),
    ]
    assert told(spark, [c for c, _, _ in cases], payloads.change_of) == [w for _, w, _ in cases]
    assert told(spark, [c for c, _, _ in cases], payloads.changed_problem) == [w for _, _, w in cases]
    assert told(spark, [None, "[1]"], payloads.changed_problem) == ["body", "body"]
