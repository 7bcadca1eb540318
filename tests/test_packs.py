"""Packs, registered fields and the rules for statements, on literal rows."""

import pytest
from pyspark.sql import functions as F

from sessionforge.operators import packs


def test_unregistered_fields_are_errors(spark):
    with pytest.raises(packs.UnregisteredField, match="row.made_up"):
        packs.pack("morning_card", {"row.made_up": F.lit(1)})
    rows = spark.createDataFrame([("morning_card", "row.price"), ("morning_triage", "derived.n_rows")], "surface string, field string")
    assert [r.unit for r in packs.checked(rows).collect()] == ["usd", "int"]
    for bad in (("morning_card", "row.made_up"), ("morning_triage", "row.price"), ("morning_card", None)):
        with pytest.raises(Exception, match="unregistered field"):
            packs.checked(spark.createDataFrame([bad], "surface string, field string")).collect()


SCHEMA = "response long, nth int, version string, surface string, kind string, text string, slots map<string,string>, cites array<string>, subjects array<string>, confidence string, fields map<string,boolean>, context map<string,array<string>>, notes string"
PACK = ({"row.price": True, "row.change": True, "row.atr": False, "group.rs_score": True}, {"groups": ["Steel", "Oil"]})


def judged(spark, *statements, surface="morning_card", version=None, notes="", kind="read"):
    """Statements given as changes to a good one; rules, confidences and whether the card is dropped."""
    rows = []
    for nth, s in enumerate(statements):
        s = {"kind": kind, "text": "Price {p} holds", "slots": {"p": "row.price"}, "cites": ["row.price", "row.change"], "subjects": None, "confidence": "high"} | s
        rows.append((1, nth, version, surface, s["kind"], s["text"], s["slots"], s["cites"], s["subjects"], s["confidence"], *PACK, notes))
    got = packs.validated(spark.createDataFrame(rows, SCHEMA)).orderBy("nth").collect()
    return [g.rule for g in got], [g.confidence for g in got], {g.card_dropped for g in got}


def test_each_rule(spark):
    cases = [
        ({"kind": "thesis"}, "kind"), ({"text": " \n"}, "shape"), ({"text": None}, "shape"), ({"text": "Price {q} holds"}, "slot_undeclared"), ({"text": "Price holds"}, "slot_unused"),
        ({"text": "At {row.price}", "slots": {}}, "slot_undeclared"), ({"slots": {"p": "context:groups"}}, "slot_unresolved"), ({"slots": {"p": "row.none"}}, "slot_unresolved"),
        ({"cites": []}, "cite_unresolved"), ({"cites": None}, "cite_unresolved"), ({"cites": ["row.price", "context:none"]}, "cite_unresolved"), ({"cites": ["context:groups#Gold"]}, "cite_unresolved"), ({"cites": ["row.price", None]}, "cite_unresolved"),
        ({"text": "Up 5 at {p}"}, "bare_digit"), ({"text": "{p} over the 50MA, S&P 500 and 52-week high"}, None), ({"subjects": ["x"]}, "subjects"), ({"cites": ["context:groups#Oil", "context:groups", "row.price"]}, None),
    ]
    for change, rule in cases:
        assert judged(spark, change)[0] == [rule], change
    assert judged(spark, {}, version="2.1")[0] == ["contract_version"] and judged(spark, {}, version="1.9")[0] == [None]
    assert judged(spark, {}, surface="elsewhere")[0] == ["kind"]


def test_caps_confidence_and_catch(spark):
    rules, confidence, dropped = judged(spark, {}, {}, {"kind": "catch", "cites": ["row.price", "row.atr"]}, {"kind": "catch"})
    assert rules == [None, "cap_kind", None, "cap_kind"] and confidence == ["high", None, "low", None] and dropped == {False}
    assert judged(spark, {}, {"kind": "catch", "text": "7"})[2] == {True}  # the catch breaks a rule
    triage = [{"kind": "triage"}] * 4 + [{"kind": "catch", "subjects": ["A"]}]
    assert judged(spark, *triage, surface="morning_triage")[0] == [None, None, None, "cap_kind", None]
    assert judged(spark, {"kind": "regime"}, surface="brief_public")[2] == {False}
    low = judged(spark, {"cites": ["row.price"]}), judged(spark, {"confidence": "sure"}), judged(spark, {"confidence": None}), judged(spark, {}, notes="the change is stale")
    assert [x[1] for x in low] == [["low"]] * 4
    assert judged(spark, {}, notes="what changed")[1] == ["high"]  # whole words only
