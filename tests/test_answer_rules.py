"""Rules on answers, on literal calls."""

from pyspark.sql import functions as F

from sessionforge.operators import answer_rules as rules

SCHEMA = "i int, capture_date date, key string, status string, raw string, parsed map<string,string>, named array<string>, given array<string>"


def call(i, task, status="ok", raw=None, parsed=None, named=None, given=None, date="2026-03-01"):
    import datetime as dt

    return (i, dt.date.fromisoformat(date), f"sectors.{task}", status, raw, parsed, named, given)


def test_findings_by_task(spark):
    whole = {"relative_strength": "x", "risks": "y"}
    bullets = lambda n: "Intro\n" + "\n".join(("- a", " * b", "• c")[i % 3] for i in range(n)) + "\n-none\n"
    cases = [
        (call(0, "rotation_phase", parsed={"label": " Mid Cycle "}), []), (call(1, "rotation_phase", parsed={"label": "Sideways"}), ["unknown_label"]), (call(2, "rotation_phase"), ["no_parsed_answer"]), (call(3, "rotation_phase", parsed={}), ["unknown_label"]),
        (call(4, "watchlist", raw=bullets(5)), []), (call(5, "watchlist", raw=bullets(6)), ["too_many_bullets"]), (call(6, "watchlist"), []), (call(7, "risk_radar", parsed=whole), []), (call(8, "risk_radar", parsed=whole | {"risks": " "}), ["no_risks"]),
        (call(9, "risk_radar", parsed={"risks": None}), ["no_relative_strength", "no_risks"]), (call(10, "risk_radar", status="timeout"), []), (call(11, "risk_radar", status=None), ["no_parsed_answer"]), (call(12, "rotation_map", named=["A", "B"], given=["B"]), ["unknown_name"]), (call(13, "rotation_map", named=["A"], given=["A"]), []), (call(14, "rotation_map", status="", named=["A"]), ["unknown_name"]),
    ]
    df = spark.createDataFrame([c for c, _ in cases], SCHEMA)
    found = rules.findings(*[F.col(c) for c in ("key", "status", "raw", "parsed", "named", "given")])
    got = {r["i"]: [x["rule"] for x in r["found"]] for r in df.select("i", found.alias("found")).collect()}
    assert got == {c[0]: want for c, want in cases}


def test_roll_up(spark):
    bad, odd, fine = call(0, "rotation_phase"), call(1, "rotation_map", named=["A"]), call(2, "watchlist")
    on = lambda c, d: (c[0], __import__("datetime").date.fromisoformat(d), *c[2:])
    rows = [on(bad, "2026-03-01"), on(odd, "2026-03-01"), on(fine, "2026-03-01"), on(odd, "2026-03-02"), on(fine, "2026-03-03"), on(bad, "2026-01-18"), call(5, "risk_radar", status="error", date="2026-03-03")]
    got = {str(r.capture_date): tuple(r)[1:] for r in rules.rolled_up(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"2026-03-01": (3, 3, 1, 1, "fail"), "2026-03-02": (1, 1, 0, 1, "warn"), "2026-03-03": (2, 1, 0, 0, "clean"), "2026-01-18": (1, 1, 1, 0, "excluded")}
