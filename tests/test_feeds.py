"""Log lines, trees, exports, sections and the state kept over stream batches, on literal rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sessionforge.operators import feeds
from sessionforge.sources import files


def test_log_skips_malformed_lines_and_other_months(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"month":"2024-01","k":1,"cost":2.5}\n{"month":"2024-01"\n{"month":"2024-02","k":3,"cost":1}\n\nnot JSON\n')
    assert [(x.k, x.cost) for x in files.read_log(spark, str(tmp_path), "k int, cost double", "2024-01").collect()] == [(1, 2.5)]


def test_panel_files_coerce_numbers_and_dates(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,name,px,perf\n2024-01-02,a, 1 234.5,3.5%\nbad,b,\"1,234.5\",-\n2024-01-03,,N/A,\n")
    got = [tuple(x) for x in files.read_panel(spark, str(tmp_path), ["px", "perf"]).collect()]
    assert got == [(dt.date(2024, 1, 2), "a", None, 3.5), (None, "b", 1234.5, None), (dt.date(2024, 1, 3), None, None, None)]


def test_page_tables_and_embedded_data(spark):
    table = "<table><TR><th>Old</th><th> <b>Price</b></th><th>Junk</th></TR><tr><td><a>X</a></td><td> 3 </td><td>j</td></tr><tr><td>short</td></tr></table>"
    pages = spark.createDataFrame([(1, table), (2, "<p>no table</p>"), (3, None), (4, "<tr><td>Old</td></tr>")], "id int, html string")
    got = pages.select("id", files.table_rows(F.col("html"), {"Old": "Ticker"}, ["Ticker", "Price"]).alias("rows")).collect()
    assert {r.id: r.rows for r in got} == {1: [{"Ticker": "X", "Price": "3"}], 2: [], 3: [], 4: []}
    json = '{"data":{"rows":[{"text":{"ticker":"A"},"numbers":{"price":2.5,"volume":1234567,"marketCap":1230,"averageVolume":4770000}},{"text":{},"numbers":{}}]}}'
    pages = spark.createDataFrame([(1, f"<script data-ssr-props='x'>{json}</script>"), (2, "<script data-ssr-props>{bad</script>"), (3, None)], "id int, html string")
    got = files.embedded_rows(pages, ["Ticker", "Price", "Volume", "Market Cap", "Avg Volume", "Change"]).collect()
    assert [tuple(r) for r in got] == [(1, "A", "2.50", "1,234,567", "1.23B", "4.77M", "-")]
    good = json.replace('"A"', '"B"')
    several = f"<script data-ssr-props>{json[:50]}</script><script data-ssr-props>[1]</script><script data-ssr-props>{{\"data\":{{\"rows\":7}}}}</script><SCRIPT data-ssr-props>{good}</SCRIPT><script data-ssr-props>{json}</script>"
    blank = '<script data-ssr-props>{"data":{"rows":[]}}</script>'
    pages = spark.createDataFrame([(1, several), (2, blank + several)], "id int, html string")
    assert [tuple(r) for r in files.embedded_rows(pages, ["Ticker", "Price"]).collect()] == [(1, "B", "2.50")]  # rows, though none, end the search
    assert len({label for label, _, _ in files.EMBEDDED}) == len(files.EMBEDDED)


def test_taxonomy_rows_and_malformed_node(spark):
    good = spark.createDataFrame([('{"sector":"S","industries":[{"name":"a"},{"name":"b"}]}',)], "tree string")
    assert sorted(tuple(x) for x in feeds.taxonomy_rows(good).collect()) == [("S", "a"), ("S", "b")]
    with pytest.raises(Exception, match="malformed node"):
        feeds.taxonomy_rows(spark.createDataFrame([('{"industries":[]}',)], "tree string")).collect()


def test_export_skips_empty(spark, tmp_path):
    df = spark.range(3)
    assert feeds.export_all({"full": df, "none": df.where("id < 0")}, str(tmp_path)) == ["full"]
    assert spark.read.parquet(str(tmp_path)).count() == 3


def test_sections_and_phase(spark):
    texts = ["pre\n#### Headline\nbody x\n### What could go wrong\nno", "## TL;DR:\n\n a\nb\n\n## tl;dr\nlast", "## Headline\n \n## Other\nx", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = df.select(*[c.alias(k) for k, c in feeds.sections(F.col("text")).items()]).collect()
    assert [tuple(x) for x in got] == [("body x", "no"), ("last", None), (None, None), (None, None), (None, None)]
    answers = spark.createDataFrame([("Label: up \nWhy: a b",), ("first\n\nsecond\nthird",), ("Why: only",), ("",)], "text string")
    label, why = feeds.phase(F.col("text"))
    assert [tuple(x) for x in answers.select(label, why).collect()] == [("up", "a b"), ("first", "second third"), ("Why: only", "only"), ("", "")]


def test_owner_actions_need_their_state(spark):
    asked = [(1, 1, "still_holding"), (1, 2, "confirm"), (1, 3, "reopen"), (2, 5, "confirm"), (2, 6, "confirm"), (2, 7, "correct"), (2, 8, "reopen"), (3, 9, "confirm"), (4, 1, "unheard_of")]
    actions = spark.createDataFrame(asked, "position long, nth long, action string")
    states = spark.createDataFrame([(1, "closing"), (2, "closing"), (4, "closed"), (5, "managing")], "position long, state string")
    got = {(r.position, r.nth): (r.found, r.accepted, r.state) for r in feeds.owner_transitions(actions, states).collect()}
    assert got == {
        (1, 1): ("closing", True, "managing"), (1, 2): ("managing", False, "managing"), (1, 3): ("managing", False, "managing"), (2, 5): ("closing", True, "closed"), (2, 6): ("closed", False, "closed"),
        (2, 7): ("closed", True, "closed"), (2, 8): ("closed", True, "managing"), (3, 9): (None, False, None), (4, 1): ("closed", False, "closed"),
    }


def test_display_forms(spark):
    rng = random.Random(3)
    size = lambda x: f"{x / 1e9:.2f}B" if abs(x) >= 1e9 else f"{x / 1e6:.2f}M" if abs(x) >= 1e6 else f"{x / 1e3:.2f}K" if abs(x) >= 1e3 else f"{x:.2f}"
    plain = {"f2": lambda x: f"{x:.2f}", "pct": lambda x: f"{x:.2f}%", "int": lambda x: f"{round(x):,}", "money": lambda x: f"{x / 1000:.2f}B" if abs(x) >= 1000 else f"{x:.2f}M", "count": size}
    numbers = [0.0, 311.0, 1234567.0, -1234.5, 0.125, 0.375, 1.005, 1.115, 26.435, 2.675, -2.675, 999.995, 999.999, 1000.0, 1.5e9, 2.5, 3.5, -0.001, 1e15, 0.005, 0.015, 123456.785]
    numbers += [rng.choice([rng.uniform(-1, 1), rng.uniform(-1e4, 1e4), rng.uniform(0, 1e10), rng.randrange(10**6) / 1000 + 0.005]) for _ in range(400)]
    df = spark.createDataFrame([(repr(x),) for x in numbers], "v string")
    got = df.select("v", *[files.displayed(F.col("v"), k).alias(k) for k in plain]).collect()
    assert [(r["v"], *(r[k] for k in plain)) for r in got] == [(repr(x), *(f(x) for f in plain.values())) for x in numbers]
    others = [("2026-08-26T16:30:00", "earn", "Aug 26/a"), ("2026-08-26T11:59", "earn", "Aug 26/b"), ("2026-08-06", "earn", "Aug 06"), ("soon", "earn", "-"), ("2026-13-40", "earn", "-"), ("", "text", "-"), ("x", "text", "x"), (None, "text", "-"), (None, "int", "-"), ("NaN", "f2", "-"), ("n/a", "count", "-"), ("", "money", "-")]
    df = spark.createDataFrame([(i, v) for i, (v, _, _) in enumerate(others)], "i int, v string")
    for kind in {k for _, k, _ in others}:
        shown = {r["i"]: r["t"] for r in df.select("i", files.displayed(F.col("v"), kind).alias("t")).collect()}
        assert all(shown[i] == want for i, (_, k, want) in enumerate(others) if k == kind), kind
