"""Stores behind a gate, headers and keys, on literal rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sessionforge.operators import gates
from sessionforge.sources.gated import Gate, GatedStore, Refused

ONE, TWO = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
SCHEMA = "session_date date, name string, n int"


@pytest.fixture
def rows(spark):
    return lambda *r: spark.createDataFrame(r, SCHEMA)


def held(store, version=None):
    return sorted((tuple(r) for r in store.read(version).collect()), key=str)


def test_dates_are_replaced_whole_or_rows_by_key(spark, tmp_path, rows):
    first, second = rows((ONE, "a", 1), (ONE, "b", 1), (TWO, "a", 1)), rows((TWO, "c", 2), (TWO, None, 3))
    for name, keys, kept in (("whole", ["session_date"], []), ("keyed", ["session_date", "name"], [(TWO, "a", 1)])):
        store = GatedStore(spark, str(tmp_path / name), SCHEMA, keys)
        assert held(store) == []
        assert store.upsert(first, Gate(least=3)).verdict == "ok"
        assert store.upsert(second, Gate(least=3)).verdict == "warn"
        assert held(store) == sorted([(ONE, "a", 1), (ONE, "b", 1), *kept, (TWO, "c", 2), (TWO, None, 3)], key=str)
        assert len(held(store, 1)) == 3
    assert store.upsert(rows((TWO, "a", 9), (TWO, "a", 9), (TWO, None, 4)), Gate()).version == 3
    assert held(store) == sorted([(ONE, "a", 1), (ONE, "b", 1), (TWO, "a", 9), (TWO, "c", 2), (TWO, None, 4)], key=str)


def test_what_the_gate_keeps_out_changes_nothing(spark, tmp_path, rows):
    store = GatedStore(spark, str(tmp_path / "s"), SCHEMA, ["session_date"])
    store.upsert(rows((ONE, "a", 1)))
    before = held(store)
    gate = Gate(refused={"too many": "n > 5"}, shares={"ones": ("n = 1", 0.5)})
    for batch, why in ((rows((ONE, "x", 6), (ONE, "y", 2)), "too many"), (rows((ONE, "x", 1), (ONE, "y", 1), (ONE, "z", 2)), "ones: 67%"), (rows((None, "x", 2)), "session_date is missing"), (rows((ONE, "x", 2)).where("n > 2"), "no rows")):
        with pytest.raises(Refused, match=why):
            store.upsert(batch, gate)
        assert held(store) == before and store.version() == 1
    assert store.upsert(rows((ONE, "x", 2)).where("n > 2"), Gate(empty="skip")).verdict == "skip"
    assert store.upsert(rows((ONE, "x", 1), (ONE, "y", 2)), gate).verdict == "ok"  # a share at its limit may pass


def test_a_batch_is_computed_once_and_a_failure_in_the_middle_leaves_the_store(spark, tmp_path, rows, monkeypatch):
    store, runs = GatedStore(spark, str(tmp_path / "s"), SCHEMA, ["session_date", "name"]), spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(n):
        runs.add(1)
        return n

    store.upsert(rows((ONE, "a", 1), (ONE, "b", 2)).withColumn("n", counted("n")), Gate(shares={"ones": ("n = 1", 0.9)}))
    assert runs.value == 2

    def broken(*_):
        raise OSError("disk is gone")

    monkeypatch.setattr(GatedStore, "_switch", broken)
    with pytest.raises(OSError, match="disk is gone"):
        store.upsert(rows((ONE, "a", 7)))
    monkeypatch.undo()
    assert held(store) == [(ONE, "a", 1), (ONE, "b", 2)] and store.version() == 1
    store.upsert(rows((ONE, "a", 8)))
    assert held(store) == [(ONE, "a", 8), (ONE, "b", 2)]


def test_the_second_of_two_writers_is_told(spark, tmp_path, rows, monkeypatch):
    store = GatedStore(spark, str(tmp_path / "s"), SCHEMA, ["session_date"])
    store.upsert(rows((ONE, "a", 1)))
    monkeypatch.setattr(GatedStore, "version", lambda self: 0)  # as it was when the other one began
    with pytest.raises(Refused, match="written meanwhile"):
        store.upsert(rows((ONE, "b", 2)))


def test_settled_and_unknown_sessions_are_refused(spark, tmp_path):
    store = GatedStore(spark, str(tmp_path / "s"), "session_date date, session string", ["session_date"])
    batch = lambda *s: spark.createDataFrame([(ONE, x) for x in s], "session_date date, session string")
    for bad, why in (("eod", "settled session"), ("lunch", "unknown session"), (None, "unknown session")):
        with pytest.raises(Refused, match=why):
            store.upsert(batch("morning", bad), gates.PROVISIONAL)
    assert store.version() == 0
    assert store.upsert(batch("morning", "pre_close"), gates.PROVISIONAL).n_rows == 2


def test_headers(spark):
    page = lambda *labels, row="<tr><td>1</td></tr>": "<table><tr>" + "".join(f"<th>{x}</th>" for x in labels) + f"</tr>{row}</table>"
    expected = ["Ticker", *[f"c{i}" for i in range(19)]]
    pages = {
        "ok": [page(*expected[:10]), page(*expected[5:])],  # what one page shows is there
        "warn": [page(*expected[:-1])], "two": [page(*expected[:-2])], "three": [page(*expected[:-3])], "key": [page(*expected[1:])],
        "no rows": [page("x", row=""), "<p>blocked</p>", None], "rows elsewhere": [page(*expected, row=""), page("Ticker")],
    }
    df = spark.createDataFrame([(k, html) for k, all_pages in pages.items() for html in all_pages], "batch string, html string")
    missing, action = gates.header_verdict(F.col("seen"), expected, "Ticker")
    got = {r["batch"]: (r["n"], r["verdict"]) for r in gates.seen_labels(df, ["batch"], F.col("html")).select("batch", F.size(missing).alias("n"), action.alias("verdict")).collect()}
    assert got == {"ok": (0, "ok"), "warn": (1, "warn"), "two": (2, "warn"), "three": (3, "abort"), "key": (1, "abort"), "no rows": (0, "ok"), "rows elsewhere": (19, "abort")}


def test_keys_of_a_broken_parse(spark, tmp_path):
    store = GatedStore(spark, str(tmp_path / "s"), "session_date date, key string", ["session_date", "key"])
    batch = lambda *keys: spark.createDataFrame([(ONE, k) for k in keys], "session_date date, key string")
    assert store.upsert(batch("AAPL", "MSFT", "C", "NVDA"), gates.SOUND_KEYS).verdict == "ok"  # a quarter of each is allowed
    with pytest.raises(Refused, match="doubled keys: 40%"):
        store.upsert(batch("AAPL", "AA", "MSFT", "", None), gates.SOUND_KEYS)
    with pytest.raises(Refused, match="single keys: 33%"):
        store.upsert(batch("C", "MSFT", "NVDA"), gates.SOUND_KEYS)
    assert store.version() == 1
