"""Streams with state by key: batches, restarts and late quotes against plain loops over all quotes."""

import datetime as dt
import random

import pytest

from sessionforge.streaming import keyed


def day(n, hour=12):
    return dt.datetime(2024, 1, n, hour)


SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"
QUOTES = [(1, day(1), 1, "a", 10.0), (2, day(1, 13), 1, "a", 12.0), (3, day(2), 1, "a", 20.0), (4, day(3), 1, "a", 9.0), (5, day(4), 1, "a", 50.0), (6, day(2), 2, "a", 5.0), (7, day(3), 2, "a", 6.0), (8, None, 2, "a", 1.0), (9, day(3), None, "a", 1.0), (10, day(4), 2, "a", None)]


def by_loop(rows):
    """Positions by the plain fold over the days of each ticker."""
    from test_trades import plain

    days = {}
    for _, ts, ticker, _, price in sorted((r for r in rows if None not in (r[1], r[2], r[4])), key=lambda r: (r[1], r[0])):
        days.setdefault(ticker, {}).setdefault(ts.date(), []).append(price)
    out = {}
    for ticker, of in days.items():
        closes, ranges, bars = [], [], []
        for d in sorted(of):
            p = of[d]
            closes.append(p[-1])
            ranges.append(max(p) - min(p))
            mean = lambda a, n: sum(a[-n:]) / len(a[-n:])
            bars.append(dict(open=p[0], high=max(p), low=min(p), close=p[-1], prev_close=closes[-2] if len(closes) > 1 else p[-1], atr=mean(ranges, 6), ma20=mean(closes, 3), ma50=mean(closes, 6)))
        s = plain(bars[0]["close"], bars[0]["low"], bars[1:])
        out[ticker] = (bars[0]["close"], s["state"], s["stop"], s["exit_reason"], s["exit_price"])
    return out


MORE = QUOTES + [(20 + 10 * t + i, day(1 + i, 9 + k), 3 + t, "a", 100 + (t + 1) * i * 3.0 + k - (40 if i == 6 + t else 0)) for t in range(4) for i in range(10) for k in range(3)]


def put(spark, folder, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/tmp-{name}")
    from pathlib import Path

    part = next(Path(f"{folder}/tmp-{name}").glob("part-*.parquet"))
    part.rename(f"{folder}/events-{name}.parquet")


def stood(rows):
    return {x.ticker: (x.entry, x.state, x.stop, x.exit_reason, x.exit_price) for x in keyed.latest(rows).collect()}


def same(got, want):
    assert set(got) == set(want)
    for k, v in want.items():
        assert all(x == (pytest.approx(y) if isinstance(y, float) else y) for x, y in zip(got[k], v, strict=True)), (k, got[k], v)


def test_positions_over_batches_with_a_restart(spark, tmp_path):
    source, state = tmp_path / "in", str(tmp_path / "state")
    source.mkdir()
    fine = [q for q in MORE if q[1] is not None]
    put(spark, source, "1", [q for q in MORE if q[1] is None or q[1].day <= 1])
    put(spark, source, "2", [q for q in fine if 1 < q[1].day <= 3 and q[1].hour < 11])
    got = keyed.run(keyed.position_stream(keyed.quotes(spark, str(source), files_a_batch=1)), state)
    same(stood(got), by_loop([q for q in fine if q[1].day <= 3 and (q[1].hour < 11 or q[1].day == 1)]))
    # days that are still open take quotes that come later, after a restart from the checkpoint
    put(spark, source, "3", [q for q in fine if 1 < q[1].day <= 3 and q[1].hour >= 11] + [q for q in fine if q[1].day > 3])
    got = keyed.run(keyed.position_stream(keyed.quotes(spark, str(source))), state)
    want = by_loop(MORE)
    same(stood(got), want)
    assert len({v[1] for v in want.values()}) == 2
    n = got.count()
    assert keyed.run(keyed.position_stream(keyed.quotes(spark, str(source))), state).count() == n  # nothing new, nothing told twice
    # a quote of a day that is over is counted and changes nothing
    put(spark, source, "4", [(900, day(1), 3, "a", 1.0), (901, day(12), 3, "a", 100.0)])
    last = {x.ticker: x for x in keyed.latest(keyed.run(keyed.position_stream(keyed.quotes(spark, str(source))), state)).collect()}
    assert last[3].late == 1 and last[1].late == 0 and (last[3].state, last[3].stop) == (want[3][1], want[3][2]) if want[3][1] == "closing" else last[3].late == 1


def life(acts, due, until):
    """Events of one ticker's actions [(ts, action)] by a plain loop."""
    out, status, ends, renewals = [], None, None, 0

    def pass_time(now):
        nonlocal status, ends
        while status and ends <= now:
            out.append(("expired" if status == "active" else "purged", ends, renewals))
            status, ends = ("expired", ends + dt.timedelta(days=14)) if status == "active" else (None, None)

    for ts, action in acts:
        pass_time(ts)
        if action == "add":
            out.append(("added" if status is None else "renewed" if status == "active" else "restored", ts, 0 if status is None else renewals + 1))
            status, ends, renewals = "active", due[ts.date()], out[-1][2]
        elif status == "active":
            out.append(("removed", ts, renewals))
            status, ends = "removed", ts + dt.timedelta(days=14)
    pass_time(until)
    return out


def test_watch_list_over_batches_with_a_restart(spark, tmp_path):
    rng, source = random.Random(5), tmp_path / "in"
    source.mkdir()
    start = dt.datetime(2024, 1, 2)
    rows = [(i, start + dt.timedelta(minutes=rng.randrange(60 * 24 * 70)), rng.randrange(6), rng.choice(["signup", "error", "view"]), rng.choice([50.0, 120.0, 200.0])) for i in range(90)]
    rows = sorted(rows + [(900, dt.datetime(2024, 3, 20), 99, "view", 1.0)], key=lambda q: q[1])
    put(spark, source, "1", rows[:40])
    for name, more in (("2", rows[40:70]), ("3", rows[70:])):
        keyed.run(keyed.watch_stream(keyed.quotes(spark, str(source), files_a_batch=1), 3), str(tmp_path / "state"))
        put(spark, source, name, more)
    got = keyed.run(keyed.watch_stream(keyed.quotes(spark, str(source)), 3), str(tmp_path / "state"))
    due = {x.day: dt.datetime.combine(x.due, dt.time()) for x in deadlines_of(spark)}
    want = []
    for ticker in range(6):
        acts = [(ts, "add" if kind == "signup" else "remove") for _, ts, t, kind, v in rows if t == ticker and (kind == "signup" and v >= 100 or kind == "error" and v >= 150)]
        want += [(ticker, *e) for e in life(acts, due, dt.datetime(2024, 3, 19))]
    micros = lambda t: int(t.replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000
    assert sorted(tuple(x) for x in got.collect()) == sorted((t, e, micros(at), n) for t, e, at, n in want)
    assert {e for _, e, _, _ in want} == {"added", "renewed", "restored", "removed", "expired", "purged"}


def deadlines_of(spark):
    return keyed.deadlines(spark, 3, dt.date(2023, 12, 1), dt.date(2024, 12, 31)).collect()


def test_deadline_skips_weekends_and_holidays(spark):
    due = {x.day: x.due for x in deadlines_of(spark)}
    assert due[dt.date(2024, 1, 2)] == dt.date(2024, 1, 6)  # Wed, Thu, Fri
    assert due[dt.date(2024, 1, 12)] == dt.date(2024, 1, 19)  # Monday the 15th is a holiday


def test_calls_on_the_state_do_not_grow_with_the_days_of_a_batch():
    from pyspark.sql import Row

    class Variable:
        def __init__(self):
            self.held, self.calls = None, 0

        def __getattr__(self, name):
            def call(*args):
                self.calls += 1
                if name in ("exists", "containsKey"):
                    return self.held is not None
                if name == "update":
                    self.held = args[0]
                return iter(()) if name == "iterator" else self.held

            return call

    class Handle:
        def __init__(self):
            self.made = []

        def getValueState(self, *_):  # noqa: N802
            self.made.append(Variable())
            return self.made[-1]

        getMapState = getValueState

    def told(n_days):
        handle, positions = Handle(), keyed.Positions()
        positions.init(handle)
        rows = [Row(ticker=1, event_id=i, ts=i * 1000, day=100 + i, price=10.0 + i) for i in range(n_days)]
        return next(positions.handleInputRows((1,), iter(rows), None)), sum(v.calls for v in handle.made)

    (few, calls), (many, more) = told(5), told(40)
    assert calls == more and few.advanced == 104 and many.advanced == 139 and many.through == 136
