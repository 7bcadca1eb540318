"""Streams with state by key, kept in the state store: positions that quotes move, and a watch list with expiry.

A batch reads and writes the state of its own keys only. State, timers and the rows that are written go
with the query's checkpoint, so a query that is started again goes on where it ended and tells nothing twice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from datetime import date
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window as W

from sessionforge.operators.calendar import calendar
from sessionforge.operators.trades import SETTINGS
from sessionforge.plans.registry import r
from sessionforge.sources.market import shared_folder, table

#: Days whose closes and ranges make a day bar's moving averages and its ATR.
FAST, SLOW = 3, 6
#: Days before a ticker's last one that still take quotes.
OPEN_DAYS = 2
CFG = {k: v for k, (_, v) in SETTINGS.items()}


def quotes(spark: SparkSession, folder: str, files_a_batch: int | None = None) -> DataFrame:
    """The events in a folder as a stream of quotes: (event_id, ts, ticker, kind, price)."""
    reader = spark.readStream.schema(spark.read.option("pathGlobFilter", "events*.parquet").parquet(folder).schema).option("pathGlobFilter", "events*.parquet")
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    return reader.parquet(folder).select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("ticker"), F.col("event_type").alias("kind"), F.col("value").alias("price"))


def run(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over all there is, going on from what the folder's checkpoint knows; all rows that it ever wrote."""
    spark = stream.sparkSession
    key, was = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        if was is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, was)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


STATE = "entry double, first_stop double, closes array<double>, ranges array<double>, state string, stop double, floor double, basis string, caution int, qty double, trimmed int, exit_price double, exit_reason string, advanced int"
DAY = "open_at long, open_id long, open double, high double, low double, close_at long, close_id long, close double"
_STATE, _DAY = ([f.split()[0] for f in names.split(", ")] for names in (STATE, DAY))
HELD = "n long, late long, through int, settled struct<{}>, days array<struct<d int, {}>>".format(STATE, DAY)
SHOWN = ("state", "entry", "stop", "floor", "basis", "caution", "qty", "exit_price", "exit_reason", "advanced")


def opened(day: int, bar: dict) -> dict:
    """A position that a ticker's first day opens: at its close, with its low as the stop."""
    plain = {"caution": 0, "qty": 100.0, "trimmed": 0, "exit_price": None, "exit_reason": None, "advanced": day}
    return plain | {"entry": bar["close"], "first_stop": bar["low"], "closes": [bar["close"]], "ranges": [bar["high"] - bar["low"]], "state": "open", "stop": bar["low"], "floor": bar["low"], "basis": "20ma"}


def advanced(p: dict, day: int, bar: dict) -> dict:
    """The position after a day's bar: an exit is looked for first, then floor, stop and trims move. A closing position stays, and so does one that knows the day."""
    if p["state"] == "closing" or day <= p["advanced"]:
        return p
    closes, ranges = (p["closes"] + [bar["close"]])[-SLOW:], (p["ranges"] + [bar["high"] - bar["low"]])[-SLOW:]
    mean = lambda x: sum(x, 0.0) / len(x)
    fast, slow, atr, close, entry, risk = mean(closes[-FAST:]), mean(closes), mean(ranges), bar["close"], p["entry"], p["entry"] - p["first_stop"]
    p = p | {"closes": closes, "ranges": ranges, "advanced": day}
    caution = p["caution"] + 1 if close < fast else 0
    gone = lambda why, price: p | {"state": "closing", "exit_reason": why, "exit_price": price}
    if bar["low"] <= p["stop"]:
        return gone("gap_down_below_stop", bar["open"]) if bar["open"] < p["stop"] else gone("stop_hit", p["stop"])
    if close < (slow if CFG["HARD_EXIT_BASIS"] == "50ma" else fast):
        return gone("close_below_50ma" if CFG["HARD_EXIT_BASIS"] == "50ma" else "close_below_20ma", close)
    if atr > 0 and (p["closes"][-2] - close) / atr >= CFG["SEVERE_BREAKDOWN_ATR"]:
        return gone("severe_breakdown", close)
    if close < fast and caution >= CFG["TWO_CLOSE_EXIT"]:
        return gone("two_close_below_20ma", close)
    reached = close if CFG["BREAKEVEN_TRIGGER"] == "close" else bar["high"]
    floor = max(p["floor"], entry) if risk > 0 and (reached - entry) / risk >= CFG["BREAKEVEN_R"] else p["floor"]
    basis, trail = ("50ma", slow) if CFG["WIDEN_TRAIL_BASIS"] and slow > entry else ("20ma", fast)
    stop = max(floor, trail) if basis != p["basis"] else max(p["stop"], trail, floor)
    extended = math.floor((close - slow) / atr) if atr > 0 else 0
    levels = max(0, extended - max(CFG["TRIM_START_ATR"] - 1, p["trimmed"]))
    return p | {"state": "managing", "stop": stop, "floor": floor, "basis": basis, "caution": caution, "qty": p["qty"] * (1 - CFG["TRIM_PCT"]) ** levels, "trimmed": extended if levels else p["trimmed"]}


def with_quote(bar: dict | None, ts: int, event_id: int, price: float) -> dict:
    """A day's bar with one more quote, which may be earlier than others."""
    if bar is None:
        return {"open_at": ts, "open_id": event_id, "open": price, "high": price, "low": price, "close_at": ts, "close_id": event_id, "close": price}
    bar = bar | {"high": max(bar["high"], price), "low": min(bar["low"], price)}
    if (ts, event_id) < (bar["open_at"], bar["open_id"]):
        bar |= {"open_at": ts, "open_id": event_id, "open": price}
    if (ts, event_id) > (bar["close_at"], bar["close_id"]):
        bar |= {"close_at": ts, "close_id": event_id, "close": price}
    return bar


class Positions(StatefulProcessor):
    """Moves each ticker's position through its day bars.

    In the state are the position after the days that are over, and the bars of a ticker's last OPEN_DAYS
    days and the one before them, which take later quotes still. A batch tells where the position stands if
    those days end as they are now; they become part of it when later days have begun. Quotes of days that
    are over are left out and counted.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        # one variable, as each call on the state is a round trip to the JVM; a ticker's open days are few
        self.held = handle.getValueState("held", HELD)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        n, late, through, settled, days = self.held.get() or (0, 0, None, None, ())
        position = dict(zip(_STATE, settled, strict=True)) if settled is not None else None
        if position is not None:
            position |= {"closes": list(position["closes"]), "ranges": list(position["ranges"])}
        bars = {day: dict(zip(_DAY, bar, strict=True)) for day, *bar in days}
        for _, event_id, ts, day, price in rows:
            if through is not None and day <= through:
                late += 1
                continue
            bars[day] = with_quote(bars.get(day), ts, event_id, price)
        last_over = max(bars, default=0) - OPEN_DAYS - 1
        for day in sorted(day for day in bars if day <= last_over):
            bar = bars.pop(day)
            position = opened(day, bar) if position is None else advanced(position, day, bar)
            through = day
        settled = tuple(position[f] for f in _STATE) if position is not None else None
        self.held.update((n + 1, late, through, settled, [(day, *bar.values()) for day, bar in sorted(bars.items())]))
        for day in sorted(bars):
            position = opened(day, bars[day]) if position is None else advanced(position, day, bars[day])
        yield Row(ticker=key[0], n=n + 1, late=late, through=through, **{c: position[c] if position else None for c in SHOWN})

    def close(self) -> None:
        pass


def position_stream(quoted: DataFrame) -> DataFrame:
    """A row for each ticker that a batch has quotes of: where its position stands by then, n counting a ticker's rows."""
    # in the order in which Positions takes a row apart
    fine = quoted.where("ticker is not null and ts is not null and price is not null").select("ticker", "event_id", F.unix_micros("ts").alias("ts"), F.unix_date(F.to_date("ts")).alias("day"), F.col("price").cast("double").alias("price"))
    kinds = {"state": "string", "basis": "string", "exit_reason": "string", "caution": "int", "advanced": "int"}
    schema = "ticker long, n long, late long, through int, " + ", ".join(f"{c} {kinds.get(c, 'double')}" for c in SHOWN)
    return fine.groupBy("ticker").transformWithState(Positions(), schema, "Append", "None")


def latest(rows: DataFrame) -> DataFrame:
    """The last row of each ticker."""
    return rows.withColumn("_nth", F.row_number().over(W.partitionBy("ticker").orderBy(F.desc("n")))).where("_nth = 1").drop("_nth")


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each ticker's position after all quotes."""
    rows = latest(run(position_stream(quotes(spark, sf_dir)), shared_folder(spark)))
    return rows.selectExpr("ticker", "state", r("entry"), r("stop"), r("floor"), "basis", "caution", r("qty"), r("exit_price"), "exit_reason", "advanced")


#: Sessions that a watched ticker stays on the list, and days after which one that has left it is forgotten.
WATCH_SESSIONS, PURGE_DAYS = 10, 14
PURGE = PURGE_DAYS * 86_400_000_000  # times in the state are microseconds
#: What puts a ticker on the list or takes it off: a kind of event, from a value on.
ADDS, REMOVES = ("signup", 100), ("error", 150)
#: Days that the calendar of deadlines covers.
DEADLINES = (date(1990, 1, 1), date(2040, 12, 31))


def deadlines(spark: SparkSession, sessions: int = WATCH_SESSIONS, first: date = DEADLINES[0], last: date = DEADLINES[1]) -> DataFrame:
    """(day, due): for each day the end of the session that is `sessions` after it."""
    days = calendar(spark, first, last)
    ends = days.where("is_open").select((F.col("n_open") - sessions).alias("_n"), F.date_add("day", 1).alias("due"))
    return days.join(ends.hint("merge"), F.col("n_open") == F.col("_n")).select("day", "due")


class WatchList(StatefulProcessor):
    """The life of a watched ticker: added, renewed or restored by an action; expired after its sessions; removed; purged.

    A timer stands for what is due next. What is due before an action of the same batch comes before it, so
    it makes no difference how actions fall into batches.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "status string, due long, renewals int")

    def _until(self, key: int, held: tuple | None, now: int) -> Iterator[tuple[Row | None, tuple | None]]:
        """What falls due up to now, with what is held then."""
        while held is not None and held[1] <= now:
            status, due, renewals = held
            event = "expired" if status == "active" else "purged"
            held = ("expired", due + PURGE, renewals) if status == "active" else None
            yield Row(ticker=key, event=event, moment=due, renewals=renewals), held

    def _keep(self, held: tuple | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held is None:
            self.held.clear()
        else:
            self.held.update(held)
            self.handle.registerTimer(held[1] // 1000)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = tuple(self.held.get()) if self.held.exists() else None
        for row in sorted(rows, key=lambda x: (x["at"], x["event_id"])):
            for told, held in self._until(key[0], held, row["at"]):
                yield told
            if row["action"] == "add":
                event = "added" if held is None else "renewed" if held[0] == "active" else "restored"
                held = ("active", row["due"], 0 if held is None else held[2] + 1)
                yield Row(ticker=key[0], event=event, moment=row["at"], renewals=held[2])
            elif held is not None and held[0] == "active":
                held = ("removed", row["at"] + PURGE, held[2])
                yield Row(ticker=key[0], event="removed", moment=row["at"], renewals=held[2])
        self._keep(held)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        held = tuple(self.held.get()) if self.held.exists() else None
        for told, held in self._until(key[0], held, timerValues.getCurrentWatermarkInMs() * 1000):
            yield told
        self._keep(held)

    def close(self) -> None:
        pass


def watch_stream(quoted: DataFrame, sessions: int = WATCH_SESSIONS) -> DataFrame:
    """What happens to watched tickers, a row an event: (ticker, event, moment, renewals)."""
    of = lambda kind, least: (F.col("kind") == kind) & (F.col("price") >= least)
    action = F.when(of(*ADDS), "add").when(of(*REMOVES), "remove")
    days = deadlines(quoted.sparkSession, sessions).select(F.col("day").alias("_day"), F.unix_micros(F.col("due").cast("timestamp")).alias("due"))
    # a condition on ts too, as others would be moved before the watermark, which all quotes drive
    known = F.when(F.col("ts").isNotNull(), F.col("ticker").isNotNull() & F.col("action").isNotNull())
    acts = quoted.withWatermark("ts", "1 day").select("ticker", "event_id", "ts", action.alias("action")).where(known)
    acts = acts.join(F.broadcast(days), F.to_date("ts") == F.col("_day"), "left").select("ticker", "event_id", "ts", F.unix_micros("ts").alias("at"), "action", "due")  # a row a day of 51 years
    return acts.groupBy("ticker").transformWithState(WatchList(), "ticker long, event string, moment long, renewals int", "Append", "EventTime")


def watch_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The watch list's events over all quotes, up to a day before the last one."""
    return run(watch_stream(quotes(spark, sf_dir)), shared_folder(spark)).select("ticker", "event", F.date_format(F.timestamp_micros("moment"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("moment"), "renewals")


def watch_sql(days: str) -> str:
    """The same as a recursive query, a round an action; days: the other engine's CTEs that end in open_days."""
    between = lambda event, at, cond: f"SELECT ticker, '{event}' AS event, {at} AS moment, renewals FROM g WHERE {cond}"
    purge = f"INTERVAL {PURGE_DAYS} DAY"
    return f"""WITH RECURSIVE {days},
numbered AS (SELECT day, row_number() OVER (ORDER BY day) AS n FROM open_days),
acts AS (SELECT user_id AS ticker, ts, event_id, CASE WHEN event_type = '{ADDS[0]}' AND value >= {ADDS[1]} THEN 'add' WHEN event_type = '{REMOVES[0]}' AND value >= {REMOVES[1]} THEN 'remove' END AS action FROM events WHERE user_id IS NOT NULL),
a AS (SELECT ticker, ts, action, row_number() OVER (PARTITION BY ticker ORDER BY ts, event_id) AS nth,
  (SELECT CAST(day AS TIMESTAMP) + INTERVAL 1 DAY FROM numbered WHERE n = {WATCH_SESSIONS} + (SELECT count(*) FROM open_days WHERE day <= CAST(ts AS DATE))) AS due FROM acts WHERE action IS NOT NULL),
f AS (SELECT ticker, nth, ts, CASE action WHEN 'add' THEN 'active' END AS status, CASE action WHEN 'add' THEN due END AS due, 0 AS renewals, CASE action WHEN 'add' THEN 'added' END AS event FROM a WHERE nth = 1
UNION ALL
SELECT ticker, nth, ts, CASE WHEN action = 'add' THEN 'active' WHEN was = 'active' THEN 'removed' ELSE was END, CASE WHEN action = 'add' THEN next_due WHEN was = 'active' THEN ts + {purge} WHEN was = 'expired' AND status = 'active' THEN due + {purge} ELSE due END,
  CASE WHEN action = 'add' THEN CASE WHEN was IS NULL THEN 0 ELSE renewals + 1 END ELSE renewals END, CASE WHEN action = 'add' THEN CASE WHEN was IS NULL THEN 'added' WHEN was = 'active' THEN 'renewed' ELSE 'restored' END WHEN was = 'active' THEN 'removed' END
FROM (SELECT a.ticker, a.nth, a.ts, a.action, a.due AS next_due, f.status, f.due, f.renewals, CASE WHEN f.status = 'active' THEN CASE WHEN f.due > a.ts THEN 'active' WHEN f.due + {purge} > a.ts THEN 'expired' END WHEN f.due > a.ts THEN f.status END AS was FROM f JOIN a ON a.ticker = f.ticker AND a.nth = f.nth + 1) x),
g AS (SELECT *, least(coalesce(lead(ts) OVER (PARTITION BY ticker ORDER BY nth), TIMESTAMP '9999-01-01'), (SELECT max(ts) FROM events) - INTERVAL 1 DAY) AS until, coalesce(lead(ts) OVER (PARTITION BY ticker ORDER BY nth), TIMESTAMP '9999-01-01') AS next_ts FROM f),
told AS (SELECT ticker, event, ts AS moment, renewals FROM f WHERE event IS NOT NULL
UNION ALL {between('expired', 'due', "status = 'active' AND (due <= next_ts AND next_ts < TIMESTAMP '9999-01-01' OR due <= until)")}
UNION ALL {between('purged', f'due + {purge}', f"status = 'active' AND (due + {purge} <= next_ts AND next_ts < TIMESTAMP '9999-01-01' OR due + {purge} <= until)")}
UNION ALL {between('purged', 'due', "status IN ('removed', 'expired') AND (due <= next_ts AND next_ts < TIMESTAMP '9999-01-01' OR due <= until)")})
SELECT ticker, event, strftime(moment, '%Y-%m-%d %H:%M:%S.%f') AS moment, CAST(renewals AS INT) AS renewals FROM told"""
