"""A watch list in batches: ticks that count once a date, and the rules of adding, renewing, removing and restoring.

Ticks come in any number at once. What a row does at a tick depends on how many ticks lie before it, so
rows look that number up by day and add what they do, where it begins and where it ends, to the ticks'
counts: a few rows for each watch row, however many ticks there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sessionforge.operators.calendar import calendar, span
from sessionforge.sources.market import table

# Sessions on the list, days until a row that has left it is purged, kinds of levels.
WATCH_SESSIONS, PURGE_DAYS = 10, 14
LEVELS, PRICED = ("above", "below", "reclaim_20ma", "reclaim_50ma"), ("above", "below")
COUNTS = ("decremented", "expired", "purged", "skipped_no_history")


def fresh_ticks(ticks: DataFrame, ledger: DataFrame) -> DataFrame:
    """The ticks (tick_date, nth) whose date is neither in the ledger (tick_date) nor an earlier tick's; of one date the smallest nth."""
    first = ticks.groupBy("tick_date").agg(F.min("nth").alias("nth"))
    return first.join(ledger.select(F.col("tick_date").alias("_done")).distinct().hint("merge"), F.col("tick_date") == F.col("_done"), "left_anti")


def ticked(watch: DataFrame, ticks: DataFrame, ledger: DataFrame, history: DataFrame, sessions: int = WATCH_SESSIONS, purge_days: int = PURGE_DAYS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(counts of every tick, the watch rows after all ticks, the ledger).

    watch: (ticker, added, left_on, ...) with a row an entry; left_on is the date on which its owner removed it, or null.
    history: (ticker, first_bar). A tick decrements entries that are active and have a bar by then; others are
    told as skipped. An entry expires at the tick that takes its last session, and is purged, like one that was
    removed, at the first tick more than purge_days after that. A repeated date changes nothing and counts nothing.
    """
    fresh = fresh_ticks(ticks, ledger)
    order = W.orderBy("tick_date")  # a row a tick
    fresh = fresh.withColumn("i", F.row_number().over(order))
    # for each day the number of ticks before it, over the days from the first entry or tick to the last one and the purges after it
    ends = span(watch.select("added", "left_on").unionByName(fresh.select(F.col("tick_date").alias("added"), F.col("tick_date").alias("left_on"))), "added", "left_on")
    empty = ends is None
    days = calendar(watch.sparkSession, *ends).select("day") if not empty else fresh.select(F.col("tick_date").alias("day"))
    upto = W.orderBy("day").rowsBetween(W.unboundedPreceding, -1)  # a row a day
    before = days.join(fresh.select("tick_date", "i").hint("merge"), F.col("day") == F.col("tick_date"), "left").select("day", F.coalesce(F.max("i").over(upto), F.lit(0)).alias("n"))

    def seen(rows: DataFrame, key: str, name: str) -> DataFrame:
        """Adds how many ticks lie before a day."""
        return rows.join(F.broadcast(before.select(F.col("day").alias("_day"), F.col("n").alias(name))), F.col(key) == F.col("_day"), "left").drop("_day")

    first = history.groupBy(F.col("ticker").alias("_of")).agg(F.min("first_bar").alias("first_bar"))
    rows = watch.join(first.hint("merge"), F.col("ticker") == F.col("_of"), "left").drop("_of")
    last = F.lit(2**31 - 1)
    # ticks are numbered from 1: the first at which the entry is there, and the first at which it has a bar too
    rows = seen(rows, "added", "_a").withColumn("_since", F.greatest("added", "first_bar"))
    rows = seen(rows, "_since", "_b")
    rows = rows.withColumn("_gone", F.coalesce("left_on", F.lit("9999-12-31").cast("date")))
    rows = seen(rows, "left_on", "_l").withColumns({"_start": F.when(F.col("first_bar").isNull(), last).otherwise(F.coalesce(F.col("_b") + 1, last)), "_removed": F.coalesce(F.col("_l") + 1, last)})
    rows = rows.withColumns({"_expires": F.when(F.col("_start") < last, F.col("_start") + sessions - 1).otherwise(last)})
    by_number = fresh.select(F.col("i").alias("_i"), F.col("tick_date").alias("_on"))
    rows = rows.join(F.broadcast(by_number), F.when(F.col("_expires") < F.col("_removed"), F.col("_expires")) == F.col("_i"), "left")
    rows = rows.withColumn("expired_on", F.col("_on")).drop("_i", "_on")
    rows = rows.withColumn("_out", F.date_add(F.coalesce("expired_on", "left_on"), purge_days + 1))
    rows = seen(rows, "_out", "_p").withColumn("_purge", F.col("_p") + 1)
    end = F.least("_removed", F.when(F.col("expired_on").isNotNull(), F.col("_expires") + 1).otherwise(last))
    steps = F.array(
        *[F.struct(F.lit(c).alias("what"), at.alias("at"), F.lit(by).alias("by")) for c, at, by in (
            ("skipped_no_history", F.col("_a") + 1, 1), ("skipped_no_history", F.least(end, F.greatest(F.col("_a") + 1, "_start")), -1),
            ("decremented", F.least(end, "_start"), 1), ("decremented", end, -1),
        )],
        *[F.struct(F.lit(c).alias("what"), at.alias("at"), F.lit(by).alias("by")) for c, tick in (("expired", F.when(F.col("expired_on").isNotNull(), F.col("_expires"))), ("purged", F.col("_purge"))) for at, by in ((tick, 1), (tick + 1, -1))],
    )
    moved = rows.select(F.explode(steps).alias("s")).select("s.*").where("at is not null").groupBy("at").agg(*[F.sum(F.when(F.col("what") == c, F.col("by")).otherwise(0)).alias(c) for c in COUNTS])
    every = fresh.select("tick_date", "nth", "i").join(moved.hint("merge"), F.col("i") == F.col("at"), "left")
    # steps at ticks that never came lie behind all others; what is summed up to a tick is what happens there
    run = W.orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    counted = every.select("tick_date", "nth", *[F.sum(F.coalesce(F.col(c), F.lit(0))).over(run).alias(c) for c in COUNTS])
    out = ticks.join(counted.withColumnsRenamed({"tick_date": "_d", "nth": "_n"}).hint("merge"), (F.col("tick_date") == F.col("_d")) & (F.col("nth") == F.col("_n")), "left")
    counts = out.select("tick_date", "nth", F.col("_d").isNotNull().alias("ticked"), *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in COUNTS])
    n_ticks = fresh.agg(F.max("i").alias("_all"))
    rows = rows.join(F.broadcast(n_ticks))  # one row
    # an entry that outlives all ticks has used up those from its start on
    used = F.greatest(F.lit(0), F.least(F.coalesce("_all", F.lit(0)), end - 1) - F.col("_start") + 1)
    status = F.when(F.col("expired_on").isNotNull(), "expired").when(F.col("left_on").isNotNull(), "removed").otherwise("active")
    left = rows.where(F.col("_purge").isNull() | (F.col("_purge") > F.coalesce("_all", F.lit(0)))).select(*watch.columns, status.alias("status"), "expired_on", (sessions - used).cast("int").alias("sessions_left"))
    return counts, left, ledger.select("tick_date").union(fresh.select("tick_date")).distinct()


def level_problem(level_type: Column, level_value: Column) -> Column:
    """Why a level can't be taken, null if it can: prices go with above and below and are positive, and moving averages have none."""
    return (
        F.when(F.coalesce(level_type, F.lit("")) == "", F.when(level_value.isNotNull(), "level_value requires a level_type"))
        .when(~level_type.isin(*LEVELS), "unknown level_type")
        .when(level_type.isin(*PRICED), F.when(level_value.isNull() | F.isnan(level_value) | (F.abs(level_value) == float("inf")) | (level_value <= 0), "level_value must be positive"))
        .otherwise(F.when(level_value.isNotNull(), "level_value must be omitted"))
    )


def upserted(actions: DataFrame) -> DataFrame:
    """The watch rows after all actions (owner, nth, acted, action, level_type, level_value), in the order of nth.

    add makes a row, or renews one and takes the level; renew and restore set it active; remove takes it off the
    list; edit changes the level; delete makes it as if it had never been. All but add do nothing without a row,
    and an add or edit whose level can't be taken does nothing. Rows are told by sums of an owner's actions, so
    owners may have any number of them.
    """
    fine = actions.where(~F.col("action").isin("add", "edit") | level_problem(F.col("level_type"), F.col("level_value")).isNull())
    deleted = fine.where("action = 'delete'").groupBy(F.col("owner").alias("_of")).agg(F.max("nth").alias("_deleted"))
    fine = fine.join(deleted.hint("merge"), F.col("owner") == F.col("_of"), "left").where("_deleted is null or nth > _deleted")
    made = fine.where("action = 'add'").groupBy(F.col("owner").alias("_owner")).agg(F.min_by(F.struct("nth", "acted"), "nth").alias("_made"))
    fine = fine.join(made.hint("merge"), F.col("owner") == F.col("_owner")).where(F.col("nth") >= F.col("_made.nth"))
    latest = lambda what, *of: F.max_by(what, F.when(F.col("action").isin(*of), F.col("nth")))
    on, off = F.max(F.when(F.col("action").isin("add", "renew", "restore"), F.col("nth"))), F.max(F.when(F.col("action") == "remove", F.col("nth")))
    level = latest(F.struct(F.when(F.col("level_type") != "", F.col("level_type")).alias("level_type"), "level_value"), "add", "edit")
    rows = fine.groupBy("owner").agg(on.alias("on"), off.alias("off"), F.first("_made.acted").alias("created"), F.max_by("acted", "nth").alias("updated"), latest(F.col("acted"), "remove").alias("off_at"), level.alias("level"), F.count(F.when(F.col("action").isin("add", "renew", "restore"), 1)).alias("n"))
    gone = F.coalesce(F.col("off") > F.col("on"), F.lit(False))
    return rows.select("owner", F.when(gone, "removed").otherwise("active").alias("status"), "created", "updated", F.when(gone, F.col("off_at")).alias("removed"), "level.level_type", "level.level_value", (F.col("n") - 1).alias("renewals"))


#: Entries are the sign-ups of some value and more; a user's first view is the ticker's first bar.
ADDED_FROM, PURGED_TICKER_DAYS = 60, 45


def sm_watch_tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of all trading days from the first event to 45 days after the last one, each told twice, and every fifth day already in the ledger."""
    events = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), F.col("user_id").alias("ticker"), "event_type", "value", "event_id")
    watch = events.where(f"event_type = 'signup' and value >= {ADDED_FROM} and ticker is not null").select("event_id", "ticker", F.col("day").alias("added"), F.when(F.col("event_id") % 4 == 0, F.date_add("day", 5)).alias("left_on"))
    history = events.where("event_type = 'view' and value >= 20").select("ticker", F.col("day").alias("first_bar"))
    first, last = span(events, "day")
    ticks = calendar(spark, first, last).select("day").union(events.select(F.max("day").alias("m")).select(F.explode(F.expr(f"sequence(date_add(m, 1), date_add(m, {PURGED_TICKER_DAYS}))")).alias("day")))
    ticks = ticks.where("weekday(day) < 5").select(F.col("day").alias("tick_date"), F.explode(F.array(F.lit(1), F.lit(2))).alias("nth"))
    ledger = ticks.where("day(tick_date) % 5 = 0").select("tick_date").distinct()
    return ticked(watch, ticks, ledger, history)[0]


#: Events as actions of their users.
_acts = """SELECT user_id AS owner, event_id AS nth, ts AS acted, CASE WHEN event_type = 'view' AND event_id % 19 = 0 THEN 'delete' WHEN event_type = 'view' THEN 'restore' WHEN event_type = 'signup' THEN 'add' WHEN event_type = 'error' THEN 'remove' WHEN event_type = 'click' THEN 'renew' ELSE 'edit' END AS action,
  CASE event_id % 7 WHEN 0 THEN 'above' WHEN 1 THEN 'below' WHEN 2 THEN 'reclaim_20ma' WHEN 3 THEN 'reclaim_50ma' WHEN 4 THEN 'sideways' WHEN 5 THEN '' END AS level_type, CASE WHEN event_id % 7 IN (0, 1) AND event_id % 5 > 0 THEN value WHEN event_id % 11 = 0 THEN value END AS level_value FROM events WHERE user_id IS NOT NULL"""


def sm_watch_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's watch row after all events as actions; views restore or, some of them, delete, and purchases edit."""
    rows = upserted(spark.sql(_acts.replace("events", "{events}"), events=table(spark, sf_dir, "events")))
    shown = [F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) for c in ("created", "updated", "removed")]
    return rows.select("owner", "status", *shown, "level_type", "level_value", "renewals")


FUNCTIONS = {f.__name__: f for f in (sm_watch_tick, sm_watch_upsert)}
_moments = ", ".join(f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f') AS {c}" for c in ("created", "updated", "removed"))
SQL = {
    "sm_watch_tick": f"""WITH w AS (SELECT event_id, user_id AS ticker, CAST(ts AS DATE) AS added, CASE WHEN event_id % 4 = 0 THEN CAST(ts AS DATE) + 5 END AS left_on FROM events WHERE event_type = 'signup' AND value >= {ADDED_FROM} AND user_id IS NOT NULL),
h AS (SELECT user_id AS ticker, min(CAST(ts AS DATE)) AS first_bar FROM events WHERE event_type = 'view' AND value >= 20 GROUP BY 1),
d AS (SELECT CAST(unnest(generate_series((SELECT min(CAST(ts AS DATE)) FROM events), (SELECT max(CAST(ts AS DATE)) FROM events) + {PURGED_TICKER_DAYS}, INTERVAL 1 DAY)) AS DATE) AS day),
t AS (SELECT day FROM d WHERE isodow(day) < 6 AND day(day) % 5 <> 0),
-- a row for each entry and tick from its adding on, with the sessions that the entry has used by then
g AS (SELECT w.*, t.day, first_bar IS NOT NULL AND first_bar <= t.day AS has_bar, sum(CASE WHEN first_bar <= t.day THEN 1 ELSE 0 END) OVER (PARTITION BY event_id ORDER BY t.day) AS used FROM w LEFT JOIN h USING (ticker) JOIN t ON t.day >= added),
e AS (SELECT event_id, min(day) FILTER (has_bar AND used = {WATCH_SESSIONS} AND (left_on IS NULL OR day < left_on)) AS expired_on FROM g GROUP BY event_id),
o AS (SELECT event_id, expired_on, coalesce(expired_on, left_on) AS out_on FROM e JOIN w USING (event_id)),
p AS (SELECT event_id, min(t.day) AS purged_on FROM o JOIN t ON t.day > out_on + {PURGE_DAYS} GROUP BY event_id),
c AS (SELECT g.day, count(*) FILTER (has_bar AND (left_on IS NULL OR g.day < left_on) AND (expired_on IS NULL OR g.day <= expired_on)) AS decremented, count(*) FILTER (NOT has_bar AND (left_on IS NULL OR g.day < left_on)) AS skipped_no_history FROM g JOIN o USING (event_id) GROUP BY g.day)
SELECT d.day AS tick_date, CAST(nth AS INT) AS nth, nth = 1 AND day(d.day) % 5 <> 0 AS ticked, CASE WHEN nth = 1 THEN coalesce(c.decremented, 0) ELSE 0 END AS decremented, CASE WHEN nth = 1 THEN (SELECT count(*) FROM o WHERE expired_on = d.day) ELSE 0 END AS expired,
  CASE WHEN nth = 1 THEN (SELECT count(*) FROM p WHERE purged_on = d.day) ELSE 0 END AS purged, CASE WHEN nth = 1 THEN coalesce(c.skipped_no_history, 0) ELSE 0 END AS skipped_no_history
FROM d CROSS JOIN (VALUES (1), (2)) n(nth) LEFT JOIN c ON c.day = d.day WHERE isodow(d.day) < 6""",
    "sm_watch_upsert": f"""WITH RECURSIVE acts AS ({_acts}),
fine AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY nth) AS k FROM acts WHERE action NOT IN ('add', 'edit') OR CASE WHEN level_type IN ('above', 'below') THEN coalesce(level_value > 0, false) WHEN level_type IN ('reclaim_20ma', 'reclaim_50ma') THEN level_value IS NULL WHEN coalesce(level_type, '') = '' THEN level_value IS NULL ELSE false END),
f(owner, k, status, created, updated, removed, level_type, level_value, renewals) AS (SELECT DISTINCT owner, CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS TIMESTAMP), CAST(NULL AS TIMESTAMP), CAST(NULL AS TIMESTAMP), CAST(NULL AS VARCHAR), CAST(NULL AS DOUBLE), CAST(0 AS BIGINT) FROM fine
UNION ALL SELECT f.owner, a.k, CASE WHEN action = 'delete' THEN NULL WHEN action = 'add' THEN 'active' WHEN status IS NULL THEN NULL WHEN action IN ('renew', 'restore') THEN 'active' WHEN action = 'remove' THEN 'removed' ELSE status END,
  CASE WHEN status IS NULL AND action = 'add' THEN acted ELSE created END, CASE WHEN status IS NOT NULL OR action = 'add' THEN acted END, CASE WHEN action IN ('add', 'renew', 'restore', 'delete') THEN NULL WHEN action = 'remove' AND status IS NOT NULL THEN acted ELSE removed END,
  CASE WHEN action = 'add' OR action = 'edit' AND status IS NOT NULL THEN nullif(a.level_type, '') WHEN action = 'delete' THEN NULL ELSE f.level_type END, CASE WHEN action = 'add' OR action = 'edit' AND status IS NOT NULL THEN a.level_value WHEN action = 'delete' THEN NULL ELSE f.level_value END,
  CASE WHEN status IS NULL THEN 0 WHEN action IN ('add', 'renew', 'restore') THEN renewals + 1 ELSE renewals END
FROM f JOIN fine a ON a.owner = f.owner AND a.k = f.k + 1)
SELECT owner, status, {_moments}, level_type, level_value, renewals FROM f WHERE status IS NOT NULL AND (owner, k) IN (SELECT (owner, max(k)) FROM fine GROUP BY owner)""",
}
