"""Structured Streaming forms of the quote pipeline, each run over all there is and then read back.

The source is the folder with the events files; results go to Parquet in the shared folder that
`spark.checkpoint.dir` names, next to the query's own checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sessionforge.operators.calendar import DAYS
from sessionforge.operators.stocks import STATUS
from sessionforge.operators.trades import fold_sql, settings_sql
from sessionforge.plans.registry import RELATIONS, Query, r
from sessionforge.sources.market import shared_folder, table
from sessionforge.streaming.keyed import FAST, SLOW, positions, watch_sql, watch_ttl


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of quotes: (event_id, ts, ticker, kind, price)."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    return stream.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("ticker"), F.col("event_type").alias("kind"), F.col("value").alias("price"))


def finished(stream: DataFrame, spark: SparkSession) -> DataFrame:
    """Runs a stream in append mode over all there is; the rows it wrote."""
    at = shared_folder(spark)
    stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def session_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day bars of quotes, a day's row once the watermark of one day has passed its end."""
    q = quotes(spark, sf_dir).withWatermark("ts", "1 day")
    bars = q.groupBy(F.window("ts", "1 day").alias("day"), "ticker").agg(F.min_by("price", F.struct("ts", "event_id")).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", F.struct("ts", "event_id")).alias("close"))
    done = finished(bars, spark)
    return done.select(F.to_date("day.start").alias("bar_date"), "ticker", "open", "high", "low", "close")


SESSION_BARS_SQL = """SELECT CAST(ts AS DATE) AS bar_date, user_id AS ticker, min_by(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low, max_by(value, row(ts, event_id)) AS close
FROM events GROUP BY 1, 2 HAVING CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY"""


def quote_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last quote of each (ticker, kind): every batch is reduced to its last quotes and merged by rank when read."""
    at = shared_folder(spark)
    latest = W.partitionBy("ticker", "kind").orderBy(F.desc("ts"), F.desc("event_id"))

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("n", F.row_number().over(latest)).where("n = 1").drop("n").write.mode("overwrite").parquet(f"{at}/out/batch={batch_id}")

    stream = quotes(spark, sf_dir)
    stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    spark.createDataFrame([], stream.schema).write.mode("append").parquet(f"{at}/out/batch=none")  # there is a folder even if no quote came
    seen = spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(f"{at}/out")
    return seen.withColumn("n", F.row_number().over(latest)).where("n = 1").select("ticker", "kind", "event_id")


QUOTE_INGEST_SQL = "SELECT user_id AS ticker, event_type AS kind, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS nth FROM events) t WHERE nth = 1"


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each quote on the ladder of pick statuses: the stream joined with its ticker's last bar; the quote is the read's open, high, low and close."""
    stock = RELATIONS["stock"](spark, sf_dir)
    last = stock.groupBy(F.col("ticker").alias("t")).agg(F.max_by(F.struct("high", "low", "ma20", "ma50"), "sidx").alias("b"))
    last = last.select("t", F.col("b.high").alias("prior_high"), F.col("b.low").alias("prior_low"), F.col("b.ma20").alias("ma20"), F.col("b.ma50").alias("ma50"))
    q = quotes(spark, sf_dir).join(last.hint("merge"), F.col("ticker") == F.col("t"), "left")
    q = q.withColumns({c: F.col("price") * QUOTE_SCALE for c in ("open", "high", "low", "close")})
    return finished(q.select("event_id", F.expr(STATUS).alias("status")), spark)


#: What a quote's price is multiplied by to stand beside the bars.
QUOTE_SCALE = 20.0
STATUS_SQL = Query(
    "ss_status",
    f"""WITH l AS (SELECT ticker AS t, max_by(high, sidx) AS h, max_by(low, sidx) AS l, max_by(close / nullif(1 + sma20_pct / 100, 0), sidx) AS m20, max_by(close / nullif(1 + sma50_pct / 100, 0), sidx) AS m50 FROM {{bars}} GROUP BY 1),
q AS (SELECT event_id, value * {QUOTE_SCALE} AS p, h, l, m20, m50 FROM events LEFT JOIN l ON t = user_id)
SELECT event_id, CASE WHEN h IS NULL OR p IS NULL THEN 'no_quote' WHEN p <= l THEN 'invalidated' WHEN p > h THEN 'gapped_through' WHEN p = h THEN 'triggered' WHEN p > m20 AND l < m20 OR p > m50 AND l < m50 THEN 'reclaim' ELSE 'setting_up' END AS status FROM q""",
).sql()


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One alert for each ticker, kind and day, however often a quote gives rise to it; keys are kept for a week."""
    q = quotes(spark, sf_dir).withWatermark("ts", "7 days").select("ts", "ticker", "kind", F.to_date("ts").alias("alert_date"))
    return finished(q.dropDuplicatesWithinWatermark(["ticker", "kind", "alert_date"]).select("ticker", "kind", "alert_date"), spark)


ALERTS_SQL = "SELECT DISTINCT user_id AS ticker, event_type AS kind, CAST(ts AS DATE) AS alert_date FROM events"

WATCH_TTL_SQL = watch_sql(DAYS)

_days = """d AS (SELECT user_id AS ticker, CAST(CAST(ts AS DATE) - DATE '1970-01-01' AS INT) AS sidx, min_by(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low, max_by(value, row(ts, event_id)) AS close FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2), """
_day_bars = f"""SELECT ticker, sidx, open, high, low, close, lag(close) OVER w AS prev_close, avg(high - low) OVER (PARTITION BY ticker ORDER BY sidx ROWS {SLOW - 1} PRECEDING) AS atr, avg(close) OVER (PARTITION BY ticker ORDER BY sidx ROWS {FAST - 1} PRECEDING) AS ma20,
  avg(close) OVER (PARTITION BY ticker ORDER BY sidx ROWS {SLOW - 1} PRECEDING) AS ma50, CAST(NULL AS INT) AS earnings_in FROM d WINDOW w AS (PARTITION BY ticker ORDER BY sidx)"""
_opened = f"SELECT ticker, sidx AS opened, close AS entry, low AS first_stop, {settings_sql()} FROM d QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY sidx) = 1"
POSITIONS_SQL = f"""SELECT f.ticker, state, {r('entry')}, stop, floor, basis, caution, qty, exit_price, exit_reason, advanced FROM ({fold_sql(_opened, _day_bars, 10_000, _days)}) f
JOIN (SELECT user_id AS ticker, max_by(value, row(ts, event_id)) AS entry FROM (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE)) AS nth FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL) e WHERE nth = 1 GROUP BY 1) o ON o.ticker = f.ticker"""
