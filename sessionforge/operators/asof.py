"""As-of joins: for each row the last one of another table up to its time.

The answer depends on keys and time only, so distinct points are looked up, and rows take what their point
found by an equality. Points and the other table's rows are sorted together in buckets of time, each of
which begins with what the buckets before it leave; so a key with very many rows is as many windows as it
has buckets, and nothing is joined by a range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sessionforge.operators.stocks import CHAT, PRICES
from sessionforge.plans.registry import Query
from sessionforge.sources.market import table


def as_of(left: DataFrame, right: DataFrame, by: list[str], time: str, columns: list[str], width: int, tolerance: int | None = None) -> DataFrame:
    """left with `columns` of the last row of right with the same keys `by` up to `time`, null where there is none.

    time is a whole number in both, width the span of a bucket. With a tolerance, what is older than that isn't
    found. Of rows of right at one time the greatest by columns counts. Rows without a key or time find nothing.
    """
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*by, time)])
    named = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
    keys = [f"_k{i}" for i in range(len(by))]
    bucket = F.floor(F.col("_t") / width).alias("_b")
    rows = right.where(whole).select(*named, F.col(time).cast("long").alias("_t"), F.struct(F.col(time).cast("long").alias("t"), *columns).alias("_v")).select("*", bucket)
    points = left.where(whole).select(*named, F.col(time).cast("long").alias("_t")).distinct().select("*", bucket)
    # what each bucket with points is handed: the last value of an earlier bucket of its key; a row a key and bucket
    ends = rows.groupBy(*keys, "_b").agg(F.max("_v").alias("_last")).unionByName(points.select(*keys, "_b").distinct().withColumn("_last", F.lit(None).cast(rows.schema["_v"].dataType)))
    ends = ends.groupBy(*keys, "_b").agg(F.max("_last").alias("_last"))
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    handed = ends.withColumn("_v", F.last("_last", ignorenulls=True).over(before)).where("_v is not null").select(*keys, F.col("_v.t").alias("_t"), "_v", "_b")
    together = rows.unionByName(handed).withColumn("_point", F.lit(0)).unionByName(points.withColumns({"_v": F.lit(None).cast(rows.schema["_v"].dataType), "_point": F.lit(1)}))
    upto = W.partitionBy(*keys, "_b").orderBy("_t", "_point", "_v").rowsBetween(W.unboundedPreceding, 0)
    found = together.withColumn("_found", F.last("_v", ignorenulls=True).over(upto)).where("_point = 1")
    if tolerance is not None:
        found = found.withColumn("_found", F.when(F.col("_t") - F.col("_found.t") <= tolerance, F.col("_found")))
    same = reduce(lambda a, b: a & b, [F.col(c) == F.col(k) for c, k in zip(by, keys, strict=True)], F.col(time) == F.col("_t"))
    out = left.join(found.where("_found is not null").select(*keys, "_t", "_found").hint("merge"), same, "left")
    return out.select(*left.columns, *[F.col("_found")[c].alias(c) for c in columns])


def jn_asof_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn with its model's price as it was then; before the first price that one, and whether the model is known at all."""
    chat = Query("chat", CHAT).run(spark, sf_dir).select("conv_id", "turn", "model")
    prices = spark.sql(f"SELECT model, from_turn, per_in FROM {PRICES}")
    first = prices.groupBy(F.col("model").alias("_of")).agg(F.min_by("per_in", "from_turn").alias("_first"))
    rows = as_of(chat, prices.withColumnRenamed("from_turn", "turn"), ["model"], "turn", ["per_in"], 64)
    rows = rows.join(F.broadcast(first), F.col("model") == F.col("_of"), "left")  # a row a model of the price list
    return rows.select("conv_id", "turn", "model", F.coalesce("per_in", "_first").alias("per_in"), F.col("_of").isNull().alias("unknown_model"))


def jn_asof_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with the nearest earlier day of the same user within five days before the day before."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.to_date("ts").alias("day"))
    seen = events.select("user_id", "day", F.unix_date("day").alias("before")).distinct().withColumnRenamed("day", "nearest")
    rows = as_of(events.withColumn("before", F.unix_date("day") - 1), seen, ["user_id"], "before", ["nearest"], 30, tolerance=5)
    return rows.select("event_id", "nearest")


FUNCTIONS = {f.__name__: f for f in (jn_asof_price, jn_asof_tolerance)}
#: The same by ranges.
SQL = {
    "jn_asof_price": Query("jn_asof_price", f"WITH c AS ({CHAT}), f AS (SELECT model, min_by(per_in, from_turn) AS first_in FROM {PRICES} GROUP BY model), a AS (SELECT c.conv_id, c.turn, c.model, max_by(v.per_in, v.from_turn) AS per_in FROM c LEFT JOIN {PRICES} ON v.model = c.model AND v.from_turn <= c.turn GROUP BY c.conv_id, c.turn, c.model) SELECT a.conv_id, a.turn, a.model, coalesce(a.per_in, f.first_in) AS per_in, f.model IS NULL AS unknown_model FROM a LEFT JOIN f ON f.model = a.model").sql(),
    "jn_asof_tolerance": Query("jn_asof_tolerance", "WITH a AS (SELECT DISTINCT user_id AS u, day(ts) AS d FROM {events}) SELECT e.event_id, max(a.d) AS nearest FROM {events} e LEFT JOIN a ON a.u = e.user_id AND a.d <= day(e.ts - INTERVAL '24' HOUR) AND a.d >= day(e.ts - INTERVAL '144' HOUR) GROUP BY e.event_id").sql(),
}
