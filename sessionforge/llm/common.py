"""Shared building blocks: checkpoints, distributed positions, components, words."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

#: A word is a maximal run of characters other than blank, tab and the line breaks 0x0A-0x0D.
WORD_BREAK = "[\\x20\\x09-\\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder of checkpoints, that `spark.checkpoint.dir` names.

    Where a session on one machine names none, as in tests, a temporary folder is set; on a cluster
    that would lie on one machine, so it is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def saved(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a table in the shared folder.

    A checkpoint would hand on what is known of its columns' values to the next plan, which in a loop
    of joins doubles from round to round.
    """
    at = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def n_shuffled(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Words of a text; 0 for null. The pieces around breaks, less the empty first and last ones."""
    pieces = F.split(F.coalesce(text, F.lit("")), WORD_BREAK)
    return (F.size(pieces) - (F.element_at(pieces, 1) == "").cast("int") - ((F.size(pieces) > 1) & (F.element_at(pieces, -1) == "")).cast("int")).cast("long")


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")


#: Rows up to which a table is broadcast.
BROADCAST_ROWS = 50_000


def positions(df: DataFrame, group: list[str], order: list[str], weight: str | None = None, name: str = "position") -> DataFrame:
    """Adds for each row the number (or sum of `weight`) of the rows before it in its group.

    Groups may be of any size: rows are dealt in ranges of (group, order), ranges count on their own,
    and the few sums of (range, group) give each range its start. Without a weight the place in the
    sorted range is the count, so rows are shuffled once; with one they are dealt a second time, one
    range a task. Rows that tie in `order` must be alike or told apart by `order`.
    """
    spark, keys = df.sparkSession, [*group, *order]
    ranged = df.repartitionByRange(*keys)
    if weight is None:
        # the id is partition * 2^33 + place in it
        held = saved(ranged.sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id()))
        held = held.withColumns({"_range": F.shiftright("_id", 33), "_place": F.col("_id").bitwiseAND(2**33 - 1)})
        sums = held.groupBy("_range", *group).agg(F.count("*").alias("_sum"), F.min("_place").alias("_first"))
        inner, inside = held, F.col("_place") - F.col("_from")
    else:
        held = saved(ranged.withColumn("_range", F.spark_partition_id().cast("long")))
        sums = held.groupBy("_range", *group).agg(F.sum(weight).alias("_sum"), F.lit(0).alias("_first"))
        upto = W.partitionBy("_range", *group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
        inner = held.repartitionById(n_shuffled(spark), F.col("_range").cast("int")).withColumn("_in", F.coalesce(F.sum(weight).over(upto), F.lit(0)))
        inside = F.col("_in")
    before = W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = saved(sums.withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0))))
    small = starts.count() <= BROADCAST_ROWS
    starts = starts.select(F.col("_range").alias("_of"), *[F.col(g).alias(f"_of_{g}") for g in group], "_start", F.col("_first").alias("_from"))
    on = inner["_range"] == F.col("_of")
    for g in group:
        on = on & inner[g].eqNullSafe(F.col(f"_of_{g}"))
    out = inner.join(starts.hint("broadcast" if small else "shuffle_hash"), on, "left")
    return out.select(*[inner[c] for c in df.columns], (inside + F.col("_start")).cast("long").alias(name))


#: Most keys that count as hot: those that hold more than a HOT_KEYS-th of all rows, and HOT_ROWS at least.
HOT_KEYS, HOT_ROWS = 20_000, 1_000


def with_facts(rows: DataFrame, facts: DataFrame, keys: list[str], n: str, columns: list[str], total: int | None = None) -> DataFrame:
    """rows left-joined to facts on keys: adds `columns` of facts, null where there are none.

    facts has one row a key; its column n says how many rows have the key. There are at most HOT_KEYS
    keys with more than a HOT_KEYS-th of all rows: these are broadcast, and their rows dealt at random
    by a salt, so that no key gathers in one task. Rows whose key is null find nothing. facts should
    be cheap to read twice; total is the sum of n, if it is known.
    """
    if total is None:
        total = facts.agg(F.coalesce(F.sum(n), F.lit(0)).alias("t")).collect()[0]["t"]
    is_hot = F.col(n) > max(HOT_ROWS, total // HOT_KEYS)
    renamed = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    hot = facts.where(is_hot).select(*renamed, F.struct(*columns).alias("_hot"))
    cold = facts.where(~is_hot).select(*renamed, F.struct(*columns).alias("_cold"), F.lit(0).cast("long").alias("_zero"))
    of = [f"_k{i}" for i in range(len(keys))]

    def on(left: DataFrame) -> Column:
        out = left[keys[0]] == F.col(of[0])
        for k, o in zip(keys[1:], of[1:], strict=True):
            out = out & (left[k] == F.col(o))
        return out

    names = rows.columns
    found = rows.join(F.broadcast(hot), on(rows), "left").drop(*of)
    lost = F.col("_hot").isNotNull()
    for k in keys:
        lost = lost | F.col(k).isNull()
    found = found.withColumn("_salt", F.when(lost, F.xxhash64(*names)).otherwise(F.lit(0).cast("long")))
    found = found.join(cold.hint("merge"), on(found) & (found["_salt"] == F.col("_zero")), "left")
    one = F.coalesce("_hot", "_cold")
    return found.withColumn("_fact", one).select(*names, *[F.col("_fact")[c].alias(c) for c in columns])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of `edges` (a, b): rows (v, root), root the smallest vertex of the component.

    Every round takes the smallest label of the neighbours and then follows the label's own label
    (pointer jumping), so rounds grow with the logarithm of the longest path; they go on until no label
    changes. Vertices with many neighbours and roots with many members are joined as hot keys. Nothing
    but counts reaches the driver.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct())
    # every edge stands there both ways, so a vertex is as often b as it is a
    labels = written(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m"), F.count("*").alias("degree")).select("v", "degree", F.least("v", "m").alias("root")))
    n_edges, n_vertices = both.count(), labels.count()
    while True:
        near = with_facts(both, labels.withColumnRenamed("v", "b"), ["b"], "degree", ["root"], n_edges).groupBy("a").agg(F.min("root").alias("m"))
        step = labels.join(near.hint("merge"), labels["v"] == near["a"])
        step = written(step.select("v", "degree", F.col("root").alias("was"), F.least("root", "m").alias("root")))
        up = step.groupBy(F.col("root").alias("r")).agg(F.count("*").alias("n"))
        up = up.join(step.select("v", F.col("root").alias("up")).hint("merge"), F.col("r") == F.col("v")).select(F.col("r").alias("root"), "n", "up")
        step = written(with_facts(step, up, ["root"], "n", ["up"], n_vertices).select("v", "degree", "was", F.least("root", F.coalesce("up", "root")).alias("root")))
        labels = step.select("v", "degree", "root")
        if step.where("root <> was").isEmpty():
            return labels.select("v", "root")


def forest(a, b):
    """Of links (a[i], b[i]) between whole numbers, the links (vertex, smallest vertex of its component)."""
    import numpy as np

    names, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = index[: len(a)], index[len(a) :]
    root = np.arange(len(names))
    while True:
        low = root.copy()
        np.minimum.at(low, x, root[y])
        np.minimum.at(low, y, root[x])
        low = low[low]
        if (low == root).all():
            break
        root = low
    moved = root != np.arange(len(names))
    return names[moved], names[root[moved]]


LONG = T.LongType()
