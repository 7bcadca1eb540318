"""Mixing sources to target weights by drawing fixed-length blocks of tokens.

The words of a source, in the order of doc_id, are one long sequence cut into blocks of `block_words`.
The mix is a row of slots in shards of `shard_slots`; each shard draws its slots' sources from the
target weights, so its counts are multinomial. Slots that a source drew beyond its quota (the target
in blocks) go to the sources that drew too few, so that totals meet the targets to within a block and
nothing is drawn more than twice. The j-th slot of a source takes the block that a pseudorandom
permutation of the block indexes, a new one for every pass, gives for j; blocks are joined by index.

Sizes are words, 0 for null and empty texts, whose rows are returned with nothing taken. A null source
is a source of its own, the last one. Rows with the same doc_id are ordered by text hash; repeated
rows are taken each on its own. A text of any length is spread over as many blocks as it fills. A source
without words has target 0. An empty table gives no rows. The table of sources, a row for each, is
ordered in one task. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sessionforge.llm.common import BROADCAST_ROWS, n_words, positions, saved, words_of

BLOCK_WORDS, SHARD_SLOTS, SEED = 64, 8192, 17
#: Weights by turn, the mix's size in times all sizes, and the most times of a source's size.
WEIGHTS, BUDGET, MOST = (5, 2, 1), 1.5, 2
#: Cells of the unit interval by which draws find their source; rounds of a permutation.
CELLS, ROUNDS = 1024, 8


def targets(sizes: DataFrame) -> DataFrame:
    """Adds sidx and target to sizes (source, source_size): weight shares of the budget, filled up to MOST times the size.

    Sources fill up in the order of size by weight. With the first k full, the others share what is
    left at a common level; the first level that the next source can hold is the one.
    """
    by_name = W.orderBy(F.asc_nulls_last("source"))
    turn = (F.row_number().over(by_name) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (turn + 1).cast("int"))
    s = sizes.withColumn("sidx", F.row_number().over(by_name) - 1).withColumn("weight", weight).withColumn("most", F.col("source_size") * MOST)
    full = W.orderBy(F.col("most") / F.col("weight"), "sidx")
    s = s.withColumn("left", F.sum("source_size").over(W.partitionBy()) * BUDGET - F.coalesce(F.sum("most").over(full.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("level", F.col("left") / F.sum("weight").over(full.rowsBetween(W.currentRow, W.unboundedFollowing)))
    level = F.min(F.when(F.col("level") <= F.col("most") / F.col("weight"), F.struct(F.col("most") / F.col("weight"), "sidx", "level"))).over(W.partitionBy())["level"]
    return s.withColumn("target", F.least(F.col("most").cast("double"), level * F.col("weight"))).select("source", "sidx", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"))


def permuted(i: Column, n: Column, *key: Column) -> Column:
    """Where a pseudorandom permutation of 0..n-1, picked by key, puts i: rounds of swap-or-not, one to one on any n.

    A round pairs x with k - x and swaps the two if a hash of the pair says so.
    """

    def turn(x: Column, r: Column) -> Column:
        y = F.pmod(F.pmod(F.xxhash64(*key, r), n) - x, n)
        return F.when(F.xxhash64(F.greatest(x, y), *key, r) % 2 == 0, y).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), i.cast("long"), turn)


def small(df: DataFrame, n_rows: int) -> DataFrame:
    """Broadcast only up to BROADCAST_ROWS rows."""
    return df.hint("broadcast" if n_rows <= BROADCAST_ROWS else "merge")


def draws(sources: DataFrame, n_sources: int, n_slots: int) -> DataFrame:
    """(sidx, n_blocks, slot, j): each slot of the mix with its source and its number among the source's slots."""
    spark = sources.sparkSession
    upto = F.sum("quota").over(W.orderBy("sidx"))
    bounds = sources.where("quota > 0").select("sidx", "quota", "n_blocks", (upto - F.col("quota")).alias("lo"), upto.alias("hi"))
    cell = lambda c: F.floor(c * CELLS / n_slots)
    cells = bounds.select("sidx", "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi") - 1))).alias("cell"))
    u = F.pmod(F.xxhash64(F.lit(SEED), F.floor(F.col("slot") / SHARD_SLOTS), F.col("slot") % SHARD_SLOTS), F.lit(n_slots))
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), F.floor(F.col("id") / SHARD_SLOTS).alias("shard")).withColumn("u", u)
    drawn = slots.join(small(cells, n_sources + CELLS), (cell(F.col("u")) == F.col("cell")) & (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("slot", "shard", "sidx")
    drawn = saved(drawn.withColumn("n", F.row_number().over(W.partitionBy("shard", "sidx").orderBy("slot"))))
    counts = saved(positions(drawn.groupBy("shard", "sidx").agg(F.count("*").alias("n_drawn")), ["sidx"], ["shard"], weight="n_drawn", name="before"))
    totals = counts.groupBy(F.col("sidx").alias("t")).agg(F.sum("n_drawn").alias("total"))
    b = bounds.join(totals.hint("merge"), F.col("sidx") == F.col("t"), "left").select("sidx", "quota", "n_blocks", F.coalesce("total", F.lit(0)).alias("total"))
    before = W.orderBy("sidx").rowsBetween(W.unboundedPreceding, -1)
    over, under = F.greatest(F.lit(0), F.col("total") - F.col("quota")), F.greatest(F.lit(0), F.col("quota") - F.col("total"))
    b = saved(b.withColumn("over_at", F.coalesce(F.sum(over).over(before), F.lit(0))).withColumn("under_at", F.coalesce(F.sum(under).over(before), F.lit(0))))
    one = b.select(F.col("sidx").alias("s"), "quota", "n_blocks", "over_at")
    placed = drawn.join(counts.select(F.col("shard").alias("sh"), F.col("sidx").alias("si"), "before").hint("merge"), (F.col("shard") == F.col("sh")) & (F.col("sidx") == F.col("si")))
    placed = placed.join(small(one, n_sources), F.col("sidx") == F.col("s")).select("slot", "sidx", "n_blocks", "quota", "over_at", (F.col("before") + F.col("n") - 1).alias("j"))
    fine = placed.where("j < quota").select("slot", "sidx", "n_blocks", "j")
    spare = placed.where("j >= quota").select("slot", (F.col("over_at") + F.col("j") - F.col("quota")).alias("k"))
    lack = b.where(F.col("quota") > F.col("total")).select("sidx", "n_blocks", "total", "under_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("quota") - F.col("total") - 1)).alias("e"))
    lack = lack.select("sidx", "n_blocks", (F.col("under_at") + F.col("e")).alias("k2"), (F.col("total") + F.col("e")).alias("j"))
    return fine.union(spare.join(lack.hint("merge"), F.col("k") == F.col("k2")).select("slot", "sidx", "n_blocks", "j"))


def mixed_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, th, source, size, source_size, target, start, block, from_word, n_words, copies): a row for each document and block it is in.

    copies is how often the mix takes the block. Documents without words have one row with null block.
    """
    rows = saved(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("th")))
    sizes = saved(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))).withColumn("n_blocks", F.ceil(F.col("source_size") / BLOCK_WORDS)).withColumn("quota", F.when(F.col("source_size") > 0, F.least(F.col("n_blocks") * MOST, F.round(F.col("target") * F.col("n_blocks") / F.col("source_size")).cast("long"))).otherwise(0)))
    head = sizes.agg(F.count("*").alias("n"), F.coalesce(F.sum("quota"), F.lit(0)).alias("slots")).collect()[0]
    at = positions(rows, ["source"], ["doc_id", "th"], weight="size", name="start")
    named = sizes.select(F.col("source").alias("src"), "sidx", "source_size", "target")
    at = at.join(small(named, head["n"]), at["source"].eqNullSafe(F.col("src"))).drop("src")
    first, last = F.floor(F.col("start") / BLOCK_WORDS), F.floor((F.col("start") + F.col("size") - 1) / BLOCK_WORDS)
    spread = at.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
    lo = F.greatest("start", F.col("block") * BLOCK_WORDS)
    spread = spread.withColumns({"from_word": lo - F.col("start"), "n_words": F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * BLOCK_WORDS) - lo})
    if head["slots"]:
        d = draws(sizes, head["n"], head["slots"])
        block = permuted(F.col("j") % F.col("n_blocks"), F.col("n_blocks"), F.col("sidx"), F.floor(F.col("j") / F.col("n_blocks")))
        taken = d.select("sidx", block.alias("b")).groupBy(F.col("sidx").alias("s"), "b").agg(F.count("*").alias("copies"))
        spread = spread.join(taken.hint("merge"), (F.col("sidx") == F.col("s")) & (F.col("block") == F.col("b")), "left").drop("s", "b")
    else:
        spread = spread.withColumn("copies", F.lit(None).cast("long"))
    return spread.withColumn("copies", F.coalesce("copies", F.lit(0)))


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of docs (doc_id, text, source)."""
    per = mixed_blocks(docs).groupBy("sidx", "start", "doc_id", "th", "size", "source_size", "target", F.when(F.col("size") == 0, F.monotonically_increasing_id()).alias("empty"))
    return per.agg(F.coalesce(F.sum(F.col("n_words") * F.col("copies")), F.lit(0)).alias("taken")).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents with the columns of docs: the words that it takes of each, once over and then those taken twice.

    A document that is taken whole keeps its text as it is; of others the taken words stand with
    blanks between. Documents of which nothing is taken are not in the mix. n_chars is counted anew.
    """
    per = mixed_blocks(docs).where("copies > 0").groupBy("sidx", "start", "doc_id", "th", "source", "size")
    per = per.agg(F.sort_array(F.collect_list(F.struct("block", "from_word", "n_words", "copies"))).alias("parts"))
    held = per.select(F.col("doc_id").alias("of"), F.col("th").alias("h"), F.col("source").alias("src"), "size", "parts", F.row_number().over(W.partitionBy("doc_id", "th", "source").orderBy("start")).alias("nth"))
    # the row travels as one struct, so that none of its columns meets a name used here
    texts = docs.select(F.struct(*docs.columns).alias("_row"), F.xxhash64("text").alias("_th"))
    texts = texts.withColumn("_nth", F.row_number().over(W.partitionBy("_row.doc_id", "_th", "_row.source").orderBy(F.lit(0))))
    out = texts.join(held.hint("merge"), F.col("_row.doc_id").eqNullSafe(F.col("of")) & (F.col("_th") == F.col("h")) & F.col("_row.source").eqNullSafe(F.col("src")) & (F.col("_nth") == F.col("nth")))

    def copy(words: Column, c: int) -> Column:
        chosen = F.filter("parts", lambda p: p["copies"] > c)
        n = F.aggregate(chosen, F.lit(0).cast("long"), lambda s, p: s + p["n_words"])
        cut = F.array_join(F.flatten(F.transform(chosen, lambda p: F.slice(words, (p["from_word"] + 1).cast("int"), p["n_words"].cast("int")))), " ")
        return F.when(n == F.col("size"), F.col("_row.text")).when(n > 0, cut)

    # the words are bound once: an expression inside a lambda would split the text again for each part
    out = out.withColumn("_text", F.transform(F.array(words_of(F.col("_row.text"))), lambda w: F.concat_ws("\n", copy(w, 0), copy(w, 1)))[0])
    return out.select(*[(F.col("_text") if c == "text" else F.length("_text").cast("long") if c == "n_chars" else F.col("_row")[c]).alias(c) for c in docs.columns])
