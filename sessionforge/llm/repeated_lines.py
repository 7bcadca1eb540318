"""Line dedup by prefix doubling over line-ID sequences.

All texts are one long sequence of line IDs with a break between documents. Prefix doubling names
the runs of 1, 2, 4, ... lines that start at each position, the name of a run of 2n lines being made
from the names of its two halves; runs that occur once drop out at once. A name stands for an interval
of the suffix array, the suffixes that begin with this run, and is given as the first position in it;
so the array need not be laid out in one order to have its longest-common-prefix intervals.

A repeated run counts if it has `min_words` words. Each such run is made up of its least windows:
from each line on, and up to each line, the fewest lines that have the words. A window of m lines is
named by the names of the two runs of 2^k <= m lines at its ends; the windows of one name are an
interval of suffixes with a common prefix of m lines. All but the first window of an interval are
later copies, and their lines go. Chained windows make up the maximal repeated runs, so a line
goes just if it lies in a run of min_words words that also starts at an earlier position.

Positions are ordered by doc_id and line, so the first copy is that of the smallest doc_id; a run that
repeats inside one document loses its later copies too. Lines are what stands between line feeds,
compared as written. Null texts have no lines and stay null; empty texts are one empty line. Rows with
the same doc_id are ordered by text hash; a repeated row (same doc_id and text) counts as one document
and both rows get the same result. Null doc_ids come first. A text may have any number of lines; it is
rebuilt in one pass. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sessionforge.llm.common import n_words, positions, saved, with_facts

MIN_WORDS = 50


def line_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, th, line, x, y, words): every line of every distinct (doc_id, text), its two hashes and its words."""
    text = docs.where("text is not null").select("doc_id", "text", F.xxhash64("text").alias("th"))
    lines = text.select("doc_id", "th", F.posexplode(F.split("text", "\n", -1)).alias("line", "value"))
    return lines.select("doc_id", "th", "line", F.xxhash64("value").alias("x"), F.hash("value").alias("y"), n_words(F.col("value")).cast("int").alias("words"))


def repeated(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, th, line, words, x, y, doc, pos, seg, upto): lines that occur more than once, in stretches of min_words words.

    seg numbers the stretches of neighbouring such lines, upto sums up the words of the stretch.
    """
    lines = saved(line_rows(docs))
    heads = saved(lines.groupBy("doc_id", "th").agg((F.max("line") + 2).cast("long").alias("room")))
    starts = positions(heads, [], ["doc_id", "th"], weight="room", name="start")
    often = saved(lines.groupBy("x", "y").agg(F.count("*").alias("n")).where("n > 1"))
    again = with_facts(lines, often, ["x", "y"], "n", ["n"]).where("n is not null").drop("n")
    s = starts.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), F.col("start").alias("doc"))
    again = again.join(s.hint("merge"), again["doc_id"].eqNullSafe(F.col("d")) & (again["th"] == F.col("t"))).drop("d", "t")
    # a repeated row gives the same positions again; one of each stays
    again = again.withColumn("pos", F.col("doc") + F.col("line")).dropDuplicates(["doc", "pos"])
    again = again.withColumn("seg", F.col("pos") - F.row_number().over(W.partitionBy("doc").orderBy("pos")))
    stretch = W.partitionBy("doc", "seg")
    again = again.withColumn("upto", F.sum("words").over(stretch.orderBy("pos"))).withColumn("all", F.sum("words").over(stretch))
    return saved(again.where(F.col("all") >= min_words).drop("all"))


def least_windows(rows: DataFrame, min_words: int) -> DataFrame:
    """(lo, hi): for every line the fewest lines from it on, and up to it, with min_words words in its stretch."""
    before = F.col("upto") - F.col("words")

    def event(value: Column, asks: int) -> Column:
        return F.struct(value.alias("value"), F.lit(asks).alias("asks"), F.col("pos").alias("at"))

    def asked(has: Column, wants: Column, first: bool) -> DataFrame:
        both = rows.select("doc", "seg", F.explode(F.array(event(has, int(not first)), event(wants, int(first)))).alias("e")).select("doc", "seg", "e.*")
        asks = F.col("asks") == int(first)
        line = F.when(~asks, F.col("at"))
        w = W.partitionBy("doc", "seg")
        # the first line at or beyond the wish stands behind it, the last line at or below stands ahead of it;
        # both frames start at the partition's end, as only those run in one pass
        order = (F.desc("value"), F.col("asks"), F.desc("at")) if first else (F.col("value"), F.desc("asks"), F.col("at"))
        got = F.last(line, ignorenulls=True).over(w.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
        return both.withColumn("got", got).where(asks & F.col("got").isNotNull()).select("at", "got")

    on = asked(F.col("upto"), before + min_words, True).select(F.col("at").alias("lo"), F.col("got").alias("hi"))
    up = asked(before, F.col("upto") - min_words, False).select(F.col("got").alias("lo"), F.col("at").alias("hi"))
    return on.union(up).distinct()


def named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(doc, pos, name) of the rows whose keys occur more than once; the name is their first position."""
    first = saved(rows.groupBy(*keys).agg(F.min("pos").alias("name"), F.count("*").alias("n")).where("n > 1"))
    return with_facts(rows.select("doc", "pos", *keys), first, keys, "n", ["name"]).where("name is not null").select("doc", "pos", "name")


def removed_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, th, line): the lines to delete."""
    base = repeated(docs, min_words)
    size = F.col("hi") - F.col("lo") + 1
    windows = saved(least_windows(base, min_words).withColumn("k", F.floor(F.log2(size.cast("double"))).cast("int")))
    deepest = windows.agg(F.max("k").alias("k")).collect()[0]["k"] or 0
    level = saved(named(base, ["x", "y"]))
    levels = level.select(F.lit(0).alias("lk"), "pos", "name")
    for k in range(deepest):
        half = 2**k
        pairs = level.withColumnRenamed("name", "head").withColumn("next", F.first("head").over(W.partitionBy("doc").orderBy("pos").rangeBetween(half, half)))
        level = saved(named(pairs.where("next is not null"), ["head", "next"]))
        levels = levels.union(level.select(F.lit(k + 1).alias("lk"), "pos", "name"))
    head = levels.select("lk", F.col("pos").alias("p"), F.col("name").alias("head"))
    tail = levels.select(F.col("lk").alias("tk"), F.col("pos").alias("q"), F.col("name").alias("tail"))
    named_windows = windows.join(head.hint("merge"), (F.col("k") == F.col("lk")) & (F.col("lo") == F.col("p"))).drop("lk", "p")
    end = F.col("hi") + 1 - F.pow(F.lit(2.0), F.col("k")).cast("long")
    named_windows = named_windows.withColumn("at", end)
    named_windows = named_windows.join(tail.hint("merge"), (F.col("k") == F.col("tk")) & (F.col("at") == F.col("q"))).select("lo", "hi", size.alias("m"), "head", "tail")
    named_windows = saved(named_windows)
    firsts = saved(named_windows.groupBy("m", "head", "tail").agg(F.min("lo").alias("first"), F.count("*").alias("n")).where("n > 1"))
    later = with_facts(named_windows, firsts, ["m", "head", "tail"], "n", ["first"]).where("first < lo")
    later = later.groupBy(F.col("lo").alias("from")).agg(F.max("hi").alias("upto_line"))
    lines = base.select("doc_id", "th", "doc", "pos", "line").join(later.hint("merge"), F.col("pos") == F.col("from"), "left")
    reach = F.max("upto_line").over(W.partitionBy("doc").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow))
    return lines.withColumn("reach", reach).where("reach >= pos").select("doc_id", "th", "line")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, names: tuple[str, str] = ("n_lines", "removed")) -> DataFrame:
    """docs with text without the deleted lines, and two more columns: the number of lines before, and sorted numbers of those deleted.

    names are the names of the two; columns of docs with these names are replaced.

    A text whose lines are all deleted becomes empty.
    """
    gone = removed_lines(docs, min_words).groupBy(F.col("doc_id").alias("_d"), F.col("th").alias("_t")).agg(F.sort_array(F.collect_list("line")).alias("_removed"))
    rows = docs.withColumn("_th", F.xxhash64("text"))
    out = rows.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_t")), "left")
    removed = F.coalesce("_removed", F.array().cast("array<int>"))
    lines = F.split("text", "\n", -1)

    def without(parts: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), removed)
        return F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n")

    # the lines are bound once: an expression inside a lambda would split the text again for each line
    kept = F.transform(F.array(lines), without)[0]
    text = F.when(F.size(removed) > 0, kept).otherwise(F.col("text"))
    keep = [text.alias(c) if c == "text" else F.col(c) for c in docs.columns if c not in names]
    return out.select(*keep, F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).alias(names[0]), removed.alias(names[1]))
