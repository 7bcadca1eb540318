"""From buckets of look-alikes to exact links, without a row for each pair.

Both near-duplicate operators find candidates by bucket keys (`key`, `id`). A pair that shares a
bucket is first held against a cheap test on small sketches; what passes only forms clusters. The
exact test then runs on whole clusters.

Both distances, the angle of vectors and one minus the Jaccard similarity of sets, obey the triangle
inequality. So in a cluster of more than BLOCK members a centre is made, and every member is held
against it exactly: members within half the threshold's distance of the centre (the core) are all
linked to one another, and are counted instead of compared. Only the others (the shell) are compared
pair by pair, with the shell and with the core, in blocks of bounded size: each block gives counts and
a spanning forest back. A cluster of near copies thus costs one comparison a member, and one with s
members in the shell s * n / BLOCK rows; no bucket or cluster is dropped, capped or sampled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionforge.llm.common import components, forest, n_shuffled, saved, with_facts

#: Buckets up to this size are tested pair by pair on sketches; members of larger ones all join a cluster.
TESTED_BUCKET = 64
#: Members of a cluster that one side of a block holds.
BLOCK = 512


@dataclass(frozen=True)
class Exact:
    """The exact comparisons of one kind of things, whose rows hold `columns` (a schema, without the id).

    links(left, right) gives the boolean matrix of links; right is None for a block with itself.
    centre(rows) makes a centre, as bytes, and the values of columns that say which rows it can be
    compared with. close(rows, centre row) says which rows are surely within half the distance.
    """

    columns: dict[str, str]
    links: Callable[[pd.DataFrame, pd.DataFrame | None], np.ndarray]
    centre: Callable[[pd.DataFrame], tuple[bytes, dict]]
    close: Callable[[pd.DataFrame, pd.Series], np.ndarray]


def grouped(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of a stream that is sorted by `keys`; a group may go on over several batches."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        if held:
            batch = pd.concat([*held, batch], ignore_index=True)
        k = batch[keys].to_numpy()
        cuts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        starts = [0, *cuts.tolist()]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            yield batch.iloc[a:b]
        held = [batch.iloc[starts[-1] :]]
    if held:
        yield held[0]


def whole_groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Batches of a stream that is sorted by `key`, cut anew so that no group goes on over several; groups must be small."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pd.concat([held, batch], ignore_index=True)
        if batch.empty:
            continue
        start = int(np.searchsorted(batch[key].to_numpy(), batch[key].iat[-1]))
        if start:
            yield batch.iloc[:start]
        held = batch.iloc[start:]
    if held is not None and len(held):
        yield held


def matrix(sketches: pd.Series) -> np.ndarray:
    """Sketches as rows of bytes; shorter ones are filled up with zeros."""
    if sketches.map(len).nunique() > 1:
        width = int(sketches.map(len).max())
        sketches = sketches.map(lambda s: s.ljust(width, b"\0"))
    return np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), -1)


def clusters(buckets: DataFrame, sketches: DataFrame, plausible: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(v, root): clusters that hold every pair that shares a bucket and is plausible.

    buckets: (key, id), saved; sketches: (id, sketch binary), saved. plausible(s, i, j) takes sketches as
    rows of bytes and says which of the pairs of rows i and j may be links; sketches of a bucket are
    equally long. Buckets with the same members (same count, ends and two sums of hashes) are tested once.
    """
    seen = buckets.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(7))).alias("y")).where("n > 1")
    once = saved(seen.groupBy("n", "lo", "hi", "x", "y").agg(F.min("key").alias("key")).select("key", "n", "lo"))
    rows = saved(with_facts(buckets.select("key", "id"), once, ["key"], "n", ["n", "lo"]).where("n is not null"))
    star = rows.where((F.col("n") > TESTED_BUCKET) & (F.col("id") > F.col("lo"))).select(F.col("id").alias("a"), F.col("lo").alias("b"))

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """All pairs of all buckets of a batch at once: row i with row i + d, for each d while some bucket goes on as far."""
        for g in whole_groups(batches, "key"):
            key, ids, s = g["key"].to_numpy(), g["id"].to_numpy(), matrix(g["sketch"])
            found = []
            for d in range(1, TESTED_BUCKET):
                i = np.flatnonzero(key[d:] == key[:-d])
                if not len(i):
                    break
                for c in range(0, len(i), 100_000):
                    x = i[c : c + 100_000]
                    x = x[plausible(s, x, x + d)]
                    found.append((x, x + d))
            if found:
                i, j = (np.concatenate([f[k] for f in found]) for k in (0, 1))
                if len(i):
                    a, b = forest(ids[i], ids[j])
                    yield pd.DataFrame({"a": a, "b": b})

    small = rows.where(F.col("n") <= TESTED_BUCKET).select("key", "id")
    small = small.join(sketches.select(F.col("id").alias("of"), "sketch").hint("merge"), F.col("id") == F.col("of")).select("key", "id", "sketch")
    # a fixed number of tasks: bytes say little about the work here
    tested = small.repartition(n_shuffled(buckets.sparkSession), "key").sortWithinPartitions("key", "id").mapInPandas(test, "a long, b long")
    return components(star.union(tested).distinct())


def _sides(rows: DataFrame, own: Column, others: Column) -> DataFrame:
    """A row for each pair of its own block with another: (i, j, side), side 1 where its own is the greater."""
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(others))
    return dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int")}).drop("own", "other")


def _block_of(n: Column) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(3)), n).cast("int")


def linked(members: DataFrame, exact: Exact) -> DataFrame:
    """Rows (id, n, a): n weighted links of id, or a forest edge id-a; members: (root, id, weight, exact.columns), saved."""
    spark, columns = members.sparkSession, list(exact.columns)
    sizes = saved(members.groupBy("root").agg(F.count("*").alias("n_members")))
    m = with_facts(members.select("root", "id", "weight", *columns), sizes, ["root"], "n_members", ["n_members"])
    little = m.where(F.col("n_members") <= BLOCK).drop("n_members").withColumns({"i": F.lit(0), "j": F.lit(0), "side": F.lit(0)})
    if sizes.where(F.col("n_members") > BLOCK).isEmpty():
        return _compared(little, exact)
    big = saved(m.where(F.col("n_members") > BLOCK).withColumn("n_chunks", F.ceil(F.col("n_members") / BLOCK).cast("int")).withColumn("chunk", _block_of(F.col("n_chunks"))))
    payload = ", ".join(f"{c} {t}" for c, t in exact.columns.items())

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in grouped(batches, ["root"]):
            centre, like = exact.centre(g)
            yield pd.DataFrame({"root": g["root"].iloc[:1].to_numpy(), "n_chunks": g["n_chunks"].iloc[:1].to_numpy(), "centre": [centre], **{c: [like.get(c)] for c in columns}})

    # chunk 0 is a sample of about BLOCK members by hash; it only decides what has to be compared, not the result
    first = big.where("chunk = 0").select("root", "id", "n_chunks", *columns).repartition(n_shuffled(spark), "root").sortWithinPartitions("root", "id")
    centres = saved(first.mapInPandas(make, f"root long, n_chunks int, centre binary, {payload}"))
    heads = centres.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)))

    def hold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in grouped(batches, ["root", "chunk"]):
            if len(g) > 1 and g["centre"].iat[0] is not None:
                rest = g.iloc[1:]
                yield pd.DataFrame({"of": rest["id"].to_numpy(), "core": exact.close(rest, g.iloc[0])})
            else:  # a root whose chunk 0 is empty has no centre
                rest = g[g["centre"].isna()]
                yield pd.DataFrame({"of": rest["id"].to_numpy(), "core": np.zeros(len(rest), bool)})

    both = heads.select("root", "chunk", F.lit(-1).cast("long").alias("id"), "centre", *columns).union(big.select("root", "chunk", "id", F.lit(None).cast("binary").alias("centre"), *columns))
    held = both.repartition(n_shuffled(spark), "root", "chunk").sortWithinPartitions("root", "chunk", "id").mapInPandas(hold, "of long, core boolean")
    big = saved(big.drop("n_chunks", "chunk").join(held.hint("merge"), F.col("id") == F.col("of")).drop("of"))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    facts = big.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.when(F.col("core"), F.col("weight"))).alias("core_weight"), F.min(F.when(F.col("core"), F.col("id"))).alias("lead"), count(~F.col("core")).alias("n_shell"), count(F.col("core")).alias("n_core"))
    facts = saved(facts)
    told = with_facts(big, facts, ["root"], "n", ["core_weight", "lead", "n_shell", "n_core"])
    inner = told.where("core")
    counted = inner.select("id", (F.col("core_weight") - F.col("weight")).alias("n"), F.lit(None).cast("long").alias("a")).where("n > 0")
    tied = inner.where("id <> lead").select("id", F.lit(0).cast("long").alias("n"), F.col("lead").alias("a"))
    shells, cores = F.ceil(F.col("n_shell") / BLOCK).cast("int"), F.ceil(F.col("n_core") / BLOCK).cast("int")
    keep = ["root", "id", "weight", *columns, "i", "j", "side"]
    shell = _sides(told.where("not core"), _block_of(shells), F.sequence(F.lit(0), shells + cores - 1)).select(*keep)
    core = _sides(told.where("core and n_shell > 0"), shells + _block_of(cores), F.sequence(F.lit(0), shells - 1)).select(*keep)
    return _compared(little.select(*keep).union(shell).union(core), exact).union(counted).union(tied)


def _compared(dealt: DataFrame, exact: Exact) -> DataFrame:
    """The exact test on each pair of blocks: rows (id, n, a) as `linked` gives them. Blocks number (i, j) in their cluster."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in grouped(batches, ["root", "i", "j"]):
            left, right = g[g["side"] == 0], g[g["side"] == 1]
            own = g["i"].iat[0] == g["j"].iat[0]
            if left.empty or (right.empty and not own):
                continue
            m = exact.links(left, None if own else right)
            if own:
                np.fill_diagonal(m, False)
                right = left
            la, ra = left["id"].to_numpy(), right["id"].to_numpy()
            n = [(la, m @ right["weight"].to_numpy())] + ([] if own else [(ra, m.T @ left["weight"].to_numpy())])
            for ids, k in n:
                yield pd.DataFrame({"id": ids[k > 0], "n": k[k > 0].astype("int64"), "a": pd.array([None] * int((k > 0).sum()), dtype="Int64")})
            x, y = np.nonzero(m)
            if len(x):
                a, b = forest(la[x], ra[y])
                yield pd.DataFrame({"id": a, "n": np.zeros(len(a), "int64"), "a": pd.array(b, dtype="Int64")})

    ready = dealt.select("root", "i", "j", "side", "id", "weight", *exact.columns)
    return ready.repartition(n_shuffled(dealt.sparkSession), "root", "i", "j").sortWithinPartitions("root", "i", "j", "side", "id").mapInPandas(run, "id long, n long, a long")


def settled(found: DataFrame) -> DataFrame:
    """(id, n_links, root) of all ids with a link, from the rows of `linked`."""
    found = saved(found)
    counts = found.groupBy("id").agg(F.sum("n").alias("n_links"))
    roots = components(found.where("a is not null").select(F.col("id").alias("a"), F.col("a").alias("b")))
    return counts.join(roots.hint("merge"), counts["id"] == roots["v"]).select("id", "n_links", "root")


def with_root_rep(found: DataFrame, reps: DataFrame) -> DataFrame:
    """found (..., root) with `rep`, what reps (id, rep) says of the root; a root may have any number of members."""
    found = saved(found)
    n = found.groupBy(F.col("root").alias("r")).agg(F.count("*").alias("n"))
    facts = saved(n.join(reps.select("id", "rep").hint("merge"), F.col("r") == F.col("id")).select(F.col("r").alias("root"), "n", "rep"))
    return with_facts(found, facts, ["root"], "n", ["rep"])
