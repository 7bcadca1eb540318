"""Sharding by a k-d tree over document metadata, to leaves of equal bytes.

The dimensions of a document are facts that equal texts share: its characters, its UTF-8 bytes per
character (a proxy of script and language), and its lines. A node is split along its dimension
of widest spread (the range in units of the whole table's range), at the distributed weighted median,
or for an odd number of leaves the quantile that the halves' leaves call for. Bytes are the weights.
Medians come from histograms: every round counts bytes in BINS bins of each open node's interval and
narrows to the bin that holds the quantile; an interval of at most FEW rows is counted key by key. So
the driver sees at most nodes x max(BINS, FEW) numbers, never texts.

Along a dimension rows stand by its value and then by text hash, so the rows of one text stand
together; a split falls between texts, at the nearer end of the text at the quantile, unless a text's
copies weigh more than a whole leaf. Then it falls among the copies, by doc_id. Null texts have no bytes but the 8 of every row, and hash 0.
Null doc_ids come first. Repeated rows count each. Texts of any length are measured whole. An empty table gives no rows. Fewer documents than
shards leave shards empty. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionforge.llm.common import positions, saved

SHARDS, BINS, FEW, ROW_BYTES = 24, 1024, 4096, 8
DIMENSIONS = ("chars", "density", "lines")
#: Bits of a dimension's value in a key; 32 more hold the text hash.
VALUE_BITS = 30


def key_of(c: str) -> Column:
    """Order along a dimension in one number: the value, then the text hash."""
    return F.least(F.col(c), F.lit(2**VALUE_BITS - 1)).cast("long") * F.lit(2**32) + F.col("text_crc32")


def metadata(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    chars, size = F.length(text), F.octet_length(text)
    lines = chars - F.length(F.translate(text, "\n", "")) + 1
    density = F.when(chars > 0, F.floor((size / chars - 1) * 2**20)).otherwise(0)
    return docs.select("doc_id", (size + ROW_BYTES).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), chars.cast("long").alias("chars"), density.cast("long").alias("density"), lines.cast("long").alias("lines"))


def at_quantile(rows: DataFrame, key: str, goal: dict[int, float], ends: dict[int, tuple[int, int, int]]) -> dict[int, tuple[int, float, float]]:
    """For each node the least key at which the bytes up to it reach the node's goal: (key, bytes below, bytes at it).

    rows: (node, size, key); ends: least key, greatest key and rows of a node. Intervals narrow until they hold one key.
    """
    open_, below, found = {n: ends[n] for n in goal if n in ends}, dict.fromkeys(goal, 0.0), {}
    while open_:
        lo, step, hi = F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(None).cast("long")
        steps = {n: 1 if rows_in <= FEW else max(1, -(-(b - a + 1) // BINS)) for n, (a, b, rows_in) in open_.items()}
        for n, (a, b, _) in open_.items():
            lo, step, hi = (F.when(F.col("node") == n, F.lit(v)).otherwise(c) for v, c in ((a, lo), (steps[n], step), (b, hi)))
        inside = rows.select("node", "size", F.col(key).alias("k"), lo.alias("lo"), step.alias("step"), hi.alias("hi")).where("lo is not null and k between lo and hi")
        # as decimals, since the ends of an interval may lie further apart than a long reaches
        bins = inside.groupBy("node", F.floor((F.col("k").cast("decimal(20,0)") - F.col("lo").cast("decimal(20,0)")) / F.col("step")).cast("decimal(20,0)").alias("bin"))
        by_node: dict[int, list] = {n: [] for n in open_}
        for r in bins.agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).orderBy("node", "bin").collect():
            by_node[r["node"]].append((int(r["bin"]), r["bytes"], r["n"]))
        nxt = {}
        for n, (a, _, _) in open_.items():
            for i, (at, w, rows_in) in enumerate(by_node[n]):
                if below[n] + w >= goal[n] or i == len(by_node[n]) - 1:
                    if steps[n] == 1:
                        found[n] = (a + at, below[n], float(w))
                    else:
                        nxt[n] = (a + at * steps[n], a + (at + 1) * steps[n] - 1, rows_in)
                    break
                below[n] += w
        open_ = nxt
    return found


@dataclass
class Node:
    """A subtree for some shards from the first on, by which it is named; split by a key, or, among copies of one text, by doc_id."""

    first: int
    shards: int
    dimension: str = DIMENSIONS[0]
    last: int = 0
    among: tuple[int, int] | None = None  # the copies' key, and the last doc_id on the left

    def halves(self) -> tuple[Node, Node]:
        n = self.shards // 2
        return Node(self.first, n), Node(self.first + n, self.shards - n)

    def side(self) -> Column:
        """The name of the half that a row falls in."""
        key, left = key_of(self.dimension), F.lit(False)
        if self.among is not None:
            at, upto = self.among
            left = (key == at) & (F.col("doc_id").isNull() | (F.col("doc_id") <= upto))
        return F.when((key <= self.last) | left, self.first).otherwise(self.first + self.shards // 2)


def leaves(meta: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Adds shard to the rows of meta, by splitting nodes until each stands for one shard.

    Nodes are split level by level. What a level decides is written with the rows, so that no
    expression grows with the tree.
    """
    rows, nodes, whole = meta.withColumn("node", F.lit(0)), [Node(0, shards)], None
    while True:
        open_ = {n.first: n for n in nodes if n.shards > 1}
        if not open_:
            return rows.withColumnRenamed("node", "shard")
        inner = rows.where(F.col("node").isin(*open_))
        ends = [f(k).alias(f"{name}_{e}") for c in DIMENSIONS for name, k in ((c, F.col(c)), (f"{c}_key", key_of(c))) for e, f in (("lo", F.min), ("hi", F.max))]
        facts = {r["node"]: r for r in inner.groupBy("node").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), *ends).collect()}
        whole = whole or {c: max(1, facts[0][f"{c}_hi"] - facts[0][f"{c}_lo"]) if facts else 1 for c in DIMENSIONS}
        split = {k: n for k, n in open_.items() if k in facts}
        for k, n in split.items():
            n.dimension = max(DIMENSIONS, key=lambda c, k=k: (facts[k][f"{c}_hi"] - facts[k][f"{c}_lo"]) / whole[c])
        key = F.lit(None).cast("long")
        for k, n in split.items():
            key = F.when(F.col("node") == k, key_of(n.dimension)).otherwise(key)
        keyed = inner.withColumn("key", key)
        goal = {k: facts[k]["bytes"] * (n.shards // 2) / n.shards for k, n in split.items()}
        cut = at_quantile(keyed, "key", goal, {k: (facts[k][f"{n.dimension}_key_lo"], facts[k][f"{n.dimension}_key_hi"], facts[k]["n"]) for k, n in split.items()})
        among = {}
        for k, (at, below, here) in cut.items():
            n = split[k]
            if here <= facts[k]["bytes"] / n.shards:  # the copies of the text at the quantile go to one side
                n.last = at if abs(below + here - goal[k]) <= abs(below - goal[k]) else at - 1
            else:
                n.last, among[k] = at - 1, (at, goal[k] - below)
        if among:
            same = F.lit(False)
            for k, (at, _) in among.items():
                same = same | ((F.col("node") == k) & (F.col("key") == at))
            copies = keyed.where(same & F.col("doc_id").isNotNull())
            spans = {r["node"]: (r["lo"], r["hi"], r["n"]) for r in copies.groupBy("node").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).collect()}
            deep = at_quantile(copies, "doc_id", {k: g for k, (_, g) in among.items()}, spans)
            for k, (at, _) in among.items():
                split[k].among = (at, deep.get(k, (0,))[0])
        node = F.col("node")
        for k, n in split.items():
            node = F.when(F.col("node") == k, n.side()).otherwise(node)
        rows = saved(rows.withColumn("node", node))
        nodes = [half for n in nodes for half in (n.halves() if n.shards > 1 else (n,))]


def kd_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of docs (doc_id, text)."""
    placed = leaves(saved(metadata(docs)), shards).select("doc_id", "size", "text_crc32", "shard")
    slots = positions(placed, ["shard"], ["text_crc32", "doc_id"], name="slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """Writes the documents in a folder for each shard, in the order of slots; files are split at a bounded number of rows."""
    by = placed.select(F.col("doc_id").alias("of"), F.col("text_crc32").alias("h"), "shard", "slot").dropDuplicates(["of", "h"])
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    out = docs.join(by.hint("merge"), docs["doc_id"].eqNullSafe(F.col("of")) & (crc == F.col("h"))).drop("of", "h")
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.option("maxRecordsPerFile", 1_000_000).partitionBy("shard").parquet(path)
