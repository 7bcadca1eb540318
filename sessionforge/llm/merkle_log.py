"""Merkle dataset manifest as a postorder append log.

Every row of a table is a leaf; the leaves of a group (here: of a language), in the order of their ids,
carry a tree whose nodes are the sha256 of two neighbours' hex digests, or of one where a level ends
alone; the groups' roots carry one more tree. Where a node stands in a group's log is a sum of subtree
sizes: of the levels up to its own, all nodes that end no later than it does, and of the levels above,
those that end before it begins (`address`).

Builders are aligned: builder b of a tier takes the 2^BITS nodes from b * 2^BITS on, so its subtree is one
of the tree, whatever lies beside it, and it writes its nodes as they are completed. It needs nothing but
its own children, so a tier is one pass with a shuffle of its children, and a tree of n leaves has
log(n) / (BITS log 2) tiers. Proofs go the other way: a segment takes the path of its own root, and addresses
the siblings of its children in its log. No group gathers in a task, however many of the leaves it has.

A null field is `-` in a leaf. A null group is a group of its own, before all others; a null id comes before
others. Rows that repeat are leaves each. Rows with one id are ordered by their digests. A text of any
length, an empty one too, is one field. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionforge.llm.common import n_shuffled, positions, written
from sessionforge.llm.linking import grouped

#: A builder's subtree has 2^BITS children.
BITS = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
DIGEST = 32
#: Segments that are handled at once.
AT_ONCE = 64
#: What a proof says of a level: no sibling, one on the left, one on the right. The digest follows.
NONE, LEFT, RIGHT = 0, 1, 2

SEGMENT = "grp string, tier int, block long, ends long, at binary, levels binary, nodes binary, root binary, ids string, changed binary"


def joined(*digests: bytes) -> bytes:
    """The digest of digests, which are hashed as hex text."""
    return hashlib.sha256(b"".join(d.hex().encode() for d in digests)).digest()


def address(level: int, index: int, ends: int) -> int:
    """The place of a node in its group's log; ends: the first leaf that isn't under it.

    Of each level up to its own, what ends by then is written: ceil(ends / 2^l) nodes. Of the levels above,
    what ends before the node begins: index // 2 + index // 4 + ..., which is index less its one bits.
    """
    return sum(-(-ends >> lower) for lower in range(level + 1)) + index - index.bit_count() - 1


def completed(children: list[bytes], top: int) -> Iterator[tuple[int, int, bytes]]:
    """(level, index, digest) of a subtree of `top` levels, the children included, each as soon as all below it are there."""
    waiting: dict[int, bytes] = {}
    for c, digest in enumerate(children):
        last, level, index = c == len(children) - 1, 0, c
        yield level, index, digest
        while level < top and (index & 1 or last):
            digest = joined(waiting.pop(level), digest) if index & 1 else joined(digest)
            level, index = level + 1, index >> 1
            yield level, index, digest
        waiting[level] = digest


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(docs: DataFrame) -> DataFrame:
    """(grp, doc_id, leaf, changed): a row's digest, and the digest after tampering if it is tampered with.

    grp is the language behind a `=`, and empty for null, so that it sorts as languages do with null first.
    """
    digest = lambda n: F.sha2(F.concat(*[_field(n if c == "n_chars" else F.col(c)) for c in FIELDS]), 256)
    struck = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    return docs.select(F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("n_chars")).alias("leaf"), F.when(struck, digest(more)).alias("changed"))


def _built(batches: Iterator[pd.DataFrame], tier: int) -> Iterator[pd.DataFrame]:
    """Segments of the log: the nodes of each builder in the order in which they are completed."""

    def segment(g: pd.DataFrame) -> tuple:
        block, children = int(g["block"].iat[0]), [bytes(d) for d in g["digest"]]
        top = (len(children) - 1).bit_length() if block == 0 else BITS  # the first builder ends at the root if it is the only one
        base, first, ends = tier * BITS, block << BITS, int(g["ends"].iat[-1])
        at, levels, nodes = [], bytearray(), bytearray()
        for level, index, digest in completed(children, top):
            index += first >> level
            at.append(address(base + level, index, min((index + 1) << (base + level), ends)))
            levels.append(base + level)
            nodes += digest
        changed = b"".join(bytes(DIGEST) if x is None else bytes(x) for x in g["changed"]) if tier == 0 else b""
        ids = "\n".join("" if x is None else x for x in g["id"])
        return g["grp"].iat[0], tier, block, ends, np.array(at, "<i8").tobytes(), bytes(levels), bytes(nodes), digest, ids, changed

    names = [field.split()[0] for field in SEGMENT.split(", ")]
    for some in itertools.batched(grouped(batches, ["grp", "block"]), AT_ONCE):
        yield pd.DataFrame([segment(g) for g in some], columns=names)


def build(rows: DataFrame) -> list[DataFrame]:
    """The segments of the logs of all groups, a table a tier; rows: (grp, position, id string, leaf hex, changed hex or null)."""
    spark = rows.sparkSession
    children = rows.select("grp", "position", F.unhex("leaf").alias("digest"), (F.col("position") + 1).alias("ends"), "id", F.unhex("changed").alias("changed"))
    tiers: list[DataFrame] = []
    while True:
        tier = len(tiers)
        dealt = children.withColumn("block", F.shiftright("position", BITS)).repartition(n_shuffled(spark), "grp", "block").sortWithinPartitions("grp", "block", "position")
        tiers.append(written(dealt.mapInPandas(lambda batches, tier=tier: _built(batches, tier), SEGMENT)))
        if tiers[-1].where("block > 0").isEmpty():
            return tiers
        children = tiers[-1].select("grp", F.col("block").alias("position"), F.col("root").alias("digest"), "ends", F.lit(None).cast("string").alias("id"), F.lit(None).cast("binary").alias("changed"))


def _each(batches: Iterator[pd.DataFrame], rows: Callable[[tuple], Iterable[tuple]], columns: list[str]) -> Iterator[pd.DataFrame]:
    """What `rows` makes of each segment, some segments at once."""
    for pdf in batches:
        for some in itertools.batched(pdf.itertuples(), AT_ONCE):
            yield pd.DataFrame([row for s in some for row in rows(s)], columns=columns)


def log(tiers: list[DataFrame]) -> DataFrame:
    """(grp, at, level, digest): the log of all groups, a row a node. Upper segments repeat their children, which lower ones have."""

    def nodes(s: tuple) -> Iterator[tuple]:
        for i, (at, level) in enumerate(zip(np.frombuffer(s.at, "<i8"), s.levels, strict=True)):
            if s.tier == 0 or level > s.tier * BITS:
                yield s.grp, at, level, s.nodes[DIGEST * i : DIGEST * (i + 1)].hex()

    names = ["grp", "at", "level", "digest"]
    parts = [t.select("grp", "tier", "at", "levels", "nodes").mapInPandas(lambda batches: _each(batches, nodes, names), "grp string, at long, level int, digest string") for t in tiers]
    return reduce(DataFrame.union, parts)


def _paths(s: tuple) -> Iterator[tuple[int, bytes]]:
    """(number, proof) of each child of a segment: its siblings there, read from the segment by address, then the segment's own path."""
    base, first = s.tier * BITS, s.block << BITS
    at, levels = np.frombuffer(s.at, "<i8"), np.frombuffer(s.levels, np.uint8)
    place = {int(a): k for k, a in enumerate(at)}
    n, top = int((levels == base).sum()), int(levels.max()) - base
    found: dict[tuple[int, int], bytes] = {}

    def sibling(level: int, index: int) -> bytes:
        other = index ^ 1
        if other << (base + level) >= s.ends:
            return bytes([NONE])
        if (level, other) not in found:
            k = place[address(base + level, other, min((other + 1) << (base + level), s.ends))]
            found[level, other] = bytes([RIGHT if index < other else LEFT]) + s.nodes[DIGEST * k : DIGEST * (k + 1)]
        return found[level, other]

    for c in range(n):
        yield c, b"".join(sibling(level, (first + c) >> level) for level in range(top)) + s.path


def _of_children(rows: DataFrame) -> DataFrame:
    """(grp, child, path, subroot) of the children of segments that have paths."""
    names = ["grp", "child", "path", "subroot"]
    children = lambda s: ((s.grp, (s.block << BITS) + c, path, s.subroot) for c, path in _paths(s))
    return rows.mapInPandas(lambda batches: _each(batches, children, names), "grp string, child long, path binary, subroot string")


def with_paths(tiers: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The segments of the leaves with `path`, the proof of their root, and subroot; tops: (grp, path, subroot) of the groups.

    Both sides of each join have a row a segment, so no group gathers.
    """
    known = tops.select("grp", F.lit(0).cast("long").alias("child"), "path", "subroot")
    for tier in reversed(tiers):
        held = tier.join(known.withColumnRenamed("grp", "_of").hint("merge"), (F.col("grp") == F.col("_of")) & (F.col("block") == F.col("child"))).drop("_of", "child")
        known = held if tier is tiers[0] else written(_of_children(held))
    return known


def siblings(path: bytes) -> Iterator[tuple[int, bytes]]:
    """(side, digest) of each level of a proof."""
    i = 0
    while i < len(path):
        side = path[i]
        yield side, path[i + 1 : i + 1 + DIGEST] if side != NONE else b""
        i += 1 + (DIGEST if side != NONE else 0)


def folded(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and a proof give."""
    for side, other in siblings(path):
        leaf = joined(leaf) if side == NONE else joined(other, leaf) if side == LEFT else joined(leaf, other)
    return leaf


def _proven(s: tuple) -> Iterator[tuple]:
    """What is told of each leaf of a segment."""
    ids, own = s.ids.split("\n"), [k for k, level in enumerate(s.levels) if level == 0]
    for (c, path), k in zip(_paths(s), own, strict=True):
        leaf, changed = s.nodes[DIGEST * k : DIGEST * (k + 1)], s.changed[DIGEST * c : DIGEST * (c + 1)]
        proof = joined(*[d for side, d in siblings(path) if side != NONE])
        yield ids[c] or None, leaf.hex(), s.subroot, proof.hex(), folded(changed if any(changed) else leaf, path).hex()


def manifest(docs: DataFrame) -> tuple[list[DataFrame], list[DataFrame], DataFrame]:
    """The segments of the groups' logs, those of the log over the groups' roots, and (grp, subroot, position) of the groups."""
    placed = positions(leaves(docs), ["grp"], ["doc_id", "leaf"])
    lower = build(placed.select("grp", "position", F.col("doc_id").cast("string").alias("id"), "leaf", "changed"))
    roots = positions(lower[-1].select("grp", F.lower(F.hex("root")).alias("subroot")), [], ["grp"])
    none = F.lit(None).cast("string")
    upper = build(roots.select(F.lit("").alias("grp"), "position", none.alias("id"), F.col("subroot").alias("leaf"), none.alias("changed")))
    return lower, upper, roots


def proofs(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of docs (doc_id, source, lang, n_chars, text).

    subroot is the root of the row's language, root that of all. proof_sha256 is the digest of all siblings
    from leaf to root; folded_root is recomputed from them and from the leaf as it is after tampering.
    """
    lower, upper, roots = manifest(docs)
    top = upper[-1].select("root").take(1)
    root = top[0]["root"].hex() if top else None
    whole = upper[-1].select("grp", F.lit(b"").alias("path"), F.lit("").alias("subroot"))
    paths = _of_children(with_paths(upper, whole)).select("child", "path")
    tops = roots.join(paths.hint("merge"), F.col("position") == F.col("child")).select("grp", "path", "subroot")
    names = ["id", "leaf", "subroot", "proof_sha256", "folded_root"]
    out = with_paths(lower, tops).mapInPandas(lambda batches: _each(batches, _proven, names), ", ".join(f"{c} string" for c in names))
    return out.select(F.col("id").cast("long").alias("doc_id"), "leaf", "subroot", F.lit(root).cast("string").alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified"))


_leaf = "sha256(concat(" + ", ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen(CAST({c} AS VARCHAR)), ':', CAST({c} AS VARCHAR)) END" for c in FIELDS) + "))"


def _tree_sql(name: str, source: str) -> str:
    """CTEs name_n, the nodes of the trees over source (g, i, n, leaf), and name_f, its rows as they fold up to the root."""
    return f"""{name}_n(g, lev, i, n, d) AS (SELECT g, 0, i, n, leaf FROM {source}
  UNION ALL SELECT g, lev + 1, i // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM {name}_n WHERE n > 1 GROUP BY g, lev, i // 2, n),
{name}_f(g, nth, lev, i, n, h, proof) AS (SELECT g, i, 0, i, n, h, proof FROM {source}
  UNION ALL SELECT f.g, nth, f.lev + 1, f.i // 2, (f.n + 1) // 2, sha256(CASE WHEN f.i % 2 = 1 THEN s.d || h ELSE h || coalesce(s.d, '') END), proof || coalesce(s.d, '')
  FROM {name}_f f LEFT JOIN {name}_n s ON s.g = f.g AND s.lev = f.lev AND s.i = xor(f.i, 1) WHERE f.n > 1)"""


#: crc32 by table, trees level by level: no builders, segments or addresses. The upper tree's proofs follow from its nodes once the lower ones are folded.
SQL = f"""WITH RECURSIVE bits(b, c, k) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
rows_0 AS (SELECT *, coalesce('=' || lang, '') AS g, xor(4294967295, list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS crc FROM documents, crc),
rows_1 AS (SELECT doc_id, g, {_leaf} AS leaf, CASE WHEN crc % 7 = 0 THEN {_leaf.replace("n_chars", "(n_chars + 1)")} END AS changed FROM rows_0),
rows_2 AS (SELECT doc_id, g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n, leaf, coalesce(changed, leaf) AS h, '' AS proof FROM rows_1),
{_tree_sql("low", "rows_2")},
subroots AS (SELECT g AS lg, d AS subroot, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM low_n WHERE n = 1),
tops AS (SELECT '' AS g, i, n, subroot AS leaf, subroot AS h, '' AS proof FROM subroots),
{_tree_sql("top", "tops")},
up(g, nth, lev, i, n, h, proof) AS (SELECT f.g, f.nth, 0, s.i, s.n, h, proof FROM low_f f JOIN subroots s ON s.lg = f.g WHERE f.n = 1
  UNION ALL SELECT f.g, nth, f.lev + 1, f.i // 2, (f.n + 1) // 2, sha256(CASE WHEN f.i % 2 = 1 THEN s.d || h ELSE h || coalesce(s.d, '') END), proof || coalesce(s.d, '')
  FROM up f LEFT JOIN top_n s ON s.lev = f.lev AND s.i = xor(f.i, 1) WHERE f.n > 1)
SELECT r.doc_id, r.leaf, s.subroot, t.d AS root, sha256(u.proof) AS proof_sha256, u.h AS folded_root, u.h = t.d AS verified
FROM rows_2 r JOIN up u ON u.g = r.g AND u.nth = r.i AND u.n = 1 JOIN subroots s ON s.lg = r.g JOIN top_n t ON t.n = 1"""
