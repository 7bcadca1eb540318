"""N-gram Jaccard join by Bayesian candidate pruning.

The sets are the distinct runs of five words of a text (a text of one to four words has one such run,
itself; words are what stands between blanks, tabs and line breaks, as written). MinHash values give
the buckets in which pairs meet. Inside a bucket the values of a pair are compared a few at a time,
and the pair is dropped once the posterior probability that its similarity reaches the threshold,
after what agreed so far, is below the tolerance. All that is left is verified on the exact sets.

Texts of any length are taken whole, and a similarity of exactly the threshold is a link. Null and empty
texts have no runs and link with nothing; they stay their own class. Texts with the
same set of runs are one vertex with a weight; a repeated row is a copy. Vertices are numbered by
their smallest doc_id, then by fingerprint, so that rows of one doc_id with different texts have
vertices, links and classes of their own. Rows with a null doc_id are returned without links. Other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionforge.llm.common import positions, saved, with_facts
from sessionforge.llm.linking import Exact, clusters, linked, settled, with_root_rep

WORDS, THRESHOLD = 5, 0.8
#: 32 bands of 4 values: a pair at 0.8 shares no band once in 2e7.
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Values compared between two looks at the posterior, and the posterior below which a pair goes.
STEP, TOLERANCE = 16, 1e-7

_P = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words in UTF-8, kept while a task runs, up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_RNG = np.random.default_rng(20)
_PLACES = _RNG.integers(0, 2**64, 64, dtype="uint64") | np.uint64(1)


def shingles(text: str | None, known: WordHashes, n: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the runs of n words of the whole text."""
    # bytes are split at blank, tab and line breaks alone, other than text
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.empty(0, "uint64")
    w = np.fromiter(map(known.__getitem__, words), "uint64", len(words))
    m = min(n, len(w))
    h = np.full(len(w) - m + 1, np.uint64(m))
    with np.errstate(over="ignore"):
        for k in range(m):
            h += w[k : len(w) - m + 1 + k] * _PLACES[k]
        h = mix(h)
    h.sort()
    return h[np.r_[True, h[1:] != h[:-1]]]


_A, _B = (_RNG.integers(0, 2**32, (HASHES, 1), dtype="uint32") for _ in range(2))
_A |= np.uint32(1)


def minhash(s: np.ndarray) -> np.ndarray:
    """HASHES values of 32 bits, each the least of a random hash over the set; a few hundred elements at a time stay in cache."""
    x = (s ^ (s >> np.uint64(32))).astype("uint32")
    out = np.full(HASHES, np.uint32(2**32 - 1))
    for k in range(0, len(x), 512):
        z = x[None, k : k + 512] * _A
        z += _B
        for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
            z ^= z >> np.uint32(shift)
            z *= np.uint32(factor)
        np.minimum(out, z.min(axis=1), out=out)
    return out


def least_matches(seen: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """Fewest agreeing values of `seen` at which P(similarity >= threshold | agreed), uniform prior, is >= tolerance.

    Values are compared by their last byte, so unequal ones agree once in 256: a pair of similarity s
    agrees with probability s + (1 - s) / 256. The posterior is summed on a grid of 4000 similarities.
    """
    s = (np.arange(4000) + 0.5) / 4000
    p = s + (1 - s) / 256
    for m in range(seen + 1):
        log = m * np.log(p) + (seen - m) * np.log1p(-p)
        like = np.exp(log - log.max())
        if like[s >= threshold].sum() / like.sum() >= tolerance:
            return m
    return seen


#: For 16, 32, ... values seen.
LEAST = {k: least_matches(k) for k in range(STEP, HASHES + 1, STEP)}


def plausible(s: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of rows (last bytes of MinHash values) have a posterior that never fell below the tolerance."""
    at, agreed = np.arange(len(i)), np.zeros(len(i), "int32")
    for k in range(0, HASHES, STEP):
        agreed = agreed + (s[i[at], k : k + STEP] == s[j[at], k : k + STEP]).sum(axis=1)
        keep = agreed >= LEAST[k + STEP]
        at, agreed = at[keep], agreed[keep]
        if not len(at):
            break
    out = np.zeros(len(i), bool)
    out[at] = True
    return out


def survivors(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Matrix of the plausible pairs of all rows of left with all of right."""
    agreed = np.zeros((len(left), len(right)), "int32")
    for k in range(STEP):
        agreed += left[:, k, None] == right[None, :, k]
    i, j = np.nonzero(agreed >= LEAST[STEP])
    both = np.concatenate([left, right])
    out = np.zeros(agreed.shape, bool)
    for c in range(0, len(i), 100_000):
        x, y = i[c : c + 100_000], j[c : c + 100_000]
        out[x, y] = plausible(both, x, len(left) + y)
    return out


def overlaps(left: list[np.ndarray], right: list[np.ndarray], slice_cells: int = 8_000_000) -> np.ndarray:
    """Exact sizes of the intersections of all sets of left with all of right, by products of 0/1 matrices."""
    out = np.zeros((len(left), len(right)), "float32")
    common = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)))
    if not len(common):
        return out

    def cells(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        v = np.concatenate(sets)
        at = np.minimum(np.searchsorted(common, v), len(common) - 1)
        hit = common[at] == v
        return row[hit], at[hit]

    (lr, lc), (rr, rc) = cells(left), cells(right)
    width = max(1, slice_cells // max(len(left), len(right)))
    lo, ro = np.argsort(lc, kind="stable"), np.argsort(rc, kind="stable")
    lr, lc, rr, rc = lr[lo], lc[lo], rr[ro], rc[ro]
    for a in range(0, len(common), width):
        w = min(width, len(common) - a)
        sides = []
        for n, r, c in ((len(left), lr, lc), (len(right), rr, rc)):
            x, y = np.searchsorted(c, [a, a + w])
            one = np.zeros((n, w), "float32")
            one[r[x:y], c[x:y] - a] = 1
            sides.append(one)
        out += sides[0] @ sides[1].T
    return out


def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each text that has words: fingerprint of its set, last bytes of MinHash values, band keys."""
    known = WordHashes()
    for pdf in batches:
        out = []
        for doc_id, text, th in zip(pdf["doc_id"], pdf["text"], pdf["th"], strict=True):
            s = shingles(text, known)
            if not len(s):
                continue
            v = minhash(s)
            with np.errstate(over="ignore"):
                fx, fy = int(np.bitwise_xor.reduce(mix(s)).view("int64")), int(mix(s * _P).sum(dtype="uint64").view("int64"))
                bands = np.arange(BANDS, dtype="uint64") + np.uint64(1)
                for r in range(ROWS):
                    bands = mix(bands * _P + v[r::ROWS].astype("uint64"))
            out.append((doc_id, th, len(s), fx, fy, v.astype("uint8").tobytes(), bands.view("int64")))
        if out:
            yield pd.DataFrame(out, columns=["doc_id", "th", "size", "fx", "fy", "sketch", "bands"])


def comparisons(threshold: float = THRESHOLD) -> Exact:
    known = WordHashes()

    def sets(rows: pd.DataFrame) -> list[np.ndarray]:
        return [shingles(t, known) for t in rows["text"]]

    def links(left: pd.DataFrame, right: pd.DataFrame | None) -> np.ndarray:
        right = left if right is None else right
        ls, rs = (np.frombuffer(b"".join(side["sketch"]), np.uint8).reshape(len(side), -1) for side in (left, right))
        out = survivors(ls, rs)
        x, y = np.flatnonzero(out.any(axis=1)), np.flatnonzero(out.any(axis=0))
        if not len(x):
            return out
        lsets, rsets = sets(left.iloc[x]), sets(right.iloc[y])
        both = overlaps(lsets, rsets)
        sizes = np.array([len(s) for s in lsets])[:, None] + np.array([len(s) for s in rsets])[None, :]
        out[np.ix_(x, y)] &= both >= threshold * (sizes - both) - 1e-9
        return out

    def centre(rows: pd.DataFrame) -> tuple[bytes, dict]:
        """The runs that at least half of the texts have, or else those of the first text."""
        all_sets = sets(rows)
        runs, n = np.unique(np.concatenate(all_sets), return_counts=True)
        most = runs[2 * n >= len(all_sets)]
        return (most if len(most) else all_sets[0]).tobytes(), {}

    def close(rows: pd.DataFrame, head: pd.Series) -> np.ndarray:
        c, out = np.frombuffer(head["centre"], "uint64"), []
        for s in sets(rows):
            both = len(np.intersect1d(s, c, assume_unique=True))
            out.append(both >= (1 + threshold) / 2 * (len(s) + len(c) - both))
        return np.array(out, bool)

    return Exact({"sketch": "binary", "text": "string"}, links, centre, close)


def jaccard_join(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_links, copy_of, kept) of every row of docs (doc_id, text).

    n_links: other texts' rows with a similarity of at least 0.8, copies included; class_id: smallest
    doc_id reachable by links; copy_of: smallest doc_id with the same set of runs; kept: whether the
    row is the one that stays of its class (a repeated row with its repeats).
    """
    return judged(docs).drop("th")


def text_hash() -> Column:
    """Tells the rows of one doc_id apart; null for a null text."""
    return F.when(F.col("text").isNotNull(), F.xxhash64("text"))


def judged(docs: DataFrame) -> DataFrame:
    """The rows of `jaccard_join` with `th`, the text_hash of the row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("th", text_hash())
    texts = rows.where("doc_id is not null and text is not null")
    sketches = saved(texts.mapInPandas(sketch, "doc_id long, th long, size int, fx long, fy long, sketch binary, bands array<long>"))
    # the vertex is the set; its text is one that the smallest doc_id with this set has
    keys, at = ["fx", "fy", "size"], F.struct("doc_id", "th")
    per_set = sketches.groupBy(*keys).agg(F.min(at).alias("at"), F.count("*").alias("weight"), F.min_by(F.struct("sketch", "bands"), at).alias("s"))
    per_set = per_set.select(*keys, "weight", F.col("at.doc_id").alias("rep"), F.col("at.th").alias("th"), "s.*")
    heads = saved(positions(per_set, [], ["rep", *keys], name="id"))
    buckets = saved(heads.select(F.explode("bands").alias("key"), "id"))
    groups = clusters(buckets, heads.select("id", "sketch"), plausible)
    members = heads.join(groups.hint("merge"), heads["id"] == groups["v"]).select("root", "id", "rep", "weight", "sketch", "th")
    own = texts.select(F.col("doc_id").alias("of"), F.col("th").alias("h"), "text")
    # only texts of clusters travel; a repeated row gives its vertex twice
    members = saved(members.join(own.hint("merge"), (members["rep"] == F.col("of")) & (members["th"] == F.col("h"))).drop("of", "h", "rep", "th").dropDuplicates(["id"]))
    found = settled(linked(members, comparisons()))
    # a class is named by the doc_id of its first vertex, the smallest of all its rows
    found = with_root_rep(found, heads).select(F.col("id").alias("fid"), "n_links", "root", F.col("rep").alias("class_id"))
    per = heads.select("id", "fx", "fy", "size", "rep", "weight", "th").join(found.hint("merge"), F.col("id") == F.col("fid"), "left")
    stays = F.when(F.coalesce("root", "id") == F.col("id"), F.col("th")).alias("stays")
    per = per.select(*keys, "weight", "rep", stays, (F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("class_id", "rep").alias("class_id"))
    per = saved(per)
    of = with_facts(sketches.select("doc_id", "th", *keys), per, keys, "weight", ["rep", "stays", "n_links", "class_id"])
    of = of.groupBy(F.col("doc_id").alias("of"), F.col("th").alias("h")).agg(F.min("class_id").alias("class_id"), F.max("n_links").alias("n_links"), F.min("rep").alias("rep"), F.min("stays").alias("stays"))
    out = rows.select("doc_id", "th").join(of.hint("merge"), (F.col("doc_id") == F.col("of")) & (F.col("th") == F.col("h")), "left")
    kept = F.col("of").isNull() | ((F.col("doc_id") == F.col("class_id")) & F.coalesce(F.col("th") == F.col("stays"), F.lit(False)))
    return out.select("doc_id", "th", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("rep", "doc_id").alias("copy_of"), kept.alias("kept"))


def least_band_recall(threshold: float = THRESHOLD) -> float:
    return 1 - math.pow(1 - threshold**ROWS, BANDS)
