"""Embedding near-duplicates by randomised-rotation binary codes with stored correction factors.

A vector is rotated at random and kept as the signs of its coordinates, one bit each; short vectors are
rotated several times, up to BITS bits. With the code two factors are stored: the mean inner product of
the rotated vector with its own sign vector, and the width of the error that follows from it. The sign
vector times a rotated query over the first factor is an unbiased estimate of the inner product, and
the second one times the SPREAD is its confidence bound.

1. Buckets: further random rotations name a vector by its greatest coordinate and that one's sign; a
   few such names are a bucket key. A pair right at the threshold misses all buckets with a chance of
   MISS; the number of buckets a vector is in grows with about the eighth root of the vectors.
2. In a bucket the stored codes alone decide: the share of differing bits is an unbiased estimate of the
   angle, and pairs beyond its confidence bound at the threshold are dropped.
3. In the clusters of what is left, estimate and bound decide which pairs are recomputed exactly: a pair
   whose upper bound stays below the threshold is dropped, all others are computed in doubles.

Nulls, zero vectors, and vectors with null or non-finite components link with nothing and stay their
own component; so do rows with a null label or vec_id. Every row counts as a vector of its own: copies
of a vector, in one label, are one vertex with a weight, and rows that repeat a vec_id with the same or
another vector are linked like all others, each with the links of its vector. Vectors of different
lengths are never compared, and a vector may have any length. A cosine of exactly the threshold is a
link. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionforge.llm.common import positions, saved, with_facts
from sessionforge.llm.linking import Exact, clusters, linked, settled, with_root_rep

#: Chance that a pair right at the threshold shares no bucket, and that its codes differ in too many bits.
MISS = 1e-5
#: Bits of a code at least; more if vectors are longer.
BITS = 256
#: Width of the bound on an estimate, in standard deviations of a coordinate of a random unit vector.
SPREAD = 5.0


def rotations(dim: int, n: int, seed: int = 11) -> np.ndarray:
    """n random orthogonal matrices of dim x dim."""
    rng = np.random.default_rng([seed, dim])
    return np.stack([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(n)]).astype("float32")


def same_corner(dim: int, threshold: float, n: int = 20_000) -> float:
    """Chance that two unit vectors at the threshold have their greatest of dim coordinates in common, sign included.

    By trial on n pairs with a fixed seed, less two standard deviations.
    """
    rng = np.random.default_rng([7, dim])
    u = rng.standard_normal((n, dim))
    v = threshold * u + math.sqrt(1 - threshold**2) * rng.standard_normal((n, dim))
    i, j = np.abs(u).argmax(1), np.abs(v).argmax(1)
    at = np.arange(n)
    p = ((i == j) & (np.sign(u[at, i]) == np.sign(v[at, j]))).mean()
    return float(max(p - 2 * math.sqrt(p * (1 - p) / n), 1e-3))


def tables_for(dim: int, threshold: float, n: int) -> tuple[list[int], int]:
    """Coordinates of each of a key's names, and bucket tables, for n vectors of one length.

    Names are added until there are twice as many keys as vectors; the last one may look at fewer
    coordinates than there are.
    """
    widths, cells = [], 1
    while cells < 2 * n and len(widths) < 24:
        width = dim
        while width > 2 and cells * width >= 2 * n:  # half the coordinates are enough
            width //= 2
        widths.append(width)
        cells *= 2 * width
    p = math.prod(same_corner(w, threshold) if w > 1 else 1 - math.acos(threshold) / math.pi for w in widths)
    return widths, 1 if p >= 1 else max(1, math.ceil(math.log(MISS) / math.log1p(-p)))


def most_differing(dim: int, threshold: float) -> int:
    """Bits in which codes of a pair at the threshold differ at most, but for a chance of MISS."""
    p, left, bits = math.acos(threshold) / math.pi, 1.0, dim * math.ceil(BITS / dim)
    for k in range(bits + 1):
        left -= math.exp(math.lgamma(bits + 1) - math.lgamma(k + 1) - math.lgamma(bits - k + 1) + k * math.log(p) + (bits - k) * math.log1p(-p))
        if left < MISS:
            # bits of rotations of so short a vector aren't independent: let all pass
            return k if dim >= 8 else bits
    return bits


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype("float64")
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def turned(x: np.ndarray) -> np.ndarray:
    """Unit vectors under all rotations of the code, one behind the other."""
    dim = x.shape[1]
    return x @ rotations(dim, math.ceil(BITS / dim)).reshape(-1, dim).T.astype(x.dtype)


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, factors and widths of unit vectors."""
    dim, y = x.shape[1], turned(x)
    f = np.abs(y).reshape(len(x), -1, dim).sum(axis=2) / math.sqrt(dim)
    return np.packbits(y >= 0, axis=1), f.mean(axis=1), np.sqrt(np.maximum(0, 1 - f**2).sum(axis=1)) / f.sum(axis=1)


def estimate(signs: np.ndarray, factor: np.ndarray, width: np.ndarray, query: np.ndarray, dim: int, spread: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of coded unit vectors (rows of +-1) and turned unit queries (columns), and error bounds.

    With f the factor of a rotation, the error of its part is sqrt(1-f^2) * sqrt(1-s^2) * t, where s is
    the true value and t a coordinate of a random unit vector of dim-1; the parts' errors add up like
    independent ones. The bound is given for s = 0, the worst case; callers scale it to the s they ask about.
    """
    est = (signs @ query.T) * (math.sqrt(dim) / query.shape[1] / factor[:, None])
    return est, np.broadcast_to((width * spread / math.sqrt(max(1, dim - 1)))[:, None], est.shape)


def near_pairs(left: np.ndarray, codes: np.ndarray, factor: np.ndarray, width: np.ndarray, right: np.ndarray, threshold: float, spread: float = SPREAD) -> np.ndarray:
    """Boolean matrix of pairs of unit vectors with cosine >= threshold; left has stored codes (packed) and factors."""
    query = turned(right.astype("float32"))
    signs = np.unpackbits(codes, axis=1, count=query.shape[1]).astype("float32") * 2 - 1
    est, wide = estimate(signs, factor, width, query, left.shape[1], spread)
    # at a true value of at least the threshold the error is at most wide * sqrt(1 - threshold^2)
    i, j = np.nonzero(est + wide * math.sqrt(max(0.0, 1 - threshold**2)) + 1e-5 >= threshold)
    out = np.zeros(est.shape, bool)
    for a in range(0, len(i), 100_000):
        x, y = i[a : a + 100_000], j[a : a + 100_000]
        out[x, y] = (left[x] * right[y]).sum(axis=1) >= threshold
    return out


def valid(df: DataFrame) -> DataFrame:
    e = F.col("embedding")
    fine = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return df.where(e.isNotNull() & (F.size(e) > 0) & F.coalesce(fine, F.lit(False)) & F.exists(e, lambda v: v != 0))


def vectors_of(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def stored(threshold: float, most: dict[int, int]):
    """Adds to batches of (id, label, weight, dim, embedding) what is stored of each vector: unit vector, code, factor, bucket names.

    most: the greatest number of vectors of one label, by their length.
    """
    plans: dict[int, tuple] = {}

    def names(x: np.ndarray, dim: int) -> np.ndarray:
        if dim not in plans:
            widths, n = tables_for(dim, threshold, most[dim])
            plans[dim] = (widths, rotations(dim, n * len(widths), seed=5).reshape(n, len(widths), dim, dim))
        widths, turns = plans[dim]
        out = np.zeros((len(x), len(turns)), "int64")
        for t, turn in enumerate(turns):
            for w, r in zip(widths, turn, strict=True):
                y = x @ r[:w].T
                at = np.abs(y).argmax(axis=1)
                with np.errstate(over="ignore"):
                    out[:, t] = out[:, t] * (2 * w) + at * 2 + (y[np.arange(len(y)), at] >= 0)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            dims = whole.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                of_dim = whole.filter(pa.array(dims == dim))
                for a in range(0, of_dim.num_rows, 2000):
                    b = of_dim.slice(a, 2000)
                    x = unit(vectors_of(b.column("embedding")))
                    codes, factor, width = coded(x)
                    keys = names(x.astype("float32"), dim)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "id": b.column("id"), "label": b.column("label"), "weight": b.column("weight"), "dim": b.column("dim"),
                            "vector": pa.array([v.tobytes() for v in x], pa.binary()), "code": pa.array([c.tobytes() for c in codes], pa.binary()), "factor": pa.array(factor), "width": pa.array(width),
                            "names": pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1]), pa.int32()), pa.array(keys.ravel())),
                        }
                    )

    return run


def comparisons(threshold: float) -> Exact:
    def parts(rows: pd.DataFrame, dim: int) -> tuple[np.ndarray, ...]:
        x = np.frombuffer(b"".join(rows["vector"]), "float64").reshape(len(rows), dim)
        return x, np.frombuffer(b"".join(rows["code"]), "uint8").reshape(len(rows), -1), rows["factor"].to_numpy(), rows["width"].to_numpy()

    def links(left: pd.DataFrame, right: pd.DataFrame | None) -> np.ndarray:
        right = left if right is None else right
        out = np.zeros((len(left), len(right)), bool)
        lk, rk = (list(zip(s["dim"], s["label"], strict=True)) for s in (left, right))
        for dim, label in sorted(set(lk) & set(rk)):
            x, y = (np.array([i for i, k in enumerate(s) if k == (dim, label)]) for s in (lk, rk))
            out[np.ix_(x, y)] = near_pairs(*parts(left.iloc[x], dim), parts(right.iloc[y], dim)[0], threshold)
        return out

    def centre(rows: pd.DataFrame) -> tuple[bytes, dict]:
        dim, label = rows["dim"].iat[0], rows["label"].iat[0]
        x = parts(rows[(rows["dim"] == dim) & (rows["label"] == label)], dim)[0]
        mean = x.mean(axis=0)
        return (mean if np.abs(mean).max() > 1e-9 else x[0]).tobytes(), {"dim": dim, "label": label}

    def close(rows: pd.DataFrame, head: pd.Series) -> np.ndarray:
        out = ((rows["dim"] == head["dim"]) & (rows["label"] == head["label"])).to_numpy()
        c = unit(np.frombuffer(head["centre"], "float64")[None])[0]
        half = math.cos(math.acos(threshold) / 2) + 1e-7  # two of half the angle are surely within the angle
        if out.any():
            out[out] = parts(rows[out], head["dim"])[0] @ c >= half
        return out

    return Exact({"label": "string", "dim": "int", "vector": "binary", "code": "binary", "factor": "double", "width": "double"}, links, centre, close)


def near_duplicate_vectors(df: DataFrame, threshold: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of all rows of df (vec_id, embedding, label)."""
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    live = valid(rows).where("label is not null and vec_id is not null").withColumn("vkey", F.xxhash64("label", "embedding"))
    copies = live.groupBy("vkey", "label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    # vertices are numbered by their smallest vec_id: the first of a component has its smallest
    vertices = positions(copies.withColumn("dim", F.size("embedding")), [], ["rep", "vkey"], name="id")
    groups = vertices.groupBy("label", "dim").agg(F.count("*").alias("n")).groupBy("dim").agg(F.max("n").alias("n")).collect()  # a row a length
    run = stored(threshold, {r["dim"]: r["n"] for r in groups})
    kept = saved(vertices.select("id", "label", "weight", "dim", "embedding").mapInArrow(run, "id long, label string, weight long, dim int, vector binary, code binary, factor double, width double, names array<long>"))
    buckets = saved(kept.select("id", "label", "dim", F.posexplode("names").alias("t", "name")).select(F.xxhash64("label", "dim", "t", "name").alias("key"), "id"))
    limits = {r["dim"]: most_differing(r["dim"], threshold) for r in groups}

    def plausible(s: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        dims = np.ascontiguousarray(s[i, :4]).view("<i4")[:, 0]
        most = np.zeros(len(i), int)
        for dim in np.unique(dims).tolist():
            most[dims == dim] = limits[dim]
        return np.bitwise_count(s[i, 4:] ^ s[j, 4:]).sum(axis=1) <= most

    # the sketch is the length, in four bytes, and the code; all of a bucket are equally long
    length = F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright("dim", 8 * k).bitwiseAND(255)), 2, "0") for k in range(4)]))
    found = clusters(buckets, kept.select("id", F.concat(length, "code").alias("sketch")), plausible)
    exact = comparisons(threshold)
    members = saved(kept.join(found.hint("merge"), kept["id"] == found["v"]).select("root", "id", "weight", *exact.columns))
    links = settled(linked(members, exact))
    # back from vertices to rows: a copy has its vertex's links, and one for each other copy
    links = with_root_rep(links, vertices).select(F.col("id").alias("lid"), F.col("n_links").alias("n"), F.col("rep").alias("component_id"))
    facts = vertices.join(links.hint("merge"), F.col("id") == F.col("lid"), "left")
    facts = saved(facts.select("vkey", "label", "embedding", "weight", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id")))
    keyed = rows.withColumn("vkey", F.when(F.col("vec_id").isNotNull(), F.xxhash64("label", "embedding")))
    out = with_facts(keyed, facts, ["vkey", "label", "embedding"], "weight", ["n_links", "component_id"])
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
