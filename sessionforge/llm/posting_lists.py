"""Approximate nearest neighbours over balanced posting lists.

There are 4 sqrt(n) lists for n vectors, in cells of about PER_CELL lists. The cells' centroids are fitted
on the driver on SAMPLE rows by splitting the fullest cluster again and again until all are about equally
full; the lists of a cell are fitted so in a task, on CELL_SAMPLE of its vectors at most. Samples are taken
by hash. A graph over the cells' centroids is held in memory by every task, one over a cell's lists by the
tasks that have the cell; both are walked best-first. A vector goes to its CELL_COPIES nearest cells and there to its near
lists: every distinct vector is indexed, in its nearest list and, as a boundary vector, in the lists whose
distance is within `closure` of the nearest one, `max_copies` at most. A query goes to the PROBE sqrt(cells)
nearest cells, MOST_CELLS at most; of the PROBE sqrt(lists) nearest lists found there, `most_probes` at most,
those whose distance is within the ratio `prune` of the best are read. So what the driver fits and what is
broadcast are a few thousand cells for 10^10 vectors, whatever a cell holds. Lists and the queries
that read them are both cut into blocks of bounded size; a task gives the best k of each query in its
blocks, and the best k of those are the answer. A query whose lists hold fewer than k others is held
against all vectors, in blocks.

Nearness is the largest inner product: an extra coordinate makes all indexed vectors equally long, so
that it becomes the smallest distance; scores are computed in doubles on the original vectors. Copies
of a vector are indexed once with the k + 1 smallest of their ids, all that can reach an answer.
Vectors of each length have an index of their own, and are answered from vectors as long. Vectors that
are null, zero or hold null or non-finite components take no part, nor do rows without a vec_id. A
vec_id that appears again counts once, with the vector of smallest hash. Equal scores go to the
smaller vec_id. A query with fewer than k others of its length gets all of them; an empty table gives
no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from sessionforge.llm.binary_codes import valid, vectors_of
from sessionforge.llm.common import n_shuffled, saved
from sessionforge.llm.linking import grouped

#: Rows of the sample that the cells of one length of vectors are fitted on; of the lists' sample for each list, and of one cell at most.
SAMPLE, SAMPLE_PER_LIST, CELL_SAMPLE = 20_000, 24, 8_192
#: Cells that a vector goes to at most.
CELL_COPIES = 2
#: Lists of a cell on average (a cell that holds more vectors has up to four times as many), cells a query looks at at most, and vectors of a cell that one task places.
PER_CELL, MOST_CELLS, CELL_BLOCK = 256, 32, 20_000
#: Lists for n vectors: LISTS * sqrt(n), of LIST_SIZE vectors at least; lists a query looks at: PROBE * sqrt(lists).
LISTS, LIST_SIZE, PROBE = 4.0, 32, 3.0
#: Postings of a block of a list, and queries of a block.
BLOCK, QUERY_BLOCK = 4_000, 1_000
#: Found rows that a task holds before it cuts them down to the best of each query.
HELD = 400_000


def n_lists(n: int) -> int:
    return max(1, min(n // LIST_SIZE, int(LISTS * math.sqrt(n))))


def balanced_centroids(x: np.ndarray, lists: int, seed: int = 3) -> np.ndarray:
    """Splits the fullest cluster at the median of its projection on a two-means direction until there are as many as lists."""
    rng = np.random.default_rng(seed)
    heap, k = [(-len(x), 0, np.arange(len(x)))], 1
    while len(heap) < lists and -heap[0][0] >= 2:
        _, _, rows = heapq.heappop(heap)
        part = x[rows]
        a, b = part[rng.integers(len(part))], part[rng.integers(len(part))]
        for _ in range(4):
            nearer = ((part - a) ** 2).sum(1) <= ((part - b) ** 2).sum(1)
            if nearer.all() or not nearer.any():
                break
            a, b = part[nearer].mean(0), part[~nearer].mean(0)
        order = np.argsort(part @ (b - a), kind="stable")
        half = len(rows) // 2
        for piece in (rows[order[:half]], rows[order[half:]]):
            heapq.heappush(heap, (-len(piece), k, piece))
            k += 1
    return np.stack([x[rows].mean(0) for _, _, rows in sorted(heap, key=lambda t: t[1])])


def neighbour_graph(c: np.ndarray, degree: int = 24, links: int = 4, seed: int = 4, cells: int = 20_000_000) -> np.ndarray:
    """For each centroid its nearest ones, and some at random so that the graph hangs together; `cells` distances at a time."""
    degree, squares, near = min(degree, max(1, len(c) - 1)), (c**2).sum(1), []
    step = max(1, cells // len(c))
    for a in range(0, len(c), step):
        d = squares[None, :] - 2 * c[a : a + step] @ c.T
        d[np.arange(len(d)), a + np.arange(len(d))] = np.inf
        near.append(np.argpartition(d, min(degree, d.shape[1] - 1), axis=1)[:, :degree])
    far = np.random.default_rng(seed).integers(0, len(c), (len(c), links))
    return np.concatenate([np.concatenate(near), far], axis=1).astype("int32")


def walk(c: np.ndarray, graph: np.ndarray, q: np.ndarray, n: int, at_once: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The n nearest centroids of each query that a best-first walk of the graph finds, nearest first, and their distances.

    Each query starts at the best of sqrt(len(c)) centroids spread over all. It keeps its n best and
    goes on from the `at_once` nearest of them that it has not left yet, until it has left all of them.
    """
    rows, n = len(q), min(n, len(c))

    def dist(r: np.ndarray, i: np.ndarray) -> np.ndarray:
        return ((c[i] - q[r]) ** 2).sum(1)

    entries = np.unique(np.linspace(0, len(c) - 1, max(16, math.isqrt(len(c)))).astype(int))
    d = (q**2).sum(1)[:, None] - 2 * q @ c[entries].T + (c[entries] ** 2).sum(1)[None]
    first = np.argsort(d, axis=1)[:, : min(n, 4)]
    best, far, left = np.full((rows, n), -1), np.full((rows, n), np.inf), np.ones((rows, n), bool)
    k = first.shape[1]
    best[:, :k], left[:, :k] = entries[first], False
    far[:, :k] = dist(np.repeat(np.arange(rows), k), best[:, :k].ravel()).reshape(rows, k)
    seen = np.zeros((rows, len(c)), bool)
    np.put_along_axis(seen, best[:, :k], True, axis=1)
    live = np.arange(rows)
    while len(live):
        ahead = np.where(left[live], np.inf, far[live])
        pick = np.argsort(ahead, axis=1)[:, :at_once]
        fine = np.isfinite(np.take_along_axis(ahead, pick, axis=1))
        live, pick, fine = live[fine[:, 0]], pick[fine[:, 0]], fine[fine[:, 0]]
        if not len(live):
            break
        left[live[:, None], pick] = True
        r = np.repeat(live, pick.shape[1] * graph.shape[1])[np.repeat(fine.ravel(), graph.shape[1])]
        i = graph[best[live[:, None], pick][fine]].ravel()
        new = ~seen[r, i]
        pairs = np.unique(r[new] * np.int64(len(c)) + i[new])
        r, i = pairs // len(c), pairs % len(c)
        seen[r, i] = True
        d = dist(r, i)
        # the new ones stand behind the row's own best, as many columns as the row with most has
        at = np.searchsorted(live, r)
        count = np.bincount(at, minlength=len(live))
        place = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
        wide_d, wide_i = np.full((len(live), n + count.max(initial=0)), np.inf), np.full((len(live), n + count.max(initial=0)), -1)
        wide_l = np.ones(wide_d.shape, bool)
        wide_d[:, :n], wide_i[:, :n], wide_l[:, :n] = far[live], best[live], left[live]
        wide_d[at, n + place], wide_i[at, n + place], wide_l[at, n + place] = d, i, False
        keep = np.argsort(wide_d, axis=1)[:, :n]
        far[live], best[live], left[live] = (np.take_along_axis(w, keep, axis=1) for w in (wide_d, wide_i, wide_l))
    return best, np.sqrt(far)


def within(d: np.ndarray, ratio: float) -> np.ndarray:
    """Which distances, nearest first, are within the ratio of the first."""
    return np.isfinite(d) & (d <= d[:, :1] * (1 + ratio) + 1e-12)


class Lists:
    """The centroids of one length, their graph, and how vectors of this length are lifted; `parts` are plain data."""

    def __init__(self, centroids: np.ndarray, graph: np.ndarray, scale: float, longest: float):
        self.centroids, self.graph, self.scale, self.longest = centroids, graph, scale, longest
        self.parts = (centroids, graph, scale, longest)

    @classmethod
    def fitted(cls, sample: np.ndarray, lists: int, scale: float, longest: float) -> Lists:
        """So many lists, fitted on a sample; scale: the vectors' greatest component, longest: the greatest square of a length, in its units."""
        blank = cls(np.zeros((1, sample.shape[1] + 1), "float32"), np.zeros((1, 1), "int32"), scale, longest)
        if not len(sample):
            return blank
        centroids = balanced_centroids(blank.lifted(sample), lists)
        return cls(centroids, neighbour_graph(centroids), scale, longest)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        x = x / self.scale
        return np.concatenate([x, np.sqrt(np.maximum(0, self.longest - (x * x).sum(1)))[:, None]], axis=1).astype("float32")

    def asking(self, x: np.ndarray) -> np.ndarray:
        """Queries made as long as the longest vector, so that ratios compare."""
        x = x / np.abs(x).max(axis=1, keepdims=True)
        q = np.concatenate([x * (math.sqrt(self.longest) / np.sqrt((x * x).sum(1)))[:, None], np.zeros((len(x), 1))], axis=1)
        return q.astype("float32")

    def of_vectors(self, x: np.ndarray, copies: int, closure: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, list, distance) of each posting."""
        return self._near(self.lifted(x), copies, closure)

    def of_queries(self, x: np.ndarray, most: int, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, list, distance) of each list that a query reads."""
        return self._near(self.asking(x), min(most, probes(len(self.centroids))), ratio)

    def _near(self, q: np.ndarray, n: int, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(self.centroids) == 1:
            return np.arange(len(q)), np.zeros(len(q), int), np.sqrt(((q - self.centroids) ** 2).sum(1)).astype("float64")
        found = [walk(self.centroids, self.graph, q[a : a + 512], n) for a in range(0, len(q), 512)]
        best, d = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        row, place = np.nonzero(within(d, ratio))
        return row, best[row, place], d[row, place].astype("float64")


def probes(lists: int) -> int:
    return math.ceil(PROBE * math.sqrt(lists))


class Cells:
    """The cells of one length, and for each how many lists it is to have and how many tasks place its vectors; `parts` are plain data."""

    def __init__(self, top: tuple, lists: np.ndarray, tasks: np.ndarray):
        self.top, self.lists, self.tasks = Lists(*top), lists, tasks
        self.parts = (top, lists, tasks)

    @classmethod
    def fitted(cls, sample: np.ndarray, n: int, scale: float, longest: float, copies: int) -> Cells:
        """Fitted on a sample of n vectors, each of which goes to so many cells at most."""
        top = Lists.fitted(sample, math.ceil(n_lists(n) / PER_CELL), scale, longest)
        share = np.ones(1)
        if len(top.centroids) > 1:
            share = np.bincount(top.of_vectors(sample, 1, 0.0)[1], minlength=len(top.centroids)) / len(sample)
        lists = np.clip(np.rint(share * n_lists(n)), 1, 4 * PER_CELL).astype(int)
        return cls(top.parts, lists, np.maximum(1, np.ceil(share * n * min(copies, len(share)) / CELL_BLOCK)).astype(int))


def score(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products along the last axis, in doubles, summed in order: equal rows get equal values wherever they stand."""
    return np.cumsum(x * q, axis=-1)[..., -1]


def best_of(query: np.ndarray, vec: np.ndarray, value: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best different vectors of each query, ties to the smaller."""
    order = np.lexsort((vec, -value, query))
    q, v = query[order], vec[order]
    same = np.zeros(len(q), bool)
    same[1:] = (q[1:] == q[:-1]) & (v[1:] == v[:-1])  # a vector found in several lists has equal scores
    order, q = order[~same], q[~same]
    start = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
    place = np.arange(len(q)) - np.maximum.accumulate(np.where(start, np.arange(len(q)), 0))
    return order[place < k]


def searched(rows: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the best k of every query in each task; rows: (dim, list, block, qblock, kind, id, ids, embedding).

    kind 0 are postings with their ids, kind 1 queries; those of one (dim, list, block, qblock) meet.
    """

    def meet(posted: pd.DataFrame, asking: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, q = (np.stack(list(s["embedding"])).astype("float64") for s in (posted, asking))
        n = [len(i) for i in posted["ids"]]
        ids, ends = np.concatenate(list(posted["ids"])), np.cumsum(n)
        fast = q @ x.T
        # copies stand for several ids and the query's own vector counts once less, so k + 1 distinct vectors are enough
        cut = np.partition(fast, -(k + 1), axis=1)[:, -(k + 1)] if len(x) > k + 1 else np.full(len(q), -np.inf)
        i, j = np.nonzero(fast >= (cut - 1e-9 * (1 + np.abs(cut)))[:, None])
        s = np.concatenate([score(x[j[a : a + 50_000]], q[i[a : a + 50_000]]) for a in range(0, len(i), 50_000)]) if len(i) else np.empty(0)
        times = np.array(n)[j]
        inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        vec = ids[np.repeat((ends - n)[j], times) + inner]
        query = np.repeat(asking["id"].to_numpy()[i], times)
        other = vec != query
        return query[other], vec[other], np.repeat(s, times)[other]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []

        def cut_down() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            query, vec, value = (np.concatenate([h[i] for h in held]) for i in range(3))
            keep = best_of(query, vec, value, k)
            return query[keep], vec[keep], value[keep]

        def frame() -> pd.DataFrame:
            return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), held[0], strict=True)))

        for g in grouped(batches, ["dim", "list", "block", "qblock"]):
            posted, asking = g[g["kind"] == 0], g[g["kind"] == 1]
            if len(posted) and len(asking):
                held.append(meet(posted, asking))
                if sum(len(h[0]) for h in held) > HELD:
                    held = [cut_down()]
                    if len(held[0][0]) > HELD // 2:
                        yield frame()
                        held = []
        if held:
            held = [cut_down()]
            yield frame()

    keys = ["dim", "list", "block", "qblock"]
    return rows.repartition(n_shuffled(rows.sparkSession), *keys).sortWithinPartitions(*keys, "kind", "id").mapInPandas(run, "query_id long, vec_id long, score double")


def nearest(df: DataFrame, every: int = 20, k: int = 20, closure: float = 0.12, max_copies: int = 8, most_probes: int = 96, prune: float = 0.15) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of df (vec_id, embedding) whose vec_id is divisible by `every`."""
    found = _answers(df, every, k, closure, max_copies, most_probes, prune)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _answers(df: DataFrame, every: int, k: int, closure: float, max_copies: int, most_probes: int, prune: float) -> DataFrame:
    spark = df.sparkSession
    floats = isinstance(df.schema["embedding"].dataType, T.ArrayType) and isinstance(df.schema["embedding"].dataType.elementType, T.FloatType)
    kind = "float" if floats else "double"
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding")).where("vec_id is not null")
    live = valid(rows).groupBy("vec_id").agg(F.min_by("embedding", F.xxhash64("embedding")).alias("embedding")).withColumn("dim", F.size("embedding"))
    live = saved(live)
    # the k + 1 smallest ids of each vector: ids are taken round by round, no group of copies is ever gathered
    ranked = live.withColumn("h", F.xxhash64("embedding"))
    small = ranked.withColumn("n", F.row_number().over(W.partitionBy("h", "embedding", F.pmod("vec_id", F.lit(64))).orderBy("vec_id"))).where(F.col("n") <= k + 1)
    small = small.withColumn("n", F.row_number().over(W.partitionBy("h", "embedding").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    distinct = saved(small.groupBy("h", "dim", "embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.element_at("ids", 1).alias("id"), "dim", "ids", "embedding"))

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                x = vectors_of(b.filter(pa.array(dims == dim)).column("embedding")).astype("float64")
                yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "n": pa.array([len(x)]), "scale": pa.array([float(np.abs(x).max())])})

    facts = {r["dim"]: r for r in distinct.select("dim", "embedding").mapInArrow(lengths, "dim int, n long, scale double").groupBy("dim").agg(F.sum("n").alias("n"), F.max("scale").alias("scale")).collect()}  # a row a length
    def share_of(want) -> Column:
        share = F.lit(1.0)
        for dim, f in facts.items():
            share = F.when(F.col("dim") == dim, min(1.0, want(f["n"]) / f["n"])).otherwise(share)
        return share

    dice = lambda seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(2**31)) / 2**31
    drawn = distinct.where(dice(4) < share_of(lambda n: SAMPLE)).select("dim", "embedding").toArrow().combine_chunks()
    index = {}
    for dim, f in facts.items():
        mine = drawn.filter(pa.compute.equal(drawn["dim"], dim))["embedding"].combine_chunks()
        x = vectors_of(mine if isinstance(mine, pa.Array) else mine.chunk(0)).astype("float64") if len(mine) else np.empty((0, dim))
        longest = float(((x / f["scale"]) ** 2).sum(1).max(initial=0)) * 1.05  # what is longer still is not lifted
        index[dim] = Cells.fitted(x, f["n"], f["scale"], longest or 1.0, CELL_COPIES).parts
    held = spark.sparkContext.broadcast(index)  # n_lists / PER_CELL centroids
    lists = sum(int(parts[1].sum()) for parts in index.values())

    def routed(get, key: str):
        """(dim, cell, task, id, embedding) of the vectors of each batch, for each cell that `get` names."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                dims = b.column("dim").to_numpy()
                for dim in np.unique(dims).tolist():
                    part, cells = b.filter(pa.array(dims == dim)), Cells(*held.value[dim])
                    row, cell, _ = get(cells, vectors_of(part.column("embedding")).astype("float64"))
                    ids = part.column(key).to_numpy()[row]
                    task = (ids // every if key == "vec_id" else ids) % cells.tasks[cell]  # queries are multiples of every
                    for a in range(0, len(row), 10_000):
                        at = slice(a, a + 10_000)
                        cols = {"dim": pa.array(np.full(len(row[at]), dim, "int32")), "cell": pa.array(cell[at].astype("int32")), "task": pa.array(task[at].astype("int32")), "id": pa.array(ids[at])}
                        yield pa.RecordBatch.from_pydict({**cols, "embedding": part.column("embedding").take(pa.array(row[at]))})

        return run

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        dim, cell = key
        cells = Cells(*held.value[dim])
        x = np.stack(list(rows.sort_values("id")["embedding"])).astype("float64")
        mine = Lists.fitted(x, int(cells.lists[cell]), cells.top.scale, cells.top.longest)
        out = {"dim": dim, "cell": cell, "n_tasks": int(cells.tasks[cell]), "centroids": mine.centroids.tobytes(), "graph": mine.graph.tobytes()}
        return pd.DataFrame([out])

    shape = f"dim int, cell int, task int, id long, embedding array<{kind}>"
    want = lambda n: max(SAMPLE_PER_LIST * n_lists(n), CELL_SAMPLE)
    near = distinct.where(dice(5) < share_of(want)).select("id", "dim", "embedding").mapInArrow(routed(lambda c, x: c.top.of_vectors(x, 1, 0.0), "id"), shape)
    first = F.row_number().over(W.partitionBy("dim", "cell").orderBy(F.xxhash64("id", F.lit(6)), "id"))
    fits = saved(near.withColumn("n", first).where(F.col("n") <= CELL_SAMPLE).groupBy("dim", "cell").applyInPandas(fit, "dim int, cell int, n_tasks int, centroids binary, graph binary"))

    def placed(vectors: DataFrame, get) -> DataFrame:
        """(id, dim, list, far): the lists that `get` finds for each vector in its cells."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            now, mine = None, None
            for b in batches:
                for key, part in b.groupby(["dim", "cell", "task"], sort=False):
                    if key != now:  # a cell's lists stand ahead of its vectors; one without any is a single list
                        top = Cells(*held.value[key[0]]).top
                        now, mine = key, Lists(top.centroids[key[1] : key[1] + 1], None, top.scale, top.longest)
                    told, rest = part[part["embedding"].isna()], part[part["embedding"].notna()]
                    if len(told):
                        c, g = told.iloc[0][["centroids", "graph"]]
                        c = np.frombuffer(c, "float32").reshape(-1, key[0] + 1)
                        mine = Lists(c, np.frombuffer(g, "int32").reshape(len(c), -1), mine.scale, mine.longest)
                    if len(rest):
                        row, at, far = get(mine, np.stack(list(rest["embedding"])).astype("float64"))
                        yield pd.DataFrame({"id": rest["id"].to_numpy()[row], "dim": key[0], "list": key[1] * 4 * PER_CELL + at, "far": far})

        none, keys = F.lit(None).cast("binary"), ["dim", "cell", "task"]
        told = fits.select("dim", "cell", F.explode(F.sequence(F.lit(0), F.col("n_tasks") - 1)).alias("task"), F.lit(-1).cast("long").alias("id"), F.lit(None).cast(f"array<{kind}>").alias("embedding"), "centroids", "graph", F.lit(0).alias("last"))
        both = told.union(vectors.select(*keys, "id", "embedding", none, none, F.lit(1)))
        return both.repartition(n_shuffled(spark), *keys).sortWithinPartitions(*keys, "last").mapInPandas(run, "id long, dim int, list int, far double")

    def nearest_lists(rows: DataFrame, most: Column, ratio: float, name: str) -> DataFrame:
        w = W.partitionBy("id", "dim").orderBy("far", "list")
        rows = rows.withColumns({"n": F.row_number().over(w), "best": F.first("far").over(w)})
        return saved(rows.where((F.col("n") <= most) & (F.col("far") <= F.col("best") * (1 + ratio) + 1e-12)).select(F.col("id").alias(name), "dim", "list"))

    posted = distinct.select("id", "dim", "embedding").mapInArrow(routed(lambda c, x: c.top.of_vectors(x, CELL_COPIES, closure), "id"), shape)
    posted = nearest_lists(placed(posted, lambda i, x: i.of_vectors(x, max_copies, closure)), F.lit(max_copies), closure, "id")
    queries = live.where(F.pmod("vec_id", F.lit(every)) == 0)
    most = F.lit(1)
    for dim, parts in index.items():
        most = F.when(F.col("dim") == dim, min(most_probes, probes(int(parts[1].sum())))).otherwise(most)
    asked = queries.select("vec_id", "dim", "embedding").mapInArrow(routed(lambda c, x: c.top.of_queries(x, MOST_CELLS, math.inf), "vec_id"), shape)
    asked = nearest_lists(placed(asked, lambda i, x: i.of_queries(x, most_probes, prune)), most, prune, "vec_id")
    n_blocks = posted.groupBy("dim", "list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_blocks"))
    n_asked = asked.groupBy(F.col("dim").alias("d"), F.col("list").alias("l")).agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("n_qblocks"))
    cuts = saved(n_blocks.join(n_asked.hint("shuffle_hash"), (F.col("dim") == F.col("d")) & (F.col("list") == F.col("l"))).select("d", "l", "n_blocks", "n_qblocks"))
    cuts = cuts.hint("broadcast" if lists <= 1_000_000 else "merge")  # a row a list
    on = (F.col("dim") == F.col("d")) & (F.col("list") == F.col("l"))
    dealt = lambda i, n: F.pmod(F.xxhash64(i), F.col(n)).cast("int")
    every_one = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    p = posted.join(cuts, on).select(F.col("id").alias("pid"), "dim", "list", dealt("id", "n_blocks").alias("block"), every_one("n_qblocks").alias("qblock"))
    p = p.join(distinct.select("id", "ids", "embedding").hint("merge"), F.col("pid") == F.col("id")).select("dim", "list", "block", "qblock", F.lit(0).alias("kind"), "id", "ids", "embedding")
    q = asked.join(cuts, on).select(F.col("vec_id").alias("qid"), "dim", "list", every_one("n_blocks").alias("block"), dealt("vec_id", "n_qblocks").alias("qblock"))
    none = F.lit(None).cast("array<bigint>").alias("ids")
    q = q.join(queries.select("vec_id", "embedding").hint("merge"), F.col("qid") == F.col("vec_id")).select("dim", "list", "block", "qblock", F.lit(1).alias("kind"), F.col("vec_id").alias("id"), none, "embedding")
    found = saved(searched(p.union(q), k).groupBy("query_id", "vec_id").agg(F.max("score").alias("score")))
    # queries whose lists hold fewer than k others, though there are more
    most = live.groupBy(F.col("dim").alias("d")).agg((F.count("*") - 1).alias("others"))
    got = found.groupBy("query_id").agg(F.count("*").alias("n"))
    short = queries.join(got.hint("merge"), F.col("vec_id") == F.col("query_id"), "left").join(F.broadcast(most), F.col("dim") == F.col("d"))  # a row a length
    short = saved(short.where(F.coalesce("n", F.lit(0)) < F.least(F.lit(k), F.col("others"))).select("vec_id", "dim", "embedding"))
    if short.isEmpty():
        return found
    n_short, n_all = short.count(), distinct.count()
    blocks, qblocks = math.ceil(n_all / BLOCK), math.ceil(n_short / QUERY_BLOCK)
    at = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    p = distinct.select("dim", F.lit(-1).alias("list"), at("id", blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(qblocks - 1))).alias("qblock"), F.lit(0).alias("kind"), "id", "ids", "embedding")
    q = short.select("dim", F.lit(-1).alias("list"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), at("vec_id", qblocks).alias("qblock"), F.lit(1).alias("kind"), F.col("vec_id").alias("id"), none, "embedding")
    return found.union(searched(p.union(q), k)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))


