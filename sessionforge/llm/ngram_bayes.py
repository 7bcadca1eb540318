"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

The features of a text are the character n-grams (3 to 5 characters, lower case, blanks for any
white space) that occur in it, hashed to `2^BITS` places. For each place the log-count ratio r says
how much likelier labelled toxic texts hold it than others, counted over the labelled training texts, all of
them up to half of `TRAIN_ROWS` a class. The places whose ratio stands out most from chance (at most `FEATURES`) are the features; a
text's vector holds r at the features it has, and a logistic regression is fitted on that, on about
`FIT_ROWS` training texts of each class, chosen by hash, all if there are fewer. Whole texts of any
length are scored.

Null, empty and blank texts have no n-grams; their score is that of the bias. Labels that are null are left
out; a doc_id with several labels is toxic if one says so. A doc_id that appears again is scored for
every row, equal texts alike. Without both classes among the training labels every score is 1/2 or the one class's rate,
smoothed. Labels, language, source and doc_id are no inputs of a score. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionforge.llm.common import saved

SIZES, BITS, FEATURES, FIT_ROWS = (3, 4, 5), 18, 4_096, 3_000
#: Labelled rows that are learned from, about half of them of each class, chosen by a hash of doc_id; 16 bytes each.
TRAIN_ROWS = 200_000
ALPHA, RIDGE, STEPS = 1.0, 1e-3, 300
#: Pieces in which a task's counts travel, 64 KB each, and parts in which partitions' pieces are added up first.
SEGMENTS, FOLDS = 64, 512

_MULTIPLIERS = np.array([2654435761, 2246822519, 3266489917, 668265263, 374761393], "uint32")


def places(text: str | None, scratch: np.ndarray) -> np.ndarray:
    """The distinct places of the n-grams of a text. scratch: 2^BITS numbers to work with."""
    if not text:
        return np.empty(0, "int64")
    c = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-32-le", "surrogatepass"), "uint32")
    found = []
    for n in SIZES:
        m = len(c) - n + 1
        if m <= 0:
            continue
        h = np.full(m, np.uint32(n * 97))
        for k in range(n):
            h = (h ^ c[k : k + m]) * _MULTIPLIERS[k]
            h ^= h >> np.uint32(15)
        found.append(h)
    if not found:
        return np.empty(0, "int64")
    h = (np.concatenate(found) >> np.uint32(32 - BITS)).astype("int64")
    at = np.arange(len(h))
    scratch[h] = at
    return h[scratch[h] == at]


def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts of each class that hold a place, in SEGMENTS pieces for the whole partition."""
    n, texts, scratch = np.zeros((2, 2**BITS), "int64"), np.zeros(2, "int64"), np.zeros(2**BITS, "int64")
    for pdf in batches:
        for text, label in zip(pdf["text"], pdf["label"], strict=True):
            n[label, places(text, scratch)] += 1
            texts[label] += 1
    if texts.any():
        each = 2**BITS // SEGMENTS
        yield pd.DataFrame({"segment": np.arange(SEGMENTS), "n0": list(n[0].reshape(SEGMENTS, each)), "n1": list(n[1].reshape(SEGMENTS, each)), "t0": texts[0], "t1": texts[1]})


def added(pdf: pd.DataFrame) -> pd.DataFrame:
    """The sum of one segment over some partitions; a row holds a fixed number of counts."""
    return pd.DataFrame({"segment": pdf["segment"].iloc[:1], "n0": [np.sum(np.stack(pdf["n0"]), axis=0)], "n1": [np.sum(np.stack(pdf["n1"]), axis=0)], "t0": [pdf["t0"].sum()], "t1": [pdf["t1"].sum()]})


def ratios(n0: np.ndarray, n1: np.ndarray, t0: int, t1: int) -> np.ndarray:
    """Log-count ratio at the features, nan elsewhere."""
    p, q = (n1 + ALPHA) / (t1 + 2 * ALPHA), (n0 + ALPHA) / (t0 + 2 * ALPHA)
    r = np.log(p / q)
    noise = np.sqrt((1 - p) / (p * (t1 + 2 * ALPHA)) + (1 - q) / (q * (t0 + 2 * ALPHA)))
    sure = np.where(n0 + n1 >= 3, np.abs(r) / noise, 0)
    out = np.full(len(r), np.nan)
    best = np.argsort(-sure, kind="stable")[:FEATURES]
    best = best[sure[best] > 2]
    out[best] = r[best]
    return out


def fitted(rows: list[np.ndarray], values: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression; classes weigh alike. Accelerated gradient steps.

    rows: the feature numbers of each text; values: the scale of each feature.
    """
    at = np.repeat(np.arange(len(rows), dtype="int32"), [len(x) for x in rows])
    f = np.concatenate(rows) if rows else np.empty(0, "uint16")
    y = labels.astype(float)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    v = values.astype("float32")[f]
    norm = np.bincount(at, v * v, minlength=len(rows)).max(initial=0) + 1
    step = 4 / norm
    w, b, pw, pb = np.zeros(len(values)), 0.0, np.zeros(len(values)), 0.0
    for t in range(STEPS):
        m = t / (t + 3)
        zw, zb = w + m * (w - pw), b + m * (b - pb)
        z = np.bincount(at, v * zw.astype("float32")[f], minlength=len(rows)) + zb
        g = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        pw, pb = w, b
        w = zw - step * (np.bincount(f, v * g.astype("float32")[at], minlength=len(values)) + RIDGE * zw / len(rows))
        b = zb - step * g.sum()
    return w, b


def toxic_model(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """A weight for each place and the bias, from docs (doc_id, text) and labels (doc_id, toxic)."""
    told = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").alias("of")).agg(F.max((F.col("toxic") == 1).cast("int")).alias("label"))
    texts = docs.select(F.col("doc_id").alias("doc"), "text").where("text is not null")
    # TRAIN_ROWS bounds what is broadcast, class by class, so that the rarer one isn't thinned with the other; texts stay where they are read
    told = saved(told)
    n = {r["label"]: r["count"] for r in told.groupBy("label").count().collect()}
    dice = lambda *by: F.pmod(F.xxhash64(*by), F.lit(2**31)) / 2**31
    share = lambda most, of: F.when(F.col("label") == 1, min(1.0, most / max(1, of.get(1, 0)))).otherwise(min(1.0, most / max(1, of.get(0, 0))))
    told = told.where(dice("of", F.lit(9)) < share(TRAIN_ROWS // 2, n))
    train = texts.join(F.broadcast(told), F.col("doc") == F.col("of")).select("doc", "text", "label")
    schema = "segment int, n0 array<long>, n1 array<long>, t0 long, t1 long"
    counts = train.select("text", "label").mapInPandas(counted, schema).withColumn("part", F.spark_partition_id() % FOLDS)
    # in two steps, so that a group has a FOLDS-th of the partitions' rows and then FOLDS rows at most
    counts = counts.groupBy("segment", "part").applyInPandas(added, schema).groupBy("segment").applyInPandas(added, schema)
    got = counts.orderBy("segment").collect()  # 2^BITS counts, whatever the input
    weights = np.zeros(2**BITS)
    t0, t1 = (got[0]["t0"], got[0]["t1"]) if got else (0, 0)
    if not t0 or not t1:
        return weights, float(np.log((t1 + 1) / (t0 + 1)))
    r = ratios(np.concatenate([g["n0"] for g in got]).astype(float), np.concatenate([g["n1"] for g in got]).astype(float), t0, t1)
    chosen = np.flatnonzero(~np.isnan(r))
    number = np.full(2**BITS, -1)
    number[chosen] = np.arange(len(chosen))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scratch = np.zeros(2**BITS, "int64")
        for pdf in batches:
            rows = [number[places(t, scratch)] for t in pdf["text"]]
            yield pd.DataFrame({"label": pdf["label"], "f": [np.sort(x[x >= 0]).astype("uint16").tobytes() for x in rows]})

    # a sample of each class by hash of id and text; a repeated row counts once, so that no document outweighs the sample
    some = train.withColumn("th", F.xxhash64("text")).where(dice("doc", "th", F.lit(5)) < share(FIT_ROWS, {0: t0, 1: t1})).dropDuplicates(["doc", "th"])
    fit = sorted((x["label"], bytes(x["f"])) for x in some.select("text", "label").mapInPandas(features, "label int, f binary").collect())
    w, bias = fitted([np.frombuffer(f, "uint16") for _, f in fit], r[chosen], np.array([label for label, _ in fit]))
    weights[chosen] = w * r[chosen]
    return weights, bias


def toxicity(docs: DataFrame, labels: DataFrame, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with score and predicted, under these names, which replace columns of docs so named; learns from labels (doc_id, toxic) whose crc32(doc_id) mod 5 is not 0."""
    learn = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    weights, bias = toxic_model(docs, learn)
    held = docs.sparkSession.sparkContext.broadcast(weights)  # 2^BITS numbers

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w, scratch = held.value, np.zeros(2**BITS, "int64")
        for batch in texts:
            z = np.array([w[places(t, scratch)].sum() for t in batch]) + bias
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    scored = docs.withColumn(names[0], score(F.col("text")))
    return scored.withColumn(names[1], (F.col(names[0]) >= 0.5).cast("int"))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs."""
    rows = toxicity(docs.select("doc_id", "text"), labels)
    return rows.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out"), "score", "predicted")


