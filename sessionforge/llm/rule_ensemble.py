"""Quality: a sparse ensemble of rules over text statistics, compiled into column expressions.

Statistics of whole texts (shares of kinds of characters and words, lengths, repetition) are computed
by Spark expressions. Boosted trees are fitted on the labelled training rows; every path of a tree is a
conjunctive rule over statistics. A logistic regression with a lasso penalty gives most rules weight
zero; the rules left, and the bias, are the score, written as one Spark column expression.

Null and empty texts have statistics of zero and get a score like any other. Null labels are left out;
a doc_id with several labels is good if all say so. Rows are scored each, so repeated rows get the
same score. Texts of any length are measured whole, and a score of exactly 1/2 predicts good. Without both classes among the training labels the score is the smoothed rate of good
ones. Labels, language, source and doc_id are no inputs of a score. Other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionforge.llm.common import saved, words_of

TREES, DEPTH, LASSO, SEED = 12, 3, 0.002, 9
#: Marks of kinds of characters: symbols that prose seldom has, and what ends or parts sentences.
SYMBOLS, STOPS, PARTS, DIGITS = "#$%&*@^~<>{}[]\\|=+_/", ".", ",;:", "0123456789"


def statistics(docs: DataFrame) -> DataFrame:
    """docs' doc_id with one double for each statistic."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", text.alias("t")).withColumn("w", words_of(F.col("t")))
    n = F.greatest(F.length("t"), F.lit(1))
    nw = F.greatest(F.size("w"), F.lit(1))

    def share(chars: str) -> Column:
        return (F.length("t") - F.length(F.translate("t", chars, ""))) / n

    lines = F.split("t", "\n", -1)
    stats = {
        "n_words": F.log1p(F.size("w").cast("double")),
        "n_lines": F.log1p(F.size(lines).cast("double")),
        "mean_word": (F.length("t") - nw + 1) / nw,
        "symbols": share(SYMBOLS),
        "bangs": share("!?"),
        "stops": share(STOPS),
        "parts": share(PARTS),
        "digits": share(DIGITS),
        "bars": share("|"),
        "upper": share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "wide": (F.octet_length("t") - F.length("t")) / n,
        "distinct_words": F.size(F.array_distinct("w")) / nw,
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "links": (F.length("t") - F.length(F.replace("t", F.lit("http"), F.lit("")))) / n,
    }
    return base.select("doc_id", *[F.coalesce(c, F.lit(0.0)).cast("double").alias(k) for k, c in stats.items()])


@dataclass(frozen=True)
class Rule:
    """Bounds on statistics that must all hold: (statistic, whether above, threshold)."""

    bounds: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, above, at in self.bounds:
            out = out & (F.col(name) > at if above else F.col(name) <= at)
        return out.cast("double")


def paths(node, names: list[str], bounds: tuple = ()) -> list[Rule]:
    """The rules of all paths from the root to any node below it."""
    out = [Rule(bounds)] if bounds else []
    if node.subtreeDepth() > 0:
        split = node.split()
        name, at = names[split.featureIndex()], split.threshold()
        out += paths(node.leftChild(), names, (*bounds, (name, False, at)))
        out += paths(node.rightChild(), names, (*bounds, (name, True, at)))
    return out


@dataclass(frozen=True)
class Ensemble:
    rules: tuple[tuple[Rule, float], ...]
    bias: float

    def score(self) -> Column:
        """The score of a row of statistics, as one expression."""
        z = F.lit(self.bias)
        for rule, weight in self.rules:
            z = z + rule.column() * weight
        return 1 / (1 + F.exp(-z))


def learned(train: DataFrame, names: list[str]) -> Ensemble:
    """Fits trees and the lasso on all rows of train (label and statistics)."""
    n = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    good, bad = n.get(1, 0), n.get(0, 0)
    if not good or not bad:
        return Ensemble((), math.log((good + 1) / (bad + 1)))
    weighted = train.withColumn("weight", F.when(F.col("label") == 1, 0.5 / good).otherwise(0.5 / bad) * (good + bad))
    vectors = saved(VectorAssembler(inputCols=names, outputCol="features").transform(weighted).select("features", "label", "weight", *names))
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, labelCol="label", weightCol="weight", seed=SEED).fit(vectors)
    rules = sorted({r for tree in trees.trees for r in paths(tree._call_java("rootNode"), names)}, key=repr)
    if not rules:
        return Ensemble((), 0.0)
    cols = [f"r{i}" for i in range(len(rules))]
    held = vectors.select("label", "weight", *[r.column().alias(c) for c, r in zip(cols, rules, strict=True)])
    held = saved(VectorAssembler(inputCols=cols, outputCol="features").transform(held).select("label", "weight", "features"))
    fit = LogisticRegression(labelCol="label", weightCol="weight", elasticNetParam=1.0, regParam=LASSO, standardization=True, maxIter=60).fit(held)
    kept = tuple((r, float(w)) for r, w in zip(rules, fit.coefficients.toArray(), strict=True) if w != 0)
    return Ensemble(kept, float(fit.intercept))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs (doc_id, text); learns from labels whose crc32(doc_id) mod 3 is not 1."""
    stats = saved(statistics(docs))
    names = [c for c in stats.columns if c != "doc_id"]
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    told = labels.where("quality is not null and doc_id is not null").where(fold != 1)
    told = told.groupBy(F.col("doc_id").alias("of")).agg(F.min((F.col("quality") == 1).cast("int")).alias("label"))
    train = saved(stats.join(told.hint("merge"), F.col("doc_id") == F.col("of")).select("label", *names))
    model = learned(train, names)
    out = stats.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), model.score().alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
