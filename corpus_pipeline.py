"""From raw documents to packed sequences: toxicity, line dedup, near-duplicates, mixing, packing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns the documents that
it leaves, with the columns of docs, or, the last one, the pieces of the packed sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sessionforge.llm.bin_slack import pack
from sessionforge.llm.common import saved, table
from sessionforge.llm.jaccard import judged, text_hash
from sessionforge.llm.mixing import mixed_documents
from sessionforge.llm.ngram_bayes import toxicity
from sessionforge.llm.repeated_lines import dedup_lines


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go. It learns from the labelled ones among docs."""
    return toxicity(docs, table(spark, sf_dir, "labels"), ("_score", "_toxic")).where("_toxic = 0").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go, and documents of which nothing but blanks is left then."""
    rows = dedup_lines(docs, names=("_lines", "_removed")).where((F.size("_removed") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    return rows.select(*[F.when(F.size("_removed") > 0, F.length("text").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each class of near-duplicates stays, of the smallest doc_id; of a repeated row one."""
    kept = judged(docs).where("kept").select(F.col("doc_id").alias("_kept"), F.col("th").alias("_kept_th")).distinct()
    rows = docs.withColumn("_th", text_hash()).join(kept.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_kept")) & F.col("_th").eqNullSafe(F.col("_kept_th")), "left_semi")
    nth = F.row_number().over(W.partitionBy("doc_id", "_th").orderBy("source", "lang"))
    return rows.withColumn("_nth", F.when(F.col("doc_id").isNull(), 1).otherwise(nth)).where("_nth = 1").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix to target weights: of each document the words that the mix takes, repeats included."""
    return mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", keep_clean),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", keep_one_of_near_copies),
    ("mix_sources", mix_sources),
    ("pack", pack_sequences),
]

#: Classifier scores, MinHash and the tokenizer can't be put in SQL; the stages are held against brute force in tests.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is checkpointed, since the next one reads it several times."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
