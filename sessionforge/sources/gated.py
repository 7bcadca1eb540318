"""Stores that are written by date behind a gate, with one visible switch.

A write stages its rows once, watched by an `Observation`: rows that may not be there stop the job by
`raise_error`, and what the whole batch shows is judged before anything becomes visible. Then the dates
that the batch touches are written anew, under a version of their own, and a commit says for each date
which version holds it. The commit is one small file that is created or not: a write that fails in the
middle leaves the store as it was, and of two writers at once the second one is told. Readers join the
commit to the versions' folders, so that they open no other dates and versions.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Refused(ValueError):
    """A batch that the gate keeps out; the store is as it was."""


@dataclass(frozen=True)
class Gate:
    """What a batch must be like.

    least: with fewer rows there is a warning. shares: for a name, a condition in SQL and the share of rows
    that may meet it at most. refused: for a message, a condition that no row may meet. empty: what an empty
    batch is, `abort` or `skip`.
    """

    least: int = 0
    shares: dict[str, tuple[str, float]] = field(default_factory=dict)
    refused: dict[str, str] = field(default_factory=dict)
    empty: str = "abort"


@dataclass(frozen=True)
class Written:
    """verdict: `ok`, `warn` for fewer rows than expected, or `skip`; n_rows of the batch, and the store's version now."""

    verdict: str
    n_rows: int
    version: int


class GatedStore:
    """A store of rows by date at a path. keys: of rows with the same ones the last write's stays; date alone: dates are replaced whole."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], date: str = "session_date"):
        if date not in keys:
            raise ValueError(f"{date} must be one of the keys")
        self.spark, self.path, self.keys, self.date = spark, path, keys, date
        self.schema = T._parse_datatype_string(schema)
        self.columns = self.schema.fieldNames()
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def version(self) -> int:
        """The number of the last commit, 0 for a new store."""
        at = self._at("commits")
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return max((int(n) for n in names if n.isdigit()), default=0)

    def _commit(self, version: int) -> DataFrame:
        """(date, version folder) of a commit: a row a date."""
        schema = T.StructType([T.StructField("_of", self.schema[self.date].dataType), T.StructField("_in", T.StringType())])
        if not version:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema("d string, v string").json(f"{self.path}/commits/{version}").select(F.col("d").cast(schema["_of"].dataType).alias("_of"), F.col("v").alias("_in"))

    def _data(self) -> DataFrame:
        schema = T.StructType([*[f for f in self.schema if f.name != self.date], T.StructField("_version", T.StringType()), self.schema[self.date]])
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(f"{self.path}/data")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the last commit, or of an earlier one."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], self.schema)
        held = F.broadcast(self._commit(version))  # a row a date
        return self._data().join(held, (F.col(self.date) == F.col("_of")) & (F.col("_version") == F.col("_in")), "left_semi").select(*self.columns)

    def _stage(self, rows: DataFrame, gate: Gate) -> tuple[DataFrame, dict]:
        """The batch as it is staged, and what was seen of it; it is computed once."""
        rows = rows.select(*[F.col(c).cast(self.schema[c].dataType).alias(c) for c in self.columns])
        checks = {f"{self.date} is missing": f"{self.date} is null"} | gate.refused
        stop: Column = F.lit(None).cast("string")
        for message, condition in reversed(checks.items()):
            stop = F.when(F.expr(condition), F.lit(message)).otherwise(stop)
        rows = rows.withColumn(self.date, F.when(stop.isNotNull(), F.raise_error(stop)).otherwise(F.col(self.date)))
        seen, staged = Observation(), f"{self.path}/staged/{uuid.uuid4().hex}"
        shares = [F.avg(F.expr(f"cast(coalesce({condition}, false) as double)")).alias(name) for name, (condition, _) in gate.shares.items()]
        try:
            rows.observe(seen, F.count(F.lit(1)).alias("n"), *shares).write.parquet(staged)
        except Exception as e:
            for message in checks:
                if message in str(e):
                    raise Refused(message) from e
            raise
        return self.spark.read.schema(self.schema).parquet(staged), seen.get

    def upsert(self, rows: DataFrame, gate: Gate = Gate()) -> Written:
        """Writes rows behind the gate; of rows of the batch with the same keys any one stays."""
        version = self.version()
        staged, seen = self._stage(rows, gate)
        if not seen["n"]:
            if gate.empty == "abort":
                raise Refused("no rows")
            return Written("skip", 0, version)
        for name, (_, most) in gate.shares.items():
            if seen[name] > most:
                raise Refused(f"{name}: {seen[name]:.0%} of {seen['n']} rows, at most {most:.0%}")
        staged = staged.dropDuplicates(self.keys) if self.keys != [self.date] else staged
        touched = [r[0] for r in staged.select(self.date).distinct().collect()]  # a row a date
        new = staged
        if version and self.keys != [self.date]:
            old = self.read(version).where(F.col(self.date).isin(touched))
            evicted = staged.select(*[F.col(k).alias(f"_{k}") for k in self.keys])
            same = F.lit(True)
            for k in self.keys:
                same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
            new = old.join(evicted.hint("merge"), same, "left_anti").unionByName(staged)
        name = f"{version + 1}-{uuid.uuid4().hex[:8]}"
        new.write.partitionBy(self.date).parquet(f"{self.path}/data/_version={name}")
        held = {str(r["_of"]): r["_in"] for r in self._commit(version).collect()} | {str(d): name for d in touched}
        self._switch(version + 1, "\n".join(json.dumps({"d": d, "v": v}) for d, v in sorted(held.items())))
        return Written("warn" if seen["n"] < gate.least else "ok", seen["n"], version + 1)

    def _switch(self, version: int, text: str) -> None:
        """Creates the commit; an error if another writer was first."""
        try:
            out = self._fs.create(self._at("commits", str(version)), False)
        except Exception as e:
            raise Refused(f"version {version} was written meanwhile") from e
        out.write(bytearray(text.encode()))
        out.close()


def attempt(store: GatedStore, rows: DataFrame, gate: Gate) -> tuple[str, int]:
    """The verdict on a write (`abort: ...` where the gate keeps it out), and the rows of the store after it."""
    try:
        verdict = store.upsert(rows, gate).verdict
    except Refused as e:
        verdict = f"abort: {e}"
    return verdict, store.read().count()
