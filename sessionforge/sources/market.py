"""The base relations: sessions, group and benchmark prices, ticker bars, taxonomy, quotes.

A session is a month of ship dates, an industry a brand and type, a sector a type, a ticker a
supplier. Every relation has a builder over Spark's readers and a twin in SQL, `CTES`, for checks in
another engine. Sums are exact decimals before they become doubles.
"""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lookbacks of the returns, in sessions; ytd looks back to the last session of the year before.
LOOKBACKS = {"day": 1, "week": 2, "month": 3, "quarter": 6, "half": 9, "year": 12}
METRICS = [*LOOKBACKS, "ytd"]
BENCHMARK = "ALL"
MONEY = "decimal(18,2)"
#: The session of a line item.
SESSION = "to_date(date_trunc('month', l_shipdate))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under `spark.checkpoint.dir`, or, on one machine alone, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{base or tempfile.mkdtemp(prefix='spark-tables-')}/table-{uuid.uuid4().hex}"


_HELD: dict[tuple, DataFrame] = {}
#: Seconds that it took to write each held relation, those included that it needed itself.
BUILT: dict[str, float] = {}


def held(name: str, build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The relation, written once to the shared folder for all queries of an application that read the same files.

    Such relations are small beside the tables they come from: a row for each group, ticker or benchmark
    and session. Queries read of them the columns that they need. A changed file gives a new one.
    """

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, name, sf_dir, _stamp(spark, sf_dir))
        if key not in _HELD:
            began = time.monotonic()
            df, at = build(spark, sf_dir), shared_folder(spark)
            df.write.parquet(at)
            BUILT[name] = time.monotonic() - began
            _HELD[key] = spark.read.schema(df.schema).parquet(at)
        return _HELD[key]

    return run


def _stamp(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, sizes and times of the files that market relations come from."""
    jvm, out = spark._jvm, []
    for table_name in ("lineitem", "part"):
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{table_name}.parquet")
        for status in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path):
            out.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return tuple(sorted(out))


#: MB of the line items' files to a task.
TASK_MB = 8


def tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks for a shuffle that carries the line items or a ticker's bars: their number grows with the files, so that none of them does."""
    size = sum(length for path, length, _ in _stamp(spark, sf_dir) if "/lineitem.parquet" in path)
    return max(spark.sparkContext.defaultParallelism, -(-size // (TASK_MB << 20)))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each line item with its session, groups, ticker and price. Parts are the built side: line items are neither sorted nor held."""
    n = tasks(spark, sf_dir)
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.concat_ws("/", "p_brand", "p_type").alias("industry"), F.col("p_type").alias("sector"))
    out = li.repartition(n, "l_partkey").join(part.repartition(n, "p_partkey").hint("shuffle_hash"), F.col("l_partkey") == F.col("p_partkey"))
    return out.withColumn("session_date", F.expr(SESSION))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_date, sidx, last_sidx): the positions of the sessions. One row a session, so a window without keys is fine."""
    days = table(spark, sf_dir, "lineitem").select(F.expr(SESSION).alias("session_date")).distinct()
    return days.select("session_date", F.expr("cast(row_number() over (order by session_date) - 1 as int)").alias("sidx"), F.expr("cast(count(*) over () - 1 as int)").alias("last_sidx"))


def with_returns(prices: DataFrame, days: DataFrame) -> DataFrame:
    """Adds sidx and perf_* (percent) to (session_date, name, px, ...); a lookback to a session without a price is null."""
    p = prices.join(F.broadcast(days), "session_date")  # a row a session, at most one a day
    w = "over (partition by name order by sidx range between {0} preceding and {0} preceding)"
    p = p.withColumns({f"perf_{m}": F.expr(f"100 * (px / nullif(first(px) {w.format(n)}, 0) - 1)") for m, n in LOOKBACKS.items()})
    # the session before the year's first lies 1 to 12 sessions back: picked from a frame that all lookbacks share
    p = p.withColumn("y_frame", F.expr("collect_list(struct(sidx, px)) over (partition by name order by sidx range between 12 preceding and 1 preceding)"))
    p = p.withColumn("y_px", F.expr("get(filter(y_frame, x -> x.sidx = sidx - month(session_date)), 0).px"))
    return p.withColumn("perf_ytd", F.expr("100 * (px / nullif(y_px, 0) - 1)")).drop("y_frame", "y_px")


def group_prices(spark: SparkSession, sf_dir: str, level: str = "industry") -> DataFrame:
    """Snapshot rows of groups: (session_date, name, px, stocks, market_cap, avg_volume, sidx, perf_*)."""
    t = trades(spark, sf_dir).select("session_date", F.col(level).alias("name"), "l_suppkey", "l_extendedprice", "l_quantity")
    # dealt by group and supplier: partial sums for counting suppliers are about as many as the line items, and a group's may not all come to one task
    g = t.repartition(tasks(spark, sf_dir), "session_date", "name", "l_suppkey").groupBy("session_date", "name").agg(
        F.expr(f"cast(sum(cast(l_extendedprice as {MONEY})) as double) / cast(sum(cast(l_quantity as {MONEY})) as double)").alias("px"),
        F.expr("cast(count(distinct l_suppkey) as int)").alias("stocks"),
        F.expr(f"cast(sum(cast(l_extendedprice as {MONEY})) as double) / 1e6").alias("market_cap"),
        F.expr(f"cast(cast(sum(cast(l_quantity as {MONEY})) as double) as bigint)").alias("avg_volume"),
    )
    return with_returns(g, held("sess", sessions)(spark, sf_dir))


def benchmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark rows: the whole market as `ALL`, and one ticker for each return flag; column name is the ticker."""
    sums = trades(spark, sf_dir).groupBy("session_date", F.col("l_returnflag").alias("name")).agg(F.expr(f"sum(cast(l_extendedprice as {MONEY}))").alias("price"), F.expr(f"sum(cast(l_quantity as {MONEY}))").alias("quantity"))
    sums = sums.union(sums.groupBy("session_date").agg(F.lit(BENCHMARK).alias("name"), F.sum("price").alias("price"), F.sum("quantity").alias("quantity")).select("session_date", "name", "price", "quantity"))
    return with_returns(sums.selectExpr("session_date", "name", "cast(price as double) / cast(quantity as double) AS px"), held("sess", sessions)(spark, sf_dir))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticker bars with moving averages as percent distances, as quote pages give them.

    (ticker, sidx, session_date, open, high, low, close, volume, prev_close, sma20_pct, sma50_pct,
    sma200_pct, atr, industry, sector); averages over 3, 6 and 12 sessions and the true range over 6.
    """
    order = "struct(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice)"
    t = trades(spark, sf_dir).where("l_suppkey is not null").select(F.col("l_suppkey").alias("ticker"), "l_quantity", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "p_brand", "sector")
    # dealt by ticker once, for the bars, the ticker's groups and the averages; what follows from other columns is added behind the shuffle
    u = t.repartition(tasks(spark, sf_dir), "ticker").withColumns({"session_date": F.expr(SESSION), "u": F.expr("l_extendedprice / nullif(l_quantity, 0)"), "industry": F.concat_ws("/", "p_brand", "sector")})
    g = u.groupBy("ticker", "session_date").agg(
        F.expr(f"min_by(u, {order})").alias("open"), F.max("u").alias("high"), F.min("u").alias("low"), F.expr(f"max_by(u, {order})").alias("close"),
        F.expr(f"cast(cast(sum(cast(l_quantity as {MONEY})) as double) as bigint)").alias("volume"), F.min(F.struct("l_partkey", "industry", "sector")).alias("h"),
    )
    # the groups of a ticker are those of its smallest part
    g = g.withColumn("h", F.expr("min(h) over (partition by ticker)")).withColumns({"industry": F.col("h.industry"), "sector": F.col("h.sector")}).drop("h")
    return bar_averages(g.join(F.broadcast(held("sess", sessions)(spark, sf_dir).drop("last_sidx")), "session_date"))


BAR_STEPS = [
    {"prev_close": "lag(close) over (partition by ticker order by sidx)"},
    {"tr": "greatest(high, coalesce(prev_close, high)) - least(low, coalesce(prev_close, low))"},
    {
        "atr": "avg(tr) over (partition by ticker order by sidx range between 5 preceding and current row)",
        "sma20_pct": "100 * (close / avg(close) over (partition by ticker order by sidx range between 2 preceding and current row) - 1)",
        "sma50_pct": "100 * (close / avg(close) over (partition by ticker order by sidx range between 5 preceding and current row) - 1)",
        "sma200_pct": "100 * (close / avg(close) over (partition by ticker order by sidx range between 11 preceding and current row) - 1)",
        "high52": "max(high) over (partition by ticker order by sidx range between 11 preceding and current row)",
        "volatility_w": "100 * tr / nullif(close, 0)",
        "avg_volume": "avg(volume) over (partition by ticker order by sidx range between 5 preceding and current row)",
    },
]


def steps(df: DataFrame, columns: list[dict[str, str]]) -> DataFrame:
    """Adds columns given as SQL expressions, a step at a time."""
    for step in columns:
        df = df.withColumns({k: F.expr(v) for k, v in step.items()})
    return df


def steps_sql(source: str, name: str, columns: list[dict[str, str]]) -> list[str]:
    """The same as common table expressions; the last is called name."""
    out, at = [], source
    for i, step in enumerate(columns):
        to = name if i == len(columns) - 1 else f"{name}_{i}"
        out.append(f"{to} AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in step.items())} FROM {at})")
        at = to
    return out


def bar_averages(g: DataFrame) -> DataFrame:
    return steps(g, BAR_STEPS)


def _returns_sql(source: str, name: str) -> list[str]:
    w = "OVER (PARTITION BY name ORDER BY sidx RANGE BETWEEN {0} PRECEDING AND {0} PRECEDING)"
    looks = ", ".join(f"100 * (px / nullif(first(px) {w.format(n)}, 0) - 1) AS perf_{m}" for m, n in LOOKBACKS.items())
    return [
        f"{name}_p AS (SELECT s.*, sess.sidx, sess.last_sidx FROM {source} s JOIN sess USING (session_date))",
        f"{name}_q AS (SELECT *, {looks} FROM {name}_p)",
        f"{name} AS (SELECT q.*, 100 * (q.px / nullif(y.px, 0) - 1) AS perf_ytd FROM {name}_q q LEFT JOIN {name}_p y ON y.name = q.name AND y.sidx = q.sidx - month(q.session_date))",
    ]


_PX = f"CAST(sum(CAST(l_extendedprice AS {MONEY})) AS DOUBLE) / CAST(sum(CAST(l_quantity AS {MONEY})) AS DOUBLE)"


def _groups_sql(level: str, name: str) -> list[str]:
    return [
        f"{name}_g AS (SELECT session_date, {level} AS name, {_PX} AS px, CAST(count(DISTINCT l_suppkey) AS INT) AS stocks, CAST(sum(CAST(l_extendedprice AS {MONEY})) AS DOUBLE) / 1e6 AS market_cap, CAST(CAST(sum(CAST(l_quantity AS {MONEY})) AS DOUBLE) AS BIGINT) AS avg_volume FROM trades GROUP BY 1, 2)",
        *_returns_sql(f"{name}_g", name),
    ]


#: Common table expressions by the relation they end in, in an order in which each may use those before.
CTES: dict[str, list[str]] = {
    "trades": ["trades AS (SELECT l.*, p_brand || '/' || p_type AS industry, p_type AS sector, CAST(date_trunc('month', l_shipdate) AS DATE) AS session_date FROM lineitem l JOIN part ON l_partkey = p_partkey)"],
    "sess": ["sess AS (SELECT session_date, CAST(row_number() OVER (ORDER BY session_date) - 1 AS INT) AS sidx, CAST(count(*) OVER () - 1 AS INT) AS last_sidx FROM (SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS DATE) AS session_date FROM lineitem))"],
    "snap": _groups_sql("industry", "snap"),
    "ssnap": _groups_sql("sector", "ssnap"),
    "bench": [f"bench_g AS (SELECT session_date, name, {_PX} AS px FROM (SELECT *, '{BENCHMARK}' AS name FROM trades UNION ALL SELECT *, l_returnflag AS name FROM trades) GROUP BY 1, 2)", *_returns_sql("bench_g", "bench")],
    "bars": [
        f"bars_t AS (SELECT *, l_extendedprice / nullif(l_quantity, 0) AS u, row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS o FROM trades)",
        f"bars_g AS (SELECT l_suppkey AS ticker, session_date, min_by(u, o) AS open, max(u) AS high, min(u) AS low, max_by(u, o) AS close, CAST(CAST(sum(CAST(l_quantity AS {MONEY})) AS DOUBLE) AS BIGINT) AS volume FROM bars_t GROUP BY 1, 2)",
        "bars_h AS (SELECT l_suppkey AS ticker, min_by(industry, l_partkey) AS industry, min_by(sector, l_partkey) AS sector FROM trades GROUP BY 1)",
        "bars_j AS (SELECT g.*, sess.sidx, h.industry, h.sector FROM bars_g g JOIN sess USING (session_date) JOIN bars_h h USING (ticker))",
        *steps_sql("bars_j", "bars", BAR_STEPS),
    ],
}
