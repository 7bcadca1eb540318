"""The derived panel: ranks, momentum, lookback differences and relative strength of every group and session.

All lookbacks are range frames on the session's position, so a group that misses a session is never
compared with an older one than meant. A column is one SQL expression; the panel is their list in
steps. Catalyst keeps only what a query selects, and shares the sorts of frames with like keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionforge.sources.market import BENCHMARK, CTES, METRICS, benchmarks, group_prices, held, steps, steps_sql

#: Metrics that make up momentum, and weights of its two profiles.
SCORED = ["week", "month", "quarter", "half", "year", "ytd"]
WEIGHTS = {"mid": dict(zip(SCORED, (1, 2, 2, 1, 1, 1), strict=True)), "fast": dict(zip(SCORED, (2, 1, 0.5, 0.5, 0.5, 0.5), strict=True))}
MIDDLE, SHORT, LONG = ["month", "quarter", "half"], ["week", "month"], ["quarter", "half", "year"]
WINDOWS, DELTA_METRICS = (5, 10, 20, 50), ("week", "month", "ytd")
ACCEL, SLOPE, HIGH, CROSS = 10, 10, 20, 5

DAY = "over (partition by session_date)"


def back(n: int) -> str:
    return f"over (partition by name order by sidx range between {n} preceding and {n} preceding)"


def last(n: int) -> str:
    """The session and the n - 1 before it."""
    return f"over (partition by name order by sidx range between {n - 1} preceding and current row)"


def mean(columns: list[str], weights: list[float] | None = None) -> str:
    """Weighted mean of the columns that aren't null; null if all are."""
    w = [f"{x}e0" for x in weights or [1] * len(columns)]
    top = " + ".join(f"coalesce({c} * {x}, 0e0)" for c, x in zip(columns, w, strict=True))
    n = " + ".join(f"(case when {c} is null then 0e0 else {x} end)" for c, x in zip(columns, w, strict=True))
    return f"(({top}) / nullif({n}, 0))"


def spread3(a: str, b: str, c: str) -> str:
    """Sample standard deviation of three values."""
    m = f"(({a} + {b} + {c}) / 3)"
    return f"sqrt((({a} - {m}) * ({a} - {m}) + ({b} - {m}) * ({b} - {m}) + ({c} - {m}) * ({c} - {m})) / 2)"


STEPS: list[dict[str, str]] = [
    {"n_groups": f"cast(count(*) {DAY} as int)"}
    | {f"rank_{m}": f"cast(rank() over (partition by session_date order by perf_{m} desc nulls last) as int)" for m in METRICS}
    | {f"live_{m}": f"count(perf_{m}) {DAY}" for m in METRICS},
    {f"pct_{m}": f"case when n_groups > 1 then (n_groups - rank_{m}) / cast(n_groups - 1 as double) end" for m in METRICS},
    {f"score_{m}": f"case when live_{m} > 0 then pct_{m} end" for m in METRICS},
    {
        "momentum_score": mean([f"score_{m}" for m in SCORED]),
        "rank_agreement": f"greatest(0e0, least(1e0, 1 - {spread3(*[f'pct_{m}' for m in MIDDLE])} * sqrt(3e0))) + 0 * pct_month",
        "momentum_weighted_mid": mean([f"score_{m}" for m in SCORED], list(WEIGHTS["mid"].values())),
        "momentum_weighted_fast": mean([f"score_{m}" for m in SCORED], list(WEIGHTS["fast"].values())),
        "regime_short_long": f"{mean([f'score_{m}' for m in SHORT])} - {mean([f'score_{m}' for m in LONG])}",
    },
    {
        "momentum_confirmed": "momentum_score * rank_agreement",
        "momentum_accel": f"momentum_score - first(momentum_score) {back(ACCEL)}",
        "rank_trend_slope": f"case when count(rank_ytd) {last(SLOPE)} >= 2 then -regr_slope(rank_ytd, sidx) {last(SLOPE)} end",
    }
    | {f"rank_{m}_delta_{n}d": f"first(rank_{m}) {back(n)} - rank_{m}" for n in WINDOWS for m in DELTA_METRICS}
    | {f"perf_{m}_delta_{n}d": f"perf_{m} - first(perf_{m}) {back(n)}" for n in WINDOWS for m in DELTA_METRICS},
    {f"rs_{m}": f"perf_{m} - bench_{m}" for m in METRICS},
    {f"rs_live_{m}": f"count(rs_{m}) {DAY}" for m in METRICS} | {f"beats_benchmark_{m}": f"case when rs_{m} > 0 then 1 when rs_{m} is not null then 0 end" for m in METRICS},
    {
        "rs_score": mean([f"beats_benchmark_{m}" for m in SCORED]),
        "rs_agreement": f"case when {' and '.join(f'rs_live_{m} > 0' for m in MIDDLE)} then abs({mean([f'sign(rs_{m})' for m in MIDDLE])}) end",
        "rs_regime_short_long": f"{mean([f'beats_benchmark_{m}' for m in SHORT])} - {mean([f'beats_benchmark_{m}' for m in LONG])}",
        "rs_slope": f"case when count(rs_month) {last(SLOPE)} >= 2 then regr_slope(rs_month, case when rs_month is not null then sidx end) {last(SLOPE)} end",
        "rs_new_high": f"case when rs_month is not null and count(rs_month) {last(HIGH)} >= 2 then case when rs_month >= max(rs_month) {last(HIGH)} then 1 else 0 end end",
        "rs_cross": f"case when rs_month is not null and count(rs_month) {last(CROSS)} >= 2 then case when rs_month > 0 and min(rs_month) over (partition by name order by sidx range between {CROSS - 1} preceding and 1 preceding) <= 0 then 1 else 0 end end",
    },
    {"rs_confirmed": "rs_score * rs_agreement", "rs_accel": f"rs_score - first(rs_score) {back(ACCEL)}"},
    # percentile of the average rank, as a share of the groups that have a score
    {"momentum_pctile": "case when momentum_score is not null then (rank() over (partition by session_date order by momentum_score asc nulls last) + (count(*) over (partition by session_date, momentum_score) - 1) / 2e0) / count(momentum_score) over (partition by session_date) end"},
]


def panel(spark: SparkSession, sf_dir: str, level: str = "industry") -> DataFrame:
    """One row for each session and group with all derived columns."""
    bench = held("bench", benchmarks)(spark, sf_dir).where(F.col("name") == BENCHMARK).select(F.col("session_date").alias("b_date"), *[F.col(f"perf_{m}").alias(f"bench_{m}") for m in METRICS])
    base = held({"industry": "snap", "sector": "ssnap"}[level], lambda s, d: group_prices(s, d, level))(spark, sf_dir)
    return steps(base.join(F.broadcast(bench), F.col("session_date") == F.col("b_date"), "left").drop("b_date"), STEPS)  # one row a session


def _panel_sql(source: str, name: str) -> list[str]:
    cols = ", ".join(f"b.perf_{m} AS bench_{m}" for m in METRICS)
    return [f"{name}_b AS (SELECT s.*, {cols} FROM {source} s LEFT JOIN bench b ON b.session_date = s.session_date AND b.name = '{BENCHMARK}')", *steps_sql(f"{name}_b", name, STEPS)]


CTES |= {"panel": _panel_sql("snap", "panel"), "spanel": _panel_sql("ssnap", "spanel")}
