"""Queries that read columns of the derived panel, and window functions over it."""

from __future__ import annotations

from sessionforge.plans.panel import DELTA_METRICS, MIDDLE, WINDOWS
from sessionforge.plans.registry import Query, r, stepped
from sessionforge.sources.market import METRICS

KEYS = "session_date, name"


def pick(name: str, *columns: str, level: str = "panel") -> Query:
    return Query(name, f"SELECT {KEYS}, {', '.join(columns)} FROM {{{level}}}")


HORIZONS = (1, 3, 5, 10)


def forward(h: int, log: bool = False) -> str:
    """Return over the h sessions after a session, null unless each of them has one; and how many of them there are."""
    frame = f"over (partition by name order by sidx range between 1 following and {h} following)"
    total = f"sum(ln(1 + perf_day / 100)) {frame}"
    full = f"count(perf_day) {frame} = least({h}, last_sidx - sidx) and last_sidx > sidx"
    if log:
        return f"case when count(perf_day) {frame} = {h} then {total} end"
    return f"case when {full} then 100 * (exp({total}) - 1) end"


def forward_steps() -> list[dict[str, str]]:
    """Forward returns over all horizons as columns, fwd_h and log_h; one pass over the panel, whose last_sidx is the last session there is."""
    return [{f"fwd_{h}": forward(h) for h in HORIZONS} | {f"log_{h}": forward(h, log=True) for h in HORIZONS}]


def forward_rows(source: str, more: str, log: bool = False) -> str:
    """(session_date, sidx, name, horizon, n_avail, fwd, more) from a relation with the columns of forward_steps."""
    kind = "log" if log else "fwd"
    value = "CASE horizon " + " ".join(f"WHEN {h} THEN {kind}_{h}" for h in HORIZONS) + " END"
    head = "" if more == "*" else "session_date, sidx, name, horizon, "
    return f"SELECT {head}{more}, least(horizon, last_sidx - sidx) AS n_avail, {value} AS fwd FROM (SELECT *, numbers({', '.join(map(str, HORIZONS))}) AS horizon FROM {{{source}}}) hs"


stepped("pfwdcols", "panel", forward_steps())

EFFICIENCY = """SELECT session_date, sidx, CASE WHEN n = 10 AND path > 0 THEN abs(100 * (exp(total) - 1)) / path END AS efficiency FROM (
  SELECT session_date, sidx, count(perf_day) OVER w AS n, sum(ln(1 + perf_day / 100)) OVER w AS total, sum(abs(perf_day)) OVER w AS path
  FROM {bench} WHERE name = 'ALL' WINDOW w AS (ORDER BY sidx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) e"""

FIRING = "regime_short_long > 0.15 AND rs_score > 0.5"

#: Groups that fire the gate, with log returns of full windows.
SPREAD = f"""WITH g AS (SELECT session_date, horizon, name, fwd, coalesce(fires, false) AS fires FROM ({forward_rows('pfwdcols', FIRING + ' AS fires', log=True)}) f WHERE fwd IS NOT NULL),
c AS (SELECT *, row_number() OVER (PARTITION BY session_date, horizon ORDER BY md5(concat('control|', cast(session_date AS varchar(10)), '|', name)), name) AS lot,
      sum(CASE WHEN fires THEN 1 ELSE 0 END) OVER (PARTITION BY session_date, horizon) AS n_fire FROM g)
SELECT session_date, horizon, cast(max(n_fire) AS int) AS n_fire, cast(count(*) AS int) AS n_all,
  100 * (exp(avg(CASE WHEN fires THEN fwd END)) - 1) AS fwd_fire, 100 * (exp(avg(CASE WHEN NOT fires THEN fwd END)) - 1) AS fwd_nonfire,
  100 * (exp(avg(fwd)) - 1) AS fwd_all, 100 * (exp(avg(CASE WHEN lot <= n_fire THEN fwd END)) - 1) AS fwd_control
FROM c GROUP BY session_date, horizon HAVING max(n_fire) > 0"""

GRADIENT = f"""WITH j AS (SELECT session_date, horizon, name, fwd, x FROM ({forward_rows('pfwdcols', 'regime_short_long AS x')}) f WHERE fwd IS NOT NULL AND n_avail = horizon AND x IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY session_date, horizon ORDER BY x, name) AS rn, count(*) OVER (PARTITION BY session_date, horizon) AS n FROM j),
b AS (SELECT *, cast(greatest(1, ceil(5e0 * (rn - 1) / (n - 1))) AS int) AS quintile FROM k WHERE n > 5)
SELECT session_date, horizon, quintile, cast(count(*) AS int) AS n_groups, avg(fwd) - max(day_mean) AS excess
FROM (SELECT b.*, avg(fwd) OVER (PARTITION BY session_date, horizon) AS day_mean FROM b) m GROUP BY session_date, horizon, quintile"""

QUERIES = [
    Query("w_session_index", "SELECT session_date, sidx FROM {sess}"),
    pick("w_ranks", *[f"rank_{m}" for m in METRICS]),
    pick("w_momentum_score", r("momentum_score")),
    pick("w_rank_agreement", r("rank_agreement")),
    pick("w_momentum_confirmed", r("momentum_confirmed")),
    pick("w_weighted_momentum", r("momentum_weighted_mid"), r("momentum_weighted_fast")),
    pick("w_regime", r("regime_short_long")),
    pick("w_momentum_accel", r("momentum_accel")),
    pick("w_rank_slope", r("rank_trend_slope")),
    pick("w_rank_delta", *[f"rank_{m}_delta_{n}d" for n in WINDOWS for m in DELTA_METRICS]),
    pick("w_perf_delta", *[r(f"perf_{m}_delta_{n}d") for n in WINDOWS for m in DELTA_METRICS]),
    pick("w_rs_spread", *[r(f"rs_{m}") for m in METRICS]),
    pick("w_rs_score", r("rs_score")),
    pick("w_rs_agreement", r("rs_agreement")),
    pick("w_rs_confirmed", r("rs_confirmed")),
    pick("w_rs_slope", r("rs_slope")),
    pick("w_rs_accel", r("rs_accel")),
    pick("w_rs_regime", r("rs_regime_short_long")),
    pick("w_beats_benchmark", *[f"beats_benchmark_{m}" for m in METRICS]),
    pick("w_rs_new_high", "rs_new_high"),
    pick("w_rs_cross", "rs_cross"),
    pick("w_pct_rank_avg", r("momentum_pctile")),
    pick("w_rank_floor", f"greatest({', '.join(f'rank_{m}' for m in MIDDLE)}) AS worst_rank", f"least({', '.join(f'rank_{m}' for m in MIDDLE)}) AS best_rank"),
    Query("w_ranks_sector", f"SELECT {KEYS}, {', '.join(f'rank_{m}' for m in METRICS)} FROM {{spanel}}"),
    Query(
        "w_group_signal",
        f"""SELECT {KEYS}, floor(composite * 1e6 + 5e-1) / 1e6 AS composite, CASE WHEN composite >= 0.65e0 THEN 'favour' WHEN composite <= 0.35e0 THEN 'avoid' WHEN composite IS NOT NULL THEN 'neutral' END AS verdict FROM (
SELECT {KEYS}, (coalesce(0.4e0 * momentum_score, 0) + coalesce(0.3e0 * rs_score, 0) + coalesce(0.2e0 * rank_agreement, 0) + coalesce(0.1e0 * (regime_short_long + 1) / 2, 0)) / nullif(
 (CASE WHEN momentum_score IS NULL THEN 0e0 ELSE 0.4e0 END) + (CASE WHEN rs_score IS NULL THEN 0e0 ELSE 0.3e0 END) + (CASE WHEN rank_agreement IS NULL THEN 0e0 ELSE 0.2e0 END) + (CASE WHEN regime_short_long IS NULL THEN 0e0 ELSE 0.1e0 END), 0) AS composite FROM {{panel}}) t""",
    ),
    Query(
        "w_churn",
        f"""SELECT {KEYS}, {r('churn')}, {r("CASE WHEN count(churn) OVER w >= 2 THEN avg(churn) OVER w END", 'churn_mean')} FROM (
SELECT {KEYS}, sidx, abs(momentum_score - lag(momentum_score) OVER (PARTITION BY name ORDER BY sidx)) AS churn FROM {{panel}}) t
WINDOW w AS (PARTITION BY name ORDER BY sidx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
    ),
    Query("w_forward_return", f"SELECT session_date, name, horizon, cast(n_avail AS int) AS n_avail, {r('fwd')} FROM ({forward_rows('pfwdcols', 'px')}) t"),
    Query("w_forward_log", f"SELECT session_date, name, horizon, {r('100 * (exp(fwd) - 1)', 'fwd')} FROM ({forward_rows('pfwdcols', 'px', log=True)}) t WHERE fwd IS NOT NULL"),
    Query("w_efficiency_ratio", f"SELECT session_date, {r('efficiency')} FROM ({EFFICIENCY}) t"),
    Query("w_spread_study", f"SELECT session_date, horizon, n_fire, n_all, {r('fwd_fire - fwd_all', 'spread')}, {r('fwd_fire')}, {r('fwd_nonfire')}, {r('fwd_all')}, {r('fwd_control - fwd_all', 'control_spread')} FROM ({SPREAD}) t"),
    Query("w_quintile_gradient", f"SELECT session_date, horizon, quintile, n_groups, {r('excess')} FROM ({GRADIENT}) t"),
    Query(
        "w_firing_streak",
        f"""WITH f AS (SELECT name, session_date, sidx, sidx - row_number() OVER (PARTITION BY name ORDER BY sidx) AS island FROM {{panel}} WHERE {FIRING})
SELECT session_date, name, cast(row_number() OVER (PARTITION BY name, island ORDER BY sidx) AS int) AS streak FROM f""",
    ),
    Query(
        "jn_theta_bucket",
        f"""WITH f AS (SELECT name, session_date, sidx, sidx - row_number() OVER (PARTITION BY name ORDER BY sidx) AS island FROM {{panel}} WHERE {FIRING}),
s AS (SELECT session_date, name, cast(row_number() OVER (PARTITION BY name, island ORDER BY sidx) AS int) AS streak FROM f)
SELECT session_date, name, streak, bucket FROM s JOIN (VALUES (1, 1, '1'), (2, 3, '2-3'), (4, 7, '4-7'), (8, NULL, '8+')) AS b(lo, hi, bucket) ON streak >= lo AND (hi IS NULL OR streak <= hi)""",
    ),
    Query("ag_gradient_pivot", f"SELECT horizon, {', '.join(r(f'avg(CASE WHEN quintile = {q} THEN excess END)', f'q{q}') for q in range(1, 6))} FROM ({GRADIENT}) t GROUP BY horizon"),
    Query(
        "ag_regime_split",
        f"""WITH s AS (SELECT session_date, horizon, fwd_fire - fwd_all AS spread FROM ({SPREAD}) t), e AS ({EFFICIENCY}),
j AS (SELECT s.horizon, s.spread, e.efficiency FROM s JOIN e ON e.session_date = s.session_date WHERE e.efficiency IS NOT NULL AND s.spread IS NOT NULL),
m AS (SELECT horizon AS h, median(efficiency) AS mid FROM j GROUP BY horizon)
SELECT horizon, cast(count(*) AS int) AS n, {r('corr(spread, efficiency)', 'correlation')}, {r('avg(CASE WHEN efficiency >= mid THEN spread END)', 'mean_trending')}, {r('avg(CASE WHEN efficiency < mid THEN spread END)', 'mean_choppy')}
FROM j JOIN m ON h = horizon GROUP BY horizon""",
    ),
    Query(
        "ag_churn_report",
        f"""WITH c AS (SELECT name, session_date, sidx, abs(momentum_score - lag(momentum_score) OVER (PARTITION BY name ORDER BY sidx)) AS churn FROM {{panel}}),
top AS (SELECT name, row_number() OVER (ORDER BY churn DESC, name) AS place FROM c WHERE churn IS NOT NULL AND sidx = (SELECT max(sidx) FROM c WHERE churn IS NOT NULL))
SELECT {r('avg(churn)', 'mean_churn')}, {r('max(churn)', 'max_churn')}, cast(count(DISTINCT c.name) AS int) AS n_groups, cast(count(DISTINCT session_date) AS int) AS n_sessions,
  (SELECT listagg(name, '|') within group (order by place) FROM top WHERE place <= 5) AS top_groups FROM c WHERE churn IS NOT NULL""",
    ),
]
