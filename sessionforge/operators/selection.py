"""The group selector and what is measured on it: picks, scoreboards, rules, filters and lists."""

from __future__ import annotations

from sessionforge.operators.panel_columns import FIRING, HORIZONS, forward_rows, forward_steps
from sessionforge.plans.registry import Query, derived, r, stepped
from sessionforge.sources.market import METRICS

#: Slots of the buckets, and groups of a day at most.
CORE, FRESH, CAP = 11, 2, 27
#: Percentile gate of the deployed selector, and the one the study rules use.
GATE, STUDY_GATE = 0.6, 0.4
GREEN = " AND ".join(f"perf_{m} > 0" for m in ("week", "month", "quarter", "half", "ytd"))
#: Bucket: slots, gate, order.
BUCKETS = {
    "emerging": (4, FIRING, "regime_short_long"),
    "accel": (3, f"momentum_accel > 0.08 AND momentum_pctile >= {GATE} AND rs_score > 0.5", "momentum_accel"),
    "rs_new_high": (3, f"rs_new_high = 1 AND rs_score >= 0.6 AND momentum_pctile >= {GATE}", "rs_slope"),
    "all_green": (4, GREEN, "momentum_score"),
}


def selector_steps(cap: int = CAP) -> list[dict[str, str]]:
    """Columns that tell for each group and session by which buckets it is chosen (tag_*), and at which place.

    Each bucket tags its natural top slots, and goes on past them with names not chosen yet until it has
    added as many as its slots, or the cap is reached. A new name's order among the bucket's new
    candidates decides, so the buckets are one chain of window columns over one partitioning by session.
    """
    day = "partition by session_date"
    out = [
        {"sum_mid": "rank_month + rank_quarter + rank_half"},
        {"core_place": f"row_number() over ({day} order by sum_mid, name)"},
        {"tag_core": f"case when core_place <= least({CORE}, {cap}) then 1 else 0 end"},
        {"fresh_ok": "case when tag_core = 0 and momentum_confirmed is not null then 1 else 0 end"},
        {"fresh_place": f"row_number() over ({day}, fresh_ok order by momentum_confirmed desc nulls last, name)"},
        {"tag_fresh": f"case when fresh_ok = 1 and fresh_place <= least({FRESH}, {cap} - {min(CORE, cap)}) then 1 else 0 end"},
        {"chosen_0": "greatest(tag_core, tag_fresh)"},
    ]
    for k, (bucket, (slots, gate, order)) in enumerate(BUCKETS.items()):
        out += [
            {f"gate_{k}": f"case when {gate} then 1 else 0 end", f"n_{k}": f"sum(chosen_{k}) over ({day})"},
            {f"place_{k}": f"row_number() over ({day}, gate_{k} order by {order} desc nulls last, name)"},
            {f"new_{k}": f"sum(1 - chosen_{k}) over ({day}, gate_{k} order by place_{k})"},
            {f"tag_{bucket}": f"case when gate_{k} = 1 and ((chosen_{k} = 1 and place_{k} <= {slots}) or (chosen_{k} = 0 and new_{k} <= least({slots}, {cap} - n_{k}))) then 1 else 0 end"},
            {f"chosen_{k + 1}": f"greatest(chosen_{k}, tag_{bucket})"},
        ]
    return out


TAGS = {"core": ("leaders", "sustained_strength", "core_place"), "fresh": ("leaders", "freshness_fill", "fresh_place")} | {b: (b, b, f"place_{k}") for k, b in enumerate(BUCKETS)}
CHOSEN = f"chosen_{len(BUCKETS)}"


def rows_of(source: str) -> str:
    """A row for each tag of a chosen group."""
    case = lambda i: "CASE tag " + " ".join(f"WHEN '{t}' THEN {v[i] if i == 2 else repr(v[i])}" for t, v in TAGS.items()) + " END"
    tags = ", ".join(f"CASE WHEN tag_{t} = 1 THEN '{t}' END" for t in TAGS)
    return f"SELECT session_date, name, {case(0)} AS list_category, {case(1)} AS basis, cast({case(2)} AS int) AS category_rank FROM (SELECT *, each({tags}) AS tag FROM {{{source}}} WHERE {CHOSEN} = 1) t"


stepped("selcols", "panel", selector_steps(), keep=True)
stepped("selcols16", "panel", selector_steps(16))
derived("sel", rows_of("selcols"))
stepped("fwdcols", "selcols", forward_steps(), keep=True)
stepped("bfwdcols", "bench", forward_steps())
derived("fwd", forward_rows("fwdcols", f"{CHOSEN} AS chosen, {', '.join(f'tag_{t}' for t in TAGS)}"))
derived("bfwd", f"SELECT session_date AS b_date, horizon AS b_horizon, fwd AS bench_fwd FROM ({forward_rows('bfwdcols', 'name AS ticker')}) t WHERE name = 'ALL'")
CATEGORY_TAGS = {"accel": "tag_accel", "all_green": "tag_all_green", "emerging": "tag_emerging", "leaders": "greatest(tag_core, tag_fresh)", "rs_new_high": "tag_rs_new_high"}
derived(
    "board",
    f"""WITH f AS (SELECT *, median(fwd) OVER (PARTITION BY session_date, horizon) AS median_fwd, avg(CASE WHEN chosen = 0 THEN fwd END) OVER (PARTITION BY session_date, horizon) AS control_fwd,
  concat_ws('|', {', '.join(f"CASE WHEN {v} = 1 THEN '{k}' END" for k, v in CATEGORY_TAGS.items())}) AS tags FROM {{fwd}})
SELECT /*+ MERGE(bf) */ session_date AS pick_date, name, tags, horizon, n_avail, fwd, bench_fwd, median_fwd, control_fwd, fwd - bench_fwd AS excess_bench, fwd - median_fwd AS excess_median, fwd - control_fwd AS excess_control,
  CASE WHEN n_avail = horizon AND fwd IS NOT NULL THEN 1 ELSE 0 END AS settled
FROM f LEFT JOIN {{bfwd}} bf ON b_date = session_date AND b_horizon = horizon WHERE chosen = 1""",
)

#: Study rules: name, rows that qualify, order, most names.
RULES = {
    "emerging": (FIRING, None, None),
    "emerging_regime_only": ("regime_short_long > 0.15", None, None),
    "leaders": ("name IS NOT NULL", "rank_month + rank_quarter + rank_half", 11),
    "accel": (f"momentum_accel > 0.08 AND gate_accel >= {STUDY_GATE} AND rs_score > 0.5", None, None),
    "rs_new_high": (f"rs_new_high = 1 AND rs_score >= 0.6 AND gate_high >= {STUDY_GATE}", None, None),
    **{f"top{n}_regime": ("regime_short_long IS NOT NULL", "-regime_short_long", n) for n in (5, 10, 14, 20, 28)},
    **{f"top{n}_{label}": (f"{c} IS NOT NULL", f"-{c}", n) for label, c in (("momentum", "momentum_score"), ("mom_confirmed", "momentum_confirmed"), ("rs_confirmed", "rs_confirmed")) for n in (10, 14, 28)},
}


def _gate(needs: str) -> str:
    """Percentile of the momentum score among the rows that have what a rule needs."""
    ok = f"CASE WHEN {needs} THEN momentum_score END"
    return f"CASE WHEN {needs} THEN (rank() OVER (PARTITION BY session_date ORDER BY {ok} ASC NULLS LAST) + (count(*) OVER (PARTITION BY session_date, {ok}) - 1) / 2e0) / count({ok}) OVER (PARTITION BY session_date) END"


_ORDERS = list(dict.fromkeys(v[1] for v in RULES.values() if v[1]))
stepped(
    "rulecols",
    "fwdcols",
    [
        {"gate_accel": _gate("momentum_accel IS NOT NULL AND momentum_score IS NOT NULL AND rs_score IS NOT NULL"), "gate_high": _gate("rs_new_high IS NOT NULL AND momentum_score IS NOT NULL AND rs_score IS NOT NULL")}
        | {f"order_{i}": f"row_number() over (partition by session_date order by {o} nulls last, name)" for i, o in enumerate(_ORDERS)},
    ],
)
_RULE_TAGS = ", ".join(f"CASE WHEN {gate}{f' AND order_{_ORDERS.index(order)} <= {n}' if order else ''} THEN '{k}' END" for k, (gate, order, n) in RULES.items())
derived("rules", f"SELECT each({_RULE_TAGS}) AS rule, session_date, name FROM {{rulecols}}")
derived("rulefwd", f"SELECT rule, session_date, name, horizon, fwd, n_avail, all_fwd FROM (SELECT each({_RULE_TAGS}) AS rule, * FROM (SELECT *, avg(CASE WHEN n_avail = horizon THEN fwd END) OVER (PARTITION BY session_date, horizon) AS all_fwd FROM ({forward_rows('rulecols', '*')}) h) a) t")

LATEST = "session_date = (SELECT max(session_date) FROM {panel})"
D5 = "rank_month_delta_5d"


def top(columns: str, where: str, order: str, n: int, label: str = "place") -> str:
    return f"SELECT session_date, name, {columns}, cast({label} AS int) AS {label} FROM (SELECT *, row_number() OVER (PARTITION BY session_date ORDER BY {order}, name) AS {label} FROM {{panel}} WHERE {where}) t WHERE {label} <= {n}"


QUERIES = [
    Query("tk_select_groups", "SELECT * FROM {sel}"),
    Query("tk_select_groups_capped", rows_of("selcols16")),
    Query("ag_selection_summary", "SELECT session_date, list_category, cast(count(*) AS int) AS n, cast(max(unique_groups) AS int) AS unique_groups FROM (SELECT /*+ MERGE(u) */ s.*, u.unique_groups FROM {sel} s JOIN (SELECT session_date AS d, count(DISTINCT name) AS unique_groups FROM {sel} GROUP BY session_date) u ON u.d = s.session_date) t GROUP BY session_date, list_category"),
    Query("w_scoreboard", f"SELECT pick_date, name, tags, horizon, cast(n_avail AS int) AS n_avail, {', '.join(r(c) for c in ('fwd', 'bench_fwd', 'median_fwd', 'control_fwd', 'excess_bench', 'excess_median', 'excess_control'))}, settled FROM {{board}}"),
    Query("ag_eval_overall", f"SELECT horizon, cast(count(*) AS int) AS n, cast(count(DISTINCT pick_date) AS int) AS n_dates, {r('avg(excess_bench)', 'mean_excess')}, {r('median(excess_bench)', 'median_excess')}, {r('avg(CASE WHEN excess_bench > 0 THEN 1e0 WHEN excess_bench IS NOT NULL THEN 0e0 END)', 'hit_rate')} FROM {{board}} WHERE settled = 1 GROUP BY horizon"),
    Query("ag_eval_bucket", f"SELECT tag, horizon, cast(count(*) AS int) AS n, {r('avg(excess_bench)', 'mean_excess')}, {r('avg(CASE WHEN excess_bench > 0 THEN 1e0 WHEN excess_bench IS NOT NULL THEN 0e0 END)', 'hit_rate')} FROM (SELECT pieces(tags) AS tag, horizon, excess_bench FROM {{board}} WHERE settled = 1) t GROUP BY tag, horizon"),
    Query("ag_eval_paired", f"SELECT horizon, cast(count(*) AS int) AS n_dates, {r('avg(gap)', 'mean_gap')}, cast(sum(CASE WHEN gap > 0 THEN 1 ELSE 0 END) AS int) AS n_positive FROM (SELECT pick_date, horizon, avg(fwd) - max(control_fwd) AS gap FROM {{board}} WHERE settled = 1 GROUP BY pick_date, horizon) t WHERE gap IS NOT NULL GROUP BY horizon"),
    Query("ext_rule_registry", "SELECT rule, session_date, name FROM {rules}"),
    Query(
        "ag_rule_leaderboard",
        f"""WITH d AS (SELECT rule, session_date, horizon, count(*) AS picks, avg(fwd) - max(all_fwd) AS excess FROM {{rulefwd}} WHERE n_avail = horizon AND fwd IS NOT NULL GROUP BY rule, session_date, horizon)
SELECT rule, horizon, cast(count(*) AS int) AS n_dates, {r('avg(picks)', 'avg_picks')}, {r('avg(excess)', 'excess_mean')}, {r('avg(CASE WHEN excess > 0 THEN 1e0 ELSE 0e0 END)', 'hit_rate')} FROM d GROUP BY rule, horizon""",
    ),
    Query("flt_emerging", f"SELECT session_date, name FROM {{panel}} WHERE {FIRING}"),
    Query("flt_accel", f"SELECT session_date, name FROM {{panel}} WHERE {BUCKETS['accel'][1]}"),
    Query("flt_rs_new_high", f"SELECT session_date, name FROM {{panel}} WHERE {BUCKETS['rs_new_high'][1]}"),
    Query("flt_all_green", f"SELECT session_date, name FROM {{panel}} WHERE {GREEN}"),
    Query("flt_all_green_view", f"SELECT session_date, name, {' AND '.join(f'coalesce(perf_{m}, 0) > 0' for m in METRICS)} AS all_green, {' AND '.join(f'coalesce(perf_{m}, 0) > 0' for m in ('month', 'quarter', 'half', 'ytd'))} AS green_variant FROM {{panel}}"),
    Query("flt_sustained", "WITH p AS (SELECT session_date, name, rank_month, rank_quarter, rank_half, n_groups, greatest(5, cast(floor(n_groups / 4e0) AS int)) AS top_n FROM {panel}) SELECT session_date, name, CASE WHEN greatest(rank_month, rank_quarter, rank_half) <= top_n THEN 'leader' ELSE 'laggard' END AS side FROM p WHERE greatest(rank_month, rank_quarter, rank_half) <= top_n OR least(rank_month, rank_quarter, rank_half) > n_groups - top_n"),
    Query("flt_date_range", f"SELECT session_date, name, floor(px * 1e6) / 1e6 AS px FROM {{snap}} WHERE session_date BETWEEN DATE '1995-01-01' AND DATE '1996-12-01'"),
    Query("flt_sector", "SELECT s.session_date, s.name, s.stocks FROM {snap} s LEFT SEMI JOIN (SELECT DISTINCT industry FROM {trades} WHERE sector = 'STEEL' OR sector LIKE 'S%') i ON i.industry = s.name"),
    Query("tk_movers", f"SELECT session_date, name, side, {D5}, cast(place AS int) AS place FROM (SELECT session_date, name, 'up' AS side, {D5}, row_number() OVER (PARTITION BY session_date ORDER BY {D5} DESC, name) AS place FROM {{panel}} WHERE {D5} IS NOT NULL UNION ALL SELECT session_date, name, 'down' AS side, {D5}, row_number() OVER (PARTITION BY session_date ORDER BY {D5}, name) AS place FROM {{panel}} WHERE {D5} IS NOT NULL) t WHERE place <= 10"),
    Query("tk_leaders_laggards", f"{top(r('momentum_score'), 'momentum_score IS NOT NULL', 'momentum_score DESC', 10, 'place')}".replace("SELECT session_date, name,", "SELECT 'leader' AS side, session_date, name,", 1) + " UNION ALL " + top(r("momentum_score"), "momentum_score IS NOT NULL", "momentum_score", 10).replace("SELECT session_date, name,", "SELECT 'laggard' AS side, session_date, name,", 1) + " UNION ALL " + top(r("momentum_score"), "regime_short_long > 0", "regime_short_long DESC", 5).replace("SELECT session_date, name,", "SELECT 'emerging' AS side, session_date, name,", 1)),
    Query(
        "tk_divergences",
        f"""WITH m AS (SELECT session_date AS d, median(momentum_score) AS mid FROM {{panel}} GROUP BY session_date),
p AS (SELECT p.*, m.mid FROM {{panel}} p JOIN m ON m.d = p.session_date),
u AS (SELECT session_date, name, 'fading' AS kind, momentum_accel AS v, row_number() OVER (PARTITION BY session_date ORDER BY momentum_accel, name) AS place FROM p WHERE momentum_score >= mid AND momentum_accel < 0
UNION ALL SELECT session_date, name, 'emerging' AS kind, momentum_accel AS v, row_number() OVER (PARTITION BY session_date ORDER BY momentum_accel DESC, name) AS place FROM p WHERE momentum_score < mid AND momentum_accel > 0
UNION ALL SELECT session_date, name, 'fragile' AS kind, rank_agreement AS v, row_number() OVER (PARTITION BY session_date ORDER BY rank_agreement, name) AS place FROM p WHERE momentum_score >= mid AND rank_agreement IS NOT NULL)
SELECT session_date, name, kind, {r('v')}, cast(place AS int) AS place FROM u WHERE place <= 5""",
    ),
    Query(
        "tk_rotation_pairs",
        f"""WITH o AS (SELECT session_date, name, momentum_accel, row_number() OVER (PARTITION BY session_date ORDER BY momentum_accel, name) AS place FROM {{panel}} WHERE momentum_accel < 0),
i AS (SELECT session_date, name, momentum_accel, row_number() OVER (PARTITION BY session_date ORDER BY momentum_accel DESC, name) AS place FROM {{panel}} WHERE momentum_accel > 0)
SELECT o.session_date, cast(o.place AS int) AS place, o.name AS outflow, {r('o.momentum_accel', 'outflow_accel')}, i.name AS inflow, {r('i.momentum_accel', 'inflow_accel')} FROM o JOIN i ON i.session_date = o.session_date AND i.place = o.place WHERE o.place <= 5""",
    ),
    Query("tk_rs_signals", top(f"{r('rs_confirmed')}, {' + '.join(f'coalesce(beats_benchmark_{m}, 0)' for m in METRICS)} AS beats, rs_new_high, rs_cross", "rs_confirmed IS NOT NULL", "rs_confirmed DESC", 8)),
    Query(
        "tk_watch_candidates",
        """WITH t AS (SELECT session_date, name, 1 AS prio, row_number() OVER (PARTITION BY session_date ORDER BY rs_slope DESC NULLS LAST, name) AS place FROM {panel} WHERE rs_cross = 1
UNION ALL SELECT session_date, name, 2 AS prio, row_number() OVER (PARTITION BY session_date ORDER BY rs_confirmed DESC NULLS LAST, name) AS place FROM {panel} WHERE rs_new_high = 1
UNION ALL SELECT session_date, name, 3 AS prio, row_number() OVER (PARTITION BY session_date ORDER BY momentum_accel DESC, name) AS place FROM {panel} WHERE momentum_accel > 0.08
UNION ALL SELECT session_date, name, 4 AS prio, row_number() OVER (PARTITION BY session_date ORDER BY regime_short_long DESC, name) AS place FROM {panel} WHERE regime_short_long > 0.15),
f AS (SELECT *, row_number() OVER (PARTITION BY session_date, name ORDER BY prio) AS nth FROM t WHERE place <= 3),
g AS (SELECT *, row_number() OVER (PARTITION BY session_date ORDER BY prio, place) AS seat FROM f WHERE nth = 1)
SELECT session_date, name, prio, cast(seat AS int) AS seat FROM g WHERE seat <= 8""",
    ),
    Query("tk_snapshot_table", f"SELECT name, stocks, {r('market_cap')}, rank_month, rank_ytd, {r('momentum_score')} FROM {{panel}} WHERE {LATEST}"),
    Query("tk_timeseries", f"SELECT session_date, name, floor(px * 1e6) / 1e6 AS px, {r('momentum_score')} FROM {{panel}} WHERE name IN (SELECT name FROM {{panel}} WHERE {LATEST} AND rank_ytd <= 3)"),
    Query("ag_market_breadth", f"SELECT session_date, cast(count(*) AS int) AS n, cast(sum(CASE WHEN {GREEN} THEN 1 ELSE 0 END) AS int) AS n_green, {r('100e0 * sum(CASE WHEN ' + GREEN + ' THEN 1 ELSE 0 END) / count(*)', 'pct_green')}, {r('avg(rank_agreement)', 'mean_agreement')}, cast(sum(CASE WHEN momentum_accel > 0.02 THEN 1 ELSE 0 END) AS int) AS building, cast(sum(CASE WHEN momentum_accel < -0.02 THEN 1 ELSE 0 END) AS int) AS fading FROM {{panel}} GROUP BY session_date"),
    Query("ag_sector_breadth", f"WITH x AS (SELECT DISTINCT industry, sector FROM {{trades}}) SELECT p.session_date, x.sector, cast(count(*) AS int) AS mapped, cast(sum(CASE WHEN p.rank_month <= p.n_groups / 2e0 THEN 1 ELSE 0 END) AS int) AS n_top_half, {r('sum(CASE WHEN p.rank_month <= p.n_groups / 2e0 THEN 1e0 ELSE 0e0 END) / nullif(count(p.perf_month), 0)', 'share')} FROM {{panel}} p JOIN x ON x.industry = p.name GROUP BY p.session_date, x.sector"),
    Query("ag_heatmap_pivot", f"SELECT name, session_date, {r('momentum_score')}, {r('avg(momentum_score) OVER (PARTITION BY name)', 'row_mean')} FROM {{panel}}"),
    Query("jn_snapshot_delta", f"SELECT s.session_date, s.name, s.stocks, floor(s.px * 1e6) / 1e6 AS px, p.rank_month, p.rank_ytd FROM {{snap}} s LEFT JOIN {{panel}} p ON p.session_date = s.session_date AND p.name = s.name WHERE s.session_date = (SELECT max(session_date) FROM {{snap}})"),
    Query("jn_group_vs_benchmark", f"SELECT s.session_date, s.name, {', '.join(r(f's.perf_{m} - b.perf_{m}', f'rs_{m}') for m in METRICS)} FROM {{snap}} s LEFT JOIN (SELECT * FROM {{bench}} WHERE name = 'ALL') b ON b.session_date = s.session_date"),
    Query("jn_session_lookback", f"SELECT a.session_date, a.name, floor(b.px * 1e6) / 1e6 AS px_5_back FROM {{snap}} a LEFT JOIN {{snap}} b ON b.name = a.name AND b.sidx = a.sidx - 5"),
    Query("jn_semi_anti", "SELECT /*+ MERGE(s) */ f.session_date, f.name, f.stocks FROM {snap} f LEFT ANTI JOIN {sel} s ON s.session_date = f.session_date AND s.name = f.name"),
    Query("jn_group_card", f"SELECT s.name, s.stocks, {r('s.market_cap', 'market_cap')}, p.rank_ytd, {r('p.momentum_score', 'momentum_score')} FROM {{snap}} s JOIN {{panel}} p ON p.session_date = s.session_date AND p.name = s.name WHERE s.session_date = (SELECT max(session_date) FROM {{snap}}) AND s.name LIKE 'Brand#1%'"),
    Query("src_benchmark", f"SELECT session_date, name AS ticker, floor(px * 1e6) / 1e6 AS px, {r('perf_month')} FROM {{bench}} WHERE name = 'ALL'"),
    Query("src_latest_slice", f"SELECT name, rank_month, {r('momentum_score')} FROM {{panel}} WHERE {LATEST}"),
    Query("src_selected_groups", "SELECT session_date, name, listagg(DISTINCT list_category, '|') within group (order by list_category) AS tags, min_by(basis, category_rank * 100 + length(basis)) AS first_basis FROM {sel} GROUP BY session_date, name"),
    Query("qry_coverage", "SELECT 'industry' AS dataset, cast(count(DISTINCT session_date) AS int) AS n_dates, min(session_date) AS first_date, max(session_date) AS last_date, cast(count(*) AS int) AS n FROM {snap} UNION ALL SELECT 'sector', cast(count(DISTINCT session_date) AS int), min(session_date), max(session_date), cast(count(*) AS int) FROM {ssnap} UNION ALL SELECT 'benchmark', cast(count(DISTINCT session_date) AS int), min(session_date), max(session_date), cast(count(*) AS int) FROM {bench}"),
    Query("dq_freshness", "SELECT name, max(session_date) AS last_date, cast((SELECT max(sidx) FROM {sess}) - max(sidx) AS int) AS stale_sessions, CASE WHEN (SELECT max(sidx) FROM {sess}) = max(sidx) THEN 'fresh' WHEN (SELECT max(sidx) FROM {sess}) - max(sidx) <= 5 THEN 'stale' ELSE 'expired' END AS state FROM {snap} GROUP BY name"),
    Query("st_crosscheck", "WITH a AS (SELECT DISTINCT industry AS name FROM {trades} WHERE session_date < DATE '1995-01-01'), b AS (SELECT DISTINCT industry AS name FROM {trades} WHERE l_quantity > 45) SELECT coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NULL THEN 'only_theirs' WHEN b.name IS NULL THEN 'only_ours' ELSE 'both' END AS side FROM a FULL OUTER JOIN b ON a.name = b.name"),
    Query("ag_majority_map", "SELECT sector, industry, cast(n AS int) AS n FROM (SELECT sector, industry, n, row_number() OVER (PARTITION BY sector ORDER BY n DESC, industry) AS place FROM (SELECT sector, industry, count(*) AS n FROM {trades} GROUP BY sector, industry) c) t WHERE place = 1"),
    Query(
        "flt_ariel_match",
        f"""WITH g AS (SELECT session_date AS d, name AS grp, rank() OVER (PARTITION BY session_date ORDER BY rank_month + rank_quarter) AS place FROM {{panel}}),
b AS (SELECT b.session_date, b.ticker, g.place, b.close * b.avg_volume AS dollar, 100 * b.atr / nullif(b.close, 0) AS atr_pct, b.sma50_pct > 0 AND b.sma200_pct > 0 AS growth FROM {{bars}} b LEFT JOIN g ON g.d = b.session_date AND g.grp = b.industry),
t AS (SELECT session_date, ticker, CASE WHEN place <= 30 THEN 2 WHEN place <= 60 THEN 1 ELSE 0 END AS by_group, CASE WHEN dollar >= 60000 THEN 2 WHEN dollar >= 30000 THEN 1 ELSE 0 END AS by_volume, CASE WHEN atr_pct BETWEEN 2 AND 40 THEN 2 WHEN atr_pct BETWEEN 1 AND 70 THEN 1 ELSE 0 END AS by_range, CASE WHEN growth THEN 2 ELSE 0 END AS by_growth FROM b)
SELECT session_date, ticker, CASE least(by_group, by_volume, by_range, by_growth) WHEN 2 THEN 'full' WHEN 1 THEN 'soft' ELSE 'none' END AS tier FROM t""",
    ),
    Query("jn_taxonomy", "WITH exact AS (SELECT DISTINCT industry, sector FROM {trades} WHERE l_returnflag = 'R'), maj AS (SELECT sector AS s, min(industry) AS fallback FROM {trades} WHERE l_returnflag = 'R' GROUP BY sector), q AS (SELECT DISTINCT l_suppkey AS ticker, industry, sector FROM {trades} WHERE l_returnflag = 'A') SELECT q.ticker, q.industry, CASE WHEN q.ticker % 50 = 0 THEN 'fund' WHEN e.industry IS NOT NULL THEN 'exact' WHEN m.s IS NOT NULL THEN 'sector' ELSE 'none' END AS source, CASE WHEN q.ticker % 50 = 0 THEN 'FUND' ELSE coalesce(e.industry, m.fallback) END AS mapped, CASE WHEN e.industry IS NOT NULL THEN 1e0 WHEN m.s IS NOT NULL THEN 0.5e0 ELSE 0e0 END AS confidence FROM q LEFT JOIN exact e ON e.industry = q.industry LEFT JOIN maj m ON m.s = q.sector"),
    Query("src_pagination_cap", "WITH s AS (SELECT session_date, name, min(CASE list_category WHEN 'leaders' THEN 1 WHEN 'emerging' THEN 2 WHEN 'accel' THEN 3 WHEN 'rs_new_high' THEN 4 ELSE 5 END) AS prio FROM {sel} GROUP BY session_date, name), t AS (SELECT /*+ MERGE(s) */ s.session_date, s.name, s.prio, b.ticker, row_number() OVER (PARTITION BY s.session_date, s.name ORDER BY b.ticker) AS nth FROM s JOIN {bars} b ON b.session_date = s.session_date AND b.industry = s.name), p AS (SELECT session_date, name, prio, ceil(least(count(*), 40) / 20e0) AS pages FROM t GROUP BY session_date, name, prio), u AS (SELECT *, sum(pages) OVER (PARTITION BY session_date ORDER BY prio, name ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM p) SELECT /*+ MERGE(u) */ t.session_date, t.name, t.ticker, cast(t.nth AS int) AS nth FROM t JOIN u ON u.session_date = t.session_date AND u.name = t.name WHERE t.nth <= 40 AND u.used <= 12"),
    Query("w_ranks_checked_horizons", f"SELECT horizon, cast(count(*) AS int) AS n, cast(count(fwd) AS int) AS n_full FROM {{fwd}} WHERE horizon IN ({', '.join(map(str, HORIZONS))}) GROUP BY horizon"),
]
