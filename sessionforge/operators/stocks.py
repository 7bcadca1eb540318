"""Queries on stocks: parsing of quote texts, setup metrics, picks, methodology replay, statuses and levels.

Volumes of the base tables are read as thousands, so that dollar floors keep their published size.
"""

from __future__ import annotations

from sessionforge.plans.registry import Query, derived, r, stepped

#: Methodology versions: effective from, weights of group, tightness and quiet, volatility floor, which haircuts hold.
VERSIONS = (
    (1, "1992-01-01", 0.4, 0.4, 0.2, None, 0, 0, 0),
    (2, "1993-07-01", 0.4, 0.4, 0.2, None, 1, 1, 0),
    (3, "1994-07-01", 0.2, 0.4, 0.4, None, 1, 1, 0),
    (4, "1995-08-01", 0.2, 0.4, 0.4, None, 1, 1, 1),
    (5, "1996-08-01", 0.2, 0.4, 0.4, None, 1, 1, 1),
    (6, "1997-09-01", 0.2, 0.4, 0.4, 1.0, 1, 1, 1),
)
_rows = ", ".join(f"({v}, DATE '{d}', {a}e0, {b}e0, {c}e0, {f'{f}e0' if f else 'cast(NULL AS double)'}, {x}, {y}, {z})" for v, d, a, b, c, f, x, y, z in VERSIONS)
METHODS = f"(VALUES {_rows}) AS v(version, effective_date, w_group, w_tight, w_quiet, vol_floor, has_liq, has_earn, has_overhead)"

STOCK = [
    {
        "ma20": "close / nullif(1 + sma20_pct / 100, 0)", "ma50": "close / nullif(1 + sma50_pct / 100, 0)", "ma200": "close / nullif(1 + sma200_pct / 100, 0)",
        "prior_high": "lag(high) over (partition by ticker order by sidx)", "prior_low": "lag(low) over (partition by ticker order by sidx)",
        "dollar_volume": "close * avg_volume * 1000", "cap_b": "close * avg_volume * 2000 / 1e9", "atr_pct": "case when close > 0 then 100 * atr / close end",
        "below_high_pct": "100 * (close / nullif(high52, 0) - 1)", "earnings_in": "cast((ticker * 7 + sidx * 13) % 60 as int) - 5",
    },
    {
        "atr_ext_50": "(close - ma50) / nullif(atr, 0)", "atr_ext_20": "(close - ma20) / nullif(atr, 0)", "risk_20ma_pct": "(close - ma20) / nullif(close, 0)", "risk_50ma_pct": "(close - ma50) / nullif(close, 0)",
        "range_atr": "(high - low) / nullif(atr, 0)", "stage2": "case when sma50_pct is not null and sma200_pct is not null then case when sma50_pct > 0 and sma200_pct > sma50_pct then 1 else 0 end end",
    },
]
stepped("stock", "bars", STOCK, keep=True, by="ticker")

STATUS = """CASE WHEN prior_high IS NULL OR prior_low IS NULL OR close IS NULL OR open IS NULL OR high IS NULL OR low IS NULL THEN 'no_quote'
  WHEN close <= prior_low THEN 'invalidated' WHEN open > prior_high THEN 'gapped_through' WHEN close >= prior_high THEN 'triggered'
  WHEN (close > ma20 AND (low < ma20 OR prior_low < ma20)) OR (close > ma50 AND (low < ma50 OR prior_low < ma50)) THEN 'reclaim'
  WHEN high >= prior_high THEN 'failed_breakout' ELSE 'setting_up' END"""

derived("picks", "SELECT /*+ MERGE(s) */ s.session_date, s.list_category, s.name AS grp, s.category_rank, k.ticker, k.sidx FROM {sel} s JOIN {stock} k ON k.session_date = s.session_date AND k.industry = s.name")
derived("methods", f"SELECT session_date, version, w_group, w_tight, w_quiet, vol_floor, has_liq, has_earn, has_overhead FROM (SELECT d.session_date, v.*, row_number() OVER (PARTITION BY d.session_date ORDER BY v.effective_date DESC) AS nth FROM {{sess}} d JOIN {METHODS} ON v.effective_date <= d.session_date) t WHERE nth = 1")

AVERAGES = "(sma50_pct > 0 OR sma200_pct > 0 OR sma50_pct > sma20_pct)"
BASE = f"cap_b > 0.005 AND {AVERAGES}"
VOLATILITY = "NOT (coalesce(volatility_w < vol_floor, false) OR coalesce(atr_pct < vol_floor, false))"
#: The base filter of picks as published: the cap floor in billions, and the volatility floor where the day's version has one.
PICK = f"cap_b > 5 AND {AVERAGES} AND {VOLATILITY}"
DQ = f"atr_ext_50 > 0 AND atr_ext_50 <= 4 AND (has_liq = 0 OR dollar_volume >= 3e7) AND {VOLATILITY}"


def ramp(x: str, lo: float, hi: float, most: float) -> str:
    return f"{most}e0 * greatest(0e0, least(1e0, coalesce(({x} - {lo}) / ({hi} - {lo}), 0e0)))"


EXTENSION = ramp("atr_ext_50", 2.5, 4.0, 0.5)
LIQUIDITY = "CASE WHEN dollar_volume IS NULL OR dollar_volume >= 6e7 THEN 0e0 ELSE 0.3e0 * greatest(0e0, least(1e0, (6e7 - dollar_volume) / 3e7)) END"
EARNINGS = "CASE WHEN earnings_in IS NULL THEN 0e0 WHEN earnings_in = -1 THEN 0.7e0 * 0.25e0 WHEN earnings_in < -1 OR earnings_in >= 10 THEN 0e0 WHEN earnings_in <= 3 THEN 0.7e0 ELSE 0.7e0 * (10 - earnings_in) / 7e0 END"
OVERHEAD = ramp("-below_high_pct", 8, 30, 0.2)


def inverted(x: str) -> str:
    """Lower is better, 0 to 1, within the pool: min-max from five rows on, places below, null in the middle."""
    w = "OVER (PARTITION BY session_date)"
    place = f"rank() OVER (PARTITION BY session_date ORDER BY {x} ASC NULLS LAST)"
    small = f"CASE WHEN count({x}) {w} = 1 THEN 1e0 ELSE 1 - ({place} - 1) / cast(count({x}) {w} - 1 AS double) END"
    big = f"CASE WHEN max({x}) {w} = min({x}) {w} THEN 0.5e0 ELSE (max({x}) {w} - {x}) / (max({x}) {w} - min({x}) {w}) END"
    return f"CASE WHEN {x} IS NULL THEN 0.5e0 WHEN count(*) {w} < 5 THEN {small} ELSE {big} END"


TIGHT = "CASE WHEN risk_20ma_pct > 0 AND (risk_50ma_pct IS NULL OR risk_50ma_pct <= 0 OR risk_20ma_pct <= risk_50ma_pct) THEN risk_20ma_pct WHEN risk_50ma_pct > 0 THEN risk_50ma_pct END"
derived(
    "focus",
    f"""WITH g AS (SELECT session_date AS d, name AS grp, rank_month + rank_quarter + rank_half AS sum_mid FROM {{panel}}),
c AS (SELECT k.*, m.version, m.w_group, m.w_tight, m.w_quiet, m.has_liq, m.has_earn, m.has_overhead, g.sum_mid, {TIGHT} AS tight FROM {{stock}} k JOIN {{methods}} m ON m.session_date = k.session_date LEFT JOIN g ON g.d = k.session_date AND g.grp = k.industry WHERE {BASE} AND {DQ}),
n AS (SELECT *, count(*) OVER (PARTITION BY session_date) AS pool, {inverted('sum_mid')} AS n_group, {inverted('tight')} AS n_tight, {inverted('range_atr')} AS n_quiet FROM c)
SELECT session_date, ticker, version, CASE WHEN pool = 1 THEN 1e0 ELSE (w_group * n_group + w_tight * n_tight + w_quiet * n_quiet) * (1 - ({EXTENSION})) END
  * (CASE WHEN has_liq = 1 THEN 1 - ({LIQUIDITY}) ELSE 1e0 END) * (CASE WHEN has_earn = 1 THEN 1 - ({EARNINGS}) ELSE 1e0 END) * (CASE WHEN has_overhead = 1 THEN 1 - ({OVERHEAD}) ELSE 1e0 END) AS focus_score FROM n""",
)

KEY = "session_date, ticker"

def _cents(x: str) -> str:
    """x / 100 to two places, halves up by the same arithmetic in any engine; round() takes 76.115 up in one and down in another. A decimal, whose text has no exponent."""
    return f"try_cast(floor({x} + 5e-1) / 100e0 AS decimal(20, 2))"


TEXTS = f"SELECT session_date, ticker, CASE WHEN ticker % 7 = 0 THEN '-' WHEN ticker % 11 = 0 THEN ' ' WHEN ticker % 13 = 0 THEN 'N/A' ELSE concat(' ', cast({_cents('sma20_pct * 100')} AS string), '%') END AS pct_text, CASE WHEN ticker % 7 = 0 THEN '-' ELSE concat(cast({_cents('close')} AS string), CASE ticker % 4 WHEN 0 THEN 'T' WHEN 1 THEN 'B' WHEN 2 THEN 'M' ELSE 'K' END) END AS cap_text, concat(cast(volume AS string), ',', '250') AS num_text FROM {{bars}}"


def scaled(text: str, unit: float) -> str:
    m = " ".join(f"WHEN '{s}' THEN {v / unit:e}" for s, v in (("T", 1e12), ("B", 1e9), ("M", 1e6), ("K", 1e3)))
    return f"try_cast(regexp_extract({text}, '^([0-9.]+)([TBMK]?)$', 1) AS double) * CASE regexp_extract({text}, '^([0-9.]+)([TBMK]?)$', 2) {m} ELSE {1 / unit:e} END"


CHAT = "SELECT conv_id, turn, role AS model, coalesce(length(text), 0) AS n_in, cast(floor(coalesce(length(text), 0) / 4e0) AS int) AS n_out, CASE WHEN turn % 3 = 0 THEN 17 END AS thoughts FROM {conversations}"
PRICES = "(VALUES ('user', 0, 0.5e0, 1.5e0), ('user', 2, 0.4e0, 1.2e0), ('assistant', 1, 2e0, 6e0)) AS v(model, from_turn, per_in, per_out)"

LATENCY = f"SELECT event_type, cast(count(*) AS int) AS n, {r('100e0 * count(*) / (SELECT count(*) FROM {events} WHERE value IS NOT NULL)', 'share')}, {r('median(value)', 'median_value')}, {r('P90', 'p90')} FROM {{events}} WHERE value IS NOT NULL GROUP BY event_type"

QUERIES = [
    Query("fn_pct", f"SELECT {KEY}, try_cast(regexp_replace(trim(pct_text), '%$', '') AS double) AS pct FROM ({TEXTS}) t"),
    Query("fn_cap_b", f"SELECT {KEY}, {r(scaled('cap_text', 1e9), 'cap_b')} FROM ({TEXTS}) t"),
    Query("fn_vol_raw", f"SELECT {KEY}, cast(floor({scaled('cap_text', 1.0)} + 5e-1) AS bigint) AS volume_raw FROM ({TEXTS}) t"),
    Query("fn_num", f"SELECT {KEY}, try_cast(replace(num_text, ',', '') AS double) AS num FROM ({TEXTS}) t"),
    Query("fn_slug", "SELECT DISTINCT industry, alnum(lower(industry)) AS slug FROM {trades}"),
    Query("fn_ma_level", f"SELECT {KEY}, {r('ma20')}, {r('ma50')}, {r('ma200')} FROM {{stock}}"),
    Query("fn_stock_metrics", f"SELECT {KEY}, {r('atr_ext_50')}, {r('risk_20ma_pct')}, {r('risk_50ma_pct')}, {r('range_atr')}, stage2 FROM {{stock}}"),
    Query("fn_atr_ext_20", f"SELECT {KEY}, {r('atr_ext_20')} FROM {{stock}}"),
    Query("fn_price_basis", f"SELECT {KEY}, basis, {r('(price - ma50) / nullif(atr, 0)', 'atr_ext_50')}, {r('(price - ma20) / nullif(price, 0)', 'risk_20ma_pct')}, {r('range_atr')} FROM (SELECT *, CASE WHEN basis = 'price' THEN close ELSE high END AS price FROM (SELECT *, each('price', 'high') AS basis FROM {{stock}}) b) t"),
    Query("fn_dollar_volume", f"SELECT {KEY}, floor(dollar_volume * 100 + 5e-1) / 100e0 AS dollar_volume FROM {{stock}}"),
    Query("fn_atr_pct", f"SELECT {KEY}, {r('atr_pct')} FROM {{stock}}"),
    Query("fn_penalty_ramp", f"SELECT {KEY}, {r(EXTENSION, 'extension')}, {r(LIQUIDITY, 'liquidity')}, {r(OVERHEAD, 'overhead')}, {r(EARNINGS, 'earnings')} FROM {{stock}}"),
    Query("fn_volatility_floor", f"SELECT {KEY}, {VOLATILITY} AS passes FROM (SELECT *, 12e0 AS vol_floor FROM {{stock}}) t"),
    Query("fn_launch_ready", f"SELECT {KEY}, CASE WHEN below_high_pct IS NULL OR atr_ext_50 IS NULL THEN NULL WHEN atr_ext_50 > 4 THEN 'extended' WHEN -below_high_pct > 8 THEN 'overhead' ELSE 'coiled' END AS band FROM {{stock}}"),
    Query("fn_power_of_3", f"SELECT {KEY}, greatest(close, ma20, ma50) - least(close, ma20, ma50) <= 1.5e0 * atr AS bunched FROM {{stock}}"),
    Query("fn_bands", "SELECT session_date, name, CASE WHEN momentum_accel >= 0.08 THEN 'surging' WHEN momentum_accel >= 0.02 THEN 'building' WHEN momentum_accel > -0.02 THEN 'flat' WHEN momentum_accel > -0.08 THEN 'fading' WHEN momentum_accel IS NOT NULL THEN 'falling' END AS accel_band, CASE WHEN regime_short_long >= 0.15 THEN 'short' WHEN regime_short_long <= -0.15 THEN 'long' WHEN regime_short_long IS NOT NULL THEN 'even' END AS regime_band FROM {panel}"),
    Query("fn_atr_from_lod", f"SELECT {KEY}, {r('(close - low) / nullif(atr, 0)', 'atr_from_lod')} FROM {{stock}}"),
    Query("fn_r_multiple", f"SELECT {KEY}, {r('CASE WHEN prior_high - prior_low > 0 THEN (close - prior_high) / (prior_high - prior_low) END', 'r_multiple')} FROM {{stock}}"),
    Query("fn_trade_ticket", f"SELECT {KEY}, basis, {r('price - stop', 'risk_per_share')}, {r('100 * (price - stop) / nullif(price, 0)', 'risk_pct')}, cast(floor(500 / nullif(price - stop, 0)) AS bigint) AS shares, coalesce((price - low) / nullif(atr, 0) > 1, false) AS chasing, coalesce(atr_ext_50 > 4, false) AS extended FROM (SELECT session_date, ticker, basis, close AS price, low, atr, atr_ext_50, CASE basis WHEN 'prior_low' THEN prior_low WHEN 'today_low' THEN low WHEN 'ma20' THEN ma20 ELSE ma50 END AS stop FROM (SELECT *, each('prior_low', 'today_low', 'ma20', 'ma50') AS basis FROM {{stock}}) b) t WHERE stop < price"),
    Query("fn_evidence_fields", f"SELECT {KEY}, {r('100 * (close - prior_low) / nullif(close, 0)', 'stop_gap_pct')}, {r('100 * (prior_high - close) / nullif(close, 0)', 'trigger_gap_pct')}, {r('(prior_high - close) / nullif(atr, 0)', 'gap_atr')}, {r('range_atr')}, {r('atr_ext_20')}, {r('atr_ext_50')} FROM {{stock}}"),
    Query("fn_earnings_days", "SELECT k, said, as_of, CASE WHEN hit IS NULL THEN NULL WHEN datediff(as_of, hit) > 180 THEN datediff(add_months(hit, 12), as_of) ELSE datediff(hit, as_of) END AS days FROM (SELECT k, said, as_of, try_to_timestamp(concat(cast(year(as_of) AS string), ' ', regexp_extract(said, '^([A-Z][a-z][a-z] [0-9]+)(/[ab])?$', 1)), 'yyyy MMM d') AS hit FROM (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 9 = 0 THEN '-' ELSE concat(date_format(o_orderdate, 'MMM d'), CASE o_orderkey % 3 WHEN 0 THEN '/a' WHEN 1 THEN '/b' ELSE '' END) END AS said, to_date(o_orderdate + make_interval(0, 0, 0, cast(o_custkey % 300 AS int))) AS as_of FROM {orders}) s) t",
          "SELECT k, said, as_of, CASE WHEN hit IS NULL THEN NULL WHEN datediff('day', hit, as_of) > 180 THEN datediff('day', as_of, CAST(hit + INTERVAL 12 MONTH AS DATE)) ELSE datediff('day', as_of, hit) END AS days FROM (SELECT k, said, as_of, CAST(try_strptime(concat(cast(year(as_of) AS string), ' ', regexp_extract(said, '^([A-Z][a-z][a-z] [0-9]+)(/[ab])?$', 1)), '%Y %b %-d') AS DATE) AS hit FROM (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 9 = 0 THEN '-' ELSE concat(strftime(o_orderdate, '%b %-d'), CASE o_orderkey % 3 WHEN 0 THEN '/a' WHEN 1 THEN '/b' ELSE '' END) END AS said, CAST(o_orderdate + to_days(cast(o_custkey % 300 AS int)) AS DATE) AS as_of FROM {orders}) s) t"),
    Query("fn_token_split", f"SELECT conv_id, turn, n_in, coalesce(n_out, 0) + coalesce(thoughts, greatest(0, cast(n_in / 10e0 AS int) - n_out)) AS billed_out FROM (SELECT conv_id, turn, n_in, n_out, thoughts FROM ({CHAT}) c) t"),
    Query("fn_watch_level", f"SELECT {KEY}, kind, CASE kind WHEN 'above' THEN close >= prior_high WHEN 'below' THEN close <= prior_low WHEN 'reclaim_20ma' THEN close > ma20 AND low < ma20 ELSE close > ma50 AND low < ma50 END AS hit FROM (SELECT *, each('above', 'below', 'reclaim_20ma', 'reclaim_50ma') AS kind FROM {{stock}}) t"),
    Query("fn_open_position", f"SELECT {KEY}, 'open' AS state, {r('close', 'entry_price')}, {r('low', 'current_stop')}, {r('low', 'profit_floor')}, '20ma' AS trail_basis, 'entered' AS event_type FROM {{stock}} WHERE low < close"),
    Query("fn_json_merge_config", "SELECT event_id, coalesce(try_cast(knob(props, '$.k') AS int), 7) AS knob_k, coalesce(knob(props, '$.basis'), '50ma') AS basis FROM {events}"),
    # days before the first version stay, without a volatility floor; versions are a row a session
    Query("flt_base_pick", f"SELECT /*+ BROADCAST(m) */ k.session_date, k.ticker FROM {{stock}} k LEFT JOIN {{methods}} m ON m.session_date = k.session_date WHERE {PICK}"),
    Query("flt_focus_dq", f"SELECT k.session_date, k.ticker FROM {{stock}} k JOIN {{methods}} m ON m.session_date = k.session_date WHERE {DQ}"),
    Query("jn_picks_expand", "SELECT session_date, list_category, grp, ticker FROM {picks}"),
    Query("jn_asof_version", "SELECT session_date, version FROM {methods}"),
    Query("jn_latest_bar", f"SELECT p.s_suppkey AS ticker, b.session_date AS last_date, {r('b.close', 'last_close')} FROM {{supplier}} p LEFT JOIN (SELECT ticker, max(session_date) AS session_date, max_by(close, session_date) AS close FROM {{bars}} GROUP BY ticker) b ON b.ticker = p.s_suppkey"),
    Query("jn_bars_after", f"SELECT ticker, session_date, cast(nth AS int) AS nth FROM (SELECT b.ticker, b.session_date, row_number() OVER (PARTITION BY b.ticker ORDER BY b.sidx) AS nth FROM {{bars}} b JOIN (SELECT ticker, max(sidx) AS opened FROM {{bars}} WHERE sidx <= ticker % 80 GROUP BY ticker) p ON p.ticker = b.ticker AND b.sidx > p.opened) t WHERE nth <= 30"),
    Query("jn_union_levels", "SELECT session_date, ticker, 'pick' AS kind FROM (SELECT DISTINCT session_date, ticker FROM {picks}) p UNION ALL SELECT /*+ MERGE(q) */ w.session_date, w.ticker, 'watch' AS kind FROM {bars} w LEFT ANTI JOIN (SELECT DISTINCT session_date, ticker FROM {picks}) q ON q.ticker = w.ticker AND q.session_date = w.session_date"),
    Query("jn_status", f"SELECT /*+ MERGE(p) */ p.session_date, p.ticker, {r('k.prior_high', 'trigger')}, coalesce({STATUS}, 'no_quote') AS status FROM (SELECT DISTINCT session_date, ticker FROM {{picks}}) p LEFT JOIN {{stock}} k ON k.ticker = p.ticker AND k.session_date = p.session_date".replace("k.prior_high", "prior_high")),
    Query("jn_prior_read", f"SELECT ticker, session_date, status, prior_status, status <> prior_status AS changed, {r('close - prior_close', 'price_change')} FROM (SELECT ticker, session_date, status, close, lag(status) OVER (PARTITION BY ticker ORDER BY sidx) AS prior_status, lag(close) OVER (PARTITION BY ticker ORDER BY sidx) AS prior_close FROM (SELECT *, {STATUS} AS status FROM {{stock}}) s) t"),
    Query("jn_watch_refs", f"SELECT w.ticker, {r('b.high', 'ref_high')}, {r('b.low', 'ref_low')}, b.ticker IS NOT NULL AS has_history FROM (SELECT DISTINCT user_id AS ticker FROM {{events}}) w LEFT JOIN (SELECT ticker, max_by(high, sidx) AS high, max_by(low, sidx) AS low FROM {{bars}} GROUP BY ticker) b ON b.ticker = w.ticker"),
    Query("w_tight_range", f"SELECT {KEY}, CASE WHEN count(high - low) OVER w = 7 THEN high - low <= min(high - low) OVER w END AS tight FROM {{bars}} WINDOW w AS (PARTITION BY ticker ORDER BY sidx ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"),
    Query("w_sparklines", f"SELECT {KEY}, n, spark FROM (SELECT ticker, session_date, cast(count(close) OVER w AS int) AS n, array_join(collect_list(cast(cast(floor(close * 100 + 5e-1) AS bigint) AS string)) OVER w, '|') AS spark FROM {{bars}} WINDOW w AS (PARTITION BY ticker ORDER BY sidx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) t WHERE n >= 3", f"SELECT {KEY}, n, spark FROM (SELECT ticker, session_date, cast(count(close) OVER w AS int) AS n, array_to_string(list(cast(cast(floor(close * 100 + 5e-1) AS bigint) AS string)) OVER w, '|') AS spark FROM {{bars}} WINDOW w AS (PARTITION BY ticker ORDER BY sidx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) t WHERE n >= 3"),
    Query("w_prev_close", f"SELECT {KEY}, {r('prev_close')} FROM {{bars}}"),
    Query("w_sessions_since", "SELECT ticker, cast((SELECT max(sidx) FROM {sess}) - max(sidx) AS int) AS sessions_since FROM {bars} GROUP BY ticker"),
    Query("w_focus_score", f"SELECT {KEY}, version, {r('focus_score')} FROM {{focus}}"),
    Query("sm_replay", f"SELECT session_date, ticker, version, {r('focus_score')}, cast(row_number() OVER (PARTITION BY session_date ORDER BY focus_score DESC, ticker) AS int) AS place FROM {{focus}}"),
    Query("tk_focus_universe", f"SELECT session_date, ticker, {r('focus_score')} FROM (SELECT *, row_number() OVER (PARTITION BY session_date ORDER BY focus_score DESC, ticker) AS place FROM {{focus}} WHERE focus_score >= 0.3) t WHERE place <= 100"),
    Query("tk_all_view_sort", f"SELECT /*+ MERGE(p) */ p.session_date, p.ticker, p.list_category, cast(row_number() OVER (PARTITION BY p.session_date ORDER BY CASE p.list_category WHEN 'leaders' THEN 1 WHEN 'emerging' THEN 2 WHEN 'accel' THEN 3 WHEN 'rs_new_high' THEN 4 ELSE 5 END, p.grp, k.atr_ext_50 ASC NULLS LAST, p.ticker) AS int) AS place FROM {{picks}} p JOIN {{stock}} k ON k.ticker = p.ticker AND k.sidx = p.sidx WHERE NOT (p.list_category = 'leaders' AND p.category_rank > 11)"),
    Query("tk_stratified_sample", f"SELECT ticker, cohort, cast(place AS int) AS place FROM (SELECT ticker, cohort, row_number() OVER (PARTITION BY cohort ORDER BY md5(concat('s|', cast(ticker AS string))), ticker) AS place FROM (SELECT ticker, CASE WHEN sum(stage2) > 10 THEN 'strong' ELSE 'weak' END AS cohort FROM {{stock}} GROUP BY ticker) c) t WHERE place <= 20"),
    Query("sm_pick_status", f"SELECT {KEY}, {STATUS} AS status FROM {{stock}}"),
    Query("sm_reclaim_ref", f"SELECT {KEY}, CASE WHEN close > ma20 AND (low < ma20 OR prior_low < ma20) THEN 'sma20' WHEN close > ma50 AND (low < ma50 OR prior_low < ma50) THEN 'sma50' END AS reclaimed FROM {{stock}}"),
    Query("ag_status_counts", f"WITH s AS (SELECT session_date, industry, atr_ext_50, status, lag(status) OVER (PARTITION BY ticker ORDER BY sidx) AS prior FROM (SELECT *, {STATUS} AS status FROM {{stock}}) k) SELECT session_date, cast(count(*) AS int) AS n, cast(sum(CASE WHEN status IN ('triggered', 'reclaim') THEN 1 ELSE 0 END) AS int) AS actionable, cast(sum(CASE WHEN status <> prior THEN 1 ELSE 0 END) AS int) AS changed, cast(count(prior) AS int) AS comparable, {r('median(CASE WHEN status IN (' + chr(39) + 'triggered' + chr(39) + ', ' + chr(39) + 'reclaim' + chr(39) + ') THEN atr_ext_50 END)', 'median_extension')} FROM s GROUP BY session_date"),
    Query("ag_spend", f"SELECT model, {r('sum(n_in * per_in + n_out * per_out) / 1e6', 'cost')}, cast(count(*) AS int) AS runs, cast(count(per_in) AS int) AS priced_runs, max(conv_id) AS last_run FROM (SELECT c.*, p.per_in, p.per_out FROM ({CHAT}) c LEFT JOIN (SELECT * FROM {PRICES} WHERE from_turn <= 1) p ON p.model = c.model) t GROUP BY model"),
    Query("ag_daily_calls", "SELECT day(ts) AS call_date, cast(count(*) AS int) AS calls FROM {events} GROUP BY day(ts)"),
    Query("ag_latency_bench", LATENCY.replace("P90", "percentile_disc(0.9) WITHIN GROUP (ORDER BY value)"), LATENCY.replace("P90", "quantile_disc(value, 0.9)")),
    Query("ag_ledger_recent", "SELECT user_id, event_id, event_type, cast(nth AS int) AS nth, last_purchase FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id) AS last_purchase FROM {events}) t WHERE nth <= 8"),
    Query("snk_keyed_dedup", "SELECT user_id, event_type, event_id FROM (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS nth FROM {events}) t WHERE nth = 1"),
    Query("snk_insert_ignore", "SELECT ticker, session_date, 'settled' AS source FROM {bars} WHERE sidx < 60 UNION ALL SELECT n.ticker, n.session_date, 'seed' AS source FROM {bars} n LEFT ANTI JOIN (SELECT ticker, session_date FROM {bars} WHERE sidx < 60) o ON o.ticker = n.ticker AND o.session_date = n.session_date"),
    Query("snk_dim_flag", "SELECT s.s_suppkey AS ticker, CASE WHEN r.ticker IS NOT NULL THEN true ELSE s.s_acctbal > 5000 END AS validated FROM {supplier} s LEFT JOIN (SELECT DISTINCT ticker FROM {bars} WHERE sidx = 80) r ON r.ticker = s.s_suppkey"),
    Query("sm_autoconfirm", f"SELECT ticker, {r('signal_price', 'exit_price')}, CASE WHEN last_sidx - sidx >= 5 THEN 'closed' ELSE 'closing' END AS state FROM (SELECT ticker, sidx, close AS signal_price, (SELECT max(sidx) FROM {{sess}}) AS last_sidx, row_number() OVER (PARTITION BY ticker ORDER BY sidx DESC) AS nth FROM {{stock}} WHERE close < ma50) t WHERE nth = 1"),
    Query("sm_stop_ack", "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prior FROM {events}) t WHERE prior IS NULL OR prior <> event_type"),
    Query("sm_alert_dedup", "SELECT user_id, alert_date, event_type, first_event FROM (SELECT user_id, day(ts) AS alert_date, event_type, min(event_id) AS first_event FROM {events} GROUP BY user_id, day(ts), event_type) a LEFT ANTI JOIN (SELECT DISTINCT user_id AS u, event_type AS e FROM {events} WHERE day(ts) = (SELECT min(day(ts)) FROM {events})) l ON l.u = a.user_id AND l.e = a.event_type"),
    Query("st_union_universe", "SELECT DISTINCT ticker FROM (SELECT s_suppkey AS ticker FROM {supplier} UNION ALL SELECT user_id AS ticker FROM {events}) t"),
    Query("st_union_sessions", "SELECT event_id, 'morning' AS session FROM {events} WHERE hour(ts) < 10 UNION ALL SELECT event_id, 'pre_close' AS session FROM {events} WHERE hour(ts) < 15"),
    # override rows for every industry, some of which are misspelt, by name and by the sector that they give
    Query("dq_unknown_names", "SELECT o.name, o.sector, CASE WHEN s.sector IS NULL THEN 'unknown_sector' ELSE 'unknown_name' END AS finding FROM (SELECT industry AS given, CASE WHEN length(industry) % 5 = 0 THEN concat(industry, ' ') WHEN length(industry) % 7 = 0 THEN lower(industry) ELSE industry END AS name, CASE WHEN length(industry) % 4 = 0 THEN upper(concat(sector, 's')) ELSE sector END AS sector FROM (SELECT DISTINCT industry, sector FROM {trades}) t) o LEFT JOIN (SELECT DISTINCT concat(p_brand, '/', p_type) AS name FROM {part}) p ON p.name = o.name LEFT JOIN (SELECT DISTINCT p_type AS sector FROM {part}) s ON s.sector = o.sector WHERE p.name IS NULL OR s.sector IS NULL",
          "SELECT name, sector, CASE WHEN sector NOT IN (SELECT p_type FROM part) THEN 'unknown_sector' ELSE 'unknown_name' END AS finding FROM (SELECT DISTINCT CASE WHEN length(p_brand || '/' || p_type) % 5 = 0 THEN p_brand || '/' || p_type || ' ' WHEN length(p_brand || '/' || p_type) % 7 = 0 THEN lower(p_brand || '/' || p_type) ELSE p_brand || '/' || p_type END AS name, CASE WHEN length(p_brand || '/' || p_type) % 4 = 0 THEN upper(p_type || 's') ELSE p_type END AS sector FROM lineitem JOIN part ON l_partkey = p_partkey) o WHERE (name, sector) NOT IN (SELECT p_brand || '/' || p_type, p_type FROM part)"),
    Query("dq_completeness", "SELECT /*+ MERGE(h) */ q.conv_id, q.role FROM (SELECT DISTINCT conv_id, each('user', 'assistant', 'system') AS role FROM {conversations}) q LEFT ANTI JOIN {conversations} h ON h.conv_id = q.conv_id AND h.role = q.role"),
]
