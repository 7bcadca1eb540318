"""Queries on pages, texts, stores and watch lists."""

from __future__ import annotations

from sessionforge.operators.stocks import KEY
from sessionforge.plans.registry import Query, r

#: Names are words of the benchmark's texts; an answer's words are held against those of the turn before it.
NAMES = r"""WITH n AS (SELECT DISTINCT w AS name, lower(w) AS folded FROM (SELECT SPLIT(text, '[^\pL\pN_]+')) AS w FROM {benchmark}) b WHERE w <> ''),
o AS (SELECT DISTINCT conv_id, turn, w FROM (SELECT conv_id, turn, SPLIT(text, '[^\pL\pN_]+')) AS w FROM {conversations} WHERE role = 'assistant') a),
i AS (SELECT DISTINCT conv_id, turn + 1 AS answered, lower(w) AS folded FROM (SELECT conv_id, turn, SPLIT(text, '[^\pL\pN_]+')) AS w FROM {conversations}) c),
u AS (SELECT /*+ MERGE(n) */ o.conv_id, o.turn, n.name, n.folded FROM o JOIN n ON n.name = o.w),
x AS (SELECT /*+ MERGE(i) */ u.conv_id, u.turn, u.name FROM u LEFT ANTI JOIN i ON i.conv_id = u.conv_id AND i.answered = u.turn AND i.folded = u.folded)
SELECT conv_id, turn, cast(count(*) AS int) AS n_names, min(name) AS first_name FROM x GROUP BY conv_id, turn"""
RAW_BARS = f"""SELECT {KEY}, close, CASE WHEN ticker % 3 = 0 THEN cast(ticker % 40 AS int) END AS typed, concat(chr(123), '"SMA20":"', cast(cast(floor(sma20_pct * 10) AS bigint) AS string), '%","SMA50":"', cast(cast(floor(sma50_pct) AS bigint) AS string), '%","SMA200":"', CASE WHEN ticker % 5 = 0 THEN '-' ELSE cast(cast(floor(sma200_pct) AS bigint) AS string) END, '%","Days":', cast(ticker % 60 AS string), chr(125)) AS raw FROM {{bars}}"""


def level(given: str) -> str:
    """A moving average from the percent distance in a raw quote; null for a distance of -100 percent or less."""
    share = f"1 + try_cast(replace({given}, '%', '') AS double) / 100"
    return f"CASE WHEN {share} > 0 THEN close / ({share}) END"


def normalized(given: str, rows: str) -> str:
    """Bars of quotes whose labels `given` names."""
    of = lambda label: given.replace("LABEL", label)
    return f"SELECT {KEY}, {', '.join(r(level(of(f'SMA{n}')), f'ma{n}') for n in (20, 50, 200))}, coalesce(typed, try_cast({of('Days')} AS int)) AS days_to_earnings FROM ({rows}) t"


#: Spark reads a quote once for all labels.
LABELS = f"SELECT {KEY}, close, typed, json_tuple(raw, 'SMA20', 'SMA50', 'SMA200', 'Days') AS (said_SMA20, said_SMA50, said_SMA200, said_Days) FROM ({RAW_BARS}) q"


QUERIES = [
    Query("src_page_facts", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang, cast((length(html) - length(replace(html, '<li>', ''))) / 4 AS int) AS n_items FROM {pages}"),
    Query("src_page_track", "SELECT page_id, try_cast(regexp_extract(html, 'track[(]([0-9]+)[)]', 1) AS int) AS tracked FROM {pages}"),
    Query("dq_text_names", NAMES.replace("SPLIT", "explode(split").replace("\\pL\\pN", "\\\\pL\\\\pN"), NAMES.replace("SPLIT", "unnest(regexp_split_to_array")),
    Query("tk_watch_list", "SELECT user_id, event_id, cast(row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END, event_id DESC) AS int) AS place FROM {events}"),
    Query("jn_positions_view", f"SELECT p.ticker, p.state, {r('b.last_close', 'last_close')}, cast(p.last_sidx - p.sidx AS int) AS sessions_since FROM (SELECT ticker, sidx, CASE WHEN close < ma50 THEN 'closed' ELSE 'open' END AS state, (SELECT max(sidx) FROM {{sess}}) AS last_sidx, row_number() OVER (PARTITION BY ticker ORDER BY sidx DESC) AS nth FROM {{stock}}) p LEFT JOIN (SELECT ticker, max_by(close, sidx) AS last_close FROM {{bars}} GROUP BY ticker) b ON b.ticker = p.ticker WHERE p.nth = 1 AND (p.state = 'open' OR p.last_sidx - p.sidx <= 10)"),
    Query("fn_normalize_bar", normalized("said_LABEL", LABELS), normalized("knob(raw, '$.LABEL')", RAW_BARS)),
    Query("fn_canonical_hash", f"SELECT {KEY}, sha(concat('[', cast(cast(floor(close * 1e4 + 5e-1) AS bigint) AS string), ',', cast(volume AS string), ']')) AS digest FROM {{bars}}"),
]
