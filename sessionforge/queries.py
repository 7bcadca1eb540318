"""All panel queries and their SQL twins, by ID."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sessionforge.operators import answer_rules, asof, calendar, feeds, gates, packs, panel_columns, payloads, preclose, selection, stocks, stores, trades, watch
from sessionforge.streaming import runs

MODULES = (panel_columns, selection, stocks, stores, feeds, gates)


#: Queries that aren't one SQL text: folds over arrays, and streams.
FUNCTIONS = trades.FUNCTIONS | {"ss_session_bars": runs.session_bars, "ss_quote_ingest": runs.quote_ingest, "ss_status": runs.status, "ss_alerts": runs.alerts, "ss_watch_ttl": runs.watch_ttl, "ss_positions": runs.positions} | feeds.FUNCTIONS | packs.FUNCTIONS | calendar.FUNCTIONS | gates.FUNCTIONS | preclose.FUNCTIONS | asof.FUNCTIONS | answer_rules.FUNCTIONS | watch.FUNCTIONS | payloads.FUNCTIONS


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.name: q.run for m in MODULES for q in m.QUERIES} | FUNCTIONS


def oracle_sql() -> dict[str, str]:
    return {q.name: q.sql() for m in MODULES for q in m.QUERIES if q.checked} | {"ss_session_bars": runs.SESSION_BARS_SQL, "ss_quote_ingest": runs.QUOTE_INGEST_SQL, "ss_status": runs.STATUS_SQL, "ss_alerts": runs.ALERTS_SQL, "ss_watch_ttl": runs.WATCH_TTL_SQL, "ss_positions": runs.POSITIONS_SQL} | feeds.SQL | packs.SQL | trades.SQL | calendar.SQL | gates.SQL | preclose.SQL | asof.SQL | answer_rules.SQL | watch.SQL | payloads.SQL
