"""Gates before writes: sessions that may be written, batches that are too small, headers and keys that show a broken parse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionforge.operators import selection  # noqa: F401  (gives `sel` its name)
from sessionforge.plans.registry import RELATIONS, Query
from sessionforge.sources.files import cells
from sessionforge.sources.gated import Gate, GatedStore, attempt
from sessionforge.sources.market import shared_folder, table

# Sessions, whether they are settled; rows expected of a level; limits of a batch.
SESSIONS = {"eod": True, "morning": False, "pre_close": False}
EXPECTED_ROWS = {"sector": 8, "industry": 100}
HEADER_MISSING_MOST, DOUBLED_MOST, SINGLE_MOST = 0.10, 0.25, 0.30

_named = lambda keys: ", ".join(f"'{k}'" for k in keys)
#: Only rows of sessions that are known and not settled may enter a provisional store.
PROVISIONAL = Gate(refused={"unknown session": f"session is null OR session NOT IN ({_named(SESSIONS)})", "settled session": f"session IN ({_named(k for k, settled in SESSIONS.items() if settled)})"})
#: A key whose first two characters are alike, and one of a single character: signs of a parse that reads the wrong cell.
DOUBLED, SINGLE = "length(key) >= 2 AND substr(key, 1, 1) = substr(key, 2, 1)", "length(key) = 1"
SOUND_KEYS = Gate(shares={"doubled keys": (DOUBLED, DOUBLED_MOST), "single keys": (SINGLE, SINGLE_MOST)})


def verdicts(spark: SparkSession, attempts: list[tuple], columns: str) -> DataFrame:
    return spark.createDataFrame(attempts, columns)


def session_rows(events: DataFrame) -> DataFrame:
    """Events with the session that their hour belongs to; events of one kind name a session that isn't known."""
    hour = F.hour("ts")
    session = F.when(F.col("event_type") == "error", "lunch").when(hour >= 16, "eod").when(hour < 10, "morning").otherwise("pre_close")
    return events.select(F.to_date("ts").alias("session_date"), "event_id", session.alias("session"))


def snk_session_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A provisional store after writes of each session's events, and of all at once: verdict, and the store's rows by then."""
    rows = session_rows(table(spark, sf_dir, "events"))
    store = GatedStore(spark, shared_folder(spark), "session_date date, event_id long, session string", ["session_date", "event_id"])
    batches = {"all": rows} | {s: rows.where(F.col("session") == s) for s in ("eod", "lunch", "morning", "pre_close")}
    out = [(n, name, *attempt(store, batch, PROVISIONAL)) for n, (name, batch) in enumerate(batches.items())]
    return verdicts(spark, out, "nth int, batch string, verdict string, n_stored long")


def dq_empty_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of groups at new highs after batches of one session each, some of which select nothing."""
    picked = RELATIONS["sel"](spark, sf_dir).where("list_category = 'rs_new_high'").select("session_date", "name").distinct()
    store = GatedStore(spark, shared_folder(spark), "session_date date, name string", ["session_date"])
    days = [r["session_date"] for r in RELATIONS["sess"](spark, sf_dir).where("sidx IN (0, 40, 60) OR sidx = last_sidx").orderBy("sidx").select("session_date").collect()]
    out = [(day, *attempt(store, picked.where(F.col("session_date") == F.lit(day)), Gate())) for day in days]
    return verdicts(spark, out, "session_date date, verdict string, n_stored long")


def _few(level: str, source: str) -> str:
    return f"SELECT '{level}' AS level, s.session_date, cast(count(g.name) AS int) AS n_rows, CASE WHEN count(g.name) = 0 THEN 'abort' WHEN count(g.name) < {EXPECTED_ROWS[level]} THEN 'warn' ELSE 'ok' END AS verdict FROM {{sess}} s LEFT JOIN {source} g ON g.session_date = s.session_date GROUP BY s.session_date"


#: Batches of a session and level; every third industry session is short, every seventh sector session empty.
_short = "(SELECT * FROM {snap} WHERE sidx % 3 <> 1 OR name < 'Brand#2')"
_none = "(SELECT * FROM {ssnap} WHERE sidx % 7 <> 3)"


def seen_labels(pages: DataFrame, by: list[str], html: Column) -> DataFrame:
    """(*by, seen): the labels that any page of a batch shows in a table with rows; pages without rows show none."""
    rows = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1)), cells)
    labels = F.transform(F.array(rows), lambda r: F.when(F.size(r) > 1, r[0]).otherwise(F.array().cast("array<string>")))[0]
    return pages.select(*by, F.explode_outer(labels).alias("label")).groupBy(*by).agg(F.collect_set("label").alias("seen"))


def header_verdict(seen: Column, expected: list[str], key: str) -> tuple[Column, Column]:
    """The expected labels that were not seen, in order, and what to do: ok, warn, or abort if the key is missing or too many are. Where nothing was seen, nothing is judged."""
    missing = F.when(F.size(seen) == 0, F.array().cast("array<string>")).otherwise(F.array_sort(F.array_except(F.array(*map(F.lit, expected)), seen)))
    action = F.when(F.size(missing) == 0, "ok").when(F.array_contains(missing, key) | (F.size(missing) > HEADER_MISSING_MOST * len(expected)), "abort").otherwise("warn")
    return missing, action


HEADER = ["Ticker", "Company", "Price", "Change", "Volume", "Open", "High", "Low", "ATR", "RSI", "Beta", "Target"]


def dq_header_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of pages, a page a session and industry, some of whose labels were renamed; read back and judged by session."""
    bars = RELATIONS["bars"](spark, sf_dir).groupBy("session_date", "industry", "sidx").agg(F.count("*").alias("n"))
    # of label i, all pages of a session lose it, or all but those of one brand, or none; one page in nine has no rows
    cell = [F.concat(F.lit("<th>"), F.when((F.col("sidx") % 11 == i) & ((F.col("sidx") % 2 == 0) | ~F.col("industry").startswith("Brand#11")) | ((F.col("sidx") % 13 == 5) & F.lit(i in (3, 7))), f"New {h}").otherwise(h), F.lit("</th>")) for i, h in enumerate(HEADER)]
    body = F.when((F.col("sidx") + F.length("industry")) % 9 == 0, "").otherwise("<tr><td>x</td></tr>")
    html = F.concat(F.lit("<table><tr>"), *cell, F.lit("</tr>"), body, F.lit("</table>"))
    missing, action = header_verdict(F.col("seen"), HEADER, "Ticker")
    return seen_labels(bars, ["session_date"], html).select("session_date", F.array_join(missing, "|").alias("missing"), action.alias("verdict"))


#: Keys of a session's rows; in some sessions the parse doubles the first character of many or leaves only it.
KEYS = "SELECT session_date, sidx, CASE WHEN sidx % 4 = 1 AND ticker % 3 < sidx % 3 THEN concat(substr(k, 1, 1), k) WHEN sidx % 4 = 2 AND ticker % 5 < sidx % 5 THEN substr(k, 1, 1) ELSE k END AS key FROM (SELECT session_date, sidx, ticker, concat('T', cast(ticker AS string)) AS k FROM {bars}) b"
_plants = """SELECT session_date, CASE WHEN sidx % 4 = 1 THEN avg(CASE WHEN ticker % 3 < sidx % 3 THEN 1e0 ELSE 0e0 END) ELSE 0e0 END AS doubled, CASE WHEN sidx % 4 = 2 THEN avg(CASE WHEN ticker % 5 < sidx % 5 THEN 1e0 ELSE 0e0 END) ELSE 0e0 END AS single FROM {bars} GROUP BY session_date, sidx"""


def dq_key_corruption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rates of doubled and single keys by session, and what the gate would do."""
    keys = Query("keys", KEYS).run(spark, sf_dir).groupBy("session_date").agg(*[F.avg(F.expr(f"cast({c} as double)")).alias(n) for n, c in (("doubled", DOUBLED), ("single", SINGLE))])
    verdict = F.when(F.col("doubled") > DOUBLED_MOST, "abort: doubled keys").when(F.col("single") > SINGLE_MOST, "abort: single keys").otherwise("ok")
    return keys.select("session_date", *[(F.floor(F.col(c) * 1e6 + 0.5) / 1e6).alias(c) for c in ("doubled", "single")], verdict.alias("verdict"))


QUERIES = [Query("dq_min_rows", f"{_few('industry', _short)} UNION ALL {_few('sector', _none)}")]
FUNCTIONS = {f.__name__: f for f in (snk_session_guard, dq_empty_batch, dq_header_drift, dq_key_corruption)}

_session = "CASE WHEN event_type = 'error' THEN 'lunch' WHEN hour(ts) >= 16 THEN 'eod' WHEN hour(ts) < 10 THEN 'morning' ELSE 'pre_close' END"
_label = " UNION ALL ".join(f"SELECT {i} AS i, '{h}' AS h" for i, h in enumerate(HEADER))
SQL = {
    "snk_session_guard": f"""WITH s AS (SELECT count(*) FILTER ({_session} = 'morning') AS m, count(*) FILTER ({_session} = 'pre_close') AS p FROM events)
SELECT CAST(nth AS INT) AS nth, batch, verdict, CASE batch WHEN 'morning' THEN m WHEN 'pre_close' THEN m + p ELSE 0 END AS n_stored
FROM s, (VALUES (0, 'all', 'abort: unknown session'), (1, 'eod', 'abort: settled session'), (2, 'lunch', 'abort: unknown session'), (3, 'morning', 'ok'), (4, 'pre_close', 'ok')) v(nth, batch, verdict)""",
    "dq_empty_batch": Query(
        "dq_empty_batch",
        "WITH d AS (SELECT s.session_date, count(DISTINCT x.name) AS n FROM {sess} s LEFT JOIN {sel} x ON x.session_date = s.session_date AND x.list_category = 'rs_new_high' WHERE s.sidx IN (0, 40, 60) OR s.sidx = s.last_sidx GROUP BY s.session_date) SELECT session_date, CASE WHEN n = 0 THEN 'abort: no rows' ELSE 'ok' END AS verdict, CAST(sum(n) OVER (ORDER BY session_date) AS BIGINT) AS n_stored FROM d",
    ).sql(),
    "dq_header_drift": Query(
        "dq_header_drift",
        f"""WITH p AS (SELECT DISTINCT session_date, sidx, industry FROM {{bars}}), l AS ({_label}),
v AS (SELECT p.session_date, l.h, bool_or((sidx + length(industry)) % 9 <> 0) AS read, bool_or((sidx + length(industry)) % 9 <> 0 AND NOT (sidx % 11 = i AND (sidx % 2 = 0 OR substr(industry, 1, 8) <> 'Brand#11') OR sidx % 13 = 5 AND i IN (3, 7))) AS shown FROM p, l GROUP BY p.session_date, l.h)
SELECT session_date, coalesce(string_agg(h, '|' ORDER BY h) FILTER (read AND NOT shown), '') AS missing, CASE WHEN count(*) FILTER (read AND NOT shown) = 0 THEN 'ok' WHEN count(*) FILTER (read AND NOT shown) > 1 OR bool_or(h = 'Ticker' AND read AND NOT shown) THEN 'abort' ELSE 'warn' END AS verdict FROM v GROUP BY session_date""",
    ).sql(),
    "dq_key_corruption": Query("dq_key_corruption", f"SELECT session_date, floor(doubled * 1e6 + 5e-1) / 1e6 AS doubled, floor(single * 1e6 + 5e-1) / 1e6 AS single, CASE WHEN doubled > {DOUBLED_MOST}e0 THEN 'abort: doubled keys' WHEN single > {SINGLE_MOST}e0 THEN 'abort: single keys' ELSE 'ok' END AS verdict FROM ({_plants}) t").sql(),
}
