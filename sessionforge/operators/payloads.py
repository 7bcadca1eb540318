"""Rules on payloads of JSON text: positions, batches of quotes, entries of the watch list and changes to them.

A payload is parsed once into a variant, and each rule is a column expression on it. The first rule that a
payload breaks names its problem; of one that breaks none the problem is null, and its values are given in
their normal form. Numbers must be JSON numbers where a rule says so: a price as text is no price. A missing
key and a null are the same but where a change of a watch entry says which keys it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionforge.operators.watch import level_problem
from sessionforge.sources.market import table

# Names of tickers and dates, what a first stop may stand on.
TICKER, DATE = r"^[A-Z][A-Z0-9.\-]{0,9}$", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
STOP_BASES = ("prior_day_low", "todays_low", "20ma", "50ma", "manual")
#: Numbers of a quote, unless others are asked for.
QUOTE_NUMBERS = ("open", "high", "low", "close", "volume")

NUMBERS = ("bigint", "decimal", "double", "float")


def kind(body: Column, key: str = "") -> Column:
    """The kind of a variant or of what it holds under a key: object, array, string, bigint, decimal, double, boolean or void; null if the key is missing."""
    of = F.try_variant_get(body, f"$.{key}", "variant") if key else body
    return F.lower(F.regexp_extract(F.schema_of_variant(of), "^[A-Za-z]+", 0))


def text_of(body: Column, key: str) -> Column:
    return F.when(kind(body, key) == "string", F.try_variant_get(body, f"$.{key}", "string"))


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\x0b\f\r\u00a0"))


def number_of(body: Column, key: str) -> Column:
    """A finite JSON number as a double, else null."""
    n = F.try_variant_get(body, f"$.{key}", "double")
    return F.when(kind(body, key).isin(*NUMBERS) & ~F.isnan(n) & (F.abs(n) < float("inf")), n)


def given(body: Column, key: str) -> Column:
    return F.coalesce(kind(body, key) != "void", F.lit(False))


def ticker_of(body: Column) -> Column:
    """The ticker in capitals, null if it isn't one."""
    name = F.upper(stripped(text_of(body, "ticker")))
    return F.when(name.rlike(TICKER), name)


def day_of(body: Column, key: str) -> Column:
    """A date that is in the calendar and written out in full, else null."""
    day = F.when(text_of(body, key).rlike(DATE), text_of(body, key))
    return F.to_date(F.try_to_timestamp(day, F.lit("yyyy-MM-dd")))


def first_problem(*rules: tuple[Column, str | Column]) -> Column:
    """The name of the first rule whose condition holds; a condition that is null counts as broken."""
    out = F.lit(None).cast("string")
    for broken, name in reversed(rules):
        out = F.when(F.coalesce(broken, F.lit(True)), name if isinstance(name, Column) else F.lit(name)).otherwise(out)
    return out


def not_object(body: Column) -> Column:
    return kind(body) != "object"


def position_problem(body: Column, today: Column) -> Column:
    """What keeps a payload from opening a position on the day `today`."""
    entry, stop, qty = (number_of(body, k) for k in ("entry_price", "initial_stop", "qty"))
    basis, dated = text_of(body, "stop_basis"), given(body, "entry_date") & ~F.coalesce(text_of(body, "entry_date") == "", F.lit(False))
    return first_problem(
        (not_object(body), "body"),
        (ticker_of(body).isNull(), "ticker"),
        (entry <= 0, "entry_price"),
        (stop <= 0, "initial_stop"),
        (qty <= 0, "qty"),
        (stop >= entry, "stop not below entry"),
        (~F.coalesce(basis, F.lit("manual")).isin(*STOP_BASES), "stop_basis"),
        (given(body, "meta") & (kind(body, "meta") != "object"), "meta"),
        (dated & day_of(body, "entry_date").isNull(), "entry_date"),
        (dated & (day_of(body, "entry_date") > today), "entry_date in the future"),
    )


def position_value(body: Column) -> Column:
    """A sound payload in its normal form: source manual unless it says picks, basis manual unless told, whole days to earnings."""
    picks = F.coalesce(F.try_variant_get(body, "$.meta.source", "string") == "picks", F.lit(False))
    return F.struct(
        ticker_of(body).alias("ticker"),
        *[number_of(body, k).alias(k) for k in ("entry_price", "initial_stop", "qty")],
        F.coalesce(text_of(body, "stop_basis"), F.lit("manual")).alias("stop_basis"),
        F.when(picks, "picks").otherwise("manual").alias("source"),
        number_of(body, "days_to_earnings").cast("int").alias("days_to_earnings"),
        day_of(body, "entry_date").alias("entry_date"),
    )


def quotes_problem(body: Column) -> Column:
    """What keeps a batch of quotes out; one bad quote keeps out the batch, and is named by its place."""
    quotes = F.when(kind(body, "quotes") == "array", F.try_variant_get(body, "$.quotes", "array<variant>"))

    def of(quote: Column, i: Column) -> Column:
        return first_problem((kind(quote) != "object", F.format_string("quotes[%d]", i)), (ticker_of(quote).isNull(), F.format_string("quotes[%d].ticker", i)), (given(quote, "raw") & (kind(quote, "raw") != "object"), F.format_string("quotes[%d].raw", i)))

    bad = F.get(F.filter(F.transform(quotes, of), lambda p: p.isNotNull()), F.lit(0))
    return first_problem(
        (not_object(body), "body"),
        (~stripped(text_of(body, "trade_date")).rlike(DATE), "trade_date"),
        (stripped(text_of(body, "collected_at")) == "", "collected_at"),
        (F.size(quotes) <= 0, "quotes"),
        (bad.isNotNull(), bad),
    )


def quote_rows(batches: DataFrame, body: str = "body", numbers: tuple[str, ...] = QUOTE_NUMBERS) -> DataFrame:
    """(trade_date, collected_at, ticker, *numbers, raw) of every quote of the sound batches, body being a variant.

    Numbers may be written as text, what is none is null. raw is the quote's own raw object, or else the whole
    quote without the time it was collected at.
    """
    b, q = F.col(body), F.col("_q")
    sound = batches.where(quotes_problem(b).isNull())
    rows = sound.select(stripped(text_of(b, "trade_date")).alias("trade_date"), stripped(text_of(b, "collected_at")).alias("collected_at"), F.explode(F.try_variant_get(b, "$.quotes", "array<variant>")).alias("_q"))

    def lenient(key: str) -> Column:
        n = F.coalesce(number_of(q, key), stripped(text_of(q, key)).try_cast("double"))
        return F.when(~F.isnan(n) & (F.abs(n) < float("inf")), n)

    rest = F.to_json(F.map_filter(q.cast("map<string,variant>"), lambda k, _: ~k.isin("raw", "collected_at")))
    raw = F.when(given(q, "raw"), F.to_json(F.try_variant_get(q, "$.raw", "variant"))).otherwise(rest)
    return rows.select("trade_date", "collected_at", ticker_of(q).alias("ticker"), *[lenient(c).alias(c) for c in numbers], raw.alias("raw"))


def level_of(body: Column) -> tuple[Column, Column]:
    """(level_type, level_value) as columns: a type that is no text is told as unknown, a value that is no number as NaN."""
    level = F.when(given(body, "level_type"), F.coalesce(text_of(body, "level_type"), F.lit("?")))
    value = F.when(given(body, "level_value"), F.coalesce(number_of(body, "level_value"), F.lit(float("nan"))))
    return level, value


def added_problem(body: Column) -> Column:
    """What keeps a payload from adding a watch entry."""
    level = level_problem(*level_of(body))
    return first_problem((not_object(body), "body"), (ticker_of(body).isNull(), "ticker"), (level.isNotNull(), level))


def change_of(body: Column) -> Column:
    """What a change of a watch entry asks for: renew, remove or restore, in this order, else an edit if it names a level; else null."""
    asks = F.coalesce(*[F.when((kind(body, k) == "boolean") & F.try_variant_get(body, f"$.{k}", "boolean"), k) for k in ("renew", "remove", "restore")])
    return F.coalesce(asks, F.when(kind(body, "level_type").isNotNull() | kind(body, "level_value").isNotNull(), "edit"))


def changed_problem(body: Column) -> Column:
    """What keeps a payload from changing a watch entry."""
    level = level_problem(*level_of(body))
    return first_problem((not_object(body), "body"), (change_of(body).isNull(), "nothing to change"), (F.when(change_of(body) == "edit", level).isNotNull(), level))


#: Payloads of events by kind. The n-th form of a kind is planted in the events whose event_id leaves n.
_name = "concat('t', cast(user_id AS string))"
_price = "cast(value AS string)"


def _body(*parts: str) -> str:
    return "concat('{', " + ", ', ', ".join(parts) + ", '}')"


def _put(key: str, value: str) -> str:
    return f"concat('\"{key}\": ', {value})"


def _said(value: str) -> str:
    return f"concat('\"', {value}, '\"')"


_ticker, _entry, _stop, _qty = _put("ticker", _said(_name)), _put("entry_price", "cast(value + 2 AS string)"), _put("initial_stop", "cast(value + 1 AS string)"), _put("qty", "cast(event_id % 50 + 1 AS string)")
_date = lambda d: _put("entry_date", _said(d))
POSITIONS = (
    _body(_put("ticker", _said(f"concat('  ', {_name}, ' ')")), _entry, _stop, _qty),
    _body(_entry, _stop, _qty),
    _body(_put("ticker", _said("cast(user_id AS string)")), _entry, _stop, _qty),
    _body(_put("ticker", _said(f"concat({_name}, 'ABCDEFGHIJ')")), _entry, _stop, _qty),
    _body(_ticker, _put("entry_price", "'0'"), _stop, _qty),
    _body(_ticker, _put("entry_price", _said(_price)), _stop, _qty),
    _body(_ticker, _entry, _put("initial_stop", "cast(value + 2 AS string)"), _qty),
    _body(_ticker, _entry, _put("initial_stop", "concat('-', cast(value + 1 AS string))"), _qty),
    _body(_ticker, _entry, _stop, _put("qty", "'null'")),
    _body(_ticker, _entry, _stop, _qty, _put("stop_basis", _said("'guess'"))),
    _body(_ticker, _entry, _stop, _qty, _put("meta", "'[1, 2]'")),
    _body(_ticker, _entry, _stop, _qty, _date("'2023-02-30'")),
    _body(_ticker, _entry, _stop, _qty, _date("cast(date_add(ts, cast(event_id % 5 AS int) - 2) AS string)")),
    f"concat('[', {_body(_ticker)}, ']')",
    _body(_ticker, _entry, _stop, _qty, _date("''"), _put("stop_basis", "'null'")),
    _body(_ticker, _entry, _stop, _qty, _put("stop_basis", _said("'20ma'")), _put("meta", "'{\"source\": \"picks\"}'"), _put("days_to_earnings", "'7.9'")),
)
_level = lambda kind, *value: (_put("level_type", _said(f"'{kind}'")), *[_put("level_value", v) for v in value])
ADDS = (
    _body(_ticker), _body(_ticker, *_level("above", "cast(value + 1 AS string)")), _body(_ticker, *_level("below", "'0'")), _body(_ticker, *_level("sideways", "'1'")),
    _body(_ticker, *_level("reclaim_20ma")), _body(_ticker, *_level("reclaim_50ma", _price)), _body(_ticker, _put("level_value", "'3'")), _body(_put("ticker", "'5'"), *_level("above", "'1'")), _body(_ticker, *_level("below", _said(_price))),
)
CHANGES = (_body(_put("renew", "'true'"), _put("remove", "'true'")), _body(_put("remove", "'true'")), _body(_put("restore", "'true'"), *_level("sideways")), _body(_put("renew", _said("'true'"))), _body(*_level("below", "cast(value + 1 AS string)")), _body(_put("level_type", "'null'")), "'{'")
_quote = lambda *parts: _body(*parts, _put("close", _price), _put("open", _said(_price)))
_batch = lambda *quotes: _body(_put("trade_date", _said("cast(to_date(ts) AS string)")), _put("collected_at", _said("cast(ts AS string)")), _put("quotes", "concat('[', " + ", ', ', ".join(quotes) + ", ']')"))
BATCHES = (
    _batch(_quote(_ticker)), _batch(_quote(_ticker), _quote(_put("ticker", _said("'SPY'")))), _batch(_quote(_ticker), _quote(_put("ticker", _said("'S P Y'")))), _batch(_quote(_ticker), "'7'"), _batch(_quote(_ticker, _put("raw", "'[]'"))), _batch("''"),
    _body(_put("trade_date", _said("'1/2/2024'")), _put("collected_at", _said("'x'"))), _body(_put("trade_date", _said("'2024-01-02'")), _put("collected_at", _said("'  '"))), _batch(_quote(_ticker, _put("raw", "'{\"a\": 1}'"))),
)


def _planted(forms: tuple[str, ...]) -> str:
    return f"CASE event_id % {len(forms)} " + " ".join(f"WHEN {i} THEN {form}" for i, form in enumerate(forms)) + " END"


_KINDS = {"purchase": ("position", POSITIONS), "signup": ("add", ADDS), "error": ("change", CHANGES), "view": ("quotes", BATCHES)}


def payloads(events: DataFrame) -> DataFrame:
    """(event_id, kind, today, body): events as payloads, body parsed; null where the text is no JSON."""
    of = F.expr("CASE event_type " + " ".join(f"WHEN '{e}' THEN '{k}'" for e, (k, _) in _KINDS.items()) + " END")
    text = F.expr("CASE event_type " + " ".join(f"WHEN '{e}' THEN {_planted(forms)}" for e, (_, forms) in _KINDS.items()) + " END")
    return events.where(of.isNotNull()).select("event_id", of.alias("kind"), F.to_date("ts").alias("today"), F.try_parse_json(text).alias("body"))


def dq_payload_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a payload: its problem, if any, and its ticker, first number and what it settles on, if none."""
    rows, b = payloads(table(spark, sf_dir, "events")), F.col("body")
    of = F.col("kind")
    problem = F.when(of == "position", position_problem(b, F.col("today"))).when(of == "add", added_problem(b)).when(of == "change", changed_problem(b)).otherwise(quotes_problem(b))
    rows = rows.withColumn("problem", problem)
    position, sound = position_value(b), F.col("problem").isNull()
    ticker = F.when(of.isin("position", "add"), ticker_of(b)).when(of == "quotes", ticker_of(F.try_variant_get(b, "$.quotes[0]", "variant")))
    number = F.when(of == "position", position["entry_price"] - position["initial_stop"]).when(of == "quotes", F.size(F.try_variant_get(b, "$.quotes", "array<variant>")).cast("double")).otherwise(level_of(b)[1])
    basis = F.when(of == "position", F.concat_ws("/", position["stop_basis"], position["source"], position["days_to_earnings"].cast("string"), position["entry_date"].cast("string")))
    settled = basis.when(of == "change", change_of(b)).when(of == "add", F.coalesce(level_of(b)[0], F.lit("no level"))).otherwise("rows")
    kept = F.floor(number * 1e6 + 0.5) / 1e6
    return rows.select("event_id", "kind", "problem", F.when(sound, ticker).alias("ticker"), F.when(sound, kept).alias("number"), F.when(sound, settled).alias("settled"))


def dq_quote_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quotes of all sound batches."""
    rows = quote_rows(payloads(table(spark, sf_dir, "events")).where("kind = 'quotes'"), numbers=("open", "close", "volume"))
    return rows.select("trade_date", "ticker", "open", "close", "volume", F.length("raw").alias("raw_length"), F.coalesce(F.get_json_object("raw", "$.a"), F.lit("-")).alias("a"))


FUNCTIONS = {f.__name__: f for f in (dq_payload_validate, dq_quote_rows)}

# what each planted form comes to, told by its number; not read from the text
SQL = {
    "dq_payload_validate": """WITH e AS (SELECT event_id, event_type, value, 'T' || user_id AS t, CAST(ts AS DATE) AS today, event_id % 16 AS p, event_id % 9 AS a, event_id % 7 AS c, event_id % 5 - 2 AS ahead, length('' || user_id) > 9 AS long_name FROM events WHERE event_type IN ('purchase', 'signup', 'error', 'view')),
v AS (
SELECT event_id, 'position' AS kind, CASE p WHEN 1 THEN 'ticker' WHEN 2 THEN 'ticker' WHEN 3 THEN 'ticker' WHEN 13 THEN 'body' ELSE CASE WHEN t IS NULL OR value IS NULL THEN 'body' WHEN p IN (4, 5) THEN 'entry_price' WHEN p = 7 THEN 'initial_stop' WHEN p = 8 THEN 'qty' WHEN p = 6 THEN 'stop not below entry' WHEN p = 9 THEN 'stop_basis' WHEN p = 10 THEN 'meta' WHEN p = 11 THEN 'entry_date' WHEN p = 12 AND ahead > 0 THEN 'entry_date in the future' END END AS problem,
  t AS ticker, (value + 2) - (value + 1) AS number, CASE p WHEN 12 THEN 'manual/manual/' || strftime(today + CAST(ahead AS INT), '%Y-%m-%d') WHEN 15 THEN '20ma/picks/7' ELSE 'manual/manual' END AS settled FROM e WHERE event_type = 'purchase'
UNION ALL SELECT event_id, 'add', CASE a WHEN 2 THEN 'level_value must be positive' WHEN 3 THEN 'unknown level_type' WHEN 5 THEN 'level_value must be omitted' WHEN 6 THEN 'level_value requires a level_type' WHEN 7 THEN 'ticker' WHEN 8 THEN 'level_value must be positive' END, t, CASE a WHEN 1 THEN value + 1 END, CASE a WHEN 0 THEN 'no level' WHEN 1 THEN 'above' ELSE 'reclaim_20ma' END FROM e WHERE event_type = 'signup'
UNION ALL SELECT event_id, 'change', CASE c WHEN 3 THEN 'nothing to change' WHEN 6 THEN 'body' END, NULL, CASE c WHEN 4 THEN value + 1 END, CASE c WHEN 0 THEN 'renew' WHEN 1 THEN 'remove' WHEN 2 THEN 'restore' ELSE 'edit' END FROM e WHERE event_type = 'error'
UNION ALL SELECT event_id, 'quotes', CASE a WHEN 2 THEN 'quotes[1].ticker' WHEN 3 THEN 'quotes[1]' WHEN 4 THEN 'quotes[0].raw' WHEN 5 THEN 'quotes' WHEN 6 THEN 'trade_date' WHEN 7 THEN 'collected_at' END, t, CASE a WHEN 1 THEN 2 ELSE 1 END, 'rows' FROM e WHERE event_type = 'view')
SELECT event_id, kind, problem, CASE WHEN problem IS NULL THEN ticker END AS ticker, CASE WHEN problem IS NULL THEN floor(number * 1e6 + 5e-1) / 1e6 END AS number, CASE WHEN problem IS NULL THEN settled END AS settled FROM v""",
    "dq_quote_rows": """WITH e AS (SELECT *, event_id % 9 AS a FROM events WHERE event_type = 'view' AND event_id % 9 IN (0, 1, 8)),
q AS (SELECT ts, value, a, 'T' || user_id AS ticker FROM e UNION ALL SELECT ts, value, a, 'SPY' FROM e WHERE a = 1)
SELECT strftime(ts, '%Y-%m-%d') AS trade_date, ticker, value AS open, value AS close, CAST(NULL AS DOUBLE) AS volume, CASE WHEN a = 8 THEN 7 ELSE length('{"ticker":"' || ticker || '","close":' || regexp_replace(CAST(value AS VARCHAR), '\\.0$', '') || ',"open":"' || value || '"}') END AS raw_length, CASE WHEN a = 8 THEN '1' ELSE '-' END AS a FROM q""",
}
