"""Files of the panel: text tables, JSON logs, pages with tables or embedded data, and stores that are written by date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Label, key and format of the columns that a page's embedded data holds.
EMBEDDED = (
    ("Ticker", "ticker", "text"), ("Company", "company", "text"),
    ("Industry", "industry", "text"), ("Country", "country", "text"),
    ("Market Cap", "marketCap", "money"), ("P/E", "PE", "f2"),
    ("Volume", "volume", "int"), ("Price", "price", "f2"),
    ("Change", "change", "pct"), ("Earnings", "earningsDate", "earn"),
    ("Index", "index", "text"), ("Forward P/E", "forwardPE", "f2"),
    ("PEG", "PEG", "f2"), ("P/S", "PS", "f2"), ("P/FCF", "PFCF", "f2"),
    ("EV/EBITDA", "evEbitda", "f2"), ("EV/Sales", "evSales", "f2"),
    ("ROE", "roe", "pct"), ("ROA", "roa", "pct"), ("ROIC", "roi", "pct"),
    ("LTDebt/Eq", "ltdebtEq", "f2"), ("Debt/Eq", "debtEq", "f2"),
    ("Dividend Gr. 5Y", "dividend5y", "pct"), ("EPS", "eps", "f2"),
    ("EPS next Q", "estQ1", "f2"), ("EPS This Y", "epsYoY", "pct"),
    ("EPS Next Y", "epsYoY1", "pct"), ("EPS Past 3Y", "eps3Years", "pct"),
    ("EPS Past 5Y", "eps5Years", "pct"), ("EPS Next 5Y", "estLTGrowth", "pct"),
    ("Sales Past 3Y", "sales3Years", "pct"), ("Sales Past 5Y", "sales5Years", "pct"),
    ("Sales Q/Q", "salesQoQ", "pct"), ("EPS Q/Q", "epsQoQ", "pct"),
    ("EPS YoY TTM", "epsYoYTTM", "pct"), ("Sales YoY TTM", "salesYoYTTM", "pct"),
    ("Gross M", "grossMargin", "pct"), ("Oper M", "operMargin", "pct"),
    ("Profit M", "netMargin", "pct"), ("Insider Trans", "insiderTrans", "pct"),
    ("Inst Trans", "instTrans", "pct"), ("Perf Week", "perf1w", "pct"),
    ("Perf Month", "perf4w", "pct"), ("Perf Quart", "perf13w", "pct"),
    ("Perf Half", "perf26w", "pct"), ("Perf YTD", "perfYtd", "pct"),
    ("Perf Year", "perf52w", "pct"), ("Perf 3Y", "perf3y", "pct"),
    ("ATR", "averageTrueRange", "f2"), ("Volatility M", "volatility4w", "pct"),
    ("Beta", "beta", "f2"), ("SMA20", "sma20", "pct"), ("SMA50", "sma50", "pct"),
    ("SMA200", "sma200", "pct"), ("RSI", "rsi", "f2"),
    ("Avg Volume", "averageVolume", "count"), ("Rel Volume", "relativeVolume", "f2"),
    ("Prev Close", "prevClose", "f2"), ("Open", "open", "f2"),
    ("High", "high", "f2"), ("Low", "low", "f2"), ("Recom", "recom", "f2"),
    ("Target Price", "targetPrice", "f2"), ("News Time", "newsTime", "text"),
    ("News Title", "newsTitle", "text"), ("News URL", "newsUrl", "text"),
    ("Daily Digest", "wiimDailyDigest", "text"), ("Sector", "sector", "text"),
    ("P/C", "PC", "f2"), ("Enterprise Value", "enterpriseValue", "money"),
    ("Curr R", "curRatio", "f2"), ("Quick R", "quickRatio", "f2"),
    ("Sales", "sales", "money"), ("Income", "income", "money"),
    ("Inst Own", "instOwn", "pct"), ("Perf 5Y", "perf5y", "pct"),
    ("Volatility W", "volatility1w", "pct"), ("52W High", "high52w", "pct"),
    ("52W Low", "low52w", "pct"), ("Change from Open", "changeopen", "pct"),
    ("Gap", "gap", "pct"), ("Dividend Gr. 3Y", "dividend3y", "pct"),
    ("EPS Surprise", "epsSurprise", "pct"), ("Revenue Surprise", "revenueSurprise", "pct"),
)


def read_panel(spark: SparkSession, path: str, numbers: list[str]) -> DataFrame:
    """A panel of text files with headers: a date, a name and numbers.

    A number may have blanks, thousands' commas or a percent sign around it; what is no number, or `-`, is
    null, and so is what is no date. Folders without rows give none.
    """
    text = spark.read.schema(", ".join(f"`{c}` string" for c in ("date", "name", *numbers))).option("header", True).csv(path)
    number = lambda c: F.regexp_replace(F.trim(c), "[,%]", "").try_cast("double")
    return text.select(F.col("date").try_cast("date").alias("date"), "name", *[number(F.col(c)).alias(c) for c in numbers])


def read_log(spark: SparkSession, path: str, fields: str, month: str) -> DataFrame:
    """The rows of one month of a line-JSON log; malformed lines are left out."""
    rows = spark.read.schema(f"month string, {fields}, _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return rows.where(F.col("_corrupt_record").isNull() & (F.col("month") == month)).drop("_corrupt_record", "month")


def plain(html: Column) -> Column:
    return F.trim(F.regexp_replace(html, "<[^>]*>", ""))


def cells(row: Column) -> Column:
    return F.transform(F.regexp_extract_all(row, F.lit(r"(?is)<t[hd][^>]*>(.*?)</t[hd]>"), F.lit(1)), plain)


def table_rows(html: Column, aliases: dict[str, str], wanted: list[str]) -> Column:
    """The rows of a page's table, each a map from label to text, in an array; empty for a page without a table.

    The first row holds the labels, some under older names (aliases). Rows with another number of cells
    than labels are left out, and columns that aren't wanted.
    """
    named = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]) if aliases else F.create_map().cast("map<string,string>")
    rows = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1)), cells)

    def mapped(all_rows: Column) -> Column:
        labels = F.transform(all_rows[0], lambda c: F.coalesce(F.try_element_at(named, c), c))
        body = F.filter(F.slice(all_rows, 2, F.greatest(F.lit(1), F.size(all_rows) - 1)), lambda r: F.size(r) == F.size(labels))
        return F.transform(body, lambda r: F.map_filter(F.map_from_arrays(labels, r), lambda k, _: k.isin(*wanted)))

    none = F.array().cast("array<map<string,string>>")
    return F.when(F.size(rows) > 0, F.transform(F.array(rows), mapped)[0]).otherwise(none)


def two_places(x: Column) -> Column:
    """A double to two places by its exact binary value, ties to even; Java's own formatting rounds the shortest decimal instead.

    The fraction times 2^56 is cut into a long, which holds a hundred times as much, and what is lost by the cut.
    """
    size = F.abs(x)
    whole = F.floor(size)
    large = (size - whole) * F.lit(2.0**56)
    parts, lost = F.floor(large) * 100, (large - F.floor(large)) * 100
    cents, short = F.shiftright(parts, 56), F.lit(2**55) - parts.bitwiseAND(F.lit(2**56 - 1))
    total = whole * 100 + cents + F.when((short < lost) | ((short == 0) & (lost == 0) & (cents % 2 == 1)), 1).otherwise(0)
    text = F.concat(F.when(x < 0, "-").otherwise(""), F.floor(total / 100).cast("string"), F.lit("."), F.lpad((total % 100).cast("string"), 2, "0"))
    return F.when(size < 1e13, text).otherwise(F.format_string("%.2f", x))


def displayed(value: Column, kind: str) -> Column:
    """A value of embedded data, as text, in the form that pages used to show; `-` for none and for what can't be read.

    text as it is; earn: a date, with /b or /a for a time before noon or after it; numbers: f2 and pct to two
    places, int with commas (halves to even), money of millions, count of units.
    """
    once = lambda v, body: F.transform(F.array(v), body)[0]  # noqa: E731  a value that is computed once and used in body
    number = F.nanvl(value.try_cast("double"), F.lit(None).cast("double"))
    units = {"f2": (), "pct": (), "money": ((1e3, "B"), (0, "M")), "count": ((1e9, "B"), (1e6, "M"), (1e3, "K"))}

    def scaled(v: Column) -> Column:
        size, suffix = F.lit(1.0), F.lit("%" if kind == "pct" else "")
        for least, letter in reversed(units[kind]):
            size = F.when(F.abs(v) >= least, least or 1.0).otherwise(size)
            suffix = F.when(F.abs(v) >= least, letter).otherwise(suffix)
        return F.concat(once(v / size, two_places), suffix)

    if kind == "text":
        text = value
    elif kind == "earn":
        hit = r"^(\d{4}-\d{2}-\d{2})(?:T(\d{2}))?"
        day, hour = F.try_to_date(F.regexp_extract(value, hit, 1), "yyyy-MM-dd"), F.regexp_extract(value, hit, 2)
        text = F.concat(F.date_format(day, "MMM dd"), F.when(hour == "", "").when(hour < "12", "/b").otherwise("/a"))
    elif kind == "int":
        text = F.format_number(F.bround(number, 0).cast("long"), 0)
    else:
        text = once(number, lambda v: F.when(v.isNotNull(), scaled(v)))
    return F.coalesce(F.when(value != "", text), F.lit("-"))


def embedded_rows(pages: DataFrame, labels: list[str]) -> DataFrame:
    """pages (html, ...) with a row for each row of their embedded data that has a ticker: one text column a label.

    The first script that holds rows counts; scripts that are malformed or hold other things are skipped.
    """
    schema = "data struct<rows:array<struct<text:map<string,string>,numbers:map<string,string>>>>"
    scripts = F.regexp_extract_all("html", F.lit(r"(?is)<script[^>]*data-ssr-props[^>]*>(.*?)</script>"), F.lit(1))
    held = F.filter(F.transform(scripts, lambda s: F.from_json(s, schema)["data"]["rows"]), lambda rows: rows.isNotNull())
    rows = pages.withColumn("_row", F.explode(F.get(held, 0))).where(F.coalesce(F.try_element_at("_row.text", F.lit("ticker")), F.lit("")) != "")
    known = {label: (key, kind) for label, key, kind in EMBEDDED}
    value = lambda key, kind: F.try_element_at("_row.text" if kind in ("text", "earn") else "_row.numbers", F.lit(key))
    return rows.select(*[c for c in pages.columns if c != "html"], *[displayed(value(*known[label]), known[label][1]).alias(label) for label in labels])


def migrated(parts: list[DataFrame], target: list[str]) -> DataFrame:
    """Parts of a store whose columns grew over time, as one relation with the target's columns in its order; blanks for what a part lacks."""
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out.select(*target)
