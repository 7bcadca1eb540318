"""Queries declared once in SQL over named relations, run by Spark, and their twins for another engine."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from sessionforge.plans import panel as panels
from sessionforge.sources import market

#: Builders of the relations that queries may name in braces.
RELATIONS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: market.held(name, build)
    for name, build in {
        "panel": panels.panel,
        "spanel": lambda s, d: panels.panel(s, d, "sector"),
        "snap": market.group_prices,
        "ssnap": lambda s, d: market.group_prices(s, d, "sector"),
        "bench": market.benchmarks,
        "bars": market.bars,
        "sess": market.sessions,
    }.items()
} | {"trades": market.trades}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Words of the texts that differ between the dialects: what Spark says, and what the other engine says.
WORDS = {
    # a row for each that isn't null
    "each": ("explode(array_compact(array({})))", "unnest(list_filter([{}], lambda x: x IS NOT NULL))"),
    "numbers": ("explode(array({}))", "unnest([{}])"),
    "alnum": ("regexp_replace({}, '[^a-z0-9]', '')", "regexp_replace({}, '[^a-z0-9]', '', 'g')"),
    "knob": ("get_json_object({})", "json_extract_string({})"),
    "day": ("to_date({})", "cast({} AS DATE)"),
    "words": ("explode(split({}, ' '))", "unnest(string_split({}, ' '))"),
    "sha": ("sha2({}, 256)", "sha256({})"),
    "pieces": ("explode(split({}, '[|]'))", "unnest(string_split({}, '|'))"),
}


def _args(text: str, at: int) -> int:
    """Where the bracket that opens before `at` closes."""
    depth = 1
    while depth:
        depth += {"(": 1, ")": -1}.get(text[at], 0)
        at += 1
    return at


def spoken(text: str, other: bool) -> str:
    """The text in Spark's or the other engine's words."""
    for word, forms in WORDS.items():
        while m := re.search(rf"\b{word}\(", text):
            end = _args(text, m.end())
            text = text[: m.start()] + forms[other].replace("{}", text[m.end() : end - 1]) + text[end:]
    if other:
        text = re.sub(r"listagg\(((?:DISTINCT )?)(.*?), '(.*?)'\) within group \(order by (.*?)\)", r"string_agg(\1\2, '\3' ORDER BY \4)", text)
        text = re.sub(r"LEFT (SEMI|ANTI) JOIN", r"\1 JOIN", text)
    return text


def r(value: str, name: str = "") -> str:
    """A double to six places, halves up and without a negative zero, by the same arithmetic in any engine."""
    return f"floor(({value}) * 1e6 + 5e-1) / 1e6 AS {name or value}"


def needed(text: str) -> list[str]:
    """The relations that a text uses, directly or through others, each behind those that it uses itself."""
    order: list[str] = []

    def visit(name: str, above: tuple[str, ...]) -> None:
        if name in above:
            raise ValueError(f"relations use one another: {' -> '.join([*above, name])}")
        if name not in order:
            within(" ".join(market.CTES[name]), (*above, name))
            order.append(name)

    def within(body: str, above: tuple[str, ...]) -> None:
        for word in dict.fromkeys(re.findall(r"\w+", body)):
            if word in market.CTES and word != (above[-1] if above else None):
                visit(word, above)

    within(text, ())
    return order


@dataclass(frozen=True)
class Query:
    """text: SQL with relations in braces; other: the same for the other engine, where words alone don't do."""

    name: str
    text: str
    other: str | None = None
    checked: bool = True

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        names = set(re.findall(r"\{(\w+)\}", self.text))
        return spark.sql(spoken(self.text, False), **{n: RELATIONS[n](spark, sf_dir) if n in RELATIONS else market.table(spark, sf_dir, n) for n in names})

    def sql(self) -> str:
        text = spoken(re.sub(r"\{(\w+)\}", r"\1", self.other or self.text), True)
        ctes = [c for name in needed(text) for c in market.CTES[name]]
        if not ctes:
            return text
        head = "WITH " + ",\n".join(ctes)
        return head + ",\n" + text.lstrip()[5:] if re.match(r"\s*WITH\s", text, re.IGNORECASE) else head + "\n" + text


def derived(name: str, text: str, other: str | None = None) -> None:
    """Gives a query's result a name that other queries may use in braces."""
    query = Query(name, text, other)
    RELATIONS[name] = query.run
    market.CTES[name] = [f"{name} AS ({spoken(re.sub(r'[{](\w+)[}]', lambda m: m[1], other or text), True)})"]


def stepped(name: str, source: str, columns: list[dict[str, str]], keep: bool = False, by: str | None = None) -> None:
    """A relation with more columns, a step at a time; held if several queries read most of it. by: the key of the steps' windows, if the source grows with the line items."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = RELATIONS[source](spark, sf_dir)
        return market.steps(rows.repartition(market.tasks(spark, sf_dir), by) if by else rows, columns)

    RELATIONS[name] = market.held(name, build) if keep else build
    market.CTES[name] = market.steps_sql(source, name, columns)
