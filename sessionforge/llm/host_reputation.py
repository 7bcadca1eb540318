"""URL filter: explicit rules first, then empirical-Bayes host reputation.

Pages with a labelled outcome (their document, named by the number that ends the path, is labelled
toxic or of low quality, or neither) are counted by host. The rate of bad outcomes is shrunk through
beta-binomial priors: the corpus mean is the prior of a suffix, the suffix's posterior mean that of a
registered domain, the domain's that of a host. A suffix is the last label, or the last two if the last
has two letters and the one before is one of SECOND_LEVEL (`co.uk`); a registered domain has one label
more, if the host has. How much a level counts as prior is fitted by moments
from the spread of its children. A host is blocked where the lower bound of its posterior is at least
`limit`.

A null url, or one without `://`, has an empty host and path; the empty host is a host like any other.
Labels that are null, or don't name a page, don't count; several labels of one document count as bad
if one is. Repeated pages are judged alike, and each counts. Without any labels every prior mean is 1/2
and no host is blocked; a bound of exactly `limit` blocks. An url of any length is taken whole. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionforge.llm.common import saved, with_facts

#: (verdict, rule); a rule is a host, and a path from the first slash on.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Standard deviations below the posterior mean, and the rate of bad outcomes that blocks from there.
Z, LIMIT = 1.645, 0.3
#: Bounds of the prior strengths, in pages.
WEAKEST, STRONGEST = 2.0, 1000.0
#: Labels below a country's that belong to its suffix.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://([^/?#]*)", 1), ASCII_UPPER, ASCII_LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        of, slash, start = rule.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(slash + start)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def shrunk(units: DataFrame, parent_mean: str, out: str) -> DataFrame:
    """Adds the posterior mean `out` and strength `out`_n of units (x bad of n) under their parent's mean."""
    p = F.col(parent_mean)
    fit = units.where((F.col("n") > 0) & (p > 0) & (p < 1)).agg(F.sum(F.pow(F.col("x") - F.col("n") * p, 2) / (F.col("n") * p * (1 - p))).alias("q"), F.count("*").alias("k"), F.sum(F.col("n") - 1).alias("m"))
    rho = F.when(F.col("m") > 0, (F.col("q") - F.col("k")) / F.col("m"))
    fit = fit.select(F.least(F.lit(STRONGEST), F.greatest(F.lit(WEAKEST), F.coalesce(F.when(rho > 0, 1 / rho - 1), F.lit(STRONGEST)))).alias("strength"))
    units = units.withColumn("strength", fit.scalar())
    return units.withColumn(out, (F.col("x") + F.col("strength") * p) / (F.col("n") + F.col("strength"))).withColumn(f"{out}_n", F.col("n") + F.col("strength")).drop("strength")


def reputations(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, pages, n_labelled, bad_rate, bad_bound) of every host of pages (host, path)."""
    bad = labels.where("doc_id is not null and (toxic is not null or quality is not null)")
    bad = bad.groupBy(F.col("doc_id").cast("string").alias("doc")).agg(F.max(F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0)).alias("bad"))
    number = F.regexp_extract("path", r"/([0-9]+)(?:\.[a-z]+)?/?$", 1)
    # pages are counted by host and number before they meet the labels; those without a number meet none
    counted = saved(pages.groupBy("host", number.alias("number")).agg(F.count("*").alias("c")))
    told = counted.where("number <> ''").join(bad.hint("merge"), F.col("number") == F.col("doc")).select("host", F.lit(0).cast("long").alias("pages"), F.col("c").alias("n"), (F.col("c") * F.col("bad")).alias("x"))
    both = counted.select("host", F.col("c").alias("pages"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("x")).union(told)
    hosts = both.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("pages", "n", "x")])
    two = F.col("host").rlike(rf"(^|\.)({'|'.join(SECOND_LEVEL)})\.[a-z][a-z]$")
    cut = lambda k: F.when(two, F.substring_index("host", ".", -k - 1)).otherwise(F.substring_index("host", ".", -k))
    hosts = saved(hosts.withColumn("domain", cut(2)).withColumn("suffix", cut(1)))
    sums = [F.sum("n").alias("n"), F.sum("x").alias("x"), F.count("*").alias("children")]
    domains = saved(hosts.groupBy("suffix", "domain").agg(*sums))
    suffixes = domains.groupBy("suffix").agg(*sums)
    top = suffixes.agg(((F.sum("x") + 1) / (F.sum("n") + 2)).alias("p0"))
    suffixes = saved(shrunk(suffixes.withColumn("p0", top.scalar()), "p0", "p1").select("suffix", "p1", "children"))
    domains = saved(shrunk(with_facts(domains, suffixes, ["suffix"], "children", ["p1"]), "p1", "p2").select("domain", "p2", "children"))
    hosts = shrunk(with_facts(hosts, domains, ["domain"], "children", ["p2"]), "p2", "p3")
    low = F.col("p3") - Z * F.sqrt(F.col("p3") * (1 - F.col("p3")) / (F.col("p3_n") + 1))
    return hosts.select("host", "pages", F.col("n").alias("n_labelled"), F.col("p3").alias("bad_rate"), low.alias("bad_bound"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules=RULES, limit: float = LIMIT) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of pages (page_id, url); labels (doc_id, quality, toxic)."""
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = saved(reputations(split, labels).select("host", "pages", "bad_bound"))
    out = with_facts(split, known, ["host"], "pages", ["bad_bound"]).withColumn("rule", best_rule(F.col("host"), F.col("path"), rules))
    by_rule = F.lit(None).cast("string")
    for verdict, rule in rules:
        by_rule = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(by_rule)
    verdict = F.coalesce(by_rule, F.when(F.col("bad_bound") >= limit, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


_TWO = f"(^|[.])({'|'.join(SECOND_LEVEL)})[.][a-z][a-z]$"

SQL = f"""
WITH split AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{ASCII_UPPER}', '{ASCII_LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
bad AS (
  SELECT CAST(doc_id AS VARCHAR) AS doc, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad
  FROM labels WHERE doc_id IS NOT NULL AND (toxic IS NOT NULL OR quality IS NOT NULL) GROUP BY 1),
hosts AS (
  SELECT host, CASE WHEN regexp_matches(host, '{_TWO}') THEN regexp_extract(host, '([^.]*[.])?[^.]*[.][^.]*$') ELSE regexp_extract(host, '([^.]*[.])?[^.]*$') END AS domain,
         CASE WHEN regexp_matches(host, '{_TWO}') THEN regexp_extract(host, '[^.]*[.][^.]*$') ELSE regexp_extract(host, '[^.]*$') END AS suffix, count(bad) AS n, coalesce(sum(bad), 0) AS x
  FROM split LEFT JOIN bad ON regexp_extract(path, '/([0-9]+)(\\.[a-z]+)?/?$', 1) = doc GROUP BY 1),
d0 AS (SELECT suffix, domain, sum(n) AS n, sum(x) AS x FROM hosts GROUP BY 1, 2),
s0 AS (SELECT suffix, sum(n) AS n, sum(x) AS x FROM d0 GROUP BY 1),
s1 AS (SELECT *, (SELECT (sum(x) + 1.0) / (sum(n) + 2) FROM s0) AS p FROM s0),
s2 AS (
  SELECT suffix, (x + s * p) / (n + s) AS p1 FROM s1, (
    SELECT least({STRONGEST}, greatest({WEAKEST}, coalesce(CASE WHEN r > 0 THEN 1 / r - 1 END, {STRONGEST}))) AS s FROM (
      SELECT CASE WHEN sum(n - 1) > 0 THEN (sum((x - n * p) ^ 2 / (n * p * (1 - p))) - count(*)) / sum(n - 1) END AS r
      FROM s1 WHERE n > 0 AND p > 0 AND p < 1))),
d1 AS (SELECT d0.*, p1 AS p FROM d0 JOIN s2 USING (suffix)),
d2 AS (
  SELECT domain, (x + s * p) / (n + s) AS p2 FROM d1, (
    SELECT least({STRONGEST}, greatest({WEAKEST}, coalesce(CASE WHEN r > 0 THEN 1 / r - 1 END, {STRONGEST}))) AS s FROM (
      SELECT CASE WHEN sum(n - 1) > 0 THEN (sum((x - n * p) ^ 2 / (n * p * (1 - p))) - count(*)) / sum(n - 1) END AS r
      FROM d1 WHERE n > 0 AND p > 0 AND p < 1))),
h1 AS (SELECT hosts.*, p2 AS p FROM hosts JOIN d2 USING (domain)),
h2 AS (
  SELECT host, (x + s * p) / (n + s) AS p3, n + s AS m FROM h1, (
    SELECT least({STRONGEST}, greatest({WEAKEST}, coalesce(CASE WHEN r > 0 THEN 1 / r - 1 END, {STRONGEST}))) AS s FROM (
      SELECT CASE WHEN sum(n - 1) > 0 THEN (sum((x - n * p) ^ 2 / (n * p * (1 - p))) - count(*)) / sum(n - 1) END AS r
      FROM h1 WHERE n > 0 AND p > 0 AND p < 1))),
rules(verdict, rule, rh, rp) AS (VALUES {', '.join(f"('{v}', '{r}', '{r.partition('/')[0]}', '{'/' + r.partition('/')[2]}')" for v, r in RULES)}),
fits AS (
  SELECT page_id, host, path, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS said
  FROM (SELECT DISTINCT page_id, host, path FROM split) t JOIN rules
    ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY 1, 2, 3)
SELECT s.page_id, s.host, s.path, f.rule,
       coalesce(f.said, CASE WHEN p3 - {Z} * sqrt(p3 * (1 - p3) / (m + 1)) >= {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict
FROM split s LEFT JOIN fits f ON s.page_id IS NOT DISTINCT FROM f.page_id AND s.host = f.host AND s.path = f.path
LEFT JOIN h2 ON s.host = h2.host
"""
