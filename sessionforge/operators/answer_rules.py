"""Rules on captured answers, by task: what each breaks, and a roll-up by capture with hard findings and warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionforge.sources.market import table

# Labels of a phase, most bullets of a watch list, sections that a risk answer needs.
PHASES, MOST_BULLETS, SECTIONS = ("Early Cycle", "Mid Cycle", "Late Cycle", "Defensive"), 5, ("relative_strength", "risks")
#: Captures that were looked at and accepted; a roll-up leaves them out.
EXCLUDED = ("2026-01-18", "2026-02-14")


def task_of(key: Column) -> Column:
    """The task is what follows the last point of a call's key."""
    return F.substring_index(key, ".", -1)


def findings(key: Column, status: Column, raw: Column, parsed: Column, named: Column, given: Column) -> Column:
    """Findings (rule, hard) of a call. parsed: a map, null where the answer is none; named: known names in the answer, given: those in its input.

    Calls that did not complete are not judged. A name that the input doesn't hold is a warning; the form of an
    answer is hard. Tasks without rules have only names.
    """
    blank = lambda name: F.trim(F.coalesce(F.try_element_at(parsed, F.lit(name)), F.lit(""))) == ""
    task, lines = task_of(key), F.split(F.coalesce(raw, F.lit("")), "\n")
    bullets = F.size(F.filter(lines, lambda x: x.rlike(r"^\s*[-*•]\s")))
    hard = {
        "no_parsed_answer": task.isin("rotation_phase", "risk_radar") & parsed.isNull(),
        "unknown_label": (task == "rotation_phase") & parsed.isNotNull() & ~F.trim(F.coalesce(F.try_element_at(parsed, F.lit("label")), F.lit(""))).isin(*PHASES),
        "too_many_bullets": (task == "watchlist") & (bullets > MOST_BULLETS),
    } | {f"no_{s}": (task == "risk_radar") & parsed.isNotNull() & blank(s) for s in SECTIONS}
    unknown = F.coalesce(F.size(F.array_except(F.coalesce(named, F.array().cast("array<string>")), F.coalesce(given, F.array().cast("array<string>")))) > 0, F.lit(False))
    found = [F.when(c, F.struct(F.lit(rule).alias("rule"), F.lit(True).alias("hard"))) for rule, c in hard.items()]
    found.append(F.when(unknown, F.struct(F.lit("unknown_name").alias("rule"), F.lit(False).alias("hard"))))
    judged = F.coalesce(status, F.lit("")).isin("ok", "")
    return F.when(judged, F.array_compact(F.array(*found))).otherwise(F.array().cast("array<struct<rule:string,hard:boolean>>"))


def rolled_up(calls: DataFrame, excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """calls (capture_date, key, status, raw, parsed, named, given) by capture: calls, those judged, findings and the verdict."""
    judged = F.coalesce("status", F.lit("")).isin("ok", "")
    rows = calls.select("capture_date", judged.alias("judged"), findings(*[F.col(c) for c in ("key", "status", "raw", "parsed", "named", "given")]).alias("found"))
    n = lambda hard: F.size(F.filter("found", lambda x: x["hard"] == hard))
    out = rows.groupBy("capture_date").agg(F.count("*").alias("n_calls"), F.sum(F.col("judged").cast("long")).alias("n_judged"), F.sum(n(True)).alias("hard"), F.sum(n(False)).alias("warn"))
    left_out = F.col("capture_date").cast("string").isin(*excluded)
    return out.withColumn("verdict", F.when(left_out, "excluded").when(F.col("hard") > 0, "fail").when(F.col("warn") > 0, "warn").otherwise("clean"))


def captured(turns: DataFrame, nations: DataFrame) -> DataFrame:
    """Calls made of conversation turns: a turn's number and length decide its task, status and the shape of the answer; nations are the known names."""
    n, names = F.length("text"), nations.agg(F.array_sort(F.collect_list("n_name")).alias("names"))  # 25 names
    rows = turns.crossJoin(F.broadcast(names)).withColumn("n", n)  # with one row
    task = F.element_at(F.array(*map(F.lit, ("rotation_phase", "watchlist", "risk_radar", "rotation_map"))), (F.col("turn") % 4 + 1).cast("int"))
    label = F.element_at(F.array(*map(F.lit, (*PHASES, " Mid Cycle ", "Sideways"))), (F.col("n") % 6 + 1).cast("int"))
    parsed = F.create_map(F.lit("label"), label, F.lit("relative_strength"), F.when(F.col("n") % 5 > 0, "strong"), F.lit("risks"), F.when(F.col("n") % 8 > 1, F.col("role")).otherwise(" "))
    marks = F.transform(F.sequence(F.lit(0), (F.col("n") % 9).cast("int")), lambda i: F.concat(F.element_at(F.array(*map(F.lit, ("- ", "  * ", "• ", "-", "1. "))), i % 5 + 1), F.lit("x")))
    name = lambda shift: F.element_at("names", ((F.col("n") + shift) % F.size("names") + 1).cast("int"))
    return rows.select(
        F.date_add(F.lit("2026-01-01").cast("date"), (F.col("conv_id") % 60).cast("int")).alias("capture_date"), F.concat(F.when(F.col("conv_id") % 2 == 0, "sectors.").otherwise("industries."), task).alias("key"),
        F.when(F.col("n") % 11 == 0, "timeout").when(F.col("n") % 11 > 3, "ok").alias("status"), F.array_join(marks, "\n").alias("raw"), F.when(F.col("n") % 13 > 0, parsed).alias("parsed"), F.array(name(0), name(3)).alias("named"), F.when(F.col("n") % 17 > 0, F.array(name(0), F.when(F.col("n") % 4 > 0, name(3)))).alias("given"),
    )


def dq_format_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roll-up of all captures that the conversations make."""
    rows = rolled_up(captured(table(spark, sf_dir, "conversations"), table(spark, sf_dir, "nation")))
    return rows.select("capture_date", "n_calls", "n_judged", "hard", "warn", "verdict")


FUNCTIONS = {"dq_format_rules": dq_format_rules}
#: The findings of each shape counted outright: lines 0, 1 and 2 of five are bullets.
SQL = {
    "dq_format_rules": f"""WITH c AS (SELECT CAST(DATE '2026-01-01' + CAST(conv_id % 60 AS INT) AS DATE) AS capture_date, turn % 4 AS task, length(text) AS n, role FROM conversations),
f AS (SELECT *, n % 11 <> 0 AS judged, n % 13 = 0 AS none, (n % 9 + 1) - (n % 9 + 1) // 5 * 2 - greatest(0, (n % 9 + 1) % 5 - 3) AS bullets FROM c),
g AS (SELECT capture_date, judged, CASE WHEN NOT judged THEN 0 WHEN task = 0 THEN CASE WHEN none OR n % 6 = 5 THEN 1 ELSE 0 END WHEN task = 1 THEN CASE WHEN bullets > {MOST_BULLETS} THEN 1 ELSE 0 END WHEN task = 2 THEN CASE WHEN none THEN 1 ELSE CASE WHEN n % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN n % 8 < 2 OR trim(role) = '' THEN 1 ELSE 0 END END ELSE 0 END AS hard, CASE WHEN judged AND (n % 17 = 0 OR n % 4 = 0) THEN 1 ELSE 0 END AS warn FROM f)
SELECT capture_date, count(*) AS n_calls, count(*) FILTER (judged) AS n_judged, CAST(sum(hard) AS BIGINT) AS hard, CAST(sum(warn) AS BIGINT) AS warn, CASE WHEN capture_date IN (DATE '2026-01-18', DATE '2026-02-14') THEN 'excluded' WHEN sum(hard) > 0 THEN 'fail' WHEN sum(warn) > 0 THEN 'warn' ELSE 'clean' END AS verdict FROM g GROUP BY capture_date""",
}
