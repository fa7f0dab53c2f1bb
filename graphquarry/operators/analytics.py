"""Usage tallies and benchmark analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def client_tally(calls: DataFrame, today: Column) -> DataFrame:
    """Per client: calls, calls on ``today`` (a date), characters, last use."""
    return calls.groupBy("client").agg(F.count("*").alias("calls"), F.count_if(F.to_date("t") == today).alias("today"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"), F.max("t").alias("last"))


def day_tally(calls: DataFrame) -> DataFrame:
    return calls.groupBy(F.to_date("t").alias("day"), "client").agg(F.count("*").alias("calls"), F.sum("chars").alias("chars"))


def recent(calls: DataFrame, n: int = 5, *ties: str) -> DataFrame:
    return calls.orderBy(F.desc("t"), *(F.desc(c) for c in ties)).limit(n)


def transcript_calls(events: DataFrame, run: str = "run", message: str = "message", order: str = "order") -> DataFrame:
    """One row for each message of a run: the last event of it."""
    last = F.row_number().over(Window.partitionBy(run, message).orderBy(F.desc(order)))
    return events.withColumn("__k", last).filter("__k = 1").drop("__k")


def transcript_summary(calls: DataFrame, run: str = "run", order: str = "order") -> DataFrame:
    """Per run: calls, summed context, work (context beyond the first call's, for each call), output."""
    first = F.first("context").over(Window.partitionBy(run).orderBy(order))
    return calls.withColumn("__f", first).groupBy(run).agg(F.count("*").alias("calls"), F.sum("context").alias("context"), F.sum(F.col("context") - F.col("__f")).alias("work"), F.sum("output").alias("output"))


def cached_cost(calls: DataFrame, read: float, write: float, out: float, run: str = "run", order: str = "order") -> DataFrame:
    """Cost per run with a cache: what the call before had as context is read, the rest written."""
    before = F.coalesce(F.lag("context").over(Window.partitionBy(run).orderBy(order)), F.lit(0))
    return calls.withColumn("__read", F.least(before, "context")).groupBy(run).agg(F.sum(F.col("__read") * read + (F.col("context") - F.col("__read")) * write + F.col("output") * out).alias("cost"))


def grade(replies: DataFrame, checks: str = "checks", expected: str = "expected", forbidden: str = "forbidden", answer: str = "answer", ok: str = "ok") -> DataFrame:
    """``recall, false_positives, passed`` of each reply by arrays of patterns."""
    hits = lambda c: F.size(F.filter(F.coalesce(c, F.expr("array()").cast("array<string>")), lambda p: F.regexp_like(F.col(answer), p)))
    n = lambda c: F.size(F.coalesce(c, F.expr("array()").cast("array<string>")))
    all_checks = hits(F.col(checks)) == n(F.col(checks))
    recall = F.when(~F.col(ok), F.lit(0.0)).when(n(F.col(expected)) > 0, hits(F.col(expected)) / n(F.col(expected))).otherwise(all_checks.cast("double"))
    return replies.withColumn("recall", recall).withColumn("false_positives", hits(F.col(forbidden))).withColumn("passed", F.col(ok) & all_checks & (F.col("recall") == 1) & (F.col("false_positives") == 0))


def arm_report(runs: DataFrame, *measures: str) -> DataFrame:
    """Per task and arm: runs, passes and the medians of the measures."""
    return runs.groupBy("task", "arm").agg(F.count("*").alias("runs"), F.count_if("passed").alias("passes"), *(F.median(m).alias(m) for m in measures))


def ratio_to_baseline(report: DataFrame, measure: str, baseline) -> DataFrame:
    """Per arm: the geometric mean over tasks of its ratio to the baseline arm; undefined ratios are skipped."""
    base = report.filter(F.col("arm") == baseline).select("task", F.col(measure).alias("__b"))
    ratio = F.try_divide(F.col(measure), F.col("__b"))
    return report.filter(F.col("arm") != baseline).join(base, "task").withColumn("__r", ratio).filter("__r > 0").groupBy("arm").agg(F.exp(F.avg(F.log("__r"))).alias("ratio"), F.count("*").alias("tasks"))


def arm_totals(runs: DataFrame) -> DataFrame:
    """Per arm: ``runs, recall`` (mean), ``false_positives, passed, used`` (runs with a call of the tools), ``tool_calls, wall`` (median), ``warm, errors``."""
    return runs.groupBy("arm").agg(
        F.count("*").alias("runs"), F.avg("recall").alias("recall"), F.coalesce(F.sum("false_positives"), F.lit(0)).alias("false_positives"), F.count_if("passed").alias("passed"),
        F.count_if(F.col("tool_calls") > 0).alias("used"), F.sum("tool_calls").alias("tool_calls"), F.median("wall").alias("wall"), F.count_if("warm").alias("warm"), F.count("error").alias("errors"),
    )
