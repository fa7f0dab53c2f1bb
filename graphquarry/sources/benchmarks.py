"""Benchmark results: runs, tasks and transcripts as tables; order of arms; grading saved transcripts again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import answer
from ..operators.analytics import grade

RUN = "task string, kind string, arm string, run int, model string, passed boolean, answer string, recall double, falsePositives int, turns int, contextTokens long, workTokens long, outputTokens long, cost double, reportedCostUsd double, warmStart boolean, tools map<string, int>, ms long, error string, rateLimited boolean"
TASKS = "tasks array<struct<id: string, kind: string, prompt: string, check: array<string>, expect: array<string>, forbid: array<string>>>"
EVENT = "type string, result string, is_error boolean, message struct<id: string, usage: struct<input_tokens: long, cache_creation_input_tokens: long, cache_read_input_tokens: long, output_tokens: long>, content: array<struct<type: string, name: string>>>"


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(RUN).option("mode", "DROPMALFORMED").json(f"{folder}/runs.jsonl")


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TASKS).option("multiLine", "true").json(path).select(F.explode("tasks").alias("t")).select("t.*")


def read_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """``task, arm, run`` from the files' names, the events' fields, and their order in the file; other lines are skipped."""
    raw = spark.read.text(f"{folder}/transcripts", wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.jsonl$", 1).alias("file"), F.posexplode(F.split("value", "\n")).alias("order", "line"))
    named = raw.withColumn("x", F.from_json("line", EVENT)).filter("x.type is not null")
    return named.select(F.regexp_extract("file", r"^(.*)-([^-]+)-(\d+)$", 1).alias("task"), F.regexp_extract("file", r"^(.*)-([^-]+)-(\d+)$", 2).alias("arm"), F.regexp_extract("file", r"^(.*)-([^-]+)-(\d+)$", 3).cast("int").alias("run"), "order", "x.*")


def tool_counts(events: DataFrame) -> DataFrame:
    """``task, arm, run, tools``: how often each tool was called, each message once (its last event)."""
    last = Window.partitionBy("task", "arm", "run", "message.id").orderBy(F.desc("order"))
    one = events.filter("type = 'assistant'").withColumn("__k", F.row_number().over(last)).filter("__k = 1")
    used = one.select("task", "arm", "run", F.explode("message.content").alias("c")).filter("c.type = 'tool_use'").groupBy("task", "arm", "run", F.col("c.name").alias("tool")).agg(F.count("*").cast("int").alias("n"))
    return used.groupBy("task", "arm", "run").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool", "n")))).alias("tools"))


def rotation(tasks: DataFrame, arms: list[str], runs: int) -> DataFrame:
    """``run, task, place, arm``: the arms of each task in a run, begun one further each time, so none always follows another.

    ``tasks (number, task)``, numbers from 0; runs count from 1.
    """
    n = len(arms)
    names = F.array(*map(F.lit, arms))
    grid = tasks.select(F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run"), "number", "task").withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return grid.select("run", "task", "place", F.element_at(names, (F.pmod(F.col("place") - F.pmod(F.col("run") + F.col("number"), F.lit(n)), F.lit(n)) + 1).cast("int")).alias("arm"))


def regrade(runs: DataFrame, events: DataFrame, tasks: DataFrame) -> DataFrame:
    """``runs`` graded anew from the transcripts' results: ``passed, recall, falsePositives``, and ``changed`` against before.

    A run without a result, or whose result is an error, has failed.
    """
    key = ["task", "arm", "run"]
    first = F.row_number().over(Window.partitionBy(*key).orderBy("order"))
    result = events.filter("type = 'result'").withColumn("__k", first).filter("__k = 1").select(*key, F.col("result").alias("__reply"), F.coalesce("is_error", F.lit(False)).alias("__error"), F.lit(True).alias("__there"))
    keys = tasks.select(F.col("id").alias("task"), F.col("check").alias("__checks"), F.col("expect").alias("__expected"), F.col("forbid").alias("__forbidden"))
    rows = runs.join(result, key, "left").join(keys, "task", "left")
    rows = rows.withColumn("__answer", answer(F.coalesce("__reply", F.lit("")))).withColumn("__ok", F.coalesce(F.col("__there") & ~F.col("__error"), F.lit(False))).withColumnsRenamed({"passed": "__passed", "recall": "__recall"}).drop("falsePositives")
    out = grade(rows, "__checks", "__expected", "__forbidden", "__answer", "__ok").withColumnRenamed("false_positives", "falsePositives")
    changed = ~F.col("passed").eqNullSafe(F.col("__passed")) | ~F.col("recall").eqNullSafe(F.col("__recall"))
    return out.withColumn("changed", changed).drop(*(c for c in out.columns if c.startswith("__")))
