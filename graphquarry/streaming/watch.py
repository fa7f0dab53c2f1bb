"""Keeping an index fresh from a stream of files, and windows over events."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.relate import changes, replace_rows
from ..operators.state import cut
from ..sources import store

LANDING = "path string, content string, deleted boolean"
FILES = "path string, content string, hash string"


def read_landing(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of ``(path, content, deleted)`` from JSON files that land in a folder."""
    return spark.readStream.schema(LANDING).json(folder)


def latest(batch: DataFrame) -> DataFrame:
    """One row for each path of a batch; a removal wins over a write."""
    w = Window.partitionBy("path").orderBy(F.desc_nulls_last("deleted"), F.sha1(F.coalesce("content", F.lit(""))))
    return batch.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


class IncrementalIndex:
    """A table of files in buckets of paths; each batch rewrites those that it touches.

    A note beside the data says which version of each bucket is current and
    which batch made it. It is replaced once a batch's buckets are written
    whole, so readers see one batch's state, an index opened anew on the folder
    goes on where the last one ended, and a batch that runs again after it was
    applied does nothing.
    """

    def __init__(self, spark: SparkSession, root: str, on_change: Callable[[DataFrame], None] | None = None, buckets: int = 64):
        self.spark, self.root, self.on_change = spark, root.rstrip("/"), on_change
        note = self._note()
        self.buckets = note["buckets"] if note else buckets

    def _note(self) -> dict | None:
        return store.read_note(self.spark, f"{self.root}/current.json")

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(FILES).parquet(*folders) if folders else self.spark.createDataFrame([], FILES)

    def files(self) -> DataFrame:
        note = self._note()
        return self._read(sorted(set(note["current"].values())) if note else [])

    def _bucket(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(self.buckets)).cast("int"))

    def apply(self, batch: DataFrame, number: int) -> None:
        note = self._note() or {"batch": -1, "buckets": self.buckets, "current": {}}
        if number <= note["batch"]:
            return
        now = cut(self._bucket(latest(batch).withColumn("hash", F.sha1("content"))))
        touched = sorted(r["bucket"] for r in now.select("bucket").distinct().collect())  # at most ``buckets``
        old = self._read([note["current"][str(k)] for k in touched if str(k) in note["current"]])
        gone, new = now.filter("deleted").select("path"), now.filter("not coalesce(deleted, false)").select("path", "content", "hash")
        state = cut(changes(old.join(now.select("path"), "path", "left_semi"), new, "path", "hash"))
        moved = new.join(state.filter("state in ('added', 'changed')"), "path", "left_semi")
        where = f"{self.root}/b{number}-{uuid.uuid4().hex}"
        rows = self._bucket(replace_rows(old, moved, gone, "path")).repartition("bucket")
        rows.write.partitionBy("bucket").parquet(where)
        kept = {r["bucket"] for r in rows.select("bucket").distinct().collect()}
        current = {k: v for k, v in note["current"].items() if int(k) not in touched} | {str(k): f"{where}/bucket={k}" for k in touched if k in kept}
        store.write_note(self.spark, f"{self.root}/current.json", note | {"batch": number, "current": current})
        if self.on_change:
            self.on_change(state.filter("state <> 'unchanged'"))

    def start(self, source: DataFrame, checkpoint: str, available_now: bool = True):
        writer = source.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling counts and sums by type; works on streams and on tables."""
    typed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        typed = typed.withWatermark("ts", late)
    return typed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user: start, end, number of events."""
    typed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return typed.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
