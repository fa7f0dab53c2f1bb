"""Cutting the lineage of iterative operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

#: Bytes of a table, by Catalyst's estimate, up to which it is broadcast.
SMALL = 10 << 20


def if_small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """``df`` to be broadcast if it is estimated to be small; else as it is, for a shuffled join."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= most else df


#: Bytes that a row of few numbers takes in a broadcast hash table.
ROW_BYTES = 96


def if_few(df: DataFrame, rows: int) -> DataFrame:
    """``df`` to be broadcast if its ``rows`` make a small hash table; else to be merged.

    Files of ascending numbers are about twenty times smaller than the table that each
    task would hold, so their size, by which :func:`if_small` and Catalyst judge, says little.
    """
    return F.broadcast(df) if rows * ROW_BYTES <= SMALL else df.hint("merge")


#: Bytes of the read tables for each partition of a large exchange: about a million rows of two or three numbers.
PART_BYTES = 16 << 20


def read_bytes(df: DataFrame) -> int:
    """Bytes of the tables that ``df`` reads, each as often as it is read; those of unknown size count nothing.

    Unlike Catalyst's estimate of a join, which is a product, it grows as the input does.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    return sum(n for n in sizes if n < 1 << 60)


def parts_for(df: DataFrame) -> int | None:
    """Partitions that a large exchange of ``df`` needs, so that a task's share stays the same whatever the input; none where one for each core is enough.

    Adaptive execution joins partitions until there are about as many as cores,
    so a hash table of small rows would grow with the input in each task.
    """
    spark = df.sparkSession
    parts = -(-read_bytes(df) // PART_BYTES)
    return max(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))) if parts > spark.sparkContext.defaultParallelism else None


def dealt(df: DataFrame, *by: str, parts: int | None) -> DataFrame:
    """``df`` dealt out by columns to ``parts`` (:func:`parts_for`), or to as many as adaptive execution finds fit."""
    return df.repartition(*by) if parts is None else df.repartition(parts, *by)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none, as in tests, a temporary folder serves.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None)
    if not found:
        held = sc._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="graphquarry-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def delete_path(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back.

    The plan starts afresh from files that survive a lost executor, and Catalyst
    knows their size, so small tables are broadcast from here on.
    """
    spark = df.sparkSession
    where = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(where)
    out = spark.read.schema(df.schema).parquet(where)
    out.stored_at = where
    return out


def at_once(*jobs: Callable[[], T]) -> list[T]:
    """Run some jobs of their own side by side: small ones take turns on the cluster's cores, not on the clock."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(job) for job in jobs]]


def cut_all(*tables: DataFrame) -> list[DataFrame]:
    return at_once(*(partial(cut, t) for t in tables))


def stored(*tables: DataFrame) -> list[DataFrame]:
    """Each table itself if :func:`cut` wrote it, else cut."""
    return at_once(*((lambda t=t: t if hasattr(t, "stored_at") else cut(t)) for t in tables))


def drop_cut(*tables: DataFrame) -> None:
    """Delete what :func:`cut` wrote; nothing may read it afterwards."""
    for df in tables:
        delete_path(df.sparkSession, df.stored_at)


def bucketed(df: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """``df`` as a table in buckets of ``key``, ``parts`` or as many as the session has shuffle partitions: joins and sums by ``key`` leave it where it lies."""
    spark = df.sparkSession
    name = f"graphquarry_{uuid.uuid4().hex}"
    df.write.bucketBy(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), key).sortBy(key).option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    out = spark.table(name)
    out.stored_as = name
    return out


def drop_bucketed(*tables: DataFrame) -> None:
    for df in tables:
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {df.stored_as}")
        delete_path(df.sparkSession, f"{shared_folder(df.sparkSession)}/{df.stored_as}")


class Seen:
    """What a search has found so far, in few tables however many levels it takes.

    Each level is added as a table; two tables of about one age are written as
    one, as when counting in binary, and the old ones are deleted. So ``n``
    levels make about ``log2(n)`` tables, and a row is written as often.
    """

    def __init__(self, first: DataFrame):
        self.tables: list[tuple[int, DataFrame]] = [(0, first)]

    def add(self, level: DataFrame) -> DataFrame:
        """Take in a level; returns the table that holds it from now on."""
        age = 0
        while self.tables and self.tables[-1][0] == age and len(self.tables) > 1:
            _, older = self.tables.pop()
            level, done = cut(older.unionByName(level)), (older, level)
            drop_cut(*done)
            age += 1
        self.tables.append((age, level))
        return level

    def all(self) -> DataFrame:
        out = self.tables[0][1]
        for _, df in self.tables[1:]:
            out = out.unionByName(df)
        return out
