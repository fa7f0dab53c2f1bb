"""Indexes in a store: versions that are written whole, opened only if they are complete and current."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Version of the tables' columns; an index of another one is built anew.
SCHEMA_VERSION = 2
TABLES = ("files", "symbols", "imports", "uses")


class NotReady(RuntimeError):
    """There is no index, or one of another version."""


def _path(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def read_note(spark: SparkSession, where: str) -> dict | None:
    """A small JSON file of the store; None if there is none."""
    fs, path = _path(spark, where)
    if not fs.exists(path):
        return None
    return json.loads("\n".join(r[0] for r in spark.read.text(where).collect()))


def write_note(spark: SparkSession, where: str, note: dict) -> None:
    """Replace a small JSON file: written beside it, then renamed, so readers see the old or the new one."""
    fs, path = _path(spark, where)
    _, beside = _path(spark, f"{where}.{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(bytearray(json.dumps(note, sort_keys=True).encode()))
    out.close()
    kind = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(kind, 1)
    over[0] = kind.OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(beside, path, over)


def save(root: str, **tables: DataFrame) -> str:
    """Write a version of the tables and name it current; returns its folder."""
    spark = next(iter(tables.values())).sparkSession
    version = uuid.uuid4().hex
    for name, table in tables.items():
        table.write.parquet(f"{root}/{version}/{name}")
    write_note(spark, f"{root}/current.json", {"schema": SCHEMA_VERSION, "version": version, "tables": sorted(tables)})
    return f"{root}/{version}"


def open_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The current version's tables, read from its own folder: what is written meanwhile doesn't change them."""
    note = read_note(spark, f"{root}/current.json")
    if note is None:
        raise NotReady("the index has not been built yet")
    if note["schema"] != SCHEMA_VERSION:
        raise NotReady("the index was built by another version")
    return {name: spark.read.parquet(f"{root}/{note['version']}/{name}") for name in note["tables"]}


def clear(spark: SparkSession, root: str) -> None:
    """Delete all versions; the store is then as if nothing had been built."""
    fs, path = _path(spark, root)
    fs.delete(path, True)


def rank_key(symbols: DataFrame, uses: DataFrame) -> str:
    """What ranks depend on, in one number: the symbols and the linked uses."""
    a = symbols.agg(F.count("*"), F.sum(F.xxhash64("id").cast("decimal(38,0)"))).first()
    b = uses.filter("to_id is not null").agg(F.count("*"), F.sum(F.xxhash64("from_id", "to_id").cast("decimal(38,0)"))).first()
    return "-".join(str(x or 0) for x in (*a, *b))


class RankCache:
    """Ranks kept beside an index until its symbols or links change."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def get(self, symbols: DataFrame, uses: DataFrame, compute) -> DataFrame:
        key = rank_key(symbols, uses)
        note = read_note(self.spark, f"{self.root}/ranks.json")
        if note is None or note["key"] != key:
            where = f"{self.root}/ranks-{uuid.uuid4().hex}"
            compute().write.parquet(where)
            note = {"key": key, "at": where}
            write_note(self.spark, f"{self.root}/ranks.json", note)
        return self.spark.read.parquet(note["at"])


def under(files: DataFrame, folder: str) -> DataFrame:
    """The files of a folder and those below it; all for the root."""
    return files if not folder else files.filter((F.col("path") == folder) | F.col("path").startswith(folder.rstrip("/") + "/"))


def refresh_tree(files: DataFrame, scanned: DataFrame, folder: str) -> DataFrame:
    """``files`` with those below ``folder`` replaced by what a scan of it found: new ones come, gone ones go."""
    return files.join(under(files, folder).select("path"), "path", "left_anti").unionByName(under(scanned, folder))


def stale(indexed: DataFrame, now: DataFrame) -> DataFrame:
    """``(path, stale)``: whether a file's content is no longer what was indexed, null if it is gone; both ``(path, hash)``."""
    return indexed.select("path", "hash").join(now.select("path", F.col("hash").alias("__now")), "path", "left").select("path", (F.col("hash") != F.col("__now")).alias("stale"))
