"""Tables of files' rows that are merged on reading: a base, deltas, tombstones, compaction.

In each table, all rows of a file are replaced together. A batch writes a delta:
the new rows of the files that it touches there, and the names of those files. A
row is alive if no later batch touched its file in its table, nor removed a
folder that it lies in.
Tables lie in buckets of the file's path, so a reader who knows the paths opens
their buckets only, and a compaction rewrites only the buckets that deltas have
rows for. A note names what is current; replacing it is what commits a batch of
all tables, so readers see whole batches.
"""

from __future__ import annotations

import uuid
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.state import at_once, delete_path, if_small
from . import store

TOUCHED = "path string, tbl string, version long"
#: Deltas after which tables are compacted.
MOST_DELTAS = 8


class MergeStore:
    """``tables``: each one's columns as DDL; every table has a ``path``."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, str], buckets: int = 64, most_deltas: int = MOST_DELTAS):
        self.spark, self.root, self.tables, self.most_deltas = spark, root.rstrip("/"), tables, most_deltas
        self.buckets = (self.note() or {"buckets": buckets})["buckets"]

    def note(self) -> dict | None:
        return store.read_note(self.spark, f"{self.root}/current.json")

    def batch(self) -> int:
        """The last batch that was committed; -1 if there was none."""
        return (self.note() or {"batch": -1})["batch"]

    def bucket(self, path: str = "path"):
        return F.pmod(F.xxhash64(path), F.lit(self.buckets)).cast("int")

    def buckets_of(self, paths: DataFrame) -> set[int]:
        """Buckets of some files: at most as many as there are."""
        return {r[0] for r in paths.select(self.bucket()).distinct().collect()}

    def _rows(self, name: str, folders: list[str]) -> DataFrame:
        schema = T.StructType.fromDDL(f"{self.tables[name]}, version long")
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, name: str, buckets: set[int] | None = None) -> DataFrame:
        """The living rows of a table, or of some of its buckets."""
        return self._alive(name, self.note() or {"base": {}, "deltas": [], "prefixes": []}, buckets).drop("version")

    def _alive(self, name: str, note: dict, buckets: set[int] | None) -> DataFrame:
        wanted = lambda k: buckets is None or int(k) in buckets
        folders = [at for k, at in note["base"].get(name, {}).items() if wanted(k)]
        folders += [f"{d['folder']}/{name}/bucket={k}" for d in note["deltas"] for k in d["buckets"].get(name, []) if wanted(k)]
        rows = self._rows(name, sorted(folders))
        if note["deltas"] and folders:
            touched = self.spark.read.schema(TOUCHED).parquet(*(f"{d['folder']}/touched" for d in note["deltas"])).filter(F.col("tbl") == name)
            latest = touched.groupBy("path").agg(F.max("version").alias("latest"))
            small = if_small(touched, 4 << 20) is not touched
            rows = rows.join(F.broadcast(latest) if small else latest, "path", "left").filter(F.col("version") >= F.coalesce("latest", F.lit(-1))).drop("latest")
        for prefix, version in note["prefixes"]:
            rows = rows.filter(~F.col("path").startswith(prefix) | (F.col("version") >= version))
        return rows

    def commit(self, batch: int, rows: dict[str, tuple[DataFrame, DataFrame]], prefixes: list[str] = ()) -> bool:
        """Replace some files' rows in each table of ``rows``, which gives the new rows and the files ``(path)``, and remove the folders ``prefixes``; false if the batch was committed before.

        A folder's removal comes before the batch's own rows, which stay.
        """
        note = self.note() or {"batch": -1, "buckets": self.buckets, "base": {}, "deltas": [], "prefixes": [], "old": []}
        if batch <= note["batch"]:
            return False
        folder = f"{self.root}/d{batch}-{uuid.uuid4().hex}"
        touched = reduce(DataFrame.unionByName, (paths.select("path", F.lit(name).alias("tbl"), F.lit(batch).cast("long").alias("version")) for name, (_, paths) in rows.items()))

        def write(name: str) -> None:
            columns = T.StructType.fromDDL(self.tables[name]).fieldNames()
            rows[name][0].select(*columns).withColumn("version", F.lit(batch).cast("long")).withColumn("bucket", self.bucket()).write.partitionBy("bucket").parquet(f"{folder}/{name}")

        at_once(lambda: touched.distinct().write.parquet(f"{folder}/touched"), *(partial(write, name) for name in rows))
        held = {name: self._listed(f"{folder}/{name}") for name in rows}
        note["deltas"].append({"batch": batch, "folder": folder, "buckets": held})
        note["prefixes"] += [[p, batch] for p in prefixes]
        note["batch"] = batch
        store.write_note(self.spark, f"{self.root}/current.json", note)
        if len(note["deltas"]) > self.most_deltas:
            self.compact()
        return True

    def _listed(self, folder: str) -> list[int]:
        fs, path = store._path(self.spark, folder)
        return sorted(int(s.getPath().getName()[7:]) for s in fs.listStatus(path) if s.getPath().getName().startswith("bucket="))

    def compact(self) -> None:
        """Write the buckets that deltas touched anew, without dead rows. What this replaces is deleted by the next compaction, so readers that began before it can end.

        A removed folder's rows can lie in any bucket, so such a removal rewrites all.
        """
        note = self.note()
        if not note or not note["deltas"]:
            return
        folder = f"{self.root}/base-{uuid.uuid4().hex}"
        replaced = [d["folder"] for d in note["deltas"]]
        paths = self.spark.read.schema(TOUCHED).parquet(*(f"{d['folder']}/touched" for d in note["deltas"]))
        dead = set(range(self.buckets)) if note["prefixes"] else self.buckets_of(paths)
        base = {}
        for name in self.tables:
            some = dead | {k for d in note["deltas"] for k in d["buckets"].get(name, [])}
            old = note["base"].get(name, {})
            self._alive(name, note, some).withColumn("bucket", self.bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{folder}/{name}")
            base[name] = {k: at for k, at in old.items() if int(k) not in some} | {str(k): f"{folder}/{name}/bucket={k}" for k in self._listed(f"{folder}/{name}")}
            replaced += [at for k, at in old.items() if int(k) in some]
        store.write_note(self.spark, f"{self.root}/current.json", note | {"base": base, "deltas": [], "prefixes": [], "old": replaced})
        for at in note["old"]:
            delete_path(self.spark, at)
