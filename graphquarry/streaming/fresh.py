"""Symbols, imports and links of a source tree, kept fresh from a stream of files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relink import relinked_rows
from ..operators.state import cut, cut_all, if_small
from ..sources.merge import MergeStore
from ..sources.parsers import IMPORT, SYMBOL, USE, module_name, parse_files
from ..sources.workspace import describe
from .watch import latest

_OWN = "path string, language string, module string, "
TABLES = {
    "files": "path string, module string, language string, hash string",
    "symbols": _OWN + SYMBOL.replace("parent int, ", "") + ", id long, parent_id long",
    "imports": _OWN + IMPORT + ", target_module string, local string, target_path string",
    "uses": _OWN + USE.replace("inside int, ", "") + ", id long, from_id long, to_id long",
}
#: Folders that one batch may remove by name; more are an error, as each is a condition of every later read.
MOST_FOLDERS = 100


class FreshIndex:
    """The tables ``files``, ``symbols``, ``imports`` (resolved) and ``uses`` (linked) of a tree, merged on reading.

    A batch has rows ``(path, content, deleted)``: files as they are now and
    files that are gone; a gone path that ends in ``/`` is a folder with all in
    it. Files whose content is as it was are left alone. After each batch the
    tables are what a full build of the tree would give; a batch that runs again
    after it was committed does nothing, and an index opened anew on the folder
    goes on where the last one ended.
    """

    def __init__(self, spark: SparkSession, root: str, roots: list[str] = ("",), layout=None, on_change: Callable[[int], None] | None = None, buckets: int = 64, most_deltas: int = 8):
        self.spark, self.roots, self.layout, self.on_change = spark, list(roots), layout, on_change
        self.store = MergeStore(spark, root, TABLES, buckets, most_deltas)

    def table(self, name: str) -> DataFrame:
        return self.store.read(name)

    def _files(self, described: DataFrame) -> DataFrame:
        roots = self.roots

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield frame.assign(module=[module_name(p, x, roots) for p, x in zip(frame["path"], frame["language"])])[["path", "module", "language", "hash"]]

        return described.select("path", "language", "hash").mapInPandas(run, TABLES["files"])

    def apply(self, batch: DataFrame, number: int) -> None:
        if number <= self.store.batch():
            return
        now = cut(latest(batch.filter("path is not null")).withColumn("deleted", F.coalesce("deleted", F.lit(False))).withColumn("hash", F.sha1(F.coalesce("content", F.lit("")))))
        folders = [r["path"] for r in now.filter("deleted and endswith(path, '/')").select("path").limit(MOST_FOLDERS + 1).collect()]
        if len(folders) > MOST_FOLDERS:
            raise ValueError(f"a batch may remove {MOST_FOLDERS} folders at most")
        old = {name: self.store.read(name) for name in TABLES}
        inside = old["files"].filter("false")
        for folder in folders:
            inside = inside.unionByName(old["files"].filter(F.col("path").startswith(folder)))
        written = now.filter("not deleted").withColumn("content", F.coalesce("content", F.lit("")))
        same = old["files"].join(if_small(written.select("path", "hash")), ["path", "hash"], "left_semi").select("path")
        if folders:  # what a removed folder holds again is new
            same = same.join(inside.select("path"), "path", "left_anti")
        described = describe(written.join(if_small(cut(same)), "path", "left_anti").select("path", "content"))
        changed = cut(described)
        gone = now.filter("deleted").select("path").union(inside.select("path")).join(if_small(changed.select("path")), "path", "left_anti").distinct()
        gone = cut(gone.join(old["files"].select("path"), "path", "left_semi"))
        if changed.isEmpty() and gone.isEmpty():
            return
        symbols, imports, uses, _ = parse_files(changed, self.roots)
        new = {"files": self._files(changed), "symbols": symbols, "imports": imports, "uses": uses}
        rows = relinked_rows(old, dict(zip(new, cut_all(*new.values()))), changed.select("path"), gone, self.layout)
        self.store.commit(number, rows, folders)
        if self.on_change:
            self.on_change(number)

    def start(self, source: DataFrame, checkpoint: str, available_now: bool = True):
        writer = source.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()
