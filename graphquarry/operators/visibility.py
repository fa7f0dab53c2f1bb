"""Which files see a declaration, what overrides what, and uses that stay unlinked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import bfs, closure


def exporting_files(ids: DataFrame, reexports: DataFrame, depth: int | None = None) -> DataFrame:
    """``(id, level)``: files ``ids`` and all that re-export them, by way of others; ``reexports (file, target)``."""
    return bfs(ids, reexports.select(F.col("target").alias("src"), F.col("file").alias("dst")), depth)


def files_seeing(ids: DataFrame, reexports: DataFrame, imports: DataFrame, spaces: DataFrame, using: DataFrame, files: DataFrame) -> DataFrame:
    """``(id)``: files that can see declarations of files ``ids``.

    They are the files and those that re-export them, all that import one of
    these, files of the same namespace or one inside it, files that use the
    namespace, and all files of a project in which it is used globally.
    ``imports (file, target)``, ``spaces (file, namespace)``, ``using (file,
    namespace, is_global)``, ``files (id, project)``.
    """
    barrel = exporting_files(ids, reexports).select("id")
    importers = imports.join(barrel, F.col("target") == F.col("id"), "left_semi").select(F.col("file").alias("id"))
    own = spaces.join(ids, F.col("file") == F.col("id"), "left_semi").select(F.col("namespace").alias("ns")).filter("ns is not null").distinct()
    prefixes = spaces.filter("namespace is not null").withColumn("ns", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("namespace", r"\."))), lambda k: F.array_join(F.slice(F.split("namespace", r"\."), F.lit(1), k), "."))))
    same = prefixes.join(own, "ns", "left_semi").select(F.col("file").alias("id"))
    users = using.join(own, F.col("namespace") == F.col("ns"), "left_semi")
    projects = users.filter("is_global").join(files, F.col("file") == F.col("id")).select("project").distinct()
    everywhere = files.join(projects, "project", "left_semi").select("id")
    return barrel.union(importers).union(same).union(users.select(F.col("file").alias("id"))).union(everywhere).distinct()


def overridden(methods: DataFrame, inherits: DataFrame, depth: int = 6) -> DataFrame:
    """``(id, base)``: each method with those of its name in base types at any distance.

    ``methods (id, name, parent_id)``, ``inherits (src, dst)`` from type to base.
    """
    up = closure(inherits, depth).select(F.col("src").alias("parent_id"), F.col("dst").alias("above"))
    bases = methods.select(F.col("parent_id").alias("above"), "name", F.col("id").alias("base"))
    return methods.join(up, "parent_id").join(bases, ["above", "name"]).select("id", "base").distinct()


def unlinked_calls(uses: DataFrame, names: DataFrame, seeing: DataFrame, results_only: bool = False) -> DataFrame:
    """``(name, n, example)``: unlinked calls of each name in files that can see it, with the first as an example.

    ``results_only``: only calls on the result of another call.
    """
    some = uses.filter("type = 'calls' and to_id is null").join(seeing.select(F.col("id").alias("path")), "path", "left_semi").join(names, "name", "left_semi")
    if results_only:
        some = some.filter(F.col("qualifier").endswith(")"))
    return some.groupBy("name").agg(F.count("*").alias("n"), F.min_by(F.concat_ws(":", "path", "line"), F.struct("path", "line")).alias("example"))


def ancestors(symbols: DataFrame, depth: int | None = None) -> DataFrame:
    """``(id, ancestors)``: the enclosing declarations of each symbol, the nearest first."""
    up = closure(symbols.filter("parent_id is not null").select(F.col("id").alias("src"), F.col("parent_id").alias("dst")), depth)
    listed = up.groupBy(F.col("src").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "dst"))), lambda x: x["dst"]).alias("ancestors"))
    return symbols.select("id").join(listed, "id", "left").withColumn("ancestors", F.coalesce("ancestors", F.array().cast("array<bigint>")))


def nested_in_function(symbols: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """``(id)`` of symbols, or of those ``among`` them (``id``), that a function or method encloses."""
    up = closure(symbols.filter("id is not null and parent_id is not null").select(F.col("id").alias("src"), F.col("parent_id").alias("dst")), sources=among)
    return up.join(symbols.filter("kind in ('function', 'method')").select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
