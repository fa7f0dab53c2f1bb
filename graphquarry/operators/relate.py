"""Relational operators of the linker: unique picks, merges, intervals, visibility."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unique_or_null(candidates: DataFrame, key: str, name: str = "qualified_name", target: str = "id") -> DataFrame:
    """``(key, target)``: the least id if all candidates share one qualified name, else null.

    Ambiguity is a result. Overloads share a name, so they are no ambiguity.
    """
    return candidates.groupBy(key).agg(F.min(name).alias("__a"), F.max(name).alias("__b"), F.min(target).alias("__t")).select(key, F.when(F.col("__a") == F.col("__b"), F.col("__t")).alias(target))


def first_rule(candidates: DataFrame, key: str, rule: str = "rule", name: str = "qualified_name", target: str = "id") -> DataFrame:
    """Like :func:`unique_or_null`, with the candidates of each key's first rule that has any."""
    each = candidates.groupBy(key, rule).agg(F.min(name).alias("a"), F.max(name).alias("b"), F.min(target).alias("t"))
    first = each.groupBy(key).agg(F.min_by(F.struct("a", "b", "t"), rule).alias("x"))
    return first.select(key, F.when(F.col("x.a") == F.col("x.b"), F.col("x.t")).alias(target))


def first_of_each(df: DataFrame, by: str | list[str], order: list, most: int, place: str = "place") -> DataFrame:
    """The first ``most`` rows of each group, with their ``place`` from 1.

    The limit stands right above the ranks, so tasks drop what can't be among
    the first before rows are shuffled: ``most`` rows of a group and task at most.
    """
    w = Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(*order)
    return df.withColumn(place, F.row_number().over(w)).filter(F.col(place) <= most)


def top_declaration(candidates: DataFrame, ancestors: DataFrame, key: str, owner: str = "owner", target: str = "id") -> DataFrame:
    """``(key, target)``: the candidate whose owner is an ancestor of all others' owners, else null.

    ``ancestors``: pairs (``type``, ``ancestor``).
    """
    some = candidates.groupBy(key, owner).agg(F.min(target).alias(target))
    many = some.groupBy(key).agg(F.count("*").alias("__all"))
    below = some.select(key, F.col(owner).alias("type")).join(ancestors.select("type", "ancestor").distinct().filter("type <> ancestor"), "type").groupBy(key, F.col("ancestor").alias(owner)).agg(F.count("*").alias("__below"))
    top = some.join(below, [key, owner], "left").join(many, key).filter(F.coalesce("__below", F.lit(0)) == F.col("__all") - 1)
    return many.select(key).join(top.groupBy(key).agg(F.min(target).alias(target)), key, "left")


def merge_parts(symbols: DataFrame, key: str | list[str] = "qualified_name", id: str = "id") -> DataFrame:
    """``symbols`` with ``merged_into``: the least id of rows that share the key, null for that row itself."""
    keys = [key] if isinstance(key, str) else list(key)
    least = symbols.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(F.min(id).alias("__c"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
    return symbols.join(least, same, "left").withColumn("merged_into", F.when(F.col(id) != F.col("__c"), F.col("__c"))).drop("__c", *(f"__{k}" for k in keys))


def canonical(df: DataFrame, column: str, merged: DataFrame) -> DataFrame:
    """``column`` replaced by the canonical id, where ``merged (id, merged_into)`` has one."""
    to = merged.filter("merged_into is not null").select(F.col("id").alias("__i"), F.col("merged_into").alias("__m"))
    return df.join(to, F.col(column) == F.col("__i"), "left").withColumn(column, F.coalesce("__m", column)).drop("__i", "__m")


def overlapping(left: DataFrame, right: DataFrame, on: str | list[str], start: str = "start_line", end: str = "end_line", low: str = "low", high: str = "high") -> DataFrame:
    """Rows of ``left`` whose closed interval meets one of ``right``'s, equal in ``on``: an equi-join with a range residual."""
    return left.join(right, on).filter((F.col(start) <= F.col(high)) & (F.col(end) >= F.col(low)))


def overlapping_bins(left: DataFrame, right: DataFrame, width: int, start: str, end: str, low: str, high: str) -> DataFrame:
    """The same without an equality: intervals are dealt into bins of ``width``, each pair is kept in the first bin that both have."""
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)))
    met = left.filter(F.col(start) <= F.col(end)).withColumn("__bin", cells(start, end)).join(right.filter(F.col(low) <= F.col(high)).withColumn("__bin", cells(low, high)), "__bin")
    return met.filter((F.col(start) <= F.col(high)) & (F.col(end) >= F.col(low)) & (F.col("__bin") == F.floor(F.greatest(start, low) / width))).drop("__bin")


def innermost(hits: DataFrame, id: str = "id", parent: str = "parent_id") -> DataFrame:
    """Hits that no other hit has as its parent."""
    return hits.join(hits.select(F.col(parent).alias("__p")).filter("__p is not null").distinct(), F.col(id) == F.col("__p"), "left_anti")


def effective_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """A file's own imports, and the global ones of other files of its project: ``(for_file, own, import columns)``."""
    own = imports.select(F.col("file_id").alias("for_file"), F.lit(True).alias("own"), *imports.columns)
    shared = imports.filter("is_global").join(files.select(F.col("id").alias("file_id"), "project"), "file_id").join(files.select(F.col("id").alias("for_file"), "project"), "project").filter("for_file <> file_id")
    return own.unionByName(shared.select("for_file", F.lit(False).alias("own"), *imports.columns))


def changes(old: DataFrame, new: DataFrame, key: str = "path", mark: str = "hash") -> DataFrame:
    """``(key, state)``: added, changed, gone or unchanged, by a full outer join on the key."""
    a, b = old.select(key, F.col(mark).alias("__a"), F.lit(1).alias("__o")), new.select(key, F.col(mark).alias("__b"), F.lit(1).alias("__n"))
    state = F.when(F.col("__o").isNull(), "added").when(F.col("__n").isNull(), "gone").when(F.col("__a").eqNullSafe(F.col("__b")), "unchanged").otherwise("changed")
    return a.join(b, key, "full").select(key, state.alias("state"))


def replace_rows(table: DataFrame, rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``table`` without the keys in ``gone`` or ``rows``, and with ``rows``."""
    drop = rows.select(key).union(gone.select(key)).distinct()
    return table.join(drop, key, "left_anti").unionByName(rows)


def null_targets(edges: DataFrame, gone: DataFrame, column: str = "to_symbol_id") -> DataFrame:
    """Edges whose target is among ``gone (id)`` stay, unresolved."""
    return edges.join(gone.select(F.col("id").alias("__g")), F.col(column) == F.col("__g"), "left").withColumn(column, F.when(F.col("__g").isNull(), F.col(column))).drop("__g")


#: The columns of a symbol as requests show it.
SYMBOL_COLUMNS = ("id", "kind", "name", "qualified_name", "namespace", "signature", "doc", "start_line", "end_line", "exported", "is_partial", "chars", "parent_id", "path", "language")


def symbol_projection(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols with their file's path and language: the fifteen columns of :data:`SYMBOL_COLUMNS`; ``files (id, path, language)``."""
    own = symbols.drop("path", "language").join(files.select(F.col("id").alias("file_id"), "path", "language"), "file_id")
    return own.select(*SYMBOL_COLUMNS)


def slim_refs(symbols: DataFrame, name: str | None = None, parents: DataFrame | None = None, path: str | None = None, namespace: str | None = None, ids: DataFrame | None = None) -> DataFrame:
    """The narrow columns of symbols by any of: name, parents (``id``), file, namespace, ids (``id``); all without a condition."""
    some = symbols.select("id", "kind", "name", "qualified_name", "namespace", "parent_id", "path")
    for column, value in (("name", name), ("path", path), ("namespace", namespace)):
        some = some.filter(F.col(column) == value) if value is not None else some
    if parents is not None:
        some = some.join(parents.select(F.col("id").alias("parent_id")), "parent_id", "left_semi")
    return some if ids is None else some.join(ids.select("id"), "id", "left_semi")


def type_parts(merged: DataFrame, ids: DataFrame) -> DataFrame:
    """``(id, part)``: all parts of the types ``ids``, whichever part is asked for; ``merged (id, merged_into)``."""
    whole = merged.select(F.col("id").alias("part"), F.coalesce("merged_into", "id").alias("whole"))
    asked = whole.join(ids.select(F.col("id").alias("part")), "part", "left_semi").select(F.col("part").alias("id"), "whole")
    return asked.join(whole, "whole").select("id", "part")


def base_types(parts: DataFrame, inherits: DataFrame, merged: DataFrame) -> DataFrame:
    """``(id, base)``: the types that any part extends or implements, by their canonical ids; ``inherits (src, dst)``."""
    found = parts.join(inherits.select(F.col("src").alias("part"), F.col("dst").alias("base")), "part").select("id", "base")
    return canonical(found, "base", merged).select("id", "base").distinct()
