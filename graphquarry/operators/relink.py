"""Linking again after some files changed: only what the change can touch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linker import link, resolve_imports
from .state import cut, cut_all, if_small
from .visibility import files_seeing


def imports_to_resolve(imports: DataFrame, changed: DataFrame) -> DataFrame:
    """Imports of changed files, those that point into them, and all that are unresolved; ``imports`` with ``path``, ``target_path``, ``target_space``, ``changed (path)``."""
    touched = changed.select("path").distinct().withColumn("__c", F.lit(True))
    out = imports.join(touched, "path", "left").join(touched.select(F.col("path").alias("target_path"), F.col("__c").alias("__t")), "target_path", "left")
    return out.filter(F.col("__c").isNotNull() | F.col("__t").isNotNull() | (F.col("target_path").isNull() & F.col("target_space").isNull())).select(*imports.columns)


def changed_meaning(before: DataFrame, after: DataFrame, key: list[str], targets: list[str]) -> DataFrame:
    """``(path)`` of files with an import that resolves to something else than before, or to nothing; nulls compare as values."""
    old = before.select(*key, *(F.col(t).alias(f"__{t}") for t in targets))
    joined = after.select(*key, *targets).join(old, key)
    differs = ~F.lit(True)
    for t in targets:
        differs = differs | ~F.col(t).eqNullSafe(F.col(f"__{t}"))
    return joined.filter(differs).select("path").distinct()


def uses_to_resolve(uses: DataFrame, files: DataFrame, into: DataFrame, seeing: DataFrame, names: DataFrame) -> DataFrame:
    """Uses that must be linked again, once each.

    All uses in ``files (path)``; those that pointed to a symbol in ``into
    (id)``; and unlinked ones in files ``seeing (path)`` whose name is among
    ``names (name)``, as a new declaration may be what they mean.
    """
    a = uses.join(files.select("path").distinct(), "path", "left_semi").select("id")
    b = uses.join(into.select(F.col("id").alias("to_id")).distinct(), "to_id", "left_semi").select("id")
    c = uses.filter("to_id is null").join(seeing.select("path").distinct(), "path", "left_semi").join(names.select("name").distinct(), "name", "left_semi").select("id")
    return uses.join(a.union(b).union(c).distinct(), "id", "left_semi")


def _seeing(paths: DataFrame, symbols: DataFrame, imports: DataFrame, files: DataFrame) -> DataFrame:
    modules = files.select(F.col("module").alias("target_module"), F.col("path").alias("target"))
    spaces = symbols.filter("kind = 'namespace'").select(F.col("path").alias("file"), F.col("qualified_name").alias("namespace")).distinct()
    hit = imports.join(modules, "target_module").select(F.col("path").alias("file"), "target", "kind")
    used = imports.filter("kind in ('using', 'wildcard')").select(F.col("path").alias("file"), F.col("target_module").alias("namespace"), F.coalesce("is_global", F.lit(False)).alias("is_global"))
    again = hit.filter("kind in ('reexport', 'wildcard')").select("file", "target")
    return files_seeing(paths.select(F.col("path").alias("id")), again, hit.select("file", "target"), spaces, used, files.select(F.col("path").alias("id"), F.lit("").alias("project"))).select(F.col("id").alias("path"))


#: What names an import beside its file.
IMPORT_KEY = ("line", "kind", "spec", "name", "alias")
#: What resolving adds to an import.
RESOLVED = ("target_module", "local", "target_path")


def with_target_path(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Resolved ``imports`` with ``target_path``: the file of the module that each means, null if the tree has none."""
    at = files.groupBy(F.col("module").alias("target_module")).agg(F.min("path").alias("target_path"))
    return imports.drop("target_path").join(at, "target_module", "left")


def relinked_rows(old: dict[str, DataFrame], new: dict[str, DataFrame], changed: DataFrame, gone: DataFrame, layout=None) -> dict[str, tuple[DataFrame, DataFrame]]:
    """What a change replaces: for each table its new rows and the files ``(path)`` of which they are all rows.

    ``old`` has ``imports`` resolved (with :data:`RESOLVED`) and ``uses`` linked;
    ``new`` has the rows of the files ``changed`` as parsed. Beside those files,
    imports are resolved again that point into changed or gone files or to none;
    a file is linked anew if one of its imports now means something else, and a
    use if it pointed into such a file, or was open and may mean a declared name
    that it sees. Links through inheritance follow the types above them, so a
    changed inheritance links all uses anew.
    """
    paths = cut(changed.select("path").union(gone.select("path")).distinct())
    without = lambda df: df.join(if_small(paths), "path", "left_anti")
    still = without(old["imports"]).withColumn("target_space", F.lit(None).cast("string"))
    files, symbols, again, before = cut_all(
        without(old["files"]).unionByName(new["files"]), without(old["symbols"]).unionByName(new["symbols"]), imports_to_resolve(still, paths).drop("target_space"),
        old["symbols"].join(if_small(paths), "path", "left_semi").select("id", "name"),
    )
    todo = again.drop(*RESOLVED).unionByName(new["imports"].drop(*RESOLVED))
    resolved = cut(with_target_path(resolve_imports(todo, symbols, files, layout), files))
    key = F.xxhash64("path", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in IMPORT_KEY)).alias("key")
    meaning = lambda df: df.select("path", key, "target_module", "target_path").distinct()
    meant = cut(changed_meaning(meaning(again), meaning(without(resolved)), ["path", "key"], ["target_module", "target_path"]))
    settled = still.filter("target_path is not null").join(if_small(paths.select(F.col("path").alias("target_path"))), "target_path", "left_anti").drop("target_space")
    imports = settled.unionByName(resolved)

    names = before.select("name").union(new["symbols"].select("name")).distinct()
    seeing = _seeing(paths, symbols, imports, files)
    kept = without(old["uses"])
    heirs = "type in ('extends', 'implements')"
    some = cut(uses_to_resolve(kept, meant, before.select("id"), seeing, names))
    moved = some.select("type").union(new["uses"].select("type")).union(old["uses"].join(if_small(paths), "path", "left_semi").select("type")).filter(heirs)
    if not moved.isEmpty():
        some = kept
    todo = cut(some.drop("to_id").unionByName(new["uses"].drop("to_id")))
    known = kept.filter(heirs).filter("to_id is not null").join(some.select("id"), "id", "left_anti").select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))
    linked = cut(link(symbols, imports, todo, layout, known, files.select("path", "module")))
    where = cut(linked.select("path").union(paths).distinct())
    rest = kept.join(if_small(where), "path", "left_semi").join(linked.select("id"), "id", "left_anti")
    turned = meant.union(paths).distinct()
    return {
        "files": (new["files"], paths), "symbols": (new["symbols"], paths),
        "imports": (imports.join(if_small(turned), "path", "left_semi"), turned),
        "uses": (rest.unionByName(linked.select(*rest.columns)), where),
    }


def relink(old: dict[str, DataFrame], new: dict[str, DataFrame], changed: DataFrame, gone: DataFrame, layout=None) -> dict[str, DataFrame]:
    """The tables after a change: ``old`` without the files ``changed`` and ``gone`` (``path``), with the rows of ``new``, linked anew where needed.

    Tables: ``files (path, module)``, ``symbols``, ``imports`` as parsed or
    resolved, ``uses`` (``old``: linked, with ``to_id``). Equal to linking
    everything, see :func:`relinked_rows`.
    """
    if "target_path" not in old["imports"].columns:
        resolved = resolve_imports(old["imports"].drop(*RESOLVED), old["symbols"], old["files"], layout)
        old = old | {"imports": cut(with_target_path(resolved, old["files"]))}
    out = relinked_rows(old, new, changed, gone, layout)
    return {n: cut(old[n].join(if_small(paths), "path", "left_anti").unionByName(rows.select(*old[n].columns))) for n, (rows, paths) in out.items()}
