"""Scanning a source tree: which files are read, and what they belong to."""

from __future__ import annotations

import fnmatch
import json
import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.paths import EXTENSIONS, IGNORED, MARKERS

#: Bytes of the largest file that is read.
LARGEST = 1_000_000


class IgnoreRules:
    """Rules of one folder's ignore file, the last match deciding."""

    def __init__(self, text: str):
        self.rules: list[tuple[re.Pattern, bool, bool]] = []
        for line in text.splitlines():
            line = line.rstrip()
            if not line or line.startswith("#"):
                continue
            keep, line = line.startswith("!"), line.lstrip("!")
            folder, line = line.endswith("/"), line.rstrip("/")
            anchored, line = "/" in line, line.lstrip("/")
            body = "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p, p if p.startswith("[") else re.escape(p)) for p in re.findall(r"\*\*|\*|\?|\[[^\]]*\]|[^*?\[]+|\[", line)).replace(r"\[", "[" if "]" in line else r"\[")
            body = body.replace(".*/", "(?:.*/)?")
            self.rules.append((re.compile(("" if anchored else "(?:.*/)?") + body + "$"), keep, folder))

    def ignored(self, relative: str, folder: bool) -> bool | None:
        found = None
        for pattern, keep, only_folder in self.rules:
            if (folder or not only_folder) and pattern.match(relative):
                found = not keep
        return found


def wanted(name: str, languages: set[str] | None = None, include: tuple[str, ...] = ()) -> bool:
    language = EXTENSIONS.get(os.path.splitext(name)[1].lower())
    ok = language is not None and (languages is None or language in languages or language == "tsx" and "typescript" in languages)
    return ok or any(fnmatch.fnmatch(name, p) for p in include)


def walk(root: str, languages: set[str] | None = None, excludes: tuple[str, ...] = (), include: tuple[str, ...] = ()) -> Iterator[tuple[str, int]]:
    """``(path, bytes)`` of the wanted files, depth first; ignore files count below their own folder."""
    def visit(folder: str, rules: list[tuple[str, IgnoreRules]]) -> Iterator[tuple[str, int]]:
        try:
            with open(os.path.join(folder, ".gitignore"), encoding="utf-8", errors="replace") as f:
                rules = [*rules, (folder, IgnoreRules(f.read()))]
        except OSError:
            pass
        for entry in sorted(os.scandir(folder), key=lambda e: e.name):
            is_folder = entry.is_dir(follow_symlinks=False)
            if is_folder and entry.name in IGNORED:
                continue
            verdict = None
            for base, rule in rules:
                said = rule.ignored(os.path.relpath(entry.path, base).replace(os.sep, "/"), is_folder)
                verdict = verdict if said is None else said
            if verdict:
                continue
            if is_folder:
                yield from visit(entry.path, rules)
            elif wanted(entry.name, languages, include) and entry.stat().st_size <= LARGEST:
                yield entry.path, entry.stat().st_size

    yield from visit(root, [(root, IgnoreRules("\n".join(excludes)))] if excludes else [])


def scan(spark: SparkSession, root: str, languages: set[str] | None = None, excludes: tuple[str, ...] = ()) -> DataFrame:
    """``(path, content, language, hash, chars)`` of a local tree; paths are relative to ``root``."""
    rows = []
    for path, _ in walk(root, languages, excludes):
        with open(path, encoding="utf-8", errors="replace", newline="") as f:
            rows.append((os.path.relpath(path, root).replace(os.sep, "/"), f.read()))
    return describe(spark.createDataFrame(rows, "path string, content string"))


def scan_store(spark: SparkSession, root: str) -> DataFrame:
    """The same from any store that Spark reads, by built-in folders and sizes only."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).filter(F.col("length") <= LARGEST)
    return describe(raw.select("path", F.decode("content", F.lit("UTF-8")).alias("content")).filter(~paths.in_ignored(F.col("path"))))


def describe(files: DataFrame) -> DataFrame:
    from ..functions.text import utf16_length

    return files.withColumn("language", paths.language(F.col("path"))).filter("language is not null").withColumn("hash", F.sha1("content")).withColumn("chars", utf16_length(F.col("content")))


def project_roots(files: DataFrame, markers: DataFrame) -> DataFrame:
    """``(path, project)``: the nearest folder above with a marker of the file's language, else the root.

    ``markers``: ``(folder, language)``.
    """
    parts = F.split("path", "/")
    above = files.select("path", "language", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("folder"))
    near = above.join(markers, ["folder", "language"]).groupBy("path").agg(F.max_by("folder", F.length("folder")).alias("project"))
    return files.select("path").join(near, "path", "left").withColumn("project", F.coalesce("project", F.lit("")))


def marker_folders(all_paths: list[str]) -> list[tuple[str, str]]:
    out = set()
    for path in all_paths:
        folder, _, name = path.rpartition("/")
        for language, names in MARKERS.items():
            if name in names or any(n.startswith(".") and name.endswith(n) for n in names):
                out.add((folder, language))
    return sorted(out)


def parse_jsonc(text: str):
    """JSON with comments and trailing commas."""
    out = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or " ", text, flags=re.S)
    return json.loads(re.sub(r'("(?:\\.|[^"\\])*")|,(\s*[}\]])', lambda m: m[1] or m[2], out))


def load_tsconfig(path: str, seen: frozenset[str] = frozenset()) -> dict:
    """``base_url`` and ``paths`` (longest prefix first) of a tsconfig and those that it extends."""
    if path in seen or not os.path.exists(path):
        return {"base_url": None, "paths": []}
    with open(path, encoding="utf-8") as f:
        config = parse_jsonc(f.read())
    here, options = os.path.dirname(path), config.get("compilerOptions", {})
    out = {"base_url": None, "paths": []}
    if (parent := config.get("extends")):
        at = os.path.normpath(os.path.join(here, parent))
        out = load_tsconfig(at if at.endswith(".json") else at + ".json", seen | {path})
    if "baseUrl" in options:
        out["base_url"] = os.path.normpath(os.path.join(here, options["baseUrl"]))
    if "paths" in options:
        base = out["base_url"] or here
        out["paths"] = sorted(((k, [os.path.normpath(os.path.join(base, v)) for v in vs]) for k, vs in options["paths"].items()), key=lambda kv: -len(kv[0].split("*")[0]))
    return out


def alias_candidates(config: dict, spec: str) -> list[str]:
    for pattern, targets in config["paths"]:
        head, star, tail = pattern.partition("*")
        if not star and spec == pattern:
            return targets
        if star and spec.startswith(head) and spec.endswith(tail) and len(spec) >= len(head) + len(tail):
            middle = spec[len(head):len(spec) - len(tail)]
            return [t.replace("*", middle, 1) for t in targets]
    return [os.path.join(config["base_url"], spec)] if config["base_url"] else []
