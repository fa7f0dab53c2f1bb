"""Path predicates: languages, tests, ignored folders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages of file extensions, markers of projects, and folders that are never read.
EXTENSIONS = {".py": "python", ".pyi": "python", ".ts": "typescript", ".mts": "typescript", ".cts": "typescript", ".tsx": "tsx", ".java": "java", ".cs": "csharp"}
MARKERS = {"python": ("pyproject.toml", "setup.py", "setup.cfg"), "typescript": ("tsconfig.json", "package.json"), "tsx": ("tsconfig.json", "package.json"), "java": ("pom.xml", "build.gradle", "build.gradle.kts"), "csharp": (".csproj",)}
IGNORED = (".git", ".hg", ".svn", "node_modules", "bower_components", "dist", "out", "build", "coverage", "bin", "obj", "target", ".gradle", "__pycache__", ".venv", "venv", ".tox", ".mypy_cache", ".pytest_cache")


def language(path: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair))
    return F.try_element_at(known, F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)))


def in_ignored(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*(F.lit(x) for x in IGNORED)))


def is_test(path: Column) -> Column:
    """Whether a path is that of a test, by its folders or the name patterns of its language."""
    folder = path.rlike(r"(?i)(^|/)(tests?|__tests__|specs?)/") | path.rlike(r"(^|/)[^/]*[._-](Unit|Integration|Functional)?Tests?/")
    name, end = F.regexp_extract(path, r"([^/]*?)\.[^./]*$", 1), F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    java = (end == ".java") & (name.rlike(r"^Test[A-Z0-9_].*|.*(Test|Tests|TestCase|IT)$"))
    sharp = (end == ".cs") & name.rlike(r".*Tests?$")
    python = end.isin(".py", ".pyi") & name.rlike(r"^test_.*|.*_test$|^conftest$")
    return folder | java | sharp | python | path.rlike(r"\.(test|spec)\.[^./]+$")


def confined(path: Column, root: str) -> Column:
    """A path as an absolute one without ``.`` and ``..`` steps if it lies in ``root``, else null; relative ones are taken from the root."""
    base = root.replace("\\", "/").rstrip("/")
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(base + "/"), path))
    parts = F.filter(F.split(whole, "/"), lambda x: (x != "") & (x != "."))
    folded = F.aggregate(parts, F.array().cast("array<string>"), lambda r, x: F.when(x == "..", F.slice(r, F.lit(1), F.greatest(F.size(r) - 1, F.lit(0)))).otherwise(F.concat(r, F.array(x))))
    clean = F.concat(F.lit("/"), F.array_join(folded, "/"))
    return F.when((clean == base) | clean.startswith(base + "/"), clean)
