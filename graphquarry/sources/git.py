"""The working tree's changes as a source: which lines of which files differ from the last commit."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relate import innermost, overlapping

_FILE = re.compile(r"\+\+\+ (?:b/(.*)|/dev/null)$")
_HUNK = re.compile(r"@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@")


def changed_ranges(diff: Iterable[str]) -> Iterator[tuple[str, int, int]]:
    """``(path, low, high)`` of each hunk of a diff without context; where lines only went, the line before stands for them."""
    path = None
    for line in diff:
        if m := _FILE.match(line):
            path = m[1]
        elif path and (m := _HUNK.match(line)):
            low, n = int(m[1]), int(m[2] or 1) if m[2] != "0" else 1
            yield path, max(low, 1), low + n - 1


def working_tree(spark: SparkSession, root: str) -> DataFrame:
    """``(path, low, high)`` of what differs from the last commit; no rows where there is none."""
    got = subprocess.run(["git", "-C", root, "diff", "HEAD", "--unified=0", "--no-color", "--no-ext-diff"], capture_output=True, text=True, errors="replace")
    return spark.createDataFrame(list(changed_ranges(got.stdout.splitlines())) if not got.returncode else [], "path string, low int, high int")


def changed_symbols(symbols: DataFrame, ranges: DataFrame, most: int = 20) -> DataFrame:
    """``(id)`` of the innermost declarations on changed lines, by path and line; namespaces and modules don't count. ``most`` is the request's limit."""
    hits = overlapping(symbols.select("id", "parent_id", "path", "kind", "start_line", "end_line"), ranges, "path").dropDuplicates(["id"])
    return innermost(hits).filter(~F.col("kind").isin("namespace", "module")).orderBy("path", "start_line", "id").select("id").limit(most)
