"""Sinks: CSV files, graph scripts, usage logs, versioned tables."""

from __future__ import annotations

import json
import math
import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import csv_field

#: Rows in a statement of a script.
BATCH = 500
#: Bytes at which a usage log is put aside, and characters kept of arguments.
ROTATE, CLIP = 2_000_000, 200


def csv_lines(df: DataFrame) -> DataFrame:
    """``line``: each row as a CSV record; quotes only where a field needs them, null as empty."""
    return df.select(F.array_join(F.array(*(csv_field(F.col(c)) for c in df.columns)), ",").alias("line"))


def export_csv(df: DataFrame, path: str) -> None:
    """One part file for each partition, with CR LF ends; a header file sorts first."""
    head = df.sparkSession.createDataFrame([tuple(df.columns)], ", ".join(f"c{k} string" for k in range(len(df.columns))))
    csv_lines(head).coalesce(1).write.mode("overwrite").option("lineSep", "\r\n").text(f"{path}/header")
    csv_lines(df).write.mode("overwrite").option("lineSep", "\r\n").text(f"{path}/rows")


def cypher_literal(value) -> str:
    """A value as a graph-query literal; null entries of maps are left out, odd keys are quoted, NaN is null."""
    if value is None or isinstance(value, float) and not math.isfinite(value):
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(cypher_literal, value)) + "]"
    if isinstance(value, dict):
        key = lambda k: k if re.fullmatch(r"[A-Za-z_]\w*", k) else "`" + k.replace("`", "``") + "`"
        return "{" + ", ".join(f"{key(k)}: {cypher_literal(v)}" for k, v in value.items() if v is not None) + "}"
    return json.dumps(str(value), ensure_ascii=False)


def statements(rows: Iterator[dict], body: str, size: int = BATCH) -> Iterator[str]:
    """``UNWIND [...] AS row`` statements of ``size`` rows each."""
    held: list[str] = []
    for row in rows:
        held.append(cypher_literal(row))
        if len(held) == size:
            yield f"UNWIND [{', '.join(held)}] AS row\n{body};"
            held = []
    if held:
        yield f"UNWIND [{', '.join(held)}] AS row\n{body};"


def graph_script(df: DataFrame, body: str, size: int = BATCH) -> DataFrame:
    """``statement``: batched statements, made partition by partition."""
    names = df.columns

    def run(frames):
        import pandas as pd

        rows = (dict(zip(names, (v.item() if hasattr(v, "item") else list(v) if hasattr(v, "tolist") else v for v in r))) for frame in frames for r in frame.itertuples(index=False, name=None))
        yield pd.DataFrame({"statement": list(statements(rows, body, size))})

    return df.mapInPandas(run, T.StructType([T.StructField("statement", T.StringType())]))


def export_graph(nodes: DataFrame, edges: DataFrame, path: str, app: str, repo: str) -> None:
    """A script as text parts: schema, removal of the section, nodes, relationships by type."""
    spark = nodes.sparkSession
    key = f"app: {cypher_literal(app)}, repo: {cypher_literal(repo)}"
    lead = ["CREATE CONSTRAINT symbol_key IF NOT EXISTS FOR (s:Symbol) REQUIRE (s.app, s.repo, s.id) IS UNIQUE;", f"MATCH (s:Symbol {{{key}}}) CALL (s) {{ DETACH DELETE s }} IN TRANSACTIONS OF 10000 ROWS;"]
    spark.createDataFrame([(s,) for s in lead], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/0-schema")
    graph_script(nodes, f"CREATE (s:Symbol {{{key}}}) SET s += row").write.mode("overwrite").text(f"{path}/1-nodes")
    for kind in ("calls", "extends", "implements", "references"):
        body = f"MATCH (a:Symbol {{{key}, id: row.src}}), (b:Symbol {{{key}, id: row.dst}}) CREATE (a)-[:{kind.upper()} {{count: row.n, lines: row.lines}}]->(b)"
        graph_script(edges.filter(F.col("type") == kind).drop("type"), body).write.mode("overwrite").text(f"{path}/2-{kind}")


class UsageLog:
    """An append-only log of calls, one JSON object a line; put aside once it is large."""

    def __init__(self, path: str, every: int = 100):
        self.path, self.every, self.writes = path, every, 0

    def record(self, entry: dict) -> None:
        if self.writes % self.every == 0 and os.path.exists(self.path) and os.path.getsize(self.path) > ROTATE:
            os.replace(self.path, self.path + ".1")
        self.writes += 1
        if isinstance(entry.get("args"), str):
            entry = entry | {"args": entry["args"][:CLIP]}
        with open(self.path, "a", encoding="utf-8") as f:
            f.write(json.dumps({k: v for k, v in entry.items() if v is not None}, ensure_ascii=False) + "\n")


def read_usage(spark, path: str) -> DataFrame:
    """The log put aside, if there is one, and the current one; lines that aren't JSON are skipped."""
    from ..schemas import USAGE

    found = [p for p in (path + ".1", path) if os.path.exists(p)]
    if not found:
        return spark.createDataFrame([], USAGE)
    return spark.read.schema(USAGE).option("mode", "DROPMALFORMED").json(found)


class UsageTail:
    """Follows a usage log: each ``read`` gives the records added since the last one.

    It begins at the end, unless ``history`` is set; a half-written line waits
    for its rest. When the log was put aside, what it still held is read from
    there first. Lines that aren't JSON objects are skipped.
    """

    def __init__(self, path: str, history: bool = False):
        self.path, self.partial = path, b""
        self.offset = 0 if history else self._size(path)
        self.node = self._node(path)

    @staticmethod
    def _size(path: str) -> int:
        return os.path.getsize(path) if os.path.exists(path) else 0

    @staticmethod
    def _node(path: str) -> int | None:
        return os.stat(path).st_ino if os.path.exists(path) else None

    def _more(self, path: str, start: int) -> bytes:
        with open(path, "rb") as f:
            f.seek(start)
            return f.read()

    def read(self) -> list[dict]:
        body, node = self.partial, self._node(self.path)
        if node is None:
            return []
        if node != self.node or self._size(self.path) < self.offset:
            aside = self.path + ".1"
            if self.node is not None and self._node(aside) == self.node:
                body += self._more(aside, self.offset)
            body = body + b"\n" if body else body
            self.offset, self.node = 0, node
        new = self._more(self.path, self.offset)
        self.offset += len(new)
        *lines, self.partial = (body + new).split(b"\n")
        out = []
        for line in lines:
            try:
                record = json.loads(line)
            except ValueError:
                continue
            if isinstance(record, dict):
                out.append(record)
        return out
