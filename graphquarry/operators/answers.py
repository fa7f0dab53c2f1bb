"""Assembled answers: seeds of a task, source blocks, references with callers' code, callees, context.

Requests are small and their limits are part of what they return; the tables
that they read are not, so lookups are joins and top-k, and only cut rows come
to the driver.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, text
from . import graph, search, visibility
from .relate import first_of_each
from .state import cut

#: Kinds that are types, and the limits of answers.
TYPE_KINDS = ("class", "interface", "enum", "type", "type_alias")
SEEDS, SAME_NAME, WORD_HITS = 8, 3, 5
NAMES, BATCH_LINES, LINES = 10, 600, 250
REFERENCES, CALLERS, SHORT_CALLER, AROUND, CODE_LINES, MATCHES, MATCH_FILES = 80, 5, 25, 2, 150, 15, 10
CALLEES, EXTERNAL = 40, 15
UNLINKED_SYMBOLS, PER_LEVEL, TESTS, BLAST = 200, 15, 15, 500
_TOKEN = re.compile(r"[A-Za-z_$][\w$]*(?:(?:\.|::?)[A-Za-z_$][\w$]*)*")


def looks_like_code(token: str, task: str) -> bool:
    """The rule of :func:`text.is_code` for one word."""
    if len(token) < 2:
        return False
    if re.search(r"[a-z][A-Z]|[_$\d]", token):
        return True
    if re.fullmatch(r"[A-Z][a-z]+", token):
        return len(token) >= 4 and token.lower() not in text.STOP_WORDS
    return not re.fullmatch(r"[A-Z]{2,}", token) and re.search(rf"(?<![\w$]){re.escape(token)}\(", task) is not None


def task_words(task: str) -> tuple[list[str], list[str], list[str]]:
    """Dotted names, words that look like code, and other words of four letters or more, in order, each once."""
    dotted, code, words = [], [], []
    for token in dict.fromkeys(_TOKEN.findall(task)):
        if "." in token or ":" in token:
            dotted.append(token)
        elif looks_like_code(token, task):
            code.append(token)
        elif len(token) >= 4 and token.lower() not in text.STOP_WORDS:
            words.append(token)
    return dotted, code, words


def best_of_name(symbols: DataFrame, ranks: DataFrame, per: str, most: int) -> DataFrame:
    """The ``most`` best rows of each ``per``: types first, then by rank, then by id."""
    ranked = symbols.join(ranks.select("id", "rank"), "id", "left")
    order = [F.col("kind").isin(*TYPE_KINDS).desc(), F.coalesce("rank", F.lit(0.0)).desc(), "id"]
    return first_of_each(ranked, per, order, most)


def seeds_from_task(symbols: DataFrame, ranks: DataFrame, task: str, limit: int = SEEDS) -> tuple[list[int], list[int]]:
    """Ids that the task names (dotted names, names that look like code), and those that its other words lead to by search.

    A dotted name is a qualified name, or else the end of one. A name that looks
    like code and isn't declared is searched for like other words. A word counts
    only if the first hit's name begins with it; each word gives one symbol.
    """
    spark = symbols.sparkSession
    order = {t: k for k, t in enumerate(dict.fromkeys(_TOKEN.findall(task)))}
    dotted, code, words = task_words(task)
    named: list[int] = []
    if dotted or code:
        asked = spark.createDataFrame([(order[t], t, re.split(r"[.:]+", t)[-1], t in dotted) for t in (*dotted, *code)], "ord int, token string, last string, dotted boolean")
        asked = F.broadcast(asked)  # the task's words
        some = symbols.select("id", "name", "qualified_name", "kind")
        exact = some.join(asked.filter("dotted"), F.col("qualified_name") == F.col("token")).withColumn("rule", F.lit(1))
        by_end = some.join(asked, F.col("name") == F.col("last")).filter(~F.col("dotted") | (F.col("qualified_name") == F.col("token")) | F.col("qualified_name").endswith(F.concat(F.lit("."), F.col("token"))) | F.col("qualified_name").endswith(F.concat(F.lit(":"), F.col("token")))).withColumn("rule", F.lit(2))
        found = cut(exact.unionByName(by_end))
        first = found.groupBy("ord").agg(F.min("rule").alias("rule"))
        rows = best_of_name(found.join(F.broadcast(first), ["ord", "rule"]), ranks, "ord", SAME_NAME).orderBy("ord", "place").select("ord", "id").collect()
        hit = {r["ord"] for r in rows}
        words = sorted([*words, *(t for t in code if order[t] not in hit)], key=order.get)
        named = list(dict.fromkeys(r["id"] for r in rows))[:limit]
    related: list[int] = []
    if words:
        some = symbols.filter(~F.col("kind").isin("namespace", "module"))
        hits = search.best_by_prefix(symbols, some, words, WORD_HITS + len(named)).filter(~F.col("id").isin(named) if named else F.lit(True))
        five = first_of_each(hits, "q", ["place"], WORD_HITS, "hit").drop("place")
        leading = five.filter("hit = 1").filter(F.lower("name").startswith(F.col("q"))).select("q")
        rows = best_of_name(five.join(leading, "q", "left_semi"), ranks, "q", 1).select("q", "id").collect()
        by_word = {r["q"]: r["id"] for r in rows}
        for w in words:
            if w.lower() in by_word and by_word[w.lower()] not in related:
                related.append(by_word[w.lower()])
    return named, related[:limit]


def source_blocks(found: DataFrame, files: DataFrame, symbols: DataFrame, max_lines: int = LINES) -> DataFrame:
    """``id, qualified_name, path, start_line, end_line, source, shown``: every overload and part; of types that are too long the members instead.

    ``shown``: ``whole``, ``members`` (the signature and a line for each
    member) or ``start`` (the first ``max_lines`` lines).
    """
    body = found.dropDuplicates(["path", "start_line"]).join(files.select("path", "content"), "path")
    n = F.col("end_line") - F.col("start_line") + 1
    listed = symbols.filter("parent_id is not null").join(found.select(F.col("id").alias("parent_id")), "parent_id", "left_semi")
    line = F.concat(F.lit("  "), text.line_range(F.col("start_line"), F.col("end_line")), F.lit(" "), F.col("kind"), F.lit(" "), F.col("name"), F.lit(": "), F.col("signature"))
    members = listed.groupBy(F.col("parent_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "id", line.alias("line")))), lambda x: x["line"]), "\n").alias("members"))
    joined = body.join(members, "id", "left")
    shown = F.when(n <= max_lines, "whole").when(F.col("members").isNotNull(), "members").otherwise("start")
    slice_ = lambda last: text.line_slice(F.col("content"), F.col("start_line"), last)
    source = F.when(shown == "whole", slice_(F.col("end_line"))).when(shown == "members", F.concat_ws("\n", "signature", "members")).otherwise(slice_(F.col("start_line") + max_lines - 1))
    return joined.select("id", "qualified_name", "path", "start_line", "end_line", source.alias("source"), shown.alias("shown"))


def callees(symbols: DataFrame, uses: DataFrame, ids: DataFrame, most: int = CALLEES) -> tuple[DataFrame, DataFrame]:
    """What the symbols and all inside them call outside themselves (the first ``most``), and the names of calls that aren't linked (``EXTERNAL``)."""
    scope = cut(graph.descendants(symbols, ids).select("id"))
    calls = uses.filter("type = 'calls'").join(scope.select(F.col("id").alias("from_id")), "from_id", "left_semi")
    inside = calls.filter("to_id is not null").select(F.col("to_id").alias("id")).distinct().join(scope, "id", "left_anti").join(symbols, "id")
    names = calls.filter("to_id is null").select("name").distinct().orderBy("name").limit(EXTERNAL)
    return inside.orderBy("path", "start_line", "id").limit(most), names


@dataclass
class References:
    """``uses`` (path, line, type, caller, text), ``code`` of callers, ``other`` lines with the name, ``more`` of them per file, ``callers`` by level, ``unlinked`` calls, and whether the callers were cut off."""

    uses: DataFrame
    code: DataFrame
    other: DataFrame
    more: DataFrame
    callers: DataFrame
    unlinked: DataFrame
    truncated: bool


def of_constructor(symbols: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with constructors (methods named like their type, ``__init__``, ``constructor``) replaced by their types."""
    owner = symbols.select(F.col("id").alias("parent_id"), F.col("name").alias("__owner"))
    makes = (F.col("kind") == "method") & ((F.col("name") == F.col("__owner")) | F.col("name").isin("__init__", "constructor"))
    ids = found.join(owner, "parent_id", "left").select(F.when(makes, F.col("parent_id")).otherwise(F.col("id")).alias("id")).distinct()
    return symbols.join(ids, "id", "left_semi")


def seeing_files(symbols: DataFrame, imports: DataFrame, files: DataFrame, where: DataFrame) -> DataFrame:
    """``(path)``: files that can see declarations in the files ``where (path)``; ``imports`` resolved, ``files (path, module)``."""
    hit = imports.join(files.select(F.col("module").alias("target_module"), F.col("path").alias("target")), "target_module").select(F.col("path").alias("file"), "target", "kind")
    spaces = symbols.filter("kind = 'namespace'").select(F.col("path").alias("file"), F.col("qualified_name").alias("namespace")).distinct()
    used = imports.filter("kind in ('using', 'wildcard')").select(F.col("path").alias("file"), F.col("target_module").alias("namespace"), F.coalesce("is_global", F.lit(False)).alias("is_global"))
    found = visibility.files_seeing(where.select(F.col("path").alias("id")).distinct(), hit.filter("kind in ('reexport', 'wildcard')").select("file", "target"), hit.select("file", "target"), spaces, used, files.select(F.col("path").alias("id"), F.lit("").alias("project")))
    return found.select(F.col("id").alias("path"))


def references(symbols: DataFrame, uses: DataFrame, contents: DataFrame, found: DataFrame, seeing: DataFrame, inherits: DataFrame, depth: int = 2) -> References:
    """All that is known of where a symbol is used.

    ``contents (path, content)``; ``seeing (path)``: files that can see the
    symbol; ``inherits (src, dst)``. Callers are followed through the base
    declarations that the methods override. Calls that couldn't be linked are
    counted for the symbol itself (all of its name in files that see it) and
    for callers outside tests (those on the result of a call).
    """
    target = cut(of_constructor(symbols, found).select("id", "name", "qualified_name", "kind", "path", "start_line", "end_line"))
    ids = target.select("id")
    callers = symbols.select(F.col("id").alias("from_id"), F.col("qualified_name").alias("caller"), F.col("start_line").alias("from_start"), F.col("end_line").alias("from_end"))
    linked = cut(uses.join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi").join(callers, "from_id", "left"))
    lines = contents.join(linked.select("path"), "path", "left_semi").select("path", F.split("content", "\r?\n").alias("lines"))
    at = linked.join(lines, "path")
    line = text.truncate(F.trim(F.try_element_at("lines", F.col("line"))), 160)
    used = at.select("path", "line", "type", "caller", line.alias("text")).dropDuplicates(["path", "line"]).orderBy("path", "line").limit(REFERENCES)

    first = Window.partitionBy("from_id").orderBy("path", "line")
    outside = at.filter("from_id is not null").join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_anti").withColumn("k", F.row_number().over(first))
    chosen = outside.filter("k = 1").orderBy("path", "line").limit(CALLERS).select("from_id")
    short = F.col("from_end") - F.col("from_start") + 1 <= SHORT_CALLER
    low, high = F.when(short, F.col("from_start")).otherwise(F.greatest(F.col("from_start"), F.col("line") - AROUND)), F.when(short, F.col("from_end")).otherwise(F.least(F.col("from_end"), F.col("line") + AROUND))
    pieces = outside.join(chosen, "from_id", "left_semi").filter((F.col("k") == 1) | (~short & (F.col("k") <= 2))).withColumn("low", low).withColumn("high", high)
    spent = F.sum(F.col("high") - F.col("low") + 1).over(Window.partitionBy(F.lit(1)).orderBy("path", "low").rowsBetween(Window.unboundedPreceding, -1))  # a few rows
    code = pieces.withColumn("spent", F.coalesce(spent, F.lit(0))).filter(F.col("spent") < CODE_LINES).select("path", "caller", "low", "high", F.array_join(F.slice("lines", F.col("low"), F.col("high") - F.col("low") + 1), "\n").alias("source"))

    near = contents.join(seeing.union(target.select("path")).union(linked.select("path")).distinct(), "path", "left_semi")
    names = [r["name"] for r in target.select("name").distinct().orderBy("name").limit(NAMES).collect()]
    matches = None
    for name in names:
        rows = search.lines_matching(near, "path", "content", name)
        matches = rows if matches is None else matches.union(rows)
    matches = near.select("path", F.lit(0).alias("line"), F.col("content").alias("text")).limit(0) if matches is None else matches
    declared = target.select("path", F.col("start_line").alias("low"), F.col("end_line").alias("high"))
    skipped = matches.join(declared, "path").filter(F.col("line").between(F.col("low"), F.col("high"))).groupBy("path", "low", "high").agg(F.min("line").alias("line")).select("path", "line")
    rest = cut(matches.join(linked.select("path", "line"), ["path", "line"], "left_anti").join(skipped, ["path", "line"], "left_anti").select("path", "line", text.truncate(F.trim("text"), 160).alias("text")).distinct())
    shown = cut(rest.orderBy("path", "line").limit(MATCHES))
    more = rest.join(shown.select("path", "line"), ["path", "line"], "left_anti").groupBy("path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path").limit(MATCH_FILES)

    calls = uses.filter("type = 'calls' and to_id is not null and from_id is not null").select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))
    wide = visibility.overridden(symbols.filter("kind = 'method' and parent_id is not null"), inherits)
    reached, truncated = graph.blast_radius(ids, calls, depth, BLAST, wide)
    placed = cut(reached.join(symbols.select("id", "qualified_name", "name", "path", "start_line"), "id").withColumn("test", paths.is_test(F.col("path"))))
    own = visibility.unlinked_calls(uses, target.select("name").distinct(), seeing.select(F.col("path").alias("id"))).withColumn("target", F.lit(True))
    asked = placed.filter("not test").dropDuplicates(["qualified_name"]).orderBy("level", "path", "start_line").limit(UNLINKED_SYMBOLS).select("name").distinct()
    theirs = visibility.unlinked_calls(uses.filter(~paths.is_test(F.col("path"))), asked.join(target.select("name"), "name", "left_anti"), contents.select(F.col("path").alias("id")), True).withColumn("target", F.lit(False))
    return References(used, code, shown, more, placed, own.union(theirs), truncated)


def blast_groups(callers: DataFrame, per_level: int = PER_LEVEL, tests: int = TESTS) -> tuple[DataFrame, DataFrame]:
    """Callers per level (``level, n, names`` of the first ones) and the tests among them per file (``path, n, names``)."""
    order = ["path", "start_line", "id"]

    def grouped(some: DataFrame, by: str, name: str, most: int) -> DataFrame:
        first = first_of_each(some, by, order, most).groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.col(name).alias("name")))), lambda x: x["name"]), ", ").alias("names"))
        return some.groupBy(by).agg(F.count("*").alias("n")).join(first, by).orderBy(by)

    return grouped(callers.filter("not test"), "level", "qualified_name", per_level), grouped(callers.filter("test"), "path", "name", tests).limit(tests)


def starter_examples(symbols: DataFrame, uses: DataFrame, files: DataFrame) -> DataFrame:
    """One row: the ``type`` used most (uses of its members count for it), the ``method`` called most, the ``caller`` of the most others, the largest ``file``.

    ``uses (src, dst)``; ties go to the lesser id or path; null where there is none.
    """
    kinds = symbols.select(F.col("id").alias("dst"), "kind", "parent_id")
    used = uses.join(kinds, "dst")
    of_type = used.select(F.when(F.col("kind").isin(*TYPE_KINDS), F.col("dst")).otherwise(F.col("parent_id")).alias("id")).join(symbols.filter(F.col("kind").isin(*TYPE_KINDS)).select("id"), "id", "left_semi")
    callable_ = F.col("kind").isin("function", "method")
    best = lambda df, by: df.groupBy("id").agg(by.alias("n")).agg(F.max_by("id", F.struct("n", -F.col("id"))).alias("id"))
    name = lambda row, out: row.join(symbols.select("id", F.col("name").alias(out)), "id", "left").select(out)
    rows = [
        name(best(of_type, F.count("*")), "type"), name(best(used.filter(callable_).select(F.col("dst").alias("id")), F.count("*")), "method"),
        name(best(uses.select(F.col("src").alias("id"), "dst"), F.countDistinct("dst")), "caller"), files.agg(F.min_by("path", F.struct(-F.col("chars"), "path")).alias("file")),
    ]
    out = rows[0]
    for row in rows[1:]:
        out = out.crossJoin(F.broadcast(row))  # one row each
    return out
