"""Budgeted packing: repo map, outlines and context for a request.

Candidates are ranked and cut to a few hundred rows by Spark; the greedy choice
under a budget is sequential and runs on those rows alone.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .graph import closure, kept
from .search import drop_copies
from .state import cut
from .visibility import nested_in_function

#: Fixed values of the packing rules.
LEVEL_VALUE = (0.0, 0.1, 0.4, 0.6, 1.0)
CANDIDATES, HEADROOM, SEED_SHARE, TEST_WEIGHT, DOC, OVERHEAD, OUTLINE = 400, 0.1, 0.6, 0.5, 400, 8, 8000
KIND_WEIGHT = {"class": 1.0, "interface": 1.0, "enum": 1.0, "type": 1.0, "function": 0.9, "method": 0.9, "property": 0.5, "field": 0.5}
TYPES = ("class", "interface", "enum", "type")
KIND_ORDER = ("class", "interface", "enum", "type", "function", "method", "property", "field")


def expand(seeds: DataFrame, related: DataFrame | None, symbols: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """``(id, hops)``: seeds, what they use and what uses them, members of types; ``related`` ids come in at hop 1."""
    types = symbols.filter(F.col("kind").isin(*TYPES)).select(F.col("id").alias("src"))
    members = symbols.filter("parent_id is not null").select(F.col("parent_id").alias("src"), F.col("id").alias("dst")).join(types, "src", "left_semi")
    both = kept(edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).union(members))
    seen = frontier = cut(seeds.select("id").distinct().withColumn("hops", F.lit(0)))
    for hop in range(1, hops + 1):
        found = frontier.join(both, F.col("id") == F.col("src")).select(F.col("dst").alias("id"))
        if hop == 1 and related is not None:
            found = found.union(related.select("id"))
        frontier = cut(found.distinct().join(seen, "id", "left_anti").withColumn("hops", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen


def candidates(symbols: DataFrame, seeds: DataFrame, edges: DataFrame, ranks: DataFrame, hops: int = 2, tests: bool = False, related: DataFrame | None = None) -> DataFrame:
    """The best ``CANDIDATES`` symbols around ``seeds (id)`` with ``hops`` and ``score``; copies, namespaces and what a function encloses are left out."""
    near = expand(seeds, related, symbols, edges, hops)
    top = ranks.agg(F.max("rank")).first()[0] or 1.0
    kind = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in KIND_WEIGHT.items() for x in kv)), F.col("kind")), F.lit(0.3))
    joined = symbols.filter(~F.col("kind").isin("namespace", "module")).join(near, "id").join(nested_in_function(symbols, near), "id", "left_anti").join(ranks.select("id", "rank"), "id", "left").withColumn("rank", F.coalesce("rank", F.lit(0.0)))
    test = F.when(F.col("test") & F.lit(not tests), F.lit(TEST_WEIGHT)).otherwise(F.lit(1.0))
    score = F.pow(F.lit(0.5), "hops") * (0.7 + 0.3 * F.col("rank") / F.lit(float(top))) * kind * test
    return drop_copies(joined.withColumn("score", score), ["qualified_name", "signature"], [F.desc("score"), "hops", "id"], CANDIDATES)


def described(symbols: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` with the sizes that packing needs, and the enclosing declarations of each (``id``, ``above``: nearest first, no namespaces)."""
    size = lambda level: text.utf16_length(text.entry_header(F.col("kind"), F.col("name"), F.col("signature"), F.col("start_line"), F.col("end_line"), F.lit(level)))
    sized = lambda df: df.withColumn("h1", size(1)).withColumn("h2", size(2)).withColumn("d", F.when(F.col("doc") != "", text.utf16_length(text.entry_doc(F.col("doc")))))
    has = symbols.filter("parent_id is not null").select(F.col("parent_id").alias("id")).distinct().withColumn("__has", F.lit(True))
    out = sized(rows).join(has, "id", "left").withColumn("members", F.col("kind").isin(*TYPES) & F.coalesce("__has", F.lit(False))).drop("__has")
    up = closure(symbols.filter("parent_id is not null").select(F.col("id").alias("src"), F.col("parent_id").alias("dst")), sources=rows)
    above = sized(symbols.filter(~F.col("kind").isin("namespace", "module"))).select(F.col("id").alias("dst"), "parent_id", "path", "start_line", "h1").join(up, "dst")
    return out, above.select(F.col("src").alias("id"), "depth", F.struct(F.col("dst").alias("id"), "path", "start_line", "h1").alias("above"))


def cost(row: dict, level: int) -> int:
    """Tokens of a symbol: 1 kind and name, 2 signature, 3 signature and doc, 4 body under its name."""
    if level == 0:
        return 0
    chars = (row["h2"] if level in (2, 3) else row["h1"]) + OVERHEAD
    if level == 3:
        chars += row["d"] + OVERHEAD
    if level == 4:
        chars += row["chars"] + OVERHEAD
    return math.ceil(chars / 4)


def pack(rows: list[dict], seeds: set, budget: int, above: dict | None = None) -> list[dict]:
    """Greedy choice of a level for each candidate: seeds first, then the best gain per token.

    ``rows`` come in score order with ``id, path, start_line, h1, h2, d, chars,
    members, hops, score``; ``above``: for an id the enclosing declarations,
    nearest first. What is shown brings those with it, by name at least, and its
    path's line; both are charged, and gained if they are candidates.
    """
    limit, above, by_id = math.floor((1 - HEADROOM) * budget), above or {}, {r["id"]: r for r in rows}
    levels, paths, spent, in_seeds = {}, set(), 0, 0

    def hidden(r: dict) -> list[dict]:
        out = []
        for x in above.get(r["id"], ()) if r["id"] not in levels else ():
            if x["id"] in levels:
                break
            out.append(x)
        return out

    def raised(r: dict, level: int) -> tuple[int, float]:
        now, more = levels.get(r["id"], 0), hidden(r)
        value = r["score"] * (LEVEL_VALUE[level] - LEVEL_VALUE[now]) + sum(by_id[x["id"]]["score"] * LEVEL_VALUE[1] for x in more if x["id"] in by_id)
        line = 0 if now or r["path"] in paths else math.ceil((len(r["path"]) + 1) / 4)
        return cost(r, level) - cost(r, now) + line + sum(cost(x, 1) for x in more), value

    def allowed(r: dict) -> list[int]:
        most = 3 if r.get("members") or r["hops"] >= 2 else 4
        return [k for k in range(levels.get(r["id"], 0) + 1, most + 1) if k != 3 or r["d"]]

    def show(r: dict, level: int) -> None:
        for x in hidden(r):
            levels[x["id"]] = 1
        paths.add(r["path"])
        levels[r["id"]] = level

    for r in rows:
        for level in reversed(allowed(r)) if r["id"] in seeds else ():
            more, _ = raised(r, level)
            if spent + more <= limit and in_seeds + more <= SEED_SHARE * budget:
                show(r, level)
                spent, in_seeds = spent + more, in_seeds + more
                break
    while True:
        best = None
        for r in rows:
            for level in allowed(r):
                more, gain = raised(r, level)
                if gain > 0 and spent + more <= limit and (best is None or gain / max(more, 1) > best[0]):
                    best = (gain / max(more, 1), r, level, more)
        if best is None:
            break
        show(best[1], best[2])
        spent += best[3]
    others = {x["id"]: x for some in above.values() for x in some}
    chosen = [by_id.get(k, others.get(k)) | {"level": level, "seed": k in seeds} for k, level in levels.items()]
    return sorted(chosen, key=lambda r: (r["path"], r["start_line"], r["id"]))


def context(symbols: DataFrame, seeds: DataFrame, edges: DataFrame, ranks: DataFrame, budget: int = 1500, hops: int = 2, related: DataFrame | None = None, tests: bool = False) -> DataFrame:
    """Packed entries ``(id, path, start_line, level, hops, seed)`` of a request; what only encloses others has no hops."""
    spark = symbols.sparkSession
    chosen = cut(candidates(symbols, seeds, edges, ranks, hops, tests, related))
    sized, above = described(symbols, chosen)
    names = ("id", "path", "start_line", "h1", "h2", "d", "chars", "members", "hops", "score")
    rows = [r.asDict() for r in sized.select(*names).orderBy(F.desc("score"), "hops", "id").limit(CANDIDATES).collect()]
    over: dict[int, list] = {}
    for r in above.orderBy("id", "depth").collect():  # those of at most CANDIDATES rows
        over.setdefault(r["id"], []).append(r["above"].asDict())
    asked = {r["id"] for r in rows if r["hops"] == 0}
    packed = pack(rows, asked, max(500, min(budget, 3000)), over)
    return spark.createDataFrame([(r["id"], r["path"], r["start_line"], r["level"], r.get("hops"), r["seed"]) for r in packed], "id long, path string, start_line int, level int, hops int, seed boolean")


def with_text(entries: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """``entries (id, level)`` of a context with their ``text``, in the order of files and lines; ``files (path, content)``.

    A line tells the entry's lines and name (its signature at levels 2 and 3),
    the next one its doc at level 3, and at level 4 its code follows, without
    the indent that its lines share. All stand as deep as entries enclose them.
    """
    own = entries.select("id", "level").join(symbols.select("id", "parent_id", "path", "kind", "name", "signature", "doc", "start_line", "end_line"), "id")
    shown = cut(own)
    inside = shown.filter("parent_id is not null").select(F.col("id").alias("src"), F.col("parent_id").alias("dst")).join(shown.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")
    above = closure(inside).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    bodies = shown.filter("level = 4").join(files.select("path", "content"), "path", "left").select("id", F.when(F.col("content").isNull(), F.lit("(file no longer exists)")).otherwise(text.reindent(text.line_slice(F.col("content"), F.col("start_line"), F.col("end_line")))).alias("body"))
    placed = shown.join(above, "id", "left").join(bodies, "id", "left")
    indent = F.repeat(F.lit("  "), F.coalesce("n", F.lit(0)).cast("int") + 1)
    header = text.entry_header(F.col("kind"), F.col("name"), F.col("signature"), F.col("start_line"), F.col("end_line"), F.col("level"))
    under = F.when(F.col("level") == 3, text.entry_doc(F.col("doc"))).when(F.col("level") == 4, F.col("body"))
    lines = F.concat(F.array(F.concat(indent, header)), F.transform(F.split(F.coalesce(under, F.lit("")), "\n"), lambda x: F.concat(indent, F.lit("  "), x)))
    shown_lines = F.when(under.isNull(), F.slice(lines, 1, 1)).otherwise(lines)
    return placed.select("id", "path", "start_line", "level", F.array_join(shown_lines, "\n").alias("text")).orderBy("path", "start_line", "id")


def repo_map(symbols: DataFrame, ranks: DataFrame, tokens: int = 1000, folder: str = "") -> DataFrame:
    """Symbols by rank until the budget is spent, in order of choice.

    Namespaces and modules are left out. The first one that doesn't fit ends the
    map, unless it is the first of all.
    """
    some = symbols.filter(~F.col("kind").isin("namespace", "module") & (F.lit(not folder) | F.col("path").eqNullSafe(folder) | F.col("path").startswith(folder.rstrip("/") + "/")))
    order = [F.desc("rank"), F.coalesce(F.array_position(F.array(*map(F.lit, KIND_ORDER)), F.col("kind")), F.lit(99)), F.desc("exported"), "qualified_name", "id"]
    most = tokens * 4
    ranked = some.join(ranks, "id").withColumn("size", F.length("signature") + OVERHEAD).orderBy(*order).limit(most // OVERHEAD + 1)  # no symbol takes less
    w = Window.partitionBy(F.lit(1)).orderBy(*order)
    placed = ranked.withColumn("spent", F.sum("size").over(w)).withColumn("place", F.row_number().over(w))
    return placed.filter((F.col("spent") <= most) | (F.col("place") == 1)).drop("size")


def outline(symbols: DataFrame, path: str) -> DataFrame:
    """A file's symbols as lines: signatures if they fit, else names, else types with their member counts."""
    own = symbols.filter(F.col("path") == path)
    full, short = own.agg(F.sum(F.length("signature") + OVERHEAD), F.sum(F.length("name") + OVERHEAD)).first()
    if (full or 0) <= OUTLINE:
        line = own.withColumn("line", F.col("signature"))
    elif short <= OUTLINE:
        line = own.withColumn("line", F.col("name"))
    else:
        members = own.groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("n"))
        line = own.filter(F.col("kind").isin("class", "interface", "enum")).join(members, "id", "left").withColumn("line", F.concat("name", F.lit(" ("), F.coalesce("n", F.lit(0)).cast("string"), F.lit(")"))).drop("n")
    return line.select("id", "start_line", "end_line", "line").orderBy("start_line", "id")
