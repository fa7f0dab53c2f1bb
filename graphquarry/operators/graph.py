"""Graph operators on edge lists.

Edges are DataFrames with ``src`` and ``dst``. All searches are
level-synchronous: a join makes the next level, an anti-join drops what was
seen, and each level is checkpointed, so cycles end and plans stay short.
"""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .state import ROW_BYTES, SMALL, Seen, bucketed, cut, dealt, drop_bucketed, drop_cut, if_few, if_small, parts_for


def _levels(depth: int | None):
    return itertools.count(1) if depth is None else range(1, depth + 1)


def kept(edges: DataFrame, *more: str) -> DataFrame:
    """``edges`` written once, without repeats, in buckets of ``src``: searches read them in every level and don't move them."""
    return _kept(edges.select("src", "dst", *more), "src")


def _kept(edges: DataFrame, key: str) -> DataFrame:
    parts = parts_for(edges)
    return bucketed(dealt(edges, key, parts=parts).distinct(), key, parts)


def bfs(seeds: DataFrame, edges: DataFrame, depth: int | None = None) -> DataFrame:
    """``(id, level)``: what ``seeds`` (``id``) reach in at most ``depth`` steps (none: in any number), at the first level."""
    edges = kept(edges)
    frontier = cut(seeds.select("id").distinct().withColumn("level", F.lit(0)))
    seen = Seen(frontier)
    for level in _levels(depth):
        nxt = frontier.join(edges, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct().join(seen.all(), "id", "left_anti").withColumn("level", F.lit(level))
        found = cut(nxt)
        if found.isEmpty():
            drop_cut(found)
            break
        frontier = seen.add(found).filter(F.col("level") == level)
    drop_bucketed(edges)
    return seen.all()


def closure(edges: DataFrame, depth: int | None = None, sources: DataFrame | None = None) -> DataFrame:
    """``(src, dst, depth)``: all pairs connected in at most ``depth`` steps (none: in any number), with the fewest; those from ``sources`` (``id``) only, if given."""
    edges = kept(edges.filter("src <> dst"))
    first = edges if sources is None else edges.join(if_small(sources.select(F.col("id").alias("src"))), "src", "left_semi")
    frontier = cut(first.withColumn("depth", F.lit(1)))
    seen = Seen(frontier)
    step = edges.select(F.col("src").alias("by"), F.col("dst").alias("far"))
    for level in _levels(None if depth is None else depth - 1):
        level += 1
        nxt = frontier.join(step, F.col("dst") == F.col("by")).select("src", F.col("far").alias("dst")).filter("src <> dst").distinct().join(seen.all(), ["src", "dst"], "left_anti").withColumn("depth", F.lit(level))
        found = cut(nxt)
        if found.isEmpty():
            drop_cut(found)
            break
        frontier = seen.add(found).filter(F.col("depth") == level)
    drop_bucketed(edges)
    return seen.all()


def weighted(uses: DataFrame) -> DataFrame:
    """Uses per pair, without self-edges: ``(src, dst, n)``."""
    uses = uses.filter("src <> dst")
    parts = parts_for(uses)
    return (uses if parts is None else dealt(uses, "src", "dst", parts=parts)).groupBy("src", "dst").agg(F.count("*").alias("n"))


def uses_with_lines(uses: DataFrame) -> DataFrame:
    """Multiplicity of each pair and its distinct lines in order: ``(src, dst, n, lines)``."""
    return uses.groupBy("src", "dst").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("line")).alias("lines"))


def neighbours(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, other)``: each node of ``ids`` with its neighbours in both directions."""
    out = edges.join(ids, F.col("id") == F.col("src"), "left_semi").select(F.col("src").alias("id"), F.col("dst").alias("other"))
    back = edges.join(ids, F.col("id") == F.col("dst"), "left_semi").select(F.col("dst").alias("id"), F.col("src").alias("other"))
    return out.union(back).distinct()


#: Sources with more than 1/(HUB_SHARE * P) of the edges are hubs, so there are few of them; rounds that one job takes.
HUB_SHARE, AT_ONCE = 4, 10


class Ranking:
    """The tables of a rank computation, in buckets of a node's id.

    ``shares (src, dst, share)`` lie in the buckets of ``src``, ``ranks (id,
    rank)`` in those of ``id``, as many as the session has shuffle partitions, or more if
    there are many edges (:func:`parts_for`).
    So a round joins ranks with edges where they lie, and moves only partial
    sums, by target: one exchange. Each node has a row to itself without a
    share, which carries its rank over, so no other join is needed. Edges of
    hubs lie apart, dealt evenly, and the few ranks of hubs go to all tasks.

    What lies in nodes without edges is spread evenly over all nodes, which
    multiplies all ranks alike; so it is left out, and the ranks are scaled to
    one at the end.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame, damping: float):
        spark, self.damping = nodes.sparkSession, damping
        ids = cut(nodes.select(F.col("id").cast("long").alias("id")).filter("id is not null").distinct())
        known = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "n").filter("src <> dst and n > 0")
        self.count = ids.count()
        few_ids, many = if_few(ids, self.count), None if self.count * ROW_BYTES <= SMALL else parts_for(known)
        spread = lambda df, *by: df if many is None else dealt(df, *by, parts=many)
        for end in ("src", "dst"):  # ids are distinct; a semi join would be pushed below what spreads its rows
            known = spread(known, end).join(few_ids.withColumnRenamed("id", end), end)
        known = spread(known, "src", "dst")  # as they lay before the joins
        held = cut(known.groupBy("src", "dst").agg(F.sqrt(F.sum("n")).alias("w")))
        parts = parts_for(held) or int(spark.conf.get("spark.sql.shuffle.partitions"))
        out = cut(held.groupBy("src").agg(F.sum("w").alias("out"), F.count("*").alias("n")))
        self.hubs = cut(out.join(F.broadcast(out.agg(F.sum("n").alias("all"))), F.col("n") * HUB_SHARE * parts > F.col("all")).select("src"))
        self.has_hubs = not self.hubs.isEmpty()
        shares = held.join(out.select("src", "out"), "src").select("src", "dst", (F.col("w") / F.col("out")).alias("share"))
        few = F.broadcast(self.hubs)
        own = ids.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(None).cast("double").alias("share"))
        tables = [bucketed(shares.join(few, "src", "left_anti").union(own).repartition(parts, "src"), "src", parts), bucketed(ids.select("id", F.lit(1.0 / max(self.count, 1)).alias("rank")).repartition(parts, "id"), "id", parts)]
        self.hub_shares = cut(shares.join(few, "src", "left_semi"))
        drop_cut(ids, held, out)
        # a session of its own: a job of many equal rounds has nothing that would be planned anew on the way
        self.side = spark.newSession()
        self.side.conf.set("spark.sql.shuffle.partitions", str(parts))
        self.parts = parts
        self.side.conf.set("spark.sql.adaptive.enabled", "false")
        self.side.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        self.shares, self.first = (self.inside(t) for t in tables)

    def inside(self, table: DataFrame) -> DataFrame:
        out = self.side.table(table.stored_as)
        out.stored_as = table.stored_as
        return out

    def next(self, ranks: DataFrame) -> tuple[DataFrame, Observation]:
        """The ranks after a round, and how much they moved in all, which is summed as they are made."""
        parts = lambda df: df.select("dst", (F.col("rank") * F.col("share")).alias("flow"), F.when(F.col("share").isNull(), F.col("rank")).alias("was"))
        flow = parts(self.shares.join(ranks.withColumnRenamed("id", "src"), "src"))
        if self.has_hubs:
            hubs, edges = (self.side.read.schema(t.schema).parquet(t.stored_at) for t in (self.hubs, self.hub_shares))
            few = F.broadcast(ranks.withColumnRenamed("id", "src").join(F.broadcast(hubs), "src", "left_semi"))
            flow = flow.union(parts(edges.join(few, "src")))
        into = flow.groupBy(F.col("dst").alias("id")).agg(F.sum("flow").alias("flow"), F.max("was").alias("was"))
        new = (F.lit((1 - self.damping) / max(self.count, 1)) + F.lit(self.damping) * F.coalesce("flow", F.lit(0.0))).alias("rank")
        moved = Observation()
        return into.select("id", new, "was").observe(moved, F.sum(F.abs(F.col("rank") - F.col("was"))).alias("moved"), F.sum("rank").alias("all")).drop("was"), moved

    def drop(self, ranks: DataFrame) -> None:
        drop_bucketed(ranks, self.shares)
        drop_cut(self.hubs, self.hub_shares)


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-9, at_once: int = AT_ONCE) -> DataFrame:
    """``(id, rank)`` by weights ``sqrt(n)`` of ``edges (src, dst, n)``.

    Self-edges and edges with unknown ends are dropped, ``n`` of repeated pairs
    is added up, dangling mass is spread evenly. A job takes ``at_once`` rounds
    and measures each; it ends after the job in which a round moved ranks by
    less than ``tolerance`` in all, or after ``rounds``. Ids are numbers.
    """
    work = Ranking(nodes, edges, damping)
    ranks, left = work.first, rounds if work.count else 0
    while left > 0:
        new, seen = ranks, []
        for _ in range(1 if work.has_hubs else min(at_once, left)):  # hubs' ranks are read apart, so each round is written
            new, moved = work.next(new)
            seen.append(moved)
        written = bucketed(new, "id", work.parts)
        drop_bucketed(ranks)
        ranks, left = written, left - len(seen)
        if any(o.get["moved"] < tolerance * o.get["all"] for o in seen):
            break
    out = cut(nodes.sparkSession.table(ranks.stored_as))
    work.drop(ranks)
    total = out.agg(F.sum("rank")).first()[0] or 1.0
    return out.select("id", (F.col("rank") / F.lit(total)).alias("rank"))


def blast_radius(targets: DataFrame, calls: DataFrame, depth: int | None = 3, most: int | None = 500, overridden: DataFrame | None = None, order: tuple[Column | str, ...] = ("id",)) -> tuple[DataFrame, bool]:
    """Transitive callers ``(id, level)`` of ``targets`` and whether the cap cut them off.

    Each level is first widened by ``overridden (id, base)``: whoever calls a
    base declaration may reach the method. Callers appear once, at the first
    level; the level that exceeds ``most`` (none: no cap) is cut in ``order``.
    """
    calls = _kept(calls.select("src", "dst"), "dst")
    overridden = None if overridden is None else cut(overridden.select("id", "base").distinct())
    frontier = cut(targets.select("id").distinct().withColumn("level", F.lit(0)))
    seen, left, last = Seen(frontier), most, None
    for level in _levels(depth):
        wide = frontier.select("id")
        if overridden is not None:
            wide = wide.union(overridden.join(wide, "id").select(F.col("base").alias("id"))).distinct()
        callers = cut(calls.join(wide.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id")).distinct().join(seen.all(), "id", "left_anti").withColumn("level", F.lit(level)))
        n = callers.count() if left is not None else int(not callers.isEmpty())
        if left is not None and n > left:
            last = callers.orderBy(*order).limit(left)
            break
        if not n:
            drop_cut(callers)
            break
        left = None if left is None else left - n
        frontier = seen.add(callers).filter(F.col("level") == level)
    drop_bucketed(calls)
    found = seen.all().filter("level > 0")
    return (found if last is None else found.unionByName(last)), last is not None


def descendants(symbols: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """``(id, level)``: ``roots`` and all that is declared inside them, by ``parent_id``."""
    return bfs(roots, symbols.filter("parent_id is not null").select(F.col("parent_id").alias("src"), F.col("id").alias("dst")), depth)


def mutual(edges: DataFrame) -> DataFrame:
    """``(a, b)``, a before b: pairs with edges both ways."""
    back = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    return edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).join(back, ["a", "b"], "left_semi").filter("a < b").distinct()


def within_hops(seeds: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """``(id, level)`` for levels 1 to ``hops``: the ends of bounded paths."""
    return bfs(seeds, edges, hops).filter("level > 0")
