"""Large exchanges: partitions follow the bytes that are read, results stay as they are."""

import pytest
from pyspark.sql import functions as F

from graphquarry.operators import graph, pack, state, visibility
from graphquarry.operators.state import cut


@pytest.fixture
def edges(spark, monkeypatch):
    """6,000 edges, each twice; a partition for each 4 KB of their files."""
    monkeypatch.setattr(state, "PART_BYTES", 4 << 10, raising=False)
    rows = spark.range(6000).select((F.xxhash64("id") % 900).alias("src"), (F.xxhash64("id", F.lit(1)) % 900).alias("dst"))
    return cut(rows.union(rows))


def pairs(df):
    return sorted((r["src"], r["dst"]) for r in df.select("src", "dst").distinct().collect())


def test_kept_edges_lie_in_as_many_buckets_as_their_size_asks(spark, edges):
    held = graph.kept(edges)
    said = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {held.stored_as}").collect()}
    assert int(said["Num Buckets"]) >= 12  # the session has 4 shuffle partitions
    assert held.count() == held.distinct().count() and pairs(held) == pairs(edges)
    assert max(r["count"] for r in held.groupBy(F.input_file_name()).count().collect()) < 1200


def test_search_over_many_buckets(spark, edges):
    step = {}
    for a, b in pairs(edges):
        step.setdefault(a, set()).add(b)
    level, seen = {5}, {5: 0}
    for k in (1, 2, 3):
        level = {y for x in level for y in step.get(x, ())} - set(seen)
        seen |= dict.fromkeys(level, k)
    got = graph.bfs(spark.createDataFrame([(5,)], "id long"), edges, 3)
    assert {r["id"]: r["level"] for r in got.collect()} == seen


def test_uses_are_added_up_in_as_many_partitions(spark, edges):
    added = graph.weighted(edges)
    assert added.rdd.getNumPartitions() >= 12
    assert pairs(added) == [x for x in pairs(edges) if x[0] != x[1]] and added.agg(F.sum("n")).first()[0] == edges.filter("src <> dst").count()


def test_ranks_in_as_many_buckets(spark, edges):
    uses, nodes = graph.weighted(edges), spark.range(-900, 900)
    work = graph.Ranking(nodes, uses, 0.85)
    for table in (work.shares, work.first):
        said = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {table.stored_as}").collect()}
        assert int(said["Num Buckets"]) >= 12
    new, moved = work.next(work.first)
    got = {r["id"]: r["rank"] for r in new.collect()}
    out, flow = {}, {k: 0.0 for k in range(-900, 900)}
    rows = [(r["src"], r["dst"], r["n"] ** 0.5) for r in uses.collect()]
    for a, _, w in rows:
        out[a] = out.get(a, 0.0) + w
    for a, b, w in rows:
        flow[b] += w / out[a] / 1800
    assert got == pytest.approx({k: 0.15 / 1800 + 0.85 * x for k, x in flow.items()}, abs=1e-12)
    assert moved.get["all"] == pytest.approx(sum(got.values()))


def test_many_nodes_are_merged_not_broadcast(spark, edges, monkeypatch):
    """150,000 ids are a small file, but a hash table of megabytes in each task."""
    plans, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    uses = graph.weighted(edges)
    for most, name in ((900, "BroadcastHashJoin"), (150_000, "SortMergeJoin")):
        plans.clear()
        work = graph.Ranking(spark.range(-800, most), uses, 0.85)
        joins = {k for k in ("BroadcastHashJoin", "SortMergeJoin") if k in plans[1]}
        assert joins == {name}
        assert pairs(work.shares.filter("share is not null")) == [x for x in pairs(edges) if x[0] != x[1] and min(x) >= -800]
        work.drop(work.first)


def test_closure_from_some_sources(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (7, 3), (4, 4), (None, 1)], "src long, dst long")
    some = spark.createDataFrame([(3,), (7,), (7,), (99,), (None,)], "id long")
    got = sorted(map(tuple, graph.closure(edges, 2, some).collect()))
    assert got == [(3, 1, 1), (3, 2, 2), (3, 4, 1), (7, 1, 2), (7, 3, 1), (7, 4, 2)]
    assert got == sorted(tuple(r) for r in graph.closure(edges, 2).collect() if r["src"] in (3, 7))


def test_context_climbs_from_its_candidates_only(spark, monkeypatch):
    """Of 2,000 methods the request is near to three, one of them inside another; what encloses the others isn't looked up."""
    kind = F.when(F.col("id") < 10, "class").otherwise("method")
    parent = F.when(F.col("id") == 12, 11).when(F.col("id") >= 10, F.col("id") % 10)
    of = lambda x: F.concat(F.lit(x), F.col("id").cast("string"))
    symbols = cut(spark.range(2000).select("id", kind.alias("kind"), of("n").alias("name"), of("q").alias("qualified_name"), of("s").alias("signature"), F.lit(None).cast("string").alias("doc"), F.lit("a.py").alias("path"), F.col("id").cast("int").alias("start_line"), F.col("id").cast("int").alias("end_line"), parent.alias("parent_id"), F.lit(40).cast("long").alias("chars"), F.lit(False).alias("test")))
    uses = cut(spark.createDataFrame([(10, 11, 2), (10, 12, 1), (500, 600, 1)], "src long, dst long, n long"))
    found, closure = [], graph.closure
    for place in (pack, visibility):
        monkeypatch.setattr(place, "closure", lambda *a, **b: found.append(closure(*a, **b)) or found[-1])
    out = pack.context(symbols, spark.createDataFrame([(10,)], "id long"), uses, uses.select(F.col("dst").alias("id"), F.col("n").cast("double").alias("rank")), hops=1)
    rows = {r["id"]: (r["hops"], r["seed"]) for r in out.collect()}
    assert rows == {10: (0, True), 11: (1, False), 0: (None, False), 1: (None, False)}  # 12 is enclosed by a method
    assert len(found) == 2 and all(df.count() <= 5 for df in found)
