from graphquarry.operators import graph, visibility


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_files_seeing(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    seen = visibility.files_seeing(
        make([(1,)], "id long"), make([(2, 1), (3, 2), (1, 3)], "file long, target long"), make([(4, 3), (5, 9)], "file long, target long"),
        make([(1, "A.B"), (6, "A.B.C"), (7, "A")], "file long, namespace string"), make([(8, "A.B", False), (9, "A.B", True)], "file long, namespace string, is_global boolean"),
        make([(9, "p"), (10, "p"), (11, "q")], "id long, project string"),
    )
    assert ids(seen) == [1, 2, 3, 4, 6, 8, 9, 10]


def test_overridden_widens_callers(spark):
    methods = spark.createDataFrame([(1, "save", 10), (2, "save", 11), (3, "save", 12), (4, "load", 11)], "id long, name string, parent_id long")
    inherits = spark.createDataFrame([(10, 11), (11, 12), (12, 10)], "src long, dst long")
    wide = visibility.overridden(methods, inherits)
    assert {(r["id"], r["base"]) for r in wide.filter("id = 1").collect()} == {(1, 2), (1, 3)}
    calls = spark.createDataFrame([(20, 3), (21, 20), (22, 4), (20, 21)], "src long, dst long")
    found, cut = graph.blast_radius(spark.createDataFrame([(1,)], "id long"), calls, 3, overridden=wide)
    assert {(r["id"], r["level"]) for r in found.collect()} == {(20, 1), (21, 2)} and not cut
    found, cut = graph.blast_radius(spark.createDataFrame([(1,)], "id long"), calls, 3, most=1, overridden=wide)
    assert ids(found) == [20] and cut


def test_unlinked_and_ancestors(spark):
    uses = spark.createDataFrame([("calls", None, "a", "x", None, 3), ("calls", None, "a", "x", "f()", 2), ("calls", 5, "a", "x", None, 1), ("calls", None, "b", "x", None, 1)], "type string, to_id long, path string, name string, qualifier string, line int")
    names, seeing = spark.createDataFrame([("x",)], "name string"), spark.createDataFrame([("a",)], "id string")
    assert [tuple(r) for r in visibility.unlinked_calls(uses, names, seeing).collect()] == [("x", 2, "a:2")]
    assert visibility.unlinked_calls(uses, names, seeing, True).first()["n"] == 1
    symbols = spark.createDataFrame([(1, None, "class"), (2, 1, "method"), (3, 2, "function")], "id long, parent_id long, kind string")
    assert {r["id"]: r["ancestors"] for r in visibility.ancestors(symbols).collect()} == {1: [], 2: [1], 3: [2, 1]}
    assert ids(visibility.nested_in_function(symbols)) == [3]


def test_pagerank_toy(spark):
    nodes = spark.createDataFrame([(k,) for k in range(1, 7)], "id long")
    edges = spark.createDataFrame([(k, 5, 1) for k in range(1, 5)] + [(5, 6, 3), (5, 5, 9), (6, 99, 1)], "src long, dst long, n long")
    out = {r["id"]: r["rank"] for r in graph.pagerank(nodes, edges, tolerance=1e-7).collect()}
    assert sorted(out, key=out.get)[-2:] == [5, 6] or sorted(out, key=out.get)[-2:] == [6, 5]
    assert abs(sum(out.values()) - 1) < 1e-6
    assert graph.pagerank(nodes.limit(0), edges).count() == 0


def brute_ranks(nodes, edges, damping=0.85, rounds=400):
    out = {}
    for a, b, n in edges:
        if a != b and a in nodes and b in nodes:
            out.setdefault(a, []).append((b, n ** 0.5))
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(rounds):
        lost = sum(r for k, r in rank.items() if k not in out)
        new = dict.fromkeys(nodes, (1 - damping) / len(nodes) + damping * lost / len(nodes))
        for a, some in out.items():
            for b, w in some:
                new[b] += damping * rank[a] * w / sum(x for _, x in some)
        rank = new
    return rank


def test_pagerank_with_hubs_against_brute_force(spark):
    """Node 0 has a third of the edges, so its edges lie apart; some nodes have none, some edges lead out of the graph."""
    import random

    rng = random.Random(2)
    nodes = list(range(40))
    pairs = {(0, b) for b in range(1, 38)} | {(rng.randint(1, 30), rng.randint(0, 42)) for _ in range(90)}
    edges = [(a, b, rng.randint(1, 9)) for a, b in sorted(pairs)]
    frame = spark.createDataFrame(edges, "src long, dst long, n long")
    want = brute_ranks(set(nodes), edges)
    for some in (frame, frame.filter("src > 0")):
        if some is not frame:
            want = brute_ranks(set(nodes), [e for e in edges if e[0]])
        got = {r["id"]: r["rank"] for r in graph.pagerank(spark.createDataFrame([(k,) for k in nodes], "id long"), some, at_once=4).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)


def test_long_chain(spark):
    """Sixty levels: found in order, in few tables."""
    import time

    chain = spark.range(60).select("id", (graph.F.col("id") + 1).alias("dst")).toDF("src", "dst")
    began = time.time()
    found = graph.bfs(spark.createDataFrame([(0,)], "id long"), chain)
    assert sorted((r["id"], r["level"]) for r in found.collect()) == [(k, k) for k in range(61)]
    assert len(found.inputFiles()) < 60 and time.time() - began < 120


def test_first_rows_are_kept_before_the_shuffle(spark):
    from graphquarry.operators.relate import first_of_each

    rows = spark.range(5000).selectExpr("id % 3 as g", "id")
    found = first_of_each(rows, "g", ["id"], 2)
    assert sorted(tuple(r) for r in found.collect()) == [(g, g + 3 * k, k + 1) for g in range(3) for k in range(2)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")  # read from the top: limited on both sides of the exchange
