"""Named queries over the test tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import analytics, graph, postings, relate, search
from . import bindings as b
from ..operators.state import cut, if_small
from .bindings import CUSTOMER, NATION, NATION_USES_SQL, NODES_SQL, PART, RANKS_SQL, SUPPLIER, TRADE_SQL, USES_SQL, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
BASE = f"WITH {NODES_SQL.strip()}, {USES_SQL.strip()}"
FULL = f"{BASE}, {NATION_USES_SQL.strip()}"
TRADE = f"{BASE}, {TRADE_SQL.strip()}"
RANKED = f"WITH RECURSIVE {NODES_SQL.strip()}, {USES_SQL.strip()}, {RANKS_SQL.strip()}"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# -- lookups, filters, joins


@query(f"{BASE} SELECT id, kind, name, qualified_name, parent_id FROM nodes WHERE kind = 'class' ORDER BY id")
def p1_symbol_projection(spark, d):
    return b.nodes(spark, d).filter("kind = 'class'").select("id", "kind", "name", "qualified_name", "parent_id")


@query(f"{BASE} SELECT id, qualified_name FROM nodes WHERE qualified_name = 'AFRICA.NATION_0'")
def p3_exact_qualified_name(spark, d):
    return b.nodes(spark, d).filter("qualified_name = 'AFRICA.NATION_0'").select("id", "qualified_name")


@query(f"{BASE} SELECT id, name, qualified_name FROM nodes WHERE name = 'Supplier#000000007' OR qualified_name ILIKE '%.supplier#000000007' OR qualified_name ILIKE '%:supplier#000000007' ORDER BY length(qualified_name), id LIMIT 50")
def p4_by_name_or_suffix(spark, d):
    return search.by_name(b.nodes(spark, d), "Supplier#000000007").select("id", "name", "qualified_name")


@query("SELECT l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey = 5 ORDER BY 1, 2, 3")
def p5_lines_of_one_file(spark, d):
    return read(spark, d, "lineitem").filter("l_orderkey = 5").select("l_linenumber", "l_partkey", "l_suppkey")


@query(f"{BASE} SELECT n.id, n.name FROM nodes n WHERE n.id IN (SELECT dst FROM uses WHERE line = 7)")
def p6_symbols_by_ids(spark, d):
    ids = b.uses(spark, d).filter("line = 7").select(F.col("dst").alias("id"))
    return b.nodes(spark, d).join(ids, "id", "left_semi").select("id", "name")


@query("SELECT CAST(min(p_partkey) AS BIGINT) AS id, p_name, p_brand, count(*) AS parts FROM part GROUP BY p_name, p_brand")
def p7_canonical_symbols(spark, d):
    merged = relate.merge_parts(read(spark, d, "part"), ["p_name", "p_brand"], "p_partkey")
    return merged.groupBy(F.coalesce("merged_into", "p_partkey").alias("id"), "p_name", "p_brand").agg(F.count("*").alias("parts"))


@query("SELECT CAST(doc_id AS BIGINT) AS doc_id, source, n_chars FROM documents WHERE source IN ('src1', 'src2')")
def p9_file_chars(spark, d):
    return read(spark, d, "documents").filter(F.col("source").isin("src1", "src2")).select("doc_id", "source", "n_chars")


@query("SELECT doc_id, sha1(text) AS hash FROM documents")
def p10_hash_lookup(spark, d):
    return read(spark, d, "documents").select("doc_id", F.sha1("text").alias("hash"))


@query("SELECT a.p_partkey AS part, m.c AS canonical FROM part a JOIN (SELECT p_name, p_brand, min(p_partkey) AS c FROM part GROUP BY ALL) m USING (p_name, p_brand) WHERE a.p_partkey <> m.c")
def p11_parts_of_a_symbol(spark, d):
    return relate.merge_parts(read(spark, d, "part"), ["p_name", "p_brand"], "p_partkey").filter("merged_into is not null").select(F.col("p_partkey").alias("part"), F.col("merged_into").alias("canonical"))


@query("SELECT * FROM nation WHERE CAST(n_nationkey AS VARCHAR) ILIKE '%\\_1%' ESCAPE '\\' OR n_name ILIKE '%\\_1%' ESCAPE '\\' OR CAST(n_regionkey AS VARCHAR) ILIKE '%\\_1%' ESCAPE '\\'")
def p13_any_column_filter(spark, d):
    return search.any_column(read(spark, d, "nation"), "_1")


@query("""WITH x AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://[^/]+', ''), '[?#].*$', '') AS path FROM pages)
SELECT page_id, path, regexp_matches(path, '(?i)(^|/)(tests?|__tests__|specs?)/') OR regexp_matches(path, '\\.(test|spec)\\.[^./]+$') AS test FROM x""")
def p14_test_paths(spark, d):
    path = F.regexp_replace(F.regexp_replace("url", "^https?://[^/]+", ""), "[?#].*$", "")
    return read(spark, d, "pages").select("page_id", path.alias("path")).withColumn("test", paths.is_test(F.col("path")))


@query(f"{BASE} SELECT kind, CASE kind WHEN 'class' THEN 1.0 WHEN 'function' THEN 0.9 WHEN 'method' THEN 0.9 WHEN 'field' THEN 0.5 ELSE 0.3 END AS weight, count(*) AS n FROM nodes GROUP BY ALL")
def p15_kind_weights(spark, d):
    weight = F.when(F.col("kind") == "class", 1.0).when(F.col("kind").isin("function", "method"), 0.9).when(F.col("kind") == "field", 0.5).otherwise(0.3)
    return b.nodes(spark, d).groupBy("kind", weight.alias("weight")).agg(F.count("*").alias("n"))


@query(f"{BASE} SELECT id, qualified_name, count(DISTINCT qualified_name) OVER () > 1 AS ambiguous FROM nodes WHERE name = 'red widget' OR qualified_name ILIKE '%.red widget' ORDER BY length(qualified_name), id LIMIT 50".replace("count(DISTINCT qualified_name) OVER () > 1", "(SELECT count(DISTINCT qualified_name) > 1 FROM (SELECT qualified_name FROM nodes WHERE name = 'red widget' ORDER BY length(qualified_name), id LIMIT 50))"))
def p17_lookup_with_ambiguity(spark, d):
    return search.lookup(b.nodes(spark, d), "red widget").select("id", "qualified_name", "ambiguous")


@query("SELECT page_id, url FROM pages WHERE url LIKE 'https://%' AND (url LIKE '%/en/%')")
def p19_scope_filter(spark, d):
    return read(spark, d, "pages").filter(F.col("url").startswith("https://") & F.col("url").contains("/en/")).select("page_id", "url")


@query("SELECT CAST(round(sum(n_chars) / 4.0) AS BIGINT) AS tokens, round(sum(n_chars) / 4.0) >= 100000 AS offered FROM documents")
def p20_tools_gate(spark, d):
    return read(spark, d, "documents").agg(F.round(F.sum("n_chars") / 4).cast("long").alias("tokens")).withColumn("offered", F.col("tokens") >= 100_000)


@query("SELECT c_custkey, c_name, count(o_orderkey) AS orders, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL")
def j2_left_join_optional_end(spark, d):
    orders = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("t"))
    return read(spark, d, "customer").select("c_custkey", "c_name").join(orders, "c_custkey", "left").select("c_custkey", "c_name", F.coalesce("orders", F.lit(0)).alias("orders"), F.round(F.coalesce("t", F.lit(0.0)), 2).alias("total"))


@query(f"{BASE} SELECT n.name AS caller, u.line, u.dst FROM uses u JOIN nodes n ON n.id = u.src WHERE u.dst IN ({SUPPLIER + 3}, {SUPPLIER + 5})")
def j3_callers(spark, d):
    return b.uses(spark, d).filter(F.col("dst").isin(SUPPLIER + 3, SUPPLIER + 5)).join(b.nodes(spark, d), F.col("src") == F.col("id")).select(F.col("name").alias("caller"), "line", "dst")


@query(f"{BASE} SELECT DISTINCT src FROM uses WHERE dst IN (SELECT id FROM nodes WHERE parent_id = {NATION + 3})")
def j4_users_of_files(spark, d):
    ids = b.nodes(spark, d).filter(F.col("parent_id") == NATION + 3).select(F.col("id").alias("dst"))
    return b.uses(spark, d).join(ids, "dst", "left_semi").select("src").distinct()


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) IN (3, 5, 8)")
def j5_semi_join_json_list(spark, d):
    ids = spark.range(1).select(F.explode(F.from_json(F.lit("[3, 5, 8]"), "array<int>")).alias("k"))
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")).join(F.broadcast(ids), "k", "left_semi").select("event_id", "k")


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE o_custkey = c.c_custkey AND s_nationkey = c.c_nationkey)")
def j6_anti_join(spark, d):
    customer, supplier = read(spark, d, "customer"), read(spark, d, "supplier")
    home = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(if_small(supplier.select("s_suppkey", "s_nationkey")), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "s_nationkey").distinct()
    bought = home.join(read(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "s_nationkey").distinct()
    return customer.join(bought, (F.col("c_custkey") == F.col("o_custkey")) & (F.col("c_nationkey") == F.col("s_nationkey")), "left_anti").select("c_custkey")


@query(f"{BASE} SELECT p.name AS parent, m.name AS member, m.kind FROM nodes m JOIN nodes p ON m.parent_id = p.id WHERE p.kind = 'namespace'")
def j7_members(spark, d):
    n = b.nodes(spark, d)
    return n.alias("m").join(n.filter("kind = 'namespace'").alias("p"), F.expr("m.parent_id = p.id")).select(F.col("p.name").alias("parent"), F.col("m.name").alias("member"), F.col("m.kind").alias("kind"))


@query("""WITH w AS (SELECT * FROM (VALUES ('1995q1', DATE '1995-01-01', DATE '1995-03-31'), ('1997h2', DATE '1997-07-01', DATE '1997-12-31')) t(label, low, high)),
s AS (SELECT o_custkey, min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS b FROM orders GROUP BY 1)
SELECT label, o_custkey FROM s, w WHERE a <= high AND b >= low""")
def j9_interval_overlap(spark, d):
    windows = spark.sql("SELECT label, unix_date(a) AS low, unix_date(b) AS high FROM VALUES ('1995q1', DATE '1995-01-01', DATE '1995-03-31'), ('1997h2', DATE '1997-07-01', DATE '1997-12-31') AS t(label, a, b)")
    spans = read(spark, d, "orders").groupBy("o_custkey").agg(F.unix_date(F.min("o_orderdate").cast("date")).alias("start"), F.unix_date(F.max("o_orderdate").cast("date")).alias("end"))
    return relate.overlapping_bins(spans, windows, 365, "start", "end", "low", "high").select("label", "o_custkey")


@query("SELECT a.doc_id, b.source AS shared, count(*) AS n FROM documents a JOIN documents b ON a.lang = b.lang AND a.doc_id < b.doc_id AND b.doc_id < a.doc_id + 20 GROUP BY ALL")
def j9_range_join_on_key(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "lang", "source")
    left = docs.select("doc_id", "lang", (F.col("doc_id") + 1).alias("start"), (F.col("doc_id") + 19).alias("end"), F.floor((F.col("doc_id") + 1) / 20).alias("x"), F.floor((F.col("doc_id") + 19) / 20).alias("y"))
    cells = left.withColumn("cell", F.explode(F.array_distinct(F.array("x", "y"))))
    right = docs.select("lang", F.col("source").alias("shared"), F.col("doc_id").alias("low"), F.col("doc_id").alias("high"), F.floor(F.col("doc_id") / 20).alias("cell"))
    return relate.overlapping(cells, right, ["lang", "cell"], "start", "end").groupBy("doc_id", "shared").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey AS file, own, count(*) AS n FROM (SELECT n_nationkey, true AS own FROM nation JOIN supplier ON s_nationkey = n_nationkey UNION ALL SELECT a.n_nationkey, false FROM nation a JOIN nation x ON a.n_regionkey = x.n_regionkey AND a.n_nationkey <> x.n_nationkey JOIN supplier ON s_nationkey = x.n_nationkey WHERE s_acctbal > 5000) GROUP BY ALL")
def j10_effective_imports(spark, d):
    files = read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("project"))
    imports = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("file_id"), (F.col("s_acctbal") > 5000).alias("is_global"))
    return relate.effective_imports(imports, files).groupBy(F.col("for_file").alias("file"), "own").agg(F.count("*").alias("n"))


@query("SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 9900 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000 UNION SELECT n_nationkey FROM nation WHERE n_regionkey = 1")
def j11_visibility_union(spark, d):
    a = read(spark, d, "customer").filter("c_acctbal > 9900").select(F.col("c_nationkey").alias("nation"))
    c = read(spark, d, "supplier").filter("s_acctbal > 9000").select("s_nationkey")
    return a.union(c).union(read(spark, d, "nation").filter("n_regionkey = 1").select("n_nationkey")).distinct()


@query(f"{BASE} SELECT DISTINCT id, other FROM (SELECT src AS id, dst AS other FROM uses UNION ALL SELECT dst, src FROM uses) WHERE id IN ({SUPPLIER + 1}, {SUPPLIER + 2})")
def j12_neighbours(spark, d):
    ids = spark.createDataFrame([(SUPPLIER + 1,), (SUPPLIER + 2,)], "id long")
    return graph.neighbours(ids, b.uses(spark, d))


@query(f"{BASE} SELECT id, kind FROM nodes n WHERE name LIKE '%1%' AND NOT EXISTS (SELECT 1 FROM nodes m WHERE m.parent_id = n.id AND m.name LIKE '%1%')")
def j14_innermost(spark, d):
    return relate.innermost(b.nodes(spark, d).filter("name like '%1%'")).select("id", "kind")


# -- graphs


@query(f"{BASE}, RECURSIVE_PLACEHOLDER".replace("WITH", "WITH RECURSIVE", 1).replace("RECURSIVE_PLACEHOLDER", f"""strong AS (SELECT DISTINCT src, dst FROM uses),
step AS (SELECT src, dst FROM strong UNION ALL SELECT dst, src FROM strong),
r(id, level) AS (SELECT CAST({SUPPLIER + 1} AS BIGINT), 0 UNION SELECT s.dst, level + 1 FROM r JOIN step s ON s.src = r.id WHERE level < 3)
SELECT id, min(level) AS level FROM r GROUP BY id"""))
def g1_closure_bfs(spark, d):
    strong = b.uses(spark, d)
    step = strong.select("src", "dst").union(strong.select("dst", "src"))
    return graph.bfs(spark.createDataFrame([(SUPPLIER + 1,)], "id long"), step, 3)


@query(f"{BASE} SELECT id, 0 AS level FROM nodes WHERE id = 2 UNION ALL SELECT id, 1 FROM nodes WHERE parent_id = 2 UNION ALL SELECT id, 2 FROM nodes WHERE parent_id IN (SELECT id FROM nodes WHERE parent_id = 2)")
def g3_descendants(spark, d):
    return graph.descendants(b.nodes(spark, d), spark.createDataFrame([(2,)], "id long"))


@query(f"{RANKED} SELECT id, round(rank, 7) AS rank FROM ranks")
def g5_pagerank(spark, d):
    return graph.pagerank(b.nodes(spark, d), graph.weighted(b.uses(spark, d))).select("id", F.round("rank", 7).alias("rank"))


@query(f"{BASE} SELECT src, dst, count(*) AS n FROM uses WHERE src <> dst GROUP BY ALL")
def g6_weighted_graph(spark, d):
    return graph.weighted(b.uses(spark, d))


_BLAST = f"""WITH RECURSIVE {NODES_SQL.strip()}, {USES_SQL.strip()}, {TRADE_SQL.strip()},
r(id, level) AS (SELECT CAST({PART + 2} AS BIGINT), 0 UNION SELECT c.src, level + 1 FROM r JOIN trade c ON c.dst = r.id WHERE level < 3)
SELECT r.id, min(level) AS level, min(name) AS name FROM r JOIN nodes USING (id) WHERE level > 0 GROUP BY r.id"""


@query(_BLAST)
def g7_blast_radius(spark, d):
    found, _ = graph.blast_radius(spark.createDataFrame([(PART + 2,)], "id long"), b.trade(spark, d), most=None)
    return found.join(b.nodes(spark, d).select("id", "name"), "id").select("id", "level", "name")


@query(f"{BASE} SELECT id AS src, parent_id AS dst, 1 AS depth FROM nodes WHERE parent_id IS NOT NULL UNION ALL SELECT n.id, p.parent_id, 2 FROM nodes n JOIN nodes p ON p.id = n.parent_id WHERE p.parent_id IS NOT NULL")
def g11_ancestor_closure(spark, d):
    return graph.closure(b.nodes(spark, d).filter("parent_id is not null").select(F.col("id").alias("src"), F.col("parent_id").alias("dst")))


@query(f"{FULL} SELECT a.src AS a, a.dst AS b FROM nation_uses a JOIN nation_uses r ON a.src = r.dst AND a.dst = r.src WHERE a.src < a.dst")
def q10_mutual(spark, d):
    return graph.mutual(cut(b.nation_uses(spark, d).select("src", "dst")))


@query(f"{BASE} SELECT r.name AS app, c.name AS repository FROM nodes c JOIN nodes r ON c.parent_id = r.id WHERE c.kind = 'class'")
def q1_overview(spark, d):
    n = b.nodes(spark, d)
    return n.filter("kind = 'class'").alias("c").join(n.alias("r"), F.expr("c.parent_id = r.id")).select(F.col("r.name").alias("app"), F.col("c.name").alias("repository"))


@query(f"{BASE} SELECT p.name AS repository, m.kind, count(*) AS n FROM nodes m JOIN nodes p ON m.parent_id = p.id GROUP BY ALL ORDER BY 1, 2")
def q2_contents(spark, d):
    n = b.nodes(spark, d)
    return n.alias("m").join(n.alias("p"), F.expr("m.parent_id = p.id")).groupBy(F.col("p.name").alias("repository"), F.col("m.kind").alias("kind")).agg(F.count("*").alias("n")).orderBy("repository", "kind")


@query(f"{RANKED} SELECT id, round(rank * n, 5) AS score FROM ranks JOIN nodes USING (id), size WHERE kind NOT IN ('property', 'field') ORDER BY round(rank * n, 5) DESC, id LIMIT 25")
def q3_core_symbols(spark, d):
    nodes = cut(b.nodes(spark, d).select("id", "kind"))
    ranks = graph.pagerank(nodes, graph.weighted(b.uses(spark, d)))
    scored = ranks.join(nodes.filter("kind not in ('property', 'field')").select("id"), "id", "left_semi").select("id", F.round(F.col("rank") * nodes.count(), 5).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(25)


@query(f"{BASE} SELECT DISTINCT u.src, u.dst FROM uses u JOIN nodes m ON m.id = u.dst WHERE m.parent_id = {NATION + 4} ORDER BY 1, 2 LIMIT 100")
def q5_used_by(spark, d):
    members = b.nodes(spark, d).filter(F.col("parent_id") == NATION + 4).select(F.col("id").alias("dst"))
    return b.uses(spark, d).join(members, "dst", "left_semi").select("src", "dst").distinct().orderBy("src", "dst").limit(100)


@query(f"{TRADE} SELECT id, min(level) AS level FROM (SELECT src AS id, 1 AS level FROM trade WHERE dst = {PART + 7} UNION ALL SELECT x.src, 2 FROM trade x JOIN trade y ON x.dst = y.src WHERE y.dst = {PART + 7}) GROUP BY id")
def q6_callers_two_hops(spark, d):
    back = b.trade(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.within_hops(spark.createDataFrame([(PART + 7,)], "id long"), back, 2)


@query(f"{BASE} SELECT p.name AS type, count(*) AS members FROM nodes m JOIN nodes p ON m.parent_id = p.id WHERE p.kind = 'class' GROUP BY p.id, p.name ORDER BY members DESC, type LIMIT 20")
def q11_largest_types(spark, d):
    n = b.nodes(spark, d)
    return n.alias("m").join(n.filter("kind = 'class'").alias("p"), F.expr("m.parent_id = p.id")).groupBy(F.col("p.name").alias("type")).agg(F.count("*").alias("members")).orderBy(F.desc("members"), "type").limit(20)


@query(f"{BASE} SELECT id, name FROM nodes n WHERE kind IN ('function', 'method') AND NOT EXISTS (SELECT 1 FROM uses u WHERE u.dst = n.id)")
def q12_unused(spark, d):
    """Nothing calls a customer, so all of them are listed, and suppliers without a sale."""
    return b.nodes(spark, d).filter("kind in ('function', 'method')").join(b.uses(spark, d).select(F.col("dst").alias("id")), "id", "left_anti").select("id", "name")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'wid') ORDER BY p_partkey LIMIT 50")
def q13_contains_search(spark, d):
    return read(spark, d, "part").filter(F.lower("p_name").contains("wid")).select("p_partkey", "p_name").orderBy("p_partkey").limit(50)


@query("SELECT r_name AS app, string_agg(n_name, ',' ORDER BY n_name) AS repositories FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def q18_apps_and_repositories(spark, d):
    return read(spark, d, "nation").join(if_small(read(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("app")).agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("repositories"))


# -- linker


@query("SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, CASE WHEN min(q.p_partkey) = max(q.p_partkey) THEN min(q.p_partkey) END AS resolved FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey JOIN part q ON (q.p_name, q.p_brand, q.p_type) = (p.p_name, p.p_brand, p.p_type) GROUP BY ALL")
def r9_unique_or_null(spark, d):
    part = read(spark, d, "part").select("p_partkey", F.struct("p_name", "p_brand", "p_type").alias("key"))
    by_key = relate.unique_or_null(part.select("key", F.col("p_partkey").alias("id"), F.col("p_partkey").alias("qualified_name")), "key")
    picked = part.join(by_key, "key").select("p_partkey", "id")
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct().join(picked, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "l_partkey", F.col("id").alias("resolved"))


@query("""WITH c AS (SELECT p_partkey, 1 AS rule, q AS id FROM (SELECT a.p_partkey, x.p_partkey AS q FROM part a JOIN part x ON (x.p_name, x.p_brand, x.p_size) = (a.p_name, a.p_brand, a.p_size) AND x.p_partkey <> a.p_partkey)
UNION ALL SELECT a.p_partkey, 2, x.p_partkey FROM part a JOIN part x ON (x.p_name, x.p_type, x.p_size) = (a.p_name, a.p_type, a.p_size) AND x.p_partkey <> a.p_partkey),
f AS (SELECT p_partkey, min(rule) AS rule FROM c GROUP BY 1) SELECT c.p_partkey, CASE WHEN min(id) = max(id) THEN min(id) END AS id FROM c JOIN f USING (p_partkey, rule) GROUP BY 1""")
def r2_resolution_cascade(spark, d):
    part = read(spark, d, "part")

    def rule(n, *same):
        other = part.select(*same, F.col("p_partkey").alias("id"))
        return part.join(other, list(same)).filter("p_partkey <> id").select("p_partkey", F.lit(n).alias("rule"), "id", F.col("id").alias("qualified_name"))

    return relate.first_rule(rule(1, "p_name", "p_brand", "p_size").union(rule(2, "p_name", "p_type", "p_size")), "p_partkey")


@query("SELECT p_partkey, CASE WHEN p_partkey <> c THEN c END AS merged_into FROM (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_name, p_brand) AS c FROM part)")
def r25_merge_parts(spark, d):
    return relate.merge_parts(read(spark, d, "part"), ["p_name", "p_brand"], "p_partkey").select("p_partkey", "merged_into")


@query("SELECT DISTINCT array_to_string(list_slice(string_split(place, '.'), 1, i), '.') AS namespace FROM (SELECT r_name || '.' || n_name AS place FROM nation JOIN region ON n_regionkey = r_regionkey), (SELECT unnest([1, 2]) AS i)")
def r22_namespace_prefixes(spark, d):
    name = b.nodes(spark, d).filter("kind = 'class'").select(F.split("qualified_name", r"\.").alias("p"))
    return name.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda k: F.array_join(F.slice("p", F.lit(1), k), "."))).alias("namespace")).distinct()


@query("SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'gone' WHEN a.h = b.h THEN 'unchanged' ELSE 'changed' END AS state FROM (SELECT doc_id, md5(text) AS h FROM documents WHERE source <> 'src7') a FULL JOIN (SELECT doc_id, md5(CASE WHEN lang = 'de' THEN text || 'x' ELSE text END) AS h FROM documents WHERE source <> 'src11') b ON a.doc_id = b.doc_id")
def x5_full_sync(spark, d):
    docs = read(spark, d, "documents")
    old = docs.filter("source <> 'src7'").select("doc_id", F.md5("text").alias("hash"))
    new = docs.filter("source <> 'src11'").select("doc_id", F.md5(F.when(F.col("lang") == "de", F.concat("text", F.lit("x"))).otherwise(F.col("text"))).alias("hash"))
    return relate.changes(old, new, "doc_id")


# -- aggregates


@query("SELECT count(*) AS files, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS chars, count(*) FILTER (WHERE quality = 1) AS good, count(quality) AS labelled FROM documents LEFT JOIN labels USING (doc_id)")
def a1_global_stats(spark, d):
    return read(spark, d, "documents").select("doc_id", "n_chars").join(read(spark, d, "labels"), "doc_id", "left").agg(F.count("*").alias("files"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars"), F.count_if(F.col("quality") == 1).alias("good"), F.count("quality").alias("labelled"))


@query("SELECT lang, count(DISTINCT source) AS sources, count(quality) AS labelled, count(*) AS docs FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def a2_per_language(spark, d):
    return read(spark, d, "documents").select("doc_id", "lang", "source").join(read(spark, d, "labels"), "doc_id", "left").groupBy("lang").agg(F.countDistinct("source").alias("sources"), F.count("quality").alias("labelled"), F.count("*").alias("docs"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS tab, count(*) AS n FROM {t}" for t in ("region", "nation", "supplier", "customer", "part", "orders", "lineitem")))
def a3_row_counts(spark, d):
    out = None
    for t in ("region", "nation", "supplier", "customer", "part", "orders", "lineitem"):
        one = read(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("tab"), "n")
        out = one if out is None else out.union(one)
    return out


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors, arg_min(event_id, (ts, event_id)) FILTER (WHERE event_type = 'error') AS first_error FROM events GROUP BY user_id")
def a5_count_and_first_example(spark, d):
    bad = F.col("event_type") == "error"
    return read(spark, d, "events").groupBy("user_id").agg(F.count_if(bad).alias("errors"), F.min_by(F.when(bad, F.col("event_id")), F.when(bad, F.struct("ts", "event_id"))).alias("first_error"))


@query(f"{BASE} SELECT src, dst, count(*) AS n, string_agg(DISTINCT line, ',' ORDER BY line) AS lines FROM uses GROUP BY ALL")
def a6_edge_lines(spark, d):
    return graph.uses_with_lines(b.uses(spark, d)).withColumn("lines", F.array_join("lines", ","))


@query(f"{BASE} SELECT dst, count(DISTINCT src) AS callers FROM uses GROUP BY dst ORDER BY callers DESC, dst LIMIT 1")
def a8_widest(spark, d):
    return b.uses(spark, d).groupBy("dst").agg(F.countDistinct("src").alias("callers")).orderBy(F.desc("callers"), "dst").limit(1)


@query("SELECT p_name, p_brand, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1")
def a9_having(spark, d):
    return read(spark, d, "part").groupBy("p_name", "p_brand").agg(F.count("*").alias("n")).filter("n > 1")


@query("SELECT source, count(*) AS n FROM documents WHERE text ILIKE '%the%' GROUP BY source ORDER BY n DESC, source LIMIT 10")
def a12_matches_per_file(spark, d):
    return read(spark, d, "documents").filter(F.col("text").ilike("%the%")).groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(10)


@query("SELECT event_type, string_agg(event_id, ',' ORDER BY event_id) AS examples, any_value(n) AS n FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE k <= 5 GROUP BY event_type")
def a13_capped_groups(spark, d):
    events = read(spark, d, "events").select("event_type", "event_id")
    top = relate.first_of_each(events, "event_type", ["event_id"], 5).groupBy("event_type").agg(F.array_join(F.array_sort(F.collect_list("event_id")), ",").alias("examples"))
    return top.join(events.groupBy("event_type").agg(F.count("*").alias("n")), "event_type").select("event_type", "examples", "n")


@query("SELECT CAST(sum(n_chars) AS BIGINT) AS chars, CAST(sum(ceil(n_chars / 4.0)) AS BIGINT) AS tokens, round(100 - 100.0 * sum(least(n_chars, 400)) / sum(n_chars), 4) AS saved FROM documents")
def a15_context_totals(spark, d):
    return read(spark, d, "documents").agg(F.sum("n_chars").alias("chars"), F.sum(text.token_estimate(F.col("n_chars"))).alias("tokens"), F.round(100 - 100.0 * F.sum(F.least("n_chars", F.lit(400))) / F.sum("n_chars"), 4).alias("saved"))


# -- search and text


_SEARCH = """WITH t AS (SELECT p_partkey AS id, p_name AS name, p_brand || '.' || p_name AS qualified_name FROM part),
w AS (SELECT id, 10.0 AS w, unnest(list_filter(regexp_split_to_array(lower(name), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS term FROM t UNION ALL SELECT id, 2.0, unnest(list_filter(regexp_split_to_array(lower(qualified_name), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) FROM t),
p AS (SELECT id, term, sum(w) AS tf, count(*) AS n FROM w GROUP BY ALL), l AS (SELECT id, sum(n) AS len FROM p GROUP BY id), m AS (SELECT count(*) AS n, avg(len) AS mean FROM l),
h AS (SELECT id, sum(tf) AS tf FROM p WHERE starts_with(term, 'wid') GROUP BY id), df AS (SELECT count(*) AS df FROM h),
s AS (SELECT h.id, greatest(ln((m.n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)) AS score FROM h JOIN l USING (id), m, df)
SELECT id, name, qualified_name, round(score, 6) AS score FROM s JOIN t USING (id) ORDER BY (lower(name) = 'wid') DESC, starts_with(lower(name), 'wid') DESC, round(score, 6) DESC, length(qualified_name), id LIMIT 20"""


def _parts(spark, d):
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat("p_brand", F.lit("."), "p_name").alias("qualified_name"))


@query(_SEARCH)
def s1_ranked_prefix_search(spark, d):
    return search.ranked_prefix_search(_parts(spark, d), "wid").select("id", "name", "qualified_name", F.round("score", 6).alias("score"))


@query(_SEARCH)
def s1_stored_index(spark, d):
    kept = postings.Postings.build(_parts(spark, d), {"name": 10.0, "qualified_name": 2.0}, shards=8)
    return kept.search("wid").select("id", "name", "qualified_name", F.round("score", 6).alias("score"))


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[^A-Za-z0-9_$]+'), lambda x: length(x) >= 2 AND (regexp_matches(x, '[a-z][A-Z]|[_$0-9]') OR CASE WHEN regexp_matches(x, '^[A-Z][a-z]+$') THEN length(x) >= 4 AND lower(x) NOT IN (" + ", ".join(f"'{w}'" for w in sorted(text.STOP_WORDS)).replace("method's", "method''s").replace("class's", "class''s").replace("code's", "code''s") + ") ELSE NOT regexp_matches(x, '^[A-Z]{2,}$') AND contains(text, x || '(') AND regexp_matches(text, '(^|[^\\w$])' || replace(x, '$', '\\$') || '\\(') END))) AS code_words FROM documents")
def s4_code_words(spark, d):
    return read(spark, d, "documents").select("doc_id", text.code_words(F.col("text")).alias("code_words"))


@query(f"{BASE} SELECT id, round(power(0.5, CASE kind WHEN 'namespace' THEN 0 WHEN 'class' THEN 1 ELSE 2 END) * (0.7 + 0.3 * length(name) / 20.0), 6) AS score FROM nodes WHERE kind <> 'field'")
def s5_candidate_score(spark, d):
    hops = F.when(F.col("kind") == "namespace", 0).when(F.col("kind") == "class", 1).otherwise(2)
    return b.nodes(spark, d).filter("kind <> 'field'").select("id", F.round(F.pow(F.lit(0.5), hops) * (0.7 + 0.3 * F.length("name") / 20), 6).alias("score"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k = 1 ORDER BY doc_id")
def s6_drop_copies(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "n_chars", F.md5("text").alias("h"))
    return search.drop_copies(docs, ["h"], [F.desc("n_chars"), "doc_id"]).select("doc_id")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100 OFFSET 50")
def s10_paging(spark, d):
    return search.page(read(spark, d, "documents").select("doc_id", "n_chars"), [F.desc("n_chars"), "doc_id"], 50)[0]


@query("SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE contains(text, 'the')) WHERE regexp_matches(line, '(^|[^\\w$])the($|[^\\w$])') GROUP BY doc_id")
def f12_name_matches(spark, d):
    return search.lines_matching(read(spark, d, "documents"), "doc_id", "text", "the").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN length(t) > 100 THEN substr(t, 1, 100) || '…' ELSE t END AS head FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)")
def f1_collapse_and_truncate(spark, d):
    return read(spark, d, "documents").select("doc_id", text.truncate(text.collapse(F.col("text")), 100).alias("head"))


@query("SELECT page_id, CASE WHEN regexp_matches(url, '[\",\\r\\n]') THEN '\"' || replace(url, '\"', '\"\"') || '\"' ELSE url END AS field FROM pages")
def f4_csv_field(spark, d):
    return read(spark, d, "pages").select("page_id", text.csv_field(F.col("url")).alias("field"))


@query("SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")
def f13_json(spark, d):
    return read(spark, d, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))


@query("SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 3), chr(10)) AS lines FROM documents")
def t3_line_slice(spark, d):
    return read(spark, d, "documents").select("doc_id", text.line_slice(F.col("text"), F.lit(2), F.lit(3)).alias("lines"))


@query("SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages) GROUP BY ALL")
def t_page_links(spark, d):
    return read(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


# -- usage and benchmark analytics


@query("SELECT event_type AS client, count(*) AS calls, count(*) FILTER (WHERE CAST(ts AS DATE) = DATE '2024-01-05') AS today, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS chars, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM events GROUP BY 1")
def u1_client_tally(spark, d):
    calls = read(spark, d, "events").select(F.col("event_type").alias("client"), F.col("ts").alias("t"), F.round(F.col("value") * 100).cast("long").alias("chars"))
    return analytics.client_tally(calls, F.lit("2024-01-05").cast("date")).withColumn("last", F.date_format("last", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS client, count(*) AS calls, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS chars FROM events GROUP BY ALL")
def u2_day_tally(spark, d):
    calls = read(spark, d, "events").select(F.col("event_type").alias("client"), F.col("ts").alias("t"), F.round(F.col("value") * 100).cast("long").alias("chars"))
    return analytics.day_tally(calls).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


_CALLS = "calls AS (SELECT conv_id AS run, turn AS ord, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS context, CAST(length(text) AS BIGINT) AS output FROM conversations)"


def _calls(spark, d):
    size = F.length("text").cast("long")
    return read(spark, d, "conversations").select(F.col("conv_id").alias("run"), F.col("turn").alias("order"), F.sum(size).over(Window.partitionBy("conv_id").orderBy("turn")).alias("context"), size.alias("output"))


@query(f"WITH {_CALLS} SELECT run, count(*) AS calls, CAST(sum(context) AS BIGINT) AS context, CAST(sum(context - f) AS BIGINT) AS work, CAST(sum(output) AS BIGINT) AS output FROM (SELECT *, first_value(context) OVER (PARTITION BY run ORDER BY ord) AS f FROM calls) GROUP BY run")
def b1_transcript_summary(spark, d):
    return analytics.transcript_summary(_calls(spark, d))


@query(f"WITH {_CALLS} SELECT run, round(sum(r * 0.3 + (context - r) * 6 + output * 15), 4) AS cost FROM (SELECT *, least(coalesce(lag(context) OVER (PARTITION BY run ORDER BY ord), 0), context) AS r FROM calls) GROUP BY run")
def b2_cached_cost(spark, d):
    return analytics.cached_cost(_calls(spark, d), 0.3, 6.0, 15.0).withColumn("cost", F.round("cost", 4))


@query("SELECT CAST(doc_id AS BIGINT) AS doc_id, (CAST(regexp_matches(text, '(?i)the') AS INTEGER) + CAST(regexp_matches(text, '(?i)license') AS INTEGER)) / 2.0 AS recall, CAST(regexp_matches(text, '!!') AS INTEGER) AS false_positives, quality = 1 AND regexp_matches(text, '(?i)the') AND regexp_matches(text, '(?i)license') AND NOT regexp_matches(text, '!!') AS passed FROM documents JOIN labels USING (doc_id) WHERE quality = 1")
def b3_grade(spark, d):
    rows = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id").filter("quality = 1").select("doc_id", F.col("text").alias("answer"), F.lit(True).alias("ok"), F.array().cast("array<string>").alias("checks"), F.array(F.lit("(?i)the"), F.lit("(?i)license")).alias("expected"), F.array(F.lit("!!")).alias("forbidden"))
    return analytics.grade(rows).select("doc_id", "recall", "false_positives", "passed")


_RUNS = "runs AS (SELECT event_type AS task, CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 AS arm, value AS cost, value < 50 AS passed FROM events)"


def _runs(spark, d):
    return read(spark, d, "events").select(F.col("event_type").alias("task"), (F.get_json_object("props", "$.k").cast("int") % 3).alias("arm"), F.col("value").alias("cost"), (F.col("value") < 50).alias("passed"))


@query(f"WITH {_RUNS} SELECT task, arm, count(*) AS runs, count(*) FILTER (WHERE passed) AS passes, round(median(cost), 6) AS cost FROM runs GROUP BY ALL")
def b4_report(spark, d):
    return analytics.arm_report(_runs(spark, d), "cost").withColumn("cost", F.round("cost", 6))


@query(f"WITH {_RUNS}, m AS (SELECT task, arm, median(cost) AS cost FROM runs GROUP BY ALL) SELECT a.arm, round(exp(avg(ln(a.cost / b.cost))), 6) AS ratio, count(*) AS tasks FROM m a JOIN m b ON a.task = b.task AND b.arm = 0 WHERE a.arm <> 0 GROUP BY a.arm")
def b5_ratio_to_baseline(spark, d):
    return analytics.ratio_to_baseline(analytics.arm_report(_runs(spark, d), "cost"), "cost", 0).withColumn("ratio", F.round("ratio", 6))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitive callers of a supplier."""
    return g7_blast_radius(spark, sf_dir)
