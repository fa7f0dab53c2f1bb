"""Further named queries: scalar functions, scoring, sinks, maintenance, hops and windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import analytics, graph, pack, relate, search
from ..sources import sinks
from ..streaming import watch
from . import bindings as b
from ..operators.state import cut, if_small
from .bindings import CUSTOMER, NATION, SUPPLIER, read
from .registry import BASE, TRADE, query


@query(f"{BASE} SELECT n.id, n.name, p.name AS parent FROM nodes n LEFT JOIN nodes p ON p.id = n.parent_id WHERE n.kind IN ('class', 'namespace')")
def p2_projection_with_optional_parent(spark, d):
    n = b.nodes(spark, d)
    return n.filter("kind in ('class', 'namespace')").alias("n").join(n.alias("p"), F.expr("p.id = n.parent_id"), "left").select("n.id", "n.name", F.col("p.name").alias("parent"))


@query(f"{BASE} SELECT kind, count(*) FILTER (WHERE parent_id = {NATION + 2}) AS in_parent, count(*) FILTER (WHERE name LIKE '%7') AS by_name FROM nodes GROUP BY kind")
def p8_slim_refs(spark, d):
    return b.nodes(spark, d).groupBy("kind").agg(F.count_if(F.col("parent_id") == NATION + 2).alias("in_parent"), F.count_if(F.col("name").endswith("7")).alias("by_name"))


@query("SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS line FROM documents WHERE source = 'src3'")
def p12_imports_in_line_order(spark, d):
    return read(spark, d, "documents").filter("source = 'src3'").select("doc_id", "source", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("line"))


@query(f"{BASE} SELECT id, name FROM nodes WHERE parent_id IS NULL AND kind = 'namespace' AND name = 'ASIA'")
def p16_top_level_export(spark, d):
    return b.nodes(spark, d).filter("parent_id is null and kind = 'namespace' and name = 'ASIA'").select("id", "name")


@query("SELECT p_partkey, c.n AS overloads FROM part JOIN (SELECT p_name, p_brand, min(p_partkey) AS m, count(*) AS n FROM part GROUP BY ALL) c USING (p_name, p_brand) WHERE p_partkey = m")
def j8_canonical_of_parts(spark, d):
    merged = relate.merge_parts(read(spark, d, "part"), ["p_name", "p_brand"], "p_partkey").select(F.col("p_partkey").alias("id"), "merged_into")
    return relate.canonical(merged.select("id"), "id", merged).groupBy(F.col("id").alias("p_partkey")).agg(F.count("*").alias("overloads"))


@query("SELECT coalesce(c, l_partkey) AS part, count(*) AS uses FROM lineitem LEFT JOIN (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_name, p_brand) AS c FROM part) ON p_partkey = l_partkey GROUP BY 1")
def j15_uses_of_canonical_targets(spark, d):
    merged = relate.merge_parts(read(spark, d, "part"), ["p_name", "p_brand"], "p_partkey").select(F.col("p_partkey").alias("id"), "merged_into")
    return relate.canonical(read(spark, d, "lineitem").select("l_partkey"), "l_partkey", merged).groupBy(F.col("l_partkey").alias("part")).agg(F.count("*").alias("uses"))


@query(f"{BASE} SELECT m.id, 2 - (m.kind = 'class')::INT AS depth FROM nodes m WHERE m.parent_id = 1 OR m.parent_id IN (SELECT id FROM nodes WHERE parent_id = 1)")
def q4_members_to_depth_two(spark, d):
    n = b.nodes(spark, d)
    first = n.filter("parent_id = 1").select("id")
    second = n.join(first.withColumnRenamed("id", "parent_id"), "parent_id").select("id")
    return first.withColumn("depth", F.lit(1)).union(second.withColumn("depth", F.lit(2)))


@query(f"{TRADE} SELECT id, min(level) AS level FROM (SELECT dst AS id, 1 AS level FROM trade WHERE src = {CUSTOMER + 9} UNION ALL SELECT y.dst, 2 FROM trade x JOIN trade y ON x.dst = y.src WHERE x.src = {CUSTOMER + 9}) GROUP BY id")
def q7_callees_two_hops(spark, d):
    return graph.within_hops(spark.createDataFrame([(CUSTOMER + 9,)], "id long"), b.trade(spark, d), 2)


@query(f"{BASE} SELECT x.id, 1 AS level FROM nodes n JOIN nodes x ON x.id = n.parent_id WHERE n.id = {SUPPLIER + 4} UNION ALL SELECT y.id, 2 FROM nodes n JOIN nodes x ON x.id = n.parent_id JOIN nodes y ON y.id = x.parent_id WHERE n.id = {SUPPLIER + 4}")
def q8_hierarchy(spark, d):
    up = b.nodes(spark, d).filter("parent_id is not null").select(F.col("id").alias("src"), F.col("parent_id").alias("dst"))
    return graph.within_hops(spark.createDataFrame([(SUPPLIER + 4,)], "id long"), up, 3)


@query("SELECT r_name AS app, max(n) AS largest, count(*) AS repositories FROM (SELECT r_name, n_name, count(c_custkey) AS n FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL) GROUP BY 1")
def q15_largest_repository(spark, d):
    per = read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    named = read(spark, d, "nation").join(if_small(read(spark, d, "region")), F.expr("n_regionkey = r_regionkey")).join(per, "n_nationkey", "left")
    return named.groupBy(F.col("r_name").alias("app")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("largest"), F.count("*").alias("repositories"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_nationkey <> 3")
def q17_delete_section(spark, d):
    gone = read(spark, d, "customer").filter("c_nationkey = 3").select("c_custkey")
    return read(spark, d, "customer").join(gone, "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


@query("SELECT count(*) AS n FROM part WHERE p_name = 'red widget'")
def a4_count_by_name(spark, d):
    return read(spark, d, "part").filter("p_name = 'red widget'").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT lang, source FROM documents")
def a10_distinct(spark, d):
    return read(spark, d, "documents").select("lang", "source").distinct()


@query(f"{BASE} SELECT parent_id, count(*) AS members FROM nodes WHERE parent_id IS NOT NULL GROUP BY 1")
def a11_members_per_parent(spark, d):
    return b.nodes(spark, d).filter("parent_id is not null").groupBy("parent_id").agg(F.count("*").alias("members"))


@query("SELECT role AS label, count(*) AS n FROM conversations GROUP BY 1 UNION ALL SELECT lang, count(*) FROM documents GROUP BY 1")
def a14_summary_counts(spark, d):
    return read(spark, d, "conversations").groupBy(F.col("role").alias("label")).agg(F.count("*").alias("n")).union(read(spark, d, "documents").groupBy("lang").agg(F.count("*")))


@query(f"{BASE} SELECT DISTINCT dst AS id FROM uses")
def a16_used_symbols(spark, d):
    return b.uses(spark, d).select(F.col("dst").alias("id")).distinct()


@query(f"""WITH c AS (SELECT p_brand AS key, p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'base' WHEN 1 THEN 'left' WHEN 2 THEN 'right' ELSE 'leaf' END AS owner FROM part),
a AS (SELECT * FROM (VALUES ('left', 'base'), ('right', 'base'), ('leaf', 'left'), ('leaf', 'base')) t(type, ancestor)), o AS (SELECT DISTINCT key, owner FROM c),
ok AS (SELECT x.key, x.owner FROM o x WHERE NOT EXISTS (SELECT 1 FROM o y WHERE y.key = x.key AND y.owner <> x.owner AND NOT EXISTS (SELECT 1 FROM a WHERE a.type = y.owner AND a.ancestor = x.owner)))
SELECT k.key, m.id FROM (SELECT DISTINCT key FROM c) k LEFT JOIN (SELECT ok.key, min(id) AS id FROM ok JOIN c USING (key, owner) GROUP BY 1) m USING (key)""")
def r10_top_declaration(spark, d):
    """Parts of a brand declare one member in a diamond of types; brands with ``left`` and ``right`` but no ``base`` have no top."""
    size = F.col("p_size") % 4
    owner = F.when(size == 0, "base").when(size == 1, "left").when(size == 2, "right").otherwise("leaf")
    a = spark.createDataFrame([("left", "base"), ("right", "base"), ("leaf", "left"), ("leaf", "base")], "type string, ancestor string")
    return relate.top_declaration(read(spark, d, "part").select(F.col("p_brand").alias("key"), owner.alias("owner"), F.col("p_partkey").alias("id")), a, "key")


@query(f"""WITH c AS (SELECT p_name || p_type AS key, p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' ELSE 'leaf' END AS owner FROM part),
a AS (SELECT * FROM (VALUES ('leaf', 'left'), ('leaf', 'right')) t(type, ancestor)), o AS (SELECT DISTINCT key, owner FROM c),
ok AS (SELECT x.key, x.owner FROM o x WHERE NOT EXISTS (SELECT 1 FROM o y WHERE y.key = x.key AND y.owner <> x.owner AND NOT EXISTS (SELECT 1 FROM a WHERE a.type = y.owner AND a.ancestor = x.owner)))
SELECT k.key, m.id FROM (SELECT DISTINCT key FROM c) k LEFT JOIN (SELECT ok.key, min(id) AS id FROM ok JOIN c USING (key, owner) GROUP BY 1) m USING (key)""")
def r10_top_or_null(spark, d):
    """The same over types of which two don't inherit from each other, so many have no top."""
    size = F.col("p_size") % 3
    owner = F.when(size == 0, "left").when(size == 1, "right").otherwise("leaf")
    a = spark.createDataFrame([("leaf", "left"), ("leaf", "right")], "type string, ancestor string")
    return relate.top_declaration(read(spark, d, "part").select(F.concat("p_name", "p_type").alias("key"), owner.alias("owner"), F.col("p_partkey").alias("id")), a, "key")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_suppkey % 10 <> 0 THEN l_suppkey END AS l_suppkey FROM lineitem")
def sk2_remove_and_null_targets(spark, d):
    gone = read(spark, d, "supplier").filter("s_suppkey % 10 = 0").select(F.col("s_suppkey").alias("id"))
    return relate.null_targets(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), gone, "l_suppkey")


@query("SELECT doc_id, CASE WHEN lang = 'fr' THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents WHERE source <> 'src1' OR lang = 'fr'")
def sk1_replace_rows(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "n_chars", "lang", "source")
    new = docs.filter("lang = 'fr'").withColumn("n_chars", F.col("n_chars") + 1)
    return relate.replace_rows(docs, new, docs.filter("source = 'src1'").select("doc_id"), "doc_id").select("doc_id", "n_chars")


@query("SELECT o_orderkey || ',' || o_orderstatus || ',' || o_orderpriority AS line FROM orders")
def sk4_csv_lines(spark, d):
    return sinks.csv_lines(read(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"))


@query("SELECT CAST(floor(k / 500) AS BIGINT) AS batch, count(*) AS n, min(p_partkey) AS first FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS k FROM part) GROUP BY 1")
def sk9_batches(spark, d):
    """Places by partition sizes, so no task holds all rows."""
    rows = read(spark, d, "part").select("p_partkey").repartitionByRange(4, "p_partkey").sortWithinPartitions("p_partkey").withColumn("part", F.spark_partition_id())
    sizes = rows.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    placed = rows.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("p_partkey")) - 1).join(sizes, "part").withColumn("k", F.col("k") + F.col("before"))
    return placed.groupBy(F.floor(F.col("k") / 500).alias("batch")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


@query(f"""{BASE}, r AS (SELECT src AS id, count(*) AS rank FROM uses GROUP BY 1), o AS (SELECT n.id, sum(length(name) + 8) OVER w AS spent, row_number() OVER w AS place FROM nodes n JOIN r USING (id) WINDOW w AS (ORDER BY rank DESC, qualified_name, id ROWS UNBOUNDED PRECEDING))
SELECT id, CAST(spent AS BIGINT) AS spent, place FROM o WHERE spent <= 4000""")
def s9_repo_map(spark, d):
    ranks = b.uses(spark, d).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("rank"))
    symbols = b.nodes(spark, d).select("id", "kind", "name", "qualified_name", F.col("name").alias("signature"), F.lit(True).alias("exported"), F.lit("").alias("path"))
    return pack.repo_map(symbols, ranks).select("id", "spent", "place")


@query()
def s7_packed_context(spark, d):
    symbols = b.nodes(spark, d).filter("kind <> 'field'").select("id", "kind", "name", "qualified_name", F.col("name").alias("signature"), F.lit(None).cast("string").alias("doc"), F.col("kind").alias("path"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), "parent_id", F.length("qualified_name").cast("long").alias("chars"), F.lit(False).alias("test"))
    edges = cut(graph.weighted(b.uses(spark, d)))  # read four times
    ranks = edges.groupBy(F.col("dst").alias("id")).agg(F.sum("n").cast("double").alias("rank"))
    return pack.context(symbols, spark.createDataFrame([(SUPPLIER + 1,)], "id long"), edges, ranks)


@query("SELECT round(median(n_chars), 4) AS med, round(avg(n_chars), 4) AS mean, round(exp(avg(ln(n_chars))), 4) AS geo FROM documents WHERE n_chars > 0")
def s13_median_mean_geometric(spark, d):
    return read(spark, d, "documents").filter("n_chars > 0").agg(F.round(F.median("n_chars"), 4).alias("med"), F.round(F.avg("n_chars"), 4).alias("mean"), F.round(F.exp(F.avg(F.log("n_chars"))), 4).alias("geo"))


@query("SELECT page_id, replace(q, '\"', '') AS literal FROM (SELECT page_id, regexp_extract(html, 'href=(\"[^\"]*\")', 1) AS q FROM pages)")
def f2_string_literal(spark, d):
    return read(spark, d, "pages").select("page_id", text.unquote(F.regexp_extract("html", 'href=("[^"]*")', 1)).alias("literal"))


@query("SELECT count(*) AS n FROM documents WHERE text LIKE '%\\%%' ESCAPE '\\'")
def f3_escaped_like(spark, d):
    return read(spark, d, "documents").filter(F.col("text").like(f"%{search.escape_like('%')}%")).agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN CAST(s // 60 AS VARCHAR) || ' min ago' WHEN s < 86400 THEN CAST(s // 3600 AS VARCHAR) || ' h ago' ELSE CAST(s // 86400 AS VARCHAR) || ' days ago' END AS age FROM (SELECT event_id, CAST(epoch(TIMESTAMP '2024-02-01') - floor(epoch(ts)) AS BIGINT) AS s FROM events)")
def f5_age(spark, d):
    seconds = F.unix_timestamp(F.lit("2024-02-01").cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))
    return read(spark, d, "events").select("event_id", text.age(seconds).alias("age"))


@query("SELECT page_id, coalesce(nullif(regexp_extract(url, '//([^/]+)', 1), '') || '.', '') || page_id AS name FROM pages")
def f14_external_name(spark, d):
    return read(spark, d, "pages").select("page_id", text.external_name(F.regexp_extract("url", "//([^/]+)", 1), F.col("page_id").cast("string")).alias("name"))


@query("SELECT p_partkey, round(sqrt(p_size), 6) AS weight, round(power(0.5, p_size % 4), 6) AS decay, CAST(ceil(p_size / 4.0) AS BIGINT) AS tokens FROM part")
def f15_numbers(spark, d):
    return read(spark, d, "part").select("p_partkey", F.round(F.sqrt("p_size"), 6).alias("weight"), F.round(F.pow(F.lit(0.5), F.col("p_size") % 4), 6).alias("decay"), text.token_estimate(F.col("p_size")).alias("tokens"))


@query("SELECT doc_id, CASE WHEN starts_with(p, 'src3/') THEN substr(p, 6) ELSE p END AS path FROM (SELECT doc_id, source || '/' || lang || '/' || doc_id AS p FROM documents)")
def f17_relative_path(spark, d):
    return read(spark, d, "documents").select("doc_id", text.relative_path(F.concat_ws("\\", "source", "lang", F.col("doc_id").cast("string")), "src3").alias("path"))


@query("SELECT doc_id, CAST(length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) AS BIGINT) AS units FROM documents")
def f_utf16_length(spark, d):
    return read(spark, d, "documents").select("doc_id", text.utf16_length(F.col("text")).alias("units"))


@query("SELECT page_id, CASE regexp_extract(path, '(\\.[^./]*)$', 1) WHEN '.py' THEN 'python' WHEN '.ts' THEN 'typescript' WHEN '.java' THEN 'java' WHEN '.cs' THEN 'csharp' END AS language FROM (SELECT page_id, url || (CASE page_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.java' WHEN 3 THEN '.cs' ELSE '.md' END) AS path FROM pages)")
def sc4_language(spark, d):
    end = F.element_at(F.array(*map(F.lit, (".py", ".ts", ".java", ".cs", ".md"))), (F.col("page_id") % 5 + 1).cast("int"))
    return read(spark, d, "pages").select("page_id", paths.language(F.concat("url", end)).alias("language"))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def x_event_windows(spark, d):
    return watch.event_windows(read(spark, d, "events")).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e) SELECT user_id, count(DISTINCT k) AS sessions, count(*) AS n FROM s GROUP BY user_id")
def x_sessions(spark, d):
    return watch.sessions(read(spark, d, "events")).groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))


@query("SELECT event_type AS arm, count(*) AS runs, count(*) FILTER (WHERE value < 50) AS passes, round(median(value), 4) AS wall FROM events GROUP BY 1")
def b6_arm_totals(spark, d):
    runs = read(spark, d, "events").select(F.col("event_type").alias("arm"), F.lit("all").alias("task"), (F.col("value") < 50).alias("passed"), F.col("value").alias("wall"))
    return analytics.arm_report(runs, "wall").select("arm", "runs", "passes", F.round("wall", 4).alias("wall"))
