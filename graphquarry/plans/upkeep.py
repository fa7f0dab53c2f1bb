"""Named queries of maintenance, answers and stored queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import analytics, answers, receivers, relate, relink
from ..operators.state import shared_folder
from ..sources import benchmarks, graphdb, merge, store
from . import bindings as b
from .bindings import read
from .registry import BASE, FULL, query

_FILES = "files AS (SELECT source || '/' || lang || '/' || doc_id AS path, sha1(text) AS hash, lang, doc_id FROM documents)"


def _files(spark, d):
    return read(spark, d, "documents").select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), F.sha1("text").alias("hash"), "lang", "doc_id")


@query(f"WITH {_FILES}, scan AS (SELECT path || (CASE WHEN lang = 'de' THEN 'x' ELSE '' END) AS path, hash FROM files WHERE lang <> 'fr') SELECT path, hash FROM files WHERE NOT starts_with(path, 'src3/') UNION ALL SELECT path, hash FROM scan WHERE starts_with(path, 'src3/')")
def sc10_refresh_tree(spark, d):
    files = _files(spark, d)
    scan = files.filter("lang <> 'fr'").select(F.concat("path", F.when(F.col("lang") == "de", "x").otherwise("")).alias("path"), "hash")
    return store.refresh_tree(files.select("path", "hash"), scan, "src3")


@query(f"WITH {_FILES} SELECT path, CASE WHEN lang = 'fr' THEN NULL ELSE lang = 'de' END AS stale FROM files")
def x8_stale_files(spark, d):
    files = _files(spark, d)
    now = files.filter("lang <> 'fr'").select("path", F.when(F.col("lang") == "de", "0").otherwise(F.col("hash")).alias("hash"))
    return store.stale(files.select("path", "hash"), now)


@query(f"WITH {_FILES} SELECT path, hash, CAST(CASE WHEN starts_with(path, 'src3/') THEN 3 WHEN lang = 'de' THEN 1 ELSE 0 END AS BIGINT) AS batch FROM files WHERE NOT starts_with(path, 'src3/') AND lang <> 'fr' OR starts_with(path, 'src3/') AND doc_id % 2 = 0")
def x4_merge_on_read(spark, d):
    """A table of files through four batches: all; German ones anew and French ones gone; a folder gone, which is compacted; half of the folder again."""
    files = _files(spark, d)
    kept = merge.MergeStore(spark, f"{shared_folder(spark)}/merge-{uuid.uuid4().hex}", {"files": "path string, hash string, batch long"}, buckets=16, most_deltas=2)
    batches = [(files, files), (files.filter("lang = 'de'"), files.filter("lang in ('de', 'fr')")), (files.filter("false"), files.filter("false"))]
    batches.append((files.filter("startswith(path, 'src3/') and doc_id % 2 = 0"), files.filter("startswith(path, 'src3/') and doc_id % 2 = 0")))
    for k, (rows, paths) in enumerate(batches):
        kept.commit(k, {"files": (rows.select("path", "hash", F.lit(k).cast("long").alias("batch")), paths.select("path"))}, ["src3/"] if k == 2 else [])
    return kept.read("files")


_IMPORTS = "imports AS (SELECT DISTINCT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, CAST(l_suppkey AS VARCHAR) AS path, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(l_partkey % 200 AS VARCHAR) END AS target_path, CASE WHEN l_linenumber = 3 THEN 'space' END AS target_space FROM lineitem)"


def _imports(spark, d):
    line = F.col("l_linenumber")
    return read(spark, d, "lineitem").select(F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))).alias("id"), F.col("l_suppkey").cast("string").alias("path"), F.when(line % 3 != 0, (F.col("l_partkey") % 200).cast("string")).alias("target_path"), F.when(line == 3, "space").alias("target_space")).distinct()


@query(f"WITH {_IMPORTS}, changed AS (SELECT CAST(s_suppkey AS VARCHAR) AS path FROM supplier WHERE s_acctbal > 8000) SELECT id, path FROM imports WHERE path IN (SELECT path FROM changed) OR target_path IN (SELECT path FROM changed) OR (target_path IS NULL AND target_space IS NULL)")
def r23_imports_to_resolve(spark, d):
    changed = read(spark, d, "supplier").filter("s_acctbal > 8000").select(F.col("s_suppkey").cast("string").alias("path"))
    return relink.imports_to_resolve(_imports(spark, d), changed).select("id", "path")


@query(f"WITH {_IMPORTS} SELECT DISTINCT path FROM imports WHERE target_path = '7' OR (target_path IS NULL AND target_space IS NOT NULL AND CAST(path AS BIGINT) % 2 = 0)")
def r24_changed_meaning(spark, d):
    """Imports of file 7 no longer resolve, and those of the namespace now do in files of even number."""
    before = _imports(spark, d)
    after = before.withColumn("target_path", F.when(F.col("target_path") == "7", None).when(F.col("target_space").isNotNull() & (F.col("path").cast("long") % 2 == 0), "new").otherwise(F.col("target_path")))
    return relink.changed_meaning(before, after, ["path", "id"], ["target_path", "target_space"])


@query("WITH u AS (SELECT DISTINCT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag) AS id, l_suppkey AS path, l_partkey % 50 AS name, CASE WHEN l_returnflag <> 'R' THEN l_partkey END AS to_id FROM lineitem) SELECT id FROM u WHERE path % 17 = 0 OR to_id IN (SELECT p_partkey FROM part WHERE p_size = 7) OR (to_id IS NULL AND path % 3 = 0 AND name IN (4, 9))")
def r26_uses_to_resolve(spark, d):
    uses = read(spark, d, "lineitem").select(F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))).alias("id"), F.col("l_suppkey").alias("path"), (F.col("l_partkey") % 50).alias("name"), F.when(F.col("l_returnflag") != "R", F.col("l_partkey")).alias("to_id")).distinct()
    paths = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("path")).distinct()
    into = read(spark, d, "part").filter("p_size = 7").select(F.col("p_partkey").alias("id"))
    names = spark.range(50).filter("id in (4, 9)").select(F.col("id").alias("name"))
    return relink.uses_to_resolve(uses, paths.filter("path % 17 = 0"), into, paths.filter("path % 3 = 0"), names).select("id")


@query("SELECT p_name AS name, p_partkey AS id, place FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY (p_size % 5 = 0) DESC, p_retailprice DESC, p_partkey) AS place FROM part) WHERE place <= 3")
def s11_best_of_name(spark, d):
    part = read(spark, d, "part")
    symbols = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 5 == 0, "class").otherwise("method").alias("kind"))
    return answers.best_of_name(symbols, part.select(F.col("p_partkey").alias("id"), F.col("p_retailprice").cast("double").alias("rank")), "name", 3).select("name", "id", "place")


@query(f"{BASE} SELECT n.id, t.id AS type FROM nodes n JOIN nodes t ON t.id = n.parent_id WHERE n.kind = 'method' UNION ALL SELECT n.id, r.id FROM nodes n JOIN nodes t ON t.id = n.parent_id JOIN nodes r ON r.id = t.parent_id WHERE n.kind = 'function'")
def r4_type_path(spark, d):
    """Suppliers name their nation by its qualified name, customers their region by its own."""
    n = b.nodes(spark, d)
    types = n.filter("kind in ('class', 'namespace')")
    lookup = receivers.Types(
        types.filter("kind = 'namespace'").select(F.lit("customers").alias("path"), F.col("name").alias("local"), "id"), spark.createDataFrame([], "owner long, holder long, depth int"),
        spark.createDataFrame([], "holder long, name string, kind string, id long, qualified_name string"), types.select("qualified_name", F.lit("java").alias("language"), "id"),
    )
    place = F.substring_index("qualified_name", ".", 2)
    asked = n.filter("kind in ('method', 'function')").select(F.col("id").alias("key"), F.when(F.col("kind") == "method", "suppliers").otherwise("customers").alias("path"), F.lit("java").alias("language"), F.when(F.col("kind") == "method", place).otherwise(F.substring_index("qualified_name", ".", 1)).alias("dotted"))
    return lookup.path(asked).select(F.col("key").alias("id"), F.col("id").alias("type"))


@query("SELECT run, n_name AS task, place, list_extract(['x', 'y', 'z'], CAST((place - (run + n_nationkey) % 3 + 3) % 3 + 1 AS INTEGER)) AS arm FROM nation, (SELECT unnest([1, 2]) AS run), (SELECT unnest([0, 1, 2]) AS place)")
def b7_arm_rotation(spark, d):
    return benchmarks.rotation(read(spark, d, "nation").select(F.col("n_nationkey").alias("number"), F.col("n_name").alias("task")), ["x", "y", "z"], 2)


@query("SELECT p_partkey, p_size || '-' || (p_size + 3) || ' ' || CASE WHEN p_partkey % 2 = 0 THEN CASE WHEN p_partkey % 4 = 0 THEN 'class ' || p_name ELSE 'def ' || p_name END ELSE 'method ' || p_name END AS header FROM part")
def f6_entry_header(spark, d):
    n = F.col("p_partkey") % 4
    kind = F.when(n == 0, "class").when(n == 2, "function").otherwise("method")
    signature = F.when(n == 0, F.concat(F.lit("class "), "p_name")).when(n == 2, F.concat(F.lit("def "), "p_name")).otherwise(F.col("p_name"))
    return read(spark, d, "part").select("p_partkey", text.entry_header(kind, F.col("p_name"), signature, F.col("p_size"), F.col("p_size") + 3, F.when(n % 2 == 0, 2).otherwise(1)).alias("header"))


@query(f"{BASE} SELECT id, CASE WHEN ends_with(qualified_name, name) THEN substr(qualified_name, 1, length(qualified_name) - length(name)) ELSE '' END AS prefix FROM nodes")
def f8_qualified_prefix(spark, d):
    return b.nodes(spark, d).select("id", text.qualified_prefix(F.col("qualified_name"), F.col("name")).alias("prefix"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'Copilot' WHEN 'view' THEN 'Copilot' ELSE event_type END AS client FROM events")
def f16_client_names(spark, d):
    raw = F.when(F.col("event_type") == "click", "Visual Studio Code").when(F.col("event_type") == "view", "Visual Studio Code - Insiders").otherwise(F.col("event_type"))
    return read(spark, d, "events").select("event_id", text.client_name(raw).alias("client"))


@query("SELECT o_orderkey, format('{:,}', CAST(o_orderkey * 1000 + o_custkey AS BIGINT)) AS shown FROM orders")
def f20_grouped_numbers(spark, d):
    return read(spark, d, "orders").select("o_orderkey", text.grouped((F.col("o_orderkey") * 1000 + F.col("o_custkey")).cast("long")).alias("shown"))


@query(f"{FULL} SELECT a.name AS file, c.name AS imports FROM nation_uses u JOIN nodes a ON a.id = u.src JOIN nodes c ON c.id = u.dst")
def q9_imports(spark, d):
    names = b.nodes(spark, d).filter("kind = 'class'").select("id", "name")
    edges = b.nation_uses(spark, d).select("src", "dst")
    return edges.join(names.toDF("src", "file"), "src").join(names.toDF("dst", "imports"), "dst").select("file", "imports")


_STORED = "stored AS (SELECT c_mktsegment AS app, c_name AS name, CAST(c_custkey AS INTEGER) AS n FROM customer)"


def _stored(spark, d):
    return read(spark, d, "customer").select(F.col("c_mktsegment").alias("app"), F.col("c_name").alias("name"), F.col("c_custkey").cast("int").alias("order"))


@query(f"WITH {_STORED} SELECT app, name, n FROM stored ORDER BY app, n")
def q14_list_queries(spark, d):
    return graphdb.list_queries(_stored(spark, d)).withColumnRenamed("order", "n")


@query(f"WITH {_STORED} SELECT app, name, n FROM stored WHERE app <> 'BUILDING' UNION ALL SELECT 'BUILDING', s_name, CAST(s_suppkey AS INTEGER) FROM supplier")
def q16_upsert_queries(spark, d):
    new = read(spark, d, "supplier").select(F.lit("BUILDING").alias("app"), F.col("s_name").alias("name"), F.col("s_suppkey").cast("int").alias("order"))
    return graphdb.upsert_queries(_stored(spark, d), new).withColumnRenamed("order", "n")


@query(f"{BASE} SELECT DISTINCT u.dst AS id FROM uses u WHERE u.src = {b.CUSTOMER + 1} ORDER BY 1 LIMIT 40")
def t7_callees(spark, d):
    n = b.nodes(spark, d).withColumn("path", F.lit("p")).withColumn("start_line", F.lit(1))
    uses = b.uses(spark, d).select(F.lit("calls").alias("type"), F.col("src").alias("from_id"), F.col("dst").alias("to_id"), F.lit("x").alias("name"))
    return answers.callees(n, uses, spark.createDataFrame([(b.CUSTOMER + 1,)], "id long"), 40)[0].select("id")


_SYMBOLS = "symbols AS (SELECT p_partkey AS id, p_type AS kind, p_name AS name, p_brand || '.' || p_name AS qualified_name, p_brand AS namespace, p_name || '()' AS signature, CAST(NULL AS VARCHAR) AS doc, p_size AS start_line, p_size + 4 AS end_line, p_size > 25 AS exported, p_size % 7 = 0 AS is_partial, CAST(length(p_name) AS BIGINT) AS chars, CASE WHEN p_partkey > 20 THEN p_partkey % 20 + 1 END AS parent_id, 'f' || p_partkey % 9 AS path, p_size % 9 AS file_id FROM part)"


def _symbols(spark, d):
    key, size = F.col("p_partkey"), F.col("p_size")
    return read(spark, d, "part").select(
        key.alias("id"), F.col("p_type").alias("kind"), F.col("p_name").alias("name"), F.concat_ws(".", "p_brand", "p_name").alias("qualified_name"), F.col("p_brand").alias("namespace"), F.concat("p_name", F.lit("()")).alias("signature"), F.lit(None).cast("string").alias("doc"),
        size.alias("start_line"), (size + 4).alias("end_line"), (size > 25).alias("exported"), (size % 7 == 0).alias("is_partial"), F.length("p_name").cast("long").alias("chars"), F.when(key > 20, key % 20 + 1).alias("parent_id"), F.concat(F.lit("f"), (key % 9).cast("string")).alias("path"), (size % 9).alias("file_id"),
    )


@query(f"WITH {_SYMBOLS} SELECT id, kind, name, qualified_name, namespace, signature, doc, start_line, end_line, exported, is_partial, chars, parent_id, n_name AS path, r_name AS language FROM symbols JOIN nation ON n_nationkey = file_id JOIN region ON r_regionkey = n_regionkey")
def p1_all_columns(spark, d):
    nation, region = read(spark, d, "nation"), read(spark, d, "region")
    files = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("path"), F.col("r_name").alias("language"))
    return relate.symbol_projection(_symbols(spark, d), files)


@query(f"""WITH {_SYMBOLS} SELECT 'all' AS shape, count(*) AS n FROM symbols UNION ALL SELECT 'name', count(*) FROM symbols WHERE name = 'red widget' UNION ALL SELECT 'parents', count(*) FROM symbols WHERE parent_id IN (3, 4)
UNION ALL SELECT 'name in parents', count(*) FROM symbols WHERE parent_id IN (3, 4) AND name = 'red widget' UNION ALL SELECT 'file', count(*) FROM symbols WHERE path = 'f3' AND name = 'red widget' UNION ALL SELECT 'namespace', count(*) FROM symbols WHERE namespace = 'Brand#11'
UNION ALL SELECT 'ids', count(*) FROM symbols WHERE id IN (3, 4)""")
def p8_slim_shapes(spark, d):
    s, ids = _symbols(spark, d), spark.createDataFrame([(3,), (4,)], "id long")
    shapes = {"all": {}, "name": {"name": "red widget"}, "parents": {"parents": ids}, "name in parents": {"parents": ids, "name": "red widget"}, "file": {"path": "f3", "name": "red widget"}, "namespace": {"namespace": "Brand#11"}, "ids": {"ids": ids}}
    out = None
    for shape, by in shapes.items():
        one = relate.slim_refs(s, **by).agg(F.count("*").alias("n")).select(F.lit(shape).alias("shape"), "n")
        out = one if out is None else out.union(one)
    return out


@query("WITH m AS (SELECT p_partkey AS id, min(p_partkey) OVER (PARTITION BY p_name, p_brand) AS whole FROM part) SELECT a.id, b.id AS part FROM m a JOIN m b USING (whole) WHERE a.id % 10 = 3")
def g12_type_parts(spark, d):
    merged = relate.merge_parts(read(spark, d, "part"), ["p_name", "p_brand"], "p_partkey").select(F.col("p_partkey").alias("id"), "merged_into")
    return relate.type_parts(merged, merged.filter("id % 10 = 3").select("id"))


@query("WITH m AS (SELECT p_partkey AS id, min(p_partkey) OVER (PARTITION BY p_name, p_brand) AS whole FROM part), h AS (SELECT p_partkey AS src, p_partkey % 40 + 1 AS dst FROM part) SELECT DISTINCT a.id, t.whole AS base FROM m a JOIN m b USING (whole) JOIN h ON h.src = b.id JOIN m t ON t.id = h.dst WHERE a.id % 10 = 3")
def g12_base_types(spark, d):
    merged = relate.merge_parts(read(spark, d, "part"), ["p_name", "p_brand"], "p_partkey").select(F.col("p_partkey").alias("id"), "merged_into")
    inherits = merged.select(F.col("id").alias("src"), (F.col("id") % 40 + 1).alias("dst"))
    return relate.base_types(relate.type_parts(merged, merged.filter("id % 10 = 3").select("id")), inherits, merged)


@query(f"""{BASE}, t AS (SELECT parent_id AS id, count(*) AS n FROM uses JOIN nodes ON nodes.id = dst GROUP BY 1), m AS (SELECT dst AS id, count(*) AS n FROM uses GROUP BY 1), c AS (SELECT src AS id, count(DISTINCT dst) AS n FROM uses GROUP BY 1)
SELECT (SELECT name FROM t JOIN nodes USING (id) ORDER BY n DESC, id LIMIT 1) AS type, (SELECT name FROM m JOIN nodes USING (id) ORDER BY n DESC, id LIMIT 1) AS method, (SELECT name FROM c JOIN nodes USING (id) ORDER BY n DESC, id LIMIT 1) AS caller,
(SELECT source || '/' || doc_id FROM documents ORDER BY n_chars DESC, source || '/' || doc_id LIMIT 1) AS file""")
def a8_starter_examples(spark, d):
    files = read(spark, d, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("chars"))
    return answers.starter_examples(b.nodes(spark, d), b.uses(spark, d), files)


@query("SELECT event_type AS arm, count(*) AS runs, round(avg(value / 100), 6) AS recall, CAST(sum(event_id % 3) AS BIGINT) AS false_positives, count(*) FILTER (WHERE value < 50) AS passed, count(*) FILTER (WHERE event_id % 4 > 0) AS used, CAST(sum(event_id % 4) AS BIGINT) AS tool_calls, round(median(value), 4) AS wall, count(*) FILTER (WHERE event_id % 5 = 0) AS warm, count(*) FILTER (WHERE event_id % 11 = 0) AS errors FROM events GROUP BY 1")
def b6_all_measures(spark, d):
    e = F.col("event_id")
    runs = read(spark, d, "events").select(F.col("event_type").alias("arm"), (F.col("value") / 100).alias("recall"), (e % 3).alias("false_positives"), (F.col("value") < 50).alias("passed"), (e % 4).alias("tool_calls"), F.col("value").alias("wall"), (e % 5 == 0).alias("warm"), F.when(e % 11 == 0, "x").alias("error"))
    return analytics.arm_totals(runs).withColumn("recall", F.round("recall", 6)).withColumn("wall", F.round("wall", 4)).withColumn("false_positives", F.col("false_positives").cast("long")).withColumn("tool_calls", F.col("tool_calls").cast("long"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '/root/' || source || '/' || lang WHEN 1 THEN '/root/' || lang WHEN 2 THEN NULL ELSE '/root/x' END AS path FROM documents")
def p18_confined_paths(spark, d):
    k = F.col("doc_id") % 4
    given = F.when(k == 0, F.concat_ws("/", F.lit("."), "source", "lang")).when(k == 1, F.concat(F.lit("a/b/../../"), F.col("lang"))).when(k == 2, F.lit("../rooted/x")).otherwise(F.lit("/root/y/../x/"))
    return read(spark, d, "documents").select("doc_id", paths.confined(given, "/root").alias("path"))
