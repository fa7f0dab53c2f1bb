"""Times the headline queries on local cores and prints one JSON line.

``tree_*`` are an index of a source tree (Python's standard library without its
tests), its ranks, a rescan without a change, and one file that changed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (sys.path[0], os.environ.get("PYTHONPATH")) if x)  # for Spark's Python workers

HEADLINE = (
    "p13_any_column_filter", "j6_anti_join", "j9_interval_overlap", "g1_closure_bfs", "g5_pagerank", "g6_weighted_graph", "g7_blast_radius", "q10_mutual", "r9_unique_or_null", "r25_merge_parts",
    "a1_global_stats", "a6_edge_lines", "s1_ranked_prefix_search", "s6_drop_copies", "f12_name_matches", "u1_client_tally", "b2_cached_cost", "b5_ratio_to_baseline", "x5_full_sync",
)


def tree_times(spark) -> tuple[dict[str, float], dict[str, int]]:
    import shutil
    import tempfile

    from pyspark.sql import functions as F

    from graphquarry.api import Index
    from graphquarry.operators import relate
    from graphquarry.sources import workspace
    from graphquarry.streaming import fresh

    folder = tempfile.mkdtemp()
    shutil.copytree(os.path.dirname(os.__file__), f"{folder}/lib", ignore=shutil.ignore_patterns("site-packages", "test", "tests", "idlelib", "lib2to3", "__pycache__", "*.so", "*.a"))
    took, began = {}, time.time()

    def lap(name: str) -> None:
        nonlocal began
        took[name], began = round(time.time() - began, 3), time.time()

    index = Index.build(spark, folder)
    lap("tree_first_index")
    index.ranks()
    lap("tree_ranks")
    relate.changes(index.files.select("path", "hash"), workspace.scan(spark, folder).select("path", "hash"), "path", "hash").filter("state <> 'unchanged'").count()
    lap("tree_rescan")
    kept = fresh.FreshIndex(spark, f"{folder}/kept", buckets=16)
    kept.apply(index.files.select("path", "content", F.lit(False).alias("deleted")), 0)
    began = time.time()
    for number, line in enumerate(("def added_here():\n    return fill('x')\n", "def added_later():\n    return added_here()\n"), 1):
        content = index.files.filter("path = 'lib/textwrap.py'").select("path", F.concat("content", F.lit(f"\n\n{line}")).alias("content"), F.lit(False).alias("deleted"))
        kept.apply(content, number)
        lap("tree_one_file")  # the second: code is compiled then
    sizes = {"files": index.files.count(), "symbols": index.symbols.count(), "uses": index.uses.count()}
    shutil.rmtree(folder)
    return took, sizes


def main() -> None:
    from pyspark.sql import SparkSession

    from graphquarry.plans import registry, more, upkeep  # noqa: F401

    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{d}/lineitem.parquet").count()
    took = {}
    for name in HEADLINE:
        began = time.time()
        registry.QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    total = round(sum(took.values()), 3)
    tree, sizes = tree_times(spark)
    print(json.dumps({"metric": "headline queries, total", "value": total, "unit": "sec", "queries": took | tree, "tree": sizes, "sf": os.path.basename(d.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
