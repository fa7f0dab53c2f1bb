"""Command line: ``python -m graphquarry {stats,search,outline,references,map,export} TREE [ARGUMENT]``."""

from __future__ import annotations

import argparse


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="graphquarry")
    parser.add_argument("command", choices=("stats", "search", "outline", "source", "references", "map", "export"))
    parser.add_argument("tree")
    parser.add_argument("argument", nargs="?", default="")
    args = parser.parse_args(argv)
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .api import Index

    spark = SparkSession.builder.appName("graphquarry").getOrCreate()
    index = Index.build(spark, args.tree)
    if args.command == "stats":
        index.files.groupBy("language").agg(F.count("*").alias("files"), F.sum("chars").alias("chars")).show()
        index.uses.agg(F.count("*").alias("uses"), F.count("to_id").alias("linked")).show()
    elif args.command == "search":
        index.search_symbols(args.argument).select("kind", "qualified_name", "path", "start_line").show(50, False)
    elif args.command == "outline":
        index.file_outline(args.argument).show(1000, False)
    elif args.command == "source":
        for row in index.symbol_source(args.argument).toLocalIterator():
            print(f"{row['path']}:{row['start_line']}\n{row['source']}\n")
    elif args.command == "references":
        found = index.find_references(args.argument)
        for table in (found.uses, found.other, found.callers.select("level", "qualified_name", "path", "start_line"), found.unlinked):
            table.show(100, False)
    elif args.command == "map":
        index.repo_map().select("path", "signature").show(200, False)
    else:
        from .operators.graph import uses_with_lines
        from .sources.sinks import export_graph

        edges = index.edges()
        lines = [uses_with_lines(edges.filter(F.col("type") == t)).withColumn("type", F.lit(t)) for t in ("calls", "extends", "implements", "references")]
        export_graph(index.symbols.select("id", "kind", "name", "qualified_name", "path"), lines[0].union(lines[1]).union(lines[2]).union(lines[3]), args.argument, "app", args.tree)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
