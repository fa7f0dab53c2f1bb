"""The request operators over an index: search, outline, source, references, map, context."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import paths, text
from .operators import answers, graph, linker, pack, postings, search
from .operators.state import cut
from .sources import config, git, store, workspace
from .sources.parsers import parse_files, python_roots


@dataclass
class Index:
    """Files, symbols and linked uses of a source tree."""

    files: DataFrame
    symbols: DataFrame
    imports: DataFrame
    uses: DataFrame
    _ranks: DataFrame | None = field(default=None, repr=False)
    _words: postings.Postings | None = field(default=None, repr=False)

    @classmethod
    def build(cls, spark: SparkSession, root: str) -> Index:
        files = cut(workspace.scan(spark, root))
        packages = [r["path"] for r in files.filter(F.col("path").endswith("/__init__.py")).select("path").toLocalIterator()]
        source = [] if files.filter("startswith(path, 'src/')").isEmpty() else ["src/module"]
        symbols, imports, uses, _ = parse_files(files, python_roots(packages + source))
        modules = symbols.select("path", "module").union(imports.select("path", "module")).distinct()
        imports = cut(linker.resolve_imports(imports, symbols, modules, config.read_layout(root)))
        chars = files.select("path", F.split("content", "\n").alias("lines"))
        sized = symbols.join(chars, "path").withColumn("chars", F.length(F.array_join(F.slice("lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")).cast("long")).drop("lines").withColumn("test", paths.is_test(F.col("path")))
        return cls(files, cut(sized), imports, cut(linker.link(symbols, imports, uses)))

    def edges(self) -> DataFrame:
        return self.uses.filter("to_id is not null and from_id is not null").select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), "type", "line")

    def inherits(self) -> DataFrame:
        return self.edges().filter("type in ('extends', 'implements')").select("src", "dst")

    def modules(self) -> DataFrame:
        return self.symbols.select("path", "module").union(self.imports.select("path", "module")).distinct()

    def ranks(self) -> DataFrame:
        """Computed once; an index doesn't change."""
        if self._ranks is None:
            self._ranks = graph.pagerank(self.symbols, graph.weighted(self.edges()))
        return self._ranks

    def search_symbols(self, query: str, kind: str | None = None, language: str | None = None, limit: int = 20) -> DataFrame:
        """From an index of the symbols' words that the first request builds."""
        if self._words is None:
            self._words = postings.Postings.build(self.symbols, {"name": 10.0, "qualified_name": 2.0})
        asked = [F.col(c) == v for c, v in (("kind", kind), ("language", language)) if v]
        return self._words.search(query, min(max(limit, 1), 50), reduce(lambda a, b: a & b, asked) if asked else None)

    def exact_match(self, query: str, most_lines: int = 60) -> DataFrame:
        """The code of the only symbol of this name (or qualified name), if it is no type and short; else no row."""
        found = self.symbols.filter((F.col("name") == query.strip()) | (F.col("qualified_name") == query.strip()))
        names = found.select("qualified_name").distinct().limit(2).count()
        one = found.filter(~F.col("kind").isin(*answers.TYPE_KINDS) & (F.col("end_line") - F.col("start_line") < most_lines) & F.lit(names == 1)).orderBy("id").limit(1)
        return answers.source_blocks(one, self.files, self.symbols, most_lines)

    def file_outline(self, path: str) -> DataFrame:
        return pack.outline(self.symbols, path)

    def file_imports(self, path: str) -> DataFrame:
        return self.imports.filter(F.col("path") == path).orderBy("line").select("line", "kind", "spec", "name", "alias", "target_module")

    def symbol_source(self, query: str | list[str], max_lines: int = answers.LINES) -> DataFrame:
        """Every overload and part of up to ten names; of types that are too long the members."""
        found = None
        for name in ([query] if isinstance(query, str) else list(dict.fromkeys(query))[:answers.NAMES]):
            one = search.lookup(self.symbols, name).filter("not ambiguous").drop("ambiguous")
            found = one if found is None else found.unionByName(one)
        blocks = answers.source_blocks(found, self.files, self.symbols, min(max(max_lines, 10), 2000))
        return blocks.withColumn("source", text.reindent(F.col("source")))

    def find_references(self, query: str, depth: int = 2) -> answers.References:
        found = cut(search.lookup(self.symbols, query).filter("not ambiguous").drop("ambiguous"))
        seeing = cut(answers.seeing_files(self.symbols, self.imports, self.modules(), found.select("path")))
        return answers.references(self.symbols, self.uses, self.files.select("path", "content"), found, seeing, self.inherits(), min(max(depth, 1), 5))

    def source_with_callees(self, query: str, max_lines: int = answers.LINES) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The source of a symbol, the signatures of what it and all inside it call, and the names of calls that aren't linked."""
        called, external = self.callees(query)
        return self.symbol_source(query, max_lines), called.select("id", "qualified_name", "path", "start_line", "signature", text.first_sentence(F.col("doc")).alias("summary")), external

    def callees(self, query: str) -> tuple[DataFrame, DataFrame]:
        """What a symbol and all inside it call outside itself, and the names of calls that aren't linked."""
        return answers.callees(self.symbols, self.uses, search.lookup(self.symbols, query).select("id"))

    def repo_map(self, token_budget: int = 1000, folder: str = "") -> DataFrame:
        return pack.repo_map(self.symbols, self.ranks(), min(max(token_budget, 100), 20_000), folder)

    def get_context(self, task: str = "", seeds: list[str] = (), budget: int = 1500, depth: int = 2, changes: DataFrame | None = None) -> DataFrame:
        """Packed entries for a task: from ``seeds``, ``changes (path, low, high)``, the names in the task, and words that lead to symbols.

        Where nothing is named, those that the words lead to are the seeds.
        """
        spark, ids = self.symbols.sparkSession, []
        for name in list(seeds)[:20]:
            ids += [r["id"] for r in search.lookup(self.symbols, name).filter("not ambiguous").select("id").limit(50).collect()]
        if changes is not None:
            ids += [r["id"] for r in git.changed_symbols(self.symbols, changes).collect()]
        named, related = answers.seeds_from_task(self.symbols, self.ranks(), task)
        ids = list(dict.fromkeys([*ids, *named]))
        related = [x for x in related if x not in ids]
        if not ids:
            ids, related = related, []
        frame = lambda some: spark.createDataFrame([(x,) for x in some], "id long")
        return pack.context(self.symbols, frame(ids), self.edges(), self.ranks(), max(budget, 500) - 150, min(max(depth, 0), 3), frame(related), "test" in task.lower())

    def context_text(self, entries: DataFrame) -> DataFrame:
        """The entries of :meth:`get_context` with their headers, docs and code."""
        return pack.with_text(entries, self.symbols, self.files)

    def stale(self, now: DataFrame) -> DataFrame:
        """``(path, stale)`` against the files as they are now (``path, hash``)."""
        return store.stale(self.files, now)

    def save(self, root: str) -> str:
        return store.save(root, files=self.files, symbols=self.symbols, imports=self.imports, uses=self.uses)

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Index:
        """The index kept at ``root``; refused if there is none, or one of another version."""
        return cls(**{n: t for n, t in store.open_tables(spark, root).items() if n in store.TABLES})
