"""Search: BM25, ranked prefix search, filters for browsing, paging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def prefix_scores(df: DataFrame, id: str, columns: dict[str, float], terms: list[str]) -> DataFrame:
    """``df`` with ``hits``: for each term that a word of the row begins with ``(q, score)``, by BM25 with the columns' weights.

    A term is counted in the row's own words, so nothing is shuffled but the
    sums over all rows (their number, mean length, and rows with each term).
    """
    asked = list(dict.fromkeys(t.lower() for t in terms))
    words = {c: tokens(F.col(c)) for c in columns}
    size = reduce(lambda x, y: x + y, (F.size(w) for w in words.values()))
    tf = lambda t: reduce(lambda x, y: x + y, (F.size(F.filter(words[c], lambda x: x.startswith(t))) * F.lit(float(n)) for c, n in columns.items()))
    rows = df.withColumn("__len", size).withColumn("__tf", F.array(*map(tf, asked)))
    total = rows.agg(F.count_if(F.col("__len") > 0).alias("__n"), F.avg(F.when(F.col("__len") > 0, F.col("__len"))).alias("__mean"), F.array(*(F.count_if(F.col("__tf")[k] > 0) for k in range(len(asked)))).alias("__df"))

    def score(k: int):
        n, tf, df = F.col("__n"), F.col("__tf")[k], F.col("__df")[k]
        idf = F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        return F.when(tf > 0, F.struct(F.lit(asked[k]).alias("q"), (idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("__len") / F.col("__mean")))).alias("score")))

    scored = rows.crossJoin(F.broadcast(total)).withColumn("hits", F.array_compact(F.array(*map(score, range(len(asked))))))  # one row
    return scored.drop("__len", "__tf", "__n", "__mean", "__df")


_WEIGHTS = {"name": 10.0, "qualified_name": 2.0}


def _order(query: Column) -> list[Column]:
    return [(F.lower("name") == query).desc(), F.lower("name").startswith(query).desc(), F.round("score", 6).desc(), F.length("qualified_name"), F.col("id")]


def ranked_prefix_search(symbols: DataFrame, query: str, limit: int = 20, kind: str | None = None, language: str | None = None) -> DataFrame:
    """Symbols that have a word beginning with each term of the query.

    Order: exact name, then name prefix (both without case), BM25 (name 10,
    qualified name 2), shorter qualified name, id.
    """
    asked = query.lower()
    terms = set(asked.split())
    found = prefix_scores(symbols, "id", _WEIGHTS, sorted(terms) or [""]).filter(F.size("hits") == max(1, len(terms)))
    for column, value in (("kind", kind), ("language", language)):
        found = found.filter(F.col(column) == value) if value else found
    return found.withColumn("score", F.aggregate("hits", F.lit(0.0), lambda s, h: s + h["score"])).drop("hits").orderBy(*_order(F.lit(asked))).limit(limit)


def best_by_prefix(symbols: DataFrame, some: DataFrame, words: list[str], most: int) -> DataFrame:
    """For each word the ``most`` best of ``some`` by :func:`ranked_prefix_search`: ``q, place, id, name, qualified_name, kind``; scores are over all ``symbols``."""
    hits = prefix_scores(symbols.select("id", "name", "qualified_name", "kind"), "id", _WEIGHTS, words).filter(F.size("hits") > 0).join(some.select("id"), "id", "left_semi").select("id", "name", "qualified_name", "kind", F.explode("hits").alias("h"))
    flat = hits.select("id", "name", "qualified_name", "kind", "h.q", "h.score").withColumn("salt", F.pmod(F.hash("id"), F.lit(64)))
    top = lambda df, *by: df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*_order(F.col("q"))))).filter(F.col("place") <= most)
    return top(top(flat, "q", "salt").drop("place"), "q").select("q", "place", "id", "name", "qualified_name", "kind")


def escape_like(text: str) -> str:
    return "".join("\\" + c if c in "%_\\" else c for c in text)


def by_name(symbols: DataFrame, name: str, limit: int = 50) -> DataFrame:
    """Symbols of this name, or whose qualified name ends in it after ``.`` or ``:`` (without case); shortest first."""
    like = escape_like(name)
    return symbols.filter((F.col("name") == name) | F.col("qualified_name").ilike(f"%.{like}") | F.col("qualified_name").ilike(f"%:{like}")).orderBy(F.length("qualified_name"), "id").limit(limit)


def any_column(df: DataFrame, text: str) -> DataFrame:
    """Rows of which any column, as text, contains ``text`` (without case)."""
    like = f"%{escape_like(text)}%"
    return df.filter(reduce(lambda a, b: a | b, (F.coalesce(F.col(c).cast("string").ilike(like), F.lit(False)) for c in df.columns)))


def page(df: DataFrame, order: list, offset: int = 0, limit: int = 100) -> tuple[DataFrame, int]:
    """A page in a total order (1,000 rows at most), and the number of all rows."""
    return df.orderBy(*order).offset(offset).limit(min(limit, 1000)), df.count()


def lookup(symbols: DataFrame, query: str) -> DataFrame:
    """The symbols of this exact qualified name; else those found by name, with ``ambiguous`` if they have several."""
    exact = symbols.filter(F.col("qualified_name") == query)
    found = exact if not exact.isEmpty() else by_name(symbols, query)
    names = F.size(F.collect_set("qualified_name").over(Window.partitionBy(F.lit(1))))
    return found.withColumn("ambiguous", names > 1)


def drop_copies(df: DataFrame, same: list[str], order: list, limit: int | None = None) -> DataFrame:
    """The best row of each group of copies, in order."""
    one = df.withColumn("__k", F.row_number().over(Window.partitionBy(*same).orderBy(*order))).filter("__k = 1").drop("__k").orderBy(*order)
    return one if limit is None else one.limit(limit)


def lines_matching(texts: DataFrame, id: str, text: str, word: str) -> DataFrame:
    """``(id, line, text)`` of the lines in which ``word`` stands as an identifier of its own."""
    plain = "".join(c if c.isalnum() or c == "_" else "\\" + c for c in word)
    lines = texts.filter(F.col(text).contains(word)).select(id, F.posexplode(F.split(text, "\n")).alias("line", "text"))
    return lines.filter(F.col("text").rlike(rf"(?<![\w$]){plain}(?![\w$])")).withColumn("line", F.col("line") + 1)
