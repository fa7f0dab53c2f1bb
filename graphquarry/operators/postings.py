"""A stored inverted index: postings in range partitions, a dictionary of prefixes, rows by id.

A request for words that begin with some terms opens the partitions that hold
those words, skips the row groups outside them, and looks up how many rows each
prefix has; it never passes over all rows.
"""

from __future__ import annotations

import json
import math
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .search import B, K1, tokens
from .state import at_once, shared_folder

#: Postings of a partition, about; rows of a row group, so that a range of words reads few.
SHARD_ROWS, GROUP_ROWS = 4_000_000, 20_000
#: Letters of a prefix that the dictionary counts; rows with longer ones are counted in the postings.
PREFIX = 24
LAST = chr(0x10FFFF)


class Postings:
    """The index of one version of a table; ``note`` says where its parts lie and what ranges they hold."""

    def __init__(self, spark: SparkSession, note: dict):
        self.spark, self.note = spark, note

    @classmethod
    def build(cls, rows: DataFrame, weights: dict[str, float], id: str = "id", root: str | None = None, shards: int | None = None) -> Postings:
        """Index the words of some columns of ``rows``, weighted; the first column of ``weights`` is the name that hits are ranked by."""
        spark = rows.sparkSession
        where = f"{root or shared_folder(spark)}/postings-{uuid.uuid4().hex}"
        rows = rows.withColumnRenamed(id, "id")
        rows.repartitionByRange("id").sortWithinPartitions("id").write.option("parquet.block.row.count.limit", GROUP_ROWS).parquet(f"{where}/rows")
        held = spark.read.schema(rows.schema).parquet(f"{where}/rows")
        weighed = lambda c, w: F.transform(tokens(F.col(c)), lambda t: F.struct(t.alias("term"), F.lit(float(w)).alias("w")))
        words = F.concat(*(weighed(c, w) for c, w in weights.items()))
        name, *others = weights
        worded = held.select("id", F.lower(name).alias("name"), F.length(others[-1] if others else name).alias("length"), words.alias("words")).withColumn("size", F.size("words")).filter("size > 0")
        total = worded.agg(F.count("*"), F.avg("size"), F.sum("size")).first()
        shards = shards or max(1, -(-int(total[2] or 0) // SHARD_ROWS))
        flat = worded.select("id", "name", "length", "size", F.explode("words").alias("x")).groupBy("id", "x.term").agg(F.sum("x.w").alias("tf"), F.first("name").alias("name"), F.first("length").alias("length"), F.first("size").alias("size"))
        prefixes = F.array_distinct(F.flatten(F.transform("words", lambda x: F.transform(F.sequence(F.lit(1), F.least(F.length(x["term"]), F.lit(PREFIX))), lambda k: F.substring(x["term"], F.lit(1), k)))))
        counted = worded.select(F.explode(prefixes).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("df"))

        sharded = lambda df: StructType([*df.schema.fields, StructField("shard", IntegerType())])

        def ranged(df: DataFrame, name: str, *key: str) -> list:
            # a word of very many rows goes on in the next partition, as the id cuts ranges, too
            df.repartitionByRange(shards, *key).sortWithinPartitions(*key).withColumn("shard", F.spark_partition_id()).write.option("parquet.block.row.count.limit", GROUP_ROWS).partitionBy("shard").parquet(f"{where}/{name}")
            ends = spark.read.schema(sharded(df)).parquet(f"{where}/{name}").groupBy("shard").agg(F.min(key[0]), F.max(key[0])).collect()
            return sorted([r[0], r[1], r[2]] for r in ends)

        bounds = at_once(lambda: ranged(flat, "postings", "term", "id"), lambda: ranged(counted, "prefixes", "prefix"))
        note = {"at": where, "rows": total[0], "mean": total[1] or 1.0, "postings": bounds[0], "prefixes": bounds[1], "schema": {"rows": rows.schema.json(), "postings": sharded(flat).json(), "prefixes": sharded(counted).json()}}
        return cls(spark, note)

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(json.loads(self.note["schema"][name]))).parquet(f"{self.note['at']}/{name}")

    def shards(self, name: str, low: str, high: str) -> list[int]:
        """Partitions whose words meet a range."""
        return [shard for shard, a, b in self.note[name] if a <= high and low <= b]

    def frequencies(self, terms: list[str]) -> dict[str, int]:
        """Rows that have a word beginning with each term."""
        asked = [t for t in terms if t and len(t) <= PREFIX]
        shards = sorted({s for t in asked for s in self.shards("prefixes", t, t)})
        out = dict.fromkeys(terms, 0)
        if asked and shards:
            out |= {r["prefix"]: r["df"] for r in self._read("prefixes").filter(F.col("shard").isin(shards) & F.col("prefix").isin(asked)).collect()}
        for t in terms:
            if not t:
                out[t] = self.note["rows"]
            elif len(t) > PREFIX:
                out[t] = self.postings(t).select("id").distinct().count()
        return out

    def postings(self, term: str) -> DataFrame:
        """Postings of the words that begin with ``term``, from the partitions and row groups that can have some."""
        high = term + LAST
        some = self._read("postings").filter(F.col("shard").isin(self.shards("postings", term, high)))
        return some.filter((F.col("term") >= term) & (F.col("term") <= high) & F.col("term").startswith(term))

    def scores(self, terms: list[str]) -> DataFrame:
        """``(id, name, length, score)`` of the rows that have words beginning with each term, by BM25."""
        found, n = self.frequencies(terms), self.note["rows"]
        parts = []
        for term in terms:
            df = found[term]
            idf = max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6) if df else 0.0
            sums = self.postings(term).groupBy("id").agg(F.sum("tf").alias("tf"), F.first("size").alias("size"), F.first("name").alias("name"), F.first("length").alias("length"))
            parts.append(sums.select("id", "name", "length", (F.lit(idf) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.lit(self.note["mean"])))).alias("score")))
        if len(parts) == 1:
            return parts[0]
        every = reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.first("name").alias("name"), F.first("length").alias("length"), F.sum("score").alias("score"), F.count("*").alias("n"))
        return every.filter(F.col("n") == len(terms)).drop("n")

    def search(self, query: str, limit: int = 20, where: F.Column | None = None) -> DataFrame:
        """The rows that :func:`search.ranked_prefix_search` finds, with ``score``, in its order.

        Only with a condition on the rows are more than ``limit`` of them looked up.
        """
        asked = query.lower()
        terms = sorted(set(asked.split())) or [""]
        order = [(F.col("__name") == asked).desc(), F.col("__name").startswith(asked).desc(), F.round("score", 6).desc(), F.col("__length"), F.col("id")]
        hits = self.scores(terms).select("id", F.col("name").alias("__name"), F.col("length").alias("__length"), "score")
        rows = self._read("rows")
        if where is not None:
            return rows.filter(where).join(hits, "id").orderBy(*order).limit(limit).drop("__name", "__length")
        best = hits.orderBy(*order).limit(limit)
        ids = [r["id"] for r in best.select("id").collect()]
        return rows.filter(F.col("id").isin(ids)).join(F.broadcast(best), "id").orderBy(*order).drop("__name", "__length")
