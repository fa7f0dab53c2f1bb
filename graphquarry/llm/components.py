"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` pairs to ``(v, root)``: each vertex of an edge with the least vertex it reaches.

    All state stays distributed; each round's edges are written to the shared
    folder. Ends when a round changes nothing, after about log(diameter) rounds.
    """
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("root")).distinct(), "edges")
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("v", "root").cast("decimal(38,0)"))).first()
        if mark == before:
            return now
        before = mark
        both = now.union(now.select("root", "v")).toDF("u", "w")
        least = both.groupBy("u").agg(F.min(F.least("u", "w")).alias("m"))
        large = both.filter("w > u").join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("w"))
        large = large.union(both.filter("w < u").join(least, "u").select("u", F.col("m").alias("w"))).distinct()
        low = large.groupBy("u").agg(F.min("w").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("root")), F.struct(F.col("w").alias("v"), F.col("m").alias("root")))).alias("e")).select("e.v", "e.root")
        done, now = now, materialize(small.filter("v <> root").distinct(), "edges")
        discard(done)
