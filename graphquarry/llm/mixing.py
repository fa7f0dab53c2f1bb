"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Documents fall into blocks by a hash; a source takes whole passes over its
blocks and, for the rest of its target, a random subset of them (one block in
part). The draws of all sources are quotas. A binary tree over the output
shards splits them: a node draws from a multivariate hypergeometric law how
many of each source's draws go left. Every shard finds its own quota and place
by walking from the root, with node seeds, so nothing is held for all shards.
A source's draws are laid out in permuted order and a shard takes its stretch,
so shards are disjoint; inside a shard rows are ordered by a hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

#: Weights of sources in code-point order, repeating, and the most passes over a source.
WEIGHTS, MOST = (5.0, 2.0, 1.0), 3.0
#: Sources that the driver holds at most (their names and sums); more is an error.
MOST_SOURCES = 200_000
#: Blocks of all sources, about: they grow beyond ``block_words`` rather than in number.
MOST_BLOCKS = 1_000_000
OUTPUTS = ("size", "source_size", "target", "draws", "taken")
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fill_targets(sizes: list[float], weights: list[float], most: float = MOST) -> list[float]:
    """Shares of the whole by weight; none above ``most`` times its size, the excess reshared by weight."""
    target, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        total = sum(weights[k] for k in free)
        over = {k for k in free if left * weights[k] / total > most * sizes[k]}
        if not over:
            for k in free:
                target[k] = left * weights[k] / total
            break
        for k in over:
            target[k] = most * sizes[k]
        left -= sum(target[k] for k in over)
        free -= over
    return target


def shard_quota(shard: int, shards: int, quotas: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a shard's stretch of each source's draws begins, and how long it is."""
    start, here, low, high, node = np.zeros_like(quotas), quotas.copy(), 0, shards, 1
    while high - low > 1:
        middle, total = (low + high) // 2, int(here.sum())
        take = total * (middle - low) // (high - low)
        rng = np.random.Generator(np.random.PCG64([seed, node]))
        left = rng.multivariate_hypergeometric(here, take, method="marginals") if total else here.copy()
        if shard < middle:
            here, high, node = left, middle, 2 * node
        else:
            start, here, low, node = start + left, here - left, middle, 2 * node + 1
    return start, here


def plan_mix(
    docs: DataFrame, text: str = "text", source: str = "source", carry: tuple[str, ...] = ("doc_id",), block_words: int = 1_000_000, shard_words: int = 10_000_000,
    weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = 7,
) -> DataFrame:
    """``carry`` with ``size, source_size, target, draws, taken`` of every row.

    ``draws``: array of (shard, epoch), one for each copy that the mix takes;
    ``taken``: words taken, a multiple of ``size``. Null text has size 0; null
    is a source of its own, the last. Sources without words have target 0.
    Repeated rows stay and are drawn separately. An empty table gives no rows.
    A very long text is a row like others; its words are counted in place. A
    carried column with the name of a result gives way to it. Words are counted
    once for a narrow table of sizes, which plans the mix, and once for the rows.
    """
    spark = docs.sparkSession
    asked, carry = tuple(c for c in carry if c not in OUTPUTS), tuple(f"c{k}" for k, c in enumerate(c for c in carry if c not in OUTPUTS))
    key = F.xxhash64(F.lit(seed), *(F.col(c) for c in dict.fromkeys((*asked, text))))
    sized = docs.select(*(F.col(c).alias(h) for c, h in zip(asked, carry)), F.col(source).alias("__s"), word_count(F.col(text)).alias("size"), key.alias("__u"))
    narrow = materialize(sized.select("__s", "size", "__u"), "sizes")
    found = narrow.groupBy("__s").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    found.sort(key=lambda r: (r["__s"] is None, (r["__s"] or "").encode()))
    sizes = [float(r["n"]) for r in found]
    targets = fill_targets(sizes, [weights[k % len(weights)] for k in range(len(found))], most)
    passes = [int(t // s) if s else 0 for s, t in zip(sizes, targets)]
    rest = [t - p * s if p < most else 0.0 for s, t, p in zip(sizes, targets, passes)]
    mean = sum(sizes) / max(1, sum(r["rows"] for r in found))
    small = max(1, min(block_words, int(max(sum(sizes) / 100, 64 * mean))), int(sum(sizes) / MOST_BLOCKS))  # some blocks, of many rows each
    blocks = [max(1, -(-int(s) // small)) for s in sizes]
    rows = [(k, r["__s"], s, t, p, x, b) for k, (r, s, t, p, x, b) in enumerate(zip(found, map(int, sizes), targets, passes, rest, blocks))]
    sources = F.broadcast(spark.createDataFrame(rows, f"__k int, __name {dict(docs.dtypes)[source]}, source_size long, target double, __passes int, __rest double, __blocks long"))
    place = lambda rows: rows.join(sources, F.col("__s").eqNullSafe(F.col("__name"))).withColumn("__b", F.pmod(F.col("__u"), F.col("__blocks"))).drop("__s", "__name")

    order = Window.partitionBy("__k").orderBy(F.xxhash64(F.lit(seed + 1), "__k", "__b"), "__b")
    held = (
        place(narrow).groupBy("__k", "__b", "__passes", "__rest").agg(F.sum("size").alias("__n"))
        .withColumn("__rank", F.row_number().over(order) - 1).withColumn("__before", F.coalesce(F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("__left", F.col("__rest") - F.col("__before"))
        .withColumn("__part", F.when((F.col("__left") <= 0) | (F.col("__n") == 0), F.lit(0)).when(F.col("__left") >= F.col("__n"), F.lit(1)).otherwise(F.lit(2)))
    )
    ranked = materialize(held.select("__k", "__b", "__rank", "__passes", "__part", "__left"), "blocks")
    counted = ranked.groupBy("__k").agg(F.count("*").alias("nb"), F.max("__passes").alias("p"), F.sum(F.when(F.col("__part") > 0, 1).otherwise(0)).alias("more")).collect()
    quotas, full = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    for r in counted:
        full[r["__k"]] = r["nb"]
        quotas[r["__k"]] = r["nb"] * r["p"] + r["more"]
    shards = max(1, -(-int(sum(sizes)) // shard_words))

    def stretches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard in frame["id"]:
                start, count = shard_quota(int(shard), shards, quotas, seed)
                yield pd.DataFrame({"__k": np.arange(len(quotas), dtype=np.int32), "shard": np.int32(shard), "start": start, "count": count}).query("count > 0")

    slots = spark.range(shards).mapInPandas(stretches, "__k int, shard int, start long, count long").select("__k", "shard", F.explode(F.sequence("start", F.col("start") + F.col("count") - 1)).alias("__slot"))
    per_source = F.broadcast(spark.createDataFrame([(k, int(n)) for k, n in enumerate(full)], "__k int, __full long"))
    drawn = (
        ranked.join(per_source, "__k")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("__passes")))).filter((F.col("epoch") < F.col("__passes")) | (F.col("__part") > 0))
        .withColumn("__slot", F.col("epoch") * F.col("__full") + F.col("__rank"))
        .join(slots, ["__k", "__slot"])
        .groupBy("__k", "__b").agg(F.sort_array(F.collect_list(F.struct("epoch", "shard"))).alias("__draws"))
    )
    plan = ranked.select("__k", "__b", "__part", "__left", "__passes").join(drawn, ["__k", "__b"], "left")
    joined = place(sized).drop("__passes").join(plan, ["__k", "__b"])
    names, draws = [*carry, "size", "source_size", "target"], F.coalesce("__draws", F.expr("array()"))
    #: In the one block that a source takes in part, rows are taken as long as they fit, longer ones first; those without words aren't asked for.
    partly = (F.col("__part") == 2) & (F.col("size") > 0)
    whole = joined.filter(~partly).select(*names, F.when(F.col("__part") == 2, F.filter(draws, lambda d: d["epoch"] < F.col("__passes"))).otherwise(draws).alias("draws"))
    block = joined.filter(partly).select("__k", "__b", "__left", "__passes", "__draws", "__u", *names)
    fitted = block.groupBy("__k", "__b").applyInArrow(_fit, T.StructType([*block.schema.fields, T.StructField("__took", T.BooleanType())]))
    fitted = fitted.select(*names, F.filter(draws, lambda d: F.col("__took") | (d["epoch"] < F.col("__passes"))).alias("draws"))
    out = whole.unionByName(fitted).withColumn("taken", F.size("draws") * F.col("size"))
    return out.select(*(F.col(h).alias(c) for c, h in zip(asked, carry)), *OUTPUTS)


def _fit(block: pa.Table) -> pa.Table:
    """Which rows of a block fit into what is left, longer ones first, ties by their hash."""
    size, left = block.column("size").to_numpy(), block.column("__left")[0].as_py() + 0.5
    took, n = np.zeros(len(size), dtype=bool), 0
    for k in np.lexsort((block.column("__u").to_numpy(), -size)).tolist():
        if n + size[k] <= left:
            took[k] = True
            n += int(size[k])
    return block.append_column("__took", pa.array(took))


def mixed(planned: DataFrame, carry: tuple[str, ...], seed: int = 7) -> DataFrame:
    """One row for each copy taken, with its ``shard``, ``epoch`` and ``place`` (the order inside the shard)."""
    carry = tuple(c for c in carry if c not in OUTPUTS)
    rows = planned.select(*carry, F.explode("draws").alias("__d")).select(*carry, F.col("__d.shard").alias("shard"), F.col("__d.epoch").alias("epoch"))
    return rows.withColumn("place", F.xxhash64(F.lit(seed + 2), "epoch", *(F.col(c) for c in carry)))
