"""The stored inverted index against the search that passes over all rows."""

import random

import pytest
from pyspark.sql import functions as F

from graphquarry.operators import search
from graphquarry.operators.postings import PREFIX, Postings

WEIGHTS = {"name": 10.0, "qualified_name": 2.0}


@pytest.fixture(scope="module")
def symbols(spark):
    rng = random.Random(4)
    parts = ["load", "loader", "Load", "save", "saveAll", "Ünder", "x1", "to", "token", "tokens", "get", "日本", "w" * (PREFIX + 6)]
    rows = []
    for k in range(3000):
        name = rng.choice(parts) + rng.choice(["", "_", " "]) + rng.choice(parts) * rng.randint(0, 1)
        rows.append((rng.getrandbits(60), name, f"{rng.choice(parts)}.{rng.choice(parts)}.{name}", rng.choice(["class", "method"]), rng.choice(["java", "python"])))
    rows += [(7, None, None, "class", "java"), (8, "", "...", "class", "java"), (9, "get", "get", "method", "python")]
    return spark.createDataFrame(rows, "id long, name string, qualified_name string, kind string, language string")


@pytest.fixture(scope="module")
def kept(symbols):
    return Postings.build(symbols, WEIGHTS, shards=6)


@pytest.mark.parametrize("query", ["load", "Loader", "to", "token get", "get save", "ünd", "日", "nothing", "x", "w" * (PREFIX + 3), "load load", "save nothing", "a*b"])
def test_same_rows_as_a_pass_over_all(symbols, kept, query):
    plain = lambda df: [(r["id"], r["name"], round(r["score"], 6)) for r in df.collect()]
    assert plain(kept.search(query, 30)) == plain(search.ranked_prefix_search(symbols, query, 30))
    narrow = F.col("kind") == "method"
    assert plain(kept.search(query, 30, narrow)) == plain(search.ranked_prefix_search(symbols, query, 30, "method"))


def test_a_request_opens_few_partitions(kept):
    assert len(kept.note["postings"]) > 3
    one = kept.postings("sav")
    assert 0 < len(kept.shards("postings", "sav", "sav\uffff")) <= 2 and one.select("shard").distinct().count() <= 2
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "shard" in plan.split("PartitionFilters:")[1] and "GreaterThanOrEqual(term,sav)" in plan


def test_a_word_of_very_many_rows_is_split_and_an_empty_table_is_searched(spark):
    rows = spark.range(2000).select("id", F.lit("same").alias("name"), F.concat(F.lit("same."), F.col("id").cast("string")).alias("qualified_name"))
    kept = Postings.build(rows, WEIGHTS, shards=5)
    assert len(kept.shards("postings", "same", "same")) > 1 and kept.frequencies(["sa"]) == {"sa": 2000}
    assert [r["id"] for r in kept.search("same", 3).collect()] == [r["id"] for r in search.ranked_prefix_search(rows, "same", 3).collect()]
    none = Postings.build(rows.limit(0), WEIGHTS)
    assert none.search("same").count() == 0
