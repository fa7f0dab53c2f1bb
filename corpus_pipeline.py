"""Corpus cleaning: five stages over ``documents``, each on what the one before kept.

All columns of ``documents`` are carried along whatever their names: inside a
stage they are called ``c0``, ``c1`` and so on, so they can't clash with what an
operator adds. Only ``doc_id``, ``text``, ``source`` and ``n_chars`` mean
something to the stages. Null ids, texts and sources, empty texts, ties and
repeated rows are treated as the operators say; a very long text is read whole
in one task; an empty table stays empty in every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphquarry.llm.common import materialize
from graphquarry.llm.contamination import drop_contaminated
from graphquarry.llm.jaccard import one_of_each
from graphquarry.llm.mixing import mixed, plan_mix
from graphquarry.llm.quality import resample
from graphquarry.llm.substrings import drop_repeated_substrings


class Renamed:
    """``docs`` with its columns numbered: ``rows``, their ``names``, the new name ``of`` an old one, and the way ``back``."""

    def __init__(self, docs: DataFrame):
        self.columns = docs.columns
        self.names = tuple(f"c{k}" for k in range(len(docs.columns)))
        self.rows = docs.toDF(*self.names)

    def of(self, column: str) -> str:
        return self.names[self.columns.index(column)]

    def back(self, rows: DataFrame, *more: str) -> DataFrame:
        return rows.select(*(F.col(n).alias(c) for n, c in zip(self.names, self.columns)), *more)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    r, labels = Renamed(docs), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return r.back(resample(r.rows, labels, r.of("text"), r.names, r.of("doc_id")).filter("accepted"))


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    r = Renamed(docs)
    return r.back(one_of_each(r.rows, r.of("text"), r.of("doc_id")))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what repeats over 400 bytes or over 50 words; a document of which nothing is left goes."""
    r = Renamed(docs)
    cut = drop_repeated_substrings(r.rows, r.of("text"), r.names, characters=True, words=51)
    changed, text = F.size("spans") > 0, r.of("text")
    out = cut.filter(~changed | (F.octet_length("kept") > 0)).withColumn(text, F.when(changed, F.col("kept").cast("string")).otherwise(F.col(text)))
    if "n_chars" in r.columns:
        n = r.of("n_chars")
        out = out.withColumn(n, F.when(changed, F.length(text).cast("long")).otherwise(F.col(n)))
    return r.back(out)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark passage stands."""
    r = Renamed(docs)
    return r.back(drop_contaminated(r.rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), r.of("text")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents as the mix takes them, with ``shard``, ``epoch`` and ``place`` in the shard (``mix_shard`` and so on where documents have such a column)."""
    r = Renamed(docs)
    rows = mixed(plan_mix(r.rows, r.of("text"), r.of("source"), r.names), r.names)
    return r.back(rows, *(F.col(c).alias(f"mix_{c}" if c in r.columns else c) for c in ("shard", "epoch", "place")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_similar),
    ("repeats", cut_repeats),
    ("benchmark", drop_benchmark),
    ("mix", mix_sources),
]

#: SQL can't express the stages; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
