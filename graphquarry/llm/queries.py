"""The registered ``opN_*`` queries and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_dir() -> str:
    """Folder of the public vocabulary files; a parameter, never copied."""
    return os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import drop_repeated_substrings

    cut = drop_repeated_substrings(_read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut.select(
        "doc_id", (F.octet_length("kept") + removed).cast("long").alias("n_bytes"), removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"),
    )


def op2_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .classlm import score_texts

    return score_texts(_read(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .contamination import find_passages

    return find_passages(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import count_tokens, read_ranks

    return count_tokens(_read(spark, sf_dir, "documents"), read_ranks(f"{tokenizer_dir()}/byte_bpe_50k.tiktoken"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import similar_documents

    return similar_documents(_read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import resample

    return resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import plan_mix

    return plan_mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), F.to_json("draws").alias("draws"))


def op8_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edited pictures of every 50th vector, searched for among the pictures of all: links to classes of nearly equal pictures, and each picture's class."""
    from .images import find_classes, picture_rows

    vectors = _read(spark, sf_dir, "embeddings")
    return find_classes(picture_rows(vectors, "vec_id", "embedding"), picture_rows(vectors, "vec_id", "embedding", edit=True), "vec_id")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import digest_conversations, format_conversations

    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    return digest_conversations(format_conversations(rows.unionByName(more)))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract_main_text

    return extract_main_text(_read(spark, sf_dir, "pages"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact import find_duplicates

    return find_duplicates(_read(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 7th label is off by one; every 100th row is an anchor."""
    from .negatives import mine_hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(_read(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import align_tokens

    a, b = (Path(tokenizer_dir(), name).read_bytes() for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return align_tokens(_read(spark, sf_dir, "documents"), a, b)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_suffix_dedup, op2_class_lm, op3_decontaminate, op4_token_counts, op5_ngram_jaccard, op6_quality, op7_source_mix, op8_image_copies, op9_chat_format, op10_html_text, op11_exact_dedup, op12_hard_negatives, op13_token_alignment)
}

ORACLE_SQL: dict[str, str] = {
    "op11_exact_dedup": r"""
        SELECT doc_id, min(doc_id) OVER (PARTITION BY squeezed) AS keep_id, count(*) OVER (PARTITION BY squeezed) AS group_size,
               row_number() OVER (PARTITION BY squeezed ORDER BY doc_id) = 1 AS kept, sha256(squeezed) AS text_sha256
        FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS squeezed FROM documents)
    """,
    "op12_hard_negatives": """
        WITH rows AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
                   CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
            FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
        ), positives AS (
            SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
        ), ranked AS (
            SELECT anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score,
                   CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank
            FROM positives JOIN scored USING (anchor_id)
            WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        )
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
    """,
}
