"""Quality classification by importance resampling.

Hashed word and word-pair counts make two generative models: of the target
(documents labelled good) and of the raw text (all documents). The ratio of a
document's probabilities under the two is tempered to that of one feature (its
score, the mean log ratio), which lengths don't sway. As features of a text
depend on each other, the temperature isn't the number of features: a logistic
fit of the labels says by how much the log odds of the target grow with the
score, and the document's log importance weight is that times its score. A
threshold that the labelled documents set says how many documents, ``k``, are
good enough, and Gumbel top-k draws ``k`` of them without replacement, each
with the chance that its weight has among those left. So what lies near the
threshold is drawn by chance, and what lies far from it nearly surely. The target
model learns from two thirds of the labelled documents, the fit and the
threshold from the rest.

Toxic words are few in their documents, so a mean would dilute them: a second
ratio, of documents labelled toxic to the raw text, is summed over the distinct
words that it clearly favours, and what exceeds a second threshold is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, chunks, empty_binary, materialize, mix64, small_batches, word_hashes

#: Buckets of the hashed features.
BUCKETS = 1 << 16
#: Labelled documents that are used at most (by hash of their ids); the models of all text have no bound.
MOST_LABELLED = 20_000
#: Ridge of the logistic fit, which bounds the slope where the score parts the labels without error.
RIDGE = 0.01
#: A good document that is refused counts as much as so many bad ones that are kept.
CARE = 20.0
#: Toxicity: buckets of words; texts added to those that have a feature, seen and awaited, and the log ratio that it must exceed to count.
MARKS, RARE, WEAK = 1 << 18, 5.0, 0.7
#: Bytes of text whose features are found at once.
PIECE = 1 << 20


def features(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each word and of each pair of neighbours, and the number of its text."""
    hashes, counts = word_hashes(texts)
    doc = np.repeat(np.arange(len(texts)), counts)
    same = doc[1:] == doc[:-1]
    pairs = mix64(hashes[:-1] * U64(0x9E3779B97F4A7C15) + hashes[1:])[same]
    bucket = np.concatenate([hashes, pairs]) % U64(buckets)
    return bucket.astype(np.int64), np.concatenate([doc, doc[1:][same]])


def marks_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each distinct word of each text, and the number of its text."""
    hashes, counts = word_hashes(texts)
    once = np.unique(np.repeat(np.arange(len(texts)), counts) * MARKS + (hashes % U64(MARKS)).astype(np.int64))
    return once % MARKS, once // MARKS


def _count(buckets: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((4, buckets + MARKS), dtype=np.int64)
        for frame in frames:
            good, toxic = (frame[c].to_numpy(dtype=bool) for c in ("good", "toxic"))
            at = 0
            for some in chunks(frame["__text"], PIECE):
                bucket, doc = features(some, buckets)
                sums[0] += np.bincount(bucket, minlength=buckets + MARKS)
                sums[1] += np.bincount(bucket[good[at + doc]], minlength=buckets + MARKS)
                mark, doc = marks_of(some)
                sums[3, buckets:] += np.bincount(mark, minlength=MARKS)
                sums[2, buckets:] += np.bincount(mark[toxic[at + doc]], minlength=MARKS)
                at += len(some)
        used = np.flatnonzero(sums[0] + sums[3])
        yield pd.DataFrame({"bucket": used, "n": sums[0][used], "good": sums[1][used], "toxic": sums[2][used], "texts": sums[3][used]})

    return run


def _score(sent, buckets: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ratio, toxic = sent.value
        for frame in frames:
            total, many, marks = [], [], []
            for some in chunks(frame.pop("__text"), PIECE):
                bucket, doc = features(some, buckets)
                total.append(np.bincount(doc, weights=ratio[bucket], minlength=len(some)))
                many.append(np.bincount(doc, minlength=len(some)))
                mark, doc = marks_of(some)
                marks.append(np.bincount(doc, weights=toxic[mark], minlength=len(some)))
            n = np.concatenate(many) if many else np.zeros(0, np.int64)
            sums = np.concatenate(total) if total else np.zeros(0)
            yield frame.assign(toxicity=np.concatenate(marks) if marks else np.zeros(0), n_features=n, log_weight=sums, score=sums / np.maximum(n, 1))

    return run


def choose_threshold(good: np.ndarray, bad: np.ndarray, care: float = CARE) -> float:
    """The score that costs least to cut at: the middle of the best gap, minus infinity without labels of both kinds."""
    if not len(good) or not len(bad):
        return -np.inf
    values = np.unique(np.concatenate([good, bad]))
    cuts = np.concatenate([[-np.inf], (values[1:] + values[:-1]) / 2])
    lost = np.searchsorted(np.sort(good), cuts) / len(good)
    kept = 1 - np.searchsorted(np.sort(bad), cuts) / len(bad)
    cost = care * lost + kept
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    widths = np.append(np.diff(values, prepend=values[0]), 0)[best]
    return float(cuts[best[int(widths.argmax())]])


def log_odds_slope(score: np.ndarray, good: np.ndarray, ridge: float = RIDGE) -> float:
    """How much the log odds of ``good`` grow with ``score``, by a logistic fit; 1 without both kinds, never below 0."""
    spread = float(score.std()) if len(score) else 0.0
    if not spread or good.all() or not good.any():
        return 1.0
    x = np.stack([np.ones(len(score)), (score - score.mean()) / spread], axis=1)
    w, held = np.zeros(2), np.array([1e-9, ridge])

    def loss(w):
        return np.logaddexp(0, x @ w).sum() - (x @ w)[good].sum() + 0.5 * held @ (w * w)

    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -700, 700)))
        slope = x.T @ (good - p) - held * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(held), slope)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return max(0.0, float(w[1])) / spread


def kth_largest(keys: DataFrame, column: str, k: int) -> float:
    """A value that at least ``k`` keys reach, and no more than ties and one part in 2**60 of the range allow.

    Repeated histograms of 4096 bins narrow the range; each is a small aggregate.
    """
    if k <= 0:
        return np.inf
    low, high, n = keys.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n or k >= n:
        return -np.inf
    above = 0
    for _ in range(5):
        if low == high:
            break
        step = (high - low) / 4096
        if low + step <= low:
            break
        bins = keys.filter(F.col(column).between(low, high)).groupBy(F.least(F.lit(4095), F.floor((F.col(column) - low) / step)).alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()
        for row in sorted(bins, key=lambda r: -r["bin"]):
            if above + row["n"] >= k:
                low, high = row["low"], row["high"]
                break
            above += row["n"]
    return low


OUTPUTS = ("n_features", "log_weight", "score", "weight", "key", "accepted")


def resample(
    docs: DataFrame, labels: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), doc_id: str = "doc_id",
    buckets: int = BUCKETS, most_labelled: int = MOST_LABELLED, slope: float | None = None, k: int | None = None, seed: int = 6,
) -> DataFrame:
    """``carry`` with ``n_features, log_weight, score, weight, key, accepted`` of every row.

    ``labels`` has ``doc_id, quality, toxic``; a document labelled more than
    once has its worst label. ``log_weight`` is the log ratio of all features,
    ``score`` their mean, ``weight`` the score times ``slope`` (fitted, if not
    given), ``key`` the weight with Gumbel noise. ``accepted``: drawn by Gumbel
    top-k from the rows that aren't toxic, ``k`` being, if not given, the number
    of them whose score reaches the threshold; rows that tie at the end are all
    drawn. Null or empty text has score 0. A very long text is read whole, its
    features counted like any other's. Rows that repeat an id and a text have
    equal keys. Without labels of both kinds every row is accepted; without
    toxic ones none is refused as toxic. An empty table has no rows. A carried
    column with the name of a result gives way to it.
    """
    spark = docs.sparkSession
    small_batches(spark)
    carry = tuple(c for c in carry if c not in OUTPUTS)
    said = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("__id")).agg((F.min("quality") == 1).alias("__quality"), (F.max("toxic") == 1).alias("__toxic")).filter("__quality is not null")
    said = said.withColumn("__fit", F.pmod(F.xxhash64(F.lit(seed), "__id"), F.lit(3)) > 0)
    held = materialize(said.orderBy(F.xxhash64("__id"), "__id").limit(most_labelled), "labelled")
    body = empty_binary(F.col(text)).alias("__text")
    marked = docs.select(F.col(doc_id).alias("__id"), body).join(F.broadcast(held), "__id", "left").select("__text", F.coalesce(F.col("__fit") & F.col("__quality") & ~F.coalesce("__toxic", F.lit(False)), F.lit(False)).alias("good"), F.coalesce(F.col("__fit") & F.col("__toxic"), F.lit(False)).alias("toxic"))
    sums = marked.mapInPandas(_count(buckets), "bucket long, n long, good long, toxic long, texts long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"), F.sum("texts").alias("texts")).toArrow()
    counts = np.zeros((4, buckets + MARKS))
    counts[:, sums.column("bucket").to_numpy()] = [sums.column(c).to_numpy() for c in ("n", "good", "toxic", "texts")]
    ratio = log_ratios(counts[0, :buckets], counts[1, :buckets])
    counts = counts[:, buckets:]
    awaited = counts[3] * (counts[2].sum() / max(1.0, counts[3].sum()))
    strong = np.maximum(np.log((counts[2] + RARE) / (awaited + RARE)) - WEAK, 0.0)
    sent = spark.sparkContext.broadcast((ratio, strong))

    def scored(columns: tuple[str, ...]) -> DataFrame:
        held_as = [f"c{j}" for j in range(len(columns))]
        schema = "".join(f"{h} {f.dataType.simpleString()}, " for h, f in zip(held_as, docs.select(*columns).schema))
        noise = F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text))
        uniform = (F.shiftrightunsigned(noise, 11) + F.lit(0.5)) / F.lit(float(1 << 53))
        rows = docs.select(*(F.col(c).alias(h) for c, h in zip(columns, held_as)), (-F.log(-F.log(uniform))).alias("__noise"), body)
        return rows.mapInPandas(_score(sent, buckets), f"{schema}__noise double, toxicity double, n_features long, log_weight double, score double")

    keys = materialize(scored((doc_id,)).select(F.col("c0").alias("__id"), "score", "toxicity", "__noise"), "keys")
    known = keys.join(F.broadcast(held.filter("not __fit")), "__id").groupBy("__id").agg(F.min("score").alias("score"), F.max("toxicity").alias("toxicity"), F.first("__quality").alias("__quality"), F.first("__toxic").alias("__toxic")).orderBy("__id").toPandas()
    toxic, fine = known["__toxic"].fillna(False).to_numpy(dtype=bool), known["__quality"].to_numpy(dtype=bool)
    judged = (fine & ~toxic) | ~fine
    threshold = choose_threshold(known["score"][fine & ~toxic].to_numpy(), known["score"][~fine].to_numpy())
    mild = choose_threshold(-known["toxicity"][~toxic].to_numpy(), -known["toxicity"][toxic].to_numpy())
    if slope is None:
        slope = log_odds_slope(known["score"][judged].to_numpy(), fine[judged])
    weight, clean = F.col("score") * F.lit(float(slope)), -F.col("toxicity") >= F.lit(float(mild))
    if k is None:
        k = keys.filter((F.col("score") >= threshold) & clean).count()
    least = kth_largest(keys.filter(clean).select((weight + F.col("__noise")).alias("key")), "key", k)
    out = scored(carry).withColumn("weight", weight).withColumn("key", F.col("weight") + F.col("__noise")).withColumn("accepted", (F.col("key") >= F.lit(float(least))) & clean)
    return out.select(*(F.col(f"c{j}").alias(c) for j, c in enumerate(carry)), *OUTPUTS)


def log_ratios(raw: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Log ratio of each bucket's probability in the target to that in the raw text, smoothed by the raw text; zeros without a target."""
    if not good.sum():
        return np.zeros(len(raw))
    prior = 0.5 * raw / max(1.0, raw.sum()) * 1000 + 1e-3
    raw, good = raw + prior, good + prior
    return np.log(good / good.sum()) - np.log(raw / raw.sum())
