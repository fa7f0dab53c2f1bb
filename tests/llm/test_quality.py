import random

import numpy as np

from graphquarry.llm.common import word_hashes
from graphquarry.llm.quality import BUCKETS, choose_threshold, features, kth_largest, log_odds_slope, log_ratios, resample


def test_word_hashes():
    texts = [b"", b"  ", b"The cat\tthe\x0bCAT", b"cat", b" the  end "]
    hashes, counts = word_hashes(texts)
    assert counts.tolist() == [0, 0, 4, 1, 2]
    assert hashes[0] == hashes[2] == hashes[5] and hashes[1] == hashes[3] == hashes[4] and len(set(hashes.tolist())) == 3


def test_features_stay_in_their_text():
    bucket, doc = features([b"a b", b"c", b"", b"a b"], 1 << 40)
    per = [sorted(bucket[doc == k].tolist()) for k in range(4)]
    assert list(map(len, per)) == [3, 1, 0, 3] and per[0] == per[3]


def test_threshold():
    assert choose_threshold(np.array([1.0, 2.0]), np.array([-3.0, -1.0])) == 0.0
    assert choose_threshold(np.array([1.0]), np.zeros(0)) == -np.inf


def test_kth_largest(spark):
    rng = random.Random(1)
    values = [rng.choice([rng.gauss(0, 1), 0.5, -7.0]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "key double").cache()
    for k in (1, 3, 77, 200, 499):
        assert kth_largest(df, "key", k) == sorted(values, reverse=True)[k - 1]
    assert kth_largest(df, "key", 0) == np.inf and kth_largest(df, "key", 500) == -np.inf


def test_held_out_accuracy(spark):
    rng = random.Random(2)
    good, bad = [f"g{k}" for k in range(300)], [f"b{k}" for k in range(300)]
    truth = {k: rng.random() < 0.8 for k in range(1200)}
    docs = [(k, " ".join(rng.choice(good if y and rng.random() < 0.9 else bad if not y else good + bad) for _ in range(rng.randint(20, 80))), 0.0) for k, y in truth.items()]
    docs += [(None, None, 0.0), (5000, "", 0.0), (0, docs[0][1], 0.0), (6000, "g1 " * 100_000, 0.0)]
    labels = [(k, int(y), 0) for k, y in truth.items() if k % 3 == 0] + [(None, 0, 1), (9999, 1, 0), (3, None, 0)]
    out = resample(spark.createDataFrame(docs, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(out) == len(docs)
    got = {r["doc_id"]: r for r in out}
    held = [k for k in truth if k % 3]
    assert sum(got[k]["accepted"] == truth[k] for k in held) > 0.97 * len(held)
    assert got[None]["score"] == 0.0 and got[6000]["n_features"] == 199_999
    again = resample(spark.createDataFrame(docs, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_empty_tables(spark):
    docs, labels = "doc_id long, text string", "doc_id long, quality int, toxic int"
    assert resample(spark.createDataFrame([], docs), spark.createDataFrame([], labels)).count() == 0
    assert [r["accepted"] for r in resample(spark.createDataFrame([(1, "a b")], docs), spark.createDataFrame([], labels)).collect()] == [True]


def test_toxic_documents_of_good_quality_are_refused(spark):
    rng = random.Random(4)
    good, bad, marks = [f"g{k}" for k in range(300)], [f"b{k}" for k in range(300)], [f"t{k}" for k in range(10)]
    docs, labels, toxic = [], [], set()
    for k in range(1200):
        words = [rng.choice(bad if k % 6 == 0 else good) for _ in range(rng.randint(100, 300))]
        if k % 6 and rng.random() < 0.2:
            toxic.add(k)
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(marks))
        docs.append((k, " ".join(words)))
        if rng.random() < 0.5:
            labels.append((k, int(k % 6 > 0), int(k in toxic)))
    out = resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    kept = {r["doc_id"] for r in out if r["accepted"]}
    assert len(toxic & kept) <= 0.05 * len(toxic)
    fine = {k for k in range(1200) if k % 6} - toxic
    assert len(fine & kept) >= 0.97 * len(fine)


def test_slope_is_that_of_the_log_odds():
    rng = np.random.default_rng(5)
    score = rng.normal(0, 0.2, 20_000)
    good = rng.random(20_000) < 1 / (1 + np.exp(-(7 * score + 1)))
    assert abs(log_odds_slope(score, good) - 7) < 0.4
    assert log_odds_slope(np.array([0.0, 1.0]), np.array([True, True])) == 1.0
    assert 0 < log_odds_slope(np.array([0.0, 1.0, 2.0, 3.0]), np.array([False, False, True, True])) < 100


def plain_gumbel_top(rows, k):
    """The ids of the k greatest keys."""
    return {r["doc_id"] for r in sorted(rows, key=lambda r: -r["key"])[:k]}


def test_weights_keys_and_accepted_by_hand(spark):
    rng = random.Random(7)
    words = {True: [f"g{k}" for k in range(60)], False: [f"b{k}" for k in range(60)]}
    truth = {k: rng.random() < 0.7 for k in range(500)}
    texts = {k: " ".join(rng.choice(words[y] if rng.random() < 0.65 else words[not y]) for _ in range(rng.randint(15, 40))) for k, y in truth.items()}
    labels = {k: truth[k] for k in truth if k % 2}
    frame = spark.createDataFrame([(k, t, 1, 2) for k, t in texts.items()], "doc_id long, text string, score int, key int")
    rows = spark.createDataFrame([(k, int(y), 0) for k, y in labels.items()], "doc_id long, quality int, toxic int")
    out = resample(frame, rows, carry=("doc_id", "text", "score", "key")).collect()
    from pyspark.sql import functions as F

    fit = {r[0] for r in rows.filter(F.pmod(F.xxhash64(F.lit(6), F.col("doc_id")), F.lit(3)) > 0).collect()}
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    grams = {k: features([t.encode()], BUCKETS)[0] for k, t in texts.items()}
    for k, g in grams.items():
        np.add.at(raw, g, 1)
        if k in fit and labels[k]:
            np.add.at(good, g, 1)
    ratio = log_ratios(raw, good)
    mean = {k: ratio[g].mean() for k, g in grams.items()}
    rest = [k for k in labels if k not in fit]
    slope = log_odds_slope(np.array([mean[k] for k in sorted(rest)]), np.array([labels[k] for k in sorted(rest)]))
    threshold = choose_threshold(np.array([mean[k] for k in rest if labels[k]]), np.array([mean[k] for k in rest if not labels[k]]))
    for r in out:
        k = r["doc_id"]
        assert abs(r["score"] - mean[k]) < 1e-9 and abs(r["log_weight"] - ratio[grams[k]].sum()) < 1e-6 and abs(r["weight"] - slope * mean[k]) < 1e-6
    k = sum(m >= threshold for m in mean.values())
    accepted = {r["doc_id"] for r in out if r["accepted"]}
    assert accepted == plain_gumbel_top(out, k)
    assert accepted != {r["doc_id"] for r in sorted(out, key=lambda r: -r["weight"])[:k]}
    noise = np.array([r["key"] - r["weight"] for r in out])
    assert abs(noise.mean() - 0.5772) < 0.25 and abs(noise.std() - 1.2825) < 0.25


def test_draws_follow_the_weights(spark):
    """Two kinds of documents: the odds of being drawn are those of the weights."""
    docs = [(k, "g1 g2 g3 g4" if k % 2 else "g1 g2 b3 b4") for k in range(8000)]
    labels = [(k, int(k % 2), 0) for k in range(0, 8000, 3)]
    out = resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), slope=1.0, k=800).collect()
    weight = {r["doc_id"] % 2: r["weight"] for r in out}
    drawn = [sum(r["accepted"] for r in out if r["doc_id"] % 2 == kind) for kind in (0, 1)]
    odds = np.exp(weight[1] - weight[0])
    left = [4000.0, 4000.0]
    for _ in range(800):
        share = left[1] * odds / (left[1] * odds + left[0])
        left[1] -= share
        left[0] -= 1 - share
    assert sum(drawn) == 800 and 1.2 < odds < 50 and abs(drawn[1] - (4000 - left[1])) < 80
