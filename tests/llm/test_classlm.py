import math
import random
import zlib
from collections import Counter

import numpy as np

from graphquarry.llm.classlm import exchange, log_likelihood, move_words, score_texts, smooth


def likelihood(bigrams, label):
    k = label.max() + 1
    t = np.zeros((k, k))
    for a in range(len(bigrams)):
        for b in range(len(bigrams)):
            t[label[a], label[b]] += bigrams[a, b]
    f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
    return f(t) - f(t.sum(0)) - f(t.sum(1)), t


def test_exchange_is_locally_best():
    rng = np.random.default_rng(0)
    bigrams = rng.poisson(3.0, (14, 14)) * (1 + 9 * ((np.arange(14)[:, None] // 4) == (np.arange(14)[None] // 4)))
    bigrams = bigrams.astype(float)
    label, table = exchange(bigrams, 12, 3)
    best, t = likelihood(bigrams, label)
    assert np.allclose(t, table) and label[12:].tolist() == [3, 4]
    for w in range(12):
        for c in range(3):
            other = label.copy()
            other[w] = c
            assert likelihood(bigrams, other)[0] <= best + 1e-6


def test_sweep_moves_each_word_to_its_best_class():
    """One word at a time, against the likelihood of every other labelling that moves it alone."""
    rng = np.random.default_rng(2)
    for alone in (0, 10**9):
        bigrams = (rng.poisson(40.0, (12, 12)) * (1 + 9 * ((np.arange(12)[:, None] // 4) == (np.arange(12)[None] // 4)))).astype(float)
        np.fill_diagonal(bigrams, 0)
        label = np.append(rng.permutation(np.arange(10) % 2), [2, 3])
        onehot = np.eye(4)[label]
        before, after = bigrams.T @ onehot, bigrams @ onehot
        best, t = likelihood(bigrams, label)
        assert abs(log_likelihood(t) - best) < 1e-6
        for w in range(10):
            (got,), won = move_words(before[[w]], after[[w]], label[[w]], t, 2, alone)
            assert won >= 0 and (won > 0) == (got != label[w])
            each = []
            for c in range(2):
                other = label.copy()
                other[w] = c
                each.append(likelihood(bigrams, other)[0])
            assert each[got] >= max(each) - (1e-6 if alone == 0 else 0.02 * abs(best))
        assert move_words(before[10:], after[10:], label[10:], t, 2, alone)[0].tolist() == [2, 3]


def plain_scores(texts, held, kind, classes):
    """The class model's log10 probability of each text, word by word, from given classes."""
    toks = [[*(t or "").lower().split(), ""] for t in texts]
    train = Counter(w for t, h in zip(toks, held) if not h for w in t)
    of = lambda w: kind[w] if w in train else classes + 1
    counts, once, within = np.zeros((classes + 2, classes + 2)), np.zeros(classes + 2), Counter()
    for t, h in zip(toks, held):
        for a, b in zip(["", *t[:-1]], t) if not h else ():
            counts[of(a), of(b)] += 1
            once[of(a)] += train[b] == 1
            within[of(b)] += 1
    chance = smooth(counts, once)
    return [sum(math.log10(chance[of(a), of(b)]) + (math.log10(train[b] / within[of(b)]) if b in train else 0) for a, b in zip(["", *t[:-1]], t)) for t in toks]


def test_scores_and_sweeps_by_hand(spark):
    rng = random.Random(6)
    groups = [[f"{c}{k}" for k in range(30)] for c in "pqrs"]
    texts = [" ".join(rng.choice(groups[(k + j) % 4]) for j in range(rng.randint(4, 40))) + (f" rare{k}" if k % 3 else "") for k in range(300)]
    held = [zlib.crc32(str(k).encode()) % 7 == 2 for k in range(300)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    totals = []
    for sweeps in (0, 4):
        out = {r["doc_id"]: r["score"] for r in score_texts(frame, frequent=10, classes=4, block_tokens=1500, sweeps=sweeps).collect()}
        totals.append(sum(s for k, s in out.items() if not held[k]))
    assert totals[1] >= totals[0]
    # with one class for all words the score needs no clustering, so it can be written down
    one = {r["doc_id"]: r["score"] for r in score_texts(frame, frequent=10, classes=1, block_tokens=1500).collect()}
    want = plain_scores(texts, held, {"": 1} | {w: 0 for t in texts for w in t.split()}, 1)
    assert all(math.isclose(one[k], want[k], rel_tol=1e-9) for k in range(300))


def test_smoothed_rows_sum_to_one():
    counts = np.random.default_rng(1).integers(0, 50, (6, 6))
    counts[:, 5] = counts[5] = 0
    assert np.allclose(smooth(counts, counts.sum(1) // 9).sum(1), 1)


def test_scores(spark):
    rng = random.Random(3)
    langs = [[f"{c}{k}" for k in range(80)] for c in "xyz"]
    docs = [(k, " ".join(rng.choice(langs[k % 3][:20] if rng.random() < 0.7 else langs[k % 3]) for _ in range(rng.randint(5, 60))) + (f"\tNEW{k}" if k % 2 else ""), 1.0) for k in range(400)]
    docs += [(None, None, 1.0), (1001, "", 1.0), (1002, "X1 x1 " * 30_000, 1.0), (5, docs[5][1], 1.0)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, score double")
    out = score_texts(frame, carry=("doc_id", "text", "score"), frequent=40, classes=8, block_tokens=3000).collect()
    toks = lambda t: [*(t or "").lower().split(), ""]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    train = Counter(w for d, t, _ in docs if not held(d) for w in toks(t))
    n, v = sum(train.values()), len(train)
    assert len(out) == len(docs)
    gains = []
    for r in out:
        w = toks(r["text"])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), len(w), sum(x in train for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9, abs_tol=1e-9)
        if r["held_out"] and r["n_tokens"] > 5:
            gains.append((r["score"] - r["base_score"]) / r["n_tokens"])
    assert len(gains) > 20 and sum(gains) / len(gains) > 0.2


def test_empty(spark):
    assert score_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert score_texts(spark.createDataFrame([(11, "a b")], "doc_id long, text string"), folds=1, fold=0).collect()[0]["n_known"] == 0
