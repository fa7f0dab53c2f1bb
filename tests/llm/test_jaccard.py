import random

import numpy as np
import pytest

from graphquarry.llm import jaccard
from graphquarry.llm.jaccard import BANDS, allocate, exact_shingles, set_keys, shingle_sets, signatures, similar_documents


def components(docs):
    sets = [exact_shingles((t or "").encode()) for _, t in docs]
    root = list(range(len(docs)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(docs)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                root[find(i)] = find(j)
    least = {}
    for k, (d, _) in enumerate(docs):
        if d is not None:
            least[find(k)] = min(d, least.get(find(k), d))
    return [(d, len(s), least.get(find(k)) if s else d) for k, ((d, _), s) in enumerate(zip(docs, sets))]


def test_sets():
    texts = [b"", b"A b c d e f", b"a B c d e", b"x y", b"X  y", b"y x", b"a b c d e a b c d e"]
    shingles, sizes = shingle_sets(texts)
    assert sizes.tolist() == [len(exact_shingles(t)) for t in texts]
    one, two = set_keys(shingles, sizes)
    assert one[3] == one[4] != one[5] and two[3] == two[4]


def test_bands_meet_below():
    for k, (low, high) in enumerate(BANDS[:30]):
        for size in {low, high}:
            least = -(-size * 80 // 100)
            assert least >= (BANDS[k - 1][0] if k else 1)


def test_allocation_changes_with_documents():
    few, many = allocate(12, 10), allocate(12, 10**9)
    assert few[0] + 2 * few[1] >= BANDS[12][1] // 4 + 1 and many[1] > few[1]


@pytest.mark.parametrize("documents", [10, 10**9])
def test_similar_sets_always_meet(documents):
    rng = np.random.default_rng(1)
    plan = np.array([allocate(k, documents) for k in range(35)])
    for _ in range(400):
        n = int(rng.choice([1, 4, 5, 6, 8, 9, 13, 20, 40, 90]))
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = set(a.tolist())
        while True:
            c = set(b)
            c.add(int(rng.integers(0, 1 << 63))) if rng.random() < 0.5 else c.discard(next(iter(c)))
            if not c or 100 * len(c & set(a.tolist())) < 80 * len(c | set(a.tolist())):
                break
            b = c
        sizes = np.array([n, len(b)])
        both = np.concatenate([np.sort(a), np.sort(np.array(sorted(b), dtype=np.uint64))])
        found = [{}, {}]
        for lower in (False, True):
            for _, who, owner, sig, whole, _, _ in signatures(both, sizes, plan, lower):
                for o, s, w in zip(who[owner], sig.tolist(), whole):
                    found[o].setdefault(s, set()).add((bool(w), lower))
        assert any((x[0] or y[0]) and not (x[1] and y[1]) for s in found[0].keys() & found[1].keys() for x in found[0][s] for y in found[1][s])


@pytest.mark.parametrize("crowd", [2, 32])
def test_against_brute_force(spark, crowd):
    rng = random.Random(9)
    word = lambda: rng.choice("abcdefghijklmnop") + rng.choice("aeiou")
    texts = [None, "", " \t", "One", "one", "one two", "two one", "a b c d e", "A b c d e f"]
    common = [word() for _ in range(30)]
    for _ in range(25):
        base = [word() for _ in range(rng.choice([3, 6, 8, 9, 12, 15, 30, 60, 120, 300]))]
        if rng.random() < 0.5:
            base[len(base) // 2:len(base) // 2] = common
        for _ in range(rng.choice([1, 2, 3, 8])):
            new = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                new[rng.randrange(len(new))] = word()
            if rng.random() < 0.3:
                new += [word() for _ in range(rng.randint(1, 5))]
            texts.append(" ".join(new))
            base = new if rng.random() < 0.4 else base
    docs = [(rng.randint(0, 10_000) if rng.random() < 0.97 else None, t) for t in texts]
    docs += [docs[10], docs[11]]
    rows = spark.createDataFrame([(d, t, b"x") for d, t in docs], "doc_id long, text string, set_name binary")
    out = similar_documents(rows, crowd=crowd).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out), key=key) == sorted(components(docs), key=key)


def test_empty(spark):
    assert similar_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
