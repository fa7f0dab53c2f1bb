import random

import numpy as np

from graphquarry.llm.contamination import Index, align, find_passages, normalise


def edits(item, text):
    """Fewest edits of the item anywhere in the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def change(rng, text, n):
    text = list(text)
    for _ in range(n):
        k, what = rng.randrange(len(text)), rng.randrange(3)
        text[k:k + (what > 0)] = [rng.choice("xyz")] if what < 2 else []
    return "".join(text)


def test_align():
    rng = random.Random(3)
    for _ in range(150):
        item = "".join(rng.choice("abcd") for _ in range(rng.randint(8, 40)))
        text = "".join(rng.choice("abcd") for _ in range(10)) + change(rng, item, rng.randint(0, 5)) + "".join(rng.choice("abcd") for _ in range(10))
        a, b = normalise(item)[0], normalise(text)[0]
        got = align(a, b, -len(item), len(text), 99)
        assert got[0] == edits(item, text)
        assert edits(item, text[got[1]:got[2]]) == got[0]


def test_same_as_brute_force():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeioubcd") for _ in range(rng.randint(2, 7)))
    items = [" ".join(word() for _ in range(rng.randint(3, 30))) for _ in range(30)]
    index, hits = Index(list(enumerate(items))), 0
    for _ in range(150):
        k = rng.randrange(30)
        text = " ".join(word() for _ in range(8)) + " " + change(rng, items[k], rng.randint(0, int(len(items[k]) * 0.12))) + "\n " + " ".join(word() for _ in range(8))
        want = {j for j in range(30) if len(items[j]) >= 8 and edits(" ".join(items[j].split()), " ".join(text.split())) <= index.budget[j]}
        got = {f[0] for f in index.search(text)}
        assert got == want
        hits += len(want)
    assert hits > 40


def test_odd_input(spark):
    item = "The  Quick brown\tfox jumps over the lazy dog, and so on."
    docs = [(1, "x " + item.upper().replace(" ", "\n") + " y", 1), (2, None, 1), (3, "", 1), (None, item, 1), (None, item, 1), (4, ("pad " * 200_000) + item.replace("lazy", "crazy"), 1), (5, "a fox jumps over", 1)]
    items = [(7, item), (8, None), (9, ""), (7, item), (10, "jumps")]
    out = find_passages(spark.createDataFrame(docs, "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = sorted(((r["doc_id"] or 0), r["item_id"], r["start"], r["end"], r["edits"]) for r in out if r["item_id"] == 7)
    n = len(item)
    assert got == sorted([(0, 7, 0, n, 0)] * 4 + [(1, 7, 2, n + 2, 0)] * 2 + [(4, 7, 800_000, 800_000 + n + 1, 2)] * 2)
    assert sorted((r["doc_id"] or 0) for r in out if r["item_id"] == 10) == [0, 0, 1, 4, 5]
    assert find_passages(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert find_passages(spark.createDataFrame(docs, "doc_id long, text string, item_id int"), spark.createDataFrame([], "item_id long, text string")).count() == 0
