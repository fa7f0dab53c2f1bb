import re
from collections import Counter, defaultdict

import numpy as np

from graphquarry.llm.mixing import fill_targets, mixed, plan_mix, shard_quota


def test_targets():
    assert fill_targets([10.0, 10.0, 10.0], [5, 2, 1]) == [18.75, 7.5, 3.75]
    t = fill_targets([1.0, 100.0, 9.0], [5, 2, 1])
    assert t[0] == 3.0 and abs(sum(t) - 110) < 1e-9 and t[2] == 27.0
    assert fill_targets([], []) == [] and fill_targets([0.0], [5]) == [0.0]


def test_tree_splits_exactly():
    quotas = np.array([17, 0, 400, 3], dtype=np.int64)
    parts = [shard_quota(k, 7, quotas, 3) for k in range(7)]
    at = np.zeros(4, np.int64)
    for start, count in parts:
        assert (start == at).all()
        at += count
    assert (at == quotas).all() and max(c.sum() for _, c in parts) - min(c.sum() for _, c in parts) <= 1


def test_mix(spark):
    rng = np.random.default_rng(2)
    rows = [(k if k % 9 else None, " ".join("w" * int(n) for n in rng.integers(1, 5, rng.integers(0, 60))), [None, "a", "b", "c", "d", "ö"][int(rng.integers(6)) if k % 3 else 1], 0) for k in range(900)]
    rows += [(1000, None, "a", 0), (1001, "", "empty", 0), (1, "x y", "b", 0), (1, "x y", "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    planned = plan_mix(docs, carry=("doc_id", "text", "source"), shard_words=2000)
    out = planned.collect()
    assert sorted(map(str, out)) == sorted(map(str, plan_mix(docs, carry=("doc_id", "text", "source"), shard_words=2000).collect()))
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in out) == Counter(r[:3] for r in rows)
    taken, size, target = defaultdict(int), defaultdict(int), {}
    for r in out:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) and r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
    names = sorted((s for s in size if s is not None), key=str.encode) + [None]
    want = dict(zip(names, fill_targets([float(size[n]) for n in names], [(5.0, 2.0, 1.0)[k % 3] for k in range(len(names))])))
    for s in names:
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - want[s]) <= 30
    copies = mixed(planned, ("doc_id", "text")).collect()
    assert len(copies) == sum(len(r["draws"]) for r in out) and len({r["shard"] for r in copies}) > 5


def test_empty(spark):
    assert plan_mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
