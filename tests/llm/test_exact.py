import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from graphquarry.llm.exact import Directory, drop_duplicates, find_duplicates, squeezed


def brute(rows):
    """(id, text) rows to their (id, keep_id, size, sha) and how many of each group stay."""
    groups = defaultdict(list)
    for name, text in rows:
        groups[re.sub(rb"[\x20\x09-\x0D]+", b" ", (text or "").encode())].append(name)
    out = []
    for body, names in groups.items():
        keep = min((n for n in names if n is not None), default=None)
        out += [(n, keep, len(names), hashlib.sha256(body).hexdigest()) for n in names]
    return out


def plain(rows):
    return sorted(map(repr, rows))


def texts(n, seed=3):
    rng = random.Random(seed)
    words = ["ä", "b", "cc", " ", "日本"]
    gaps = [" ", "  ", "\t", "\n\x0b", "\r\n \f"]
    return ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(0, 4))) for _ in range(n)]


def test_squeezed():
    for t in texts(300) + [" ", "\t a", "a ", "\x1c a\x85", "\x00", " "]:
        assert squeezed(t.encode()) == re.sub(rb"[\x20\x09-\x0D]+", b" ", t.encode())


def test_directory_doubles_and_splits():
    weights = np.zeros(1 << 10, np.int64)
    weights[0], weights[3], weights[700:900] = 50, 50, 7
    d = Directory(weights, 60, 8)
    assert len(d.table) == 1 << d.depth
    starts = {}
    for b, (depth, prefix) in enumerate(zip(d.local, d.prefix)):
        width = d.depth - depth
        assert (d.table[prefix << width:(prefix + 1) << width] == b).all() and (d.table == b).sum() == 1 << width
        assert d.weight(b) <= 60 or depth == 8
        starts[b] = prefix << width
    assert sum(map(d.weight, d.local and range(len(d.local)))) == weights.sum()
    owners = d.owners(7)
    assert (np.diff(owners) >= 0).all() and owners.max() < 7 and len(set(owners.tolist())) > 3
    assert all(len(set(owners[d.table == b].tolist())) == 1 for b in starts)
    alone = Directory(np.zeros(1 << 10, np.int64), 10)
    assert alone.depth == 0 and (alone.entries(np.arange(3, dtype=np.uint64)) == 0).all() and alone.owners(4).tolist() == [0]


@pytest.mark.parametrize("key_bits,bucket_bytes", [(64, 1 << 20), (3, 1), (1, 50)])
def test_against_brute_force(spark, key_bits, bucket_bytes):
    """Few key bits: different texts collide and share chains."""
    body = texts(400) + [None, "", " ", None, "x" * 300_000, "x" * 300_000, "x" * 299_999]
    body += ["hot text"] * 300
    rows = [(k if k % 50 else None, t) for k, t in enumerate(body, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = find_duplicates(docs, key_bits=key_bits, bucket_bytes=bucket_bytes).collect()
    assert plain((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == plain(brute(rows))
    kept = defaultdict(int)
    for r in got:
        kept[r["text_sha256"]] += r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert set(kept.values()) == {1}


def test_repeated_rows_clashing_names_and_carried_columns(spark):
    rows = [(7, "a", 1, None)] * 5 + [(7, "a ", 2, b"z"), (3, "b", 3, None), (None, "b", 4, None), (None, None, 5, None), (None, "", 6, None)]
    docs = spark.createDataFrame(rows, "Kept long, body string, keep_id int, key binary").repartition(3)
    out = find_duplicates(docs, "body", "Kept", ("keep_id", "key"))
    assert out.columns == ["Kept", "keep_id", "key", "keep_id_", "group_size", "kept_", "text_sha256"]
    got = out.collect()
    assert plain((r["Kept"], r["keep_id_"], r["group_size"], r["text_sha256"]) for r in got) == plain(brute([r[:2] for r in rows]))
    assert sorted((r["keep_id"] for r in got)) == sorted(r[2] for r in rows)
    assert sum(r["kept_"] for r in got) == 4
    left = drop_duplicates(docs, "body", "Kept")
    assert left.columns == docs.columns and sorted((r["body"] or "") for r in left.collect()) == ["", "a", "a ", "b"]


def test_empty_table_and_text_keys(spark):
    assert find_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = find_duplicates(spark.createDataFrame([("é", "t"), ("z", "t"), ("a", "t t")], "name string, text string"), key="name").collect()
    assert sorted((r["name"], r["keep_id"], r["kept"]) for r in got) == [("a", "a", True), ("z", "z", True), ("é", "z", False)]
