import hashlib
import random
from collections import Counter
from pathlib import Path

import pytest

from graphquarry.llm.alignment import Pair, SEGMENT, align_tokens, pair_counts
from graphquarry.llm.queries import tokenizer_dir

A, B = (Path(tokenizer_dir(), n).read_bytes() for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
HARD = ["", " ", "  ", "a", " a", "a ", "a  ", "\n", "a\n b", "a \n", "\t\tx", "x y z", "x  y", "▁x", "a▁b", "<|endoftext|> x", "<s> [INST] </s>", "<unk>", "<0x41> b", "\x00 a\x00b", "it's we'll 'S", "　 　x", "á é", "ẛ̣ ﬁ", "日本語 テキスト", "🙂🙂 👩‍👩‍👧", "\x1c \x1d a", "  x  ", "a\r\n b\r\n", "        indented\n        more", "1234 567,89", "ﷺ ½ ²", "x" * 5000, "﻿a b", "​ ​"]


def whole(texts):
    """Both libraries on whole texts, links by comparing all byte ranges."""
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.decoders import ByteLevel  # noqa: F401

    ta = Tokenizer.from_buffer(A)
    ta.encode_special_tokens = True
    tb = sentencepiece.SentencePieceProcessor(model_proto=B)
    pair = Pair(A, B)
    docs, counts = [], Counter()
    for t in texts:
        a, b, ok = [], [], False
        if t:
            a, b = ta.encode(" " + t, add_special_tokens=False).ids, tb.encode(t)
            x, y = [pair.a_bytes[k] for k in a], [pair.b_bytes[k] for k in b]
            ok = b"".join(x) == b"".join(y) == (" " + t).encode()
        if not ok:
            docs.append(None)
            continue
        spans = []
        for ids, pieces in ((a, x), (b, y)):
            at, out = 0, []
            for k, p in zip(ids, pieces):
                out.append((at, at + len(p), k))
                at += len(p)
            spans.append(out)
        both = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        links, groups, start = [], [], 0
        for end in both:
            inside = [[s for s in side if start <= s[0] and s[1] <= end] for side in spans]
            groups.append("|".join(",".join(str(k) for *_, k in side) for side in inside))
            links += [(p[2], q[2]) for p in inside[0] for q in inside[1] if p[0] < q[1] and q[0] < p[1]]
            start = end
        counts.update(links)
        docs.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = Counter()
    for (_, k), n in counts.items():
        most[k] = max(most[k], n)
    out = [(0, 0, 0, 0, 0, 0, "") if d is None else (*d[:3], len(d[3]), sum(counts[x] == most[x[1]] for x in d[3]), sum(counts[x] for x in d[3]), d[4]) for d in docs]
    return out, counts


def prose(n, seed=1):
    rng = random.Random(seed)
    words = ["the", "tokenization", "Straße", "naïve", "x2=3", "don't", "über", "(see", "日本", "word.", "\nNew", "  gap", "É", "zqxj"]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(n)]


def test_segments_give_whole_texts_tokens():
    from tokenizers import Tokenizer

    pair, ta = Pair(A, B), Tokenizer.from_buffer(A)
    ta.encode_special_tokens = True
    for text in [t for t in HARD + prose(100) if t]:
        segments = SEGMENT.split(" " + text)
        assert "".join(segments) == " " + text
        a, b = zip(*map(pair.encode, segments))
        assert sum(a, []) == ta.encode(" " + text, add_special_tokens=False).ids
        assert sum(b, []) == pair.b.encode(text), repr(text)
    segments = sorted({s for text in HARD + prose(100) if text for s in SEGMENT.split(" " + text) if not s[-1].isspace()})
    alone, together = [*map(pair.encode, segments)], pair.encode("".join(segments))
    assert sum((a for a, _ in alone), []) == together[0] and sum((b for _, b in alone), []) == together[1]


def test_against_whole_texts(spark):
    texts = HARD + prose(150) + [None, prose(1, 9)[0], prose(1, 9)[0]]
    want, counts = whole(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: tuple(r)[1:] for r in align_tokens(docs, A, B).collect()}
    assert [got[k] for k in range(len(texts))] == want
    assert sum(w[0] > 0 for w in want) > 150 and sum(t not in (None, "") and w[0] == 0 for t, w in zip(texts, want)) >= 1
    assert {(r["a"], r["b"]): r["count"] for r in pair_counts(docs, A, B).collect()} == counts


def test_small_chunks_and_forgetting(spark):
    """Chunks of a document each and a worker that forgets give the same."""
    from graphquarry.llm import alignment

    texts = prose(60, 4)
    want, _ = whole(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    before = alignment.CHUNK, alignment.PIECE, alignment.REMEMBERED
    try:
        alignment.CHUNK, alignment.PIECE, alignment.REMEMBERED = 200, 100, 10
        got = {r["doc_id"]: tuple(r)[1:] for r in align_tokens(docs, A, B).collect()}
    finally:
        alignment.CHUNK, alignment.PIECE, alignment.REMEMBERED = before
    assert [got[k] for k in range(len(texts))] == want


def test_documents_as_weights(spark):
    texts = ["to to to be", "to be", "be"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    once, _ = whole([" ".join(dict.fromkeys(t.split())) for t in texts])
    got = sorted(tuple(r) for r in align_tokens(docs, A, B, by="documents").collect())
    counts = {(r["a"], r["b"]): r["count"] for r in pair_counts(docs, A, B, by="documents").collect()}
    assert counts == whole([" ".join(dict.fromkeys(t.split())) for t in texts])[1]
    assert got[1][1:] == once[1] and got[0][4] == 4
    with pytest.raises(ValueError):
        pair_counts(docs, A, B, by="words")


def test_clashing_names_repeats_and_empty(spark):
    rows = [(1, "a b", None, 2.5)] * 2 + [(None, "a b", "x", None)]
    docs = spark.createDataFrame(rows, "n_a int, text string, chunk string, local double")
    out = align_tokens(docs, A, B, keys=("n_a", "chunk"))
    assert out.columns == ["n_a", "chunk", "n_a_", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = whole(["a b"] * 3)[0]
    assert sorted(map(str, (tuple(r)[2:] for r in out.collect()))) == sorted(map(str, want))
    none = docs.limit(0)
    assert align_tokens(none, A, B, keys=("chunk",)).count() == 0 and pair_counts(none, A, B).count() == 0
