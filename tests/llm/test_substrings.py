import random

from hypothesis import given, settings
from hypothesis import strategies as st

from graphquarry.llm.substrings import drop_repeated_substrings
from graphquarry.llm.suffixes import front_code, front_decode, lcp, merge


def brute(texts, span):
    seen = {}
    for t in texts:
        for i in range(len(t) - span + 1):
            seen[t[i:i + span]] = seen.get(t[i:i + span], 0) + 1
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - span + 1):
            if seen[t[i:i + span]] > 1:
                gone[i:i + span] = [True] * span
        out.append((bytes(c for c, g in zip(t, gone) if not g), sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone)), sum(gone)))
    return out


STRINGS = st.lists(st.binary(max_size=6) | st.sampled_from([b"", b"aaaa", b"aaab", b"a" * 200, b"a" * 200 + b"b"]), max_size=12)


@settings(deadline=None, max_examples=200)
@given(st.lists(STRINGS.map(sorted), max_size=6))
def test_merge(runs):
    coded = [front_decode(front_code(r)) for r in runs]
    assert [c[0] for c in coded] == runs
    order, shared = merge(coded)
    merged = [runs[r][k] for r, k in order]
    assert merged == sorted(x for r in runs for x in r)
    assert shared == [lcp(a, b) for a, b in zip([b"", *merged], merged)]


def check(spark, texts, span, gram, **more):
    rows = [(k % 3 if k % 5 else None, t, "x") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    out = drop_repeated_substrings(docs, carry=("doc_id", "text", "kept"), span=span, gram=gram, **more).collect()
    got = sorted((r["text"] or "", bytes(r["kept"]), len(r["spans"]), sum(s["end"] - s["start"] for s in r["spans"])) for r in out)
    raw = [(t or "").encode() for t in texts]
    assert got == sorted((t or "", *b) for t, b in zip(texts, brute(raw, span)))


def test_against_brute_force(spark):
    rng = random.Random(5)
    for span, gram in ((20, 6), (12, 5)):
        base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 90))) for _ in range(25)]
        texts = [None, "", "a" * 300, "ab" * 150, "a" * 299 + "b", *base, base[3], base[3], base[4] + base[5]]
        for _ in range(60):
            t = rng.choice(base)
            a, b = sorted((rng.randint(0, len(t)), rng.randint(0, len(t))))
            u = rng.choice(base)
            texts.append(u[: len(u) // 2] + t[a:b] + u[len(u) // 2:])
        check(spark, texts, span, gram)
        check(spark, texts, span, gram, hot=2)


def test_a_gram_in_every_text_is_split(spark):
    rng = random.Random(7)
    shared = "".join(rng.choice("abcdefghij") for _ in range(64))
    texts = ["".join(rng.choice("klmnop") for _ in range(rng.randint(0, 40))) + shared[rng.randint(0, 9):64 - rng.randint(0, 9)] + "".join(rng.choice("qrstuv") for _ in range(30)) for _ in range(120)]
    check(spark, texts, 40, 8, hot=50)


def test_long_texts_and_empty_table(spark, monkeypatch):
    rng = random.Random(6)
    long = "".join(rng.choice("abcdefgh") for _ in range(300_000))
    out = drop_repeated_substrings(spark.createDataFrame([(1, long + long[1000:2000]), (2, "x" + long[500:900]), (3, long[:399])], "doc_id long, text string")).collect()
    cut = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in out}
    assert cut == {1: [(500, 900), (1000, 2000), (300_000, 301_000)], 2: [(1, 401)], 3: []}
    assert drop_repeated_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0
