from hypothesis import given, settings
from hypothesis import strategies as st

from graphquarry.llm.tokens import LongestMatch, count_tokens


def greedy(pieces, text):
    pieces, n, at = {*pieces, *(bytes([b]) for b in range(256))}, 0, 0
    while at < len(text):
        at = max(e for e in range(at + 1, len(text) + 1) if text[at:e] in pieces)
        n += 1
    return n


WORDS = st.lists(st.sampled_from("abc"), max_size=12).map("".join).map(str.encode)


@settings(deadline=None, max_examples=300)
@given(st.lists(WORDS, max_size=8), WORDS)
def test_same_count_as_greedy(pieces, text):
    assert LongestMatch(pieces).count(text) == greedy(set(pieces) - {b""}, text)


def test_odd_input(spark):
    rows = [(1, None, 1), (2, "", 2), (None, "ab  ab\tc", 3), (4, "x" * 100_000, 4), (4, "x" * 100_000, 4)]
    out = count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens long"), [b" ab", b"xx"]).collect()
    assert sorted((r["n_words"], r["n_tokens"]) for r in out) == [(0, 0), (0, 0), (1, 50001), (1, 50001), (3, 4)]
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), [b"a"]).count() == 0


def test_vocabularies_that_begin_alike_in_one_worker(spark):
    shared = [bytes([97 + k % 26, 97 + k // 26]) for k in range(70)]
    docs = spark.createDataFrame([(1, "zzzz zzzz")], "doc_id long, text string").coalesce(1)
    one, two = shared + [b" zzzz"], shared + [b" zz  "]
    assert len(one) == len(two) and one[:64] == two[:64]
    assert [count_tokens(docs, v).first()["n_tokens"] for v in (one, two, one)] == [2, 10, 2]
