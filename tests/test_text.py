"""Text functions on odd and long texts."""

import re
import time

from pyspark.sql import functions as F

from graphquarry.functions import text


def brute(words: str | None) -> int | None:
    def code(w: str) -> bool:
        if len(w) < 2 or re.search(r"[a-z][A-Z]|[_$0-9]", w):
            return len(w) >= 2
        if re.fullmatch("[A-Z][a-z]+", w):
            return len(w) >= 4 and w.lower() not in text.STOP_WORDS
        return not re.fullmatch("[A-Z]{2,}", w) and re.search(rf"(?:^|[^A-Za-z0-9_$]){re.escape(w)}\(", words) is not None

    return None if words is None else sum(map(code, re.split(r"[^A-Za-z0-9_$]+", words)))


def test_code_words(spark):
    texts = [
        None, "", "(", "a(b(c(", "run run( run", "run running(", "prerun( run", "éfoo( foo", "$foo( foo", "foo$( foo$", "foo (foo)", "foo\n(foo", "AB( AB Ab( Ab ABc ABc(", "The Then Tree TREE Tree(",
        "x1 y_ $ $$ _ 9 99", "iPhone getX A a aB Ba", "foo(foo(foo", "zeta alpha( beta zeta( alpha", "Método( todo todo(", "Read read( Read( read", "aa( aa$ aa0 aa",
    ]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", text.code_words(F.col("t")).alias("n"))
    assert [r["n"] for r in df.orderBy("k").collect()] == [brute(t) for t in texts]


def test_code_words_of_a_long_text_take_linear_time(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    some = ["".join(letters[k // 26 ** p % 26] for p in range(4)) for k in range(150_000)]
    one = " ".join([*some, "zzzz()", "aaaa()", *some])  # zzzz is no other word of these, aaaa is the first of them
    began = time.monotonic()
    got = spark.createDataFrame([(one,)], "t string").select(text.code_words(F.col("t"))).first()[0]
    assert got == 1 + 1 + 2
    assert time.monotonic() - began < 30
