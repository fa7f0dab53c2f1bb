import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphquarry.llm.chat import CONTROL, default_template, digest_conversations, escape, format_conversations, locate_turns, parse_default, unescape

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


@settings(deadline=None, max_examples=200)
@given(st.lists(st.sampled_from([*CONTROL, "\\", "<", "|", "a", "é", "\n", " "])).map("".join))
def test_escape_round_trip(text):
    assert unescape(escape(text)) == text
    assert not any(c in escape(text) for c in CONTROL)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "<|end|>"]), st.lists(st.sampled_from([*CONTROL, "\\", "x"])).map("".join)), max_size=5))
def test_turns_round_trip(turns):
    out, spans, rewrites = locate_turns(default_template, turns)
    assert not rewrites and out == default_template(turns) and parse_default(out) == turns
    assert [unescape(out[b:c]) for _, b, c, _ in spans] == [t for _, t in turns]


def test_moving_tail_and_rewriting_templates():
    turns = [("user", "a"), ("assistant", "bb"), ("user", "c")]
    out, spans, rewrites = locate_turns(lambda ts: "".join(f"[{r}]{t};" for r, t in ts) + "<eot>", turns)
    assert not rewrites and [out[b:c] for _, b, c, _ in spans] == ["a", "bb", "c"]
    assert locate_turns(lambda ts: f"{len(ts)}:" + "".join(t for _, t in ts), turns)[2]
    assert locate_turns(lambda ts: "".join(t if k == len(ts) - 1 else "" for k, (_, t) in enumerate(ts)), turns)[2]


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_nulls_ties_clashing_columns(spark):
    rows = [(1, 2, "assistant", "b", "z"), (1, 1, "user", None, "z"), (1, 1, "user", None, "z"), (None, 0, None, "n", None), (2, None, "assistant", "<|end|>", None)]
    out = {r["conv_id"]: r for r in digest_conversations(format_conversations(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert out[1]["n_turns"] == 3 and out[1]["turns_sha256"] == digest("user\n\nuser\n\nassistant\nb\n") and out[1]["loss_sha256"] == digest("b")
    assert out[None]["turns_sha256"] == digest("\nn\n") and out[None]["loss_chars"] == 0
    assert out[2]["loss_sha256"] == digest("<|end|>")


def test_empty_table(spark):
    assert digest_conversations(format_conversations(spark.createDataFrame([], SCHEMA))).count() == 0
