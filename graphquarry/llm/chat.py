"""Chat formatting by incremental black-box rendering.

A template is any function from a list of ``(role, text)`` to a string. Nothing
is known of its inside: the operator renders successive turn prefixes and
compares consecutive outputs. What an output adds to the one before is the new
turn's span; two probes that differ only in the text show where in that span
the text stands. A template whose output for a longer prefix doesn't continue
the shorter one (apart from a constant tail, which may move) rewrites history;
such conversations are flagged, and have no spans.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]

START, SPLIT, END = "<|start|>", "<|text|>", "<|end|>"
#: Control strings of this and of other usual templates.
CONTROL = ("<|start|>", "<|text|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))
_ESCAPED = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    """Double every backslash, then put one after the first character of each control string."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    """The inverse of :func:`escape`: of two backslashes one stays, a single one goes."""
    return _ESCAPED.sub(r"\1", text)


def default_template(turns: list[Turn]) -> str:
    return "".join(f"{START}{escape(role)}{SPLIT}{escape(text)}{END}\n" for role, text in turns)


def parse_default(formatted: str) -> list[Turn]:
    """Read the turns back from what :func:`default_template` wrote."""
    turns = []
    for piece in formatted.split(START)[1:]:
        role, _, rest = piece.partition(SPLIT)
        turns.append((unescape(role), unescape(rest[: rest.rindex(END)])))
    return turns


def _common(a: str, b: str) -> int:
    return len(os.path.commonprefix((a, b)))


def locate_turns(render: Callable[[list[Turn]], str], turns: list[Turn]) -> tuple[str, list[tuple[int, int, int, int]], bool]:
    """The rendered conversation, for each turn (span start, text start, text end, span end), and whether history is rewritten."""
    spans: list[tuple[int, int, int, int]] = []
    before = render([])
    for k, (role, text) in enumerate(turns):
        head = turns[:k]
        now = render([*head, (role, text)])
        shared = len(before) if now.startswith(before) else _common(before, now)
        tail = len(before) - shared
        if tail and not now.endswith(before[shared:]):
            return render(turns), [], True
        one, two = render([*head, (role, "\x01")]), render([*head, (role, "\x02")])
        at = _common(one, two)
        after = len(one) - at - 1
        if at < shared or one[at:at + 1] != "\x01" or len(now) < at + after or now[:at] != one[:at] or now[len(now) - after:] != one[at + 1:]:
            return render(turns), [], True
        spans.append((shared, at, len(now) - after, len(now) - tail))
        before = now
    return before, spans, False


def format_conversations(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    template: Callable[[list[Turn]], str] = default_template, trained_role: str = "assistant",
) -> DataFrame:
    """One row per conversation: ``conv, n_turns, formatted, spans, rewrites``.

    ``spans``: for each turn its role, its span and its text's span in code
    points, and whether the loss mask covers the text (it is the trained
    role's). Turns go by ``turn`` (null first), ties by role and text, so
    repeated rows stay and reruns agree. Null role or text: empty. Rows of a
    null ``conv`` form one conversation. Other columns are ignored. A
    conversation is read as a whole; memory and output grow with the longest.
    """
    kind = dict(rows.dtypes)[conv]
    schema = f"`{conv}` {kind}, n_turns bigint, formatted string, spans array<struct<role:string,start:int,text_start:int,text_end:int,end:int,loss:boolean>>, rewrites boolean"

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["k", "r", "x"], na_position="first", kind="stable")
        turns = list(zip(frame["r"], frame["x"]))
        out, spans, rewrites = locate_turns(template, turns)
        found = [{"role": r, "start": a, "text_start": b, "text_end": c, "end": d, "loss": r == trained_role} for (r, _), (a, b, c, d) in zip(turns, spans)]
        return pd.DataFrame({conv: [frame["c"].iloc[0]], "n_turns": [len(turns)], "formatted": [out], "spans": [found], "rewrites": [rewrites]})

    picked = rows.select(F.col(conv).alias("c"), F.col(turn).alias("k"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("r"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("x"))
    return picked.groupBy("c").applyInPandas(one, schema)


def digest_conversations(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Digests of what stands in the formatted output, read back from it alone."""
    kind = dict(formatted.dtypes)[conv]

    def digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for out, spans in zip(frame["formatted"], frame["spans"]):
                turns = parse_default(out)
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                loss = "".join(unescape(out[s["text_start"]:s["text_end"]]) for s in spans if s["loss"])
                rows.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(out)))
            yield pd.DataFrame({conv: frame[conv], **dict(zip(("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"), map(list, zip(*rows)) if rows else [[]] * 5))})

    return formatted.mapInPandas(digests, f"`{conv}` {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
