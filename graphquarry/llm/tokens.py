"""Token counts by a linear longest-match automaton.

The vocabulary becomes a trie whose nodes carry a failure link and the number
of pieces that longest-first matching would pop on following that link. A word
is read once, left to right: where no child fits, the popped count is added
and the link followed. So the greedy count is found in time linear in the word
and no piece is ever built.
"""

from __future__ import annotations

import base64
import hashlib
from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import empty_binary

#: Words that a worker remembers before it starts afresh: bounds its memory.
REMEMBERED = 100_000


def read_ranks(path: str) -> list[bytes]:
    """Pieces of a ``.tiktoken`` file."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


class LongestMatch:
    """Counts of greedy longest-match pieces of byte strings.

    Bytes that no piece starts with count as one piece each.
    """

    def __init__(self, pieces: Iterable[bytes]):
        step: dict[int, int] = {}
        ends = [False]
        for piece in {*pieces, *(bytes([b]) for b in range(256))} - {b""}:
            at = 0
            for byte in piece:
                key = at << 8 | byte
                if (to := step.get(key)) is None:
                    to = step[key] = len(ends)
                    ends.append(False)
                at = to
            ends[at] = True
        below: list[list[tuple[int, int]]] = [[] for _ in ends]
        for key, to in step.items():
            below[key >> 8].append((key & 255, to))
        fail, pops = [0] * len(ends), [0] * len(ends)
        queue = deque([0])
        while queue:
            at = queue.popleft()
            for byte, to in below[at]:
                queue.append(to)
                if ends[to]:
                    fail[to], pops[to] = 0, 1
                    continue
                state, count = fail[at], pops[at]
                while (found := step.get(state << 8 | byte)) is None:
                    count += pops[state]
                    state = fail[state]
                fail[to], pops[to] = found, count
        self.step, self.fail, self.pops = step, fail, pops

    def count(self, text: bytes) -> int:
        step, fail, pops = self.step, self.fail, self.pops
        state = total = 0
        for byte in text:
            while (to := step.get(state << 8 | byte)) is None:
                total += pops[state]
                state = fail[state]
            state = to
        while state:
            total += pops[state]
            state = fail[state]
        return total


def count_tokens(docs: DataFrame, pieces: list[bytes], text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys`` with ``n_bytes``, ``n_words`` and ``n_tokens`` of each whole text.

    Words are split at ASCII white space and matched with the space before
    them, as in vocabularies whose pieces carry it. Null text is empty and has
    0 tokens. Row by row, no shuffle; the pieces are broadcast, their size is
    that of the vocabulary file. Other columns are ignored, repeated rows stay.
    """
    spark: SparkSession = docs.sparkSession
    sent, name = spark.sparkContext.broadcast(pieces), digest_of(pieces)
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", n_bytes bigint, n_words bigint, n_tokens bigint"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = _machine(sent, name)
        known: dict[bytes, int] = {}
        for frame in frames:
            rows = []
            for body in frame.pop("__text"):
                words = body.split()
                total = 0
                for word in words:
                    if (n := known.get(word)) is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        n = known[word] = machine.count(b" " + word)
                    total += n
                rows.append((len(body), len(words), total))
            a, b, c = zip(*rows) if rows else ((), (), ())
            yield frame.assign(n_bytes=pd.Series(a, index=frame.index, dtype="int64"), n_words=pd.Series(b, index=frame.index, dtype="int64"), n_tokens=pd.Series(c, index=frame.index, dtype="int64"))

    return docs.select(*keys, empty_binary(F.col(text)).alias("__text")).mapInPandas(run, schema)


def digest_of(pieces: Iterable[bytes]) -> bytes:
    """A name for a vocabulary, from all its pieces."""
    out = hashlib.sha256()
    for piece in pieces:
        out.update(len(piece).to_bytes(4, "little") + piece)
    return out.digest()


_built: dict[bytes, LongestMatch] = {}


def _machine(sent, name: bytes) -> LongestMatch:
    """The automaton of a vocabulary; a Python worker keeps the last one."""
    if name not in _built:
        _built.clear()
        _built[name] = LongestMatch(sent.value)
    return _built[name]
