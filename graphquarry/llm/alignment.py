"""Alignment of two tokenizers' tokens through a dictionary of groups.

Where tokens of both tokenizers end at the same byte, a text falls into groups
of A ids and B ids. Most groups repeat, so each distinct group is interned once:
tasks number the groups of a chunk of documents and keep each document as those
numbers. The dictionary of all chunks holds a group with its frequency; the
links of its tokens are expanded once and multiplied by it, which counts all id
pairs of the corpus. What a group contributes to its documents is joined back by
the group's key, then added up chunk by chunk.

Tokens of neither kind span the place between a character that isn't white space
and a space, so texts are read in segments from one such place to the next, and
a worker tokenizes a segment once.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, materialize, steps, unsteps

#: Characters of a chunk of documents, and of those tokenized together.
CHUNK, PIECE = 6 << 20, 1 << 20
#: Characters of segments that are tokenized as one text.
TOGETHER = 1 << 13
#: Segments, and characters of them, that a worker remembers before it starts afresh.
REMEMBERED, REMEMBERED_CHARS = 200_000, 16 << 20

SEGMENT = re.compile(r"(?<=\S)(?= )")


def byte_level() -> dict[str, int]:
    """The bytes that the characters of a byte-level vocabulary stand for: printable ones themselves, others from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pair:
    """Both tokenizers, with the bytes of each token."""

    def __init__(self, a: bytes, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_buffer(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        byte = byte_level()
        vocab = json.loads(a)["model"]["vocab"]
        self.a_bytes: list[bytes] = [b""] * (max(vocab.values()) + 1)
        for piece, k in vocab.items():
            self.a_bytes[k] = bytes(byte[c] for c in piece if c in byte)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.a_len, self.b_len = (np.array([*map(len, x)], np.int64) for x in (self.a_bytes, self.b_bytes))
        self.space = self.b.piece_to_id("▁")

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """A and B ids of a text that starts with a space; B adds that space itself."""
        return self.a.encode(text, add_special_tokens=False).ids, self.b.encode(text[1:]) if len(text) > 1 else [self.space]

    def groups(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """A and B ids of consecutive segments, which A and B id each group ends with, and how many A and B ids come before each segment and after all; none if some bytes can't be had back from the tokens."""
        text = "".join(segments)
        a, b = self.encode(text)
        body = text.encode()
        if b"".join([self.a_bytes[k] for k in a]) != body or b"".join([self.b_bytes[k] for k in b]) != body:
            return None
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        ends, other = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        at = np.searchsorted(other, ends)
        both = other[np.minimum(at, len(other) - 1)] == ends
        cuts = np.concatenate([[0], np.cumsum([len(x) if x.isascii() else len(x.encode()) for x in segments])])
        before = np.searchsorted(ends, cuts[1:]) + 1, np.searchsorted(other, cuts[1:]) + 1
        if (ends[before[0] - 1] != cuts[1:]).any() or (other[before[1] - 1] != cuts[1:]).any():
            return None
        return a, b, np.flatnonzero(both), at[both], *(np.concatenate([[0], x]) for x in before)

    def links(self, key: str) -> Counter:
        """How often each (A id, B id) pair of a group overlaps."""
        a, b = ([int(x) for x in side.split(",")] for side in key.split("|"))
        out: Counter = Counter()
        j = start = 0
        right = [*accumulate(len(self.b_bytes[x]) for x in b)]
        for x in a:
            end = start + len(self.a_bytes[x])
            while True:
                out[x, b[j]] += 1
                if right[j] >= end:
                    j += right[j] == end
                    break
                j += 1
            start = end
        return out


_built: dict[bytes, Pair] = {}


def _pair(sent) -> Pair:
    """The tokenizers of this worker, which keeps the last two."""
    name = hashlib.sha256(sent.value[0] + b"|" + sent.value[1]).digest()
    if name not in _built:
        _built.clear()
        _built[name] = Pair(*sent.value)
    return _built[name]


def _intern(sent, names: list[str], by: str):
    """Documents (``c*``, ``chunk``, counts, ``groups``) and a chunk's groups (``chunk``, ``local``, ``group_key``, ``freq``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, chunk = _pair(sent), TaskContext.get().partitionId() << 33
        known: dict[str, tuple | None] = {}
        number: dict[str, int] = {}
        spelled: list[str] = []
        held: list[tuple] = []
        size = remembered = 0
        kinds: dict[str, pa.DataType] = {}

        def learn(segments: set[str]) -> None:
            """Tokenize what isn't known yet, many segments at once: those that end in white space, which could run into the next, alone."""
            nonlocal remembered
            some: list[str] = []
            chars = 0
            for segment in segments:
                if segment in known:
                    continue
                remembered += len(segment)
                if segment[-1].isspace():
                    take([segment])
                    continue
                some.append(segment)
                chars += len(segment)
                if chars > TOGETHER:
                    take(some)
                    some, chars = [], 0
            if some:
                take(some)

        def take(some: list[str]) -> None:
            found = pair.groups(some)
            if found is None:
                for segment in some if len(some) > 1 else ():
                    take([segment])
                if len(some) == 1:
                    known[some[0]] = None
                return
            a, b, last_a, last_b, upto_a, upto_b = found
            first_a, first_b = np.concatenate([[0], last_a[:-1] + 1]), np.concatenate([[0], last_b[:-1] + 1])
            numbers = np.empty(len(last_a), np.int64)
            single = (first_a == last_a) & (first_b == last_b)
            codes, back = np.unique(a[last_a[single]] << 32 | b[last_b[single]], return_inverse=True)
            numbers[single] = np.array([number.setdefault(f"{c >> 32}|{c & 0xFFFFFFFF}", len(number)) for c in codes.tolist()], np.int64)[back]
            left, right = [*map(str, a.tolist())], [*map(str, b.tolist())]
            more = np.flatnonzero(~single)
            numbers[more] = [number.setdefault(f"{','.join(left[i:k + 1])}|{','.join(right[j:m + 1])}", len(number)) for i, k, j, m in zip(first_a[more].tolist(), last_a[more].tolist(), first_b[more].tolist(), last_b[more].tolist())]
            ends = np.searchsorted(last_a, upto_a[1:] - 1) + 1
            each = numbers.tolist()
            start = 0
            for segment, end, x, y in zip(some, ends.tolist(), np.diff(upto_a).tolist(), np.diff(upto_b).tolist()):
                known[segment] = (each[start:end], x, y)
                start = end

        def document(segments: list[str]) -> tuple[int, int, list[int], str]:
            parts = [known[s] for s in segments]
            if not parts or None in parts:
                return 0, 0, [], ""
            mine, a, b = zip(*parts)
            mine = [*chain.from_iterable(mine)]
            if len(spelled) < len(number):
                spelled.extend([*number][len(spelled):])
            return sum(a), sum(b), mine, hashlib.sha256(";".join([spelled[k] for k in mine]).encode()).hexdigest()

        def chunk_rows() -> Iterator[pa.RecordBatch]:
            nonlocal chunk, size
            flat = np.fromiter(chain.from_iterable(d[1][2] for d in held), dtype=np.int64)
            used, ranks, times = np.unique(flat, return_inverse=True, return_counts=True)
            each = [np.sort(x) for x in np.split(ranks, np.cumsum([len(d[1][2]) for d in held])[:-1])]
            if by == "documents":
                times = np.bincount(np.concatenate([np.unique(x) for x in each]), minlength=len(used))
            n = len(held)
            out = {c: pa.array([d[0][k] for d in held], kinds[c]) if n else pa.nulls(0, kinds[c]) for k, c in enumerate(names)}
            out |= {"chunk": np.full(n, chunk), "n_a": pa.array([d[1][0] for d in held], pa.int64()), "n_b": pa.array([d[1][1] for d in held], pa.int64()), "n_groups": pa.array([len(x) for x in each], pa.int64())}
            out |= {"sha": pa.array([d[1][3] for d in held], pa.string()), "groups": pa.array([steps(x) for x in each], pa.binary())}
            out |= {"local": pa.nulls(n, pa.int32()), "group_key": pa.nulls(n, pa.string()), "freq": pa.nulls(n, pa.int64())}
            yield pa.record_batch(out)
            m = len(used)
            out = {c: pa.nulls(m, kinds[c]) for c in names} | {"chunk": np.full(m, chunk)} | {c: pa.nulls(m, pa.int64()) for c in ("n_a", "n_b", "n_groups")}
            out |= {"sha": pa.nulls(m, pa.string()), "groups": pa.nulls(m, pa.binary()), "local": np.arange(m, dtype=np.int32), "group_key": pa.array([spelled[k] for k in used.tolist()], pa.string()), "freq": times.astype(np.int64)}
            yield pa.record_batch(out)
            held.clear()
            chunk, size = chunk + 1, 0

        for batch in batches:
            kinds = {c: batch.schema.field(c).type for c in names}
            texts = batch.column("text").to_pylist()
            carried = list(zip(*(batch.column(c).to_pylist() for c in names))) if names else [()] * len(texts)
            first = 0
            while first < len(texts):
                last, chars = first, 0
                while last < len(texts) and (last == first or chars + len(texts[last] or "") <= PIECE):
                    chars += len(texts[last] or "")
                    last += 1
                if held and size + chars > CHUNK or len(known) > REMEMBERED or remembered > REMEMBERED_CHARS:
                    if held:
                        yield from chunk_rows()
                    if len(known) > REMEMBERED or remembered > REMEMBERED_CHARS:
                        known.clear()
                        number.clear()
                        spelled.clear()
                        remembered = 0
                split = [SEGMENT.split(" " + t) if t else [] for t in texts[first:last]]
                learn(set(chain.from_iterable(split)))
                held += zip(carried[first:last], map(document, split))
                size += chars
                first = last
        if held:
            yield from chunk_rows()

    return run


def _expand(sent):
    """Each distinct group's links, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(sent)
        for batch in batches:
            keys, freqs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = [(key, a, b, m, freq) for key, freq in zip(keys, freqs) for (a, b), m in pair.links(key).items()]
            if rows:
                k, a, b, m, f = zip(*rows)
                yield pa.record_batch({"group_key": pa.array(k, pa.string()), "a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "m": pa.array(m, pa.int64()), "freq": pa.array(f, pa.int64())})

    return run


def _sum_up(docs: pa.Table, results: pa.Table) -> pa.Table:
    """A chunk's documents with the sums of what their groups contribute."""
    values = np.zeros((3, results.num_rows), np.int64)
    at = results.column("local").to_numpy()
    for k, name in enumerate(("n_links", "n_best", "count_sum")):
        values[k, at] = results.column(name).to_numpy()
    sums = [values[:, unsteps(x)].sum(1) if x else np.zeros(3, np.int64) for x in docs.column("groups").to_pylist()]
    out = docs.drop_columns(["chunk", "groups"])
    for k, name in enumerate(("n_links", "n_best", "count_sum")):
        out = out.append_column(name, pa.array([int(s[k]) for s in sums], pa.int64()))
    return out


def _interned(docs: DataFrame, a: bytes, b: bytes, text: str, columns: list[str], by: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents as numbers of groups, the chunks' dictionaries and all distinct groups' links."""
    if by not in ("links", "documents"):
        raise ValueError("by is 'links' or 'documents'")
    sent = docs.sparkSession.sparkContext.broadcast((a, b))
    kinds, names = dict(docs.dtypes), [f"c{k}" for k in range(len(columns))]
    schema = "".join(f"{n} {kinds[c]}, " for n, c in zip(names, columns)) + "chunk long, n_a long, n_b long, n_groups long, sha string, groups binary, local int, group_key string, freq long"
    picked = docs.select(*(F.col(c).alias(n) for n, c in zip(names, columns)), F.col(text).cast("string").alias("text"))
    written = materialize(picked.mapInArrow(_intern(sent, names, by), schema), "groups")
    entries = written.filter("group_key is not null").select("chunk", "local", "group_key", "freq")
    distinct = entries.groupBy("group_key").agg(F.sum("freq").alias("freq"))
    links = materialize(distinct.mapInArrow(_expand(sent), "group_key string, a int, b int, m long, freq long"), "links")
    return written.filter("groups is not null").select(*names, "chunk", "n_a", "n_b", "n_groups", "sha", "groups"), entries, links


def _counted(links: DataFrame) -> DataFrame:
    return links.groupBy("a", "b").agg(F.sum(F.col("m") * F.col("freq")).alias("count"))


def pair_counts(docs: DataFrame, a: bytes, b: bytes, text: str = "text", by: str = "links") -> DataFrame:
    """``a``, ``b`` and ``count`` of all id pairs that are linked somewhere (see :func:`align_tokens`)."""
    return _counted(_interned(docs, a, b, text, [], by)[2])


def align_tokens(docs: DataFrame, a: bytes, b: bytes, text: str = "text", keys: tuple[str, ...] = ("doc_id",), by: str = "links") -> DataFrame:
    """``keys`` with ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and ``groups_sha256``.

    ``a`` is the file of a byte-level BPE, which reads a space and the text,
    ``b`` that of a sentence-piece model, which adds the space itself; no special
    tokens. Tokens that both end at one byte cut them into groups; A and B tokens
    whose bytes overlap are linked. A pair of ids counts its links in all
    documents, or with ``by="documents"`` those of each group once for each
    document that holds it. ``n_best`` are the links whose count is the highest
    that their B id has, ties included; ``count_sum`` adds the links' counts up.
    Null or empty texts, and those whose bytes either tokenizer doesn't give
    back, have no tokens: zeros and an empty digest. Repeated rows stay, each
    counted; an empty table gives none; other columns are ignored; a result whose
    name is that of a key gets ``_`` appended. A text longer than a chunk is one
    alone; a group may be as long as its text.
    """
    columns = list(keys)
    rows, entries, links = _interned(docs, a, b, text, columns, by)
    pairs = _counted(links)
    best = pairs.join(pairs.groupBy("b").agg(F.max("count").alias("most")), "b")
    worth = links.join(best, ["a", "b"]).groupBy("group_key").agg(
        F.sum("m").alias("n_links"), F.sum(F.when(F.col("count") == F.col("most"), F.col("m")).otherwise(0)).alias("n_best"), F.sum(F.col("m") * F.col("count")).alias("count_sum")
    )
    results = entries.select("chunk", "local", "group_key").join(worth, "group_key").select(F.col("chunk").alias("part"), "local", "n_links", "n_best", "count_sum")
    kinds = dict(docs.dtypes)
    schema = "".join(f"c{k} {kinds[c]}, " for k, c in enumerate(columns)) + "n_a long, n_b long, n_groups long, sha string, n_links long, n_best long, count_sum long"
    summed = rows.groupBy("chunk").cogroup(results.groupBy("part")).applyInArrow(_sum_up, schema)
    found = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "sha")
    names = free_names(("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"), columns)
    return summed.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(columns)), *(F.col(c).alias(n) for c, n in zip(found, names)))
