"""Removal of long repeated substrings by a distributed suffix merge sort.

A byte goes if a string of ``span`` bytes that covers it also starts elsewhere.
Not every suffix has to be sorted to find them. Of each window of ``span``
bytes the ``gram``-byte piece with the least hash is its *anchor*, so equal
windows have equal anchors at the same offset. Per anchor the text to its right
(a suffix) and to its left (a reversed prefix) are what decides:

1. Documents are dealt into blocks. Each block counts its anchors' grams, and a
   sum over blocks keeps those that occur twice or more.
2. Each block sorts the suffixes and the reversed prefixes at those anchors,
   front-codes both orders and sends them, as one run for each partition of
   grams.
3. A partition merges its runs with loser trees that carry common-prefix
   lengths. For each offset ``d`` the windows that start ``d`` bytes before
   their anchors are equal just if nothing below ``d`` stands between them in
   the left order and nothing below ``span - d`` in the right order. That needs
   the merged lengths only; a group of any size costs a sort, never its pairs.
4. The repeated stretches go back to the blocks, one packed row for each block
   and partition, and are cut.

Equal contexts in a block are sent once, with the places where they stand. A
gram that stands ``hot`` times or more doesn't go to one partition: its offsets
are split into ``RANGES`` ranges, and in each range an anchor goes where the
bytes send it that all windows of the range share. Equal windows share them, so
they still meet.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, U64, PowerTable, chunks, empty_binary, mix64, parts_for, word_hashes
from .suffixes import front_code, front_decode, merge, pack, unpack

#: Bytes of a block of documents and of a partition of runs, as the files have them.
BLOCK_BYTES, PART_BYTES = 4 << 20, 8 << 20
#: Bytes of text whose anchors are found at once; a longer text is read in pieces.
PIECE = 1 << 18
_TABLE, _OTHER = PowerTable(0xD6E8FEB86659FD93), PowerTable(0xA3B195354A39B70D)
_LOW = 20
#: Occurrences from which a gram is split, and into how many ranges of offsets.
HOT, RANGES = 1 << 14, 8


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive keys."""
    n = len(keys)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, dtype=U64)
    padded[:n] = keys
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1:n])


def find_anchors(texts: list[bytes], span: int, gram: int) -> tuple[np.ndarray, ...]:
    """For all anchors: text number, position, least and greatest offset of its windows, hash of its gram.

    Offset ``d`` stands for the window that starts ``d`` bytes before the anchor.
    """
    width = span - gram + 1
    out = []
    long = [(k, 0, t) for k, t in enumerate(texts) if len(t) >= span]
    pieces = ((k, a, t[a:a + PIECE + span - 1]) for k, _, t in long for a in range(0, len(t) - span + 1, PIECE))
    for some in chunks(pieces, PIECE * 2, lambda x: len(x[2])):
        joined = np.frombuffer(b"".join(x[2] for x in some), dtype=np.uint8)
        ends = np.cumsum([len(x[2]) for x in some])
        starts = ends - [len(x[2]) for x in some]
        n = len(joined)
        up, down = _TABLE.upto(n + 1)
        sums = np.zeros(n + 1, dtype=U64)
        np.cumsum((joined.astype(U64) + U64(1)) * down[:n], out=sums[1:])
        hashes = mix64((sums[gram:] - sums[:-gram]) * up[gram:])
        keys = (hashes >> U64(_LOW) << U64(_LOW)) | np.arange(len(hashes), dtype=U64)
        at = (_least(keys, width) & U64((1 << _LOW) - 1)).astype(np.int64)
        windows = np.concatenate([np.arange(a, b - span + 1) for a, b in zip(starts, ends)])
        at = at[windows]
        piece = np.repeat(np.arange(len(some)), ends - starts - span + 1)
        first = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(piece, prepend=-1) != 0))
        last = np.append(first[1:], len(at)) - 1
        anchor, of = at[first], piece[first]
        base = np.array([x[1] for x in some]) - starts
        out.append((np.array([x[0] for x in some])[of], anchor + base[of], anchor - windows[last], anchor - windows[first], hashes[anchor]))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, U64))
    return tuple(np.concatenate(x) for x in zip(*out))


def _distinct(table: pa.Table) -> tuple[list[bytes], np.ndarray]:
    """The block's texts without copies, and how many copies each has; shared order is by text."""
    count: dict[bytes, int] = {}
    for text in table.column("__text").to_pylist():
        count[text] = count.get(text, 0) + 1
    texts = sorted(count)
    return texts, np.array([count[t] for t in texts], dtype=np.int64)


def _digest(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def _count_grams(span: int, gram: int):
    def run(table: pa.Table) -> pa.Table:
        texts, copies = _distinct(table)
        doc, _, _, _, hashes = find_anchors(texts, span, gram)
        found, of = np.unique(hashes, return_inverse=True)
        times = np.bincount(of, weights=copies[doc], minlength=len(found)) if len(found) else np.zeros(0)
        block = table.column("__block")[0].as_py()
        return pa.table({"__block": pa.array(np.full(len(found), block, np.int64)), "gram": pa.array(found.view(np.int64)), "n": pa.array(times.astype(np.int64))})

    return run


def _shares(texts: list[bytes], doc: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, chosen: np.ndarray, span: int, gram: int, parts: int):
    """For each of the ``chosen`` anchors and range of offsets that it has windows in: anchor, partition, least and greatest offset."""
    wide = -(-(span - gram + 1) // RANGES)
    out = []
    for k in chosen.tolist():
        text, p = texts[doc[k]], int(at[k])
        for first in range(int(low[k]) // wide * wide, int(high[k]) + 1, wide):
            name = hashlib.blake2b(text[p - first:p - first - wide + 1 + span], digest_size=8, salt=first.to_bytes(4, "little")).digest()
            out.append((k, int.from_bytes(name, "little") % parts, max(first, int(low[k])), min(first + wide - 1, int(high[k]))))
    return np.array(out, dtype=np.int64).reshape(-1, 4).T


def _make_runs(span: int, gram: int, parts: int, hot: int):
    def run(table: pa.Table, wanted: pa.Table) -> pa.Table:
        out_part, out_run = [], []
        if len(table) and len(wanted):
            texts, copies = _distinct(table)
            block = table.column("__block")[0].as_py()
            order = np.argsort(wanted.column("gram").to_numpy())
            keep, many = wanted.column("gram").to_numpy()[order], wanted.column("n").to_numpy()[order]
            doc, at, low, high, hashes = find_anchors(texts, span, gram)
            signed = hashes.view(np.int64)
            place = np.minimum(np.searchsorted(keep, signed), len(keep) - 1)
            known = keep[place] == signed
            whole = np.flatnonzero(known & (many[place] < hot))
            split = _shares(texts, doc, at, low, high, np.flatnonzero(known & (many[place] >= hot)), span, gram, parts)
            chosen, part, low, high = (np.concatenate(x) for x in zip((whole, (hashes[whole] % U64(parts)).astype(np.int64), low[whole], high[whole]), split))
            order = np.argsort(part, kind="stable")
            chosen, part, low, high = chosen[order], part[order], low[order], high[order]
            borders = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
            digests: dict[int, bytes] = {}
            for a, b in zip(borders[:-1], borders[1:]):
                found: dict[tuple[bytes, bytes], list[tuple[int, int]]] = {}
                for k, x, y in zip(chosen[a:b], low[a:b].tolist(), high[a:b].tolist()):
                    d, p = int(doc[k]), int(at[k])
                    text = texts[d]
                    found.setdefault((text[p:p - x + span], text[p - y:p][::-1]), []).append((d, p))
                entries = sorted(found)
                left = sorted(range(len(entries)), key=lambda e: entries[e][1])
                docs = sorted({d for e in entries for d, _ in found[e]})
                number = {d: n for n, d in enumerate(docs)}
                for d in docs:
                    if d not in digests:
                        digests[d] = _digest(texts[d])
                out_part.append(int(part[a]))
                out_run.append(pack((
                    block, front_code([e[0] for e in entries]), left, front_code([entries[e][1] for e in left]),
                    [len(found[e]) for e in entries], [number[d] for e in entries for d, _ in found[e]], [p for e in entries for _, p in found[e]],
                    [digests[d] for d in docs], [int(copies[d]) for d in docs],
                )))
        return pa.table({"part": pa.array(out_part, pa.int64()), "run": pa.array(out_run, pa.binary())})

    return run


def repeated_offsets(right_share: np.ndarray, left_share: np.ndarray, right_at: np.ndarray, left_at: np.ndarray, low: np.ndarray, high: np.ndarray, times: np.ndarray, span: int) -> np.ndarray:
    """For each offset and entry: whether the window at that offset occurs twice or more.

    ``*_share``: what neighbours in the merged order share; ``*_at``: an entry's place in that order.
    """
    n = len(times)
    out = np.zeros((int(high.max()) + 1 if n else 0, n), dtype=bool)
    for d in range(len(out)):
        here = np.flatnonzero((low <= d) & (d <= high))
        if not len(here):
            continue
        right = np.cumsum(right_share < span - d)[right_at[here]]
        left = np.cumsum(left_share < d)[left_at[here]]
        _, group = np.unique(right * np.int64(n + 1) + left, return_inverse=True)
        out[d, here] = np.bincount(group, weights=times[here])[group] >= 2
    return out


def _merge_runs(span: int):
    def run(table: pa.Table) -> pa.Table:
        runs = [unpack(x) for x in sorted(table.column("run").to_pylist())]
        rights, lefts, base = [], [], [0]
        for r in runs:
            rights.append(front_decode(r[1]))
            lefts.append(front_decode(r[3]))
            base.append(base[-1] + len(r[1][0]))
        n = base[-1]
        order, right_share = merge(rights)
        right_at = np.empty(n, np.int64)
        right_at[[base[r] + k for r, k in order]] = np.arange(n)
        order, left_share = merge(lefts)
        left_at = np.empty(n, np.int64)
        left_at[[base[r] + runs[r][2][k] for r, k in order]] = np.arange(n)
        low = span - np.array([x for r in runs for x in r[1][1]], dtype=np.int64)
        high = np.empty(n, np.int64)
        for r, b in zip(runs, base):
            high[b + np.array(r[2], dtype=np.int64)] = r[3][1]
        docs = np.cumsum([0, *(len(r[7]) for r in runs)])
        size = np.concatenate([np.array(r[4], dtype=np.int64) for r in runs])
        place = np.concatenate([np.array(r[5], dtype=np.int64) + d for r, d in zip(runs, docs)])
        at = np.concatenate([np.array(r[6], dtype=np.int64) for r in runs])
        copies = np.concatenate([np.array(r[8], dtype=np.int64) for r in runs])
        digests = [x for r in runs for x in r[7]]
        blocks = np.repeat(np.array([r[0] for r in runs], dtype=np.int64), np.diff(docs))
        entry = np.repeat(np.arange(n), size)
        times = np.bincount(entry, weights=copies[place], minlength=n)
        twice = repeated_offsets(np.array(right_share), np.array(left_share), right_at, left_at, low, high, times, span)
        edge = np.diff(np.pad(twice.astype(np.int8), ((1, 1), (0, 0))), axis=0).T
        of, first = np.nonzero(edge == 1)
        _, after = np.nonzero(edge == -1)
        begins = np.cumsum(size) - size
        rows = size[of]
        which = np.repeat(begins[of] - np.cumsum(rows) + rows, rows) + np.arange(rows.sum())
        a, b = at[which] - np.repeat(after - 1, rows), at[which] - np.repeat(first, rows) + span
        return _replies(blocks, digests, place[which], a, b)

    return run


def _replies(blocks: np.ndarray, digests: list[bytes], doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Table:
    """A row for each block: digests of its texts, how many stretches each has, and the stretches, united."""
    if not len(doc):
        return pa.table({"__block": pa.array([], pa.int64()), "found": pa.array([], pa.binary())})
    far = np.int64(1 << 33)
    order = np.lexsort((a, doc))
    doc, a, b = doc[order], a[order] + doc[order] * far, b[order] + doc[order] * far
    reach = np.maximum.accumulate(b)
    first = np.flatnonzero(np.append(True, a[1:] > reach[:-1]))
    last = np.append(first[1:], len(a)) - 1
    doc = doc[first]
    a, b = a[first] - doc * far, reach[last] - doc * far
    used, start, many = np.unique(doc, return_index=True, return_counts=True)
    out: dict[int, list] = {}
    for d, x, n in zip(used.tolist(), start.tolist(), many.tolist()):
        names, counts, lows, highs = out.setdefault(int(blocks[d]), ([], [], [], []))
        names.append(digests[d])
        counts.append(n)
        lows.append(a[x:x + n])
        highs.append(b[x:x + n])
    packed = [pack((names, counts, np.concatenate(x).astype("<i4"), np.concatenate(y).astype("<i4"))) for names, counts, x, y in out.values()]
    return pa.table({"__block": pa.array(list(out), pa.int64()), "found": pa.array(packed, pa.binary())})


def _unite(spans: np.ndarray) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in spans[np.argsort(spans[:, 0], kind="stable")].tolist():
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _whole(text: bytes, a: int, b: int) -> tuple[int, int]:
    """The stretch with the characters that it touches."""
    while a and text[a] & 0xC0 == 0x80:
        a -= 1
    while b < len(text) and text[b] & 0xC0 == 0x80:
        b += 1
    return a, b


def word_windows(texts: list[bytes], words: int, gram: int = 8) -> tuple[np.ndarray, ...]:
    """For all windows of ``words`` words: text number, number of the first word, hash of the least gram, two hashes."""
    hashes, counts = word_hashes(texts)
    doc, n = np.repeat(np.arange(len(texts)), counts), len(hashes) - words + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), *(np.zeros(0, U64) for _ in range(3))

    def rolled(table: PowerTable, width: int) -> np.ndarray:
        up, down = table.upto(len(hashes) + 1)
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(hashes * up[: len(hashes)], dtype=U64)])
        return mix64((sums[width:] - sums[:-width]) * down[: len(hashes) - width + 1])

    good = np.flatnonzero(doc[:n] == doc[words - 1:])
    least = _least(rolled(_TABLE, gram), words - gram + 1)
    return doc[good], good, least[good], rolled(_TABLE, words)[good], rolled(_OTHER, words)[good]


def _counted(hashes: np.ndarray, names: tuple[str, ...], block: int) -> pa.Table:
    """Distinct rows of ``hashes`` and how often each is there."""
    found, n = np.unique(hashes, axis=0, return_counts=True)
    return pa.table({"__block": np.full(len(n), block, np.int64), **{c: found[:, k].view(np.int64) for k, c in enumerate(names)}, "n": n.astype(np.int64)})


def _pieces(table: pa.Table):
    return chunks(table.column("__text").to_pylist(), PIECE)


def _count_word_grams(words: int):
    def run(table: pa.Table) -> pa.Table:
        # Windows side by side share their least gram, so it counts once for each run of them, and again where windows of one piece are equal.
        rows = [np.zeros(0, U64)]
        for some in _pieces(table):
            doc, _, least, one, _ = word_windows(some, words)
            _, of, n = np.unique(one, return_inverse=True, return_counts=True)
            rows.append(least[n[of] > 1])
            rows.append(least[(np.diff(least, prepend=U64(0)) != 0) | (np.diff(doc, prepend=-1) != 0)])
        return _counted(np.concatenate(rows)[:, None], ("gram",), table.column("__block")[0].as_py())

    return run


def _count_windows(words: int):
    def run(table: pa.Table, twice: pa.Table) -> pa.Table:
        known, rows = twice.column("gram").to_numpy().view(U64), [np.zeros((0, 2), U64)]
        for some in _pieces(table) if len(known) else ():
            _, _, least, one, two = word_windows(some, words)
            rows.append(np.stack([one, two], 1)[np.isin(least, known)])
        return _counted(np.concatenate(rows), ("one", "two"), table.column("__block")[0].as_py() if len(table) else 0)

    return run


def _word_places(words: int):
    def run(table: pa.Table, again: pa.Table) -> pa.Table:
        first = np.sort(again.column("one").to_numpy().view(U64))
        known = set(zip(again.column("one").to_pylist(), again.column("two").to_pylist()))
        names, places = {}, []
        for some in _pieces(table) if known else ():
            doc, at, _, one, two = word_windows(some, words)
            hit = np.flatnonzero(np.isin(one, first))
            hit = hit[[x in known for x in zip(one[hit].view(np.int64).tolist(), two[hit].view(np.int64).tolist())]] if len(hit) else hit
            if not len(hit):
                continue
            space = SPACE[np.frombuffer(b" ".join(some) + b" ", dtype=np.uint8)]
            edge = np.diff(space.astype(np.int8), prepend=np.int8(1))
            start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
            base = np.cumsum([0, *(len(t) + 1 for t in some)])
            new = np.flatnonzero((np.diff(at[hit], prepend=-2) != 1) | (np.diff(doc[hit], prepend=-1) != 0))
            for a, b in zip(new.tolist(), [*new[1:].tolist(), len(hit)]):
                d, low, high = doc[hit[a]], at[hit[a]], at[hit[b - 1]] + words - 1
                places.append((names.setdefault(_digest(some[d]), len(names)), start[low] - base[d], end[high] - base[d]))
        block = table.column("__block")[0].as_py() if len(table) else 0
        return _replies(np.full(len(names), block), list(names), *np.array(places, np.int64).reshape(-1, 3).T)

    return run


def _cut(schema: pa.Schema, characters: bool):
    def run(table: pa.Table, found: pa.Table) -> pa.Table:
        parts: dict[bytes, list[np.ndarray]] = {}
        for names, counts, low, high in map(unpack, found.column("found").to_pylist()):
            at = 0
            for name, n in zip(names, counts):
                parts.setdefault(name, []).append(np.stack([low[at:at + n], high[at:at + n]], axis=1))
                at += n
        spans = {name: _unite(np.concatenate(x)) for name, x in parts.items()}
        kept, cuts = [], []
        for text in table.column("__text").to_pylist():
            cut = spans.get(_digest(text), []) if spans else []
            if characters:
                cut = [_whole(text, a, b) for a, b in cut]
            at, rest = 0, []
            for a, b in cut:
                rest.append(text[at:a])
                at = max(at, b)
            kept.append(b"".join([*rest, text[at:]]) if cut else text)
            cuts.append([{"start": a, "end": b} for a, b in cut])
        out = table.drop_columns(["__block", "__text"])
        out = out.append_column("kept", pa.array(kept, pa.binary())).append_column("spans", pa.array(cuts, schema.field("spans").type))
        return out

    return run


def drop_repeated_substrings(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), span: int = 400, gram: int = 51, characters: bool = False, words: int = 0, hot: int = HOT) -> DataFrame:
    """``carry`` with ``kept`` (binary, the bytes left) and ``spans`` (the bytes cut, array of start and end).

    Texts are UTF-8 bytes, null is empty; a text below ``span`` bytes stays as
    it is. With ``characters`` a stretch takes along the characters whose bytes it
    splits, so what is left is UTF-8. Every row counts: repeated rows are copies of each other, whatever
    their ids, and null or equal ids do no harm, as places are found by content.
    ``carry`` columns come back unchanged, but one named ``kept`` or ``spans``
    gives way to the result; others are ignored. With ``words``,
    runs of so many words that stand twice go too, however short in bytes; they
    are compared lower-cased and whatever white space is between them. Of their
    windows only those are hashed and sent whose least 8-word gram stands twice.
    A text is read whole in one task, as is a block of ``BLOCK_BYTES``.
    """
    carry = tuple(c for c in carry if c not in ("kept", "spans"))
    held = [f"c{k}" for k in range(len(carry))]
    blocks, parts = parts_for(docs, BLOCK_BYTES), parts_for(docs, PART_BYTES)
    body = empty_binary(F.col(text))
    dealt = docs.select(
        F.pmod(F.xxhash64(body, *(F.col(c) for c in carry if c != text)) + F.spark_partition_id() * F.lit(7919), F.lit(blocks)).alias("__block"), body.alias("__text"), *(F.col(c).alias(h) for c, h in zip(carry, held))
    ).repartition("__block")
    grams = dealt.groupBy("__block").applyInArrow(_count_grams(span, gram), "__block long, gram long, n long")
    twice = grams.withColumn("n", F.sum("n").over(Window.partitionBy("gram"))).filter("n >= 2")
    runs = dealt.groupBy("__block").cogroup(twice.groupBy("__block")).applyInArrow(_make_runs(span, gram, parts, hot), "part long, run binary")
    found = runs.groupBy("part").applyInArrow(_merge_runs(span), "__block long, found binary")
    if words:
        common = lambda df, *by: df.withColumn("n", F.sum("n").over(Window.partitionBy(*by))).filter("n >= 2").select("__block", *by)
        pairs = common(dealt.groupBy("__block").applyInArrow(_count_word_grams(words), "__block long, gram long, n long"), "gram")
        again = common(dealt.groupBy("__block").cogroup(pairs.groupBy("__block")).applyInArrow(_count_windows(words), "__block long, one long, two long, n long"), "one", "two")
        found = found.unionByName(dealt.groupBy("__block").cogroup(again.groupBy("__block")).applyInArrow(_word_places(words), "__block long, found binary"))
    schema = "".join(f"{h} {f.dataType.simpleString()}, " for h, f in zip(held, docs.select(*carry).schema)) + "kept binary, spans array<struct<start:int,end:int>>"
    spans = pa.schema([("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
    cut = dealt.groupBy("__block").cogroup(found.groupBy("__block")).applyInArrow(_cut(spans, characters), schema)
    return cut.select(*(F.col(h).alias(c) for c, h in zip(carry, held)), "kept", "spans")
