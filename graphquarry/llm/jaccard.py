"""Similarity join of documents' word shingles by partitioning the universe.

Sets of sizes in one band are cut into the same segments by hashing shingles.
Two sets that are similar enough differ in at most ``H`` shingles, so by the
pigeonhole principle some segments are equal, or differ in one shingle only:

* an *exact* segment is indexed by its content and misses a pair only if it
  holds a difference (weight 1);
* a *deletion* segment is indexed by its content and by each of its one-deletion
  neighbours and misses a pair only if it holds two differences (weight 2).

How many of each a band has is chosen by cost (signatures that are sent, and
chance hits, which grow with the band's documents), under the condition that
all weights sum to ``H + 1 + spare``. So similar sets meet in segments of weight
``spare + 1`` at least. Contents that say nothing (empty ones) aren't indexed:
a set for which they weigh more than ``spare`` is hashed anew, at the next level
with another seed, where it meets all sets in the same case. Contents that more
than ``CROWD`` sets share are not paired off, and need not be, but for sets in
which they weigh more than ``spare`` together with the empty ones.

Candidates are compared by sketches, which bound the difference from below, and
those that may be linked are verified on the texts. Links are found in three
rounds: each set with its most frequent companion; then, of candidates that are
not yet in one component, as many as would join the components; then all that
are still apart. Texts move only for sets in such pairs: a bitmap of fixed size
keeps most others back where they are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, chunks, discard, empty_binary, materialize, mix64, parts_for, planes, small_batches, unplanes, word_hashes
from .components import connected_components
from .suffixes import pack, unpack

#: Words of a shingle; a link needs ``PERCENT * union <= 100 * intersection``.
WORDS, PERCENT = 5, 80
#: Levels of hashing; members of a content that are paired off at most.
LEVELS, CROWD = 6, 32
#: Bits of the least sketch, and of the bitmap of sets whose texts are asked for; members of a crowd in a row.
SKETCH, SIEVE, ROW = 512, 1 << 26, 32
#: Bytes of text that are shingled at once, signatures that a task holds, and bytes of input for each partition of signatures.
PIECE, HELD, PART_BYTES = 1 << 19, 1 << 20, 8 << 20


def band_bounds(most: int = 1 << 31) -> list[tuple[int, int]]:
    """Bands of sizes; a set's similar smaller sets lie in its own band or the one below."""
    out, low = [], 1
    while low < most:
        high = low * 100 // PERCENT
        out.append((low, high))
        low = high + 1
    return out


BANDS = band_bounds()
_LOWS = np.array([a for a, _ in BANDS], dtype=np.int64)


def _poisson_tail(mean: float, least: int) -> float:
    """P(X >= least)."""
    term, below = math.exp(-mean), 0.0
    for k in range(least):
        below += term
        term *= mean / (k + 1)
    return max(0.0, 1.0 - below)


def allocate(band: int, documents: int) -> tuple[int, int, int]:
    """Exact segments, deletion segments and spare weight of a band, at the least estimated cost."""
    low, high = BANDS[band]
    need, best = high // 4 + 1, None
    spares = sorted({0, *range(1, 9), need // 8, need // 4, need // 2}) if need > 2 else (0, 1)
    for spare in spares:
        weight = need + spare
        doubles = sorted({*range(min(weight // 2, 12) + 1), weight // 8, weight // 4, weight // 2, *({(weight + 1) // 2} if weight % 2 else ())})
        for g in doubles:
            f = max(0, weight - 2 * g)
            mean = low / (f + g)
            none, one, two = math.exp(-mean), mean * math.exp(-mean), mean * mean / 2 * math.exp(-mean)
            if f + g == 1:
                none = one = two = 0.0
            sent = f + g * (1 + mean)
            chance = documents * 1e-4 * (f * one + g * (one + two))
            again = _poisson_tail(f * none + 2 * g * (none + one), spare + 1 + (2 * g + f - weight))
            cost = sent + chance + 20 * sent * again
            if best is None or cost < best[0]:
                best = (cost, f, g, f + 2 * g - need)
    return best[1:]


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, in the texts' order, and how many each has."""
    hashes, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    n = len(hashes)
    if n >= WORDS:
        rolled = np.zeros(n - WORDS + 1, dtype=U64)
        for j in range(WORDS):
            rolled = rolled * U64(0x9E3779B97F4A7C15) + hashes[j:n - WORDS + 1 + j]
        doc = np.repeat(np.arange(len(texts)), counts)
        inside = doc[WORDS - 1:] == doc[: n - WORDS + 1]
        rolled, doc = mix64(rolled)[inside], doc[: n - WORDS + 1][inside]
    else:
        rolled, doc = np.zeros(0, U64), np.zeros(0, np.int64)
    few = np.flatnonzero((counts > 0) & (counts < WORDS))
    if len(few):
        short = np.zeros(len(few), dtype=U64)
        for j in range(WORDS - 1):
            has = counts[few] > j
            at = np.minimum(ends[few] - counts[few] + j, n - 1)
            short = np.where(has, short * U64(0xC2B2AE3D27D4EB4F) + hashes[at], short)
        rolled, doc = np.concatenate([rolled, mix64(short + counts[few].astype(U64))]), np.concatenate([doc, few])
    order = np.lexsort((rolled, doc))
    rolled, doc = rolled[order], doc[order]
    new = np.ones(len(rolled), dtype=bool)
    new[1:] = (rolled[1:] != rolled[:-1]) | (doc[1:] != doc[:-1])
    return rolled[new], np.bincount(doc[new], minlength=len(texts))


def set_keys(shingles: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set, which together name it."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    out = []
    for seed in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        sums = np.zeros(len(sizes), dtype=U64)
        np.add.at(sums, doc, mix64(shingles ^ U64(seed)))
        out.append(mix64(sums + sizes.astype(U64)))
    return out[0], out[1]


def _names(one: np.ndarray, two: np.ndarray) -> list[bytes]:
    both = np.stack([one, two], axis=1).astype(">u8").tobytes()
    return [both[k:k + 16] for k in range(0, len(both), 16)]


def sketches(shingles: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """The parity of each set's shingles in each of ``SKETCH`` or more classes, at least four for each shingle.

    A shingle that only one of two sets has turns one bit over, so sketches
    differ in no more bits than sets do in shingles. Numbers of classes are
    powers of two; a wider sketch is folded by XOR of its halves.
    """
    mixed, out, at = mix64(shingles ^ U64(0x2545F4914F6CDD1D)), [], 0
    for n in sizes.tolist():
        wide = max(SKETCH, 1 << (4 * n - 1).bit_length()) if n else SKETCH
        place = (mixed[at:at + n] & U64(wide - 1)).astype(np.int64)
        out.append(np.packbits((np.bincount(place, minlength=wide) & 1).astype(np.uint8)).tobytes())
        at += n
    return out


def fold(bits: bytes, size: int) -> np.ndarray:
    x = np.frombuffer(bits, dtype=np.uint8)
    while len(x) > size:
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    return x


def signatures(shingles: np.ndarray, sizes: np.ndarray, plan: np.ndarray, lower: bool):
    """Signatures in each set's own band, or in the band below.

    ``plan``: exact segments, deletion segments and spare weight of each band.
    Yields for each level: set number, signature, whether of a whole content,
    weight; and the slack of each set, or none.
    """
    starts = np.cumsum(sizes) - sizes
    band = np.searchsorted(_LOWS, np.maximum(sizes, 1), side="right") - 1 - int(lower)
    who = np.flatnonzero((sizes > 0) & (band >= 0))
    for level in range(LEVELS):
        if not len(who):
            return
        b, n = band[who], sizes[who]
        f, g, spare = plan[b].T
        m = f + g
        local = np.repeat(np.arange(len(who)), n)
        tokens = shingles[np.repeat(starts[who] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        offset = np.cumsum(m) - m
        segment = (mix64(tokens ^ U64(0xA0761D6478BD642F + level)) % m[local].astype(U64)).astype(np.int64)
        at = offset[local] + segment
        total = int(m.sum())
        value = mix64(tokens + U64(0xE7037ED1A0B428DB))
        sums = np.zeros(total, dtype=U64)
        np.add.at(sums, at, value)
        many = np.bincount(at, minlength=total)
        of = np.repeat(np.arange(len(who)), m)
        number = np.arange(total) - offset[of]
        double = number >= f[of]
        base = mix64((b[of].astype(U64) << U64(40)) + (number.astype(U64) << U64(8)) + U64(level + 1))
        mute = np.where(double, 2 * (many <= 1), many == 0)
        slack = spare + 1 - np.bincount(of, weights=mute, minlength=len(who)).astype(np.int64)
        stuck = slack <= 0
        last = level == LEVELS - 1
        whole = np.flatnonzero((many > 0) | (last & stuck[of]))
        least = np.where(last & stuck[local], 1, 2)
        less = np.flatnonzero(double[at] & (many[at] >= least))
        sig = np.concatenate([mix64(sums[whole] + base[whole]), mix64(sums[at[less]] - value[less] + base[at[less]])])
        owner = np.concatenate([of[whole], local[less]])
        yield level, who, owner, sig, np.concatenate([np.ones(len(whole), bool), np.zeros(len(less), bool)]), np.concatenate([1 + double[whole], np.full(len(less), 2)]), slack
        who = who[stuck]


def _describe(carry: list[str], schema: pa.Schema, sketched: bool = False):
    """Rows of ``carry`` with the size and the name of each text's set; with ``sketched`` also the name's first half and the sketch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, name, key, bits = [], [], [], []
            for some in chunks(batch.column("__text").to_pylist(), PIECE):
                shingles, sizes = shingle_sets(some)
                one, two = set_keys(shingles, sizes)
                size.append(sizes)
                name += _names(one, two)
                key.append(one.view(np.int64))
                bits += sketches(shingles, sizes) if sketched else ()
            size = np.concatenate(size) if size else np.zeros(0, np.int64)
            more = [pa.array(np.concatenate(key) if key else size, pa.int64()), pa.array([x if s else None for x, s in zip(bits, size)], pa.binary())] if sketched else []
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(size.astype(np.int64)), pa.array([x if s else None for x, s in zip(name, size)], pa.binary()), *more], schema=schema)

    return run


def signature_bits(plan: np.ndarray, by_band: np.ndarray, parts: int) -> int:
    """Bits of a signature beside its partition, such that unequal ones seldom meet, however many there are."""
    sent = 1.0
    for k, (f, g, _) in enumerate(plan.tolist()):
        sent += int(by_band[k]) * (f + g * (1 + BANDS[k][0] / max(1, f + g)))
    return min(48, max(24, math.ceil(math.log2(sent) + 10 - math.log2(parts))))


def _sign(plan: np.ndarray, parts: int, width: int):
    """One run of signatures for each partition and stretch of documents."""
    schema = pa.schema([("part", pa.int64()), ("run", pa.binary())])

    def flush(held: list, entries: list) -> pa.RecordBatch:
        sig, owner, flag = (np.concatenate([h[k] for h in held]) for k in range(3))
        keys, slack, code = (np.concatenate([e[k] for e in entries]) for k in range(3))
        part, sig = (sig % U64(parts)).astype(np.int64), sig >> U64(64 - width)
        order = np.lexsort((sig, part))
        borders = np.flatnonzero(np.diff(part[order], prepend=-1, append=-1))
        rows = []
        for a, b in zip(borders[:-1], borders[1:]):
            here = order[a:b]
            used, local = np.unique(owner[here], return_inverse=True)
            steps = np.diff(sig[here], prepend=U64(0))
            rows.append((int(part[here[0]]), pack((planes(steps, "<u8"), planes(local, "<u4"), flag[here].astype(np.uint8).tobytes(), keys[used].tobytes(), slack[used].astype("<i4").tobytes(), code[used].astype(np.uint8).tobytes()))))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, entries, base, size = [], [], 0, 0
        seen: set[bytes] = set()
        for batch in batches:
            for some in chunks(batch.column("__text").to_pylist(), PIECE):
                shingles, sizes = shingle_sets(some)
                one, two = set_keys(shingles, sizes)
                names = _names(one, two)
                new = np.zeros(len(some), dtype=bool)
                for k, name in enumerate(names):
                    if sizes[k] and name not in seen:
                        seen.add(name)
                        new[k] = True
                shingles, sizes, one = shingles[np.repeat(new, sizes)], sizes[new], one[new]
                for lower in (False, True):
                    for level, who, owner, sig, whole, weight, slack in signatures(shingles, sizes, plan, lower):
                        held.append((sig, owner + base, whole * 4 + weight))
                        entries.append((one[who], slack, np.full(len(who), level * 2 + lower)))
                        base += len(who)
                        size += len(sig)
                        if size >= HELD:
                            yield flush(held, entries)
                            held, entries, base, size = [], [], 0, 0
                if len(seen) > 500_000:
                    seen.clear()
        if held:
            yield flush(held, entries)

    return run


_FOUND = "kind int, gid long, members array<long>, slack array<int>, weight int, code array<int>"


def _meet(crowd: int):
    """Signatures that two or more sets share: whole small groups once, memberships of crowded ones."""
    def run(table: pa.Table) -> pa.Table:
        part, base = table.column("part")[0].as_py(), 0
        sig, owner, flag, keys, slack, code = [], [], [], [], [], []
        for blob in table.column("run").to_pylist():
            a, b, c, d, e, f = unpack(blob)
            sig.append(np.cumsum(unplanes(a, "<u8"), dtype=U64))
            owner.append(unplanes(b, "<u4").astype(np.int64) + base)
            flag.append(np.frombuffer(c, np.uint8))
            keys.append(np.frombuffer(d, U64))
            slack.append(np.frombuffer(e, "<i4"))
            code.append(np.frombuffer(f, np.uint8))
            base += len(keys[-1])
        sig, owner, flag, keys, slack, code = map(np.concatenate, (sig, owner, flag, keys, slack, code))
        order = np.lexsort((keys[owner], sig))
        sig, owner, flag = sig[order], owner[order], flag[order]
        key = keys[owner]
        start = np.flatnonzero(np.diff(sig, prepend=~sig[:1]) != 0)
        fresh = np.ones(len(sig), dtype=np.int64)
        fresh[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])
        many = np.add.reduceat(fresh, start)
        whole = np.bitwise_or.reduceat(flag & 4, start) > 0
        own = np.bitwise_or.reduceat((code[owner] & 1) ^ 1, start) > 0
        end = np.append(start[1:], len(sig))
        good = (many >= 2) & whole & own
        small = np.flatnonzero(good & (many <= crowd))
        sums = np.add.reduceat(np.where(fresh == 1, mix64(key), U64(0)), start)
        gid, first = np.unique(sums[small], return_index=True)
        out = []
        for g, k in zip(gid.view(np.int64).tolist(), small[first]):
            here = slice(start[k], end[k])
            out.append((0, g, key[here][fresh[here] == 1].view(np.int64).tolist(), [], 1, []))
        for k in np.flatnonzero(good & (many > crowd)):
            here = np.arange(start[k], end[k])
            here = here[fresh[here] == 1]
            g = int(mix64(sig[start[k]:start[k] + 1] + (U64(part + 1) << U64(48))).view(np.int64)[0])
            for at in range(0, len(here), ROW):
                some = here[at:at + ROW]
                if at:
                    some = np.concatenate([here[:1], some])
                out.append((1, g, key[some].view(np.int64).tolist(), slack[owner[some]].tolist(), int(flag[some[0]] & 3), code[owner[some]].tolist()))
        kinds = (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32(), pa.list_(pa.int32()))
        columns = list(zip(*out)) if out else [[]] * 6
        return pa.table({n: pa.array(list(c), t) for n, c, t in zip(("kind", "gid", "members", "slack", "weight", "code"), columns, kinds)})

    return run


def _texts(sent):
    """Sets that the bitmap lets through, once for each task, with a text that has them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            rows = []
            for some in chunks(batch.column("__text").to_pylist(), PIECE):
                shingles, sizes = shingle_sets(some)
                one, two = set_keys(shingles, sizes)
                place = one & U64(SIEVE - 1)
                asked = (sizes > 0) & ((sent.value[(place >> U64(6)).astype(np.int64)] >> (place & U64(63))) & U64(1) != 0)
                names = _names(one, two)
                for k in np.flatnonzero(asked).tolist():
                    if names[k] not in seen:
                        seen.add(names[k])
                        rows.append((names[k], some[k]))
            if len(seen) > 500_000:
                seen.clear()
            columns = list(zip(*rows)) if rows else [[]] * 2
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()) for c in columns], names=["c", "text"])

    return run


def _fetch(body: DataFrame, asked: DataFrame) -> DataFrame:
    """``c, text`` of the sets named in ``asked`` (``c``, and ``k``, its first half as a number)."""
    place = F.col("k").bitwiseAND(F.lit(SIEVE - 1))
    words = asked.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(k & 63L as int))")).alias("bits")).toArrow()
    sieve = np.zeros(SIEVE // 64, U64)
    sieve[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(U64)
    sent = body.sparkSession.sparkContext.broadcast(sieve)
    return materialize(body.mapInArrow(_texts(sent), "c binary, text binary").join(asked.select("c").distinct(), "c", "left_semi").dropDuplicates(["c"]), "texts")


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with sizes and sketches those that may be linked."""
    for batch in batches:
        keep = []
        for m, n, x, y in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "xa", "xb"))):
            least = min(len(x), len(y))
            apart = int(np.bitwise_count(fold(x, least) ^ fold(y, least)).sum(dtype=np.int64))
            keep.append(100 * min(m, n) >= PERCENT * max(m, n) and apart <= (m + n) * (100 - PERCENT) // (100 + PERCENT))
        yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


def _plausible(forest: bool):
    """Pairs of each group's members of different components whose sizes and sketches allow a link.

    With ``forest`` no more than would join all components of the task's rows.
    """
    def run(table: pa.Table) -> pa.Table:
        gid, n = (table.column(c).to_numpy() for c in ("gid", "n"))
        names, bits = table.column("c").to_pylist(), table.column("bits").to_pylist()
        ids: dict[bytes, int] = {}
        root = np.fromiter((ids.setdefault(r, len(ids)) for r in table.column("root").to_pylist()), dtype=np.int64, count=len(gid))
        above = list(range(len(ids)))

        def find(k: int) -> int:
            while above[k] != k:
                above[k] = k = above[above[k]]
            return k

        order = np.lexsort((n, gid))
        out: set[tuple[bytes, bytes]] = set()
        for here in np.split(order, np.flatnonzero(np.diff(gid[order]) != 0) + 1):
            least = min(len(bits[k]) for k in here)
            sketch = np.stack([fold(bits[k], least) for k in here]).view(U64)
            size, roots = n[here], root[here]
            for k in range(len(here) - 1):
                to = int(np.searchsorted(size, size[k] * 100 // PERCENT, side="right"))
                rest = k + 1 + np.flatnonzero(roots[k + 1:to] != roots[k])
                if not len(rest):
                    continue
                apart = np.bitwise_count(sketch[rest] ^ sketch[k]).sum(axis=1, dtype=np.int64)
                for j in rest[apart <= (size[rest] + size[k]) * (100 - PERCENT) // (100 + PERCENT)].tolist():
                    if forest:
                        x, y = find(int(roots[k])), find(int(roots[j]))
                        if x == y:
                            continue
                        above[y] = x
                    x, y = names[here[k]], names[here[j]]
                    out.add((min(x, y), max(x, y)))
        a, b = zip(*out) if out else ((), ())
        return pa.table({"a": pa.array(list(a), pa.binary()), "b": pa.array(list(b), pa.binary())})

    return run


def exact_shingles(text: bytes) -> set[tuple[bytes, ...]]:
    words = text.lower().split()
    return set(zip(*(words[j:] for j in range(WORDS)))) if len(words) >= WORDS else {tuple(words)} if words else set()


def _verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[bytes, set] = {}
    for frame in frames:
        keep = []
        for a, b, x, y in zip(frame["a"], frame["b"], frame["x"], frame["y"]):
            sets = []
            for name, text in ((a, x), (b, y)):
                if name not in held:
                    if len(held) >= 64:
                        held.pop(next(iter(held)))
                    held[name] = exact_shingles(text)
                sets.append(held[name])
            common = len(sets[0] & sets[1])
            keep.append(100 * common >= PERCENT * (len(sets[0]) + len(sets[1]) - common))
        yield frame.loc[keep, ["a", "b"]]


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` of set names that are similar, by their texts."""
    joined = pairs.join(texts.select(F.col("c").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("c").alias("b"), F.col("text").alias("y")), "b")
    return joined.select("a", "b", "x", "y").mapInPandas(_verify, "a binary, b binary")


def similar_documents(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), doc_id: str = "doc_id", crowd: int = CROWD) -> DataFrame:
    """``carry`` with ``n_shingles``, ``set_name`` and ``component_id`` of every row.

    ``set_name`` names the shingle set (null: empty); rows of one name are
    copies. ``component_id`` is the least ``doc_id`` that links reach. A text
    without words (null, empty) is linked with nothing. Null ids count as
    absent from the minimum. Repeated rows stay. A carried column named like
    one of the three results gives way to it. A very long text is one set and
    is read whole; an empty table has no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    body = docs.select(empty_binary(F.col(text)).alias("__text"))
    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    shape = f"id {kind}, n_shingles long, set_name binary, k long, bits binary"
    listed = docs.select(F.col(doc_id).alias("id"), empty_binary(F.col(text)).alias("__text")).mapInArrow(_describe(["id"], _arrow(spark.createDataFrame([], shape)), True), shape)
    narrow = materialize(listed, "sets")

    held = narrow.filter("n_shingles > 0").groupBy(F.col("n_shingles")).count()
    plan = np.zeros((len(BANDS), 3), dtype=np.int64)
    by_band = np.zeros(len(BANDS) + 1, dtype=np.int64)
    edges = [a for a, _ in BANDS]
    band = F.lit(0)
    for k, low in enumerate(edges[1:], 1):
        band = band + (F.col("n_shingles") >= low).cast("int")
    for r in held.groupBy(band.alias("band")).agg(F.sum("count").alias("n")).collect():
        by_band[r["band"]] += r["n"]
        by_band[r["band"] - 1] += r["n"] if r["band"] else 0
    for k in range(len(BANDS)):
        plan[k] = allocate(k, int(by_band[k])) if by_band[k] else (1, 0, 0)

    parts = parts_for(docs, PART_BYTES)
    found = body.mapInArrow(_sign(plan, parts, signature_bits(plan, by_band, parts)), "part long, run binary").groupBy("part").applyInArrow(_meet(crowd), _FOUND)
    zipped = F.explode(F.arrays_zip("members", "slack", "code")).alias("x")
    #: Rows of at most ``ROW`` members are dealt out before they are taken apart, so no task has a crowd's members alone.
    dealt = found.repartition(F.xxhash64("gid", "members")).select("kind", "gid", "weight", F.element_at("members", 1).alias("p"), zipped)
    members = materialize(dealt.select("kind", "gid", "weight", "p", F.col("x.members").alias("k"), F.col("x.slack").alias("slack"), F.col("x.code").alias("code")), "met")
    wanted = members.select("k").distinct()
    names = materialize(narrow.filter("n_shingles > 0").select("k", F.col("set_name").alias("c"), F.col("n_shingles").alias("n"), "bits").join(wanted, "k", "left_semi").dropDuplicates(["c"]), "names")

    best = members.filter("k <> p").groupBy("k", "p").count().groupBy("k").agg(F.max_by("p", F.struct("count", "p")).alias("p"))
    side = lambda key, c, n, x: names.select(F.col("k").alias(key), F.col("c").alias(c), F.col("n").alias(n), F.col("bits").alias(x))
    pairs = best.join(side("k", "b", "nb", "xb"), "k").join(side("p", "a", "na", "xa"), "p").filter("a <> b").select("a", "b", "na", "nb", "xa", "xb")
    pairs = materialize(pairs.mapInArrow(_close, "a binary, b binary"), "pairs")
    of = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct()
    texts = _fetch(body, of(pairs).join(names.select("c", "k"), "c"))
    first = materialize(_links(pairs, texts), "links")
    labels = connected_components(first)
    discard(pairs, first)

    crowds = members.filter("kind = 1").select("gid", "weight", "k", "slack", "code").distinct()
    dense = crowds.groupBy("k", "code", "slack").agg(F.sum("weight").alias("w")).filter("w >= slack").select("k", "code").distinct()
    groups = members.filter("kind = 0").select("gid", "k").union(crowds.join(dense, ["k", "code"], "left_semi").select("gid", "k"))
    known, done = [texts], None
    for forest in (True, False):
        rooted = names.select("k", "c", "n").join(labels.withColumnRenamed("v", "c"), "c", "left").select("k", "c", "n", F.coalesce("root", "c").alias("root"))
        whole = Window.partitionBy("gid")
        placed = groups.join(rooted, "k").withColumn("__r0", F.min("root").over(whole)).withColumn("__r1", F.max("root").over(whole)).filter("__r0 <> __r1").drop("__r0", "__r1")
        open_groups = materialize(placed.dropDuplicates(["gid", "c"]), "open")
        sketched = open_groups.join(names.select("c", "bits"), "c").withColumn("part", F.pmod("gid", F.lit(parts * 4)))
        pairs = materialize(sketched.groupBy("part").applyInArrow(_plausible(forest), "a binary, b binary").distinct(), "pairs")
        missing = materialize(of(pairs).join(texts.select("c"), "c", "left_anti").join(names.select("c", "k"), "c"), "missing")
        if not missing.isEmpty():
            known.append(_fetch(body, missing))
            texts = texts.union(known[-1])
        before, labels = labels, connected_components(labels.toDF("a", "b").union(_links(pairs, texts)))
        discard(before, pairs, missing, *([done] if done is not None else []))
        groups, done = open_groups.select("gid", "k"), open_groups
    discard(members, names, done, *known)

    ids = narrow.filter("n_shingles > 0").groupBy("set_name").agg(F.min("id").alias("least")).join(labels.withColumnRenamed("v", "set_name"), "set_name", "left").withColumn("root", F.coalesce("root", "set_name"))
    least = ids.groupBy("root").agg(F.min("least").alias("component_id"))
    by_set = ids.join(least, "root").select("set_name", "component_id")
    kept = [c for c in carry if c not in ("n_shingles", "set_name", "component_id")]
    if set(kept) <= {doc_id}:
        out, own = narrow.select("id", "n_shingles", "set_name"), {doc_id: "id"}
    else:
        own = {c: f"c{k}" for k, c in enumerate(dict.fromkeys((*kept, doc_id)))}
        shape = "".join(f"{own[f.name]} {f.dataType.simpleString()}, " for f in docs.select(*own).schema) + "n_shingles long, set_name binary"
        out = docs.select(*(F.col(c).alias(h) for c, h in own.items()), empty_binary(F.col(text)).alias("__text")).mapInArrow(_describe([*own.values()], _arrow(spark.createDataFrame([], shape))), shape)
    out = out.join(by_set, "set_name", "left")
    return out.select(*(F.col(own[c]).alias(c) for c in kept), "n_shingles", "set_name", F.when(F.col("n_shingles") == 0, F.col(own[doc_id])).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each component: that of the least id.

    Texts without words all stay. Of rows with the same id in a component one
    stays; rows without an id go only if their set stands in a component that
    has one, or is a copy of another such row's.
    """
    columns = docs.columns
    found = materialize(similar_documents(docs, text, (doc_id,), doc_id).filter("n_shingles > 0").select(F.col(doc_id).alias("id"), "set_name", "component_id"), "similar")
    keep = found.filter("id = component_id").groupBy("component_id").agg(F.min("set_name").alias("set_name")).union(found.filter("component_id is null").select("component_id", "set_name").distinct())
    named = docs.select(*(F.col(c).alias(f"c{k}") for k, c in enumerate(columns)), empty_binary(F.col(text)).alias("__text"))
    schema = ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(docs.schema)) + ", n_shingles long, set_name binary"
    named = named.mapInArrow(_describe([f"c{k}" for k in range(len(columns))], _arrow(docs.sparkSession.createDataFrame([], schema))), schema)
    own = f"c{columns.index(doc_id)}"
    one = named.filter("n_shingles > 0").join(keep, "set_name").filter(F.col(own).eqNullSafe(F.col("component_id"))).dropDuplicates(["set_name", own])
    picked = [F.col(f"c{k}").alias(c) for k, c in enumerate(columns)]
    return one.select(*picked).union(named.filter("n_shingles = 0").select(*picked))


def _arrow(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.schema)
