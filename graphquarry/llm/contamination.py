"""Finding benchmark passages by q-gram filtering and banded alignment.

An occurrence of an item of ``m`` characters within ``k`` edits shares at least
``m - q + 1 - k*q`` of its q-grams with the text, and they lie on diagonals
(place in the text less place in the item) that differ by ``2k`` at most. So
shared q-grams are counted in bands of twice that width which overlap by half;
bands that reach the bound are regions, and a banded alignment decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, PowerTable, chunks, mix64, small_batches

#: Length of a gram, and edits allowed for each character of an item.
Q, RATE = 8, 0.08
#: Characters of items in one index: bounds what is broadcast; more items are searched in further passes.
INDEX_CHARS = 2_000_000
#: Characters of text that are searched at once.
PIECE = 1 << 18
#: Shared grams whose diagonals are counted at once: a gram of many items and places is no more memory.
HELD = 1 << 21
_TABLE = PowerTable(0x8CB92BA72F3D8DD7)
_SPACES = np.array([0x20, *range(0x09, 0x0E), 0x85, 0xA0], dtype=np.uint32)


def normalise(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points with white space runs as one space, and where each stands in the text."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    space = np.isin(codes, _SPACES)
    codes = np.where(space, np.uint32(0x20), codes)
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = ~(space[1:] & space[:-1])
    at = np.flatnonzero(keep)
    codes = codes[at]
    a, b = int(len(codes) > 0 and codes[0] == 0x20), len(codes)
    b -= int(b > a and codes[-1] == 0x20)
    return codes[a:b], at[a:b]


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    n = len(codes)
    if n < q:
        return np.zeros(0, U64)
    up, down = _TABLE.upto(n + 1)
    sums = np.zeros(n + 1, dtype=U64)
    np.cumsum((codes.astype(U64) + U64(1)) * down[:n], out=sums[1:])
    return mix64((sums[q:] - sums[:-q]) * up[q:])


def align(item: np.ndarray, region: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """The best place of the item in the region on diagonals ``low`` to ``high``: edits, begin, end; none beyond the budget.

    Row by row over the item; a row holds one cell for each diagonal of the band.
    """
    width, far = high - low + 1, np.int32(1 << 20)
    steps = np.arange(width, dtype=np.int32)
    place = steps + low
    cost = np.where((place >= 0) & (place <= len(region)), np.int32(0), far)
    began = place.copy()
    padded = np.concatenate([np.zeros(max(0, -low) + 1, np.uint32), region, np.zeros(max(0, high + len(item) - len(region)) + 1, np.uint32)])
    shift = max(0, -low) + 1
    for i, code in enumerate(item, 1):
        end = place + i
        inside = (end >= 1) & (end <= len(region))
        chars = padded[shift + low + i - 1: shift + low + i - 1 + width]
        swap = cost + ((chars != code) | ~inside)
        drop = np.append(cost[1:], far) + 1
        later = np.append(began[1:], 0)
        down = drop < swap
        best, origin = np.where(down, drop, swap), np.where(down, later, began)
        best = np.where((end >= 0) & (end <= len(region)), best, far)
        run = np.minimum.accumulate(best - steps)
        source = np.maximum.accumulate(np.where(best - steps == run, steps, 0))
        cost, began = run + steps, origin[source]
        if cost.min() > budget:
            return None
    k = int(cost.argmin())
    return int(cost[k]), int(began[k]), int(place[k] + len(item))


class Index:
    """The q-grams of some items, ready to be searched for."""

    def __init__(self, items: list[tuple[object, str]], q: int = Q, rate: float = RATE):
        self.q, self.ids, self.codes, self.budget, self.need, self.short = q, [], [], [], [], []
        grams, of, at = [], [], []
        for key, text in items:
            codes, _ = normalise(text)
            m = len(codes)
            if not m:
                continue
            budget = max(0, min(int(m * rate), (m - q) // q))
            n = len(self.ids)
            self.ids.append(key)
            self.codes.append(codes)
            self.budget.append(budget)
            self.need.append(m - q + 1 - budget * q)
            if m < q:
                self.short.append(n)
                continue
            h = gram_hashes(codes, q)
            grams.append(h)
            of.append(np.full(len(h), n))
            at.append(np.arange(len(h)))
        self.budget, self.need = np.array(self.budget, dtype=np.int64), np.array(self.need, dtype=np.int64)
        self.grams = np.concatenate(grams) if grams else np.zeros(0, U64)
        order = np.argsort(self.grams, kind="stable")
        self.grams = self.grams[order]
        self.of = np.concatenate(of)[order] if grams else np.zeros(0, np.int64)
        self.at = np.concatenate(at)[order] if grams else np.zeros(0, np.int64)
        self.bits = 1 << max(16, int(len(self.grams) * 16).bit_length())
        self.seen = np.zeros(self.bits, dtype=bool)
        self.seen[(self.grams & U64(self.bits - 1)).astype(np.int64)] = True
        self.longest = max((len(c) + int(b) for c, b in zip(self.codes, self.budget)), default=0)

    def regions(self, codes: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, lowest, highest diagonal) of each band that shares enough grams."""
        h = gram_hashes(codes, self.q)
        hit = np.flatnonzero(self.seen[(h & U64(self.bits - 1)).astype(np.int64)])
        if len(hit) < 1 or not len(self.grams):
            return []
        low, high = np.searchsorted(self.grams, h[hit]), np.searchsorted(self.grams, h[hit], side="right")
        found, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for some in np.split(np.arange(len(hit)), np.flatnonzero(np.diff(np.cumsum(high - low) // HELD)) + 1):
            n = high[some] - low[some]
            which = np.repeat(low[some] - np.cumsum(n) + n, n) + np.arange(n.sum())
            item, diagonal = self.of[which], np.repeat(hit[some], n) - self.at[which]
            wide = 2 * self.budget[item] + 1
            band = diagonal // wide + (1 << 30)
            key = item * np.int64(1 << 40) + band
            now, times = np.unique(np.concatenate([key, key - 1]), return_counts=True)
            found, of = np.unique(np.concatenate([found, now]), return_inverse=True)
            count = np.bincount(of, weights=np.concatenate([count, times]), minlength=len(found)).astype(np.int64)
        which = found >> 40
        out = []
        for k in np.flatnonzero(count >= self.need[which]):
            j = int(which[k])
            first = (int(found[k] & ((1 << 40) - 1)) - (1 << 30)) * int(2 * self.budget[j] + 1)
            out.append((j, first, first + 4 * int(self.budget[j]) + 1))
        return out

    def search(self, text: str) -> list[tuple[object, int, int, int]]:
        """(item, start, end, edits) of each place, by code point in the text as it is."""
        codes, places = normalise(text)
        found: dict[int, list[tuple[int, int, int]]] = {}
        body = codes.tobytes() if self.short else b""
        for j in self.short:
            piece, at = self.codes[j].tobytes(), -1
            while (at := body.find(piece, at + 1)) >= 0:
                if at % 4 == 0:
                    found.setdefault(j, []).append((0, at // 4, at // 4 + len(self.codes[j])))
        for a in range(0, max(1, len(codes) - self.longest), PIECE):
            for j, low, high in self.regions(codes[a:a + PIECE + self.longest + self.q]):
                item, budget = self.codes[j], int(self.budget[j])
                left = max(0, a + low)
                region = codes[left:a + high + len(item) + 1]
                exact = region.tobytes().find(item.tobytes())
                got = (0, exact // 4, exact // 4 + len(item)) if exact >= 0 and exact % 4 == 0 else align(item, region, a + low - left, a + high - left, budget)
                if got and got[0] <= budget:
                    found.setdefault(j, []).append((got[0], left + got[1], left + got[2]))
        out = []
        for j in sorted(found):
            end = -1
            best: list[tuple[int, int, int]] = []
            for edits, x, y in sorted(found[j], key=lambda f: (f[1], f[2])):
                if x < end:
                    if (edits, x) < (best[-1][0], best[-1][1]):
                        best[-1] = (edits, x, y)
                    end = max(end, y)
                else:
                    best.append((edits, x, y))
                    end = y
            out += [(self.ids[j], int(places[x]), int(places[y - 1]) + 1, edits) for edits, x, y in best if y > x]
        return out


def find_passages(docs: DataFrame, items: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), item: str = "item_id", item_text: str = "text", q: int = Q, rate: float = RATE) -> DataFrame:
    """``keys``, ``item``, ``start``, ``end`` (code points) and ``edits`` for each place of an item in a text.

    Case and the kind of white space are ignored. An item may be changed by
    ``rate`` edits a character (fewer if it is so short that no gram would
    need to stay; an item below ``q`` characters must stand as it is). Null or
    empty texts and items match nothing. Of overlapping places of an item the
    one of the fewest edits stays. Repeated rows of ``docs`` each give their
    rows; items with equal text are reported by each id. The items are indexed
    ``INDEX_CHARS`` characters at a time, one pass over ``docs`` for each.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kinds, kind = dict(docs.dtypes), dict(items.dtypes)[item]
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", `{item}` {kind}, start int, end int, edits int"
    picked = docs.select(*keys, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    listed = items.select(item, F.col(item_text).alias("__text")).filter("length(__text) > 0").toLocalIterator()

    def searcher(sent):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index: Index = sent.value
            for frame in frames:
                found = [index.search(t) for t in frame.pop("__text")]
                rows = [r for f in found for r in f]
                out = frame.iloc[np.repeat(np.arange(len(found)), [len(f) for f in found])].reset_index(drop=True)
                for k, name in enumerate((item, "start", "end", "edits")):
                    out[name] = [r[k] for r in rows]
                yield out

        return run

    out = None
    for some in chunks(listed, INDEX_CHARS, lambda r: len(r["__text"])):
        sent = spark.sparkContext.broadcast(Index([(r[item], r["__text"]) for r in some], q, rate))
        part = picked.mapInPandas(searcher(sent), schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", q: int = Q, rate: float = RATE) -> DataFrame:
    """``docs`` without the rows in which an item stands (see :func:`find_passages`).

    Row by row, no shuffle. Null and empty texts stay, as nothing stands in
    them; repeated rows stay or go together; all columns come back as they are,
    whatever their names. A very long text is searched whole, piece by piece.
    """
    spark, columns, out = docs.sparkSession, docs.columns, docs
    small_batches(spark)
    listed = items.select(item, F.col(item_text).alias("__text")).filter("length(__text) > 0").toLocalIterator()

    def cleaner(sent, at: int):
        def run(batches):
            index: Index = sent.value
            for batch in batches:
                yield batch.filter(pa.array([not (t and index.search(t)) for t in batch.column(at).to_pylist()], pa.bool_()))

        return run

    for some in chunks(listed, INDEX_CHARS, lambda r: len(r["__text"])):
        sent = spark.sparkContext.broadcast(Index([(r[item], r["__text"]) for r in some], q, rate))
        out = out.mapInArrow(cleaner(sent, columns.index(text)), docs.schema)
    return out
