"""Language-model scores from Brown classes found by exchange clustering.

The model is a class bigram: P(word | before) = P(class | class before) *
P(word | class). Classes maximise the likelihood of the training text.

1. Texts become blocks of word numbers, written once; all passes read those.
2. Word counts over the whole corpus; the ``FREQUENT`` most frequent words'
   bigram counts, a table of fixed size, go to the driver, where the exchange
   algorithm moves words between classes as long as the likelihood grows.
3. Every other word of the training text meets its counts of neighbouring
   classes in one partition and gets the class where the likelihood is greatest.
4. Then all words are exchanged, in sweeps: blocks count the classes around each
   of their words; a partition of words sums them, takes the table of all class
   bigrams and moves word after word to the class where the likelihood grows
   most (words of few tokens together, to first order); the new classes go back
   to the blocks. Sweeps end when the moves of one gain next to nothing.
5. Texts become sequences of classes; transitions are counted, and smoothed.

Words not seen in training are one further type, in a class of its own. The
chance of it after a class is that of words seen once (Good and Turing), so
the distribution over all types sums to one. Each text ends with an end token,
whose class it alone is in, and which is the context of a text's first token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import suffixes
from .common import U64, discard, empty_binary, materialize, parts_for, planes, release, small_batches, steps, unplanes, unsteps, word_hashes
from .suffixes import unpack

#: Words whose bigrams the driver clusters, and classes (besides those of the end and of unseen words).
FREQUENT, CLASSES = 512, 60
#: Tokens in a block, and bytes of input for each partition of words.
BLOCK_TOKENS, PART_BYTES = 1 << 19, 4 << 20
#: Weight of the class distribution in smoothed transitions.
MU = 20.0
#: Sweeps over all words at most, gain of the log likelihood (as a share) below which they end, and tokens from which a word is moved by itself.
SWEEPS, ENOUGH, ALONE = 6, 0.01, 2000
END = b""
#: Level at which blocks and runs are compressed: all passes write or move them.
LEVEL = 5


def pack(run) -> bytes:
    return suffixes.pack(run, LEVEL)


def _blocks(carry: list[str], kinds: pa.Schema, block_tokens: int):
    schema = pa.schema([("block", pa.int64()), ("words", pa.binary()), ("ids", pa.binary()), ("sizes", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), *((c, pa.list_(kinds.field(c).type)) for c in carry)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        known: dict[bytes, int] = {END: 0}
        ids: list[np.ndarray] = []
        sizes, held, rows, total = [], [], [[] for _ in carry], 0

        def flush():
            body = pack((list(known)[1:],)), pack(planes(np.concatenate(ids)))
            columns = [[number], [body[0]], [body[1]], [sizes], [held], *([r] for r in rows)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            for k, (text, out) in enumerate(zip(batch.column("__text").to_pylist(), batch.column("__held").to_pylist())):
                words = text.lower().split()
                new = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))
                ids.append(np.append(new, 0))
                sizes.append(len(words) + 1)
                held.append(out)
                for j, c in enumerate(carry):
                    rows[j].append(batch.column(c)[k].as_py())
                total += len(words) + 1
                if total >= block_tokens:
                    yield flush()
                    number, known, ids, sizes, held, rows, total = number + 1, {END: 0}, [], [], [], [[] for _ in carry], 0
        if sizes:
            yield flush()

    return run


class _Block:
    """A block read back: its words, token ids, and masks."""

    def __init__(self, words: bytes, ids: bytes, sizes: list[int], held: list[bool]):
        self.words = [END, *unpack(words)[0]]
        self.ids = unplanes(unpack(ids)).astype(np.int64)
        self.sizes = np.array(sizes, dtype=np.int64)
        self.train = np.repeat(~np.array(held, dtype=bool), self.sizes)

    def before(self, tokens: np.ndarray, end) -> np.ndarray:
        """What stands before each token; a text's first follows an end."""
        out = np.empty_like(tokens)
        out[1:], out[:1] = tokens[:-1], end
        out[np.cumsum(self.sizes)[:-1]] = end
        return out


def _read(table) -> Iterator[tuple[int, _Block]]:
    for block, words, ids, sizes, held in zip(*(table.column(c).to_pylist() for c in ("block", "words", "ids", "sizes", "held"))):
        yield block, _Block(words, ids, sizes, held)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, b in _read(batch):
            n = np.bincount(b.ids[b.train], minlength=len(b.words))
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([b.words[k] for k in used], pa.binary()), pa.array(n[used])], names=["word", "n"])


def _frequent_bigrams(number: dict[bytes, int]):
    """Bigram counts of frequent words; all others are one symbol."""
    size = len(number) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size * size, dtype=np.int64)
        for batch in batches:
            for _, b in _read(batch):
                symbol = np.array([number.get(w, size - 1) for w in b.words])[b.ids]
                sums += np.bincount((b.before(symbol, number[END]) * size + symbol)[b.train], minlength=size * size)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], names=["code", "n"])

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, movable: int, classes: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the first ``movable`` symbols, and the class bigram counts.

    Symbols after them keep classes of their own. The start deals symbols out
    in turn; then each in turn goes to the class where the likelihood of the
    class bigrams is greatest, until a round moves none.
    """
    n = len(bigrams)
    total = classes + n - movable
    label = np.concatenate([np.arange(movable) % classes, np.arange(classes, total)])
    onehot = np.eye(total)[label]
    right, left = bigrams @ onehot, bigrams.T @ onehot  # counts of each symbol before and after each class
    table = onehot.T @ right
    for _ in range(rounds):
        moved = 0
        for w in range(movable):
            a, r, l, own = label[w], right[w].copy(), left[w].copy(), bigrams[w, w]
            r[a] -= own
            l[a] -= own
            table[a] -= r
            table[:, a] -= l
            table[a, a] -= own
            rows, columns = table[:classes], table[:, :classes].T
            gain = (_xlogx(rows + r) - _xlogx(rows)).sum(1) + (_xlogx(columns + l) - _xlogx(columns)).sum(1)
            k = np.arange(classes)
            cell = table[k, k]
            gain += _xlogx(cell + r[k] + l[k] + own) - _xlogx(cell + r[k]) - _xlogx(cell + l[k]) + _xlogx(cell)
            before, after = rows.sum(1), columns.sum(1)
            gain -= _xlogx(before + r.sum() + own) - _xlogx(before) + _xlogx(after + l.sum() + own) - _xlogx(after)
            b = a if gain[a] >= gain.max() - 1e-9 else int(gain.argmax())
            table[b] += r
            table[:, b] += l
            table[b, b] += own
            if b != a:
                label[w] = b
                right[:, a] -= bigrams[:, w]
                right[:, b] += bigrams[:, w]
                left[:, a] -= bigrams[w]
                left[:, b] += bigrams[w]
                moved += 1
        if not moved:
            break
    return label, table


def _profiles(number: dict[bytes, int], label: np.ndarray, classes: int, parts: int):
    """To each partition of words: the block's words in it, their counts, and the classes around the rarer ones."""
    end, size = number[END], classes + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, b in _read(batch):
                symbol = np.array([number.get(w, len(number)) for w in b.words])
                kind = label[symbol]
                n = np.bincount(b.ids[b.train], minlength=len(b.words))
                tokens = kind[b.ids]
                rare = b.train & (symbol[b.ids] == len(number))
                before = b.before(tokens, label[end])
                after = np.append(tokens[1:], label[end])
                codes = np.concatenate([b.ids[rare] * (2 * size) + before[rare], b.ids[rare] * (2 * size) + size + after[rare]])
                code, times = np.unique(codes, return_counts=True)
                word = code // (2 * size)
                hashes = np.append(U64(0), word_hashes([b"\n".join(b.words[1:])])[0])
                part = (hashes % U64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                borders = np.flatnonzero(np.diff(part[order], prepend=-1, append=-1))
                code_order = np.argsort(part[word], kind="stable")
                dealt = part[word][code_order]
                place = np.empty(len(part), np.int64)
                out = []
                for x, y in zip(borders[:-1], borders[1:]):
                    here, p = order[x:y], int(part[order[x]])
                    place[here] = np.arange(y - x)
                    some = code_order[np.searchsorted(dealt, p):np.searchsorted(dealt, p, side="right")]
                    out.append((p, pack((block, [b.words[k] for k in here], steps(here), planes(n[here]), steps(place[word[some]]), (code[some] % (2 * size)).astype(np.uint8), planes(times[some])))))
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary())], names=["part", "run"])

    return run


def _assign(number: dict[bytes, int], label: np.ndarray, table: np.ndarray, classes: int):
    """Each word's count and class, sent back to the blocks that have it."""
    size = classes + 2
    logs = np.log(table + 0.1)
    after, before = np.log(table.sum(1) + 1), np.log(table.sum(0) + 1)

    def run(runs: pa.Table) -> pa.Table:
        got = [unpack(x) for x in runs.column("run").to_pylist()]
        ids: dict[bytes, int] = {}
        places = [np.fromiter((ids.setdefault(w, len(ids)) for w in g[1]), dtype=np.int64, count=len(g[1])) for g in got]
        n = np.zeros(len(ids), dtype=np.int64)
        around = np.zeros((len(ids), 2 * size), dtype=np.float32)
        for g, place in zip(got, places):
            n[place] += unplanes(g[3])
            np.add.at(around, (place[unsteps(g[4])], g[5]), unplanes(g[6]))
        total = around[:, :size].sum(1)
        gain = around[:, size:] @ logs[:classes].T + around[:, :size] @ logs[:, :classes] - total[:, None] * (after[:classes] + before[:classes])
        kind = gain.argmax(1)
        for w, k in ids.items():
            if (s := number.get(w)) is not None:
                kind[k] = label[s]
        kind[n == 0] = classes + 1
        return pa.table({"block": pa.array([g[0] for g in got], pa.int64()), "dict": pa.array([pack((g[2], planes(n[p], "<u8"), kind[p].astype(np.uint8))) for g, p in zip(got, places)], pa.binary())})

    return run


def _around(classes: int, parts: int):
    """To each partition of words: the block's words in it, their classes, and the classes around them; as part -1 the block's class bigrams."""
    end, size = classes, classes + 2

    def run(blocks: pa.Table, dicts: pa.Table) -> pa.Table:
        (block, b), = _read(blocks)
        kind, n = np.full(len(b.words), classes + 1, np.int64), np.bincount(b.ids[b.train], minlength=len(b.words))
        for where, _, k in map(unpack, dicts.column("dict").to_pylist()):
            kind[unsteps(where)] = k
        tokens = kind[b.ids]
        before, after, train = b.before(tokens, end), np.append(tokens[1:], end), np.flatnonzero(b.train)
        table = np.bincount(before[train] * size + tokens[train], minlength=size * size)
        code, times = np.unique(np.concatenate([b.ids[train] * (2 * size) + before[train], b.ids[train] * (2 * size) + size + after[train]]), return_counts=True)
        word = code // (2 * size)
        hashes = np.append(U64(0), word_hashes([b"\n".join(b.words[1:])])[0])
        part = (hashes % U64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        borders = np.flatnonzero(np.diff(part[order], prepend=-1, append=-1))
        code_order = np.argsort(part[word], kind="stable")
        dealt = part[word][code_order]
        place, out = np.empty(len(part), np.int64), [(-1, pack(table))]
        for x, y in zip(borders[:-1], borders[1:]):
            here, p = order[x:y], int(part[order[x]])
            place[here] = np.arange(y - x)
            some = code_order[np.searchsorted(dealt, p):np.searchsorted(dealt, p, side="right")]
            out.append((p, pack((block, [b.words[k] for k in here], steps(here), planes(n[here]), kind[here].astype(np.uint8), steps(place[word[some]]), (code[some] % (2 * size)).astype(np.uint8), planes(times[some])))))
        return pa.table({"part": pa.array([o[0] for o in out], pa.int64()), "run": pa.array([o[1] for o in out], pa.binary())})

    return run


def _table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = 0
    for batch in batches:
        for x in batch.column("run").to_pylist():
            sums = sums + unpack(x)
    if not isinstance(sums, int):
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums.astype(np.int64))], names=["code", "n"])


def log_likelihood(table: np.ndarray) -> float:
    """Of class bigrams given the classes, but for a sum over words that no exchange changes."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(0)).sum() - _xlogx(table.sum(1)).sum())


def move_words(before: np.ndarray, after: np.ndarray, kind: np.ndarray, table: np.ndarray, classes: int, alone: int) -> tuple[np.ndarray, float]:
    """New classes of words, from the classes around them and the table of all class bigrams, and what the moves gain one by one.

    Words of ``alone`` tokens or more go one after the other, the table moving
    along; the gains of the others are taken to first order. A word whose own
    class is fixed (the end's, or that of unseen words) keeps it.
    """
    table, kind, total, won = table.astype(float), kind.copy(), before.sum(1), 0.0
    movable = kind < classes
    for w in np.flatnonzero(movable & (total >= alone))[np.argsort(-total[movable & (total >= alone)], kind="stable")]:
        a, r, l = kind[w], after[w].astype(float), before[w].astype(float)
        table[a] -= r
        table[:, a] -= l
        table = np.maximum(table, 0)
        rows, columns = table[:classes], table[:, :classes].T
        gain = (_xlogx(rows + r) - _xlogx(rows)).sum(1) + (_xlogx(columns + l) - _xlogx(columns)).sum(1)
        gain -= _xlogx(rows.sum(1) + r.sum()) - _xlogx(rows.sum(1)) + _xlogx(columns.sum(1) + l.sum()) - _xlogx(columns.sum(1))
        b = a if gain[a] >= gain.max() - 1e-9 else int(gain.argmax())
        table[b] += r
        table[:, b] += l
        kind[w] = b
        won += float(gain[b] - gain[a])
    few = np.flatnonzero(movable & (total < alone))
    logs = np.log(table + 0.1)
    gain = after[few] @ logs[:classes].T + before[few] @ logs[:, :classes] - total[few][:, None] * (np.log(table.sum(1) + 1)[:classes] + np.log(table.sum(0) + 1)[:classes])
    best, own = gain.argmax(1), gain[np.arange(len(few)), kind[few]]
    if len(few):
        more = gain.max(1) - own
        kind[few] = np.where(more > 1e-6, best, kind[few])
        won += float(more[more > 1e-6].sum())
    return kind, won


def _sweep(table: np.ndarray, classes: int, alone: int):
    """Each word's count and new class, sent back to the blocks that have it."""
    size = classes + 2

    def run(runs: pa.Table) -> pa.Table:
        got = [unpack(x) for x in sorted(runs.column("run").to_pylist())]
        ids: dict[bytes, int] = {}
        places = [np.fromiter((ids.setdefault(w, len(ids)) for w in g[1]), dtype=np.int64, count=len(g[1])) for g in got]
        n, kind = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=np.int64)
        for g, place in zip(got, places):
            n[place] += unplanes(g[3])
            kind[place] = g[4]
        cells, times = (np.concatenate(x) for x in zip(*((place[unsteps(g[5])] * (2 * size) + g[6], unplanes(g[7])) for g, place in zip(got, places))))
        around = np.bincount(cells, weights=times, minlength=len(ids) * 2 * size).astype(np.float32).reshape(len(ids), 2 * size)
        kind, won = move_words(around[:, :size], around[:, size:], kind, table, classes, alone)
        replies = [pack((g[2], planes(n[p], "<u8"), kind[p].astype(np.uint8))) for g, p in zip(got, places)]
        return pa.table({"block": pa.array([*(g[0] for g in got), -1], pa.int64()), "dict": pa.array([*replies, pack(won)], pa.binary())})

    return run


def _encode(carry: list[str], tokens: int, types: int):
    """Rows of texts: counts, base score, and the classes of their tokens (128 is added for words seen once)."""
    def run(blocks: pa.Table, dicts: pa.Table) -> pa.Table:
        (_, b), = _read(blocks)
        count, kind = np.zeros(len(b.words), np.int64), np.zeros(len(b.words), np.int64)
        for where, n, k in map(unpack, dicts.column("dict").to_pylist()):
            at = unsteps(where)
            count[at], kind[at] = unplanes(n, "<u8"), k
        starts = np.cumsum(b.sizes) - b.sizes
        c = count[b.ids]
        base = np.add.reduceat(np.log10((c + 1) / (tokens + types + 1)), starts)
        words = np.add.reduceat(np.log10(np.maximum(c, 1)), starts)
        known = np.add.reduceat((c > 0).astype(np.int64), starts)
        codes = (kind[b.ids] + 128 * (c == 1)).astype(np.uint8).tobytes()
        columns = {name: pa.concat_arrays([x.values if hasattr(x, "values") else x for x in blocks.column(name).chunks]) for name in carry}
        return pa.table(columns | {
            "__held": pa.array(blocks.column("held")[0].as_py(), pa.bool_()), "__n": pa.array(b.sizes), "__known": pa.array(known), "__base": pa.array(base), "__words": pa.array(words),
            "__codes": pa.array([codes[a:a + n] for a, n in zip(starts.tolist(), b.sizes.tolist())], pa.binary()),
        })

    return run


def _transitions(end: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((size, 2 * size), dtype=np.int64)
        for batch in batches:
            raw = np.frombuffer(bytes([end]) + b"".join(batch.column("__codes").to_pylist()), np.uint8).astype(np.int64)
            codes, once = raw & 127, raw[1:] >> 7
            sums += np.bincount(codes[:-1] * 2 * size + codes[1:] + once * size, minlength=2 * size * size).reshape(size, 2 * size)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums.ravel()[used])], names=["code", "n"])

    return run


def smooth(counts: np.ndarray, once: np.ndarray, mu: float = MU) -> np.ndarray:
    """P(class | class before), the last class being that of unseen words; rows sum to one."""
    size = len(counts)
    after = counts.sum(0).astype(float)
    after[size - 1] = once.sum() + 1
    prior = after / after.sum()
    rows = counts.astype(float)
    rows[:, size - 1] = once
    return (rows + mu * prior) / (rows.sum(1, keepdims=True) + mu)


def _scores(chance: np.ndarray, size: np.ndarray, end: int):
    """log10 of a text: transitions, and its words in their classes."""
    step, within = np.log10(np.maximum(chance, 1e-300)), np.log10(np.maximum(size, 1))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for codes, words in zip(frame.pop("__codes"), frame.pop("__words")):
                c = np.frombuffer(codes, np.uint8).astype(np.int64) & 127
                out.append(float(step[np.append(end, c[:-1]), c].sum() + words - within[c].sum()))
            yield frame.assign(score=pd.Series(out, index=frame.index, dtype=float))

    return run


OUTPUTS = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def score_texts(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", carry: tuple[str, ...] = ("doc_id",), folds: int = 7, fold: int = 2,
    frequent: int = FREQUENT, classes: int = CLASSES, block_tokens: int = BLOCK_TOKENS, sweeps: int = SWEEPS, alone: int = ALONE,
) -> DataFrame:
    """``carry`` with ``held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Texts whose ``crc32(doc_id as text) % folds`` isn't ``fold`` are learnt from
    (null ids are, too). ``base_score`` is the unigram model's log10
    probability with one added to each count, ``score`` the class model's; both
    are distributions over the training vocabulary and one type for all other
    words. Null or empty text is an end token. Repeated rows each count. A very
    long text is read whole. A carried column with the name of a result gives
    way to it. An empty table has no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    from .jaccard import _arrow

    carry = tuple(c for c in carry if c not in OUTPUTS)
    cols = [f"c{k}" for k in range(len(carry))]
    fields = docs.select(*carry).schema.fields
    held = F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))
    rows = docs.select(*(F.col(c).alias(k) for c, k in zip(carry, cols)), empty_binary(F.col(text)).alias("__text"), held.alias("__held"))
    schema = "block long, words binary, ids binary, sizes array<long>, held array<boolean>" + "".join(f", {k} array<{f.dataType.simpleString()}>" for k, f in zip(cols, fields))
    kinds = _arrow(rows.select(*cols).limit(0))
    blocks = materialize(rows.mapInArrow(_blocks(cols, kinds, block_tokens), schema), "blocks")
    bare = blocks.select("block", "words", "ids", "sizes", "held")

    counts = materialize(blocks.mapInArrow(_word_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    tokens, types = (int(x or 0) for x in counts.agg(F.sum("n"), F.count("*")).first())
    top = [bytes(r["word"]) for r in counts.filter(F.col("word") != F.lit(END)).orderBy(F.desc("n"), "word").limit(frequent).collect()]
    discard(counts)
    number = {w: k for k, w in enumerate([*top, END])}
    size = len(number) + 1
    bigrams = np.zeros(size * size)
    for r in blocks.mapInArrow(_frequent_bigrams(number), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toLocalIterator():
        bigrams[r["code"]] = r["n"]
    label, table = exchange(bigrams.reshape(size, size), len(top), classes)
    end, unseen, width = classes, classes + 1, classes + 2

    parts = parts_for(docs, PART_BYTES)
    runs = blocks.mapInArrow(_profiles(number, label, classes, parts), "part long, run binary")
    dicts = materialize(runs.groupBy("part").applyInArrow(_assign(number, label, table, classes), "block long, dict binary"), "classes")
    del runs, counts
    release(spark)
    for _ in range(sweeps):
        around = materialize(bare.groupBy("block").cogroup(dicts.filter("block >= 0").groupBy("block")).applyInArrow(_around(classes, parts), "part long, run binary"), "around")
        release(spark)
        now = np.zeros(width * width, dtype=np.int64)
        for r in around.filter("part = -1").mapInArrow(_table, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
            now[r["code"]] = r["n"]
        now = now.reshape(width, width)
        moved = materialize(around.filter("part >= 0").groupBy("part").applyInArrow(_sweep(now, classes, alone), "block long, dict binary"), "classes")
        discard(around, dicts)
        dicts = moved
        won = sum(unpack(r["dict"]) for r in moved.filter("block = -1").toLocalIterator())  # a number for each partition of words
        del around, moved
        release(spark)
        if won < ENOUGH * abs(log_likelihood(now)):
            break

    shape = ", ".join(f"{k} {f.dataType.simpleString()}" for k, f in zip(cols, fields))
    encoded = blocks.groupBy("block").cogroup(dicts.filter("block >= 0").groupBy("block")).applyInArrow(_encode(cols, tokens, types), f"{shape}, __held boolean, __n long, __known long, __base double, __words double, __codes binary")
    encoded = materialize(encoded, "encoded")
    discard(blocks, dicts)

    seen = np.zeros((width, 2 * width), dtype=np.int64)
    for r in encoded.filter("not __held").select("__codes").mapInArrow(_transitions(end, width), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        seen[divmod(r["code"], 2 * width)] = r["n"]
    whole, once = seen[:, :width] + seen[:, width:], seen[:, width:].sum(1)
    chance, within = smooth(whole, once), whole.sum(0)
    within[unseen] = 1
    out = encoded.mapInPandas(_scores(chance, within, end), f"{shape}, __held boolean, __n long, __known long, __base double, score double")
    return out.select(*(F.col(k).alias(c) for c, k in zip(carry, cols)), F.col("__held").alias("held_out"), F.col("__n").alias("n_tokens"), F.col("__known").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), F.col("__base").alias("base_score"), "score")
