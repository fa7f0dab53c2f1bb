"""Hard negatives by bit-sliced integer products.

Vectors become integers, and blocks of them are stored by bit-plane, the most
significant first, in two's complement. The product of an anchor with a block
grows plane by plane; what the planes still to come can add is bounded by the
sums of the anchor's positive and of its negative components, so after each
plane every score lies in a known interval, half as wide as before. A candidate
is dropped as soon as its interval can't qualify: below the scores that are
already sure of their place, or outside the window that a positive leaves for
its negatives. The last plane leaves exact scores.

All anchors meet all blocks in a grid: a cell holds some anchors and streams
some blocks past them, and returns the best of each anchor only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Vectors of a block, anchors of a cell, anchors whose products are formed at once.
BLOCK, CELL, TILE = 2048, 1 << 14, 1024
#: Candidate vectors of a cell that make another column of the grid.
COLUMN = 1 << 20
#: Integer components are held to this range, which keeps sums within 64 bits.
MOST = 1 << 24
#: Share of pairs still open below which pairs are followed one by one.
SPARSE = 1 / 8
PAIRS = 1 << 16

BLOCKS = "block long, n int, dim int, width int, n_anchors int, ids binary, labels binary, anchors binary, planes binary"
ANCHORS = "row long, id long, label long, vector binary"


def slices(values: np.ndarray) -> tuple[int, bytes]:
    """An (n, dim) integer array as bit-planes of two's complement, the sign's first."""
    low, high = (int(values.min()), int(values.max())) if values.size else (0, 0)
    width = max((-low - 1).bit_length() if low < 0 else 0, high.bit_length() if high > 0 else 0) + 1
    shifted = values.astype(np.int64) & ((1 << width) - 1)
    return width, b"".join(np.packbits((shifted >> k & 1).astype(np.uint8)).tobytes() for k in range(width - 1, -1, -1))


def plane(body: bytes, k: int, n: int, dim: int) -> np.ndarray:
    """The ``k``-th plane from the top as zeros and ones."""
    each = (n * dim + 7) // 8
    return np.unpackbits(np.frombuffer(body, np.uint8, each, k * each), count=n * dim).reshape(n, dim)


def _pack(scale: float, size: int):
    """Vectors to blocks, each named by its first row's number; the last one of a task is smaller."""

    def block(number: int, ids: list, labels: list, flags: list, vectors: list) -> pa.RecordBatch:
        dim = max(map(len, vectors))
        values = np.zeros((len(vectors), dim), np.float64)
        for k, v in enumerate(vectors):
            values[k, :len(v)] = v
        values = np.clip(np.floor(values * scale), -MOST, MOST).astype(np.int64)
        width, body = slices(values)
        cols = [[number], [len(vectors)], [dim], [width], [int(sum(flags))], [np.array(ids, "<i8").tobytes()], [np.array(labels, "<i8").tobytes()], [np.packbits(np.array(flags, bool)).tobytes()], [body]]
        types = [pa.int64(), *[pa.int32()] * 4, *[pa.binary()] * 4]
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], names=[x.split()[0] for x in BLOCKS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        held: list[list] = [[], [], [], []]
        for batch in batches:
            for a in range(0, batch.num_rows, size):
                part = batch.slice(a, size)
                for k in range(3):
                    held[k] += part.column(k).to_pylist()
                vectors = part.column(3)
                flat, ends = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(vectors.value_lengths().to_numpy())
                held[3] += np.split(flat, ends[:-1])
                while len(held[0]) >= size:
                    yield block(number, *(h[:size] for h in held))
                    held, number = [h[size:] for h in held], number + size
        if held[0]:
            yield block(number, *held)

    return run


def _values(row: dict) -> np.ndarray:
    out = np.zeros((row["n"], row["dim"]), np.int64)
    for k in range(row["width"]):
        weight = 1 << row["width"] - 1 - k
        out += plane(row["planes"], k, row["n"], row["dim"]).astype(np.int64) * (-weight if k == 0 else weight)
    return out


def _anchors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            at = np.flatnonzero(np.unpackbits(np.frombuffer(row["anchors"], np.uint8), count=row["n"]))
            ids, labels, values = np.frombuffer(row["ids"], "<i8")[at], np.frombuffer(row["labels"], "<i8")[at], _values(row)[at]
            yield pa.record_batch({"row": row["block"] + at, "id": ids, "label": labels, "vector": pa.array([v.astype("<i8").tobytes() for v in values], pa.binary())})


def narrow(anchors: np.ndarray, row: dict, still, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (anchor, vector of the block) that may qualify, with their exact scores.

    ``start`` says which pairs are open at first; ``still(i, j, low, high)``
    says, of pairs with scores from ``low`` to ``high``, which stay open. ``i``
    and ``j`` are ``None`` while whole arrays are asked about.
    """
    n, dim, width = row["n"], row["dim"], row["width"]
    d = max(dim, anchors.shape[1])
    a = np.zeros((len(anchors), d), np.int64)
    a[:, :anchors.shape[1]] = anchors
    a = a[:, :dim] if dim < d else a
    exact = float(np.abs(a).sum(1).max(initial=0)) * (1 << width) < 2.0**53
    kind = np.float64 if exact else np.int64
    above, below, a = a.clip(min=0).sum(1).astype(kind), a.clip(max=0).sum(1).astype(kind), a.astype(kind)
    part, live, i, j = np.zeros((len(a), n), kind), start.copy(), None, None
    for k in range(width):
        left = width - 1 - k
        weight, rest = (-(1 << left) if k == 0 else 1 << left), (1 << left) - 1
        bits = plane(row["planes"], k, n, dim).astype(kind)
        if i is None and np.count_nonzero(live) < SPARSE * live.size:
            i, j = np.nonzero(live)
            part = part[i, j]
        if i is None:
            part += weight * (a @ bits.T)
            live &= still(None, None, part + rest * below[:, None], part + rest * above[:, None])
        else:
            for at in range(0, len(i), PAIRS):
                s = slice(at, at + PAIRS)
                part[s] += weight * np.einsum("pd,pd->p", a[i[s]], bits[j[s]])
            keep = still(i, j, part + rest * below[i], part + rest * above[i])
            i, j, part = i[keep], j[keep], part[keep]
    if i is None:
        i, j = np.nonzero(live)
        part = part[i, j]
    return i, j, part.astype(np.int64)


class Best:
    """The first ``most`` of each list: higher scores first, then smaller ids, then rows."""

    def __init__(self, lists: int, most: int):
        self.most = most
        self.at, self.score, self.id, self.row = (np.zeros(0, np.int64) for _ in range(4))
        #: A list's last score once it is full: what is below can't enter.
        self.floor = np.full(lists, np.iinfo(np.int64).min)

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        keep = score >= self.floor[at]
        at, score, ids, rows = (np.concatenate([a, b[keep]]) for a, b in zip((self.at, self.score, self.id, self.row), (at, score, ids, rows)))
        order = np.lexsort((rows, ids, -score, at))
        at = at[order]
        first = np.searchsorted(at, at)
        rank = np.arange(len(at)) - first
        full = rank == self.most - 1
        self.floor[at[full]] = score[order][full]
        keep = rank < self.most
        self.at, self.score, self.id, self.row = at[keep], score[order][keep], ids[order][keep], rows[order][keep]


def _cell(most: int, tile_size: int, window: tuple[int, int] | None):
    """One cell of the grid: its anchors come first, its blocks after them.

    Without a window: for each anchor the first rows of its own label. With
    one: for each anchor and positive the first rows of other labels within it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        tiles: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] is None:
                    rows.append(row)
                    continue
                if rows and not tiles:
                    tiles = [_tile(rows[a:a + tile_size], most, window) for a in range(0, len(rows), tile_size)]
                ids, labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
                numbers = row["block"] + np.arange(row["n"])
                for tile in tiles:
                    if window is None:
                        _nearest(tile, row, ids, labels, numbers)
                    else:
                        _within(tile, row, ids, labels, numbers)
        for tile in tiles:
            best = tile["best"]
            if len(best.at):
                yield pa.record_batch({"row": tile["row"][best.at // tile["lists"]], "pick": best.at % tile["lists"], "other_row": best.row, "other_id": best.id, "score": best.score})

    return run


def _tile(rows: list[dict], most: int, window: tuple[int, int] | None) -> dict:
    vectors = [np.frombuffer(r["vector"], "<i8") for r in rows]
    values = np.zeros((len(rows), max(map(len, vectors))), np.int64)
    for k, v in enumerate(vectors):
        values[k, :len(v)] = v
    lists = 1 if window is None else max(len(r["scores"]) for r in rows)
    out = {"row": np.array([r["row"] for r in rows], np.int64), "label": np.array([r["label"] for r in rows], np.int64), "values": values, "lists": lists, "best": Best(len(rows) * lists, most)}
    if window is not None:
        least, top = window
        # 100 * score lies between least * positive and top * positive; an unused list has no room
        out["low"], out["high"] = np.ones((len(rows), lists), np.int64), np.zeros((len(rows), lists), np.int64)
        for k, r in enumerate(rows):
            s = np.array(r["scores"], np.int64)
            out["low"][k, :len(s)], out["high"][k, :len(s)] = -(-least * s // 100), top * s // 100
    return out


def _nearest(tile: dict, row: dict, ids, labels, numbers) -> None:
    best, n = tile["best"], row["n"]

    def still(i, j, low, high):
        if i is None:
            floor = best.floor.astype(np.float64)
            if n > best.most:  # so many of this block are sure to be as good
                sure = np.where(start, low, -np.inf)
                floor = np.maximum(floor, np.partition(sure, n - best.most, axis=1)[:, n - best.most])
            return high >= floor[:, None]
        return high >= best.floor[i]

    start = (tile["label"][:, None] == labels[None, :]) & (tile["row"][:, None] != numbers[None, :])
    i, j, score = narrow(tile["values"], row, still, start)
    best.add(i, score, ids[j], numbers[j])


def _within(tile: dict, row: dict, ids, labels, numbers) -> None:
    best, lists = tile["best"], tile["lists"]
    low, high = np.maximum(tile["low"], best.floor.reshape(-1, lists)), tile["high"]

    def still(i, j, least, most):
        if i is None:
            out = np.zeros(least.shape, bool)
            for q in range(lists):
                out |= (least <= high[:, q, None]) & (most >= low[:, q, None])
            return out
        out = np.zeros(len(i), bool)
        for q in range(lists):
            out |= (least <= high[i, q]) & (most >= low[i, q])
        return out

    i, j, score = narrow(tile["values"], row, still, tile["label"][:, None] != labels[None, :])
    for q in range(lists):
        fits = (score >= low[i, q]) & (score <= high[i, q])
        best.add(i[fits] * lists + q, score[fits], ids[j[fits]], numbers[j[fits]])


def _meet(blocks: DataFrame, anchors: DataFrame, columns: int, lines: int, most: int, tile: int, window: tuple[int, int] | None = None) -> DataFrame:
    """All anchors against all blocks; of each cell the best of each anchor and list."""
    seen = [c for c in anchors.columns]
    right = blocks.select("block", "n", "dim", "width", "ids", "labels", "planes", F.explode(F.sequence(F.lit(0), F.lit(lines - 1))).alias("line"), F.pmod(F.xxhash64("block"), F.lit(columns)).cast("int").alias("column"))
    left = anchors.select("*", F.pmod(F.xxhash64("row"), F.lit(lines)).cast("int").alias("line"), F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("column"))
    both = left.unionByName(right, allowMissingColumns=True)
    cell = (F.col("line") * columns + F.col("column")).alias("cell")
    dealt = both.select(*seen, "block", "n", "dim", "width", "ids", "labels", "planes", cell).repartitionById(columns * lines, "cell").sortWithinPartitions(F.col("block").asc_nulls_first())
    return dealt.mapInArrow(_cell(most, tile, window), "row long, pick long, other_row long, other_id long, score long")


def mine_hard_negatives(vectors: DataFrame, anchor: Column, key: str = "vec_id", label: str = "label", vector: str = "embedding", scale: float = 256.0, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90), block: int = BLOCK, tile: int = TILE, cell: int = CELL, column: int = COLUMN) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score`` and ``negative_score``.

    Scores are inner products of ``floor(scale * component)``. An anchor's
    positives are the first ``positives`` other rows of its label; for each, the
    first ``negatives`` rows of other labels are returned whose score is from
    ``window[0]`` to ``window[1]`` hundredths of the positive's. Higher scores
    come first, then smaller keys; rows that share a key are told apart, in the
    order of reading, and each anchor row has its own results. A row takes part
    if its key and label aren't null and its vector isn't null and holds finite
    numbers only. Vectors of unequal length compare over the shorter. Integer
    components are held to +-2**24. Keys and labels are whole numbers. Other
    columns are ignored; an empty table, or one without anchors, gives none.
    """
    spark = vectors.sparkSession
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & finite)
    picked = rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vector).cast("array<double>").alias("vector"))
    blocks = materialize(picked.mapInArrow(_pack(scale, block), BLOCKS), "blocks")
    n_blocks, n_rows, n_anchors = blocks.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_anchors"), F.lit(0))).first()
    lines = max(1, -(-n_anchors // cell))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = max(1, min(n_blocks, max(-(-n_rows // column), -(-tasks // lines))))
    anchors = blocks.filter("n_anchors > 0").select("block", "n", "dim", "width", "ids", "labels", "anchors", "planes").mapInArrow(_anchors_of, ANCHORS)

    first = Window.partitionBy("row").orderBy(F.desc("score"), "other_id", "other_row")
    found = _meet(blocks, anchors.select("row", "label", "vector"), columns, lines, positives, tile)
    near = materialize(found.withColumn("pick", F.row_number().over(first) - 1).filter(F.col("pick") < positives).select("row", "pick", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    scores = near.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("pick", "positive_score"))), lambda s: s["positive_score"]).alias("scores"))
    asked = anchors.join(scores, "row")
    found = _meet(blocks, asked.select("row", "label", "vector", "scores"), columns, lines, negatives, tile, window)
    first = Window.partitionBy("row", "pick").orderBy(F.desc("score"), "other_id", "other_row")
    best = found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= negatives)
    return (
        best.join(near, ["row", "pick"]).join(anchors.select("row", F.col("id").alias("anchor_id")), "row")
        .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )
