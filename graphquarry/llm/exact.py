"""Exact duplicates by an extendible-hash index on shared files.

Two passes read the texts. The first only hashes them: keys that more than one
row has are marked in a sieve of fixed size, and their weights build the
directory, which doubles whenever a bucket at its full depth is overfull and
splits. The second writes every row's digest to the shared folder, together
with one copy for each different text of a task whose key is marked; rows point
to that copy. Owner tasks then take the copies of a range of buckets each, in
the order of their keys, chain what collides and compare bytes. So equality is
decided by bytes, never by a hash, and a text moves only if its key is shared,
once for each task that read it, however many copies the task saw.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, discard, empty_binary, free_names, materialize, plan_bytes

#: Words of 64 marks in the sieve (8 MB in all), as a power of two; a directory's depth at most.
SIEVE_BITS, MOST_DEPTH = 20, 16
#: Bytes of text that fill a bucket; bytes of different texts that a task holds before it writes them.
BUCKET_BYTES, HELD_BYTES = 4 << 20, 32 << 20
#: Copies of one text that reach its owner count so often at most when buckets are weighed.
MOST_COPIES = 64


def squeezed(body: bytes) -> bytes:
    """``body`` with each run of space and 0x09-0x0D as one space."""
    words = body.split()
    if not words:
        return b" " if body else b""
    return b" " * body[:1].isspace() + b" ".join(words) + b" " * body[-1:].isspace()


class Directory:
    """An extendible-hash directory over the leading bits of 64-bit keys.

    ``weights`` are those of the keys' first cells of equal width. Entry ``e`` of
    ``table`` names the bucket of all keys whose first ``depth`` bits are ``e``;
    a bucket of less local depth has several neighbouring entries.
    """

    def __init__(self, weights: np.ndarray, capacity: int, most_depth: int = MOST_DEPTH):
        self.sums = np.concatenate([[0], np.cumsum(weights, dtype=np.int64)])
        self.bits = len(weights).bit_length() - 1
        self.depth, self.table = 0, np.zeros(1, np.int32)
        self.local, self.prefix = [0], [0]
        waiting = [0]
        while waiting:
            bucket = waiting.pop()
            if self.weight(bucket) > capacity and self.local[bucket] < min(most_depth, self.bits):
                waiting += [bucket, self.split(bucket)]

    def weight(self, bucket: int) -> int:
        width = self.bits - self.local[bucket]
        first = self.prefix[bucket] << width
        return int(self.sums[first + (1 << width)] - self.sums[first])

    def split(self, bucket: int) -> int:
        """Move the upper half of a bucket to a new one; the directory doubles if it is too short to tell them apart."""
        if self.local[bucket] == self.depth:
            self.table, self.depth = np.repeat(self.table, 2), self.depth + 1
        new = len(self.local)
        self.local[bucket] += 1
        self.prefix[bucket] <<= 1
        self.local.append(self.local[bucket])
        self.prefix.append(self.prefix[bucket] | 1)
        width = self.depth - self.local[new]
        self.table[self.prefix[new] << width:(self.prefix[new] + 1) << width] = new
        return new

    def owners(self, n: int) -> np.ndarray:
        """The owner of each entry: ``n`` key ranges at most, cut between buckets, of about equal weight."""
        starts = np.arange(len(self.table), dtype=np.int64) << (self.bits - self.depth)
        new = np.ones(len(self.table), dtype=bool)
        new[1:] = self.table[1:] != self.table[:-1]
        before = self.sums[starts][new][np.cumsum(new) - 1] + np.cumsum(new) - 1
        return (before * n // (self.sums[-1] + int(new.sum()))).astype(np.int32)

    def entries(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> U64(64 - self.depth)).astype(np.int64) if self.depth else np.zeros(len(keys), np.int64)


def hashed(bodies: list[bytes], key_bits: int) -> np.ndarray:
    keys = np.fromiter((xxhash.xxh3_64_intdigest(b) for b in bodies), dtype=U64, count=len(bodies))
    return keys >> U64(64 - key_bits) << U64(64 - key_bits)


def _marked(keys: np.ndarray, sieve: np.ndarray) -> np.ndarray:
    return sieve[(keys >> U64(64 - SIEVE_BITS)).astype(np.int64)] >> (keys >> U64(58 - SIEVE_BITS) & U64(63)) & U64(1) > 0


def _key_pass(key_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [squeezed(b) for b in batch.column(0).to_pylist()]
            yield pa.record_batch({"key": hashed(bodies, key_bits).view(np.int64), "size": pa.array([len(b) for b in bodies], pa.int64())})

    return run


def _row_pass(sieve, owner_of, entry_of, key_bits: int, names: list[str]):
    """Rows (``c*`` columns, ``row``, ``rep``, ``sha``) and copies (``rep``, ``owner``, ``bucket``, ``key``, ``n``, ``least``, ``least_row``, ``body``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, base = sieve.value, TaskContext.get().partitionId() << 33
        held: dict[bytes, list] = {}
        size = row = reps = 0
        kinds = None

        def copies() -> pa.RecordBatch:
            bodies = list(held)
            keys = hashed(bodies, key_bits)
            rep, n, _, least, least_row = zip(*held.values())
            entry = entry_of(keys)
            out = {name: pa.nulls(len(bodies), kind) for name, kind in kinds.items()}
            out |= {"row": pa.nulls(len(bodies), pa.int64()), "sha": pa.nulls(len(bodies), pa.string()), "rep": pa.array(rep, pa.int64())}
            out |= {"owner": owner_of.value[0][entry], "bucket": owner_of.value[1][entry], "key": keys.view(np.int64), "n": pa.array(n, pa.int64())}
            out |= {"least": pa.array(least, kinds["c0"]), "least_row": pa.array(least_row, pa.int64()), "body": pa.array(bodies, pa.binary())}
            return pa.record_batch(out)

        for batch in batches:
            kinds = {name: batch.schema.field(name).type for name in names}
            bodies = [squeezed(b) for b in batch.column("text").to_pylist()]
            keys = hashed(bodies, key_bits)
            pointer: list[int | None] = [None] * len(bodies)
            ids = batch.column("c0")
            for k in np.flatnonzero(_marked(keys, marks)).tolist():
                body, name = bodies[k], ids[k].as_py()
                here = (name is None, name, base + row + k)
                if (seen := held.get(body)) is None:
                    held[body] = [base + reps, 1, *here]
                    reps += 1
                    size += len(body)
                else:
                    seen[1] += 1
                    if here[0] < seen[2] or here[0] == seen[2] and not here[0] and here[1] < seen[3]:
                        seen[2:] = here
                pointer[k] = held[body][0]
                if size > HELD_BYTES:
                    yield copies()
                    held.clear()
                    size = 0
            out = {name: batch.column(name) for name in names}
            out |= {"row": np.arange(base + row, base + row + len(bodies)), "sha": pa.array([hashlib.sha256(b).hexdigest() for b in bodies], pa.string()), "rep": pa.array(pointer, pa.int64())}
            none = len(bodies)
            out |= {"owner": pa.nulls(none, pa.int32()), "bucket": pa.nulls(none, pa.int32()), "key": pa.nulls(none, pa.int64()), "n": pa.nulls(none, pa.int64())}
            out |= {"least": pa.nulls(none, kinds["c0"]), "least_row": pa.nulls(none, pa.int64()), "body": pa.nulls(none, pa.binary())}
            yield pa.record_batch(out)
            row += len(bodies)
        if held:
            yield copies()

    return run


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An owner's copies, in the order of their keys, to each copy's group: links of a key's chain are told apart by bytes."""
    chain: dict[bytes, list] = {}
    now = kind = None
    out: list[tuple] = []

    def flushed() -> list[tuple]:
        rows = [(rep, bucket, now, slot, least, least_row, n) for slot, (n, _, least, least_row, reps) in enumerate(chain.values()) for rep, bucket in reps]
        chain.clear()
        return rows

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows))
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), kind, pa.int64(), pa.int64())
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], names=["rep", "bucket", "key", "slot", "keep", "keep_row", "group_size"])

    for batch in batches:
        kind = batch.schema.field("least").type
        for row in batch.to_pylist():
            if row["key"] != now:
                out += flushed()
                now = row["key"]
                if len(out) > 1 << 14:
                    yield packed(out)
                    out = []
            here = (row["least"] is None, row["least"], row["least_row"])
            link = chain.get(row["body"])
            if link is None:
                chain[row["body"]] = [row["n"], *here, [(row["rep"], row["bucket"])]]
                continue
            link[0] += row["n"]
            link[4].append((row["rep"], row["bucket"]))
            if here[0] < link[1] or here[0] == link[1] and (here[2] < link[3] if here[0] or here[1] == link[2] else here[1] < link[2]):
                link[1:4] = here
    out += flushed()
    if out:
        yield packed(out)


def find_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", carry: tuple[str, ...] = (), key_bits: int = 64, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``carry``, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal if their bytes are, once each run of space and 0x09-0x0D is
    one space; null counts as empty, so null and empty texts are one group. Of a
    group the row of the smallest key stays; null keys come last; of rows with
    equal keys one stays. ``keep_id`` is null only where all keys of the group
    are. An empty table gives an empty result. Columns that are neither named
    here nor carried are ignored, whatever their names; a result whose name is
    taken by ``key`` or ``carry`` gets ``_`` appended. A text must fit in a
    task's memory; a task holds ``HELD_BYTES`` of different texts. ``key_bits``
    below 64 makes keys collide, which changes the chains, not the result.
    """
    spark = docs.sparkSession
    body = empty_binary(F.col(text)).alias("text")
    shared = docs.select(body).mapInArrow(_key_pass(key_bits), "key long, size long").groupBy("key").agg(F.count("*").alias("n"), F.max("size").alias("size")).filter("n > 1")
    word = F.shiftrightunsigned("key", 64 - SIEVE_BITS).alias("word")
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {58 - SIEVE_BITS}) & 63 as int))")
    marks = shared.groupBy(word).agg(F.bit_or(bit).alias("marks"), F.sum(F.col("size") * F.least("n", F.lit(MOST_COPIES))).alias("weight")).toArrow()
    sieve, weights = np.zeros(1 << SIEVE_BITS, U64), np.zeros(1 << SIEVE_BITS, np.int64)
    at = marks.column("word").to_numpy()
    sieve[at], weights[at] = marks.column("marks").to_numpy().view(U64), marks.column("weight").to_numpy()

    total = int(weights.sum())
    directory = Directory(weights, max(bucket_bytes, total >> (MOST_DEPTH - 2)))
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(total, plan_bytes(docs) or total) // (64 << 20))
    context = spark.sparkContext
    sent, placed = context.broadcast(sieve), context.broadcast((directory.owners(owners), directory.table))

    kinds, columns = dict(docs.dtypes), [key, *carry]
    names = [f"c{k}" for k in range(len(columns))]
    schema = ", ".join(f"{n} {kinds[c]}" for n, c in zip(names, columns)) + f", row long, sha string, rep long, owner int, bucket int, key long, n long, least {kinds[key]}, least_row long, body binary"
    directory.sums = directory.local = directory.prefix = None
    written = materialize(docs.select(*(F.col(c).alias(n) for n, c in zip(names, columns)), body).mapInArrow(_row_pass(sent, placed, directory.entries, key_bits, names), schema), "rows")
    copies = written.filter("body is not null").select("owner", "rep", "bucket", "key", "n", "least", "least_row", "body")
    index = materialize(copies.repartitionById(owners, "owner").sortWithinPartitions("key", "rep").mapInArrow(_chain, f"rep long, bucket int, key long, slot int, keep {kinds[key]}, keep_row long, group_size long"), "index")

    rows = written.filter("row is not null").select(*names, "row", "sha", "rep")
    results = free_names(("keep_id", "group_size", "kept", "text_sha256"), columns)
    restored = [F.col(n).alias(c) for n, c in zip(names, columns)]
    single = rows.filter("rep is null").select(*restored, *(c.alias(r) for c, r in zip((F.col("c0"), F.lit(1).cast("long"), F.lit(True), F.col("sha")), results)))
    grouped = rows.filter("rep is not null").join(index.select("rep", "keep", "keep_row", "group_size"), "rep")
    return single.unionAll(grouped.select(*restored, *(c.alias(r) for c, r in zip((F.col("keep"), F.col("group_size"), F.col("row") == F.col("keep_row"), F.col("sha")), results))))


def drop_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` without the rows that :func:`find_duplicates` doesn't keep; all columns come back as they are."""
    rest = [c for c in docs.columns if c != key]
    kept = free_names(("keep_id", "group_size", "kept", "text_sha256"), [key, *rest])[2]
    return find_duplicates(docs, text, key, tuple(rest)).filter(F.col(f"`{kept}`")).select(*(F.col(f"`{c}`") for c in docs.columns))
