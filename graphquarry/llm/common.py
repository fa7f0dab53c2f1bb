"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
MASK64 = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the cluster's ``spark.checkpoint.dir``. Only where that is unset, as
    in local tests, a temporary folder takes its place.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None)
    if not found:
        held = sc._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="graphquarry-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what :func:`materialize` wrote; nothing may read it afterwards."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished rounds: it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows of an Arrow batch at most: with long texts, a worker's memory follows the batch.
BATCH_ROWS = 1024


def small_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to ``BATCH_ROWS`` rows, where it allows more."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the input's bytes: a partition count without a job. 0 where it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def parts_for(df: DataFrame, bytes_each: int) -> int:
    """Partitions of about ``bytes_each``, never fewer than the session's shuffle partitions."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-plan_bytes(df) // bytes_each))


def empty_binary(column) -> "F.Column":
    """A text column as raw UTF-8 bytes, null as empty."""
    return F.coalesce(column.cast("binary"), F.lit("").cast("binary"))


def free_names(names, taken) -> list[str]:
    """``names``, each with as many ``_`` appended as set it apart from those taken, letter case aside."""
    out, used = [], {t.lower() for t in taken}
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base & MASK64, dtype=U64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class PowerTable:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            most = max(n, 1 << 16)
            self.up, self.down = powers(self.base, most), powers(self.inverse, most)
        return self.up[:n], self.down[:n]


#: Bytes that end a word: space and 0x09-0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_WORDS = PowerTable(0x9E3779B97F4A7C15)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all lower-cased words, and how many each text has.

    A polynomial over the bytes, taken for all words at once from prefix sums
    modulo 2**64, then mixed.
    """
    if not texts:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    joined = LOWER[np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)]
    space = SPACE[joined]
    edge = np.diff(space.astype(np.int8), prepend=np.int8(1))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if end.size and start.size and end[0] < start[0]:
        end = end[1:]
    _, down = _WORDS.upto(len(joined) + 1)
    sums = np.zeros(len(joined) + 1, dtype=U64)
    np.cumsum((joined.astype(U64) + U64(1)) * down[: len(joined)], out=sums[1:])
    up, _ = _WORDS.upto(len(joined) + 1)
    hashes = mix64((sums[end] - sums[start]) * up[end] + (end - start).astype(U64))
    bounds = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(start, bounds), prepend=0)
    return hashes, counts


def planes(values: np.ndarray, kind: str = "<u4") -> bytes:
    """Numbers, the bytes of one weight together: those that are all zero cost next to nothing once compressed."""
    return np.ascontiguousarray(np.asarray(values).astype(kind).view(np.uint8).reshape(len(values), np.dtype(kind).itemsize).T).tobytes()


def unplanes(body: bytes, kind: str = "<u4") -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(width, -1).T).view(kind).ravel()


def steps(values: np.ndarray) -> bytes:
    """Numbers below 2**32 by what each adds to the one before: small if they ascend."""
    return planes(np.diff(np.asarray(values, dtype=np.int64), prepend=0))


def unsteps(body: bytes) -> np.ndarray:
    return np.cumsum(unplanes(body), dtype=np.uint32).astype(np.int64)


def chunks(rows, most: int, size=len):
    """Lists of consecutive rows whose sizes sum to about ``most``; a larger row stands alone."""
    out, total = [], 0
    for row in rows:
        n = size(row)
        if out and total + n > most:
            yield out
            out, total = [], 0
        out.append(row)
        total += n
    if out:
        yield out
