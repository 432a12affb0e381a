"""What the text operators share: durable intermediate tables, word hashing in
numpy, held-out splits and connected components.

Words are maximal runs of bytes other than ASCII white space. All hashing is
done on whole Arrow batches with numpy, a few megabytes of text at a time, so a
task's memory is bounded by one batch and its longest text.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
#: Arrow batches that go to Python hold so many bytes (and one row more) at most.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Row groups of written tables hold so many bytes at most: a task holds one while it writes, and one of each table that it reads.
GROUP_BYTES = 16 << 20
_GROUP_SETTING = "parquet.block.size"

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_POSITION = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_COUNT = np.uint64(0xD6E8FEB86659FD93)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which every executor sees. Where the session names none, local mode takes a new temporary folder; on a cluster that is an error, as each machine would write to its own disk."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def small_batches(frame: DataFrame) -> DataFrame:
    """`frame` as it is; its session sends Arrow batches of BATCH_BYTES and writes row groups of GROUP_BYTES from now on, unless it is set to less. The settings are read when a frame runs, so they can't be put back here; rows, not results, are dealt out by them."""
    spark = frame.sparkSession
    conf = spark.conf
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get(_BATCH_SETTING)) > BATCH_BYTES:
        conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    if int(conf.get(_GROUP_SETTING, None) or GROUP_BYTES + 1) > GROUP_BYTES:
        conf.set(_GROUP_SETTING, str(GROUP_BYTES))
    return frame


def lean(run):
    """An Arrow function that gives back to the system, at the end of each task, the memory it no longer holds: idle workers of one stage leave room to the next."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library, where it has it
        if trim is not None:
            trim(0)

    return wrapped


class Workspace:
    """Tables written to the shared folder: they cut the lineage and outlive any executor.

    Tables that a returned frame still reads stay until the application ends; drop() and close() remove others earlier.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        path, system = self._system(self.path)
        system.deleteOnExit(path)

    def _system(self, where: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def keep(self, frame: DataFrame, table: str) -> DataFrame:
        where = f"{self.path}/{table}"
        frame.write.option(_GROUP_SETTING, GROUP_BYTES).mode("overwrite").parquet(where)
        return self.spark.read.schema(frame.schema).parquet(where)

    def drop(self, *tables: str) -> None:
        """Removes tables that no returned frame reads any more."""
        for table in tables:
            path, system = self._system(f"{self.path}/{table}")
            system.delete(path, True)

    def close(self) -> None:
        """Removes all of its tables."""
        path, system = self._system(self.path)
        system.delete(path, True)


def held_out(doc_id: str, parts: int, part: int) -> Column:
    """True for rows whose crc32 of the id as text leaves `part`; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part, F.lit(False))


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, CHUNK_BYTES * 2)
            with np.errstate(over="ignore"):
                cls.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE, np.uint64)]), dtype=np.uint64)
                cls.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE_INVERSE, np.uint64)]), dtype=np.uint64)
        return cls.up, cls.down


def chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK_BYTES characters; a longer text stands alone."""
    start = size = 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if size and size + n > CHUNK_BYTES:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def word_spans(texts: list[str | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, start and end of each word in them, and for each text the number of its first word (one entry more than texts)."""
    raw = [t.encode("utf-8", "replace") if t else b"" for t in texts]
    joined = b" " + b" ".join(raw) + b" "
    buf = np.frombuffer(joined.translate(_LOWER) if lower else joined, np.uint8)
    space = _SPACE[buf]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    bounds = np.cumsum([1] + [len(r) + 1 for r in raw])
    return buf, starts, ends, np.searchsorted(starts, bounds)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _Powers.to(len(buf) + 1)
    with np.errstate(over="ignore"):
        total = np.cumsum(_BYTE[buf] * up[: len(buf)], dtype=np.uint64)
        return mix64((total[ends - 1] - total[starts - 1]) * down[starts] + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.full(n, np.uint64(k) * _COUNT, np.uint64)
        for j in range(k):
            total += words[j : j + n] * _POSITION[j]
        return mix64(total)


def shingle_sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """For each text its distinct k-word shingles as sorted 64-bit hashes; with fewer words the whole sequence is one; without words the set is empty."""
    for a, b in chunks(texts):
        buf, starts, ends, first = word_spans(texts[a:b], lower=True)
        words = word_hashes(buf, starts, ends)
        with np.errstate(over="ignore"):
            runs = window_hashes(words, k)
            for i in range(b - a):
                s, e = first[i], first[i + 1]
                if e - s >= k:
                    yield np.unique(runs[s : e - k + 1])
                elif e > s:
                    yield mix64(np.array([(words[s:e] * _POSITION[: e - s]).sum(dtype=np.uint64) + np.uint64(e - s) * _COUNT], np.uint64))
                else:
                    yield np.zeros(0, np.uint64)


def components(work: Workspace, edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of `edges` (src, dst longs): the smallest node reachable.

    Alternating large-star and small-star rounds; each round's edges are
    written to the shared folder, and the loop ends when a round changes none.
    A hub is met by partial minima before the shuffle and by Spark's skew-join
    splitting after it.
    """

    def state(frame: DataFrame) -> tuple:
        return tuple(frame.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(20,0)"))).first())

    current = work.keep(edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).where("src <> dst").distinct(), f"{name}-0")
    seen, turn = state(current), 0
    while seen[0]:
        both = current.unionByName(current.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("m"))
        large = both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        large = large.where("src <> dst").distinct()
        floor = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(floor, "src").select(F.explode(F.array(F.struct("src", F.col("m").alias("dst")), F.struct(F.col("dst").alias("src"), F.col("m").alias("dst")))).alias("e")).select("e.*")
        turn += 1
        current = work.keep(small.where("src <> dst").distinct(), f"{name}-{turn}")
        work.drop(f"{name}-{turn - 1}")
        now = state(current)
        if now == seen:
            break
        seen = now
    nodes = current.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("component"))
    return nodes.unionByName(current.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
