"""Shared pieces of the training-data operators: storage, hashing, components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    _LIBC = ctypes.CDLL(None)
except (OSError, TypeError):  # no libc of that kind here
    _LIBC = None

#: Stands for a null document id where ids are compared as integers.
NULL_ID = np.iinfo(np.int64).max


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: ``spark.checkpoint.dir``.  A folder of our own serves local mode only."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def fresh_dir(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: later stages never
    recompute it, and a lost executor takes none of it along."""
    spark = df.sparkSession
    path = fresh_dir(spark, "cut")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the folder of a ``cut`` frame that nothing reads any more."""
    hadoop_path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._cut_at)
    hadoop_path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def qualified(spark: SparkSession, uri: str) -> str:
    """``uri`` with the scheme and host that the cluster's Hadoop configuration gives it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def file_system(uri: str):
    """(pyarrow file system, path) of a qualified URI, or of a local path without a scheme.

    Schemes that pyarrow can't open raise a ``ValueError`` that says so: nothing falls back on an executor's own disk.
    """
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if not re.match(r"[A-Za-z][\w+.-]*:", uri):
        return fs.LocalFileSystem(), uri
    try:
        return fs.FileSystem.from_uri(uri)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError) as e:
        raise ValueError(f"executors can't open {uri!r}: name a folder that pyarrow's file systems know") from e


def drop_shuffles(spark: SparkSession) -> None:
    """Has the driver collect its garbage, by which Spark learns whose shuffle files nobody needs any more."""
    spark._jvm.System.gc()


def release() -> None:
    """Gives a Python worker's freed memory back to the system; workers outlive their tasks and stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_LIBC, "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(f):
    """``f``, a function of one table, two, or a key and two, with ``release`` after each call."""

    def run(args):
        try:
            return f(*args)
        finally:
            release()

    return {1: lambda a: run((a,)), 2: lambda a, b: run((a, b)), 3: lambda key, a, b: run((key, a, b))}[f.__code__.co_argcount]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (columns ``a``, ``b``: long, not null).

    Returns ``(id, component)`` for every id that occurs in an edge, with
    ``component`` the smallest id reachable.  Alternates the large-star and
    small-star steps of Kiveris et al. (2014) on DataFrames; each step keeps the
    edge count linear and halves path lengths, so the number of rounds is
    logarithmic.  Every round is written to the shared folder, and only the
    counters that show convergence come to the driver.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        both = both.unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v"))) if large else e.select(
            F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(
            F.col("u").alias("k"), F.least("u", "m").alias("m"))
        out = both.join(low, both["u"] == low["k"])
        if large:
            out = out.where(F.col("v") > F.col("u")).select(F.col("m").alias("a"), F.col("v").alias("b"))
        else:
            out = out.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(
                low.select(F.col("m").alias("a"), F.col("k").alias("b")))
        return out.where("a <> b").distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.col("a") % 1000003), F.sum(F.xxhash64("a", "b").bitwiseAND((1 << 40) - 1))).first())

    now = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    seen = mark(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        before, now = now, cut(star(star(now, True), False))
        discard(before)
        was, seen = seen, mark(now)
        if was == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
    return roots.unionByName(now.select(F.col("b").alias("id"), F.col("a").alias("component")))


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> list[int]:
    """Positions of links that suffice to connect what all of them connect."""
    root = list(range(n))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    out = []
    for p, (a, b) in enumerate(zip(i.tolist(), j.tolist())):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append(p)
    return out


# -- hashing of byte and word sequences, whole arrays at a time ----------------

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


#: Positions whose powers are kept in a table; those of a later strip are these times one power of its own.
STRIP = 1 << 16
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(base: int) -> np.ndarray:
    steps = np.full(STRIP, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))
_STRIP_UP, _STRIP_DOWN = (np.uint64(pow(_BASE, k, 1 << 64)) for k in (STRIP, -STRIP))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of ``values[s:e]`` for all (s, e), from prefix sums."""
    n = len(values)
    if not len(starts):
        return np.zeros(0, np.uint64)
    total, base = np.zeros(n + 1, np.uint64), np.ones(1, np.uint64)
    for lo in range(0, n, STRIP):
        part = values[lo:lo + STRIP].astype(np.uint64)
        part += np.uint64(1)
        part *= _UP[:len(part)]
        part *= base
        part[:1] += total[lo]
        np.cumsum(part, out=total[lo + 1:lo + 1 + len(part)])
        base *= _STRIP_UP
    strips = np.full(n // STRIP + 1, _STRIP_DOWN, np.uint64)
    strips[0] = 1
    back = np.multiply.accumulate(strips)[starts // STRIP] * _DOWN[starts % STRIP]
    raw = (total[ends] - total[starts]) * back
    return mix64(raw ^ (ends - starts).astype(np.uint64) * _M2)


def words_of(buffer: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of bytes that ``table`` doesn't map to 0."""
    solid = np.concatenate(([False], table[buffer] != 0, [False]))
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    return edge[0::2], edge[1::2]


def space_table(lower: bool = True, spaces: bytes = b"\x20\x09\x0a\x0b\x0c\x0d") -> np.ndarray:
    """Byte map: separators to 0, A-Z to a-z when ``lower``, all else (0 too) to itself + 0."""
    t = np.arange(256, dtype=np.uint16) + 1
    if lower:
        t[65:91] += 32
    t[list(spaces)] = 0
    return t


def gram_hashes(word: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every run of ``n`` consecutive word hashes."""
    m = len(word) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += word[i:i + m]
    return mix64(out)
