"""Blocks of whole documents and the search for keys that several documents share.

A block is the documents of one hash range of (id, text), a few MB of text.
Operators on passages find many keys in each text (window minimisers, prefix
shingles), most of which occur in one document only.  ``shared_keys`` finds those that do not:
every block sends each of its keys once, as 32 bits within one of ``n``
buckets (a chance meeting only costs work later on), and gets back the ones that other blocks
or several of its own documents have.  A key that a third of all documents
hold thus is one entry per block, never one per document.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, released

#: Bytes of text in a block, on average.
BLOCK_BYTES = 4_000_000

_HASH32 = np.uint64(32)
_LOW32 = np.uint64(0xFFFFFFFF)


@dataclass
class Blocks:
    """``frame``: doc_id, text, g; its exchange by ``g`` is one that Spark reuses each time it is grouped.

    ``free``: ids of the frame from this one on stand for ids greater by one; see ``text_blocks``.
    """

    frame: DataFrame
    n: int
    free: int | None = None

    def grouped(self):
        return self.frame.groupBy("g")

    def restored(self, df: DataFrame, *columns: str) -> DataFrame:
        """``df`` with the documents' own ids in ``columns``."""
        if self.free is None:
            return df
        return df.select(*[F.when(F.col(c) >= self.free, F.col(c) + 1).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def text_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES, whole_rows: bool = False) -> Blocks:
    """``whole_rows``: the other columns go along, as a struct ``rest``; see ``rows_of``.

    Where a document has the greatest id there is, which stands for null here, ids above the greatest free one move down by one.
    """
    rest = [F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text"], docs["text"].isNull().alias("no_text")).alias("rest")] if whole_rows else []
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *rest)
    total, most = d.agg(F.sum(F.octet_length("text") + 40), F.max("doc_id")).first()
    n, free = int(max(4, -(-(total or 0) // block_bytes))), None
    if most == NULL_ID:
        ids = d.select("doc_id").where("doc_id is not null").distinct()
        below = ids.where(F.col("doc_id") > int(np.iinfo(np.int64).min)).select((F.col("doc_id") - 1).alias("below"))
        free = below.join(ids, F.col("below") == F.col("doc_id"), "left_anti").agg(F.max("below")).first()[0]
        d = d.withColumn("doc_id", F.when(F.col("doc_id") > free, F.col("doc_id") - 1).otherwise(F.col("doc_id")))
    return Blocks(d.select("doc_id", "text", *(["rest"] if whole_rows else []), F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("g")), n, free)


def rows_of(kept: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` from ``kept(text, rest)``."""
    return kept.select(*[(F.when(~F.col("rest.no_text"), F.col("text")) if c == "text" else F.col(f"rest.c{i}")).alias(c) for i, c in enumerate(docs.columns)])


def ids_of(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").combine_chunks().fill_null(int(NULL_ID)).to_numpy()


def texts_of(table: pa.Table) -> list[bytes]:
    return [x.as_buffer().to_pybytes() for c in table.column("text").cast(pa.large_binary()).chunks for x in c]


def pack(a: np.ndarray) -> bytes:
    """Array to zstd bytes."""
    return pa.compress(np.ascontiguousarray(a).tobytes(), codec="zstd", asbytes=True)


def unpack(blob, size: int, dtype) -> np.ndarray:
    """``size``: items."""
    if not size:
        return np.zeros(0, dtype)
    return np.frombuffer(pa.decompress(blob, size * np.dtype(dtype).itemsize, codec="zstd", asbytes=True), dtype)


def bucket_of(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    return ((keys >> _HASH32) % np.uint64(n)).astype(np.int64), (keys & _LOW32).astype(np.uint32)


def _cuts(sorted_values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1]))) if len(sorted_values) else np.zeros(0, np.int64)


def shared_keys(b: Blocks, keys_of: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """``g, bucket, keys``: for each block its keys that several documents have, as sorted uint32 within the bucket.

    ``keys_of(table)`` gives 64-bit keys of a block and the document (row) of each.
    """
    n = b.n

    def send(table):
        keys, rows = keys_of(table)
        ids = ids_of(table)[rows] if len(keys) else np.zeros(0, np.int64)
        bucket, low = bucket_of(keys, n)
        whole = (bucket.astype(np.uint64) << _HASH32) | low
        o = np.argsort(whole, kind="stable")
        whole, ids = whole[o], ids[o]
        at = _cuts(whole)
        least, most = (np.minimum.reduceat(ids, at), np.maximum.reduceat(ids, at)) if len(at) else (ids, ids)
        uniq, many = whole[at], least != most
        of = (uniq >> _HASH32).astype(np.int64)
        starts = _cuts(of)
        ends = np.append(starts[1:], len(uniq))
        g = table.column("g")[0].as_py()
        return pa.table({
            "bucket": pa.array([int(of[s]) for s in starts], pa.int32()), "g": pa.array([g] * len(starts), pa.int32()),
            "one": pa.array([(uniq[s:e][~many[s:e]] & _LOW32).astype(np.uint32).tobytes() for s, e in zip(starts, ends)], pa.binary()),
            "many": pa.array([(uniq[s:e][many[s:e]] & _LOW32).astype(np.uint32).tobytes() for s, e in zip(starts, ends)], pa.binary())})

    def meet(table):
        one = [np.frombuffer(x, np.uint32) for x in table.column("one").to_pylist()]
        many = [np.frombuffer(x, np.uint32) for x in table.column("many").to_pylist()]
        flat = np.sort(np.concatenate(one + many)) if one else np.zeros(0, np.uint32)
        met = np.unique(np.concatenate([flat[1:][flat[1:] == flat[:-1]], *many]))
        gs, out = [], []
        for g, x, y in zip(table.column("g").to_pylist(), one, many):
            mine = np.concatenate([x[in_sorted(x, met)], y])
            if len(mine):
                gs.append(g)
                out.append(np.sort(mine).tobytes())
        return pa.table({"g": pa.array(gs, pa.int32()), "bucket": pa.array([table.column("bucket")[0].as_py()] * len(gs), pa.int32()), "keys": pa.array(out, pa.binary())})

    sent = b.grouped().applyInArrow(released(send), "bucket int, g int, one binary, many binary")
    return sent.groupBy("bucket").applyInArrow(released(meet), "g int, bucket int, keys binary")


def in_sorted(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which of ``x`` occur in the sorted ``table``."""
    if not len(table):
        return np.zeros(len(x), bool)
    k = np.searchsorted(table, x)
    k[k == len(table)] = 0
    return table[k] == x


def known_keys(table: pa.Table) -> np.ndarray:
    """The sorted (bucket << 32 | key) of a block's rows of ``shared_keys``."""
    parts = [(np.uint64(k) << _HASH32) | np.frombuffer(x, np.uint32) for k, x in zip(table.column("bucket").to_pylist(), table.column("keys").to_pylist())]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def is_shared(keys: np.ndarray, known: np.ndarray, n: int) -> np.ndarray:
    bucket, low = bucket_of(keys, n)
    return in_sorted((bucket.astype(np.uint64) << _HASH32) | low, known)
