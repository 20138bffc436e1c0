"""Token counts of whole texts by a map-side two-tier lookup."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release
from .pieces import Pieces, worker_pieces

#: Entries of the broadcast table, rows that may be looked at to fill it, and characters of each.
TABLE, SAMPLE_ROWS, SAMPLE_CHARS = 32_768, 2_000, 4_000


def frequent_lengths(docs: DataFrame, tokenizer: str, table: int = TABLE, sample_rows: int = SAMPLE_ROWS) -> dict[str, int]:
    """Token counts of at most ``table`` frequent pieces.

    The rows looked at (at most ``sample_rows``, each as far as ``SAMPLE_CHARS``) only decide which lookups are fast;
    a piece that is not in the table is encoded by the worker that meets it.
    """

    some = docs.select(F.substring(F.coalesce("text", F.lit("")), 1, SAMPLE_CHARS)).limit(sample_rows).collect()  # reads as few partitions as it needs
    p, seen = Pieces(tokenizer), Counter()
    if p.form == "other":
        return {}
    for r in some:
        if r[0].isascii():
            seen.update(p.pieces(r[0]))
    return {w: p.value(w) for w, n in seen.most_common(table) if n > 1}


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, table: int = TABLE) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs(doc_id, text)``.

    A null text counts as empty (0 bytes, 0 tokens); a null ``doc_id`` stays
    null; repeated rows give repeated results; other columns are ignored and
    an empty table gives an empty result.  No pre-token leaves its worker:
    tier one is the broadcast table of ``table`` entries, tier two a bounded
    cache in each worker filled by the library's own model.
    """
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(frequent_lengths(docs, tokenizer, table))

    def count(batches):
        p = worker_pieces(tokenizer, known.value)
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            n_tokens, n_bytes = [], []
            for t in texts:
                t = t.as_py() or ""
                n_tokens.append(p.count(t))
                n_bytes.append(len(t.encode()))
            yield pa.RecordBatch.from_pydict({
                "doc_id": ids, "n_bytes": pa.array(n_bytes, pa.int64()), "n_tokens": pa.array(n_tokens, pa.int64()),
                "over_limit": pa.array([n > limit for n in n_tokens], pa.bool_())})
        p.reset()
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
