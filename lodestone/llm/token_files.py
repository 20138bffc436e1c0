"""Token ids in Arrow IPC files of fixed-size-list batches.

A file holds record batches of two columns, ``tokens`` and ``mask`` (bytes, 1 or 0), both
fixed-size lists of one length: row ``i`` of a file is the ``i``-th sequence of
its token stream, so a memory-mapped reader reaches any sequence and its mask
without copying or scanning.  Masks are dictionary-encoded: a file has two at most, that of whole sequences and that of its last one.  Documents run on from one sequence into the
next; only the last sequence of a file is padded, and its mask says where.  An
index file beside it has each document's id, start and length, and the folder's ``manifest`` has the
accepted files in order with the number of ids before each: files of failed or speculative attempts aren't in it.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_system, fresh_dir, qualified, release
from .pieces import worker_pieces

SEQ_LEN, BATCH_ROWS = 2048, 128
_INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
_FILES = "file string, n_docs long, n_tokens long, before long"
_MANIFEST = "file string, n_docs long, n_tokens long, first_id long"


class _Writer:
    """Writes one file and its index under temporary names, renamed when whole."""

    def __init__(self, out_dir: str, dtype: np.dtype, seq_len: int):
        self.fs, self.dir = file_system(out_dir)
        self.fs.create_dir(self.dir, recursive=True)
        self.name, self.seq, self.dtype = uuid.uuid4().hex, seq_len, dtype
        self.schema = pa.schema([("tokens", pa.list_(pa.from_numpy_dtype(dtype), seq_len)), ("mask", pa.dictionary(pa.int8(), pa.list_(pa.uint8(), seq_len)))])
        self.sink = self.fs.open_output_stream(f"{self.dir}/.{self.name}.tokens")
        self.file = pa.ipc.new_file(self.sink, self.schema, options=pa.ipc.IpcWriteOptions(emit_dictionary_deltas=True))
        self.masks = np.ones((1, seq_len), np.uint8)
        self.index_sink = self.fs.open_output_stream(f"{self.dir}/.{self.name}.index")
        self.index = pa.ipc.new_file(self.index_sink, _INDEX)
        self.wait: list[bytes] = []
        self.waiting, self.total, self.rows = 0, 0, []
        self.first, self.n_docs = None, 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // self.dtype.itemsize
        if not self.n_docs:
            self.first = doc_id
        self.n_docs += 1
        self.rows.append((doc_id, self.total, n))
        self.total += n
        self.wait.append(ids)
        self.waiting += n
        if self.waiting >= self.seq * BATCH_ROWS:
            self.flush(False)
        if len(self.rows) >= 20_000:
            self.flush_index()

    def flush(self, end: bool) -> None:
        flat = np.frombuffer(b"".join(self.wait), self.dtype)
        step = self.seq * BATCH_ROWS
        real = len(flat) if end else len(flat) // step * step  # all batches but the last have BATCH_ROWS rows
        pad = -len(flat) % self.seq if end else 0
        use = np.concatenate([flat[:real], np.zeros(pad, self.dtype)])
        for i in range(0, len(use), step):
            which = np.zeros(len(use[i:i + step]) // self.seq, np.int8)
            if pad and i + step >= len(use):
                which[-1] = 1
                self.masks = np.stack([self.masks[0], np.arange(self.seq) < self.seq - pad]).astype(np.uint8)
            masks = pa.FixedSizeListArray.from_arrays(pa.array(self.masks.ravel()), self.seq)
            self.file.write_batch(pa.RecordBatch.from_arrays([
                pa.FixedSizeListArray.from_arrays(pa.array(use[i:i + step]), self.seq),
                pa.DictionaryArray.from_arrays(pa.array(which), masks)], schema=self.schema))
        rest = flat[real:]
        self.wait, self.waiting = [rest.tobytes()], len(rest)

    def flush_index(self) -> None:
        if self.rows:
            self.index.write_batch(pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in zip(*self.rows)], schema=_INDEX))
        self.rows = []

    def close(self) -> dict:
        self.flush(True)
        self.flush_index()
        for x in (self.file, self.sink, self.index, self.index_sink):
            x.close()
        for kind in ("index", "tokens"):
            self.fs.move(f"{self.dir}/.{self.name}.{kind}", f"{self.dir}/{self.name}.{kind}")
        return {"file": self.name, "n_docs": self.n_docs, "n_tokens": self.total, "first_id": self.first}


def write_token_files(docs: DataFrame, tokenizer: str, out_dir: str | None = None, end_id: int | None = 1, seq_len: int = SEQ_LEN) -> tuple[str, list]:
    """Encodes ``docs(doc_id, text)`` and writes the files, in ascending ``doc_id`` order.

    Returns the folder and one manifest row per file, in that order, each with
    the number of ids before it.  ``end_id`` follows each document.  A null text
    counts as empty, null ids come first, rows of the same id stay together
    in the order of their texts.  The rows are dealt by ranges of ``doc_id`` as text, which is
    smaller than its ids.  Each attempt of a task writes names of its own, and only the
    attempt that Spark accepts is in the manifest.
    """
    spark = docs.sparkSession
    out_dir = qualified(spark, out_dir) if out_dir else fresh_dir(spark, "token-files")

    def write(batches):
        w = None
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                if w is None:
                    p = worker_pieces(tokenizer, ids=True)
                    w = _Writer(out_dir, p.dtype, seq_len)
                    tail = b"" if end_id is None else np.array([end_id], p.dtype).tobytes()
                w.add(doc_id, p.encode(text.as_py() or "") + tail)
        if w is not None:
            p.reset()
            release()
            yield pa.RecordBatch.from_pylist([w.close()], schema=pa.schema([
                ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("first_id", pa.int64())]))

    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
            .mapInArrow(write, _MANIFEST).collect())  # one row per file
    rows.sort(key=lambda r: (r["first_id"] is not None, r["first_id"] or 0))
    before, manifest = 0, []
    for r in rows:
        manifest.append((r["file"], r["n_docs"], r["n_tokens"], before))
        before += r["n_tokens"]
    spark.createDataFrame(manifest, _FILES).coalesce(1).write.parquet(f"{out_dir}/manifest")
    return out_dir, manifest


def open_tokens(out_dir: str, name: str):
    """A reader of a token file; memory-mapped where the folder is local."""
    fs, path = file_system(out_dir)
    local = fs.type_name == "local"
    return pa.ipc.open_file(pa.memory_map(f"{path}/{name}.tokens") if local else fs.open_input_file(f"{path}/{name}.tokens"))


def sequence(out_dir: str, name: str, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence ``i`` of a file and its mask; both are views of the mapped file."""
    batch = open_tokens(out_dir, name).get_batch(i // BATCH_ROWS)
    tokens, mask = batch.column(0), batch.column(1)
    n, at = tokens.type.list_size, i % BATCH_ROWS
    which = int(mask.indices.to_numpy()[at])
    return tokens.flatten().to_numpy()[at * n:(at + 1) * n], mask.dictionary.flatten().to_numpy()[which * n:(which + 1) * n]


def _read(out_dir: str, name: str, before: int):
    fs, path = file_system(out_dir)
    with fs.open_input_file(f"{path}/{name}.index") as src:
        index = pa.ipc.open_file(src).read_all()
    ids = index.column("doc_id").to_pylist()
    starts, sizes = index.column("start").to_numpy(), index.column("n_tokens").to_numpy()
    crcs, at, low, k = [0] * len(ids), 0, 0, 0
    reader = open_tokens(out_dir, name)
    for i in range(reader.num_record_batches):
        flat = reader.get_batch(i).column(0).flatten().to_numpy()
        words = memoryview(flat.astype("<u4")).cast("B")
        high = low + len(flat)
        while k < len(ids) and starts[k] < high:
            a, b = max(int(starts[k]), low), min(int(starts[k] + sizes[k]), high)
            crcs[k] = zlib.crc32(words[4 * (a - low):4 * (b - low)], crcs[k])
            if starts[k] + sizes[k] > high:
                break
            k += 1
        low = high
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array(ids, pa.int64()), "start": pa.array(starts + before, pa.int64()),
        "n_tokens": pa.array(sizes, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())})


def read_token_files(spark, out_dir: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files that the manifest names."""

    def read(batches):
        for b in batches:
            for r in b.to_pylist():
                yield _read(out_dir, r["file"], r["before"])
        release()

    files = spark.read.schema(_FILES).parquet(f"{out_dir}/manifest")
    return files.repartition(max(1, files.count()), "file").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, out_dir: str | None = None, end_id: int = 1, seq_len: int = SEQ_LEN) -> DataFrame:
    """Writes ``docs`` and reads the files back; see the two functions above."""
    return read_token_files(docs.sparkSession, write_token_files(docs, tokenizer, out_dir, end_id, seq_len)[0])
