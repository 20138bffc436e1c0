"""Toxicity scores by nearest labelled examples.

A bounded sample of labelled rows gives the examples.  Examples and documents are TF-IDF vectors over every term,
word or word beginning, that two examples have at least; a term's weight grows with what it tells of the
classes, and none is left out.  The nearest examples by exact cosine come from an inverted index in
blocks of examples: postings of rare terms are added up as they are, and those of frequent terms are kept a block at a time with the
block's largest weight, so that a block whose bound lies below a document's k-th best similarity is skipped.  Votes
are weighted by the fourth power of the similarity and calibrated on the examples, each left out in turn.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, release
from .decontaminate import slices

#: At most so many examples of each class, neighbours that vote, and examples that a term must occur in.
PER_CLASS, NEIGHBOURS, LEAST = 2000, 15, 2
#: Examples in an index block; terms whose postings are kept by block; blocks between two looks at the k-th best; rows scored in one go.
BLOCK, FREQUENT, AHEAD, ROWS = 64, 1536, 16, 256
#: Text whose terms are counted in one go; lengths of word beginnings; entries of a worker's word table.
BYTES = 1_000_000
STEMS, WORDS = (4, 5, 6), 150_000
#: Postings of a row added up in one go.
POSTINGS = 600_000
#: Neighbours that a row shows; parts that the examples are read in.
EVIDENCE, PARTS = 5, 32
#: Weight of the base rate among the votes; a term's weight where it tells nothing, and the share of explained variance from which it is 1.
PRIOR, FLOOR, TELLING = 0.25, 0.1, 0.06

_WORD = re.compile(r"[^\W\d_]+")
#: The characters of Latin-1 that words are made of; a space for each other.
_LETTERS = bytes(c if _WORD.match(chr(c)) else 32 for c in range(256))


def words_of(text: str | None) -> list[str]:
    """``_WORD`` found in the lower-cased text, faster where that is Latin-1."""
    text = (text or "").lower()
    try:
        return text.encode("latin-1").translate(_LETTERS).decode("latin-1").split()
    except UnicodeEncodeError:
        return _WORD.findall(text)


def terms_of(word: str) -> list[str]:
    return [word, *[word[:n] + "*" for n in STEMS if len(word) > n]]


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null"))) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[DataFrame, dict[int, int]]:
    """``doc_id, toxic, text`` of at most ``per_class`` rows of each class, and the classes' sizes.

    Taken are the rows of the smallest id hashes, so reruns agree.  Labels of held-out
    rows are not read; an id labelled more than once counts with its largest label; an id with several rows gives one.
    """
    y = (labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
         .groupBy(F.col("doc_id").cast("long").alias("lab_id")).agg(F.max("toxic").cast("int").alias("toxic")))
    sizes = {r[0]: r[1] for r in y.groupBy("toxic").count().collect()}  # two rows at most
    picks = [y.where(F.col("toxic") == c).orderBy(F.xxhash64("lab_id"), "lab_id").limit(per_class) for c in (0, 1)]
    chosen = F.broadcast(picks[0].unionByName(picks[1]))  # 2 * per_class rows at most
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = d.join(chosen, d["doc_id"] == chosen["lab_id"]).groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return cut(rows.repartition(PARTS, "doc_id")), sizes


@dataclass
class Sparse:
    """Vectors of rows: row ``i`` has ``value[at[i]:at[i + 1]]`` at the features ``term[at[i]:at[i + 1]]``, ascending, and length 1 (or none)."""

    at: np.ndarray
    term: np.ndarray
    value: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))

    def part(self, lo: int, hi: int) -> Sparse:
        return Sparse(self.at[lo:hi + 1] - self.at[lo], self.term[self.at[lo]:self.at[hi]], self.value[self.at[lo]:self.at[hi]])

    def take(self, order: np.ndarray) -> Sparse:
        n = np.diff(self.at)[order]
        i = np.repeat(self.at[order], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return Sparse(np.concatenate(([0], np.cumsum(n))), self.term[i], self.value[i])


class Terms:
    """Counts the known terms of texts; a worker's table of words is bounded."""

    def __init__(self, names: list[str]):
        self.size = max(len(names), 1)
        self.known = {t: i for i, t in enumerate(names) if not t.endswith("*")}
        self.stems = [(n, {t[:-1]: i for i, t in enumerate(names) if len(t) == n + 1 and t.endswith("*")}) for n in STEMS]
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, int] = {}
        self.terms = np.zeros((0, 1 + len(STEMS)), np.int32)  # of a word itself and of its beginnings; -1: not known

    def learn(self, new: list[str]) -> None:
        """Looks up the terms of words, all in one go: most words of a text are rare ones."""
        long, of = np.fromiter(map(len, new), np.int64, len(new)), np.empty((len(new), 1 + len(STEMS)), np.int32)
        of[:, 0] = np.fromiter(map(self.known.get, new, repeat(-1)), np.int32, len(new))
        for c, (n, stems) in enumerate(self.stems, 1):
            of[:, c] = np.where(long > n, np.fromiter(map(stems.get, [w[:n] for w in new], repeat(-1)), np.int32, len(new)), -1)
        self.words.update(zip(new, range(len(self.words), len(self.words) + len(new))))
        self.terms = np.concatenate([self.terms, of])

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, count), ascending, of the terms that occur."""
        if len(self.words) >= WORDS:
            self.forget()
        found = [words_of(text) for text in texts]
        self.learn(list(set().union(*found).difference(self.words)))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        of = self.terms[np.fromiter(map(self.words.__getitem__, chain.from_iterable(found)), np.int64, sizes.sum())]
        key, times = np.unique((np.repeat(np.arange(len(texts)) * self.size, sizes)[:, None] + of)[of >= 0], return_counts=True)
        return key // self.size, key % self.size, times


@dataclass
class Model:
    """Plain arrays: bounded by the sample, and sent to workers as they are."""

    names: list[str]
    weights: np.ndarray  # of terms: idf and what they tell of the classes
    ids: np.ndarray
    y: np.ndarray
    weight: np.ndarray  # of examples: rows of the class that one stands for
    vectors: Sparse
    prior: float
    steps: np.ndarray  # raw scores and what they mean, from the calibration
    levels: np.ndarray

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "index"}

    def vectorised(self, n: int, row: np.ndarray, term: np.ndarray, count: np.ndarray) -> Sparse:
        v = (1 + np.log(count)) * self.weights[term] if len(term) else np.zeros(0)
        length = np.sqrt(np.bincount(row, v * v, n)) if len(row) else np.zeros(n)
        at = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n)))) if n else np.zeros(1, np.int64)
        return Sparse(at, term.astype(np.int32), (v / length[row] if len(row) else v).astype(np.float32))

    @cached_property
    def index(self) -> dict:
        """Postings of rare terms; of frequent ones a row each in every block and a row of block maxima."""
        n, m = -(-len(self.ids) // BLOCK) * BLOCK, len(self.names)
        x, df = self.vectors, np.bincount(self.vectors.term, minlength=m)
        frequent = np.sort(np.argsort(-df, kind="stable")[:FREQUENT])
        place = np.full(m, -1)
        place[frequent] = np.arange(len(frequent))
        often = place[x.term] >= 0
        dense = np.zeros((n // BLOCK, len(frequent), BLOCK), np.float32)
        dense[x.rows[often] // BLOCK, place[x.term[often]], x.rows[often] % BLOCK] = x.value[often]
        o = np.argsort(x.term[~often], kind="stable")
        begin = np.searchsorted(x.term[~often][o], np.arange(m + 1))
        return {"n": n, "place": place, "dense": dense, "top": dense.max(2).T, "begin": begin,
                "example": x.rows[~often][o], "value": x.value[~often][o]}

    def nearest(self, q: Sparse, k: int = NEIGHBOURS, leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Indices and similarities (five decimals) of the k nearest examples of each row, exactly; -1 and 0 where
        fewer share a term.  Ties go to the smaller index.  ``leave``: an example to leave out, per row."""
        m = len(q.at) - 1
        if not m or not len(self.ids):
            return np.full((m, k), -1), np.zeros((m, k))
        parts = [self._nearest(q.part(lo, min(lo + ROWS, m)), k, None if leave is None else leave[lo:lo + ROWS]) for lo in range(0, m, ROWS)]
        return np.concatenate([i for i, _ in parts]), np.concatenate([s for _, s in parts])

    def _rare(self, q: Sparse) -> np.ndarray:
        """What rare terms give each row with each example.  Postings are added up a row at a time, which
        takes less time than those of many rows at once."""
        x = self.index
        sims, rare = np.zeros((len(q.at) - 1, x["n"]), np.float32), x["place"][q.term] < 0
        at, term, value = np.concatenate(([0], np.cumsum(rare)))[q.at], q.term[rare], q.value[rare]
        begin, size = x["begin"][term], x["begin"][term + 1] - x["begin"][term]
        end = np.cumsum(size)
        for r, (lo, last) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
            while lo < last:
                hi = min(last, max(lo + 1, int(np.searchsorted(end, end[lo] - size[lo] + POSTINGS, "right"))))
                some = size[lo:hi]
                i = np.repeat(begin[lo:hi] - (np.cumsum(some) - some), some)
                i += np.arange(len(i))
                w = x["value"].take(i)
                w *= np.repeat(value[lo:hi], some)
                sims[r] += np.bincount(x["example"].take(i), w, x["n"])
                lo = hi
        return sims

    def _nearest(self, q: Sparse, k: int, leave: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        m, x = len(q.at) - 1, self.index
        n, row = x["n"], q.rows
        often = x["place"][q.term] >= 0
        head = np.zeros((m, x["dense"].shape[1]), np.float32)
        head[row[often], x["place"][q.term[often]]] = q.value[often]
        sims = self._rare(q)
        if leave is not None:
            sims[np.arange(m), leave] = -9
        bound = sims.reshape(m, n // BLOCK, BLOCK).max(2) + head @ x["top"] + 1e-5
        order, done = np.argsort(-bound.max(0), kind="stable"), np.full((m, n), -1, np.float32)
        best = np.full((m, k), -1, np.float32)  # the k best so far, the least of them first
        for lo in range(0, len(order), AHEAD):
            ahead = order[lo:lo + AHEAD]
            for b in ahead:
                rows, at = np.flatnonzero(bound[:, b] >= best[:, 0]), slice(b * BLOCK, (b + 1) * BLOCK)
                if len(rows):
                    done[rows, at] = sims[rows, at] + head[rows] @ x["dense"][b]
            seen = done.reshape(m, n // BLOCK, BLOCK)[:, ahead].reshape(m, -1)
            best = np.partition(np.concatenate([best, seen], 1), seen.shape[1], 1)[:, seen.shape[1]:]
        # Similarity and place in one number, so that ties are settled by place; only of those that round to the k-th best or more.
        row, at = np.nonzero(done >= np.maximum(best[:, :1] - 2e-5, 4e-6))
        key = np.rint(done[row, at] * 1e5).astype(np.int64) * n + (n - 1 - at)
        o = np.lexsort((-key, row))
        row, key = row[o], key[o]
        place = np.arange(len(row)) - np.searchsorted(row, np.arange(m))[row]
        keep = (place < k) & (key >= n)
        idx, near = np.full((m, k), -1), np.zeros((m, k))
        idx[row[keep], place[keep]], near[row[keep], place[keep]] = n - 1 - key[keep] % n, key[keep] // n / 1e5
        return idx, near

    def raw(self, idx: np.ndarray, sims: np.ndarray) -> np.ndarray:
        if not len(self.ids):
            return np.full(len(idx), self.prior)
        w = np.where(idx >= 0, sims**4 * self.weight[idx], 0)
        return ((w * self.y[idx]).sum(1) + PRIOR * self.prior) / (w.sum(1) + PRIOR)

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(raw, self.steps, self.levels), 0, 1) if len(self.steps) else np.clip(raw, 0, 1)

    def scored(self, terms: Terms, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(neighbours, similarities, scores)."""
        idx, sims = self.nearest(self.vectorised(len(texts), *terms.counts(texts)))
        return idx, sims, self.calibrated(self.raw(idx, sims))


def _monotone(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling neighbours that fall; one step per pool."""
    o = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # mean, weight, first x, last x
    at = 0
    x, y, w = x[o], y[o], w[o]
    while at < len(x):
        end = np.searchsorted(x, x[at], "right")
        pools.append([np.average(y[at:end], weights=w[at:end]), w[at:end].sum(), x[at], x[at]])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            pools.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2], b[3]])
        at = end
    xs, ys = [], []
    for mean, _, first, last in pools:
        xs += [first] if first == last else [first, last]
        ys += [mean] * (1 if first == last else 2)
    return np.array(xs), np.array(ys)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Trains on a bounded sample; see ``sample``.  Without examples every score is 0."""
    rows, sizes = sample(docs, labels, per_class)

    def each(batches):
        for b in batches:
            out = []
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out += [(f, y) for f in {f for w in set(_WORD.findall(t.lower())) for f in terms_of(w)}]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int32())], names=["f", "y"])

    c = rows.select("text", "toxic").mapInArrow(each, "f string, y int").groupBy("f").agg(
        F.count("*").cast("double").alias("df"), F.sum("y").cast("double").alias("a")).where(F.col("df") >= LEAST).orderBy("f").toArrow()
    held = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    n0, n1 = held.get(0, 0), held.get(1, 0)
    df, a = c.column("df").to_numpy(), c.column("a").to_numpy()
    told = (a * (n0 - df + a) - (df - a) * (n1 - a)) ** 2 / np.maximum(df * (n0 + n1 - df) * n0 * n1, 1e-9)  # chi-squared by rows: the variance explained
    weights = (np.log((1 + n0 + n1) / (1 + df)) + 1) * (FLOOR + np.minimum(told, TELLING) / TELLING)
    names, prior, empty = c.column("f").to_pylist(), sizes.get(1, 0) / max(1, sum(sizes.values())), np.zeros(0)
    shared = rows.sparkSession.sparkContext.broadcast(names)

    def vectors(batches):
        terms = Terms(shared.value)
        for part in slices(batches, 2, BYTES):
            row, term, count = terms.counts(part.column(2).to_pylist())
            at = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (term, count)]],
                                             names=["doc_id", "toxic", "term", "n"])
        release()

    # 2 * per_class rows at most, as numbers: texts stay on the executors.
    got = rows.select("doc_id", "toxic", "text").mapInArrow(vectors, "doc_id long, toxic int, term array<int>, n array<int>").orderBy("toxic", "doc_id").toArrow().combine_chunks()
    ids, y = got.column("doc_id").to_numpy().astype(np.int64), got.column("toxic").to_numpy().astype(np.int64)
    model = Model(names, weights, ids, y, np.where(y == 1, sizes.get(1, 0) / max(1, n1), sizes.get(0, 0) / max(1, n0)), Sparse(np.zeros(1, np.int64), y[:0], empty), prior, empty, empty)
    if not len(ids):
        return model
    term, n = (np.concatenate([c.values.to_numpy()[c.offsets[0].as_py():c.offsets[-1].as_py()] for c in got.column(x).chunks]) for x in ("term", "n"))
    row = np.repeat(np.arange(len(ids)), np.concatenate([np.diff(c.offsets.to_numpy()) for c in got.column("n").chunks]))
    q = model.vectorised(len(ids), row, term, n)
    # Examples whose weightiest term is the same stand together, which keeps the blocks' maxima low.
    main = np.full(len(ids), -1)
    o = np.lexsort((q.value, q.rows))
    main[q.rows[o]] = q.term[o]
    o = np.lexsort((ids, main, y))
    model = Model(names, weights, ids[o], y[o], model.weight[o], q.take(o), prior, empty, empty)
    idx, sims = model.nearest(model.vectors, leave=np.arange(len(ids)))
    model.steps, model.levels = _monotone(model.raw(idx, sims), model.y.astype(float), model.weight)
    del model.index  # workers make their own
    shared.destroy()
    release()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted, evidence`` for every row of ``docs(doc_id, text)``.

    ``evidence``: the nearest examples' ids, labels and similarities.  A null or
    empty text has no features and gets the rate that such examples have; repeated rows and null
    ids are scored like any other; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        terms = Terms(m.names)
        for part in slices(batches, 1, BYTES):
            idx, sims, s = m.scored(terms, part.column(1).to_pylist())
            near = np.where(idx[:, :EVIDENCE] >= 0)
            at = np.concatenate(([0], np.cumsum(np.bincount(near[0], minlength=part.num_rows))))
            found = idx[near]
            evidence = pa.StructArray.from_arrays([pa.array(m.ids[found], pa.int64()), pa.array(m.y[found].astype(np.int32)), pa.array(sims[near])], ["doc_id", "toxic", "similarity"])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), evidence)],
                names=["doc_id", "held_out", "score", "predicted", "evidence"])
        release()

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int, evidence array<struct<doc_id:long,toxic:int,similarity:double>>")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))


def without_toxic(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``limit`` or more; all columns kept, nothing shuffled."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def keep(batches):
        m = shared.value
        terms = Terms(m.names)
        for part in slices(batches, at, BYTES):
            yield part.filter(pa.array(m.scored(terms, part.column(at).to_pylist())[2] < limit))
        release()

    return docs.mapInArrow(keep, docs.schema)
