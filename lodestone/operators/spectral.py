"""Spectral clustering: leading eigenpairs of the normalised affinity, gaps, embedding, Lloyd's k-means.

Graphs of up to ``DENSE`` nodes are solved in one executor task with a dense solver.  Larger
ones by a block Krylov method: the matrix lies on the executors in packed rows, a product is one
job without a shuffle, and the driver holds some 80 numbers for each node, never the edges.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .graph import normalized_affinity, remove_loops

DENSE = 4000


def eigenpairs(affinity: DataFrame, k: int, dense: int = DENSE, rounds: int = 200, tol: float = 1e-8) -> tuple[list[float], DataFrame]:
    """The k algebraically largest eigenvalues, descending, and ``node, vec`` (array<double> of k) of the normalised affinity."""
    matrix = settle(normalized_affinity(affinity))
    nodes = settle(matrix.select(F.col("i").alias("node")).distinct())
    n = nodes.count()
    k = min(k, n)
    if n <= dense:
        return _dense(matrix, k)
    return _krylov(matrix, nodes, k, rounds, tol)


def _dense(matrix: DataFrame, k: int) -> tuple[list[float], DataFrame]:
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, at = np.unique(np.concatenate([pdf.i, pdf.j]), return_inverse=True)
        a = np.zeros((len(ids), len(ids)))
        a[at[:len(pdf)], at[len(pdf):]] = pdf.w
        values, vectors = np.linalg.eigh(a)
        top = np.argsort(-values, kind="stable")[:k]
        return pd.DataFrame({"node": ids, "vec": list(vectors[:, top]), "values": [values[top]] * len(ids)})

    out = settle(matrix.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(solve, "node long, vec array<double>, values array<double>"))
    first = out.select("values").first()
    return (list(first[0]) if first else []), out.select("node", "vec")


def _packed(matrix: DataFrame, ids) -> DataFrame:
    """``row, ends, col, w``: the matrix with nodes by their place in the broadcast ``ids``, a row of arrays for each partition."""

    def pack(batches):
        parts = [[b.column(c).to_numpy() for c in range(3)] for b in batches]
        if not parts:
            return
        i, j, w = (np.concatenate(x) for x in zip(*parts))
        row, col = np.searchsorted(ids.value, i), np.searchsorted(ids.value, j)
        o = np.lexsort((col, row))
        row, col, w = row[o], col[o], w[o]
        first = np.flatnonzero(np.diff(row, prepend=-1))
        arrays = [row[first].astype(np.int32), np.append(first[1:], len(row)), col.astype(np.int32), w]
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in arrays], names=["row", "ends", "col", "w"])

    parts = 2 * matrix.sparkSession.sparkContext.defaultParallelism
    return settle(matrix.select("i", "j", "w").repartition(parts, "i").mapInArrow(pack, "row binary, ends binary, col binary, w binary"))


def _product(packed: DataFrame, x: np.ndarray) -> np.ndarray:
    """A X; each column is summed by rows on the executors."""
    sc = packed.sparkSession.sparkContext
    held = sc.broadcast(np.asfortranarray(x))

    def multiply(batches):
        for b in batches:
            for row, ends, col, w in zip(*(c.to_pylist() for c in b.columns)):
                ends, col, w = np.frombuffer(ends, np.int64), np.frombuffer(col, np.int32), np.frombuffer(w, np.float64)
                starts = np.append(0, ends[:-1])
                out = np.stack([np.add.reduceat(w * held.value[:, c][col], starts) for c in range(held.value.shape[1])])
                yield pa.RecordBatch.from_arrays([pa.array([row], pa.binary()), pa.array([out.tobytes()], pa.binary())], names=["row", "out"])

    y = np.zeros(x.shape)
    for r in packed.mapInArrow(multiply, "row binary, out binary").collect():  # a number for each node and column
        at = np.frombuffer(r["row"], np.int32)
        y[at] = np.frombuffer(r["out"], np.float64).reshape(x.shape[1], len(at)).T
    held.destroy()
    return y


def _new_directions(q: np.ndarray, w: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``w`` adds to that of ``q``."""
    for _ in range(2):
        w = w - q @ (q.T @ w)
        size = np.linalg.norm(w, axis=0)
        w = w[:, size > 1e-13]
        if not w.shape[1]:
            return w
        u, s, _ = np.linalg.svd(w / np.linalg.norm(w, axis=0), full_matrices=False)
        w = u[:, s > 1e-10]
    return w


def _krylov(matrix: DataFrame, nodes: DataFrame, k: int, rounds: int, tol: float, steps: int = 3) -> tuple[list[float], DataFrame]:
    """Rounds of ``steps`` products that widen the space of the best k + 4 vectors, until the k leading values move by less than ``tol``."""
    ids = np.sort(nodes.toArrow().column(0).to_numpy())
    sc, n = matrix.sparkSession.sparkContext, len(ids)
    sent = sc.broadcast(ids)
    packed = _packed(matrix, sent)
    m = min(k + 4, n)
    q = np.linalg.qr(np.random.default_rng(42).standard_normal((n, m)))[0]
    aq, before = _product(packed, q), None
    for _ in range(rounds):
        fresh = aq
        for _ in range(steps):
            w = _new_directions(q, fresh)
            if not w.shape[1] or q.shape[1] >= n:
                break
            fresh = _product(packed, w)
            q, aq = np.hstack([q, w]), np.hstack([aq, fresh])
        gram = q.T @ aq
        values, turn = np.linalg.eigh((gram + gram.T) / 2)
        values, turn = values[::-1][:m], turn[:, ::-1][:, :m]
        q, aq = q @ turn, aq @ turn
        if before is not None and np.abs(values[:k] - before).max() < tol:
            break
        before = values[:k]
    found = sc.broadcast(np.ascontiguousarray(q[:, :k]))

    def named(batches):
        for b in batches:
            rows = found.value[np.searchsorted(sent.value, b.column(0).to_numpy())]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * k, pa.int32()), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["node", "vec"])

    return [float(v) for v in values[:k]], settle(nodes.mapInArrow(named, "node long, vec array<double>"))


def eigen_table(spark, values: list[float]) -> DataFrame:
    return spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(values)], "rank int, eigenvalue double")


def eigengaps(eigen: DataFrame) -> DataFrame:
    """``k, gap``: eigenvalue k less eigenvalue k + 1.  One row per eigenvalue asked for."""
    nxt = F.lead("eigenvalue").over(Window.orderBy("rank"))
    return eigen.select(F.col("rank").alias("k"), (F.col("eigenvalue") - nxt).alias("gap")).where("gap is not null")


def best_k(gaps: DataFrame) -> DataFrame:
    """``best_k``: the position of the largest gap, the first of equal ones."""
    return gaps.agg(F.max_by("k", F.struct(F.col("gap"), -F.col("k"))).alias("best_k"))


def all_equal(eigen: DataFrame) -> DataFrame:
    return eigen.agg((F.max("eigenvalue") == F.min("eigenvalue")).alias("all_equal"))


def row_normalize(vectors: DataFrame) -> DataFrame:
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    return vectors.select("node", "vec", norm.alias("l")).select("node", F.transform("vec", lambda x: x / F.when(F.col("l") == 0, 1.0).otherwise(F.col("l"))).alias("vec"))


def fiedler(vectors: DataFrame) -> DataFrame:
    """``node, value``: the second vector."""
    return vectors.select("node", F.element_at("vec", 2).alias("value"))


def sorted_values(vector: DataFrame) -> DataFrame:
    """``position, value`` ascending, positions from 0; counted by ranges, without a single sorted partition."""
    s = settle(vector.select("value", "node").repartitionByRange("value", "node").sortWithinPartitions("value", "node").withColumn("p", F.spark_partition_id()))
    sizes = s.groupBy("p").agg(F.count("*").alias("n"))
    before = sizes.select("p", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("p").orderBy("value", "node"))
    return s.withColumn("r", rank).join(before, "p").select((F.col("before") + F.col("r") - 1).alias("position"), "value")


def embedding(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """``node, x, y, cluster``: second and third vector."""
    return vectors.select("node", F.element_at("vec", 2).alias("x"), F.element_at("vec", 3).alias("y")).join(labels, "node")


def heat_map(vector: DataFrame, rows: int, cols: int) -> DataFrame:
    """``row, col, value`` of ``node, value``, nodes counted from 0; the size must be rows x cols."""
    if vector.count() != rows * cols:
        raise ValueError("the vector's size is not rows * cols")
    return vector.select(F.floor(F.col("node") / cols).alias("row"), (F.col("node") % cols).alias("col"), "value")


def scaled(vector: DataFrame) -> DataFrame:
    """``node, value`` brought to 0..1; 0 where all are equal."""
    ends = vector.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return vector.crossJoin(F.broadcast(ends)).select("node", F.when(F.col("hi") > F.col("lo"), (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0).alias("value"))  # one row


def lloyd(points: DataFrame, k: int, max_iter: int = 300, tol: float = 1e-4) -> DataFrame:
    """``node, cluster`` of ``points(node, vec)``: k-means from k rows evenly spaced in order of node.

    ``tol`` is relative to the mean variance of the coordinates; a cluster that empties is moved to the point
    farthest from its centre.  Centres (k vectors) are all that comes to the driver.
    """
    p = settle(points)
    n, dim = p.count(), len(p.first()["vec"])
    picks = sorted({int(x) for x in np.linspace(0, n - 1, k)})
    numbered = settle(_numbered(p))
    centres = [r["vec"] for r in numbered.where(F.col("position").isin(picks)).orderBy("position").collect()]
    var = p.agg(*[F.var_pop(F.col("vec")[c]).alias(f"v{c}") for c in range(dim)]).first()
    stop = tol * float(np.mean([v or 0.0 for v in var]))

    def assigned(centres):
        dist = [sum(((F.col("vec")[c] - float(m[c])) ** 2 for c in range(dim)), F.lit(0.0)) for m in centres]
        both = F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(i).alias("c")) for i, d in enumerate(dist)]))
        return p.select("node", "vec", both.alias("b")).select("node", "vec", F.col("b.c").alias("cluster"), F.col("b.d").alias("d"))

    for _ in range(max_iter):
        a = assigned(centres)
        rows = {r["cluster"]: r for r in a.groupBy("cluster").agg(*[F.avg(F.col("vec")[c]).alias(f"m{c}") for c in range(dim)]).collect()}
        empty = [i for i in range(len(centres)) if i not in rows]
        far = [r["vec"] for r in a.orderBy(F.desc("d"), "node").limit(len(empty)).collect()] if empty else []
        moved = [[rows[i][f"m{c}"] for c in range(dim)] if i in rows else far[empty.index(i)] for i in range(len(centres))]
        shift = float(sum((x - y) ** 2 for a_, b_ in zip(centres, moved) for x, y in zip(a_, b_)))
        centres = moved
        if shift <= stop:
            break
    return assigned(centres).select("node", "cluster")


def _numbered(points: DataFrame) -> DataFrame:
    s = settle(points.repartitionByRange("node").sortWithinPartitions("node").withColumn("p", F.spark_partition_id()))
    sizes = s.groupBy("p").agg(F.count("*").alias("n"))
    before = sizes.select("p", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return s.withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy("node"))).join(before, "p").select("node", "vec", (F.col("before") + F.col("r") - 1).alias("position"))


def spectral_clusters(affinity: DataFrame, k: int, dense: int = DENSE) -> DataFrame:
    """``node, cluster``: loops removed, k leading eigenvectors, rows normalised, k-means."""
    _, vectors = eigenpairs(remove_loops(affinity), k, dense)
    return lloyd(row_normalize(vectors), k)


def modularity_sweep(affinity: DataFrame, ks: list[int], dense: int = DENSE) -> list[tuple[int, float]]:
    """(k, modularity) for each k: clustered without loops, scored with them."""
    from .quality import modularity

    return [(k, modularity(affinity, settle(spectral_clusters(affinity, k, dense))).first()[0]) for k in ks]
