"""Embedding near-duplicates by int8 tile products with error bounds.

Vectors of one label are dealt to tiles.  A tile holds each vector as int8
codes with a scale and the exact length of what the codes leave out, so the
product of two tiles of codes bounds every cosine from above; only pairs that may
reach the threshold are computed again in double precision from the vectors
themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, spanning

#: Vectors of a tile; pairs of tiles that one task takes at a time.
TILE = 1024
#: Room for rounding in the bound itself: far above the error of double sums of unit vectors, far below any code step.
SLACK = 1e-9


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes of unit vectors (rows), their scales, lengths of the coded vectors and of the errors."""
    scale = np.abs(unit).max(1) / 127.0
    scale[scale == 0] = 1.0
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    back = codes * scale[:, None]
    return codes, scale, np.sqrt((back * back).sum(1)), np.sqrt(((unit - back) ** 2).sum(1))


def code_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 rows, by single-precision products of at most 1000 dimensions (sums below 2**24)."""
    out = np.zeros((len(a), len(b)))
    for lo in range(0, a.shape[1], 1000):
        out += a[:, lo:lo + 1000].astype(np.float32) @ b[:, lo:lo + 1000].astype(np.float32).T
    return out


def linked_pairs(x: np.ndarray, y: np.ndarray, qx: tuple, qy: tuple, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of two tiles whose cosine in double precision is at least ``threshold``; of one tile, each pair once."""
    (cx, sx, lx, ex), (cy, sy, ly, ey) = qx, qy
    upper = code_product(cx, cy) * (sx[:, None] * sy)
    # |u.v - u'.v'| <= |u'| |v - v'| + |v'| |u - u'| + |u - u'| |v - v'|
    upper += lx[:, None] * ey + ex[:, None] * ly + ex[:, None] * ey + SLACK
    i, j = np.nonzero(upper >= threshold)
    if same:
        i, j = i[i < j], j[i < j]
    keep = np.zeros(len(i), bool)
    for lo in range(0, len(i), 200_000):
        a, b = x[i[lo:lo + 200_000]], y[j[lo:lo + 200_000]]
        cos = np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))
        keep[lo:lo + 200_000] = cos >= threshold
    return i[keep], j[keep]


def near_duplicates(embeddings: DataFrame, threshold: float = 0.93, tile: int = TILE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``embeddings(vec_id, embedding, label)``.

    Linked are rows of equal, not null labels whose cosine in double precision is at least ``threshold``; vectors that are null,
    zero, empty or hold null or non-finite components link with nothing, nor do vectors of different lengths.
    Identical vectors of a label form a class, and classes are compared, not their copies: a class of a
    third of all rows is one vector in one tile.  ``n_links`` counts the other rows linked directly, copies
    included.  A repeated ``vec_id`` counts as several rows with one result each; null ids are
    classes of their own.  Empty tables give no rows; other columns are ignored.
    """
    spark = embeddings.sparkSession
    e = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").alias("label"))
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    e = cut(e.select("vec_id", "label", "v", F.coalesce(good, F.lit(False)).alias("good")))
    classes = cut(e.where("good").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"))
                  .select("label", F.size("v").alias("dim"), "rep", "size", "v", F.xxhash64("label", "v").alias("h")))
    n = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).select(
        F.col("label").alias("l"), F.col("dim").alias("d"), F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    dealt = classes.join(n, (F.col("label") == F.col("l")) & (F.col("dim") == F.col("d"))).select(
        "label", "dim", "tiles", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int").alias("tile"), "rep", "size", "v", "h")

    def one(table):
        label, dim, tiles, t = (table.column(c)[0].as_py() for c in ("label", "dim", "tiles", "tile"))
        v = np.array(table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64)
        return pa.table({"label": pa.array([label], table.column("label").type), "dim": pa.array([dim], pa.int32()), "tiles": pa.array([tiles], pa.int32()),
                         "tile": pa.array([t], pa.int32()), "reps": pa.array([table.column("rep").to_numpy().astype("<i8").tobytes()], pa.binary()),
                         "sizes": pa.array([table.column("size").to_numpy().astype("<i8").tobytes()], pa.binary()),
                         "hashes": pa.array([table.column("h").to_numpy().astype("<i8").tobytes()], pa.binary()),
                         "v": pa.array([v.astype("<f8").tobytes() if not np.array_equal(v.astype("<f4").astype("<f8"), v) else v.astype("<f4").tobytes()], pa.binary())})

    kind = embeddings.schema["label"].dataType.simpleString()
    tiles = cut(dealt.groupBy("label", "dim", "tiles", "tile").applyInArrow(
        one, f"label {kind}, dim int, tiles int, tile int, reps binary, sizes binary, hashes binary, v binary"))
    # Each tile goes to every pair it is part of: (p, q) with p <= q.  A pair is a key of its own, whatever its label's size.
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    pairs = tiles.select("*", other).select("label", "dim", F.least("tile", "other").alias("p"), F.greatest("tile", "other").alias("q"), "tile", "reps", "sizes", "hashes", "v")

    def load(r: dict):
        reps, sizes, dim = np.frombuffer(r["reps"], "<i8"), np.frombuffer(r["sizes"], "<i8"), r["dim"]
        x = np.frombuffer(r["v"], "<f4" if len(r["v"]) == 4 * dim * len(reps) else "<f8").astype(np.float64).reshape(len(reps), dim)
        # Scaled by the largest component first: lengths neither overflow nor vanish.
        x = x / np.abs(x).max(1, keepdims=True)
        return reps, sizes, x, quantise(x / np.sqrt((x * x).sum(1, keepdims=True)))

    def compare(table):
        rows = sorted(table.to_pylist(), key=lambda r: r["tile"])
        ra, na, xa, qa = load(rows[0])
        same = len(rows) == 1
        rb, nb, xb, qb = (ra, na, xa, qa) if same else load(rows[1])
        i, j = linked_pairs(xa, xb, qa, qb, threshold, same)
        hashes = np.concatenate([np.frombuffer(r["hashes"], "<i8") for r in rows])
        links_a, links_b = np.bincount(i, nb[j], len(ra)).astype(np.int64), np.bincount(j, na[i], len(rb)).astype(np.int64)
        ids = np.concatenate([ra, rb]) if not same else ra
        links = np.concatenate([links_a, links_b]) if not same else links_a + links_b
        some = links > 0
        keep = spanning(len(ids), i, j if same else j + len(ra))
        a, b = ra[i[keep]], rb[j[keep]]
        return pa.table({"a": pa.array([*ids[some].tolist(), *a.tolist()], pa.int64()), "h": pa.array([*hashes[some].tolist(), *[0] * len(a)], pa.int64()), "b": pa.array([None] * int(some.sum()) + b.tolist(), pa.int64()),
                         "links": pa.array([*links[some].tolist(), *[0] * len(a)], pa.int64())})

    # Rows with a null b count links of class a; the others are links enough to connect the two tiles' classes.
    met = cut(pairs.groupBy("label", "dim", "p", "q").applyInArrow(compare, "a long, h long, b long, links long"))
    counts = met.where("b is null").groupBy("a", "h").agg(F.sum("links").alias("links")).select(F.col("a").alias("c_id"), F.col("h").alias("c_h"), "links")
    comps = components(met.where("b is not null").select("a", "b")).select(F.col("id").alias("k_id"), "component")
    classes = classes.select("label", "v", "rep", "size", "h")
    about = (classes.join(counts, (F.col("rep") == F.col("c_id")) & (F.col("h") == F.col("c_h")), "left").join(comps, F.col("rep") == F.col("k_id"), "left")
             .select(F.col("label").alias("l"), F.col("v").alias("w"), "rep", "size", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("component")))
    joined = e.join(about, F.col("good") & (F.col("label") == F.col("l")) & (F.col("v") == F.col("w")), "left")
    component = F.coalesce("component", "vec_id")
    return joined.select("vec_id", F.coalesce(F.col("links") + F.col("size") - 1, F.lit(0)).cast("long").alias("n_links"),
                         component.alias("component_id"), (F.col("vec_id").eqNullSafe(component)).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e,
         label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
           AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0 AS good
  FROM embeddings),
g AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS length FROM v WHERE good),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_dot_product(a.e, b.e) / (a.length * b.length) >= 0.93),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT reach.x, l.b FROM reach JOIN l ON l.a = reach.y),
c AS (SELECT x, min(y) AS c FROM reach GROUP BY x),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.c AS component_id, v.vec_id = c.c AS kept
FROM v JOIN c ON c.x = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""
