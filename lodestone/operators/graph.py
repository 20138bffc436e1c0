"""Edges, degrees, triangles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_edges(edges: DataFrame, dedupe: bool = True) -> DataFrame:
    """``u <= v`` of ``edges(u, v)`` without self-loops and, unless ``dedupe`` is off, without repeats."""
    out = edges.where(F.col("u") != F.col("v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), *[c for c in edges.columns if c not in ("u", "v")])
    if not dedupe:
        return out
    rest = [F.min(c).alias(c) for c in out.columns if c not in ("u", "v")]
    return out.groupBy("u", "v").agg(*rest) if rest else out.distinct()


def consecutive_pairs(rows: DataFrame, order: str, node: str) -> DataFrame:
    """``seq, u, v``: the nodes of rows that follow each other, ``order`` counting up by one; a hash join, no global sort."""
    a = rows.select((F.col(order) + 1).alias("seq"), F.col(node).alias("u"))
    return a.join(rows.select(F.col(order).alias("seq"), F.col(node).alias("v")), "seq")


def arcs(edges: DataFrame) -> DataFrame:
    """``i, j``: both directions of each edge."""
    return edges.select(F.col("u").alias("i"), F.col("v").alias("j")).unionByName(edges.select(F.col("v").alias("i"), F.col("u").alias("j")))


def degrees(edges: DataFrame) -> DataFrame:
    """``node, degree``."""
    return edges.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def top_degree_subgraph(edges: DataFrame, n: int) -> DataFrame:
    """Edges with both ends among the n nodes of highest degree (ties: smaller id)."""
    top = degrees(edges).orderBy(F.desc("degree"), "node").limit(n).select("node")
    return edges.join(top.select(F.col("node").alias("u")), "u", "left_semi").join(top.select(F.col("node").alias("v")), "v", "left_semi").select("u", "v")


def triangles(edges: DataFrame, order: str | None = None) -> DataFrame:
    """``x, y, z``, each triangle once, of canonical ``edges``.

    Edges point from the end of lower degree to that of higher degree, so no node has more than
    sqrt(2 E) edges out and hubs don't blow up the wedges.  With ``order``, a column of the edges, ``third`` in addition:
    which of x, y, z (0, 1, 2) the triangle's last edge leaves out; wedges carry no more than the later of their two values and which it is.
    """
    d = degrees(edges)
    e = edges.join(d.select(F.col("node").alias("u"), F.col("degree").alias("du")), "u").join(d.select(F.col("node").alias("v"), F.col("degree").alias("dv")), "v")
    up = (F.col("du") < F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("u") < F.col("v")))
    o = e.select(F.when(up, F.col("u")).otherwise(F.col("v")).alias("x"), F.when(up, F.col("v")).otherwise(F.col("u")).alias("y"),
                 F.when(up, F.col("dv")).otherwise(F.col("du")).alias("dy"), *([F.col(order).alias("c")] if order else []))
    w = o.alias("p").join(o.alias("q"), F.col("p.x") == F.col("q.x"))
    w = w.where((F.col("p.dy") < F.col("q.dy")) | ((F.col("p.dy") == F.col("q.dy")) & (F.col("p.y") < F.col("q.y"))))
    # Edges of one value come in order of their ends, so the last is the same whichever way a triangle is found.
    y_last = later(F.col("p.c"), F.col("p.x"), F.col("p.y"), F.col("q.c"), F.col("q.x"), F.col("q.y"))
    w = w.select(F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.col("q.y").alias("z"), *([F.greatest("p.c", "q.c").alias("c"), y_last.alias("y_last")] if order else []))
    closed = w.join(o.select(F.col("x").alias("y"), F.col("y").alias("z"), *([F.col("c").alias("c_yz")] if order else [])), ["y", "z"])
    if not order:
        return closed.select("x", "y", "z")
    end = F.when(F.col("y_last"), F.col("y")).otherwise(F.col("z"))
    third = F.when(later("c_yz", "y", "z", "c", "x", end), 0).when(F.col("y_last"), 2).otherwise(1)
    return closed.select("x", "y", "z", third.alias("third"))


def later(c, a, b, d, e, f) -> Column:
    """Whether edge a-b of value c comes after edge e-f of value d: by value, then by its ends."""
    c, d = (F.col(v) if isinstance(v, str) else v for v in (c, d))
    return (c > d) | ((c == d) & (F.struct(F.least(a, b), F.greatest(a, b)) > F.struct(F.least(e, f), F.greatest(e, f))))


def triangles_global(edges: DataFrame) -> DataFrame:
    return triangles(edges).agg(F.count("*").alias("triangles"))


def triangles_local(edges: DataFrame) -> DataFrame:
    """``node, triangles`` of every node: the triangles it is part of."""
    t = triangles(edges).select(F.explode(F.array("x", "y", "z")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))
    return degrees(edges).select("node").join(t, "node", "left").select("node", F.coalesce("triangles", F.lit(0)).alias("triangles"))


def triangles_local_endpoints(edges: DataFrame) -> DataFrame:
    """``node, triangles``: each triangle credited to the two ends of its edge of highest ``seq``, not to its third node."""
    t = triangles(edges, order="seq")
    corners = F.when(F.col("third") == 0, F.array("y", "z")).when(F.col("third") == 1, F.array("x", "z")).otherwise(F.array("x", "y"))
    ends = t.select(F.explode(corners).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))
    return degrees(edges).select("node").join(ends, "node", "left").select("node", F.coalesce("triangles", F.lit(0)).alias("triangles"))


def common_neighbours(edges: DataFrame) -> DataFrame:
    """``u, v, common`` of every edge: the neighbours that both ends have."""
    t = triangles(edges)
    sides = t.select(F.explode(F.array(F.struct(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")), F.struct(F.least("x", "z").alias("u"), F.greatest("x", "z").alias("v")),
                                       F.struct(F.least("y", "z").alias("u"), F.greatest("y", "z").alias("v")))).alias("s"))
    c = sides.groupBy("s.u", "s.v").agg(F.count("*").alias("common"))
    return edges.select("u", "v").join(c, ["u", "v"], "left").select("u", "v", F.coalesce("common", F.lit(0)).alias("common"))


def symmetric_affinity(edges: DataFrame, weight: Column | None = None) -> DataFrame:
    """``i, j, w`` of ``edges(src, dst)`` as given: repeats summed, then the larger of the two directions in both."""
    one = edges.groupBy(F.col("src").alias("i"), F.col("dst").alias("j")).agg(F.sum(F.lit(1.0) if weight is None else weight).alias("w"))
    both = one.unionByName(one.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    return both.groupBy("i", "j").agg(F.max("w").alias("w"))


def remove_loops(affinity: DataFrame) -> DataFrame:
    return affinity.where(F.col("i") != F.col("j"))


def affinity_degrees(affinity: DataFrame) -> DataFrame:
    return affinity.groupBy(F.col("i").alias("node")).agg(F.sum("w").alias("degree"))


def normalized_affinity(affinity: DataFrame) -> DataFrame:
    """``i, j, w / sqrt(d_i d_j)``, a degree of 0 counting as 1."""
    d = affinity_degrees(affinity).select("node", (1 / F.sqrt(F.when(F.col("degree") == 0, 1.0).otherwise(F.col("degree")))).alias("s"))
    return affinity.join(d.select(F.col("node").alias("i"), F.col("s").alias("si")), "i").join(d.select(F.col("node").alias("j"), F.col("s").alias("sj")), "j").select(
        "i", "j", (F.col("w") * F.col("si") * F.col("sj")).alias("w"))
