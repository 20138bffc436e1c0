"""Quality of a clustering: cut and inner edges, expansion, conductance, modularity, triangle participation.

``affinity(i, j, w)`` holds both directions of each edge; ``labels(node, cluster)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import triangles


def labelled_arcs(affinity: DataFrame, labels: DataFrame) -> DataFrame:
    a = labels.select(F.col("node").alias("i"), F.col("cluster").alias("ci"))
    b = labels.select(F.col("node").alias("j"), F.col("cluster").alias("cj"))
    return affinity.join(a, "i").join(b, "j").select("i", "j", "w", "ci", "cj")


def edge_counts(affinity: DataFrame, labels: DataFrame) -> DataFrame:
    """``cluster, intra, inter``: inner edges counted once, edges that leave counted for each cluster they leave."""
    e = labelled_arcs(affinity, labels)
    n = e.groupBy(F.col("ci").alias("cluster")).agg(
        F.sum(F.when((F.col("ci") == F.col("cj")) & (F.col("j") > F.col("i")), 1).otherwise(0)).alias("intra"),
        F.sum(F.when(F.col("ci") != F.col("cj"), 1).otherwise(0)).alias("inter"))
    every = labels.select("cluster").distinct()
    return every.join(n, "cluster", "left").select("cluster", F.coalesce("intra", F.lit(0)).alias("intra"), F.coalesce("inter", F.lit(0)).alias("inter"))


def totals(affinity: DataFrame, labels: DataFrame) -> DataFrame:
    """One row ``total_intra, total_inter, intra_normalized, inter_normalized``: each edge once; the latter over half the stored entries."""
    e = labelled_arcs(affinity, labels)
    s = e.agg(F.sum(F.when((F.col("ci") == F.col("cj")) & (F.col("j") > F.col("i")), 1).otherwise(0)).alias("total_intra"),
              F.sum(F.when((F.col("ci") != F.col("cj")) & (F.col("j") > F.col("i")), 1).otherwise(0)).alias("total_inter"),
              F.floor(F.count("*") / 2).alias("half"))
    share = lambda c: F.when(F.col("half") > 0, F.col(c) / F.col("half")).otherwise(0.0)
    return s.select("total_intra", "total_inter", share("total_intra").alias("intra_normalized"), share("total_inter").alias("inter_normalized"))


def expansion(affinity: DataFrame, labels: DataFrame) -> DataFrame:
    """``cluster, expansion``: inter / intra; infinite where only edges out are, 0.0 where none are."""
    x = F.when(F.col("intra") > 0, F.col("inter") / F.col("intra")).when(F.col("inter") > 0, F.lit(float("inf"))).otherwise(0.0)
    return edge_counts(affinity, labels).select("cluster", x.alias("expansion"))


def conductance(affinity: DataFrame, labels: DataFrame) -> DataFrame:
    """``cluster, conductance``: inter / (inter + intra), 0.0 for none."""
    n = F.col("inter") + F.col("intra")
    return edge_counts(affinity, labels).select("cluster", F.when(n > 0, F.col("inter") / n).otherwise(0.0).alias("conductance"))


def finite_average(metric: DataFrame, column: str) -> DataFrame:
    return metric.agg(F.avg(F.when(~F.col(column).isin(float("inf"), float("-inf")) & ~F.isnan(column), F.col(column))).alias(f"avg_{column}"))


def modularity(affinity: DataFrame, labels: DataFrame) -> DataFrame:
    """``modularity``: the sum over clusters of in / 2m - (vol / 2m)**2; 0.0 without edges.  Sums per cluster, no n x n matrix."""
    e = labelled_arcs(affinity, labels)
    per = e.groupBy("ci").agg(F.sum(F.when(F.col("ci") == F.col("cj"), F.col("w")).otherwise(0.0)).alias("inner"), F.sum("w").alias("vol"))
    s = per.agg(F.sum("inner").alias("inner"), F.sum(F.col("vol") * F.col("vol")).alias("squares"), F.sum("vol").alias("m2"))
    return s.select(F.when(F.coalesce("m2", F.lit(0.0)) > 0, F.col("inner") / F.col("m2") - F.col("squares") / (F.col("m2") * F.col("m2"))).otherwise(0.0).alias("modularity"))


def triangle_participation(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``cluster, participation``: the share of its nodes that are in a triangle inside the cluster; ``edges`` canonical (u, v)."""
    a = labels.select(F.col("node").alias("u"), F.col("cluster").alias("cu"))
    b = labels.select(F.col("node").alias("v"), F.col("cluster").alias("cv"))
    inner = edges.join(a, "u").join(b, "v").where(F.col("cu") == F.col("cv")).select("u", "v")
    nodes = triangles(inner).select(F.explode(F.array("x", "y", "z")).alias("node")).distinct().withColumn("hit", F.lit(1))
    return labels.join(nodes, "node", "left").groupBy("cluster").agg((F.count("hit") / F.count("*")).alias("participation"))
