"""Mixing sources to target weights with hash-threshold histograms.

DataFrame functions only: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Hex digits of a document's hash that each of the nested histograms looks at, and how many histograms there are.
DIGITS, LEVELS = 3, 3


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` runs of a text; 0 for null."""
    t = F.coalesce(text, F.lit(""))
    # Runs, counted as the starts that follow a separator: every run of separators becomes one line end.
    parts = F.split(F.regexp_replace(t, "^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$", ""), "[\\x20\\x09-\\x0D]+")
    return F.when(F.regexp_like(t, F.lit("[^\\x20\\x09-\\x0D]")), F.size(parts)).otherwise(0).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, source_size, target`` from ``sizes(source, size)``.

    Sources in code-point order, null last, take ``weights`` in turn and share
    ``share`` times all sizes; a target stops at ``most`` times its source's
    size and what is over goes to the others by weight, until none is above.
    The end of that reshaping is the level L at which the sum of
    min(most * size, L * weight) is the budget, found from running sums over
    sources in the order in which they reach their limits.  One row per source.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = s.select("source", "source_size", w.alias("w"), (F.col("source_size") * F.lit(float(most))).alias("top"))
    up = Window.orderBy(F.col("top") / F.col("w"), F.col("source").asc_nulls_last())
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.select("*", F.coalesce(F.sum("top").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("full"),
                 F.sum("w").over(up.rowsBetween(0, Window.unboundedFollowing)).alias("open"),
                 (F.sum("source_size").over(every) * F.lit(float(share))).alias("budget"))
    level = (F.col("budget") - F.col("full")) / F.col("open")
    s = s.select("source", "source_size", "w", "top", F.when(level <= F.col("top") / F.col("w"), level).alias("level"))
    # The first source in that order that the level doesn't fill sets it, and later ones would set it lower; with none, every source is at its limit.
    s = s.select("*", F.max("level").over(every).alias("at"))
    return s.select("source", "source_size", F.when(F.col("at").isNull(), F.col("top")).otherwise(
        F.least("top", F.col("at") * F.col("w"))).alias("target"))


def document_hash(doc_id: Column) -> Column:
    return F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null"))), 1, DIGITS * LEVELS)


def _plan(docs: DataFrame, weights: tuple[int, ...], share: float, most: float) -> tuple[DataFrame, DataFrame]:
    """``doc_id, source, size`` of every row, and one row per source with its target and its threshold.

    A source whose target is k times its size and r words more takes each
    document k times and, once more, those whose hash lies below a threshold.
    Threshold search: words summed by source and leading hash digits, a
    running sum that finds the bucket which holds r, then the same inside that
    bucket alone, ``LEVELS`` times.  The last bucket, by then at most the rows
    of a few ids, goes in if that brings the source nearer to its target.
    Nothing is sorted but histograms of at most 16**DIGITS buckets a source.
    """
    d = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                        word_count(F.col("text").cast("string")).alias("size")))
    targets = cut(source_targets(d, weights, share, most))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    limits = targets.select("source", "source_size", "target", whole.alias("k")).select(
        "*", (F.col("target") - F.col("k") * F.col("source_size")).alias("rest"), F.lit("").alias("edge"), F.lit(0.0).alias("before"))
    hashed = d.select("source", "size", document_hash(F.col("doc_id")).alias("h"))
    for level in range(LEVELS):
        limits = _refine(hashed, limits, DIGITS * (level + 1))
    # ``edge`` is now the whole hash of the boundary bucket, ``before`` the words below it, ``held`` the words in it.
    nearer = F.abs(F.col("before") + F.col("held") - F.col("rest")) < F.abs(F.col("before") - F.col("rest"))
    cuts = limits.select(F.col("source").alias("_mix_source"), F.col("source_size").cast("long").alias("_mix_source_size"), F.col("target").alias("_mix_target"),
                         F.col("k").alias("_mix_k"), F.col("edge").alias("_mix_edge"), nearer.alias("_mix_closed"))
    return d, cut(cuts)  # written, so that its size is known when it is joined


def _taken_times(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """``rows`` with the cuts' columns and ``_mix_times``: how often each row is taken."""
    h = document_hash(F.col("doc_id").cast("long"))
    once = F.col("_mix_edge").isNotNull() & ((h < F.col("_mix_edge")) | (F.col("_mix_closed") & (h == F.col("_mix_edge"))))
    return rows.join(cuts, F.col("source").cast("string").eqNullSafe(F.col("_mix_source"))).withColumn(
        "_mix_times", (F.col("_mix_k") + F.when(once, 1).otherwise(0)).cast("int"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs(doc_id, text, source)``.

    Null text: size 0.  A null source is a source (the last); null ids share a
    hash; rows with one id are taken together, so repeated rows stay
    deterministic; an empty table gives no rows; other columns are ignored.
    """
    d, cuts = _plan(docs, weights, share, most)
    return _taken_times(d, cuts).select("doc_id", "size", F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"),
                                        (F.col("_mix_times") * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mix itself: the rows of ``docs``, all columns, each as often as it is taken."""
    cuts = _plan(docs, weights, share, most)[1]
    rows = _taken_times(docs, cuts)
    return rows.withColumn("_mix_copy", F.explode(F.array_repeat(F.lit(1), F.col("_mix_times")))).select(*[rows[c] for c in docs.columns])


def _refine(hashed: DataFrame, limits: DataFrame, digits: int) -> DataFrame:
    """The boundary bucket of each source, ``digits`` digits long, inside the one found before."""
    known = limits.drop("held").select(F.col("source").alias("s"), *[c for c in limits.columns if c not in ("source", "held")])
    inside = hashed.join(known.select("s", "edge"), F.col("source").eqNullSafe(F.col("s")) & F.col("h").startswith(F.col("edge")))
    sums = inside.groupBy("source", F.substring("h", 1, digits).alias("b")).agg(F.sum("size").cast("double").alias("held"))
    run = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "b", "held", F.coalesce(F.sum("held").over(run), F.lit(0.0)).alias("below"))
    at = sums.join(known, F.col("source").eqNullSafe(F.col("s")))
    hit = at.where((F.col("before") + F.col("below") <= F.col("rest")) & (F.col("before") + F.col("below") + F.col("held") > F.col("rest")))
    hit = hit.select(F.col("s").alias("hs"), F.col("b").alias("hb"), (F.col("before") + F.col("below")).alias("hbefore"), F.col("held"))
    # A source without such a bucket takes nothing once more: its rest is 0 (or its documents are empty).
    out = known.join(hit, F.col("s").eqNullSafe(F.col("hs")), "left")
    return out.select(F.col("s").alias("source"), "source_size", "target", "k", "rest", F.col("hb").alias("edge"),
                      F.coalesce("hbefore", F.lit(0.0)).alias("before"), F.coalesce("held", F.lit(0.0)).alias("held"))


#: The same for DuckDB over ``documents``.
ORACLE = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 9) AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w,
             source_size * 2.0::DOUBLE AS top FROM s),
f AS (SELECT *, coalesce(sum(top) OVER (ORDER BY top / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS filled,
             sum(w) OVER (ORDER BY top / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS open,
             (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget FROM w),
l AS (SELECT *, CASE WHEN (budget - filled) / open <= top / w THEN (budget - filled) / open END AS level FROM f),
t AS (SELECT source, source_size, least(top, coalesce(max(level) OVER () * w, top))::DOUBLE AS target FROM l),
k AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS k FROM t),
r AS (SELECT *, target - k * source_size AS rest FROM k),
g AS (SELECT source, h, sum(size)::DOUBLE AS held FROM d GROUP BY source, h),
c AS (SELECT *, coalesce(sum(held) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g),
e AS (SELECT r.source, c.h AS edge, abs(below + held - rest) < abs(below - rest) AS closed
      FROM r JOIN c ON r.source IS NOT DISTINCT FROM c.source WHERE below <= rest AND below + held > rest)
SELECT d.doc_id, d.size, r.source_size, r.target,
       ((r.k + CASE WHEN e.edge IS NOT NULL AND (d.h < e.edge OR (e.closed AND d.h = e.edge)) THEN 1 ELSE 0 END) * d.size)::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""
