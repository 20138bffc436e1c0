"""Triangle counts of an edge stream from a bounded sample of its edges."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .graph import canonical_edges, triangles_global

RESULT = "replica int, seen long, estimate double"


class Reservoir:
    """A sample of at most ``size`` edges and the counters that follow it.

    ``improved``: counters move before sampling by a weight that grows with the stream and never go down.
    ``local``: "paper" credits all three corners of a triangle, "endpoints" only those of the edge that arrives.
    """

    def __init__(self, size: int, improved: bool = False, local: str = "paper", seed: int = 42, weighted_local: bool = False):
        if size < (2 if improved else 3):
            raise ValueError("the sample is too small for the estimate")
        if local not in ("paper", "endpoints"):
            raise ValueError(local)
        self.size, self.improved, self.local, self.weighted_local = size, improved, local, weighted_local
        self.random = random.Random(seed)
        self.edges: list[tuple[int, int]] = []
        self.near: dict[int, set[int]] = {}
        self.seen, self.total, self.by_node = 0, 0.0, {}

    def scale(self) -> float:
        t, m = self.seen, self.size
        return max(1.0, t * (t - 1) * (t - 2) / (m * (m - 1) * (m - 2)))

    def weight(self) -> float:
        t, m = self.seen, self.size
        return max(1.0, (t - 1) * (t - 2) / (m * (m - 1)))

    def _count(self, u: int, v: int, by: float) -> None:
        for c in self.near.get(u, set()) & self.near.get(v, set()):
            self.total += by
            for x in (u, v, c) if self.local == "paper" else (u, v):
                self.by_node[x] = self.by_node.get(x, 0.0) + by

    def _forget(self, at: int) -> tuple[int, int]:
        u, v = self.edges[at]
        self.edges[at] = self.edges[-1]
        self.edges.pop()
        self.near[u].discard(v)
        self.near[v].discard(u)
        return u, v

    def _keep(self, u: int, v: int) -> None:
        if v not in self.near.get(u, ()):
            self.edges.append((u, v))
            self.near.setdefault(u, set()).add(v)
            self.near.setdefault(v, set()).add(u)

    def add(self, u: int, v: int) -> None:
        if u == v:
            return
        self.seen += 1
        if self.improved:
            self._count(u, v, self.weight())
        if len(self.edges) < self.size and self.seen <= self.size:
            taken = True
        else:
            taken = self.random.random() < self.size / self.seen
            if taken and len(self.edges) >= self.size:
                gone = self._forget(self.random.randrange(len(self.edges)))
                if not self.improved:
                    self._count(*gone, -1.0)
        if taken:
            self._keep(u, v)
            if not self.improved:
                self._count(u, v, 1.0)

    def estimate(self) -> float:
        return self.total if self.improved else self.scale() * self.total

    def estimate_local(self, node: int) -> float:
        own = self.by_node.get(node, 0.0)
        return own if self.improved and not self.weighted_local else self.scale() * own


def stream_estimates(edges: DataFrame, size: int, improved: bool = False, replicas: int = 1, seed: int = 42, dedupe: bool = True) -> DataFrame:
    """``replica, seen, estimate`` over ``edges(seq, u, v)`` in order of ``seq``.

    An estimator sees the whole stream in order; independent replicas run side by side, one task
    each, in memory bounded by ``size``: the stream comes in sorted Arrow batches and is never held whole.
    A sample with room for the whole stream without its repeats never loses an edge and weighs each triangle once,
    so all replicas count every triangle; these are counted by joins then, and no task holds the stream.
    """

    def play(batches):
        held: dict[int, Reservoir] = {}
        for pdf in batches:
            for r, u, v in zip(pdf.replica, pdf.u, pdf.v):
                if r not in held:
                    held[r] = Reservoir(size, improved, seed=seed + int(r))
                held[r].add(int(u), int(v))
        yield pd.DataFrame([(r, h.seen, h.estimate()) for r, h in held.items()], columns=["replica", "seen", "estimate"])

    e = canonical_edges(edges.select("seq", "u", "v"), dedupe)
    if dedupe:
        e = settle(e)
        seen = e.count()
        if 0 < seen <= size and size >= 3:
            every = e.sparkSession.range(replicas).select(F.col("id").cast("int").alias("replica"), F.lit(seen).cast("long").alias("seen"))
            return every.crossJoin(triangles_global(e.select("u", "v")).select(F.col("triangles").cast("double").alias("estimate")))  # one row
    copies = e.withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))))
    return copies.repartition("replica").sortWithinPartitions("replica", "seq").mapInPandas(play, RESULT)


def combined(estimates: DataFrame) -> DataFrame:
    """``estimate, std_error``: the replicas' mean."""
    return estimates.agg(F.avg("estimate").alias("estimate"), (F.stddev_samp("estimate") / F.sqrt(F.count("*"))).alias("std_error"))
