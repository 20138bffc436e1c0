"""Balanced k-way partitioning by colour swaps with simulated annealing.

``nodes(id, color, init_color)`` and ``arcs(i, j)`` with both directions of each edge.
Two runners: ``swap_sequential`` follows a seeded run node by node in one task, for traces; ``swap_rounds``
does a round as joins over all nodes at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle


@dataclass(frozen=True)
class PartitionConfig:
    # The defaults of a run.
    rounds: int = 1000
    partitions: int = 4
    uniform_sample: int = 6
    temperature: float = 2.0
    delta: float = 0.003
    seed: int = 0
    alpha: float = 2.0
    neighbour_sample: int = 3
    initial: str = "ROUND_ROBIN"
    policy: str = "HYBRID"
    annealing: str = "linear"

    def __post_init__(self):
        if self.initial not in ("ROUND_ROBIN", "BATCH", "RANDOM") or self.policy not in ("LOCAL", "RANDOM", "HYBRID") or self.annealing not in ("linear", "exponential"):
            raise ValueError("unknown initial colouring, policy or annealing")


class JavaRandom:
    """java.util.Random's published generator: 48-bit linear congruential."""

    def __init__(self, seed: int):
        self.state = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1)

    def bits(self, n: int) -> int:
        self.state = (self.state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        return self.state >> (48 - n)

    def below(self, bound: int) -> int:
        if bound & (bound - 1) == 0:
            return (bound * self.bits(31)) >> 31
        while True:
            r = self.bits(31)
            v = r % bound
            if r - v + bound - 1 < 1 << 31:
                return v


def initial_color(node: Column, n: int, k: int, policy: str = "ROUND_ROBIN", seed: int = 0) -> Column:
    """Colours 0..k-1: id mod k, k equal ranges of ids, or random by seed."""
    if policy == "ROUND_ROBIN":
        return (node % k).cast("int")
    if policy == "BATCH":
        return (F.ceil(node * k / F.lit(float(n))) - 1).cast("int")
    if policy == "RANDOM":
        return F.pmod(F.xxhash64(node, F.lit(seed)), F.lit(k)).cast("int")
    raise ValueError(policy)


def color_distribution(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("color").agg(F.count("*").alias("n"))


def edge_cut(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """``edge_cut``: arcs between colours, halved."""
    a = nodes.select(F.col("id").alias("i"), F.col("color").alias("ci"))
    b = nodes.select(F.col("id").alias("j"), F.col("color").alias("cj"))
    return arcs.join(a, "i").join(b, "j").agg(F.floor(F.sum(F.when(F.col("ci") != F.col("cj"), 1).otherwise(0)) / 2).alias("edge_cut"))


def migrations(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.sum(F.when(F.col("color") != F.col("init_color"), 1).otherwise(0)).alias("migrations"))


def color_degrees(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """``id, color, degree``: neighbours by colour, where there are any."""
    return arcs.join(nodes.select(F.col("id").alias("j"), "color"), "j").groupBy(F.col("i").alias("id"), "color").agg(F.count("*").alias("degree"))


def swap_scores(nodes: DataFrame, arcs: DataFrame, pairs: DataFrame, temperature: float = 1.0, alpha: float = 2.0) -> DataFrame:
    """``p, q, old, new, benefit`` of ``pairs(p, q)``: what the two nodes' like-coloured neighbours are worth before and after."""
    d = color_degrees(nodes, arcs)
    out = pairs.join(nodes.select(F.col("id").alias("p"), F.col("color").alias("cp")), "p").join(nodes.select(F.col("id").alias("q"), F.col("color").alias("cq")), "q")
    for node, color, name in (("p", "cp", "pp"), ("q", "cq", "qq"), ("p", "cq", "pq"), ("q", "cp", "qp")):
        out = out.join(d.select(F.col("id").alias(node), F.col("color").alias(color), F.col("degree").alias(name)), [node, color], "left")
    power = lambda c: F.pow(F.coalesce(c, F.lit(0)).cast("double"), F.lit(alpha))
    old, new = power(F.col("pp")) + power(F.col("qq")), power(F.col("pq")) + power(F.col("qp"))
    return out.select("p", "q", "cp", "cq", old.alias("old"), new.alias("new"), (new * temperature - old).alias("benefit"))


def cool(temperature: float, at_floor: int, config: PartitionConfig) -> tuple[float, int]:
    """Temperature after a round; linear to 1, or by a factor to 1e-4 and back to 2 after 400 rounds there."""
    if config.annealing == "linear":
        return max(1.0, temperature - float(np.float32(config.delta))), 0
    temperature = max(1e-4, temperature * float(np.float32(config.delta)))
    if temperature == 1e-4:
        at_floor += 1
        if at_floor >= 400:
            return 2.0, 0
    return temperature, at_floor


class _Run:
    """A seeded run.  Each node keeps the number of its neighbours by colour, so a swap is scored by four look-ups."""

    def __init__(self, adjacency: dict[int, list[int]], config: PartitionConfig):
        self.c, self.adj, self.ids = config, adjacency, sorted(adjacency)
        self.random = JavaRandom(config.seed)
        n, k = len(self.ids), config.partitions
        start = {"ROUND_ROBIN": lambda i: i % k, "BATCH": lambda i: -(-i * k // n) - 1, "RANDOM": lambda i: self.random.below(k)}[config.initial]
        self.color = {i: start(i) for i in self.ids}
        self.first = dict(self.color)
        self.near = {i: [0] * k for i in self.ids}
        for i, around in adjacency.items():
            for j in around:
                self.near[i][self.color[j]] += 1
        self.temperature, self.at_floor, self.swaps = config.temperature, 0, 0

    def draw(self, pool: list[int], count: int, but: int | None) -> list[int]:
        """Distinct members of the pool; fewer where it has no more to give."""
        count = min(count, len(set(pool) - {but}))
        out: list[int] = []
        while len(out) < count:
            x = pool[self.random.below(len(pool))]
            if x != but and x not in out:
                out.append(x)
        return out

    def partner(self, p: int, offered: list[int]) -> int | None:
        best, found = 0.0, None
        cp, a = self.color[p], self.c.alpha
        for q in offered:
            cq = self.color[q]
            old = float(self.near[p][cp]) ** a + float(self.near[q][cq]) ** a
            new = float(self.near[p][cq]) ** a + float(self.near[q][cp]) ** a
            if self.c.annealing == "linear":
                gain = new * self.temperature - old
            else:
                gain = float(np.exp(min(700.0, (new - old) / self.temperature)))
                if gain <= self.random.bits(26) / (1 << 26):
                    continue
            if gain > best:
                best, found = gain, q
        return found

    def swap(self, p: int, q: int) -> None:
        cp, cq = self.color[p], self.color[q]
        self.swaps += 1
        if cp == cq:
            return
        for node, was, now in ((p, cp, cq), (q, cq, cp)):
            self.color[node] = now
            for j in self.adj[node]:
                self.near[j][was] -= 1
                self.near[j][now] += 1

    def rounds(self) -> Iterator[tuple[int, int, int, int]]:
        for r in range(self.c.rounds):
            for p in self.ids:
                q = None
                if self.c.policy != "RANDOM":
                    around = self.adj[p]
                    q = self.partner(p, around if len(around) <= self.c.neighbour_sample else self.draw(around, self.c.neighbour_sample, None))
                if q is None and self.c.policy != "LOCAL":
                    q = self.partner(p, self.draw(self.ids, self.c.uniform_sample, p))
                if q is not None:
                    self.swap(p, q)
            self.temperature, self.at_floor = cool(self.temperature, self.at_floor, self.c)
            cut = sum(len(around) - self.near[i][self.color[i]] for i, around in self.adj.items()) // 2
            yield r, cut, self.swaps, sum(self.color[i] != self.first[i] for i in self.ids)


def swap_sequential(graph: DataFrame, config: PartitionConfig) -> DataFrame:
    """``round, edge_cut, swaps, migrations`` of ``graph(id, neighbours)``: every node in turn, in place, one generator.

    Each swap depends on the one before, so a run is one task; several configurations run in parallel
    when ``graph`` has a column ``run`` that numbers copies.
    """

    def play(pdf: pd.DataFrame) -> pd.DataFrame:
        run = _Run({int(i): [int(x) for x in a] for i, a in zip(pdf.id, pdf.neighbours)}, config)
        return pd.DataFrame(list(run.rounds()), columns=["round", "edge_cut", "swaps", "migrations"])

    one = graph if "run" in graph.columns else graph.withColumn("run", F.lit(0))
    return one.groupBy("run").applyInPandas(play, "round int, edge_cut long, swaps long, migrations long")


def swap_rounds(nodes: DataFrame, arcs: DataFrame, config: PartitionConfig, rounds: int | None = None) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """(nodes, [(round, edge cut, swaps)]): rounds over all nodes at once.

    Every node is offered a few neighbours and a few nodes at random, takes the offer of most benefit, and
    pairs that are each other's best, by benefit and then by hash, swap.  Colours are only exchanged, so their histogram stays.
    """
    ids = settle(nodes.select("id"))
    n = ids.count()
    numbered = settle(_numbered(ids))
    now, temperature, at_floor, report = settle(nodes), config.temperature, 0, []
    for r in range(config.rounds if rounds is None else rounds):
        offers = None
        if config.policy != "RANDOM":
            pick = F.slice(F.array_sort(F.collect_list(F.struct(F.xxhash64("i", "j", F.lit(r), F.lit(config.seed)).alias("h"), F.col("j").alias("q")))), 1, config.neighbour_sample)
            offers = arcs.groupBy(F.col("i").alias("p")).agg(pick.alias("s")).select("p", F.explode("s.q").alias("q"))
        if config.policy != "LOCAL":
            at = F.explode(F.transform(F.sequence(F.lit(1), F.lit(config.uniform_sample)), lambda x: F.pmod(F.xxhash64(F.col("id"), x, F.lit(r), F.lit(config.seed)), F.lit(n))))
            drawn = ids.select(F.col("id").alias("p"), at.alias("position")).join(numbered.select(F.col("id").alias("q"), "position"), "position").select("p", "q")
            offers = drawn if offers is None else offers.unionByName(drawn)
        scores = swap_scores(now, arcs, offers.where("p <> q").distinct(), temperature, config.alpha).where((F.col("cp") != F.col("cq")) & (F.col("benefit") > 0))
        tie = F.xxhash64(F.least("p", "q"), F.greatest("p", "q"))
        scores = settle(scores.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), F.struct(F.col("benefit"), tie.alias("tie")).alias("rank")).distinct())
        best = scores.select("rank", F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.max("rank").alias("top"))
        chosen = scores.join(best.select(F.col("id").alias("a"), F.col("top").alias("ta")), "a").join(best.select(F.col("id").alias("b"), F.col("top").alias("tb")), "b")
        chosen = settle(chosen.where((F.col("rank") == F.col("ta")) & (F.col("rank") == F.col("tb"))).select("a", "b"))
        partner = chosen.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(chosen.select(F.col("b").alias("id"), F.col("a").alias("other")))
        theirs = partner.join(now.select(F.col("id").alias("other"), F.col("color").alias("new")), "other").select("id", "new")
        now = settle(now.join(theirs, "id", "left").select("id", F.coalesce("new", "color").alias("color"), "init_color"))
        temperature, at_floor = cool(temperature, at_floor, config)
        report.append((r, edge_cut(now, arcs).first()[0], chosen.count()))
    return now, report


def _numbered(ids: DataFrame) -> DataFrame:
    """``id, position``: dense positions from 0, by hash buckets."""
    from pyspark.sql import Window

    b = ids.select("id", F.pmod(F.xxhash64("id"), F.lit(4096)).alias("b"))
    size = b.groupBy("b").agg(F.count("*").alias("m"))
    before = size.select("b", F.coalesce(F.sum("m").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return b.withColumn("k", F.row_number().over(Window.partitionBy("b").orderBy("id"))).join(before, "b").select("id", (F.col("before") + F.col("k") - 1).alias("position"))
