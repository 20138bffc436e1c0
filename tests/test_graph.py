import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph, partition, quality, reservoir, spectral

RING = [(0, 1), (0, 4), (0, 5), (1, 2), (2, 3), (3, 4), (4, 5)]


def edges(spark, pairs):
    return spark.createDataFrame([(i, u, v) for i, (u, v) in enumerate(pairs)], "seq long, u long, v long")


def some_graph(seed, n=30, m=110):
    r = random.Random(seed)
    out = []
    while len(out) < m:
        u, v = r.randrange(n), r.randrange(n)
        if u != v and (min(u, v), max(u, v)) not in out:
            out.append((min(u, v), max(u, v)))
    return out


def test_triangles(spark):
    pairs = some_graph(1)
    have = set(pairs)
    tri = [t for t in itertools.combinations(range(30), 3) if all(p in have for p in itertools.combinations(t, 2))]
    e = graph.canonical_edges(edges(spark, pairs + [(v, u) for u, v in pairs[:20]] + [(3, 3)]))
    assert graph.triangles_global(e.select("u", "v")).first()[0] == len(tri)
    local = {r["node"]: r["triangles"] for r in graph.triangles_local(e.select("u", "v")).collect()}
    assert all(local[x] == sum(x in t for t in tri) for x in local)
    at = {p: i for i, p in enumerate(pairs)}
    ends = {}
    for t in tri:
        for x in max(itertools.combinations(t, 2), key=at.get):
            ends[x] = ends.get(x, 0) + 1
    got = {r["node"]: r["triangles"] for r in graph.triangles_local_endpoints(e).collect()}
    assert {k: v for k, v in got.items() if v} == ends
    common = {(r["u"], r["v"]): r["common"] for r in graph.common_neighbours(e.select("u", "v")).collect()}
    assert all(common[p] == sum(set(p) <= set(t) for t in tri) for p in pairs)


@pytest.mark.parametrize("improved", [False, True])
def test_reservoir(spark, improved):
    pairs = some_graph(2)
    exact = graph.triangles_global(graph.canonical_edges(edges(spark, pairs)).select("u", "v")).first()[0]
    whole = reservoir.stream_estimates(edges(spark, pairs), len(pairs), improved).first()
    assert whole["estimate"] == exact and whole["seen"] == len(pairs)
    est = reservoir.combined(reservoir.stream_estimates(edges(spark, pairs), 60, improved, replicas=60)).first()
    assert abs(est["estimate"] - exact) <= 4 * est["std_error"] + 1e-9
    with pytest.raises(ValueError):
        reservoir.Reservoir(1, improved)


def test_endpoints_and_paper_credit():
    for local, want in (("paper", {0: 1, 1: 1, 2: 1}), ("endpoints", {0: 1, 2: 1})):
        r = reservoir.Reservoir(10, local=local)
        for e in ((0, 1), (1, 2), (0, 2)):
            r.add(*e)
        assert {k: r.estimate_local(k) for k in want} == want and r.estimate() == 1


def test_streaming(spark, tmp_path):
    from lodestone.streaming import triangles as T

    pairs = some_graph(3)
    exact = graph.triangles_global(graph.canonical_edges(edges(spark, pairs)).select("u", "v")).first()[0]
    edges(spark, pairs).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = T.streaming_estimates(T.stream_edge_files(spark, str(tmp_path / "in")), len(pairs))
    q = out.writeStream.outputMode("update").format("memory").queryName("estimates").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("estimates").orderBy(F.desc("seen")).first()["estimate"] == exact


def affinity(spark, pairs):
    return graph.symmetric_affinity(spark.createDataFrame(pairs, "src long, dst long"))


def test_spectrum(spark):
    values, vectors = spectral.eigenpairs(affinity(spark, RING), 6)
    assert values == pytest.approx([1.0, 0.535849, 0.274292, -0.376585, -0.607625, -0.825930], abs=1e-6)
    gaps = spectral.eigengaps(spectral.eigen_table(spark, values))
    assert [r["gap"] for r in gaps.orderBy("k").collect()] == pytest.approx([0.464151, 0.261557, 0.650877, 0.231040, 0.218305], abs=1e-6)
    assert spectral.best_k(gaps).first()[0] == 3
    labels = spark.createDataFrame(list(enumerate([0, 1, 1, 1, 0, 0])), "node long, cluster int")
    assert quality.modularity(affinity(spark, RING), labels).first()[0] == pytest.approx(0.204081632653)
    order = [r["value"] for r in spectral.sorted_values(spectral.fiedler(vectors)).orderBy("position").collect()]
    assert order == sorted(order) and len(order) == 6


def test_subspace_agrees_with_dense(spark):
    pairs = [(a + 12 * c, b + 12 * c) for c in range(3) for a, b in itertools.combinations(range(12), 2) if (a * b + c) % 3] + [(0, 12), (12, 24)]
    a = affinity(spark, pairs)
    dense, _ = spectral.eigenpairs(a, 2)
    iterated, _ = spectral.eigenpairs(a, 2, dense=0, rounds=6, tol=1e-5)
    assert iterated == pytest.approx(dense, abs=1e-3)


def test_clusters(spark):
    pairs = [(a + 8 * c, b + 8 * c) for c in range(3) for a, b in itertools.combinations(range(8), 2)] + [(0, 8), (8, 16)]
    got = {r["node"]: r["cluster"] for r in spectral.spectral_clusters(affinity(spark, pairs), 3).collect()}
    assert len({got[0], got[8], got[16]}) == 3 and all(got[n] == got[n // 8 * 8] for n in got)


def test_quality(spark):
    pairs = some_graph(5)
    labels = spark.createDataFrame([(i, i % 3) for i in range(30)], "node long, cluster int")
    a = affinity(spark, pairs)
    for c, intra, inter in quality.edge_counts(a, labels).select("cluster", "intra", "inter").collect():
        assert intra == sum(u % 3 == v % 3 == c for u, v in pairs) and inter == sum((u % 3 == c) != (v % 3 == c) for u, v in pairs)
    lone = spark.createDataFrame([(1, 2)], "src long, dst long")
    apart = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "node long, cluster int")
    assert {r[0]: r[1] for r in quality.expansion(graph.symmetric_affinity(lone), apart).collect()} == {0: math.inf, 1: math.inf, 2: 0.0}
    none = graph.symmetric_affinity(spark.createDataFrame([], "src long, dst long"))
    assert quality.modularity(none, apart).first()[0] == 0.0


def adjacency(pairs):
    near = {}
    for u, v in pairs:
        near.setdefault(u, []).append(v)
        near.setdefault(v, []).append(u)
    return {k: sorted(v) for k, v in near.items()}


def test_java_random():
    r = partition.JavaRandom(0)
    assert [r.below(100) for _ in range(5)] == [60, 48, 29, 47, 15]


def test_partition_rounds(spark):
    near = adjacency(some_graph(6, 40, 120))
    nodes = spark.createDataFrame([(i, i % 4, i % 4) for i in near], "id long, color int, init_color int")
    arcs = spark.createDataFrame([(i, j) for i in near for j in near[i]], "i long, j long")
    before = partition.edge_cut(nodes, arcs).first()[0]
    after, report = partition.swap_rounds(nodes, arcs, partition.PartitionConfig(temperature=1.0), rounds=2)
    count = lambda n: {r["color"]: r["n"] for r in partition.color_distribution(n).collect()}
    assert count(after) == count(nodes) and report[-1][1] <= before


@pytest.mark.parametrize("policy", ["LOCAL", "RANDOM", "HYBRID"])
def test_partition_sequential(spark, policy):
    near = adjacency(some_graph(7, 40, 120))
    g = spark.createDataFrame(list(near.items()), "id long, neighbours array<bigint>")
    config = partition.PartitionConfig(rounds=4, policy=policy)
    rows = partition.swap_sequential(g, config).orderBy("round").collect()
    assert [r["round"] for r in rows] == [0, 1, 2, 3] and rows[-1]["edge_cut"] <= rows[0]["edge_cut"] + 20
    run = partition._Run(near, config)
    list(run.rounds())
    assert sorted(run.color.values()) == sorted(run.first.values())
    for i, around in near.items():
        assert run.near[i] == [sum(run.color[j] == c for j in around) for c in range(4)]


def test_cooling():
    c = partition.PartitionConfig(annealing="exponential", delta=0.5)
    t, at = 2.0, 0
    for _ in range(14):
        t, at = partition.cool(t, at, c)
    assert t == pytest.approx(2 * 0.5 ** 14)
    t, at = partition.cool(1e-4, 399, c)
    assert (t, at) == (2.0, 0) and partition.cool(1.001, 0, partition.PartitionConfig())[0] == 1.0
    assert partition.cool(2.0, 0, partition.PartitionConfig())[0] == 2.0 - float(np.float32(0.003))


def test_full_estimates_hold_every_edge(spark, tmp_path, monkeypatch):
    from lodestone.plans import queries
    monkeypatch.setattr(queries, "WHOLE", 20, raising=False)
    monkeypatch.setattr(queries, "SAMPLE", 20)
    users = [(i * i + i // 3) % 23 for i in range(200)]
    spark.createDataFrame(list(enumerate(users)), "event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    e = {(min(x, y), max(x, y)) for x, y in zip(users, users[1:]) if x != y}
    n = sum((a, c) in e for a, b in e for b2, c in e if b == b2)
    for q in (queries.triest_base_full, queries.triest_improved_full):
        got = q(spark, str(tmp_path)).first()
        assert (got["seen"], got["estimate"]) == (len(e), n) and len(e) > 20 and n


def test_iterated_spectrum_settles_in_few_rounds(spark):
    """Values close to each other, as random graphs have them: a block Krylov space finds them where powers of the matrix don't in these rounds."""
    pairs = some_graph(8, 300, 3000)
    a = affinity(spark, pairs)
    dense, _ = spectral.eigenpairs(a, 6)
    values, vectors = spectral.eigenpairs(a, 6, dense=0, rounds=20)
    assert values == pytest.approx(dense, abs=1e-6)
    m = np.zeros((300, 300))
    for r in graph.normalized_affinity(a).collect():
        m[r["i"], r["j"]] = r["w"]
    x = np.zeros((300, 6))
    for r in vectors.collect():
        x[r["node"]] = r["vec"]
    assert np.abs(x.T @ x - np.eye(6)).max() < 1e-8 and np.abs(m @ x - x * values).max() < 1e-3


def test_iterated_spectrum_of_small_graphs(spark):
    values, vectors = spectral.eigenpairs(affinity(spark, RING), 6, dense=0)
    assert values == pytest.approx([1.0, 0.535849, 0.274292, -0.376585, -0.607625, -0.825930], abs=1e-6) and vectors.count() == 6
    assert spectral.eigenpairs(affinity(spark, RING).where("i < 0"), 3)[0] == []


def test_last_edges_of_triangles(spark):
    """Edges of one value come in order of their ends; wedges carry a value and which edge has it, not the edges."""
    pairs = some_graph(9)
    for at in ({p: 0 for p in pairs}, {p: (p[0] * 7 + p[1]) % 3 for p in pairs}):
        e = spark.createDataFrame([(at[p], *p) for p in pairs], "seq long, u long, v long")
        t = graph.triangles(e, order="seq")
        assert t.columns == ["x", "y", "z", "third"]
        for x, y, z, third in t.collect():
            sides = {0: (y, z), 1: (x, z), 2: (x, y)}
            assert sorted(sides[third]) == list(max((tuple(sorted(s)) for s in sides.values()), key=lambda s: (at[s], s)))


@pytest.mark.parametrize("improved", [False, True])
def test_whole_stream_is_held_by_no_task(spark, improved):
    pairs = some_graph(10)
    twice = edges(spark, pairs + pairs[:9] + [(4, 4)])
    exact = graph.triangles_global(graph.canonical_edges(twice).select("u", "v")).first()[0]
    out = reservoir.stream_estimates(twice, len(pairs), improved, replicas=2)
    assert sorted(map(tuple, out.collect())) == [(0, len(pairs), float(exact)), (1, len(pairs), float(exact))]
    assert "InPandas" not in out._jdf.queryExecution().toString()
    assert reservoir.stream_estimates(twice.where("u > 99"), 20, improved).count() == 0
