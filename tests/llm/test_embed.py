import math
import random

import numpy as np

from lodestone.llm import embed_dedup as E


def brute(rows, threshold):
    good = [(i, v, lab) for i, v, lab in rows if v and lab is not None and i is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, root = {k: 0 for k in range(len(good))}, list(range(len(good)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(good)):
        for b in range(a):
            (_, x, p), (_, y, q) = good[a], good[b]
            if p == q and len(x) == len(y) and float(np.dot(x, y)) / (float(np.linalg.norm(x)) * float(np.linalg.norm(y))) >= threshold:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for k, g in enumerate(good):
        least[find(k)] = min(least.get(find(k), g[0]), g[0])
    out = [(g[0], links[k], least[find(k)], g[0] == least[find(k)]) for k, g in enumerate(good)]
    out += [(r[0], 0, r[0], True) for r in rows if r not in good]
    return sorted(out, key=str)


def rows_for(seed, n=150, dim=12):
    r = np.random.default_rng(seed)
    base = r.normal(size=(12, dim))
    rows = []
    for i in range(n):
        v = base[r.integers(12)] + r.normal(size=dim) * r.choice([0, 0.05, 0.3, 1.0])
        rows.append((i, [float(np.float32(x)) for x in v], int(r.integers(2))))
    return rows


def run(spark, rows, **k):
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, kept int")
    return sorted(map(tuple, E.near_duplicates(df, **k).collect()), key=str)


def test_brute_force(spark):
    rows = rows_for(1)
    odd = [(1000, None, 1), (1001, [0.0] * 12, 1), (1002, [float("nan")] + [1.0] * 11, 1), (1003, [float("inf")] * 12, 0), (1004, [None] + [1.0] * 11, 0),
           (1005, rows[3][1], None), (1006, rows[3][1], rows[3][2]), (1007, rows[3][1][:5], rows[3][2]), (1008, [], 1), (1009, [x * 2 for x in rows[4][1]], rows[4][2]), (None, rows[5][1], 1)]
    assert run(spark, rows + odd, tile=16) == brute(rows + odd, 0.93)
    assert run(spark, []) == []


def test_many_copies(spark):
    rows = [(i, [1.0, 2.0, 3.0], 0) for i in range(300)] + [(500, [1.0, 2.0, 3.1], 0), (501, [-1.0, 0.0, 0.0], 0)]
    got = {r[0]: r[1:] for r in run(spark, rows, tile=8)}
    assert got[0] == (300, 0, True) and got[299] == (300, 0, False) and got[500] == (300, 0, False) and got[501] == (0, 501, True)


def test_bound_is_rigorous():
    r = np.random.default_rng(5)
    for dim in (3, 64, 2100):
        x = r.normal(size=(80, dim)) * np.exp(r.normal(size=(1, dim)) * random.Random(dim).choice([0, 2]))
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        c, s, length, e = E.quantise(u)
        exact = u @ u.T
        coded = E.code_product(c, c) * (s[:, None] * s)
        bound = length[:, None] * e + e[:, None] * length + e[:, None] * e + E.SLACK
        assert (np.abs(exact - coded) <= bound).all()
        assert (E.code_product(c, c) == c.astype(np.int64) @ c.astype(np.int64).T).all()


def test_links_of_repeated_ids(spark):
    """A row's links are those of its own vector, also where another row has its id."""
    rows = [(1, [1.0, 0.0], 5), (1, [0.0, 1.0], 5), (2, [1.0, 0.01], 5), (3, [0.01, 1.0], 5), (4, [0.02, 1.0], 5)]
    got = E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), 0.93).collect()
    assert sorted((g["vec_id"], g["n_links"]) for g in got) == [(1, 1), (1, 2), (2, 1), (3, 2), (4, 2)]
