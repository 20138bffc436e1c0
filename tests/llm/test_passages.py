import random

import numpy as np
import pyarrow as pa

from lodestone.llm import passages as P


def test_windows_are_the_cartesian_tree(monkeypatch):
    monkeypatch.setattr(P, "STRIP", 64)
    r = random.Random(4)
    texts = [" ".join(r.choice("abc") for _ in range(r.randrange(0, 160))) for _ in range(12)] + ["z " * 90]
    s = P.Shingles(pa.table({"doc_id": pa.array(range(len(texts))), "text": texts}), 2)
    for t in (1, 5, 20):
        s.__dict__.pop("_inside", None)
        got = set(zip(*(x.tolist() for x in P.compact_windows(s, t, 3)[:4])))
        want = set()
        for d in range(len(texts)):
            v = (P.hashed(s.flat[s.at[d]:s.at[d + 1]], 3) >> np.uint64(24)).tolist()

            def tree(lo, hi, d=d, v=v):
                while hi - lo + 1 >= t:
                    c = min(range(lo, hi + 1), key=lambda i: (v[i], i))
                    if not (lo > 0 and v[lo - 1] == v[c]):
                        want.add((d, lo, c, hi))
                    tree(lo, c - 1)
                    lo = c + 1

            tree(0, len(v) - 1)
        assert got == want


def run(spark, rows, **k):
    df = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, jaccard double")
    return [r.asDict() for r in P.passages(df, **k).collect()]


def text(r, n, tag=""):
    return [f"{tag}{r.randrange(100000)}" for _ in range(n)]


def test_planted_passages(spark):
    r = random.Random(8)
    shared, near = text(r, 60, "s"), text(r, 80, "n")
    rows, holders, nears = [], set(), set()
    for i in range(60):
        w = text(r, r.randrange(20, 200))
        if i % 4 == 0:
            p = r.randrange(len(w))
            w[p:p] = shared
            holders.add(i)
        elif i % 7 == 0:
            x = list(near)
            x[r.randrange(80)] = "other"
            w += x
            nears.add(i)
        elif i % 5 == 0:
            w += shared[:30]  # too short
        rows.append((i, " ".join(w)))
    rows += [(100, None), (101, ""), (None, " ".join(shared)), (102, " ".join(shared)), (102, " ".join(shared))]
    got = run(spark, rows, block_bytes=4000)
    linked = {g["doc_id"] for g in got} | {g["of_doc_id"] for g in got}
    assert linked == holders | nears | {102}
    root = {i: i for i in linked}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for g in got:
        assert g["jaccard"] >= 0.8 and g["end_word"] - g["start_word"] >= 50 and g["doc_id"] != g["of_doc_id"]
        root[find(g["doc_id"])] = find(g["of_doc_id"])
    assert len({find(i) for i in holders | {102}}) == 1 and len({find(i) for i in nears}) == 1
    texts = dict(rows[:60])
    for g in got:
        if g["doc_id"] in holders and g["of_doc_id"] in holders:
            a = texts[g["doc_id"]].split()[g["start_word"]:g["end_word"]]
            assert " ".join(shared) in " ".join(a)


def test_greatest_id_is_not_null(spark):
    most, r = (1 << 63) - 1, random.Random(8)
    shared = " ".join(text(r, 70))
    df = spark.createDataFrame([(most, shared), (5, " ".join(text(r, 20, "a")) + " " + shared), (None, shared)], "doc_id long, text string")
    got = {x["doc_id"]: (x["component_id"], x["n_passages"] > 0) for x in P.classes(df).collect()}
    assert got == {most: (5, True), 5: (5, True), None: (None, False)}


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, "a b"), (2, None)]) == []


def found(a, b):
    """(start, end, start, end, Jaccard) of the passages of two texts, and whether brute force finds any."""
    s = P.Shingles(pa.table({"doc_id": pa.array([0, 1]), "text": [" ".join(a), " ".join(b)]}), 5)
    x, y = s.flat[:s.at[1]], s.flat[s.at[1]:]
    got = P.common_passages(np.arange(len(x)), x, np.arange(len(y)), y, 5, 50, 0.8)
    for i0, i1, j0, j1, jaccard in got:
        u, v = set(x[i0:i1 - 4].tolist()), set(y[j0:j1 - 4].tolist())
        assert min(i1 - i0, j1 - j0) >= 50 and jaccard >= 0.8 and abs(len(u & v) / len(u | v) - jaccard) < 1e-9
    left = [set(x[i:i + k].tolist()) for k in range(46, len(x) + 1) for i in range(len(x) - k + 1)]
    right = [set(y[j:j + k].tolist()) for k in range(46, len(y) + 1) for j in range(len(y) - k + 1)]
    return got, any(len(u & v) >= 0.8 * len(u | v) for u in left for v in right)


def test_verification_against_brute_force():
    r = random.Random(11)
    w = text(r, 60)
    assert found(w[:50], ["other", *w[1:50]])[0] and found(w, w[30:] + w[:30])[0]
    both = set()
    for k in range(40):
        p = text(r, r.randrange(50, 58))
        q = list(p)
        for _ in range(r.randrange(1, 4)):
            at = r.choice([0, 1, len(q) - 1, r.randrange(len(q))])
            q[at:at + r.randrange(2)] = text(r, r.randrange(1, 3), "x")
        if k % 4 == 0:
            q = q[len(q) // 2:] + q[:len(q) // 2]
        got, want = found(p, q)
        assert bool(got) == want
        both.add(want)
    assert both == {True, False}


def brute_pairs(texts):
    """Pairs of documents with windows of 50 to 96 words that reach 0.8."""
    s = P.Shingles(pa.table({"doc_id": pa.array(range(len(texts))), "text": texts}), 5)
    parts = [s.flat[s.at[i]:s.at[i + 1]] for i in range(len(texts))]
    return {(i, j) for i in range(len(parts)) for j in range(i)
            if len(np.intersect1d(parts[i], parts[j])) >= 36 and P.stretches(parts[i], parts[j], 46, 0.8)}


def test_groups_of_different_near_copies(spark):
    """Every pair that brute force finds is joined, directly or by others of its group; nothing else is linked."""
    r = random.Random(21)
    texts = []
    for _ in range(12):
        shared = text(r, r.randrange(56, 75), "s")
        for _ in range(12):
            p = list(shared)
            for k in r.sample(range(len(p)), r.randrange(1, 3)):
                p[k] = text(r, 1, "x")[0]
            w = text(r, 200)
            w[100:100] = p
            texts.append(" ".join(w))
    want = brute_pairs(texts)
    for options in ({"block_bytes": 30_000}, {"block_bytes": 30_000, "tile": 6}):
        got = {(g["doc_id"], g["of_doc_id"]) for g in run(spark, list(enumerate(texts)), **options)}
        assert got <= want
        root = list(range(len(texts)))
        for i, j in got:
            a, b = root[i], root[j]
            root = [b if x == a else x for x in root]
        joined = sum(root[i] == root[j] for i, j in want)
        assert joined >= 0.97 * len(want), (joined, len(want))


def test_passages_of_few_different_shingles(spark):
    """Documents in a group link by a passage whose shingles repeat; one row per document has their class."""
    r = random.Random(5)
    cycle = text(r, 9, "c") * 8
    rows = [(3 * i, " ".join(text(r, 80) + cycle + text(r, 80))) for i in range(1, 7)] + [(1, " ".join(text(r, 200))), (2, None), (None, " ".join(cycle))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: (x["component_id"], x["n_passages"] > 0) for x in P.classes(df).collect()}
    assert got == {**{3 * i: (3, True) for i in range(1, 7)}, 1: (1, False), 2: (2, False), None: (None, False)}


def test_windows_that_rule_each_other_out(monkeypatch):
    """Two long texts of one repeating line each, a little less than 0.8 alike, need no search; what is similar isn't ruled out."""
    calls, search = [], P.stretches
    monkeypatch.setattr(P, "stretches", lambda *x: calls.append(1) or search(*x))
    line = np.arange(1, 49, dtype=np.uint64)
    a, b = np.tile(line, 30), np.tile(np.where(line % 6 == 0, line + 1000, line), 30)
    assert not P.common_passages(np.arange(len(a)), a, np.arange(len(b)), b, 5, 50, 0.8, first=True) and len(calls) == 0
    r = np.random.default_rng(6)
    seen = set()
    for k in range(150):
        x = r.integers(0, r.choice([12, 40, 10000]), r.integers(10, 40)).astype(np.uint64)
        y = x[r.permutation(len(x))] if k % 3 else np.roll(x, 7)
        y = np.concatenate([r.integers(20000, 30000, r.integers(0, 9)).astype(np.uint64), np.where(r.random(len(y)) < r.choice([0.05, 0.15]), y + np.uint64(50000), y)])
        t = 9
        if len(y) < t:
            continue
        want = [(i, i + m, j, j + o) for m in range(t, 2 * t + 1) for i in range(len(x) - m + 1) for o in range(t, 2 * t + 1) for j in range(len(y) - o + 1)
                if 5 * len(np.intersect1d(x[i:i + m], y[j:j + o])) >= 4 * len(np.union1d(x[i:i + m], y[j:j + o]))] if k < 12 else search(x, y, t, 0.8)
        of_x, of_y = P.able(x, y, t, 0.8)
        for i, i_end, j, j_end, *_ in want if k < 12 else []:
            assert of_x[i] <= i_end and of_y[j] <= j_end
        seen.add(bool(want))
        assert not want or (P._holding([(0, len(x))], of_x) and P._holding([(0, len(y))], of_y))
    assert seen == {True, False}


def test_documents_are_dealt_out_for_cells_only(spark, monkeypatch):
    """Comparing takes the nodes' texts from what the blocks sent, also where a head has more nodes than a tile."""
    calls, grouped = [], P.text_blocks(spark.createDataFrame([(1, "a")], "doc_id long, text string")).__class__.grouped
    monkeypatch.setattr("lodestone.llm.blocks.Blocks.grouped", lambda self: calls.append(1) or grouped(self))
    r = random.Random(17)
    shared = text(r, 110, "s")
    rows = [(i, " ".join(text(r, 60) + [w if k != 4 * i + 3 else f"x{i}" for k, w in enumerate(shared)] + text(r, 60))) for i in range(24)]
    got = run(spark, rows, tile=6)
    assert {g["doc_id"] for g in got} | {g["of_doc_id"] for g in got} == set(range(24)) and len(calls) == 2
