import random
import re

import pytest

from lodestone.llm import ngram_join as J


def shingles(text, n):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", t)
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n, num, den):
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is None or rows[b][0] is None or not sets[a] or not sets[b]:
                continue
            if rows[a][0] == rows[b][0] or den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(sets[k]), None if i is None else least[find(k)]) for k, (i, _) in enumerate(rows)), key=str)


def run(spark, rows, **k):
    df = spark.createDataFrame([(i, t, 5, 6) for i, t in rows], "doc_id long, text string, n int, g int")
    return sorted(map(tuple, J.jaccard_join(df, **k).collect()), key=str)


def corpus(seed, n=90, words=40, vocabulary=30):
    r = random.Random(seed)
    base = [[f"W{r.randrange(vocabulary)}" for _ in range(r.randrange(1, words))] for _ in range(n // 6)]
    rows = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            p = r.randrange(len(w) + 1)
            if r.random() < 0.5 and p < len(w):
                w[p] = "new"
            else:
                w.insert(p, f"x{r.randrange(3)}")
        rows.append((i, r.choice([" ", "\n", " \t"]).join(x.lower() if r.random() < 0.3 else x for x in w)))
    return rows


def test_greatest_id_is_not_null(spark):
    most = (1 << 63) - 1
    near = " ".join(f"w{i}" for i in range(40))
    rows = [(most, near), (most - 1, "one two three four five"), (None, near), (most, "six seven eight nine ten"), (3, near + " more"), (-7, "six seven eight nine ten")]
    assert run(spark, rows, n=4, num=85) == brute(rows, 4, 85, 100)


@pytest.mark.parametrize("seed,n,num", [(1, 4, 85), (2, 5, 80), (3, 2, 60)])
def test_brute_force(spark, seed, n, num):
    rows = corpus(seed) + [(500, None), (501, ""), (502, " \n"), (503, "one"), (504, "One"), (505, "one two"), (None, "one two"), (None, "w"), (506, "a\xa0b c"), (507, "é É")]
    assert run(spark, rows, n=n, num=num, block_bytes=2000) == brute(rows, n, num, 100)


def test_large_clusters(spark, monkeypatch):
    monkeypatch.setattr(J, "SMALL", 3)
    r = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(80):
        w = list(base) + [f"t{k}" for k in range(r.randrange(30))]
        w[r.randrange(len(w))] = f"u{i}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(base[:20] + [f"z{i}_{k}" for k in range(40)])) for i in range(20)]
    got = run(spark, rows, n=4, num=85, block_bytes=4000, tile=7)
    assert got == brute(rows, 4, 85, 100)


def test_repeated_ids_and_empty(spark):
    a, b = "a b c d e f g h", "p q r s t u v w"
    rows = [(9, a), (5, a), (9, b), (7, b), (1, None), (1, None)]
    assert run(spark, rows, n=4) == brute(rows, 4, 80, 100)
    assert run(spark, []) == []
