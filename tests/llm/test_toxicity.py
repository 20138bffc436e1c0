import random
import sys
import zlib
from collections import Counter

import numpy as np

from lodestone.llm import toxicity as T


def sparse(dense):
    row, term = np.nonzero(dense)
    return T.Sparse(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(dense))))), term, dense[row, term].astype(np.float64))


def test_nearest_is_exact(monkeypatch):
    """Against brute force, with every share of terms kept by block."""
    r = np.random.default_rng(2)
    n, f = 300, 40
    v = r.random((n, f)) * (r.random((n, f)) < 0.1)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    v[7] = v[3]
    q = r.random((60, f)) * (r.random((60, f)) < 0.1)
    q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-9)
    q[5] = 0
    exact = np.round(q @ v.T, 5)
    for frequent in (0, 10, 40):
        monkeypatch.setattr(T, "FREQUENT", frequent)
        monkeypatch.setattr(T, "ROWS", 16)
        m = T.Model([f"f{i}" for i in range(f)], np.ones(f), np.arange(n), np.zeros(n), np.ones(n), sparse(v), 0.1, np.zeros(0), np.zeros(0))
        idx, sims = m.nearest(sparse(q), 7)
        for i in range(len(q)):
            best = sorted((-round(float(s), 4), j) for j, s in enumerate(exact[i]) if s > 0)[:7]
            assert np.allclose([-s for s, _ in best], sims[i][:len(best)], atol=2e-4)
            assert (idx[i][len(best):] == -1).all() and np.allclose(exact[i][idx[i][:len(best)]], sims[i][:len(best)], atol=2e-5)
        left, _ = m.nearest(sparse(v[:20]), 3, leave=np.arange(20))
        assert all(i not in left[i] for i in range(20)) and left[3][0] == 7 and left[7][0] == 3


def test_cosine_of_whole_texts(spark):
    """Scores' neighbours against cosines worked out term by term from the texts."""
    rows, labels = corpus(9, 300)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = T.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    weight, texts = dict(zip(m.names, m.weights)), {i: t for i, t, _ in rows}

    def vector(text):
        c = Counter(t for w in text.lower().split() for t in T.terms_of(w) if t in weight)
        v = {t: (1 + np.log(k)) * weight[t] for t, k in c.items()}
        size = sum(x * x for x in v.values()) ** 0.5
        return {t: x / size for t, x in v.items()}

    held = [vector(texts[i]) for i in m.ids.tolist()]
    idx, sims, _ = m.scored(T.Terms(m.names), [texts[i] for i in range(40)])
    for i in range(40):
        q = vector(texts[i])
        want = sorted((sum(q[t] * e.get(t, 0) for t in q) for e in held), reverse=True)[:T.NEIGHBOURS]
        assert np.allclose(want, sims[i], atol=2e-5)
    assert (np.diff(m.vectors.at) > 0).mean() >= 0.95


def test_monotone():
    x, y = T._monotone(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert (np.diff(y) >= 0).all() and y[0] == 0 and y[-1] == 1


def corpus(seed, n=600):
    r = random.Random(seed)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    rows, labels = [], []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randrange(10, 150))]
        toxic = r.random() < 0.2
        for _ in range(4 * toxic):
            w.insert(r.randrange(len(w)), r.choice(["vilest", "grimmed", "zurq" + r.choice(words)]))
        rows.append((i, " ".join(w), "en"))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_edges(spark):
    rows, labels = corpus(3)
    extra = [(5000, None, "x"), (5001, "", "y"), (None, "vilest grimmed vilest", "z"), (5001, "", "y")]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, score string")
    lab = spark.createDataFrame([*labels, (None, 1), (7, None), labels[0]], "doc_id long, toxic int")
    got = T.toxicity(docs, lab).collect()
    assert len(got) == len(rows) + 4 and all(0 <= g["score"] <= 1 and g["predicted"] == (g["score"] >= 0.5) for g in got)
    y = dict(labels)
    held = [g for g in got if g["held_out"] and g["doc_id"] in y]
    assert {g["doc_id"] for g in held} == {i for i in y if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(g["predicted"] == y[g["doc_id"]] for g in held) / len(held) >= 0.97
    assert all(g["predicted"] == 0 for g in got if g["doc_id"] in (5000, 5001)) and all(g["predicted"] for g in got if g["doc_id"] is None)
    assert any(g["evidence"] and g["evidence"][0]["toxic"] == 1 for g in got if g["predicted"])
    kept = T.without_toxic(docs, T.fit(docs, lab)).collect()
    assert len(kept) == sum(g["predicted"] == 0 for g in got)


def test_held_out_labels_don_t_matter(spark):
    rows, labels = corpus(4, 200)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    flip = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    a, b = ([tuple(r)[:4] for r in T.toxicity(docs, spark.createDataFrame(x, "doc_id long, toxic int")).orderBy("doc_id").collect()] for x in (labels, flip))
    assert a == b


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in T.toxicity(docs, none).collect()] == [0.0, 0.0]
    assert T.toxicity(docs.limit(0), none).count() == 0
    one = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert all(r["predicted"] == 0 for r in T.toxicity(docs, one).collect())


def test_counts_of_terms_by_text():
    """Against counts text by text, with words repeated within and across texts and calls."""
    t = T.Terms(["abcd*", "abcdef", "xy"])
    for texts in (["abcdef xy XY abcdef", None, "abcdx zz abcd"], ["xy abcdef", "", "abcdx abcdx"]):
        row, term, count = t.counts(texts)
        want = Counter((i, k) for i, x in enumerate(texts) for w in (x or "").lower().split() for k, n in enumerate(["abcd*", "abcdef", "xy"]) if n in T.terms_of(w))
        assert list(zip(row.tolist(), term.tolist())) == sorted(want) and count.tolist() == [want[k] for k in sorted(want)]


def test_words_of_any_characters():
    """The way by Latin-1 finds what the pattern finds."""
    r = random.Random(8)
    for top in (128, 256, 1000):
        for _ in range(200):
            t = "".join(chr(r.randrange(top)) for _ in range(r.randrange(40)))
            assert T.words_of(t) == T._WORD.findall(t.lower())
    assert T.words_of("".join(map(chr, range(256)))) == T._WORD.findall("".join(map(chr, range(256))).lower())
    assert T.words_of("\u0130x \u201cStra\xdfe\u201d 5\xb2 a\xa0b") == ["i", "x", "stra\xdfe", "\xb2", "a", "b"] and T.words_of(None) == T.words_of("") == []


def test_work_of_new_words_and_of_rows(monkeypatch):
    """New words take no calls each, and rows go through the blocks together whatever their postings."""
    t, calls = T.Terms(["abcd*", "abcdef", "xy"]), 0

    def seen(frame, event, arg):
        nonlocal calls
        calls += event == "c_call"

    letters = "bcdfghklmnpqrstvwxyz"
    words = [f"{a}{b}{c}e" for a in letters for b in letters for c in letters]
    sys.setprofile(seen)
    try:
        t.counts([" ".join(words)])
    finally:
        sys.setprofile(None)
    assert len(t.words) == len(words) and calls < len(words) / 10
    r = np.random.default_rng(5)
    v = r.random((200, 30)) * (r.random((200, 30)) < 0.3)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    monkeypatch.setattr(T, "FREQUENT", 5)
    monkeypatch.setattr(T, "POSTINGS", 100)
    m = T.Model([f"f{i}" for i in range(30)], np.ones(30), np.arange(200), np.zeros(200), np.ones(200), sparse(v), 0.1, np.zeros(0), np.zeros(0))
    whole, went = T.Model._nearest, []
    monkeypatch.setattr(T.Model, "_nearest", lambda self, q, *a: went.append(len(q.at) - 1) or whole(self, q, *a))
    _, sims = m.nearest(sparse(v), 4)
    assert went == [200] and np.allclose(sims, -np.sort(-(v @ v.T), 1)[:, :4], atol=2e-5)
