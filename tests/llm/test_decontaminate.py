import random
import time
import re

import numpy as np

from lodestone.llm import decontaminate as D

ITEMS = [(1, "Anna buys 12 apples for 3 dollars each and sells 12 apples to Bert for 5 dollars each. How much does Anna earn?"),
         (2, "the quick brown fox jumps over the lazy dog while seven small cats watch from a wall"), (3, "too short"), (4, None), (None, "the quick brown fox jumps over it all"), (5, ""), (6, "1 2 3 4 5 6 7 8")]


def plain_tokens(text):
    """(kind, value) of each token, by rule and one at a time."""
    out, last = [], 0
    for m in re.finditer(r"(?:[^\W_]|(?<=\d)[.,](?=\d))+", text):
        w, between = m.group(), text[last:m.start()]
        opens = not out or re.search(r"[.!?:\n]", between) is not None
        low = w.lower()
        if w[0].isdigit() and w[0].isascii() or low in D.NUMBER_WORDS and not (w[0].isupper() and not opens):
            kind = D._NUMBER
        elif w[0].isupper() and not opens:
            kind = D._NAME
        else:
            kind = D._PLAIN
        if low in D.UNITS and out and out[-1][0] == D._NUMBER and kind != D._NUMBER:
            kind = D._UNIT
        out.append((kind, low))
        last = m.end()
    return out


def test_tokens():
    texts = [i[1] for i in ITEMS if i[1]] + ["Été à Paris. Élan, 3.5 km; 1,000 x 2. No. ÀB cd", "", "a", "5 Km", "Twenty one. Twenty km and two km"]
    t = D.tokens(texts)
    same: dict = {}
    for i, text in enumerate(texts):
        got = [(int(k), int(v)) for k, v in zip(t.kind[t.first[i]:t.first[i + 1]], t.value[t.first[i]:t.first[i + 1]])]
        want = plain_tokens(text)
        assert [k for k, _ in got] == [k for k, _ in want], text
        for (_, v), (_, w) in zip(got, want):
            assert same.setdefault(w, v) == v
    assert len(set(same.values())) == len(same)


def leaks(spark, texts, items=ITEMS, **k):
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    return sorted(((r["doc_id"], r["item_id"]) for r in D.leaks(docs, bench, **k).collect()), key=str)


def test_reparameterised(spark):
    pad = " unrelated words stand here before it."
    again = "Cora buys 40 apples for 7 dollars each and sells 40 apples to Dave for 9 dollars each. How much does Cora earn?"
    mixed_up = "Cora buys 40 apples for 7 dollars each and sells 41 apples to Dave for 9 euros each. How much does Emil earn?"
    rows = [(1, pad + " " + ITEMS[0][1] + pad), (2, pad + " " + again), (3, pad + " " + mixed_up), (4, pad), (5, None), (6, ""), (7, "x " + ITEMS[1][1].replace("lazy", "very") + " y"),
            (None, ITEMS[1][1]), (8, ITEMS[1][1][:40]), (9, "so too short it is"), (10, "9 8 7 6 5 4 3 2"), (11, "1 2 3 4 5 6 7 8"), (1, ITEMS[1][1])]
    assert leaks(spark, rows, agreement=0.9) == sorted([(1, 1), (2, 1), (1, 2), (None, 2), (9, 3), (11, 6)], key=str)
    assert leaks(spark, rows, [])== [] and leaks(spark, []) == []


def test_brute_force(spark):
    r = random.Random(5)
    words = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randrange(6, 40)))) for i in range(12)]
    rows = []
    for i in range(120):
        w = [r.choice(words) for _ in range(r.randrange(0, 80))]
        if i % 3 == 0:
            x = r.choice(items)[1].split()
            for _ in range(r.randrange(3)):
                x[r.randrange(len(x))] = "changed"
            w[len(w) // 2:len(w) // 2] = x
        rows.append((i, " ".join(w)))
    windows = lambda t: [tuple(t.split()[k:k + 5]) for k in range(len(t.split()) - 4)]
    want = sorted([(d, i) for d, t in rows for i, x in items if sum(w in set(windows(t)) for w in windows(x)) >= 0.8 * len(windows(x))], key=str)
    assert leaks(spark, rows, items) == want and want


def test_blocks_give_the_same(spark, monkeypatch):
    rows = [(i, f"before {x} after") for i, (_, x) in enumerate(ITEMS) if x]
    whole = leaks(spark, rows)
    monkeypatch.setattr(D.blocks, "__defaults__", (40,))
    assert leaks(spark, rows) == whole and whole


def test_rows_stay_whole(spark):
    docs = spark.createDataFrame([(1, "a b c", "k"), (2, ITEMS[1][1], "l"), (3, None, None)], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert sorted(map(tuple, D.without_leaks(docs, bench).collect())) == [(1, "a b c", "k"), (3, None, None)]
    assert np.isclose(D.COVERAGE, 0.8)


def test_names_that_open_sentences(spark):
    item = "Tom has 3 apples. Tom buys 4 more. Tom eats 2. How many apples are left?"
    sam = "Sam has 5 apples. Sam buys 9 more. Sam eats 1. How many apples are left?"
    capital = "What is the capital of France and of Spain?"
    items = [(1, item), (2, capital)]
    rows = [(1, sam), (2, "Before it. " + sam + " After it."), (3, item.replace("buys", "\nbuys").replace(". Tom", ", Tom")), (4, item.lower()), (5, item.upper()),
            (6, capital.upper()), (7, sam.replace("Sam eats", "Eve eats").replace("Sam buys", "Bob buys")), (8, "Paris is the capital of France. Rome is the capital of Italy."), (9, "They ate. How many are left?")]
    assert leaks(spark, rows, items, agreement=0.9) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 2)]


def test_names_that_open_sentences():
    for item, other in (("Anna has 3 apples and eats 2 of them. Anna then buys 5 more pears at noon.", "Cora has 7 apples and eats 4 of them. Cora then buys 9 more pears at noon."),
                        ("Tom had 5 marbles. Tom lost 2.", "Sam had 8 marbles. Sam lost 3.")):
        assert [m[1] for m in D.matches([other, "nothing of the kind here at all"], D.block([(4, item)]))] == [4]
        clash = other.replace("Cora then", "Dora then").replace("Sam lost", "Max lost")
        assert not D.matches([clash], D.block([(4, item)]), agreement=0.99)


def test_number_heavy_texts_take_linear_time():
    r = random.Random(5)
    numbers = lambda n: " ".join(str(r.randrange(1000)) for _ in range(n))
    items = [(i, numbers(60)) for i in range(300)]
    b = D.block(items)
    began = time.time()
    assert D.matches([numbers(20_000)], b) == []
    assert [m[1] for m in D.matches([numbers(500) + " " + items[7][1] + " " + numbers(500)], b)] == [7]
    assert time.time() - began < 5


def test_hits_in_parts(monkeypatch):
    """What is looked at in parts gives what is looked at whole."""
    r = random.Random(6)
    texts = [" ".join(r.choice(["a", "b", "Tom", "3", "7"]) for _ in range(60)) for _ in range(30)]
    b = D.block([(i, " ".join(t.split()[10:30])) for i, t in enumerate(texts[:15])])
    whole = sorted(D.matches(texts, b))
    assert {(i, i) for i in range(15)} <= {m[:2] for m in whole}
    monkeypatch.setattr(D, "HITS", 20)
    assert sorted(D.matches(texts, b)) == whole


def test_slots_against_brute_force():
    """Random questions with other values, consistent or not, against a search over all alignments."""
    r = random.Random(13)
    names, units = ["Tom", "Ann", "Bob", "Eve", "Max"], ["km", "kg", "hours", "dollars"]

    def filled(template, values):
        return " ".join(values.get(t, t) for t in template)

    for _ in range(60):
        words = [f"w{r.randrange(400)}" for _ in range(r.randrange(12, 25))]
        template = [r.choice(["N0", "N1", "P0", "P1", "n0 u0"]) if r.random() < 0.3 else w for w in words]
        template = ["so", *" ".join(template).split()]
        values = lambda: {"N0": str(r.randrange(10, 50)), "N1": str(r.randrange(50, 99)), "n0": str(r.randrange(100, 200)), "u0": r.choice(units),
                          "P0": r.choice(names[:2]), "P1": r.choice(names[2:])}
        item, other = filled(template, values()), filled(template, values())
        torn = " ".join(f"x{r.randrange(900)}" if r.random() < 0.4 else w for w in other.split())
        b = D.block([(1, item)])
        assert [m[:2] for m in D.matches([f"say {other} and done", f"say {torn} and done"], b)] in ([(0, 1)], [(0, 1), (1, 1)])
        t, q = D.tokens([item]).read(2), D.tokens([torn]).read(2)
        w = min(5, len(t.kind))
        plain = [i for i in range(len(t.kind) - w + 1) if (t.kind[i:i + w] == 0).any()] or list(range(len(t.kind) - w + 1))
        best = max(sum(i + d >= 0 and i + d + w <= len(q.kind) and list(t.template[i:i + w]) == list(q.template[i + d:i + d + w]) for i in plain)
                   for d in range(-len(t.kind), len(q.kind)))
        if best < 0.5 * len(plain):
            assert not D.matches([torn], b)
