import itertools
import random

import pytest

from lodestone.operators import itemsets as I


def baskets(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "basket_id long, items array<bigint>")


def mine(spark, rows, s, **k):
    return {tuple(r["items"]): r["cnt"] for r in I.apriori(I.explode_items(baskets(spark, rows)), s, len(rows), **k).collect()}


def test_support_and_rules_of_the_small_fixture(spark):
    b = baskets(spark, [[1, 2, 3], [1, 2, 4], [1, 3, 4], [2, 3, 4]])
    asked = spark.createDataFrame([(0, [1, 2]), (1, [1, 3]), (2, [2, 3]), (3, [1, 2, 3]), (4, [1, 2, 3, 4])], "set_id int, items array<bigint>")
    got = {r["set_id"]: (r["support"], r["is_frequent"]) for r in I.support_of(b, asked, 0.5).collect()}
    assert got == {0: (0.5, True), 1: (0.5, True), 2: (0.5, True), 3: (0.25, False), 4: (0.0, False)}
    rules = spark.createDataFrame([(0, [1, 2], 3), (1, [1, 3], 4), (2, [2, 3], 3), (3, [1, 2, 3], 4), (4, [1, 2, 3, 4], 3)], "rule_id int, antecedent array<bigint>, consequent bigint")
    got = {r["rule_id"]: (r["confidence"], r["interest"]) for r in I.rule_metrics(b, rules).collect()}
    assert got == {0: (0.5, -0.25), 1: (0.5, -0.25), 2: (1.0, 0.25), 3: (0.0, -0.75), 4: (0.0, -0.75)}


def test_pairs_don_t_depend_on_order(spark):
    assert mine(spark, [[825], [39, 825], [39, 825]], 0.5)[39, 825] == 2


@pytest.mark.parametrize("seed", [1, 2])
def test_against_enumeration(spark, seed):
    r = random.Random(seed)
    rows = [sorted(r.sample(range(9), r.randrange(0, 7))) for _ in range(60)]
    want = {}
    for k in range(1, 8):
        for c in itertools.combinations(range(9), k):
            n = sum(set(c) <= set(b) for b in rows)
            if n >= 0.1 * len(rows):
                want[c] = n
    assert mine(spark, rows, 0.1) == want


def test_rules(spark):
    rows = [[1, 2, 3], [1, 2], [1, 3], [2, 3], []]
    f = I.apriori(I.explode_items(baskets(spark, rows)), 0.2, len(rows))
    got = {(tuple(r["antecedent"]), r["consequent"]): r for r in I.association_rules(f, len(rows), min_interest=-1.0).collect()}
    assert got[(1,), 2]["support"] == pytest.approx(0.4) and got[(1,), 2]["confidence"] == pytest.approx(2 / 3)
    assert got[(1,), 2]["interest"] == pytest.approx(2 / 3 - 0.6)
    assert got[(1, 2), 3]["confidence"] == pytest.approx(0.5) and len(got) == 9
    assert I.association_rules(f, len(rows), min_confidence=0.6, min_interest=-1.0).count() == 6
