"""Frequent itemsets and association rules over baskets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle


def explode_items(baskets: DataFrame) -> DataFrame:
    """``basket_id, item``, distinct, of ``basket_id, items``; empty baskets have no rows."""
    return baskets.select("basket_id", F.explode(F.array_distinct("items")).alias("item"))


def item_support(items: DataFrame, n_baskets: int) -> DataFrame:
    """``item, cnt, support``."""
    return items.groupBy("item").agg(F.count("*").alias("cnt")).withColumn("support", F.col("cnt") / F.lit(float(max(n_baskets, 1))))


def frequent(counts: DataFrame, min_support: float, n_baskets: int) -> DataFrame:
    """Rows whose ``cnt`` reaches ``min_support * n_baskets``, as doubles."""
    return counts.where(F.col("cnt").cast("double") >= F.lit(min_support * n_baskets))


def candidates(level: DataFrame, k: int) -> DataFrame:
    """Sets of k items of which all subsets of k - 1 are in ``level`` (``items`` ascending): joined on equal
    prefixes, last items ascending, then pruned against the level."""
    prefix = F.slice("items", 1, k - 2)
    a = level.select(prefix.alias("prefix"), F.element_at("items", -1).alias("x"))
    b = level.select(prefix.alias("prefix"), F.element_at("items", -1).alias("y"))
    joined = a.join(b, "prefix").where(F.col("x") < F.col("y")).select(F.concat("prefix", F.array("x", "y")).alias("items"))
    if k == 2:
        return joined
    # The two subsets without x or y are there by the join; the others drop one item of the prefix.
    subs = joined.select("items", F.explode(F.transform(F.sequence(F.lit(1), F.lit(k - 2)), lambda i: F.concat(
        F.slice("items", F.lit(1), i - 1), F.slice("items", i + 1, F.lit(k))))).alias("sub"))
    return subs.join(level.select(F.col("items").alias("sub")), "sub", "left_semi").groupBy("items").agg(F.count("*").alias("n")).where(F.col("n") == k - 2).select("items")


def extend(held: DataFrame, items: DataFrame) -> DataFrame:
    """``basket_id, items`` of the sets one larger that baskets hold: each held set with a later item of the same basket."""
    return held.join(items, "basket_id").where(F.col("item") > F.element_at("items", -1)).select("basket_id", F.concat("items", F.array("item")).alias("items"))


def apriori(items: DataFrame, min_support: float, n_baskets: int, max_size: int | None = None, interest: float = 0.0) -> DataFrame:
    """``size, items, cnt`` of all frequent sets of ``items(basket_id, item)``, distinct rows.

    ``n_baskets`` counts empty baskets too.  ``interest`` is accepted and not used: it never filters itemsets.  Level by level, over
    the frequent sets that each basket holds, which the next level extends by one item; an empty level ends the loop.
    """
    one = settle(frequent(items.groupBy("item").agg(F.count("*").alias("cnt")), min_support, n_baskets).select(F.array("item").alias("items"), "cnt"))
    levels, k, now = [one.select(F.lit(1).alias("size"), "items", "cnt")], 1, one
    kept = settle(items.join(one.select(F.element_at("items", 1).alias("item")), "item", "left_semi"))
    held = kept.select("basket_id", F.array("item").alias("items"))
    while (max_size is None or k < max_size) and now.limit(1).count():
        k += 1
        found = settle(extend(held, kept).join(candidates(now, k), "items", "left_semi"))
        now = settle(frequent(found.groupBy("items").agg(F.count("*").alias("cnt")), min_support, n_baskets))
        held = found.join(now.select("items"), "items", "left_semi")
        levels.append(now.select(F.lit(k).alias("size"), "items", "cnt"))
    return reduce(DataFrame.unionByName, levels)


def max_by_size(itemsets: DataFrame) -> DataFrame:
    return itemsets.groupBy("size").agg(F.max("cnt").alias("max_cnt"), F.count("*").alias("n_itemsets"))


def support_of(baskets: DataFrame, asked: DataFrame, min_support: float = 0.0) -> DataFrame:
    """``set_id, support, is_frequent`` of ``asked(set_id, items)``: the share of baskets that hold all the items.

    0.0 without baskets.  The asked sets are few; they are met by their items, not by comparing every basket with every set.
    """
    n = baskets.count()
    items = explode_items(baskets)
    wanted = asked.select("set_id", F.size(F.array_distinct("items")).alias("k"), F.explode(F.array_distinct("items")).alias("item"))
    hit = wanted.join(items, "item").groupBy("set_id", "k", "basket_id").agg(F.count("*").alias("n")).where(F.col("n") == F.col("k"))
    counts = hit.groupBy("set_id").agg(F.count("*").alias("cnt"))
    support = F.coalesce(F.when(F.size("items") == 0, F.lit(n)).otherwise(F.col("cnt")), F.lit(0)) / F.lit(float(max(n, 1)))
    return asked.join(counts, "set_id", "left").select("set_id", support.alias("support")).withColumn("is_frequent", F.col("support") >= min_support)


def rule_metrics(baskets: DataFrame, asked: DataFrame) -> DataFrame:
    """``rule_id, support, confidence, interest`` of ``asked(rule_id, antecedent, consequent)``.

    Confidence is 0.0 where the antecedent never occurs; interest is confidence less the consequent's support.
    """
    sets = asked.select(F.concat(F.lit("u"), F.col("rule_id").cast("string")).alias("set_id"), F.array_distinct(F.concat("antecedent", F.array("consequent"))).alias("items")).unionByName(
        asked.select(F.concat(F.lit("a"), F.col("rule_id").cast("string")).alias("set_id"), F.col("antecedent").alias("items"))).unionByName(
        asked.select(F.concat(F.lit("c"), F.col("rule_id").cast("string")).alias("set_id"), F.array("consequent").alias("items")))
    s = support_of(baskets, sets).select(F.substring("set_id", 1, 1).alias("kind"), F.expr("substring(set_id, 2)").alias("rule"), "support")
    wide = s.groupBy("rule").agg(*[F.max(F.when(F.col("kind") == k, F.col("support"))).alias(k) for k in "uac"])
    confidence = F.when(F.col("a") > 0, F.col("u") / F.col("a")).otherwise(0.0)
    return asked.join(wide, F.col("rule_id").cast("string") == F.col("rule")).select("rule_id", F.col("u").alias("support"), confidence.alias("confidence"), (confidence - F.col("c")).alias("interest"))


def association_rules(itemsets: DataFrame, n_baskets: int, min_support: float = 0.0, min_confidence: float = 0.0, min_interest: float = 0.0) -> DataFrame:
    """``antecedent, consequent, support, confidence, interest``: each item of each set of two or more as the only consequent.

    All supports are in the itemset table already, every subset of a frequent set being frequent, so no basket is read.
    """
    n = F.lit(float(max(n_baskets, 1)))
    sets = itemsets.where(F.col("size") >= 2).select("items", "cnt", F.explode("items").alias("consequent"))
    sets = sets.select(F.array_remove("items", F.col("consequent")).alias("antecedent"), "consequent", "cnt")
    ante = itemsets.select(F.col("items").alias("antecedent"), F.col("cnt").alias("ante_cnt"))
    cons = itemsets.where(F.col("size") == 1).select(F.element_at("items", 1).alias("consequent"), F.col("cnt").alias("cons_cnt"))
    support, confidence = F.col("cnt") / n, (F.col("cnt") / n) / (F.col("ante_cnt") / n)
    out = sets.join(ante, "antecedent").join(cons, "consequent").select(
        "antecedent", "consequent", support.alias("support"), confidence.alias("confidence"), (confidence - F.col("cons_cnt") / n).alias("interest"))
    return out.where((F.col("support") >= min_support) & (F.col("confidence") >= min_confidence) & (F.col("interest") >= min_interest))


def rules_by_size(rules: DataFrame) -> DataFrame:
    return rules.groupBy(F.size("antecedent").alias("antecedent_size")).agg(
        F.count("*").alias("n_rules"), F.avg("confidence").alias("avg_confidence"), F.avg("interest").alias("avg_interest"))


def describe_rule() -> Column:
    """A rule in one line, metrics with four decimals."""
    return F.format_string("{%s} -> %s [s=%.4f, c=%.4f, i=%.4f]", F.array_join(F.transform("antecedent", lambda x: x.cast("string")), ", "),
                           F.col("consequent").cast("string"), F.col("support"), F.col("confidence"), F.col("interest"))


def fpgrowth_itemsets(baskets: DataFrame, min_support: float) -> DataFrame:
    """The same sets by FP-growth, as a cross-check: ``size, items, cnt``."""
    from pyspark.ml.fpm import FPGrowth

    found = FPGrowth(itemsCol="items", minSupport=min_support).fit(baskets.select(F.array_distinct("items").alias("items"))).freqItemsets
    return found.select(F.size("items").alias("size"), F.array_sort("items").alias("items"), F.col("freq").alias("cnt"))
