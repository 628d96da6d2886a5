"""Frequent itemsets and multi-item association rules.

Items are ``<column>_<value>`` (one-hot names); a NULL contributes no item.

Plan: the rows are first collapsed to distinct attribute tuples with a count
(one partial + final hash aggregate: a hot tuple is a single row per task
before the shuffle), then ``GROUPING SETS`` over every column subset of size
1..max_len runs on the tuples only.  Support is inclusive (``n >= s * N``).

Size bound used for broadcasts: each row supports at most
``sum(C(m, j), j <= max_len)`` itemsets, and every kept itemset has at least
``s * N`` rows, so there are at most ``sum(C(m, j)) / s`` itemsets (2500 for
5 columns, length 3, s = 0.01) — independent of the data size.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, comb
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook import presets as P
from casebook.plans.joins import broadcast_if_small
from casebook.session import cut_lineage


def itemset_bound(n_cols: int, max_len: int, min_support: float) -> int:
    return int(sum(comb(n_cols, j) for j in range(1, max_len + 1)) / min_support)


def frequent_itemsets(df: DataFrame, cols: Sequence[str],
                      min_support: float = P.ITEMSET_MIN_SUPPORT,
                      max_len: int = P.ITEMSET_MAX_LEN, sep: str = "_") -> DataFrame:
    """Columns: items (sorted array<string>), items_text, size, n, support."""
    cols = list(cols)
    total = df.count()
    if total == 0:
        return df.sparkSession.createDataFrame(
            [], "items array<string>, items_text string, size int, n bigint, support double")
    tuples = (df.select(*[F.col(c).cast("string").alias(c) for c in cols])
                .groupBy(*cols).agg(F.count(F.lit(1)).alias("_w")))
    sets = [list(s) for j in range(1, max_len + 1) for s in combinations(cols, j)]
    g = (tuples.groupingSets(sets, *cols)
               .agg(F.sum("_w").alias("n"), *[F.grouping(c).alias(f"_g_{c}") for c in cols]))
    # a grouped column holding NULL is not an item: drop that group
    for c in cols:
        g = g.where(~((F.col(f"_g_{c}") == 0) & F.col(c).isNull()))
    g = g.where(F.col("n") >= F.lit(min_support * total))
    items = F.array_compact(F.array(*[
        F.when(F.col(f"_g_{c}") == 0, F.concat(F.lit(c + sep), F.col(c))) for c in cols]))
    out = (g.select(F.sort_array(items).alias("items"), F.col("n").cast("long").alias("n"))
            .withColumn("items_text", F.array_join("items", ", "))
            .withColumn("size", F.size("items"))
            .withColumn("support", F.col("n") / F.lit(float(total))))
    return out.select("items", "items_text", "size", "n", "support")


def association_rules(itemsets: DataFrame, min_lift: float = P.RULE_MIN_LIFT,
                      broadcast_rows: int = 100_000) -> DataFrame:
    """Every split of every itemset of size >= 2 into antecedent and
    consequent (multi-item consequents; Spark ML's FPGrowth only gives single
    items), with the support of both sides joined from ``itemsets``; keeps
    ``lift >= min_lift``.  The lookups are broadcast joins if the itemsets are at
    most ``broadcast_rows`` (checked), else the planner's.
    """
    itemsets = cut_lineage(itemsets)  # read by three branches
    sup = itemsets.select("items_text", "support")
    multi = itemsets.where(F.col("size") >= 2)
    # one row per non-empty proper subset: bit i of _mask puts item i on the left
    masks = multi.withColumn(
        "_mask", F.explode(F.sequence(F.lit(1), F.pow(2, F.col("size")).cast("int") - 2)))
    splits = masks.select(
        F.expr("filter(items, (x, i) -> ((_mask >> i) & 1) = 1)").alias("antecedents"),
        F.expr("filter(items, (x, i) -> ((_mask >> i) & 1) = 0)").alias("consequents"),
        "support")
    splits = (splits.withColumn("_a", F.array_join("antecedents", ", "))
                    .withColumn("_c", F.array_join("consequents", ", ")))
    sup = broadcast_if_small(sup, broadcast_rows)
    a = sup.select(F.col("items_text").alias("_a"), F.col("support").alias("antecedent_support"))
    c = sup.select(F.col("items_text").alias("_c"), F.col("support").alias("consequent_support"))
    r = splits.join(a, "_a", "inner").join(c, "_c", "inner")
    conf = F.col("support") / F.col("antecedent_support")
    r = (r.withColumn("confidence", conf)
          .withColumn("lift", F.col("confidence") / F.col("consequent_support"))
          .withColumn("leverage", F.col("support")
                      - F.col("antecedent_support") * F.col("consequent_support"))
          .withColumn("conviction", F.when(F.col("confidence") < 1,
                      (1 - F.col("consequent_support")) / (1 - F.col("confidence")))))
    return (r.where(F.col("lift") >= min_lift)
             .select("antecedents", "consequents", "antecedent_support", "consequent_support",
                     "support", "confidence", "lift", "leverage", "conviction"))


def top_rules(rules: DataFrame, n: int = 10, show_items: int = 2) -> DataFrame:
    """Top ``n`` rules by lift (ties: antecedent then consequent text) with
    the first ``show_items`` items of each side as text (H6)."""
    a = F.array_join("antecedents", ", ")
    c = F.array_join("consequents", ", ")
    t = (rules.withColumn("_a", a).withColumn("_c", c)
              .orderBy(F.col("lift").desc(), F.col("_a"), F.col("_c")).limit(n))
    from pyspark.sql import Window
    w = Window.orderBy(F.col("lift").desc(), F.col("_a"), F.col("_c"))  # over n rows
    return t.select(
        F.row_number().over(w).alias("rank"),
        F.array_join(F.slice("antecedents", 1, show_items), ", ").alias("antecedents_head"),
        F.array_join(F.slice("consequents", 1, show_items), ", ").alias("consequents_head"),
        "lift", "support")


def rules_for_csv(rules: DataFrame) -> DataFrame:
    """A5: arrays as joined text so the table can be written as CSV."""
    return (rules.withColumn("antecedents", F.array_join("antecedents", ", "))
                 .withColumn("consequents", F.array_join("consequents", ", ")))


#: Baskets whose items share a bitmap: 16 words of 64 bits.
BLOCK_BITS, WORDS = 10, 16


def _bitmaps(baskets: DataFrame, frequent: DataFrame) -> DataFrame:
    """(block, item, bits): which of a block's baskets hold a frequent item.  An item that
    is in none of them has no row."""
    bit = (F.col("_id") % (1 << BLOCK_BITS)).cast("int")
    long = (baskets.select(F.shiftright("_id", BLOCK_BITS).alias("block"), bit.alias("bit"), F.explode("items").alias("item"))
            .join(frequent, "item"))
    one = F.expr("shiftleft(1L, bit % 64)")
    words = [F.bit_or(F.when(F.floor(F.col("bit") / 64) == w, one).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in range(WORDS)]
    return long.groupBy("block", "item").agg(*words).select("block", "item", F.array(*[f"w{w}" for w in range(WORDS)]).alias("bits"))


def _candidates(level: DataFrame, size: int) -> DataFrame:
    """(items, head, item): sets of ``size`` items whose subsets are all frequent, from two
    frequent sets that differ in the last item."""
    a = level.select(F.slice("items", 1, size - 2).alias("prefix"), F.col("items").alias("head"), F.element_at("items", -1).alias("last"))
    b = a.select(F.col("prefix").alias("prefix_b"), F.col("last").alias("item"))
    pairs = a.join(b, (F.col("prefix") == F.col("prefix_b")) & (F.col("last") < F.col("item"))).select(
        F.concat("head", F.array("item")).alias("items"), "head", "item")
    if size == 2:
        return pairs
    parts = pairs.select("items", F.explode(F.transform(F.sequence(F.lit(1), F.lit(size)), lambda k: F.filter(
        "items", lambda x, i: i + 1 != k))).alias("part"))
    whole = (parts.join(level.select(F.col("items").alias("part")), "part", "left_semi")
             .groupBy("items").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == size).select("items"))
    return pairs.join(whole, "items", "left_semi")


def basket_itemsets(baskets: DataFrame, items_col: str = "items",
                    min_support: float = P.ITEMSET_MIN_SUPPORT,
                    max_len: int | None = P.ITEMSET_MAX_LEN, broadcast_rows: int = 100_000) -> DataFrame:
    """D12 for generic baskets (an array column of any length), level by level.

    Frequent items get a bitmap per block of 1024 baskets.  The sets of the next level
    are joined from two frequent ones that share all items but the last, those with an
    infrequent subset are left out, and a set's bitmap in a block is the AND of its
    head's and its last item's; its support is the bits of all blocks.  No set longer
    than ``max_len`` is ever made.  Items are de-duplicated per basket and NULL items
    left out; NULL and empty baskets count in the number of baskets; the threshold is
    inclusive, ``ceil(min_support * baskets)``."""
    items = F.array_sort(F.array_distinct(F.array_compact(F.coalesce(F.col(items_col).cast("array<string>"), F.array().cast("array<string>")))))
    b = cut_lineage(baskets.select(items.alias("items")).withColumn("_id", F.monotonically_increasing_id()))
    total = b.count()
    least = max(1, ceil(min_support * total))
    ones = b.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    level = cut_lineage(ones.select(F.array("item").alias("items"), F.col("n").cast("long").alias("n")))
    out, size = level, 1
    if max_len is None or max_len > 1:
        single = cut_lineage(_bitmaps(b, broadcast_if_small(level.select(F.col("items")[0].alias("item")), broadcast_rows)))
        maps = single.select("block", F.array("item").alias("items"), "bits")
    while (max_len is None or size < max_len) and not level.isEmpty():
        size += 1
        cand = _candidates(level, size)
        both = (maps.withColumnRenamed("items", "head").join(broadcast_if_small(cand, broadcast_rows), "head")
                .join(single.select("block", "item", F.col("bits").alias("more")), ["block", "item"])
                .select("block", "items", F.zip_with("bits", "more", lambda x, y: x.bitwiseAND(y)).alias("bits")))
        maps = cut_lineage(both.where(F.exists("bits", lambda x: x != 0)))
        count = F.aggregate("bits", F.lit(0), lambda acc, x: acc + F.bit_count(x))
        level = cut_lineage(maps.groupBy("items").agg(F.sum(count).cast("long").alias("n")).where(F.col("n") >= least))
        maps = maps.join(broadcast_if_small(level.select("items"), broadcast_rows), "items", "left_semi")
        out = out.unionByName(level)
    return out.select("items", F.array_join("items", ", ").alias("items_text"), F.size("items").alias("size"), "n",
                      (F.col("n") / F.lit(float(total or 1))).alias("support"))
