"""Itemsets and rules against brute-force enumeration and FPGrowth."""

from itertools import combinations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import functions as F

from casebook.operators import itemsets as IS

ROWS = [("x", "p", "u"), ("x", "p", None), ("x", "q", "u"), ("y", "p", "u"),
        ("x", "p", "u"), (None, "p", "v"), ("y", "q", "v"), ("x", "p", "u")]
COLS = ["a", "b", "c"]


def _brute(min_support):
    n = len(ROWS)
    counts = {}
    for r in ROWS:
        items = [f"{c}_{v}" for c, v in zip(COLS, r) if v is not None]
        for j in (1, 2, 3):
            for s in combinations(sorted(items), j):
                counts[s] = counts.get(s, 0) + 1
    return {s: c / n for s, c in counts.items() if c >= min_support * n}


def test_itemsets_match_brute_force(spark):
    df = spark.createDataFrame(ROWS, "a string, b string, c string")
    got = {tuple(r["items"]): r["support"] for r in
           IS.frequent_itemsets(df, COLS, min_support=0.25).collect()}
    assert got == _brute(0.25)


def test_itemsets_match_fpgrowth(spark):
    df = spark.createDataFrame(ROWS, "a string, b string, c string")
    mine = {tuple(r["items"]) for r in IS.frequent_itemsets(df, COLS, 0.25).collect()}
    baskets = df.select(F.array_compact(F.array(*[
        F.when(F.col(c).isNotNull(), F.concat(F.lit(c + "_"), F.col(c))) for c in COLS]))
        .alias("items"))
    fp = FPGrowth(itemsCol="items", minSupport=0.25).fit(baskets)
    theirs = {tuple(sorted(r["items"])) for r in fp.freqItemsets.collect() if len(r["items"]) <= 3}
    assert mine == theirs


def test_rules_metrics(spark):
    df = spark.createDataFrame(ROWS, "a string, b string, c string")
    its = IS.frequent_itemsets(df, COLS, 0.25)
    sup = _brute(0.25)
    rules = IS.association_rules(its, min_lift=0.0).collect()
    n_expected = sum(2 ** len(s) - 2 for s in sup if len(s) >= 2)
    assert len(rules) == n_expected                        # every split, multi-item consequents
    for r in rules:
        a, c = tuple(r["antecedents"]), tuple(r["consequents"])
        s = sup[tuple(sorted(a + c))]
        conf = s / sup[a]
        assert abs(r["confidence"] - conf) < 1e-12
        assert abs(r["lift"] - conf / sup[c]) < 1e-12
        assert abs(r["leverage"] - (s - sup[a] * sup[c])) < 1e-12
        if conf == 1:
            assert r["conviction"] is None
    kept = IS.association_rules(its, min_lift=1.2).collect()
    assert all(r["lift"] >= 1.2 for r in kept)


def test_itemset_bound():
    assert IS.itemset_bound(5, 3, 0.01) == 2500


def test_empty_input(spark):
    df = spark.createDataFrame([], "a string, b string, c string")
    assert IS.frequent_itemsets(df, COLS).count() == 0


def test_basket_itemsets_equal_column_itemsets(spark):
    df = spark.createDataFrame(ROWS + [(None, None, None)], "a string, b string, c string")
    baskets = df.select(F.array_compact(F.array(*[
        F.when(F.col(c).isNotNull(), F.concat(F.lit(c + "_"), F.col(c))) for c in COLS]))
        .alias("items"))
    a = {r["items_text"]: (r["n"], r["support"]) for r in IS.frequent_itemsets(df, COLS, 0.25).collect()}
    b = {r["items_text"]: (r["n"], r["support"]) for r in IS.basket_itemsets(baskets, "items", 0.25).collect()}
    assert a == b


def brute_baskets(baskets, least, max_len):
    from itertools import combinations
    from collections import Counter
    out, items = Counter(), sorted({x for b in baskets for x in b})
    for size in range(1, (max_len or len(items)) + 1):
        for b in baskets:
            for c in combinations(sorted(set(b)), size):
                out[c] += 1
    return {c: n for c, n in out.items() if n >= least}


def test_basket_itemsets_level_by_level(spark):
    """Blocks of baskets, items in few of them, levels that end early, NULLs and repeats."""
    import random
    rng = random.Random(4)
    rows = [[rng.choice("abcdefgh") for _ in range(rng.randint(0, 6))] for _ in range(3000)] + [["z", "y", "x"]] * 40
    df = spark.createDataFrame([(b,) for b in rows] + [(None,)] * 10 + [([None, "a", "a"],)], "items array<string>").repartition(3)
    rows = rows + [[]] * 10 + [["a"]]
    for max_len, support in ((1, 0.05), (2, 0.05), (3, 0.01), (None, 0.03)):
        least = -(-support * len(rows) // 1)
        got = {tuple(r["items"]): (r["n"], r["support"]) for r in IS.basket_itemsets(df, min_support=support, max_len=max_len).collect()}
        want = brute_baskets(rows, least, max_len)
        assert {c: n for c, (n, _) in got.items()} == want
        assert all(abs(s - n / len(rows)) < 1e-12 for n, s in got.values())
    assert IS.basket_itemsets(df.limit(0)).collect() == []


def test_candidates_are_pruned(spark):
    level = spark.createDataFrame([(["a", "b"], 5), (["a", "c"], 5), (["b", "c"], 5), (["b", "d"], 5)], "items array<string>, n long")
    assert [r["items"] for r in IS._candidates(level, 3).collect()] == [["a", "b", "c"]]
