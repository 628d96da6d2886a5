"""Plan shape (pruning, partial aggregation, per-partition top-k, bounded
broadcasts) and correctness when one key holds a third of the rows."""

import numpy as np
from pyspark.sql import functions as F

from casebook.operators import evaluate as EV
from casebook.operators import itemsets as IS
from casebook.operators import rates
from casebook.operators.ranking import exact_quantile, hash_rank
from casebook.sources.cases import tpch_cases

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_cases_scan_is_pruned_and_filtered(spark):
    plan = tpch_cases(spark, SF)._jdf.queryExecution().executedPlan().toString()
    # lineitem is read for two columns only
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in plan
    assert "PushedFilters: [IsNotNull(l_orderkey)]" in plan


def test_rate_table_aggregates_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), (F.col("id") % 2).alias("y"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = _plan(rates.rate_table(df, "k", "y"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "partial_avg" in plan and "Exchange hashpartitioning" in plan


def test_topk_per_group_is_limited_before_the_shuffle(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("a"),
                                  (F.col("id") % 3).cast("string").alias("b"),
                                  (F.col("id") % 2).alias("y"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = _plan(rates.rate_tables_long(df, ["a", "b"], "y", top=5))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("WindowGroupLimit") >= 2   # partial before, final after the exchange


def _skewed(spark, n=3000):
    # one key holds a third of all rows
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 97}", float(i % 11), i % 2) for i in range(n)]
    return spark.createDataFrame(rows, "id int, k string, v double, y int"), rows


def test_hot_key_results_are_whole(spark):
    df, rows = _skewed(spark)
    t = {r["k"]: r["cases"] for r in rates.rate_table(df, "k", "y").collect()}
    assert t["hot"] == 1000 and sum(t.values()) == len(rows)
    m = {r["k"]: r["mode_v"] for r in rates.modes(df, ["v"], by=["k"]).collect()}
    vals = [r[2] for r in rows if r[1] == "hot"]
    counts = {v: vals.count(v) for v in set(vals)}
    best = min(counts, key=lambda v: (-counts[v], str(v)))
    assert m["hot"] == str(best)
    r = hash_rank(df, ["id"], 42, strata=["y"])
    ranks = sorted(x["rank"] for x in r.where(F.col("y") == 0).collect())
    assert ranks == list(range(1, 1501))


def test_quantile_and_auc_with_hot_value(spark):
    rows = [(1 if i % 2 else 0, 0.5 if i % 3 == 0 else (i % 101) / 100.0) for i in range(3000)]
    df = spark.createDataFrame(rows, "y int, s double")
    s = np.array([r[1] for r in rows])
    assert exact_quantile(df, "s", 0.5) == float(np.median(s))
    y = np.array([r[0] for r in rows])
    pos, neg = s[y == 1], s[y == 0]
    want = (np.sum(pos[:, None] > neg[None, :]) + 0.5 * np.sum(pos[:, None] == neg[None, :])) / (len(pos) * len(neg))
    assert abs(EV.auc(df, "y", "s").first()["auc"] - want) < 1e-12


def test_itemsets_with_hot_tuple(spark):
    rows = [("a", "x")] * 1000 + [(f"b{i % 5}", f"y{i % 3}") for i in range(2000)]
    df = spark.createDataFrame(rows, "c1 string, c2 string")
    its = {r["items_text"]: r["n"] for r in IS.frequent_itemsets(df, ["c1", "c2"], 0.01).collect()}
    assert its["c1_a, c2_x"] == 1000 and its["c1_a"] == 1000


def test_size_for_input_bounds(spark):
    from casebook.session import size_for_input
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions",
                                          "spark.sql.files.maxPartitionBytes")}
    try:
        big = size_for_input(spark, 100 * 1024 ** 4)
        assert int(big["spark.sql.shuffle.partitions"]) == 200_000
        small = size_for_input(spark, 10 << 20)
        assert int(small["spark.sql.shuffle.partitions"]) == spark.sparkContext.defaultParallelism * 2
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.initialPartitionNum")


def test_input_bytes_reads_filesystem_metadata(spark):
    import os
    from casebook.session import input_bytes
    want = sum(os.path.getsize(os.path.join(SF, f)) for f in os.listdir(SF))
    assert input_bytes(spark, SF) == want


def test_auc_with_crowded_scores(spark):
    rng = np.random.default_rng(9)
    n = 2000
    y = rng.integers(0, 2, n)
    s = np.where(rng.random(n) < 0.9, 0.5 + rng.random(n) * 1e-7, rng.random(n)) + y * 1e-8
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    pos, neg = s[y == 1], s[y == 0]
    want = (np.sum(pos[:, None] > neg[None, :]) + 0.5 * np.sum(pos[:, None] == neg[None, :])) / (len(pos) * len(neg))
    assert abs(EV.auc(df, "y", "s").first()["auc"] - want) < 1e-12


def test_training_frame_has_partitions_by_size(spark):
    """Tree learning sends node sums per partition: the frame isn't dealt by the shuffle
    setting, and a second query reads the stored one."""
    from casebook.plans import queries as Q
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        Q._PREP.clear()
        p = Q._prepared(spark, "/root/testdata/sf0.001", "rf")
        assert p.frame.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
        assert {"record_id", "label", "split", "fold", "weight", "features"} == set(p.frame.columns)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        Q.release()
