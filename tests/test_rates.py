"""Rate tables and profiles: N2-N4, N10, rounding, ties, empty groups."""

from pyspark.sql import functions as F

from casebook.operators import rates


def _cases(spark):
    rows = [(1, "a", 1), (2, "a", 0), (3, "a", None), (4, "b", 1), (5, None, 1),
            (6, "b", 1), (7, "c", None)]
    return spark.createDataFrame(rows, "id int, k string, y int")


def test_rate_table_null_keys_and_counts(spark):
    t = {r["k"]: (r["cases"], r["rate"]) for r in rates.rate_table(_cases(spark), "k", "y").collect()}
    assert None not in t                      # N2
    assert t["a"] == (2, 0.5)                 # N3: count of non-null labels
    assert t["c"] == (0, None)
    t_all = {r["k"]: r["cases"] for r in rates.rate_table(_cases(spark), "k", "y",
                                                          count_all=True).collect()}
    assert t_all["a"] == 3                    # N4


def test_round_half_even(spark):
    # 3 of 8 = 0.375 -> 0.38? half-even on 3 places: 0.375 -> 0.375; use 1/8=0.125 at 2 places
    df = spark.createDataFrame([(0.125,), (0.135,)], "v double")
    out = [r[0] for r in df.select(F.bround("v", 2)).collect()]
    assert out[0] == 0.12


def test_summary_counts_open_two_ways(spark):
    r = rates.outcome_summary(_cases(spark), "y").first()
    assert r["n_rows"] == 7 and r["n_solved"] == 4 and r["n_open"] == 1
    assert r["n_open_all"] == 3 and r["n_labelled"] == 5


def test_modes_ties_smallest_and_empty(spark):
    df = spark.createDataFrame([("g", "b"), ("g", "a"), ("g", "b"), ("g", "a"), ("h", None)],
                               "g string, v string")
    m = {r["g"]: r["mode_v"] for r in rates.modes(df, ["v"], by=["g"]).collect()}
    assert m == {"g": "a", "h": "N/A"}        # N10 and the empty case


def test_missing_profile(spark):
    t = {r["column"]: r["missing_pct"] for r in
         rates.missing_profile(_cases(spark), ["k", "y", "id"]).collect()}
    assert set(t) == {"k", "y"}
    assert abs(t["y"] - 200 / 7) < 1e-9


def test_share_of_total_lists_empty_groups(spark):
    df = spark.createDataFrame([(0,), (0,), (2,)], "c int")
    keys = spark.range(3).select(F.col("id").cast("int").alias("c"))
    t = {r["c"]: (r["size"], r["pct"]) for r in rates.share_of_total(df, "c", keys).collect()}
    assert t[1] == (0, 0.0) and t[0][0] == 2


def test_head_tail_both_ends_ties_by_key(spark):
    df = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("c", 0.9), ("d", 0.1), ("e", 0.5)],
                               "k string, v double")
    assert [r["k"] for r in rates.head(df, 3, "v", "k").orderBy("rank").collect()] == ["c", "a", "b"]
    assert [r["k"] for r in rates.tail(df, 2, "v", "k").orderBy("rank").collect()] == ["e", "d"]
    be = rates.both_ends(df, 1, "v", "k").collect()
    assert {(r["side"], r["k"]) for r in be} == {("top", "c"), ("bottom", "d")}


def test_rate_tables_long_top_and_others(spark):
    rows = [(i, f"c{i % 7}", i % 2) for i in range(70)]
    df = spark.createDataFrame(rows, "id int, f string, y int")
    t = rates.rate_tables_long(df, ["f"], "y", top=5).collect()
    assert len(t) == 5 and all(r["other_categories"] == 2 for r in t)
    assert all(r["cases"] == 10 for r in t)


def test_distribution_stats_exact_median(spark):
    import numpy as np
    vals = [float(x) for x in [5, 1, 9, 3, 3, 7, 100, 2]]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    r = rates.distribution_stats(df, "x").first()
    assert r["median"] == float(np.median(vals)) and r["min"] == 1 and r["max"] == 100
