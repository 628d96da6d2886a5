"""Distributed exact ranks / quantiles vs NumPy."""

import numpy as np
from pyspark.sql import functions as F

from casebook.operators.ranking import exact_quantile, kth_values, value_prefix_sums


def test_quantile_with_hot_value_and_nan(spark):
    rng = np.random.default_rng(1)
    vals = list(rng.normal(size=300)) + [3.25] * 200 + [float("nan")] * 5
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    clean = [v for v in vals if v == v]
    for q in (0.1, 0.5, 0.77, 1.0):
        assert abs(exact_quantile(df, "x", q) - float(np.quantile(clean, q))) < 1e-12
    ks = kth_values(df, "x", [1, 250, 500], pivots=8)
    s = sorted(clean)
    assert ks == {1: s[0], 250: s[249], 500: s[499]}


def test_value_prefix_sums_grouped(spark):
    rng = np.random.default_rng(2)
    rows = [(int(g), float(v), int(w)) for g, v, w in
            zip(rng.integers(0, 3, 400), rng.random(400), rng.integers(0, 5, 400))]
    seen = set()
    rows = [r for r in rows if (r[0], r[1]) not in seen and not seen.add((r[0], r[1]))]
    df = spark.createDataFrame(rows, "g int, v double, w int")
    out = value_prefix_sums(df, "v", ["w"], ["g"], buckets=16).collect()
    for g in range(3):
        part = sorted([r for r in rows if r[0] == g], key=lambda r: r[1])
        want = {r[1]: (i + 1, c) for i, (r, c) in enumerate(zip(part, np.cumsum([r[2] for r in part])))}
        got = {r["v"]: (r["position"], r["cum_w"]) for r in out if r["g"] == g}
        assert got == want


def test_value_prefix_sums_quantile_buckets(spark):
    rng = np.random.default_rng(5)
    vals = sorted(set(float(v) for v in np.r_[0.5 + rng.random(300) * 1e-7, rng.random(100)]))
    rows = [(v, int(i % 3)) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "v double, w int")
    out = {r["v"]: (r["position"], r["cum_w"]) for r in
           value_prefix_sums(df, "v", ["w"], buckets=32).collect()}
    want = {v: (i + 1, c) for i, (v, c) in enumerate(zip(vals, np.cumsum([w for _, w in rows])))}
    assert out == want


def test_quantile_of_infinite_values_and_heavy_tails(spark):
    inf = float("inf")
    x = lambda vals: spark.createDataFrame([(float(v),) for v in vals], "x double")
    assert exact_quantile(x([1, 2, inf]), "x", 0.5) == 2.0
    assert exact_quantile(x([-inf, -inf, 5, inf]), "x", 0.25) == -inf
    assert exact_quantile(x([inf] * 50), "x", 0.5) == inf
    assert exact_quantile(x([]), "x", 0.5) is None
    tail = [10.0 ** (i / 40) for i in range(-6000, 6000, 7)] + [-(10.0 ** (i / 40)) for i in range(0, 6000, 11)] + [0.0] * 5
    for q in (0.0, 0.31, 0.5, 0.999, 1.0):
        assert exact_quantile(x(tail), "x", q) == float(np.quantile(np.array(tail), q))
    s = sorted(tail)
    assert kth_values(x(tail), "x", [1, 7, len(s)], pivots=4) == {1: s[0], 7: s[6], len(s): s[-1]}


def test_ranks_of_null_strata_are_kept(spark):
    from casebook.operators.ranking import first_by_hash, hash_rank
    df = spark.createDataFrame([(i, None if i % 3 == 0 else i % 2) for i in range(30)], "id int, y int")
    got = hash_rank(df, ["id"], 1, strata=["y"]).collect()
    assert len(got) == 30
    assert sorted(r["rank"] for r in got if r["y"] is None) == list(range(1, 11))
    first = first_by_hash(df, ["id"], 1, ["y"], lambda n: n - n + 2).where("_first").collect()
    assert sorted(str(r["y"]) for r in first) == ["0", "0", "1", "1", "None", "None"]
    sums = value_prefix_sums(df.withColumn("v", F.col("id").cast("double")).withColumn("w", F.lit(1)), "v", ["w"], ["y"], buckets=3)
    assert sorted(r["cum_w"] for r in sums.where("y is null").collect()) == list(range(1, 11))


def test_crowded_scores_spread_over_the_buckets(spark):
    """No bucket of a crowded, logistic-shaped score holds twice the mean."""
    import casebook.operators.ranking as RK
    rng = np.random.default_rng(3)
    vals = np.unique(1 / (1 + np.exp(-rng.normal(-6, 2, 20000))))
    df = spark.createDataFrame([(float(v), 1) for v in vals], "v double, w int")
    seen = {}
    join = RK._join_offsets

    def spy(d, offsets, groups, bucket):
        seen["n"] = [r["count"] for r in d.groupBy(bucket).count().collect()]
        return join(d, offsets, groups, bucket)
    RK._join_offsets = spy
    try:
        value_prefix_sums(df, "v", ["w"], buckets=64).count()
    finally:
        RK._join_offsets = join
    assert len(seen["n"]) >= 60 and max(seen["n"]) < 2 * sum(seen["n"]) / len(seen["n"])
