"""Feature encoders and exact splits: N8, N9, Q1-Q4, ties at rank K."""

import pandas as pd
from pyspark.sql import functions as F

from casebook.operators import features as FE
from casebook.operators import split as SP
from casebook.operators.ranking import hash_rank


def test_topk_ties_at_rank_k_and_nulls(spark):
    # 16 categories: c00..c13 twice each, c14 and c15 once -> tie at rank 15
    rows = [(f"c{i:02d}",) for i in range(14) for _ in range(2)] + [("c15",), ("c14",), (None,)]
    df = spark.createDataFrame(rows, "v string")
    m = FE.fit_topk(df, ["v"], k=15)
    assert len(m.keep["v"]) == 15 and m.keep["v"][-1] == "c14"   # ties by value asc
    out = [r[0] for r in m.apply(df).collect()]
    assert out.count("Other") == 2                               # c15 and NULL


def test_semi_join_topk(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "v string")
    m = FE.fit_topk(df, ["v"], k=1)
    assert FE.semi_join_topk(df, m, "v").count() == 2


def test_target_encoder_fallback(spark):
    train = spark.createDataFrame([("x", 1), ("x", 0), ("y", 1), ("z", None)], "k string, y int")
    m = FE.fit_target_encoder(train, "k", "y")
    new = spark.createDataFrame([("x",), ("unseen",), (None,), ("z",)], "k string")
    got = [r["k_rate"] for r in m.apply(new).orderBy(F.col("k").asc_nulls_last()).collect()]
    gm = 2 / 3
    # x -> 0.5; unseen, z (no labels) and NULL -> global mean
    assert sorted(got) == sorted([0.5, gm, gm, gm])


def test_vocab_drop_first_and_unseen_is_baseline(spark):
    df = spark.createDataFrame([(1.0, "b"), (2.0, "a"), (3.0, "c")], "n double, s string")
    v = FE.fit_vocab(df, ["n"], ["s"], drop_first=True)
    assert v.features == ["n", "s_b", "s_c"]
    # Q1/Q2: a single row or an unseen value still encodes against the stored vocabulary
    one = spark.createDataFrame([(5.0, "zzz"), (5.0, "c")], "n double, s string")
    enc = v.apply(one).collect()
    assert [tuple(r) for r in enc] == [(5.0, 0.0, 0.0), (5.0, 0.0, 1.0)]
    keep_all, _ = FE.onehot_all(df, ["s"])
    assert keep_all.features == ["s_a", "s_b", "s_c"]


def test_impute_mode_and_minmax(spark):
    df = spark.createDataFrame([("Unknown",), ("Gun",), ("Gun",), ("Knife",), (None,)], "w string")
    out = [r[0] for r in FE.impute_mode(df, "w").collect()]
    assert out == ["Gun", "Gun", "Gun", "Knife", None]
    same = spark.createDataFrame([(2000,), (2000,)], "y int")
    assert [r["yn"] for r in FE.minmax(same, "y", "yn").collect()] == [None, None]


def test_label_codes_nan_category(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",)], "v string")
    c = FE.fit_label_codes(df, ["v"])
    assert c.values["v"] == ["a", "b", "nan"]                     # N9
    assert [r["v_code"] for r in c.apply(df).collect()] == [1, 2, 0]


def _brute_rank(pdf, seed, strata):
    import hashlib
    pdf = pdf.copy()
    pdf["h"] = [hashlib.md5(f"{k}|{seed}".encode()).hexdigest() for k in pdf["id"]]
    pdf = pdf.sort_values(["h", "id"])
    if strata:
        pdf["rank"] = pdf.groupby(strata).cumcount() + 1
    else:
        pdf["rank"] = range(1, len(pdf) + 1)
    return dict(zip(pdf["id"], pdf["rank"]))


def test_hash_rank_matches_brute_force(spark):
    rows = [(i, i % 3) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, g int")
    got = {r["id"]: r["rank"] for r in hash_rank(df, ["id"], 42, ["g"], prefix_hex=2).collect()}
    want = _brute_rank(pd.DataFrame(rows, columns=["id", "g"]), 42, ["g"])
    assert got == want
    got0 = {r["id"]: r["rank"] for r in hash_rank(df, ["id"], 7).collect()}
    assert got0 == _brute_rank(pd.DataFrame(rows, columns=["id", "g"]), 7, [])


def test_exact_sample_and_stratified_split(spark):
    rows = [(i, 1 if i % 4 == 0 else 0) for i in range(1001)]
    df = spark.createDataFrame(rows, "id int, y int")
    assert SP.exact_sample(df, ["id"], 0.3).count() == round(0.3 * 1001)
    s = SP.stratified_split(df, ["id"], "y")
    c = {(r["y"], r["split"]): r["count"] for r in s.groupBy("y", "split").count().collect()}
    n1, n0 = 251, 750
    import math
    assert c[(1, "test")] == math.ceil(0.3 * n1) and c[(0, "test")] == math.ceil(0.3 * n0 - 1e-9)
    assert s.count() == 1001                                      # train + test = all
    again = {r["id"]: r["split"] for r in SP.stratified_split(df, ["id"], "y").collect()}
    assert again == {r["id"]: r["split"] for r in s.collect()}    # reproducible
    f = SP.stratified_folds(df, ["id"], "y", k=5)
    sizes = [r["count"] for r in f.groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 2


def test_class_weights(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,), (None,)], "y int")
    w = {r["y"]: r["weight"] for r in SP.class_weights(df, "y").collect()}
    assert w == {1: 4 / 2, 0: 4 / 6}


def test_vocab_size_is_checked(spark):
    import pytest
    df = spark.range(50).selectExpr("cast(id as string) as v")
    with pytest.raises(FE.TooManyCategories):
        FE.fit_vocab(df, [], ["v"], max_categories=10)
    m = FE.fit_topk(df, ["v"], k=5)
    assert len(FE.fit_vocab(m.apply(df), [], ["v"], max_categories=10).features) == 5


def test_split_and_folds_agree_with_separate_passes(spark):
    rows = [(i, 1 if i % 5 == 0 else 0) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, y int")
    both = {r["id"]: (r["split"], r["fold"]) for r in SP.split_and_folds(df, ["id"], "y").collect()}
    s = {r["id"]: r["split"] for r in SP.stratified_split(df, ["id"], "y").collect()}
    f = {r["id"]: r["fold"] for r in SP.stratified_folds(df, ["id"], "y").collect()}
    assert both == {i: (s[i], f[i]) for i in s}


def test_first_by_hash_matches_rank_cut(spark):
    from casebook.operators.ranking import first_by_hash
    rows = [(i * 7919, i % 3) for i in range(600)]
    df = spark.createDataFrame(rows, "id bigint, g int")
    want = _brute_rank(pd.DataFrame(rows, columns=["id", "g"]), 5, ["g"])
    for frac in (0.0, 0.37, 1.0):
        got = {r["id"]: r["_first"] for r in first_by_hash(
            df, ["id"], 5, ["g"], lambda n: F.ceil(n * frac - 1e-9), prefix_hex=2).collect()}
        n_by_g = {g: sum(1 for _, x in rows if x == g) for g in range(3)}
        import math
        exp = {i: want[i] <= math.ceil(n_by_g[g] * frac - 1e-9) for i, g in rows}
        assert got == exp
