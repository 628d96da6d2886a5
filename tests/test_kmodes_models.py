"""k-modes invariants and model training/persistence on small frames."""

import os

from pyspark.sql import functions as F

from casebook.operators import kmodes as KM
from casebook.operators import models as MD
from casebook.plans import training as TR
from casebook.session import scratch_path

COLS = ["a", "b", "c"]


def _planted(spark):
    rows = []
    for i in range(60):
        rows.append((i, "x", "p", "u") if i % 3 == 0 else
                    (i, "y", "q", "v") if i % 3 == 1 else (i, "z", "r", "w"))
    rows += [(100, "x", "q", "w"), (101, None, "p", "u")]
    return spark.createDataFrame(rows, "id int, a string, b string, c string")


def test_planted_clusters_recovered(spark):
    df = _planted(spark)
    m = KM.fit(df, COLS, 3, n_init=3)
    assert sorted(map(tuple, m.modes)) == [("x", "p", "u"), ("y", "q", "v"), ("z", "r", "w")]
    a = m.assign(df, keep=["id"])
    # rows of a planted group share one cluster
    groups = a.where(F.col("id") < 60).groupBy((F.col("id") % 3).alias("g")).agg(
        F.countDistinct("cluster").alias("k")).collect()
    assert all(r["k"] == 1 for r in groups)
    assert m.cost == 2 + 1                     # the two odd rows: distances 2 and 1 ('nan')


def test_cost_never_increases_and_rerun_is_stable(spark):
    df = _planted(spark)
    t = KM.collapse(df, COLS)
    modes = [["x", "q", "w"], ["x", "p", "u"]]
    c0 = KM.cost_of(t, COLS, modes)
    new, _ = KM._update_many(t, COLS, {0: modes})[0]
    assert KM.cost_of(t, COLS, new) <= c0
    m1, m2 = KM.fit(df, COLS, 2, n_init=2), KM.fit(df, COLS, 2, n_init=2)
    assert m1.modes == m2.modes and m1.cost == m2.cost


def test_assignment_ties_go_to_lowest_id(spark):
    df = spark.createDataFrame([("x", "q", "u")], "a string, b string, c string")
    a = KM.assign(df, COLS, [["x", "p", "u"], ["x", "q", "w"]]).first()
    assert a["cluster"] == 0 and a["distance"] == 1


def test_profiles_and_elbow(spark):
    df = _planted(spark)
    m = KM.fit(df, COLS, 4, n_init=2)
    p = KM.profiles(m.assign(df), COLS, 4).collect()
    assert len(p) == 4 and abs(sum(r["pct"] for r in p) - 100) < 1e-9
    e = KM.elbow(df, COLS, [2, 3], n_init=2).collect()
    assert [r["k"] for r in e] == [2, 3] and e[1]["cost"] <= e[0]["cost"]
    assert KM.default_ks(4979) == [2, 3, 4, 5, 6, 7, 8] and KM.default_ks(150) == [2]
    assert KM.default_ks(99) == []
    assert KM.default_k(150) == 2


def _frame(spark):
    rows = [(i, float(i % 50), "A" if i % 3 else "B", "r%d" % (i % 4), i % 2) for i in range(400)]
    return spark.createDataFrame(rows, "record_id int, age double, g string, r string, label int")


def test_models_train_score_and_roundtrip(spark):
    p = TR.prepare(_frame(spark), ["age"], ["g", "r"], rate_key="r")
    train = p.frame.where(F.col("split") == "train")
    lr = MD.logistic_regression(train)
    coef = MD.coefficient_table(lr, p.features.vocab).collect()
    assert len(coef) == len(p.features.vocab.features)
    rf = MD.random_forest(train, MD.ForestParams(5, 3, 5, "sqrt", True))
    s = MD.score(rf, p.frame).collect()
    assert all(0.0 <= r["probability_1"] <= 1.0 for r in s)
    assert all(r["predicted"] == int(r["probability_1"] >= 0.5) for r in s)
    path = scratch_path(spark, "test-model")
    p.features.save(path)
    fm2 = TR.FeatureModel.load(path)
    assert fm2.vocab.features == p.features.vocab.features
    a = [r["features"] for r in p.features.encode(_frame(spark), ["record_id"]).orderBy("record_id").collect()]
    b = [r["features"] for r in fm2.encode(_frame(spark), ["record_id"]).orderBy("record_id").collect()]
    assert a == b


def test_out_of_fold_covers_every_row(spark):
    p = TR.prepare(_frame(spark), ["age"], ["g"])
    oof = MD.out_of_fold(p.frame, lambda d: MD.logistic_regression(d, max_iter=50))
    assert oof.count() == p.frame.count()
    cv = MD.cv_auc(oof).first()
    assert cv["folds"] == 5 and 0 <= cv["mean_auc"] <= 1


def test_minimum_rows_guard(spark):
    small = spark.createDataFrame([("x", "p", "u")] * 9, "a string, b string, c string")
    assert KM.fit_if_enough(small, COLS, 2) is None
    ok = spark.createDataFrame([("x", "p", "u")] * 10, "a string, b string, c string")
    assert KM.fit_if_enough(ok, COLS, 2, n_init=1).cost == 0


def test_a_fit_that_still_moves_raises(spark):
    import pytest
    df = _planted(spark)
    with pytest.raises(KM.NotConverged):
        KM.fit(df, COLS, 2, n_init=3, max_iter=0)
    assert KM.fit(df, COLS, 3, n_init=3).converged


def test_all_categories_without_top_k(spark):
    """k=None keeps rare categories apart, and NULL is the baseline."""
    rows = [(i, f"r{i % 30:02d}" if i % 31 else None, i % 2) for i in range(600)]
    df = spark.createDataFrame(rows, "record_id int, r string, label int")
    p = TR.prepare(df, [], ["r"], k=None)
    assert len(p.features.vocab.features) == 29 and "r_Other" not in p.features.vocab.features
    null = p.features.encode(df.where("r is null"), keep=["record_id"]).first()["features"]
    assert sum(null.toArray()) == 0
    path = scratch_path(spark, "test-nok")
    p.features.save(path)
    assert TR.FeatureModel.load(path).topk is None


def test_logistic_fit_is_optimal(spark):
    p = TR.prepare(_frame(spark), ["age"], ["g", "r"], k=None)
    train = p.frame.where(F.col("split") == "train")
    g = MD.logistic_gradient(MD.logistic_regression(train), train, p.features.vocab).collect()
    assert len(g) == len(p.features.vocab.features) and all(abs(r["gradient"]) < 1e-5 for r in g)
