"""Forests grown from counted rows, against Spark's learner and plain sums."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from casebook.operators import evaluate as EV
from casebook.operators import forests as FO
from casebook.operators import growth as GR
from casebook.operators import models as MD
from casebook.operators import split as SP
from casebook.plans import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(8)
    data = []
    for i in range(1500):
        a, b, c = rng.randint(0, 9), rng.choice([-1.5, 0.0, 2.0]), rng.randint(0, 3)
        y = float(rng.random() < 0.2 + 0.05 * a + 0.2 * (b > 0) - 0.1 * (c == 2))
        data.append((i, i % 5, y, 1.7 if y else 0.6, [float(a), b, float(c == 1), float(c == 2), float(c == 3), float(i % 2)]))
    df = spark.createDataFrame(data, "id int, fold int, label double, weight double, x array<double>")
    return df.withColumn("features", array_to_vector("x")).drop("x").cache()


@pytest.fixture(scope="module")
def counted(rows):
    return GR.distinct_rows(rows, ["label", "fold", "weight"]).cache()


def test_distinct_rows_keep_their_number(rows, counted):
    assert counted.count() < rows.count() == counted.agg(F.sum("n")).first()[0]


@pytest.mark.parametrize("weighted", [False, True])
def test_a_tree_is_that_of_sparks_learner(rows, counted, weighted):
    params = MD.ForestParams(num_trees=1, max_depth=6, min_leaf=15, feature_subset="all", weighted=weighted, bootstrap=False)
    mine = MD.random_forest(counted, params, count="n")
    rf = RandomForestClassifier(numTrees=1, maxDepth=6, minInstancesPerNode=15, featureSubsetStrategy="all", bootstrap=False, seed=1)
    theirs = (rf.setWeightCol("weight") if weighted else rf).fit(rows)
    assert mine.totalNumNodes == theirs.totalNumNodes > 9
    a = {r["id"]: r["probability_1"] for r in MD.score(mine, rows).collect()}
    b = {r["id"]: r["probability_1"] for r in MD.score(theirs, rows).collect()}
    assert max(abs(a[i] - b[i]) for i in a) < 1e-12
    assert np.allclose(mine.featureImportances.toArray(), theirs.featureImportances.toArray(), atol=1e-12)


def test_scores_and_importances_are_those_of_the_spark_model(rows, counted):
    params = MD.ForestParams(num_trees=7, max_depth=5, min_leaf=5, feature_subset="sqrt", weighted=True)
    mine = MD.random_forest(counted, params, count="n")
    theirs = FO.forest_of_nodes(mine.nodes, params, 6)
    assert theirs.getNumTrees == mine.getNumTrees == 7 and theirs.totalNumNodes == mine.totalNumNodes
    assert len({tuple(t) for t in mine.nodes.groupBy("tree").agg(F.sum("gain")).select("sum(gain)").collect()}) == 7  # own bags
    a = {r["id"]: r["probability_1"] for r in MD.score(mine, rows).collect()}
    b = {r["id"]: r["probability_1"] for r in MD.score(theirs, rows).collect()}
    assert max(abs(a[i] - b[i]) for i in a) < 1e-12
    assert np.allclose(mine.featureImportances.toArray(), theirs.featureImportances.toArray(), atol=1e-12)
    # the same trees however the rows are dealt and counted
    again = MD.random_forest(rows.withColumn("n", F.lit(1)).repartition(7), params, count="n")
    key = ["tree", "id", "feature", "threshold", "n", "s0", "s1"]
    assert sorted(map(tuple, mine.nodes.select(key).where("`left` >= 0").collect())) == \
        sorted(map(tuple, again.nodes.select(key).where("`left` >= 0").collect()))


def test_bags_hold_as_many_rows(counted):
    params = MD.ForestParams(num_trees=60, max_depth=3, min_leaf=40, feature_subset="0.5", weighted=False, min_split=200)
    nodes = MD.random_forest(counted, params, count="n").nodes
    roots = [r["n"] for r in nodes.where("id = 0").collect()]
    assert len(roots) == 60 and abs(np.mean(roots) - 1500) < 4 * 1500 ** 0.5 / 60 ** 0.5 and 20 < np.std(roots) < 60
    assert nodes.where("n < 40 or (`left` >= 0 and n < 200)").count() == 0
    kids = nodes.alias("p").join(nodes.alias("c"), F.expr("p.tree = c.tree and c.id in (p.`left`, p.`right`)")).groupBy("p.tree", "p.id", "p.n").agg(
        F.sum("c.n").alias("below"), F.count(F.lit(1)).alias("k"))
    assert kids.where("n != below or k != 2").count() == 0


def test_beyond_the_bound_sparks_learner_gets_all_rows(rows, counted, monkeypatch):
    monkeypatch.setattr(GR, "MAX_CELLS", 1)
    params = MD.ForestParams(num_trees=2, max_depth=3, min_leaf=5, feature_subset="all", weighted=False, bootstrap=False)
    nodes = FO.node_table(MD.random_forest(counted, params, count="n"))
    assert [r["n"] for r in nodes.where("node = 0").collect()] == [1500, 1500]


def test_cut_points():
    assert GR.cut_points([(3.0, 1), (0.0, 5), (1.0, 2)]) == [0.5, 2.0]
    assert GR.cut_points([(2.0, 9)]) == []
    many = GR.cut_points([(float(v), 10.0) for v in range(320)])
    assert len(many) == 31 and many[0] == 9.5 and np.allclose(np.diff(many), 10)


def test_counted_weights_and_auc(rows, counted):
    a = {r["label"]: r["weight"] for r in SP.class_weights(rows, "label").collect()}
    assert a == {r["label"]: r["weight"] for r in SP.class_weights(counted, "label", count="n").collect()}
    score = F.element_at(F.col("x"), 1) + F.element_at(F.col("x"), 2)
    from pyspark.ml.functions import vector_to_array
    of = lambda d: d.withColumn("x", vector_to_array("features")).withColumn("p", score)
    plain = {r["fold"]: r["auc"] for r in EV.auc(of(rows), "label", "p", ["fold"]).collect()}
    got = {r["fold"]: r["auc"] for r in EV.auc(of(counted), "label", "p", ["fold"], count="n").collect()}
    assert plain == got and len(got) == 5


def _no_row_fits(monkeypatch):
    def fail(*a, **k):
        raise AssertionError("a forest is fitted to the rows one by one")
    monkeypatch.setattr(MD, "RandomForestClassifier", fail)


def test_cross_validation_fits_counted_rows(spark, monkeypatch):
    _no_row_fits(monkeypatch)
    r = Q.QUERIES["i5_cv_auc_forest"](spark, SF).first()
    assert r["folds"] == 5 and 0 <= r["mean_auc"] <= 1
    n = Q._prepared(spark, SF, "rf").frame.count()
    assert Q._counted_rows(spark, SF).agg(F.sum("n")).first()[0] == n


def test_out_of_fold_scores_fit_counted_rows(spark, monkeypatch):
    _no_row_fits(monkeypatch)
    frame = Q._prepared(spark, SF, "rf").frame
    oof = Q._oof_forest(spark, SF)
    assert oof.count() == frame.count() and oof.where("probability_1 is null").count() == 0
    right = oof.agg(F.avg((F.col("label") == F.col("predicted")).cast("double"))).first()[0]
    assert abs(Q.QUERIES["i15_oof_accuracy"](spark, SF).first()["oof_accuracy"] - right) < 1e-12
    ranked = Q.QUERIES["i18_rank_open_oof"](spark, SF).collect()
    assert {r["record_id"]: r["probability_1"] for r in ranked} == {r["record_id"]: r["probability_1"] for r in oof.where("label = 0").collect()}
    assert [(-r["probability_1"], r["record_id"]) for r in ranked] == sorted((-r["probability_1"], r["record_id"]) for r in ranked)


def test_out_of_fold_models_have_not_seen_the_row(rows, counted):
    params = MD.ForestParams(num_trees=3, max_depth=4, min_leaf=5, feature_subset="all", weighted=False, bootstrap=False)
    got = MD.out_of_fold(rows, lambda d: MD.random_forest(d, params, count="n"), train=counted)
    for f in (0, 3):
        model = MD.random_forest(counted.where(F.col("fold") != f), params, count="n")
        want = {r["id"]: r["probability_1"] for r in MD.score(model, rows.where(F.col("fold") == f)).collect()}
        assert want == {r["id"]: r["probability_1"] for r in got.where(F.col("fold") == f).collect()}


def test_forest_a_fits_counted_rows(spark, monkeypatch):
    _no_row_fits(monkeypatch)
    top = Q.QUERIES["i13_forest_a_importance"](spark, SF).collect()
    assert len(top) == 10 and [r["rank"] for r in top] == list(range(1, 11))
    assert 0 <= top[0]["test_auc"] <= 1 and sum(r["importance"] for r in top) <= 1 + 1e-9


def test_all_bags_hashed_once(spark):
    keys = spark.createDataFrame([(i, f"k|{i}") for i in range(300)] + [(300, None)], "i int, k string")
    want = [FO.bag_count(["i", "k"], F.lit(t), 9).alias(f"b{t}") for t in range(12)]
    for r in keys.select(FO.bag_counts(["i", "k"], 12, 9).alias("got"), *want).collect():
        assert r["got"] == [r[f"b{t}"] for t in range(12)]


def test_bagged_trees_are_those_of_sparks_learner(rows, monkeypatch):
    params = MD.ForestParams(num_trees=3, max_depth=5, min_leaf=12, feature_subset="all", weighted=True, seed=3)
    votes = FO.leaf_votes(FO.bagged_forest(rows, params, ["id"]), rows, ["id", "label"])
    monkeypatch.setattr(GR, "MAX_CELLS", 1)
    fitted = FO.bagged_forest(rows, params, ["id"])
    theirs = FO.leaf_votes(fitted, rows, ["id", "label"])
    a, b = ({r["id"]: r["votes"] for r in v.collect()} for v in (votes, theirs))
    assert len(a) == 1500 and fitted.totalNumNodes > 20
    assert max(abs(x - y) for i in a for x, y in zip(a[i], b[i], strict=True)) < 1e-12
    # a row per vote gives the same scores
    long = votes.select("id", "label", F.posexplode("votes").alias("tree", "p1"))
    one, two = ({r["id"]: r for r in FO.out_of_bag(v, ["id"], "label", 3).collect()} for v in (votes, long))
    assert set(one) == set(two) and len(one) < 1500
    for i in one:
        assert one[i]["trees"] == two[i]["trees"] and abs(one[i]["probability_1"] - two[i]["probability_1"]) < 1e-12


def test_out_of_bag_query_fits_no_tree_to_rows(spark, monkeypatch):
    def fail(*a, **k):
        raise AssertionError("Spark's learner is given the rows of a bag")
    monkeypatch.setattr(FO, "inheritable_thread_target", fail)
    r = Q.QUERIES["i15_oob_accuracy"](spark, SF).first()
    assert 0 < r["n_rows"] <= Q._prepared(spark, SF, "rf").frame.where("split = 'train'").count() and 0 <= r["oob_accuracy"] <= 1


def test_hashes_of_many_texts():
    import hashlib

    from casebook.operators.hashing import first_words
    rng = random.Random(1)
    heads = [bytes(rng.randrange(256) for _ in range(size)) for size in [*range(70), *range(70)]]
    tails = [b"", b"0", b"123456"]
    got = first_words(heads, tails)
    assert got.tolist() == [[int(hashlib.md5(h + t).hexdigest()[:8], 16) for t in tails] for h in heads]
