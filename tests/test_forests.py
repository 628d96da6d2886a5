"""Trees as tables: cuts, bags, out-of-bag votes, against plain recomputation."""

import hashlib
import random

import pytest
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from casebook.operators import forests as FO
from casebook.operators import models as MD


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = [(i, rng.random(), rng.random(), float(rng.randint(0, 3))) for i in range(600)]
    data = [(i, a, b, c, float(a + b / 2 + rng.random() / 2 > 0.9 or c == 2 and b < 0.3)) for i, a, b, c in data]
    df = spark.createDataFrame(data, "id int, a double, b double, c double, label double")
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df).withColumn("weight", F.lit(1.0)).cache()


def walk(nodes, x, min_split):
    """Nodes that a row passes, by the table."""
    at, path = 0, [0]
    while nodes[at]["left"] >= 0 and nodes[at]["n"] >= min_split:
        at = nodes[at]["left"] if x[nodes[at]["feature"]] <= nodes[at]["threshold"] else nodes[at]["right"]
        path.append(at)
    return path


@pytest.mark.parametrize("min_split", [0, 30, 90, 10_000])
def test_cut_tree_against_walk(rows, min_split):
    tree = DecisionTreeClassifier(maxDepth=6, seed=1).fit(rows)
    whole = {r["node"]: r for r in FO.node_table(tree).collect()}
    cut = FO.cut_back(tree, min_split)
    data = rows.select("id", "label", vector_to_array("features").alias("x")).collect()
    paths = {r["id"]: walk(whole, r["x"], min_split) for r in data}
    ends = {}
    for r in data:
        ends.setdefault(paths[r["id"]][-1], []).append(r["label"])
    got = {r["id"]: r["probability_1"] for r in MD.score(cut, rows).collect()}
    for r in data:
        mine = ends[paths[r["id"]][-1]]
        assert abs(got[r["id"]] - sum(mine) / len(mine)) < 1e-12
    left = {n for p in paths.values() for n in p}
    assert cut.numNodes == len(left)
    for r in FO.node_table(cut).collect():
        assert r["left"] < 0 or r["n"] >= min_split
    # rows that reach each node
    seen = {(r["tree"], r["node"]): r["n"] for r in FO.reach_counts(rows.select("label", vector_to_array("features").alias("x")), FO.node_table(cut)).collect()}
    assert seen == {(0, r["node"]): r["n"] for r in FO.node_table(cut).collect()}


def test_cut_forest_keeps_its_trees(rows):
    forest = RandomForestClassifier(numTrees=4, maxDepth=5, seed=2).fit(rows)
    cut = FO.cut_back(forest, 60)
    assert cut.getNumTrees == 4 and cut.totalNumNodes < forest.totalNumNodes
    one = FO.cut_back(forest, 10_000)
    assert one.totalNumNodes == 4
    same = FO.cut_back(forest, 0)
    a = {r["id"]: r["probability_1"] for r in MD.score(forest, rows).collect()}
    assert a == {r["id"]: r["probability_1"] for r in MD.score(same, rows).collect()}


def test_min_split_parameter(rows):
    params = MD.ForestParams(num_trees=3, max_depth=6, min_leaf=2, feature_subset="all", weighted=False, min_split=80)
    nodes = FO.node_table(MD.random_forest(rows, params)).where("left >= 0")
    assert nodes.count() > 0 and nodes.where("n < 80").count() == 0
    tree = FO.node_table(MD.decision_tree(rows, weight=None, max_depth=6, min_split=120)).where("left >= 0")
    assert tree.count() > 0 and tree.where("n < 120").count() == 0


def held(key, seed, tree):
    h = int(hashlib.md5(f"{key}|{seed}|{tree}".encode()).hexdigest()[:8], 16)
    return sum(h >= c for c in FO._poisson_cuts())


def test_bags_are_poisson_and_repeatable(spark):
    df = spark.range(20000).withColumnRenamed("id", "k")
    got = df.select("k", FO.bag_count(["k"], F.lit(3), 42).alias("n")).collect()
    assert all(r["n"] == held(r["k"], 42, 3) for r in got)
    mean = sum(r["n"] for r in got) / len(got)
    none = sum(r["n"] == 0 for r in got) / len(got)
    assert abs(mean - 1) < 0.03 and abs(none - 0.3679) < 0.015


def test_out_of_bag_against_plain(rows):
    """Three trees: the votes of those that haven't seen the row, tree by tree."""
    params = MD.ForestParams(num_trees=3, max_depth=4, min_leaf=5, feature_subset="all", weighted=False, seed=7, min_split=40)
    model = FO.bagged_forest(rows, params, ["id"])
    assert model.getNumTrees == 3
    votes = FO.leaf_votes(model, rows, ["id", "label"])
    tables = {}
    for r in FO.node_table(model).collect():
        tables.setdefault(r["tree"], {})[r["node"]] = r
    want, data = {}, rows.select("id", "label", vector_to_array("features").alias("x")).collect()
    for r in data:
        says = []
        for t, nodes in tables.items():
            if held(r["id"], 7, t) == 0:
                end = nodes[walk(nodes, r["x"], 0)[-1]]
                says.append(end["stats"][1] / sum(end["stats"]))
        if says:
            want[r["id"]] = (len(says), sum(says) / len(says))
    got = FO.out_of_bag(votes, ["id"], "label", 7).collect()
    assert {r["id"] for r in got} == set(want) and len(want) < len(data)
    for r in got:
        assert r["trees"] == want[r["id"]][0] and abs(r["probability_1"] - want[r["id"]][1]) < 1e-12
    right = sum(r["predicted"] == r["label"] for r in got) / len(got)
    acc = FO.oob_accuracy(FO.out_of_bag(votes, ["id"], "label", 7)).first()
    assert acc["n_rows"] == len(got) and abs(acc["oob_accuracy"] - right) < 1e-12 and right > 0.6
    # each tree was fitted to its bag: the root holds the rows that the bag holds
    for t, nodes in tables.items():
        assert nodes[0]["n"] == sum(held(r["id"], 7, t) > 0 for r in data)
        assert nodes[0]["stats"][0] + nodes[0]["stats"][1] == sum(held(r["id"], 7, t) for r in data)
        assert all(n["left"] < 0 or n["n"] >= 40 for n in nodes.values())


def test_split_stays_where_both_sides_are_of_one_class(spark):
    from pyspark.ml.functions import array_to_vector
    # positives: 10 of 100 where x is 0, 30 of 100 where it is 1 - class 0 leads on both sides
    rows = [(float(i % 10 < 1 + 2 * x), float(x)) for x in (0, 1) for i in range(100)]
    df = spark.createDataFrame(rows, "label double, x double").select("label", array_to_vector(F.array("x", F.lit(0.0))).alias("features"))
    n = {r["node"]: r for r in FO.node_table(MD.split_tree(df)).collect()}
    assert sorted(n) == [0, 1, 2] and n[0]["feature"] == 0
    assert [(n[i]["n"], n[i]["stats"][1]) for i in (1, 2)] == [(100, 10.0), (100, 30.0)]
    assert len(FO.node_table(MD.decision_tree(df, weight=None, max_depth=1)).collect()) == 1  # the classifier merges them
