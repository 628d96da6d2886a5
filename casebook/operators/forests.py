"""Trees as tables (I13-I16): minimum split sizes, explicit bags, out-of-bag votes.

Spark's learners know a minimum leaf size only, draw their bags inside the fit and
don't tell which rows a tree has seen.  Here a fitted model becomes a table of its
nodes (the learner's own save format, one row per node), which DataFrame steps change
and the learner's loader turns into a model again, so scoring stays Spark's own:

* ``cut_back`` makes a leaf of every node with fewer rows than a minimum split size.
  Trees grow from the root and a node's split doesn't look at its children, so this is
  the tree that a learner with that limit would have grown.  A limit of up to twice the
  minimum leaf size changes nothing: both children of a split hold that many rows.
* ``bagged_forest`` grows one tree per bag; how often a bag holds a row is a Poisson(1)
  number read from a hash of the row's key, so any job can tell it again.
* ``votes`` averages the trees whose bag doesn't hold the row: the out-of-bag score.

Node tables are as large as the model, never as the data.
"""

from __future__ import annotations

import json
import math
from multiprocessing.pool import ThreadPool
from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.classification import (DecisionTreeClassificationModel, RandomForestClassificationModel,
                                        RandomForestClassifier)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.operators import growth as GR
from casebook.operators.hashing import first_words
from casebook.session import cut_lineage, drop_path, scratch_path


# --------------------------------------------------------------- node tables
def _saved(spark: SparkSession, model) -> str:
    path = scratch_path(spark, "trees")
    model.write().session(spark).save(path)
    return path


def _raw_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(treeID, nodeData) of a saved forest, or of a saved tree as tree 0."""
    df = spark.read.parquet(f"{path}/data")
    if "nodeData" in df.columns:
        return df.select("treeID", "nodeData")
    return df.select(F.lit(0).alias("treeID"), F.struct(*df.columns).alias("nodeData"))


def _flat(raw: DataFrame) -> DataFrame:
    n = "nodeData."
    return raw.select(F.col("treeID").alias("tree"), F.col(n + "id").alias("node"), F.col(n + "leftChild").alias("left"),
                      F.col(n + "rightChild").alias("right"), F.col(n + "split.featureIndex").alias("feature"),
                      F.get(n + "split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
                      F.col(n + "rawCount").alias("n"), F.col(n + "impurityStats").alias("stats"))


def node_table(model) -> DataFrame:
    """One row per node: tree, node (0 is the root; left to right, a parent before its
    children), left and right (-1: a leaf), feature, threshold (rows up to it go left),
    n (rows of the tree's bag that reach the node), stats (their weight per class).
    Splits on numbers only, as one-hot columns are."""
    spark = SparkSession.getActiveSession()
    path = _saved(spark, model)
    out = cut_lineage(_flat(_raw_nodes(spark, path)))
    drop_path(spark, path)
    return out


def _is_split(min_split: int) -> Column:
    return (F.col("left") >= 0) & (F.col("n") >= min_split)


def reachable(nodes: DataFrame, min_split: int = 0) -> DataFrame:
    """The rows of ``nodes`` (tree, node, left, right, n, ...) that are still there when
    nodes of fewer than ``min_split`` rows are leaves: a step down per level, from the
    roots, over the node table."""
    front = kept = cut_lineage(nodes.where("node = 0"))
    while True:
        below = front.where(_is_split(min_split)).select("tree", F.explode(F.array("left", "right")).alias("node"))
        front = cut_lineage(nodes.join(below, ["tree", "node"], "left_semi"))
        if front.isEmpty():
            return kept
        kept = kept.unionByName(front)


def cut_back(model, min_split: int):
    """``model`` (a tree or a forest) with every node of fewer than ``min_split`` rows
    made a leaf."""
    spark = SparkSession.getActiveSession()
    path, new = _saved(spark, model), scratch_path(spark, "trees-cut")
    raw = _raw_nodes(spark, path)
    _write_model(spark, path, new, _cut(raw, min_split), forest=isinstance(model, RandomForestClassificationModel))
    out = type(model).load(new)
    drop_path(spark, path)
    drop_path(spark, new)
    return out


def _cut(raw: DataFrame, min_split: int) -> DataFrame:
    """Node rows after the cut, numbered anew (the loader asks for 0, 1, 2, ... in a tree)."""
    from pyspark.sql import Window
    flat = _flat(raw)
    # a tree's nodes are in one task: bounded by its depth
    number = (reachable(flat.select("tree", "node", "left", "right", "n"), min_split)
              .withColumn("new", (F.row_number().over(Window.partitionBy("tree").orderBy("node")) - 1).cast("int"))
              .withColumn("split", _is_split(min_split)).select("tree", "node", "new", "split"))
    number = cut_lineage(number)
    d = raw.select(F.col("treeID").alias("tree"), F.col("nodeData.id").alias("node"), "nodeData").join(number, ["tree", "node"])
    for side in ("left", "right"):
        child = number.select("tree", F.col("node").alias("c"), F.col("new").alias(f"new_{side}")).alias(side)
        d = d.join(child, (F.col(f"{side}.tree") == d["tree"]) & (F.col(f"{side}.c") == F.col(f"nodeData.{side}Child")) & F.col("split"),
                   "left").drop(F.col(f"{side}.tree")).drop("c")
    leaf = F.lit(-1)
    node = (F.col("nodeData").withField("id", F.col("new"))
            .withField("leftChild", F.coalesce("new_left", leaf)).withField("rightChild", F.coalesce("new_right", leaf))
            .withField("gain", F.when(F.col("split"), F.col("nodeData.gain")).otherwise(-1.0))
            .withField("split.featureIndex", F.when(F.col("split"), F.col("nodeData.split.featureIndex")).otherwise(leaf))
            .withField("split.leftCategoriesOrThreshold", F.when(F.col("split"), F.col("nodeData.split.leftCategoriesOrThreshold"))
                       .otherwise(F.array().cast("array<double>")))
            .withField("split.numCategories", F.when(F.col("split"), F.col("nodeData.split.numCategories")).otherwise(leaf)))
    return d.select(F.col("tree").alias("treeID"), node.alias("nodeData"))


def _write_model(spark: SparkSession, old: str, new: str, raw: DataFrame, forest: bool, trees: int | None = None) -> None:
    """A saved model like the one at ``old`` with other node rows (and, of a saved
    one-tree forest, as many trees as asked for)."""
    meta = spark.read.text(f"{old}/metadata").first()[0]
    if trees is not None:
        d = json.loads(meta)
        d["numTrees"] = d["paramMap"]["numTrees"] = trees
        meta = json.dumps(d)
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.text(f"{new}/metadata")
    if not forest:
        raw.select("nodeData.*").write.parquet(f"{new}/data")
        return
    raw.write.parquet(f"{new}/data")
    about = spark.read.parquet(f"{old}/treesMetadata")
    if trees is not None:
        first, number, *rest = about.columns[0], F.explode(F.sequence(F.lit(0), F.lit(trees - 1))), *about.columns[1:]
        about = about.select(number.alias(first), *rest)
    about.write.parquet(f"{new}/treesMetadata")


def forest_of_nodes(nodes: DataFrame, params, d: int, label: str = "label", features: str = "features") -> RandomForestClassificationModel:
    """The model that ``growth``'s node rows are, of ``d`` features: saved as the learner
    saves, beside what it writes of a fit to two rows."""
    from pyspark.ml.linalg import Vectors
    spark = nodes.sparkSession
    two = spark.createDataFrame([(float(y), Vectors.dense([float(y)] * d)) for y in (0, 1)], [label, features])
    old = _saved(spark, RandomForestClassifier(
        featuresCol=features, labelCol=label, numTrees=1, bootstrap=params.bootstrap, maxDepth=params.max_depth,
        minInstancesPerNode=params.min_leaf, featureSubsetStrategy=params.feature_subset, seed=params.seed, impurity="gini").fit(two))
    kind = spark.read.parquet(f"{old}/data").schema
    split = F.struct(F.col("feature").alias("featureIndex"),
                     F.when(F.col("left") >= 0, F.array("threshold")).otherwise(F.array().cast("array<double>")).alias("leftCategoriesOrThreshold"),
                     F.lit(-1).alias("numCategories"))
    node = F.struct("id", "prediction", "impurity", F.array("s0", "s1").alias("impurityStats"), F.col("n").alias("rawCount"), "gain",
                    F.col("left").alias("leftChild"), F.col("right").alias("rightChild"), split.alias("split"))
    raw = nodes.select(F.col("tree").alias("treeID"), node.cast(kind["nodeData"].dataType).alias("nodeData"))
    new = scratch_path(spark, "forest")
    _write_model(spark, old, new, raw, forest=True, trees=params.num_trees)
    model = RandomForestClassificationModel.load(new)
    drop_path(spark, old)
    drop_path(spark, new)
    return model


# ---------------------------------------------------------------------- bags
def _poisson_cuts() -> list[int]:
    """2**32 * P(X <= k) for a Poisson(1) X, as far as 32 bits tell them apart."""
    out, p, total, k = [], math.exp(-1), 0.0, 0
    while not out or out[-1] < (1 << 32) - 1:
        total += p
        out.append(int(total * (1 << 32)))
        k += 1
        p /= k
    return out


def bag_count(key: Sequence[str], tree: Column, seed: int) -> Column:
    """How often bag ``tree`` holds the row: a Poisson(1) number from
    md5(key | seed | tree)."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed)), tree.cast("string"))),
                           1, 8), 16, 10).cast("long")
    return sum((h >= F.lit(c)).cast("int") for c in _poisson_cuts())


def bags(df: DataFrame, key: Sequence[str], trees: int, seed: int = 42) -> DataFrame:
    """(tree, times, n): how many rows each bag holds so many times."""
    one = df.select(*key, F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    return one.select("tree", bag_count(key, F.col("tree"), seed).alias("times")).groupBy("tree", "times").agg(F.count(F.lit(1)).alias("n"))


def _bag_text(key: Sequence[str], seed: int) -> Column:
    return F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed)))


def _held(texts: pa.Array, trees: int) -> np.ndarray:
    """``bag_count`` of each row (by its ``_bag_text``) and each of the first ``trees``
    bags: rows x trees."""
    hashes = first_words([f"{t}|".encode() for t in texts.to_pylist()], [str(t).encode() for t in range(trees)])
    return np.searchsorted(_poisson_cuts(), hashes, side="right")


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel()))


def bag_counts(key: Sequence[str], trees: int, seed: int) -> Column:
    """``bag_count`` of all bags as an array, each hashed once."""
    @F.arrow_udf("array<tinyint>")
    def counts(texts: pa.Array) -> pa.Array:
        return _lists(_held(texts, trees).astype(np.int8))

    return counts(_bag_text(key, seed))


def bagged_forest(train: DataFrame, params, key: Sequence[str], label: str = "label", features: str = "features",
                  weight: str = "weight", parallelism: int = 4) -> RandomForestClassificationModel:
    """A forest of trees fitted to explicit bags: tree t weighs each row with its bag
    count (times its class weight, if ``params.weighted``); rows of count 0 are left
    out.  The bags are summed per distinct row, of which ``growth`` grows the trees.  If
    too many rows differ, Spark's learner fits each tree to its rows, ``parallelism`` at a
    time, as in Spark ML's own tuning; these trees are put together from their node
    tables, cut back to ``params.min_split``."""
    table = GR.counted(train, label, features, weight if params.weighted else None)
    if table is not None:
        # all rows of a code in one task before their bags are drawn: sums leave it, not rows
        rows = GR.coded(train.where(F.col(label).isNotNull()), table.cuts, [label, *key], features).repartition("code")
        drawn = rows.select("code", label, F.posexplode(bag_counts(key, params.num_trees, params.seed)).alias("tree", "times")).where("times > 0")
        bagged = drawn.groupBy("code", "tree").agg(
            *[F.sum(F.when(F.col(label) == y, F.col("times")).otherwise(0)).alias(f"times{y}") for y in (0, 1)], F.count(F.lit(1)).alias("held"))
        return forest_of_nodes(GR.bag_trees(bagged, table, params), params, len(table.cuts), label, features)
    spark = train.sparkSession
    base = F.col(weight) if params.weighted else F.lit(1.0)
    # every bag's counts hashed once, a small column per tree: a fit reads its own three times
    path_of_bags = scratch_path(spark, "bags")
    counts = [bag_count(key, F.lit(t), params.seed).cast("byte").alias(f"_bag{t}") for t in range(params.num_trees)]
    train.select(label, features, base.cast("double").alias("_base"), *counts).write.parquet(path_of_bags)
    bagged = spark.read.parquet(path_of_bags)

    def fit(t: int) -> str:
        rows = bagged.where(F.col(f"_bag{t}") > 0).withColumn("_times", F.col(f"_bag{t}") * F.col("_base"))
        tree = RandomForestClassifier(
            featuresCol=features, labelCol=label, weightCol="_times", numTrees=1, bootstrap=False, maxDepth=params.max_depth,
            minInstancesPerNode=params.min_leaf, featureSubsetStrategy=params.feature_subset, seed=params.seed + t, impurity="gini")
        return _saved(spark, tree.fit(rows.select(label, features, "_times")))

    with ThreadPool(min(parallelism, params.num_trees)) as pool:
        paths = pool.map(inheritable_thread_target(spark)(fit), range(params.num_trees))
    raw = None
    for t, path in enumerate(paths):
        one = _raw_nodes(spark, path).withColumn("treeID", F.lit(t))
        raw = one if raw is None else raw.unionByName(one)
    raw = cut_lineage(raw.coalesce(1))
    new = scratch_path(spark, "forest")
    if params.min_split > 2 * params.min_leaf:
        raw = _cut(raw, params.min_split)
    _write_model(spark, paths[0], new, raw, forest=True, trees=params.num_trees)
    model = RandomForestClassificationModel.load(new)
    for path in [*paths, new, path_of_bags]:
        drop_path(spark, path)
    return model


# --------------------------------------------------------------------- votes
def route(df: DataFrame, nodes: DataFrame, keep: Sequence[str], x: str = "x") -> DataFrame:
    """(``keep``, tree, node, depth): every node that each row of ``df`` reaches in each
    tree, ``x`` being its features as an array: a broadcast join with the node table
    (bounded by the model) per level."""
    table = F.broadcast(nodes.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), "left", "right", "feature", "threshold"))
    cur = df.select(*keep, x).join(F.broadcast(nodes.select("tree").distinct()))
    cur = cur.withColumn("_at", F.lit(0)).withColumn("_path", F.array(F.lit(0)))
    depth = _depth(nodes)
    for _ in range(depth):
        j = cur.join(table, (F.col("tree") == F.col("_t")) & (F.col("_at") == F.col("_n")), "left")
        to = F.when(F.col("left") >= 0, F.when(F.get(x, F.col("feature")) <= F.col("threshold"), F.col("left")).otherwise(F.col("right")))
        cur = j.select(*keep, x, "tree", to.alias("_at"), "_path").withColumn(
            "_path", F.when(F.col("_at").isNotNull(), F.concat("_path", F.array("_at"))).otherwise(F.col("_path")))
    return cur.select(*keep, "tree", F.posexplode("_path").alias("depth", "node"))


def _depth(nodes: DataFrame) -> int:
    """Levels below the roots (as many small jobs over the node table)."""
    front, depth = nodes.where("node = 0"), 0
    while True:
        below = front.where("left >= 0").select("tree", F.explode(F.array("left", "right")).alias("node"))
        front = cut_lineage(nodes.join(below, ["tree", "node"], "left_semi"))
        if front.isEmpty():
            return depth
        depth += 1


def reach_counts(df: DataFrame, nodes: DataFrame, label: str = "label", x: str = "x") -> DataFrame:
    """(tree, node, n, positives): rows of ``df`` that reach each node."""
    return (route(df, nodes, [label], x).groupBy("tree", "node")
            .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("double")).alias("positives")))


def leaf_votes(model: RandomForestClassificationModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(``keep``, votes): what each tree says of each row, in the trees' order, through the
    leaf numbers that Spark's scoring gives (left to right)."""
    leaves = node_table(model).where("left < 0").select(
        "tree", "node", (F.get("stats", F.lit(1)) / F.aggregate("stats", F.lit(0.0), lambda a, b: a + b)).alias("p1"))
    # bound: one row per leaf of the model
    found = leaves.orderBy("tree", "node").toArrow()
    tree, p1 = found["tree"].to_numpy(), found["p1"].to_numpy()
    first = np.searchsorted(tree, np.arange(model.getNumTrees))

    @F.arrow_udf("array<double>")
    def says(leaf: pa.Array) -> pa.Array:
        at = leaf.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(leaf), len(first))
        return _lists(p1[first + at])

    scored = model.copy().setLeafCol("_leaf").transform(df)
    return scored.select(*keep, says(vector_to_array("_leaf")).alias("votes"))


def out_of_bag(votes: DataFrame, key: Sequence[str], label: str, seed: int, cut: float = 0.5) -> DataFrame:
    """(``key``, label, trees, probability_1, predicted) from votes (key, label, votes: one
    per tree), or a row per vote (key, label, tree, p1): the mean over the trees whose bag
    doesn't hold the row.  Rows in every bag have no such tree and no row here."""
    if "votes" in votes.columns:
        @F.arrow_udf("struct<trees: bigint, p1: double>")
        def free_mean(texts: pa.Array, p1: pa.Array) -> pa.Array:
            p1 = p1.flatten().to_numpy(zero_copy_only=False).reshape(len(texts), -1)
            free = _held(texts, p1.shape[1]) == 0
            trees = free.sum(axis=1)
            return pa.StructArray.from_arrays([pa.array(trees), pa.array((p1 * free).sum(axis=1) / np.maximum(trees, 1))], names=["trees", "p1"])

        # as if by chance: the filter must not hash a second time
        mean = free_mean.asNondeterministic()(_bag_text(key, seed), F.col("votes"))
        scored = (votes.select(*key, label, mean.alias("_m")).where("_m.trees > 0")
                  .select(*key, label, F.col("_m.trees").alias("trees"), F.col("_m.p1").alias("probability_1")))
    else:
        free = votes.where(bag_count(key, F.col("tree"), seed) == 0)
        scored = free.groupBy(*key, label).agg(F.count(F.lit(1)).alias("trees"), F.avg("p1").alias("probability_1"))
    return scored.withColumn("predicted", (F.col("probability_1") >= cut).cast("int"))


def oob_accuracy(oob: DataFrame, label: str = "label") -> DataFrame:
    """Rows with an out-of-bag score, and the share of them that is right."""
    return oob.agg(F.count(F.lit(1)).alias("n_rows"), F.avg((F.col(label) == F.col("predicted")).cast("double")).alias("oob_accuracy"))
