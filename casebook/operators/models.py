"""Classifier training and scoring through Spark ML.

Spark ML's estimators are distributed (tree learning aggregates split
statistics per partition; logistic regression aggregates gradients), so the
library only sets parameters to match the analysis:

* logistic regression, L2 with C = 1 and balanced weights: sklearn minimises
  ``C * sum(w * loss) + ||b||^2 / 2`` while Spark minimises
  ``sum(w * loss) / sum(w) + reg/2 * ||b||^2``, hence ``reg = 1 / (C * sum(w))``;
  no standardisation, intercept not penalised (as in both libraries);
* forests: ``minInstancesPerNode`` carries the min-leaf size, ``forests.cut_back``
  the min-split size (in the analysis's two forests it is twice the min-leaf size,
  which implies it); Spark bins numeric features (``maxBins``), so splits can differ
  from an exact-threshold learner.

Cross-validation is done by hand on a fold column so that the fold AUC is
the exact rank-sum AUC of ``evaluate.auc`` (Spark's evaluator bins scores).
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.ml.classification import (DecisionTreeClassifier, LogisticRegression,
                                        RandomForestClassifier)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook import presets as P
from casebook.operators import evaluate as EV
from casebook.operators import forests as FO
from casebook.operators import growth as GR
from casebook.operators.features import Vocab


@dataclass(frozen=True)
class ForestParams:
    num_trees: int
    max_depth: int
    min_leaf: int
    feature_subset: str
    weighted: bool
    bootstrap: bool = True
    seed: int = 42
    min_split: int = 2


# FIXED VALUES: the two forests of the analysis.
FOREST_A = ForestParams(num_trees=100, max_depth=15, min_leaf=10, feature_subset="sqrt",
                        weighted=True, min_split=20)
FOREST_B = ForestParams(num_trees=50, max_depth=8, min_leaf=50, feature_subset="0.3",
                        weighted=False, min_split=100)


def logistic_regression(train: DataFrame, label: str = "label", features: str = "features",
                        weight: str | None = "weight", C: float = 1.0, max_iter: int = 1000, tol: float = 1e-9):
    sw = (train.select(F.sum(weight)).first()[0] if weight
          else train.count())
    lr = LogisticRegression(featuresCol=features, labelCol=label, maxIter=max_iter,
                            regParam=1.0 / (C * float(sw)), elasticNetParam=0.0,
                            standardization=False, fitIntercept=True, tol=tol)
    if weight:
        lr = lr.setWeightCol(weight)
    return lr.fit(train)


def decision_tree(train: DataFrame, label: str = "label", features: str = "features",
                  weight: str | None = "weight", max_depth: int = 4, seed: int = 42, min_split: int = 2):
    dt = DecisionTreeClassifier(featuresCol=features, labelCol=label, maxDepth=max_depth,
                                impurity="gini", seed=seed)
    if weight:
        dt = dt.setWeightCol(weight)
    model = dt.fit(train)
    return FO.cut_back(model, min_split) if min_split > 2 else model


def split_tree(train: DataFrame, label: str = "label", features: str = "features", max_depth: int = 1, seed: int = 42):
    """A tree whose splits all stay.  Spark's classifiers merge two leaves of one class,
    though their shares of positives differ; a regression tree of the 0/1 label finds the
    same splits (its variance is half of the Gini impurity) and merges equal shares only.
    A node's stats are its rows, its positives and again its positives."""
    return DecisionTreeRegressor(featuresCol=features, labelCol=label, maxDepth=max_depth, impurity="variance", seed=seed).fit(train)


def random_forest(train: DataFrame, params: ForestParams = FOREST_B, label: str = "label",
                  features: str = "features", weight: str = "weight", count: str | None = None):
    """``count``: the column that tells how many rows a row stands for; the trees are
    grown from such counts then (``growth``), or by Spark's learner from the rows
    themselves if too many of them differ."""
    if count is not None:
        table = GR.counted(train, label, features, weight if params.weighted else None, count)
        if table is not None:
            return GR.GrownForest(GR.bootstrap_trees(table, params), table.cuts)
        train = train.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col(count)))).drop("_copy")
    rf = RandomForestClassifier(featuresCol=features, labelCol=label,
                                numTrees=params.num_trees, maxDepth=params.max_depth,
                                minInstancesPerNode=params.min_leaf,
                                featureSubsetStrategy=params.feature_subset,
                                bootstrap=params.bootstrap, seed=params.seed,
                                impurity="gini", cacheNodeIds=True, maxMemoryInMB=512,
                                checkpointInterval=10)
    if params.weighted:
        rf = rf.setWeightCol(weight)
    model = rf.fit(train)
    # both children of a split hold min_leaf rows: a smaller limit is kept anyway
    return FO.cut_back(model, params.min_split) if params.min_split > 2 * params.min_leaf else model


@dataclass
class LinearScorer:
    """A logistic score from a given coefficient table (I8's shape): features of
    the vocabulary that it doesn't name count as 0.  Scores rows that hold the
    encoded vector, as a trained model does."""

    features: list
    coefficients: dict
    intercept: float = 0.0

    def transform(self, df: DataFrame) -> DataFrame:
        weights = F.array(*[F.lit(float(self.coefficients.get(f, 0.0))) for f in self.features])
        products = F.zip_with(vector_to_array("features"), weights, lambda x, w: x * w)
        z = F.aggregate(products, F.lit(float(self.intercept)), lambda acc, x: acc + x)
        return df.withColumn("_p1", 1 / (1 + F.exp(-z)))


@dataclass
class GivenLogistic:
    """Coefficients in the vocabulary's order, read as a fitted model's are."""

    values: object
    intercept: float

    @property
    def coefficients(self):
        return Vectors.dense(self.values)


def score(model, df: DataFrame, out: str = "probability_1", cut: float = P.OUTCOME_CUT) -> DataFrame:
    """Positive-class probability and the class at ``>= cut`` (B19);
    Spark's own ``prediction`` column (``>``) is dropped."""
    s = model.transform(df)
    s = s.withColumn(out, F.col("_p1") if "_p1" in s.columns else vector_to_array("probability")[1])
    drop = [c for c in ("rawPrediction", "probability", "prediction", "_p1") if c in s.columns]
    return s.drop(*drop).withColumn("predicted", (F.col(out) >= cut).cast("int"))


def coefficient_table(model, vocab: Vocab) -> DataFrame:
    """I8: feature, coef, odds_ratio."""
    spark = _spark()
    rows = [(f, float(c)) for f, c in zip(vocab.features, model.coefficients.toArray())]
    df = spark.createDataFrame(rows, "feature string, coef double")
    return df.withColumn("odds_ratio", F.exp("coef"))


def coefficient_ends(model, vocab: Vocab, n: int = 5) -> DataFrame:
    """The ``n`` largest and the ``n`` smallest coefficients, each ranked."""
    from casebook.operators.rates import both_ends
    return both_ends(coefficient_table(model, vocab), n, "coef", "feature")


def logistic_gradient(model, train: DataFrame, vocab: Vocab, label: str = "label", weight: str = "weight",
                      C: float = 1.0) -> DataFrame:
    """Per feature, the gradient of the weighted, regularised log-loss at the model's
    coefficients, from the rows: 0 at the optimum."""
    z = F.aggregate(F.zip_with(F.col("_x"), F.array(*[F.lit(float(c)) for c in model.coefficients.toArray()]),
                               lambda x, b: x * b), F.lit(float(model.intercept)), lambda acc, x: acc + x)
    rows = train.select(vector_to_array("features").alias("_x"), F.col(label).cast("double").alias("_y"),
                        F.col(weight).alias("_w")).withColumn("_e", F.col("_w") * (1 / (1 + F.exp(-z)) - F.col("_y")))
    sums = rows.select("_e", F.posexplode("_x").alias("pos", "x")).groupBy("pos").agg(F.sum(F.col("_e") * F.col("x")).alias("g"))
    total = float(train.agg(F.sum(weight)).first()[0])
    coefs = _spark().createDataFrame([(i, f, float(c)) for i, (f, c) in enumerate(zip(vocab.features, model.coefficients.toArray()))],
                                     "pos int, feature string, coef double")
    return sums.join(coefs, "pos").select("feature", ((F.col("g") + F.col("coef") / C) / total).alias("gradient"))


def importance_table(model, vocab: Vocab) -> DataFrame:
    """I16: feature, importance (all features, model order)."""
    spark = _spark()
    imp = model.featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(vocab.features, imp)]
    return spark.createDataFrame(rows, "feature string, importance double")


def _spark():
    from pyspark.sql import SparkSession
    return SparkSession.getActiveSession()


def out_of_fold(df: DataFrame, fit: Callable[[DataFrame], object], fold: str = "fold",
                k: int = P.CV_FOLDS, score_col: str = "probability_1", train: DataFrame | None = None) -> DataFrame:
    """Predictions of every row by the model trained on the other folds
    (union of k held-out scorings).  ``train``: the rows of ``df`` in the form that
    ``fit`` takes (counted), if another."""
    parts = []
    for f in range(k):
        m = fit((df if train is None else train).where(F.col(fold) != f))
        parts.append(score(m, df.where(F.col(fold) == f), score_col))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cv_auc(oof: DataFrame, label: str = "label", score_col: str = "probability_1",
           fold: str = "fold", count: str | None = None) -> DataFrame:
    """Exact AUC per fold; mean and population std over folds."""
    per = EV.auc(oof, label, score_col, [fold], count)
    return per.agg(F.avg("auc").alias("mean_auc"), F.stddev_pop("auc").alias("std_auc"),
                   F.count(F.lit(1)).alias("folds"))


def oof_accuracy(oof: DataFrame, label: str = "label") -> DataFrame:
    """Accuracy of out-of-fold predictions (``forests.oob_accuracy`` is that of
    out-of-bag ones, I15)."""
    return oof.agg(F.avg((F.col(label) == F.col("predicted")).cast("double"))
                   .alias("oof_accuracy"))
