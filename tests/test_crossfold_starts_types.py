"""Folds fitted together, Huang's starts, types of CSV cells."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from casebook.operators import crossfold as CV
from casebook.operators import kmodes as KM
from casebook.operators import models as MD
from casebook.operators import split as SP
from casebook.session import scratch_path
from casebook.sources.cases import infer_types, load_cases


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        a, b, c = rng.randint(0, 4), float(rng.random() < 0.3), float(rng.random() < 0.6)
        rows.append((i, float(a), b, c, float(rng.random() < 1 / (1 + np.exp(1.5 - 0.4 * a - b))), i % 5))
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, label double, fold int")
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df).cache()


def test_folds_match_single_fits(frame):
    m = CV.fit_folds(frame)
    for f in range(5):
        train = SP.with_class_weights(frame.where(F.col("fold") != f), "label")
        one = MD.logistic_regression(train, tol=1e-12)
        assert np.allclose(m.coefficients[f], [*one.coefficients.toArray(), one.intercept], atol=1e-5)
    got = {r["id"]: r["probability_1"] for r in m.score(frame).collect()}
    for r in frame.collect():
        z = float(np.dot(m.coefficients[r["fold"]], [*r["features"].toArray(), 1.0]))
        assert abs(got[r["id"]] - 1 / (1 + np.exp(-z))) < 1e-12
    assert m.steps < 15


def test_folds_with_a_constant_or_separating_feature(spark):
    rows = [(float(i % 2), 0.0, float(i % 2), i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, label double, fold int")
    m = CV.fit_folds(VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df), k=3)
    assert np.isfinite(m.coefficients).all() and (m.coefficients[:, 0] > 1).all() and np.allclose(m.coefficients[:, 1], 0)


def test_folds_need_rows(frame):
    with pytest.raises(ValueError):
        CV.fit_folds(frame.limit(0))


COLS = ["a", "b", "c"]


def test_huang_starts(spark):
    rng = random.Random(1)
    rows = [("xyz"[min(rng.randint(0, 5), 2)], "pq"[rng.randint(0, 1)], None if rng.random() < 0.2 else "uvw"[rng.randint(0, 2)]) for _ in range(400)]
    t = KM.collapse(spark.createDataFrame(rows, "a string, b string, c string"), COLS)
    have = {tuple(r[c] for c in COLS) for r in t.collect()}
    starts = KM.init_huang(t, COLS, 4, 3, 42)
    assert starts == KM.init_huang(t, COLS, 4, 3, 42) and starts != KM.init_huang(t, COLS, 4, 3, 43)
    for modes in starts:
        assert len({tuple(m) for m in modes}) == 4 and {tuple(m) for m in modes} <= have
    # more clusters than tuples: all tuples are there, none is made up
    few = KM.collapse(spark.createDataFrame([("x", "p", "u"), ("y", "q", "v")], "a string, b string, c string"), COLS)
    assert {tuple(m) for m in KM.init_huang(few, COLS, 3, 1, 1)[0]} <= {("x", "p", "u"), ("y", "q", "v")}
    assert KM.init_huang(few.limit(0), COLS, 2, 2, 1) == [[], []]


def test_huang_draws_by_frequency(spark):
    """Values come up about as often as their column has them."""
    t = KM.collapse(spark.createDataFrame([("x",)] * 700 + [("y",)] * 200 + [("z",)] * 100, "a string"), ["a"])
    drawn = Counter()
    counts = t.unpivot(["w"], ["a"], "column", "value").groupBy("column", "value").agg(F.sum("w").alias("n"))
    h = F.conv(F.substring(F.md5(F.concat_ws("|", "column", "value", "draw", F.lit("9"))), 1, 8), 16, 10).cast("long")
    key = -F.log((h + 0.5) / float(1 << 32)) / F.col("n")
    for r in (counts.select("column", "value", "n", F.explode(F.sequence(F.lit(0), F.lit(1999))).alias("draw"))
              .groupBy("draw").agg(F.min(F.struct(key.alias("key"), "value")).alias("b")).collect()):
        drawn[r["b"]["value"]] += 1
    assert abs(drawn["x"] / 2000 - 0.7) < 0.04 and abs(drawn["z"] / 2000 - 0.1) < 0.03


def test_huang_fit_is_no_worse(spark):
    from casebook.plans.catalog import open_cases
    from casebook.plans.queries import CLUSTER_COLS
    df = open_cases(spark, "/root/testdata/sf0.001")
    a, b = KM.fit(df, CLUSTER_COLS, 5, n_init=5), KM.fit(df, CLUSTER_COLS, 5, n_init=5, init="Huang")
    assert b.converged and b.cost <= 1.02 * a.cost
    with pytest.raises(ValueError):
        KM.fit(df, CLUSTER_COLS, 2, n_init=1, init="random")


CELLS = {
    "long": ["1", " -2 ", "+3", "NaN", ""], "beyond": ["9223372036854775808", "1", "2", "3", "4"], "real": ["1", "2.5", "1e3", ".5", "NA"],
    "inf": ["inf", "-Infinity", "1", "2", "3"], "truth": ["True", "false", "TRUE", "None", "true"], "mixed": ["True", "1", "2", "3", "4"],
    "late": ["1", "2", "3", "4", "x5"], "suffix": ["1d", "2f", "3", "4", "5"], "none": ["", "NA", "null", "NaN", "n/a"], "date": ["2020-01-01"] * 5,
}
TYPES = {"long": "bigint", "beyond": "double", "real": "double", "inf": "double", "truth": "boolean", "mixed": "string", "late": "string",
         "suffix": "string", "none": "double", "date": "string"}


def test_types_of_cells(spark):
    df = spark.createDataFrame(list(zip(*CELLS.values())), ", ".join(f"{c} string" for c in CELLS))
    assert infer_types(df) == TYPES
    assert infer_types(df.limit(0)) == dict.fromkeys(TYPES, "double")
    path = scratch_path(spark, "csv-types")
    df.coalesce(1).write.option("header", True).csv(path)
    got = load_cases(spark, path)
    assert dict(got.dtypes) == TYPES
    assert sorted(r["long"] for r in got.collect() if r["long"] is not None) == [-2, 1, 3]
    assert sum(r["truth"] is None for r in got.collect()) == 1 and all(r["none"] is None for r in got.collect())
    assert dict(load_cases(spark, path, infer=False).dtypes) == dict.fromkeys(TYPES, "string")
