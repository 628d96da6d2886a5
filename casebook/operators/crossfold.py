"""Cross-validated logistic regression, all folds at once.

The fits of a cross-validation differ only in the rows they leave out, so each Newton
step gets the gradient, the Hessian and the loss of every fold from one aggregate: a
row adds to the sums of all folds but its own.  Rows are collapsed to distinct
(fold, label, features) with a count first, and a feature vector of m non-zero entries
adds m * (m + 1) / 2 products, whatever the width of the encoding.  What reaches the
driver is one row per pair of features that occur together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook import presets as P
from casebook.session import cut_lineage

#: Features whose Hessian the driver solves (a dense matrix of that side).
MAX_FEATURES = 3_000


@dataclass
class FoldModels:
    """Coefficients (the intercept last) of the fit that leaves each fold out, the class
    weights of its rows, and its steps."""

    coefficients: np.ndarray      # folds x (features + 1)
    weights: dict                 # (fold, label) -> weight
    steps: int

    def score(self, df: DataFrame, fold: str = "fold", features: str = "features", out: str = "probability_1",
              cut: float = P.OUTCOME_CUT) -> DataFrame:
        """Every row by the model that hasn't seen its fold, in one projection."""
        z = _dot(_entries(vector_to_array(features)), F.get(_table(self.coefficients), F.col(fold)))
        return df.withColumn(out, 1 / (1 + F.exp(-z))).withColumn("predicted", (F.col(out) >= cut).cast("int"))


def _table(rows: np.ndarray) -> Column:
    return F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in rows])


def _entries(x: Column) -> Column:
    """Non-zero entries of a feature array as (i, v), with the intercept's 1 at the end."""
    some = F.filter(F.transform(x, lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda e: e["v"] != 0)
    return F.concat(some, F.array(F.struct(F.size(x).alias("i"), F.lit(1.0).alias("v"))))


def _dot(entries: Column, beta: Column) -> Column:
    return F.aggregate(entries, F.lit(0.0), lambda acc, e: acc + e["v"] * F.get(beta, e["i"]))


def fit_folds(df: DataFrame, label: str = "label", fold: str = "fold", features: str = "features", k: int = P.CV_FOLDS,
              C: float = 1.0, tol: float = 1e-9, max_steps: int = 50) -> FoldModels:
    """The ``k`` logistic regressions (L2 with C, balanced class weights of the rows each
    one is fitted to, intercept not penalised) of a cross-validation."""
    entries = _entries(vector_to_array(features))
    width = df.select(F.size(vector_to_array(features))).first()
    if width is None:
        raise ValueError("no rows to fit")
    d = int(width[0])
    if d > MAX_FEATURES:
        raise ValueError(f"{d} features: more than {MAX_FEATURES}; fit the folds with models.out_of_fold")
    tuples = (df.select(F.col(fold).cast("int").alias("fold"), F.col(label).cast("double").alias("y"), entries.alias("e"))
              .groupBy("fold", "y", "e").agg(F.count(F.lit(1)).cast("double").alias("n")))
    product = F.flatten(F.transform("e", lambda a: F.transform(F.filter("e", lambda b: b["i"] >= a["i"]), lambda b: F.struct(
        a["i"].alias("i"), b["i"].alias("j"), (a["v"] * b["v"]).alias("v"), a["v"].alias("a")))))
    tuples = cut_lineage(tuples.withColumn("pairs", product))
    # one row per fold and class
    counts = {(r["fold"], r["y"]): r["n"] for r in tuples.groupBy("fold", "y").agg(F.sum("n").alias("n")).collect()}
    classes = sorted({y for _, y in counts})
    weights = {}
    for f in range(k):
        of = {y: sum(n for (g, z), n in counts.items() if g != f and z == y) for y in classes}
        for y in classes:
            weights[f, y] = sum(of.values()) / (len(classes) * of[y]) if of[y] else 0.0
    betas, last = np.zeros((k, d + 1)), np.full(k, np.inf)
    step, done, steps = np.zeros((k, d + 1)), np.zeros(k, bool), 0
    total = np.array([sum(n * weights[f, y] for (g, y), n in counts.items() if g != f) for f in range(k)])
    ridge = np.append(np.full(d, 1 / C), 0.0)
    while not done.all():
        if steps == max_steps:
            raise RuntimeError(f"{int((~done).sum())} of {k} folds not at their optimum after {max_steps} steps")
        grad, hess, loss = _sums(tuples, betas, weights, k, d)
        steps += 1
        loss = loss + (betas ** 2 * ridge).sum(1) / 2
        grad = grad + betas * ridge
        for f in range(k):
            if done[f]:
                continue
            if loss[f] > last[f] * (1 + 1e-12):  # too far: halve the way back
                step[f] /= 2
                betas[f] += step[f]
                continue
            last[f] = loss[f]
            if np.abs(grad[f]).max() <= tol * max(total[f], 1.0):
                done[f] = True
                continue
            step[f] = np.linalg.lstsq(hess[f] + np.diag(ridge), grad[f], rcond=None)[0]
            betas[f] -= step[f]
    return FoldModels(betas, weights, steps)


def _sums(tuples: DataFrame, betas: np.ndarray, weights: dict, k: int, d: int):
    """Gradient, Hessian and loss of every fold at its coefficients, one job."""
    classes = sorted({y for _, y in weights})
    weight = F.array(*[sum(F.when((F.col("y") == y) & (F.col("fold") != f), F.col("n") * weights[f, y]).otherwise(0.0) for y in classes)
                       for f in range(k)])
    z = F.transform(_table(betas), lambda b: _dot(F.col("e"), b))
    rows = tuples.select("y", "pairs", weight.alias("w"), z.alias("z"))
    p = [1 / (1 + F.exp(-F.col("z")[f])) for f in range(k)]
    w = [F.col("w")[f] for f in range(k)]
    y = F.col("y")
    # log(1 + exp(-m)) of the margin m, without overflow
    margin = [F.when(y > 0, F.col("z")[f]).otherwise(-F.col("z")[f]) for f in range(k)]
    lost = [F.log1p(F.exp(-F.abs(m))) + F.greatest(-m, F.lit(0.0)) for m in margin]
    rows = rows.select(F.inline("pairs"), *[(w[f] * (p[f] - y)).alias(f"g{f}") for f in range(k)],
                       *[(w[f] * p[f] * (1 - p[f])).alias(f"h{f}") for f in range(k)], *[(w[f] * lost[f]).alias(f"l{f}") for f in range(k)])
    last, corner = F.col("j") == d, (F.col("i") == d) & (F.col("j") == d)
    got = rows.groupBy("i", "j").agg(
        *[F.sum(F.col("v") * F.col(f"h{f}")).alias(f"h{f}") for f in range(k)],
        *[F.sum(F.when(last, F.col("a") * F.col(f"g{f}"))).alias(f"g{f}") for f in range(k)],
        *[F.sum(F.when(corner, F.col(f"l{f}"))).alias(f"l{f}") for f in range(k)]).collect()  # <= (d + 1)(d + 2) / 2 rows
    grad, hess, loss = np.zeros((k, d + 1)), np.zeros((k, d + 1, d + 1)), np.zeros(k)
    for r in got:
        for f in range(k):
            hess[f, r["i"], r["j"]] = hess[f, r["j"], r["i"]] = r[f"h{f}"]
            if r["j"] == d:
                grad[f, r["i"]] = r[f"g{f}"]
                if r["i"] == d:
                    loss[f] = r[f"l{f}"]
    return grad, hess, loss
