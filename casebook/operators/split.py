"""Exact, reproducible sampling and splits.

Row order is ``md5(key | seed)`` (identical bytes in any SQL engine).
Samples and splits only need "the first n rows of each class", which
``ranking.first_by_hash`` answers with one threshold per class (a map-only
pass over the data after two small jobs); folds need every row's rank and
use ``ranking.hash_rank`` (bucketed by hash prefix, so no step sorts a whole
class in one task).
"""

from __future__ import annotations

from decimal import Decimal
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook import presets as P
from casebook.operators.ranking import first_by_hash, hash_rank


def share_of(n, fraction: float):
    """``fraction * n`` in decimal arithmetic: exact for any row count, where a
    double would put 0.3 * 10 just above 3."""
    return n.cast("decimal(20,0)") * F.lit(Decimal(str(fraction)))


def exact_sample(df: DataFrame, key: Sequence[str], fraction: float = P.SAMPLE_FRACTION,
                 seed=P.SPLIT_SEED) -> DataFrame:
    """Exactly ``round_half_even(fraction * n)`` rows, without
    replacement, chosen by hash order.  (``df.sample`` is Bernoulli: only
    approximately ``fraction``.)"""
    f = first_by_hash(df, key, seed, [], lambda n: F.bround(share_of(n, fraction), 0).cast("long"), out="_keep")
    return f.where(F.col("_keep")).drop("_keep")


def stratified_split(df: DataFrame, key: Sequence[str], label: str,
                     test_fraction: float = P.SPLIT_TEST_FRACTION, seed=P.SPLIT_SEED,
                     out: str = "split") -> DataFrame:
    """I4: per class, the first ``ceil(test_fraction * n_class)`` rows in
    hash order are 'test', the rest 'train' (exact class proportions).
    Rows with a NULL label are left out."""
    f = first_by_hash(df.where(F.col(label).isNotNull()), key, seed, [label],
                      lambda n: F.ceil(share_of(n, test_fraction)).cast("long"), out="_test")
    return (f.withColumn(out, F.when(F.col("_test"), "test").otherwise("train"))
             .drop("_test"))


def stratified_folds(df: DataFrame, key: Sequence[str], label: str, k: int = P.CV_FOLDS,
                     seed=P.SPLIT_SEED, out: str = "fold") -> DataFrame:
    """fold = (rank - 1) mod k inside each class."""
    r = hash_rank(df.where(F.col(label).isNotNull()), key, seed, strata=[label])
    return (r.withColumn(out, ((F.col("rank") - 1) % k).cast("int"))
             .drop("rank", "stratum_size"))


def split_and_folds(df: DataFrame, key: Sequence[str], label: str,
                    test_fraction: float = P.SPLIT_TEST_FRACTION, k: int = P.CV_FOLDS,
                    seed=P.SPLIT_SEED) -> DataFrame:
    """I4 + I5 from one ranking pass: same ``split`` and ``fold`` columns as
    ``stratified_split`` and ``stratified_folds``."""
    r = hash_rank(df.where(F.col(label).isNotNull()), key, seed, strata=[label])
    n_test = F.ceil(share_of(F.col("stratum_size"), test_fraction)).cast("long")
    return (r.withColumn("split", F.when(F.col("rank") <= n_test, "test").otherwise("train"))
             .withColumn("fold", ((F.col("rank") - 1) % k).cast("int"))
             .drop("rank", "stratum_size"))


def class_weights(df: DataFrame, label: str, out: str = "weight", count: str | None = None) -> DataFrame:
    """Balanced weights ``n / (n_classes * n_c)`` (one small aggregate).  ``count``:
    how many rows a row stands for."""
    counts = (df.where(F.col(label).isNotNull()).groupBy(label)
                .agg((F.sum(count) if count else F.count(F.lit(1))).alias("n")))
    n, n_classes = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    return counts.withColumn(out, F.lit(float(n or 0)) / (F.lit(n_classes) * F.col("n")))


def with_class_weights(df: DataFrame, label: str, out: str = "weight",
                       basis: DataFrame | None = None, count: str | None = None) -> DataFrame:
    """Attach balanced weights computed on ``basis`` (default: ``df``), e.g.
    the training rows only."""
    w = class_weights(basis if basis is not None else df, label, out, count).select(label, out)
    # bound: one row per class
    return df.join(F.broadcast(w), label, "left")
