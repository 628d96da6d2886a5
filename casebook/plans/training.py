"""The training run as one plan: derive -> split -> fit feature models on the
train side only -> encode -> weights -> fit -> evaluate -> persist.

``FeatureModel`` bundles everything scoring needs (target rates, kept top-K
values, vocabulary, numeric fill values) so that training and scoring apply
the same transformations (no train/score skew).  Persisted with Spark
writers into a caller-given folder (A8, A9).
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass
from typing import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook import presets as P
from casebook.operators import features as FE
from casebook.operators import split as SP
from casebook.session import cut_lineage, drop_path, scratch_path


@dataclass
class FeatureModel:
    numeric: list                 # raw numeric columns (before the rate column)
    categorical: list
    rate_key: str | None
    rate_out: str | None
    topk: FE.TopKModel | None     # None: no bucketing
    vocab: FE.Vocab
    fill: dict                    # numeric column -> train mean
    rates: DataFrame | None = None
    global_rate: float | None = None

    def encode(self, df: DataFrame, keep: Sequence[str] = (),
               use_given_rate: bool = False) -> DataFrame:
        """Rate lookup (global-mean fallback) -> top-K bucketing -> numeric
        fill -> vocabulary columns -> one vector column ``features``.
        ``use_given_rate``: the rate column is already in ``df`` (requests
        carry their own)."""
        d = df
        if self.rate_key and not use_given_rate:
            te = FE.TargetEncoderModel(self.rate_key, self.rates, self.global_rate, self.rate_out)
            d = te.apply(d)
        if self.topk:
            d = self.topk.apply(d, self.categorical)
        d = d.fillna({c: v for c, v in self.fill.items() if v is not None})
        # positional names: category text may hold characters that column
        # name parsing treats specially
        cols = [c.alias(f"_v{i}") for i, c in enumerate(self.vocab.columns())]
        enc = d.select(*dict.fromkeys(keep), *cols)
        va = VectorAssembler(inputCols=[f"_v{i}" for i in range(len(cols))],
                             outputCol="features")
        return va.transform(enc).select(*keep, "features")

    # -------------------------------------------------------------- A8/A9
    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        self.vocab.table(spark).coalesce(1).write.mode("overwrite").json(os.path.join(path, "vocab"))
        if self.topk:
            self.topk.table(spark).coalesce(1).write.mode("overwrite").json(os.path.join(path, "topk"))
        if self.rates is not None:
            self.rates.write.mode("overwrite").parquet(os.path.join(path, "rates"))
        meta = {"numeric": self.numeric, "categorical": self.categorical,
                "rate_key": self.rate_key, "rate_out": self.rate_out, "fill": self.fill,
                "global_rate": self.global_rate, "other": self.topk.other if self.topk else None}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode(
            "overwrite").text(os.path.join(path, "meta"))

    @classmethod
    def load(cls, path: str) -> "FeatureModel":
        spark = SparkSession.getActiveSession()
        meta = json.loads(spark.read.text(os.path.join(path, "meta")).first()[0])
        vocab = FE.Vocab.from_table(spark.read.schema(
            "pos int, feature string, column string, category string").json(os.path.join(path, "vocab")))
        keep: dict = {c: [] for c in meta["categorical"]}
        for r in () if meta["other"] is None else (spark.read.schema("column string, value string, rank int")
                  .json(os.path.join(path, "topk")).orderBy("column", "rank").collect()):  # <= k x columns
            keep[r["column"]].append(r["value"])
        rates = (spark.read.parquet(os.path.join(path, "rates")) if meta["rate_key"] else None)
        return cls(meta["numeric"], meta["categorical"], meta["rate_key"], meta["rate_out"],
                   FE.TopKModel(keep, meta["other"]) if meta["other"] is not None else None, vocab, meta["fill"], rates,
                   meta["global_rate"])


def fit_features(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
                 label: str = "label", rate_key: str | None = None, k: int | None = P.TOP_K_CATEGORIES,
                 drop_first: bool = True, fill_numeric: bool = True) -> FeatureModel:
    """Fit on the training rows only (the analysis fitted the target rate on
    all rows incl. the test rows, a leak this avoids).

    ``k``: categories kept per column, the others and NULL being one category;
    None keeps all, and NULL is the baseline (all indicators 0).
    ``fill_numeric``: NULLs of numeric columns become the mean of the training
    rows (our rule: the estimators take no NULLs)."""
    d = train
    rates, gm, rate_out = None, None, None
    nums = list(numeric)
    if rate_key:
        te = FE.fit_target_encoder(train, rate_key, label)
        te.rates = cut_lineage(te.rates)  # read by every encoding
        rates, gm, rate_out = te.rates, te.global_mean, te.out
        d = te.apply(d)
        nums = nums + [rate_out]
    topk = FE.fit_topk(d, categorical, k) if k is not None else None
    if topk:
        d = topk.apply(d, categorical)
    fill = {}
    if fill_numeric and nums:
        fill_row = d.agg(*[F.avg(c).alias(c) for c in nums]).first()
        fill = {c: (float(fill_row[c]) if fill_row[c] is not None else None) for c in nums}
    vocab = FE.fit_vocab(d, nums, categorical, drop_first=drop_first)
    return FeatureModel(list(numeric), list(categorical), rate_key, rate_out, topk, vocab, fill,
                        rates, gm)


@dataclass
class Prepared:
    features: FeatureModel
    frame: DataFrame              # record_id, label, split, fold, weight, features
    path: str                     # where it is stored


def prepare(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
            label: str = "label", key: str = "record_id", rate_key: str | None = None,
            seed: int = P.SPLIT_SEED, k: int | None = P.TOP_K_CATEGORIES) -> Prepared:
    """Labelled rows -> exact stratified split + folds -> feature model fitted
    on train -> encoded frame with balanced weights, stored once: read back, it has
    partitions by its size and the cores, as tree learning sends one set of node sums
    per partition."""
    kept = [key, label, *numeric, *categorical, *([rate_key] if rate_key else [])]
    spark = df.sparkSession
    rows = scratch_path(spark, "split")
    SP.split_and_folds(df.select(*dict.fromkeys(kept)), [key], label, seed=seed).write.parquet(rows)
    s = spark.read.parquet(rows)
    train = s.where(F.col("split") == "train")
    fm = fit_features(train, numeric, categorical, label, rate_key, k)
    enc = fm.encode(s, keep=[key, label, "split", "fold"])
    path = scratch_path(spark, "frame")
    SP.with_class_weights(enc, label, basis=train).withColumn(label, F.col(label).cast("double")).write.parquet(path)
    drop_path(spark, rows)
    return Prepared(fm, spark.read.parquet(path), path)
