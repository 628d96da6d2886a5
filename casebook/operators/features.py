"""Feature preparation.

Fit/apply pattern, as in Spark ML: ``fit`` runs one aggregate and keeps a
small, bounded model on the driver (top-K values, vocabulary, codes); ``apply``
is a projection with literal expressions, so the large table is never
shuffled to use the model.  Only the target encoder, whose key count is not
bounded by construction, applies through a join (broadcast behind a size
check, a shuffle join beyond it).
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casebook.plans.joins import broadcast_if_small


# ------------------------------------------------------------------- B13
def impute_mode(df: DataFrame, col: str, token: str = "Unknown") -> DataFrame:
    """Replace the value ``token`` by the column's mode (ties -> smallest);
    NULLs stay NULL; a no-op when the mode is ``token`` itself."""
    from casebook.operators.rates import modes
    mode = modes(df, [col], empty=None).first()[0]  # two-stage, no value map
    if mode is None:
        return df
    return df.withColumn(col, F.when(F.col(col) == token, F.lit(mode)).otherwise(F.col(col)))


# ------------------------------------------------------------------- B14
def minmax(df: DataFrame, col: str, out: str) -> DataFrame:
    """``(x - min) / (max - min)`` over the table; NULL when max == min."""
    lo, hi = df.agg(F.min(col), F.max(col)).first()
    if lo is None:
        return df.withColumn(out, F.lit(None).cast("double"))
    return df.withColumn(out, F.try_divide(F.col(col) - F.lit(lo), F.lit(hi - lo)).cast("double"))


# ------------------------------------------------------------------- B15
@dataclass
class TopKModel:
    """Kept values per column; everything else (and NULL) -> ``other``."""

    keep: dict
    other: str = "Other"

    def column(self, col: str) -> Column:
        values = self.keep.get(col, [])
        return F.when(F.col(col).cast("string").isin(*values),
                      F.col(col).cast("string")).otherwise(F.lit(self.other))

    def apply(self, df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
        cols = list(self.keep) if cols is None else cols
        return df.withColumns({c: self.column(c) for c in cols})

    def table(self, spark) -> DataFrame:
        rows = [(c, v, i + 1) for c, vs in self.keep.items() for i, v in enumerate(vs)]
        return spark.createDataFrame(rows, "column string, value string, rank int")


def fit_topk(df: DataFrame, cols: Sequence[str], k: int = 15, other: str = "Other") -> TopKModel:
    """Top ``k`` most frequent non-null values of each column, ties by value
    ascending.  One aggregate over the unpivoted columns; at most
    ``k * len(cols)`` rows reach the driver."""
    long = (df.select(*[F.col(c).cast("string").alias(c) for c in cols])
              .unpivot([], list(cols), "column", "value")
              .where(F.col("value").isNotNull()))
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value"))
    top = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    keep: dict = {c: [] for c in cols}
    for r in top.orderBy("column", "rank").collect():
        keep[r["column"]].append(r["value"])
    return TopKModel(keep, other)


def semi_join_topk(df: DataFrame, model: TopKModel, col: str) -> DataFrame:
    """C3 as a filter: rows whose value is among the kept values.  The kept
    table has at most k rows, so the semi join is a broadcast."""
    spark = df.sparkSession
    keep = model.table(spark).where(F.col("column") == col).select(F.col("value").alias(col))
    return df.join(F.broadcast(keep), col, "left_semi")


# ------------------------------------------------------------- B18 / C1
@dataclass
class TargetEncoderModel:
    key: str
    rates: DataFrame          # key, rate
    global_mean: float
    out: str

    def apply(self, df: DataFrame, max_broadcast_rows: int = 1_000_000) -> DataFrame:
        """Left join of the per-key rate; unseen or NULL keys get the global
        mean (per-row fallback)."""
        r = broadcast_if_small(self.rates, max_broadcast_rows)
        return (df.join(r, self.key, "left")
                  .withColumn(self.out, F.coalesce(F.col("_te_rate"),
                                                   F.lit(self.global_mean)).cast("double"))
                  .drop("_te_rate"))


def fit_target_encoder(df: DataFrame, key: str, label: str, out: str | None = None) -> TargetEncoderModel:
    """Mean label per key (NULL keys and labels skipped) + the global mean."""
    rates = (df.where(F.col(key).isNotNull())
               .groupBy(key).agg(F.avg(label).alias("_te_rate"))
               .where(F.col("_te_rate").isNotNull()))
    gm = df.select(F.avg(label)).first()[0]
    return TargetEncoderModel(key, rates, gm, out or f"{key}_rate")


# --------------------------------------------------------- I1 / I2 / A8
@dataclass
class Vocab:
    """Ordered encoded feature list: numeric columns first (as they are),
    then ``<column>_<category>`` per categorical column with categories in
    lexicographic order; ``drop_first`` leaves out each column's first
    category (the baseline)."""

    numeric: list
    categories: dict          # column -> sorted categories kept as dummies
    sep: str = "_"

    @property
    def features(self) -> list[str]:
        out = list(self.numeric)
        for c, cats in self.categories.items():
            out += [f"{c}{self.sep}{v}" for v in cats]
        return out

    def rows(self) -> list[tuple]:
        rows = [(i, f, f, None) for i, f in enumerate(self.numeric)]
        i = len(rows)
        for c, cats in self.categories.items():
            for v in cats:
                rows.append((i, f"{c}{self.sep}{v}", c, v))
                i += 1
        return rows

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame(
            self.rows(), "pos int, feature string, column string, category string")

    def columns(self) -> list[Column]:
        """B24 by construction: one 0/1 column per vocabulary entry, in order;
        categories never seen at fit time are all-zero (= baseline)."""
        out = [F.col(c).cast("double").alias(c) for c in self.numeric]
        for c, cats in self.categories.items():
            for v in cats:
                out.append(F.coalesce((F.col(c).cast("string") == F.lit(v)), F.lit(False))
                           .cast("double").alias(f"{c}{self.sep}{v}"))
        return out

    def apply(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        return df.select(*keep, *self.columns())

    @classmethod
    def from_table(cls, table: DataFrame) -> "Vocab":
        numeric, cats = [], {}
        for r in table.orderBy("pos").collect():  # a stored (bounded) vocabulary
            if r["category"] is None:
                numeric.append(r["feature"])
            else:
                cats.setdefault(r["column"], []).append(r["category"])
        return cls(numeric, cats)


class TooManyCategories(ValueError):
    """The vocabulary would exceed its bound: bucket the column first."""


def _bounded_collect(df: DataFrame, max_rows: int, what: str):
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise TooManyCategories(f"{what}: more than {max_rows} distinct values; "
                                f"bucket with fit_topk first")
    return rows


def fit_vocab(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
              drop_first: bool = True, sep: str = "_", max_categories: int = 100_000) -> Vocab:
    """Distinct non-null categories per column (one aggregate).  Bucket
    high-cardinality columns first (``fit_topk``): the vocabulary is a
    driver-side model, so its size is checked against ``max_categories``
    before it is collected."""
    cats: dict = {c: [] for c in categorical}
    if categorical:
        long = (df.select(*[F.col(c).cast("string").alias(c) for c in categorical])
                  .unpivot([], list(categorical), "column", "value")
                  .where(F.col("value").isNotNull())
                  .distinct())
        for r in _bounded_collect(long.orderBy("column", "value"), max_categories, "vocabulary"):
            cats[r["column"]].append(r["value"])
    if drop_first:
        cats = {c: v[1:] for c, v in cats.items()}
    return Vocab(list(numeric), cats, sep)


def onehot_all(df: DataFrame, cols: Sequence[str], sep: str = "_") -> tuple[Vocab, DataFrame]:
    """``get_dummies(drop_first=False)``."""
    v = fit_vocab(df, [], cols, drop_first=False, sep=sep)
    return v, v.apply(df)


# ------------------------------------------------------------------- I3
@dataclass
class LabelCodes:
    """Alphabetical integer codes per column (NULL -> the text 'nan', N9)."""

    values: dict

    def column(self, col: str) -> Column:
        arr = F.array(*[F.lit(v) for v in self.values[col]])
        return (F.array_position(arr, F.coalesce(F.col(col).cast("string"), F.lit("nan")))
                - 1).cast("int")

    def apply(self, df: DataFrame, suffix: str = "_code") -> DataFrame:
        return df.withColumns({f"{c}{suffix}": self.column(c) for c in self.values})


def fit_label_codes(df: DataFrame, cols: Sequence[str], max_categories: int = 100_000) -> LabelCodes:
    long = (df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias(c) for c in cols])
              .unpivot([], list(cols), "column", "value").distinct())
    vals: dict = {c: [] for c in cols}
    for r in _bounded_collect(long.orderBy("column", "value"), max_categories, "label codes"):
        vals[r["column"]].append(r["value"])
    return LabelCodes(vals)
