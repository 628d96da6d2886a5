"""Dictionaries of any size and sparse encodings.

The distinct values of all columns are range-partitioned by column and value; a value's
code is its place among its column's values, from running offsets over the partitions.
The dictionary stays a table: rows get their codes by a join per column (broadcast only
behind a row check), and the encoding of a row is one sparse vector, however many
categories there are.  What reaches the driver is one row per column.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casebook.plans.joins import broadcast_if_small
from casebook.session import cut_lineage

#: Rows of one column's dictionary that are sent to every task at most.
BROADCAST_VALUES = 200_000


def fit_dictionary(df: DataFrame, cols: Sequence[str], null_text: str | None = None) -> DataFrame:
    """(column, value, code): the distinct values of each column in ascending order,
    numbered from 0.  NULL is left out, or is ``null_text``."""
    text = lambda c: F.col(c).cast("string") if null_text is None else F.coalesce(F.col(c).cast("string"), F.lit(null_text))
    long = (df.select(*[text(c).alias(c) for c in cols]).unpivot([], list(cols), "column", "value")
            .where(F.col("value").isNotNull()).distinct())
    # in order: partitions by range, rows in a partition numbered as they stand
    placed = cut_lineage(long.repartitionByRange("column", "value").sortWithinPartitions("column", "value")
                         .withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    sizes = placed.groupBy(part.alias("_p"), "column").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    # one row for each partition and column in it
    before = Window.partitionBy("column").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("column").alias("_c"), "_p", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return (placed.withColumn("_q", part).join(F.broadcast(starts), (F.col("column") == F.col("_c")) & (F.col("_q") == F.col("_p")))
            .select("column", "value", (F.col("_id") + F.col("_shift")).cast("long").alias("code")))


def with_codes(df: DataFrame, dictionary: DataFrame, cols: Sequence[str], suffix: str = "_code", null_text: str | None = None) -> DataFrame:
    """``df`` with the code of each column's value; NULL for values the dictionary lacks."""
    out = df
    for c in cols:
        one = dictionary.where(F.col("column") == c).select(F.col("value").alias("_value"), F.col("code").cast("int").alias(f"{c}{suffix}"))
        own = F.col(c).cast("string") if null_text is None else F.coalesce(F.col(c).cast("string"), F.lit(null_text))
        out = out.withColumn("_own", own).join(broadcast_if_small(one, BROADCAST_VALUES), F.col("_own") == F.col("_value"), "left").drop("_own", "_value")
    return out


@dataclass
class SparseEncoder:
    """Numeric columns as they are, then one entry per category of each column in
    ascending order, without the first one with ``drop_first`` (the layout of
    ``features.Vocab``)."""

    numeric: list
    categorical: list
    dictionary: DataFrame
    sizes: dict               # column -> categories
    drop_first: bool = True

    @property
    def width(self) -> int:
        return len(self.numeric) + sum(max(0, n - self.drop_first) for n in self.sizes.values())

    def features(self) -> DataFrame:
        """(pos, feature, column, category) of every entry, as a table."""
        rows, at = [], len(self.numeric)
        for c in self.categorical:
            rows.append((c, at - int(self.drop_first)))
            at += max(0, self.sizes[c] - self.drop_first)
        spark = self.dictionary.sparkSession
        starts = F.broadcast(spark.createDataFrame(rows, "column string, start long"))
        cats = (self.dictionary.where(F.col("code") >= int(self.drop_first)).join(starts, "column")
                .select((F.col("code") + F.col("start")).alias("pos"), F.concat("column", F.lit("_"), "value").alias("feature"),
                        "column", F.col("value").alias("category")))
        own = spark.createDataFrame([(i, c, c, None) for i, c in enumerate(self.numeric)], cats.schema)
        return own.unionByName(cats)

    def apply(self, df: DataFrame, keep: Sequence[str] = (), out: str = "features") -> DataFrame:
        """``keep`` and one sparse vector a row; values not seen at fit time and NULLs
        have no entry (B24)."""
        cols = [c for c in self.categorical if self.sizes[c] > self.drop_first]
        d = df.select(*dict.fromkeys(keep), *[F.col(c).cast("double").alias(f"_n{i}") for i, c in enumerate(self.numeric)],
                     *[F.col(c).cast("string").alias(f"_c{i}") for i, c in enumerate(cols)])
        named = self.dictionary.join(F.broadcast(df.sparkSession.createDataFrame(
            [(c, f"_c{i}") for i, c in enumerate(cols)], "column string, _as string")), "column").select(F.col("_as").alias("column"), "value", "code")
        d = with_codes(d, named, [f"_c{i}" for i in range(len(cols))], suffix="x")
        # the encoder leaves out the last index: absent values, and the first category if it is dropped, go there
        sizes = [self.sizes[c] + (0 if self.drop_first else 1) for c in cols]
        none = {f"_c{i}x": F.coalesce(F.when(F.col(f"_c{i}x") >= int(self.drop_first), F.col(f"_c{i}x") - int(self.drop_first)),
                                      F.lit(sizes[i] - 1)).cast("double") for i in range(len(cols))}
        d = d.withColumns(none) if none else d
        if cols:
            d = _encoder(d.sparkSession, sizes, list(none)).transform(d)
        inputs = [f"_n{i}" for i in range(len(self.numeric))] + [f"_v{i}" for i in range(len(cols))]
        return VectorAssembler(inputCols=inputs, outputCol=out).transform(d).select(*keep, out)


def _encoder(spark: SparkSession, sizes: list[int], inputs: list[str]):
    """A one-hot encoder for known category counts: fitted to a row of the largest codes."""
    top = spark.createDataFrame([tuple(float(n - 1) for n in sizes)], ", ".join(f"{c} double" for c in inputs))
    return OneHotEncoder(inputCols=inputs, outputCols=[f"_v{i}" for i in range(len(inputs))], dropLast=True).fit(top)


def fit_sparse(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], drop_first: bool = True) -> SparseEncoder:
    """The dictionary of the categorical columns, kept as a table, and its sizes."""
    dictionary = cut_lineage(fit_dictionary(df, categorical)) if categorical else df.sparkSession.createDataFrame(
        [], "column string, value string, code long")
    sizes = dict.fromkeys(categorical, 0)
    sizes.update({r["column"]: r["n"] for r in dictionary.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()})  # a row per column
    return SparseEncoder(list(numeric), list(categorical), dictionary, sizes, drop_first)


def feature_sums(encoded: DataFrame, groups: Sequence[str] = (), features: str = "features") -> DataFrame:
    """(``groups``, pos, total): column sums of sparse vectors, from their entries alone."""
    v = F.unwrap_udt(features)
    # a dense vector has no indices: its places are
    index = F.when(v["type"] == 0, v["indices"]).otherwise(F.sequence(F.lit(0), F.size(v["values"]) - 1))
    return (encoded.select(*groups, F.inline(F.arrays_zip(index.alias("pos"), v["values"].alias("x"))))
            .groupBy(*groups, "pos").agg(F.sum("x").alias("total")))
