"""Outcome-rate tables, profiles and top/bottom reports.

All of these are one hash aggregate (partial aggregation map-side, so a hot
key costs one row per task before the shuffle) followed by work on the small
aggregated result.  Windows only ever run over aggregated rows.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _round(c: Column, digits: int | None) -> Column:
    # pandas .round() is half-to-even -> bround
    return c if digits is None else F.bround(c, digits)


# ------------------------------------------------------------------- D1
def rate_table(df: DataFrame, key: str, label: str, digits: int | None = 3,
               cases_name: str = "cases", rate_name: str = "rate",
               count_all: bool = False) -> DataFrame:
    """``groupby(key)[label].agg(count, mean)``: NULL keys dropped (N2),
    ``count`` counts non-null labels (N3) unless ``count_all`` (N4)."""
    n = F.count(F.lit(1)) if count_all else F.count(label)
    return (df.where(F.col(key).isNotNull())
              .groupBy(key)
              .agg(n.alias(cases_name), _round(F.avg(label), digits).alias(rate_name)))


def sort_rates(df: DataFrame, rate: str = "rate", key: str | None = None,
               ascending: bool = False) -> DataFrame:
    """sort by rate with the key as tie-breaker (ties are otherwise open)."""
    r = F.col(rate).asc_nulls_last() if ascending else F.col(rate).desc_nulls_last()
    order = [r] + ([F.col(key).asc()] if key else [])
    return df.orderBy(*order)


# ------------------------------------------------------------------- D2
def rate_tables_long(df: DataFrame, cols: Sequence[str], label: str, top: int = 5) -> DataFrame:
    """Rate per category for a list of columns in one pass (C4 folded in).

    Output: feature, category, rate (mean label), cases (all rows, N4),
    rank (1..top by rate desc, category asc), other_categories
    (= max(n_categories - top, 0)).
    """
    long = (df.select(label, *[F.col(c).cast("string").alias(c) for c in cols])
              .unpivot([label], list(cols), "feature", "category")
              .where(F.col("category").isNotNull()))
    agg = (long.groupBy("feature", "category")
               .agg(F.avg(label).alias("rate"), F.count(F.lit(1)).alias("cases")))
    # category count per feature: a second small aggregate (one row per
    # feature) instead of a count window, so the ranking window below is a
    # plain row_number <= top that Spark limits per partition before the
    # shuffle (WindowGroupLimit) -- a feature with millions of categories
    # never lands whole in one task.
    n_cat = agg.groupBy("feature").agg(
        F.greatest(F.count(F.lit(1)) - top, F.lit(0)).alias("other_categories"))
    w = Window.partitionBy("feature").orderBy(F.col("rate").desc_nulls_last(), F.col("category"))
    ranked = agg.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    # bound: one row per listed column
    return ranked.join(F.broadcast(n_cat), "feature", "inner")


# ------------------------------------------------------------------- D3
def grouped_mean(df: DataFrame, key: str, label: str, name: str = "rate") -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.avg(label).alias(name))


# ------------------------------------------------------------------- D4
def outcome_summary(df: DataFrame, label: str) -> DataFrame:
    """n rows, sum of label, mean, open counted two ways: ``label == 0`` and
    ``rows - sum`` (the latter counts NULL labels as open)."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(label).cast("long").alias("n_solved"),
        F.avg(label).alias("rate"),
        F.count_if(F.col(label) == 0).alias("n_open"),
        (F.count(F.lit(1)) - F.coalesce(F.sum(label), F.lit(0))).cast("long").alias("n_open_all"),
        F.count(label).alias("n_labelled"),
    )


# ------------------------------------------------------------------- D5
def value_counts(df: DataFrame, col: str, name: str = "n") -> DataFrame:
    return (df.where(F.col(col).isNotNull()).groupBy(col)
              .agg(F.count(F.lit(1)).alias(name)))


# ------------------------------------------------------------------- D6
def modes(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (),
          empty: str = "N/A") -> DataFrame:
    """Most frequent non-null value per column (ties -> smallest, N10);
    a group without any value gets ``empty``.

    Two aggregates instead of a per-group value->count map: counts per
    (group, column, value) with map-side combine, then the top value per
    (group, column) by ``min(struct(-n, value))``; a hot group with many
    distinct values never builds one large in-memory map."""
    by = list(by)
    long = (df.select(*by, *[F.col(c).cast("string").alias(c) for c in cols])
              .unpivot(by or [], list(cols), "_column", "_value")
              .where(F.col("_value").isNotNull()))
    counts = long.groupBy(*by, "_column", "_value").agg(F.count(F.lit(1)).alias("_n"))
    best = (counts.groupBy(*by, "_column")
                  .agg(F.min(F.struct((-F.col("_n")).alias("k"), F.col("_value").alias("v")))
                        ["v"].alias("_mode")))
    wide = best.groupBy(*by).pivot("_column", list(cols)).agg(F.first("_mode"))
    if by:
        # groups whose columns are all NULL still get a row ('N/A')
        groups = df.select(*by).distinct()
        w2 = wide.select(*[F.col(b).alias(f"_g{i}") for i, b in enumerate(by)], *cols)
        out = (groups.join(w2, [groups[b].eqNullSafe(w2[f"_g{i}"]) for i, b in enumerate(by)],
                           "left").select(*by, *cols))
    else:
        out = wide
    fill = (lambda c: F.col(c)) if empty is None else (lambda c: F.coalesce(F.col(c), F.lit(empty)))
    return out.select(*by, *[fill(c).alias(f"mode_{c}") for c in cols])


# ------------------------------------------------------------------- D7
def distribution_stats(df: DataFrame, col: str) -> DataFrame:
    """mean, median (linear interpolation), min, max of a numeric column.

    The median is exact: ``casebook.operators.ranking.exact_quantile`` finds
    the order statistics by bucketed counting instead of sorting everything
    in one task."""
    from casebook.operators.ranking import exact_quantile

    med = exact_quantile(df, col, 0.5)
    return df.agg(F.avg(col).alias("mean"), F.min(col).alias("min"),
                  F.max(col).alias("max")).withColumn("median", F.lit(med).cast("double"))


# ------------------------------------------------------------------- D8
def rate_range(rates: DataFrame, rate: str = "rate") -> DataFrame:
    return rates.agg(F.min(rate).alias("min_rate"), F.max(rate).alias("max_rate"))


# ------------------------------------------------------------------- D9
def missing_profile(df: DataFrame, cols: Sequence[str], keep_zero: bool = False) -> DataFrame:
    """Percent NULL per column in one aggregate, unpivoted to
    ``(column, missing_pct)``; columns without NULLs dropped."""
    row = df.agg(*[(F.avg(F.col(c).isNull().cast("double")) * 100).alias(c) for c in cols])
    long = row.unpivot([], list(cols), "column", "missing_pct")
    return long if keep_zero else long.where(F.col("missing_pct") > 0)


# ------------------------------------------------------------------ D10
def share_of_total(df: DataFrame, key: str, all_keys: DataFrame | None = None,
                   size: str = "size", pct: str = "pct") -> DataFrame:
    """Group size and percent of all rows; ``all_keys`` (one column named
    ``key``) lists groups that must appear even when empty (size 0)."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias(size))
    if all_keys is not None:
        sizes = all_keys.join(sizes, key, "left").fillna({size: 0})
    total = df.select(F.count(F.lit(1))).scalar()
    return sizes.withColumn(pct, F.col(size) * 100.0 / total)


# ------------------------------------------------------------------ D11
def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_cols", F.lit(len(df.columns)))


# ------------------------------------------------------------- F2-F6
def head(df: DataFrame, n: int, by: str, key: str, ascending: bool = False) -> DataFrame:
    """``orderBy(by, key).limit(n)`` with ``rank`` 1..n (E1).  Spark
    plans this as TakeOrderedAndProject: a per-task top-n, then a merge of
    n x tasks rows."""
    o = F.col(by).asc_nulls_last() if ascending else F.col(by).desc_nulls_last()
    top = df.orderBy(o, F.col(key).asc()).limit(n)
    w = Window.orderBy(o, F.col(key).asc())  # over at most n rows
    return top.withColumn("rank", F.row_number().over(w))


def tail(df: DataFrame, n: int, by: str, key: str) -> DataFrame:
    """last n of a descending sort, still reported descending."""
    bottom = df.orderBy(F.col(by).asc_nulls_first(), F.col(key).desc()).limit(n)
    w = Window.orderBy(F.col(by).desc_nulls_last(), F.col(key).asc())
    return bottom.withColumn("rank", F.row_number().over(w))


def both_ends(df: DataFrame, n: int, by: str, key: str) -> DataFrame:
    """top-n and bottom-n with a ``side`` column."""
    top = head(df, n, by, key).withColumn("side", F.lit("top"))
    bottom = head(df, n, by, key, ascending=True).withColumn("side", F.lit("bottom"))
    return top.unionByName(bottom)
