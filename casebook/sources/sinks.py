"""Sinks (A5-A8): CSV tables for people, JSON/parquet for machines.

Writers are plain ``DataFrame.write`` calls: one file per task, no
``coalesce(1)`` funnel through a single task.  Arrays are joined to text
before CSV (CSV has no array type).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)
    return path


def write_rules_csv(rules: DataFrame, path: str) -> str:
    """A5: all rules, arrays as ', '-joined text, sorted by lift, to 9 places (the sort is
    a range-partitioned global sort; files are in lift order)."""
    from casebook.operators.itemsets import rules_for_csv
    return write_csv(rules_for_csv(rules).orderBy(F.round("lift", 9).desc(), "antecedents",
                                                  "consequents"), path)


def write_assignments_csv(assigned: DataFrame, path: str, key: str = "record_id") -> str:
    """(key, cluster)."""
    return write_csv(assigned.select(key, "cluster"), path)


def write_ranked_csv(scored: DataFrame, path: str, score: str, key: str = "record_id") -> str:
    """Every column plus the score, sorted by score descending."""
    return write_csv(scored.orderBy(F.col(score).desc(), F.col(key)), path)


def read_csv(spark, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


def read_ranked(spark, path: str, schema, place: str = "place") -> DataFrame:
    """A written table with each row's ``place``, from 1, in the order of the files'
    names and of the rows in them."""
    from pyspark.sql import Window
    rows = (spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)
            .select("*", F.col("_metadata.file_name").alias("_file"), F.monotonically_increasing_id().alias("_at")))
    inside = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_file").orderBy("_at")))
    # one row for each file
    before = (inside.groupBy("_file").agg(F.count(F.lit(1)).alias("_rows"))
              .withColumn("_before", F.coalesce(F.sum("_rows").over(
                  Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_rows"))
    return (inside.join(before, "_file").withColumn(place, (F.col("_n") + F.col("_before")).cast("long"))
            .drop("_file", "_at", "_n", "_before"))
