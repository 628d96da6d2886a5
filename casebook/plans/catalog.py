"""Shared inputs for the registered queries.

The ``cases`` table is three joins and one aggregate away from the raw
tables.  It is built once per session and input, written as Parquet into the
shared checkpoint folder, and every query reads only the columns it uses from
there - the same way for inputs of any size.  The key of a stored table holds the
names, sizes and times of the input files, so changed files are never served from
an old copy; ``clear`` deletes the stored tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.functions import rules as R
from casebook.session import drop_path, input_signature, scratch_path
from casebook.sources.cases import documents_cases, tpch_cases

_STORED: dict = {}


def input_key(spark: SparkSession, sf_dir: str, *more) -> tuple:
    """Identifies a result of this session over the files that ``sf_dir`` holds now."""
    return (spark.sparkContext.applicationId, sf_dir, input_signature(spark, sf_dir), *more)


def stored(spark: SparkSession, sf_dir: str, name: str, build, *more) -> DataFrame:
    """The table ``build()`` gives, written once per session, input and name."""
    key = input_key(spark, sf_dir, name, *more)
    if key not in _STORED:
        path = scratch_path(spark, name)
        build().write.parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shared case table."""
    return stored(spark, sf_dir, "cases", lambda: tpch_cases(spark, sf_dir))


def derive(df: DataFrame) -> DataFrame:
    """The derive stage: label and all rule-based categories, one projection
    (whole-stage codegen, no UDF)."""
    return df.withColumns({
        "label": R.OUTCOME.column("outcome"),
        "vulnerable": R.OutOfRangeFlag().column("age"),
        "age_cat": R.AGE_PROFILING.column("age"),
        "age_category": R.AGE_MODEL.column("age"),
        "item_group": R.ITEM_GROUPS.column("item"),
        "weapon_group": R.WEAPON5.column("weapon"),
        "weapon_model": R.WEAPON5_MODEL.column("weapon"),
        "weapon_service": R.WEAPON5_SERVICE.column("weapon"),
        "weapon_category": R.WEAPON3.column("weapon"),
        "grp_b_simple": R.SEGMENTS.column("grp_b"),
        "relation_simple": R.RELATION.column("relation"),
        "month_num": R.MONTH_NUMBER.column("month"),
    }).withColumn("month_flag", R.MONTH_FLAG.column("month_num"))


def derived_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(cases(spark, sf_dir))


def open_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2: label = 0."""
    return derived_cases(spark, sf_dir).where(F.col("label") == 0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_cases(spark, sf_dir)


def clear(spark: SparkSession) -> None:
    """Delete the tables stored by this session."""
    for path in _STORED.values():
        drop_path(spark, path)
    _STORED.clear()
