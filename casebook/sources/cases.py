"""Case-table sources (A1-A4, A10) and the bindings onto the test tables.

A *case table* has one row per case: a key, categorical attributes and a
yes/no outcome.  ``load_cases`` reads such a table from CSV or parquet;
``tpch_cases`` derives one from the TPC-H-style tables so that every query
grows with the input.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casebook import presets as P
from casebook.functions import rules as R
from casebook.plans.joins import broadcast_if_small


class MissingSourceError(FileNotFoundError):
    """A2: the input path does not exist."""


def normalise_names(df: DataFrame, sep: str = " ", repl: str = "_") -> DataFrame:
    """A3: replace ``sep`` with ``repl`` in every column name."""
    mapping = {c: c.replace(sep, repl) for c in df.columns if sep in c}
    return df.withColumnsRenamed(mapping) if mapping else df


def available(df: DataFrame, wanted) -> list[str]:
    """A4: the subset of ``wanted`` columns present in ``df``, in order."""
    have = set(df.columns)
    return [c for c in wanted if c in have]


def _is_missing_path(e: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e)


#: Cell patterns of the types that ``infer_types`` finds, the narrowest first.
CELL_TYPES = [("boolean", r"(?i)^(?:true|false)$"), ("bigint", r"^\s*[+-]?[0-9]+\s*$"),
              ("double", r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$|^\s*[+-]?(?i:inf|infinity)\s*$")]


def infer_types(df: DataFrame, na_texts=tuple(P.NA_TEXTS)) -> dict[str, str]:
    """The narrowest type that every cell of each text column has: boolean, bigint,
    double, else string.  Cells that hold one of ``na_texts`` or NULL say nothing; a
    column of nothing else is double.  Whole numbers beyond 64 bits are double.  One
    aggregate over the table, one row to the driver."""
    bad = []
    for i, c in enumerate(df.columns):
        cell = F.col(f"`{c}`")
        said = cell.isNotNull() & ~cell.isin(*na_texts)
        bad.append(F.count_if(said).alias(f"n{i}"))
        for kind, pattern in CELL_TYPES:
            fits = cell.rlike(pattern)
            if kind == "bigint":
                fits = fits & F.trim(cell).try_cast("bigint").isNotNull()
            bad.append(F.count_if(said & ~fits).alias(f"{kind}{i}"))
    r = df.agg(*bad).first()
    return {c: "double" if not r[f"n{i}"] else next((kind for kind, _ in CELL_TYPES if not r[f"{kind}{i}"]), "string")
            for i, c in enumerate(df.columns)}


def _parsed(cell, kind):
    return F.trim(cell).try_cast(kind) if isinstance(kind, str) else cell.try_cast(kind)


def load_cases(spark: SparkSession, path: str, fmt: str = "csv",
               schema: T.StructType | None = None, normalise: bool = True,
               outcome_col: str = "Crime_Solved", label_col: str = "Solved",
               na_texts=tuple(P.NA_TEXTS), infer: bool = True) -> DataFrame:
    """A1-A3 + B1: read a case table, normalise names and add the 0/1 label.

    CSV cells are read as text (header, doubled quotes), a cell that holds one of
    ``na_texts`` is NULL, and the rest is cast to the type that ``schema`` gives
    its column; text that doesn't parse is NULL, and no cell becomes NaN.  Without
    a schema the types are those of ``infer_types`` (another pass over the file), or all
    text with ``infer=False``.  A missing path raises ``MissingSourceError``.
    """
    try:
        if fmt == "csv":
            reader = spark.read.option("header", True).option("escape", '"').option("multiLine", True).option("nullValue", None)
            if schema is not None:
                reader = reader.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields]))
            df = reader.csv(path)
            kinds = ({f.name: f.dataType for f in schema.fields} if schema is not None
                     else {c: t for c, t in infer_types(df, na_texts).items() if t != "string"} if infer else {})
            cell = lambda c: F.when(~F.col(f"`{c}`").isin(*na_texts), F.col(f"`{c}`"))
            df = df.select(*[(_parsed(cell(c), kinds[c]) if c in kinds else cell(c)).alias(c) for c in df.columns])
        else:
            reader = spark.read if schema is None else spark.read.schema(schema)
            df = reader.format(fmt).load(path)
    except AnalysisException as e:
        if _is_missing_path(e):
            raise MissingSourceError(path) from e
        raise
    if normalise:
        df = normalise_names(df)
    oc = outcome_col if outcome_col in df.columns else outcome_col.replace("_", " ")
    if oc in df.columns:
        df = df.withColumn(label_col, R.OUTCOME.column(oc))
    return df


def cases_from_rows(spark: SparkSession, rows, schema) -> DataFrame:
    """A10: in-memory rows (small, caller-supplied) as a DataFrame."""
    return spark.createDataFrame(rows, schema)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = os.path.join(sf_dir, f"{name}.parquet")
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if _is_missing_path(e):
            raise MissingSourceError(path) from e
        raise


CASES_COLUMNS = ["record_id", "outcome", "item", "age", "grp_a", "grp_b", "region",
                 "units", "year", "month", "price", "weapon", "relation", "sex"]


def _word(words, key: str):
    """The word that a key picks (NULL words and keys give NULL)."""
    texts = F.array(*[F.lit(w).cast("string") for w in words])
    return F.get(texts, (F.col(key) % len(words)).cast("int"))


def tpch_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``cases`` binding (one row per order).

    Plan shape: lineitem is aggregated per order (partial + final hash
    aggregate), which leaves it hash-partitioned on the order key, so the
    left join to orders shuffles only orders.  nation is broadcast behind a
    row-count check; customer and part joins are left to AQE (broadcast when
    the runtime size is small, sort-merge with skew splitting otherwise).
    """
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
        "o_orderpriority")
    customer = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_mktsegment")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    lines = (read_table(spark, sf_dir, "lineitem")
             .groupBy("l_orderkey")
             .agg(F.min("l_partkey").alias("pk"), F.count(F.lit(1)).alias("n_lines")))

    cust = customer.join(broadcast_if_small(nation, 10_000),
                         customer.c_nationkey == nation.n_nationkey, "inner")
    month_names = F.array(*[F.lit(m) for m in P.MONTHS])
    out = (orders
           .join(cust, orders.o_custkey == cust.c_custkey, "inner")
           .join(lines, orders.o_orderkey == lines.l_orderkey, "left")
           .join(part, F.col("pk") == part.p_partkey, "left")
           .select(
               F.col("o_orderkey").alias("record_id"),
               F.when(F.col("o_orderstatus") == "F", "Yes")
                .when(F.col("o_orderstatus") == "O", "No").alias("outcome"),
               F.col("p_name").alias("item"),
               (F.col("p_size") * 2).cast("double").alias("age"),
               F.col("o_orderpriority").alias("grp_a"),
               F.col("c_mktsegment").alias("grp_b"),
               F.col("n_name").alias("region"),
               F.coalesce(F.col("n_lines"), F.lit(0)).cast("int").alias("units"),
               F.year("o_orderdate").cast("int").alias("year"),
               F.element_at(month_names, F.month("o_orderdate")).alias("month"),
               F.col("o_totalprice").alias("price"),
               _word(P.BIND_WEAPONS, "pk").alias("weapon"),
               _word(P.BIND_RELATIONS, "o_custkey").alias("relation"),
               _word(P.BIND_SEXES, "o_orderkey").alias("sex"),
           ))
    return out


def documents_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second binding: all documents, with a 0/1 quality label where there is one."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return docs.join(labels, "doc_id", "left")
