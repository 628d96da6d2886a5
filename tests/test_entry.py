"""Driver contract: entry, queries, oracle_sql; CSV loader (A1-A3)."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from casebook.session import scratch_path
from casebook.sources.cases import MissingSourceError, load_cases

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    rows = E.entry(spark).collect()
    assert len(rows) > 0 and set(rows[0].asDict()) == {"item_group", "cases", "rate"}


def test_registry_shape():
    q, o = E.queries(), E.oracle_sql()
    assert len(q) >= 60 and set(o) <= set(q)
    assert all(callable(f) for f in q.values())


@pytest.mark.parametrize("name", ["d1_rate_by_region", "d12_itemsets", "i4_stratified_split",
                                  "d19_auc", "i10_kmodes_assign"])
def test_queries_against_duckdb_on_smallest_data(spark, duck, name):
    for t in ("orders", "customer", "nation", "lineitem", "part", "documents", "labels"):
        duck.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = E.queries()[name](spark, SF).toPandas()
    want = duck.execute(E.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    norm = lambda df: sorted(tuple(round(v, 6) if isinstance(v, float) else v
                                   for v in r) for r in df[cols].itertuples(index=False))
    assert norm(got) == norm(want)


def test_csv_loader_normalises_and_labels(spark):
    path = scratch_path(spark, "csv")
    df = spark.createDataFrame([(1, "Yes", "Handgun"), (2, "No", None), (3, "Maybe", "Knife")],
                               "`Record ID` int, `Crime Solved` string, Weapon string")
    df.write.option("header", True).csv(path)
    got = load_cases(spark, path, schema=df.schema).orderBy("Record_ID").collect()
    assert [r["Solved"] for r in got] == [1, 0, None]
    assert "Crime_Solved" in got[0].asDict()
    with pytest.raises(MissingSourceError):
        load_cases(spark, path + "-absent")


def test_optional_column_probing_and_rows_source(spark):
    from casebook.sources.cases import available, cases_from_rows
    df = cases_from_rows(spark, [(1, "x")], "id int, Weapon string")
    assert available(df, ["Weapon", "State", "id"]) == ["Weapon", "id"]


def test_csv_cells_that_are_missing_or_quoted(spark):
    path = scratch_path(spark, "csv-na")
    lines = ['Record ID,Victim Age,Weapon,Crime Solved', '1,NaN,"say ""gun"" x",Yes', "2,41,NA,No", "3,abc,None,No", "4,,Rifle,"]
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(path)
    schema = spark.createDataFrame([], "`Record ID` int, `Victim Age` double, Weapon string, `Crime Solved` string").schema
    got = {r["Record_ID"]: r for r in load_cases(spark, path, schema=schema).collect()}
    assert [got[i]["Victim_Age"] for i in (1, 2, 3, 4)] == [None, 41.0, None, None]
    assert [got[i]["Weapon"] for i in (1, 2, 3, 4)] == ['say "gun" x', None, None, "Rifle"]
    assert [got[i]["Solved"] for i in (1, 2, 3, 4)] == [1, 0, 0, None]


def test_changed_input_is_read_anew(spark):
    """A stored table is keyed by the files it was made from."""
    import shutil
    from casebook.plans import catalog
    sf = scratch_path(spark, "sf").removeprefix("file:")
    shutil.copytree(SF, sf, copy_function=shutil.copyfile)
    os.chmod(sf, 0o755)  # the given folder may be read-only
    n = catalog.cases(spark, sf).count()
    half = spark.read.parquet(f"{SF}/orders.parquet").limit(100)
    half.coalesce(1).write.parquet(f"{sf}-new")
    part = [f for f in os.listdir(f"{sf}-new") if f.endswith(".parquet")][0]
    shutil.copyfile(f"{sf}-new/{part}", f"{sf}/orders.parquet")
    assert catalog.cases(spark, sf).count() == 100 < n
