"""Dictionaries of any size, sparse encodings, and the stream with a place for each outcome."""

import json

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from casebook.operators import dictionary as DI
from casebook.operators import features as FE
from casebook.plans import scoring as SC
from casebook.session import scratch_path
from casebook.streaming import requests as RQ


def test_dictionary_of_200000_categories(spark):
    df = spark.range(400_000).select((F.col("id") % 200_000).cast("string").alias("k"), F.when(F.col("id") % 3 > 0, "x").alias("s"), F.lit(1.0).alias("v"))
    d = DI.fit_dictionary(df, ["k", "s"])
    want = sorted(str(i) for i in range(200_000))
    got = {r["value"]: r["code"] for r in d.where("column = 'k'").collect()}
    assert got == {v: i for i, v in enumerate(want)}
    assert [tuple(r) for r in d.where("column = 's'").collect()] == [("s", "x", 0)]
    enc = DI.fit_sparse(df, ["v"], ["k", "s"])
    assert enc.width == 1 + 199_999 + 0
    rows = enc.apply(df.where("k in ('0', '1', '99999')"), keep=["k"]).distinct().collect()
    assert {r["k"]: {int(i): x for i, x in zip(r["features"].indices, r["features"].values)} for r in rows} == {
        "0": {0: 1.0}, "1": {0: 1.0, got["1"]: 1.0}, "99999": {0: 1.0, got["99999"]: 1.0}}


@pytest.mark.parametrize("drop_first", [True, False])
def test_sparse_is_the_dense_encoding(spark, drop_first):
    rows = [(1.0, "b", "x"), (2.0, None, "y"), (0.0, "a", None), (4.0, "c", "x"), (5.0, "b", "only here")]
    df = spark.createDataFrame(rows, "n double, p string, q string")
    vocab = FE.fit_vocab(df, ["n"], ["p", "q"], drop_first=drop_first)
    enc = DI.fit_sparse(df, ["n"], ["p", "q"], drop_first=drop_first)
    assert [r["feature"] for r in enc.features().orderBy("pos").collect()] == vocab.features
    new = df.unionByName(spark.createDataFrame([(7.0, "never seen", "x")], df.schema))
    dense = sorted(tuple(r) for r in vocab.apply(new).collect())
    assert sorted(tuple(r["x"]) for r in enc.apply(new).select(vector_to_array("features").alias("x")).collect()) == dense
    sums = {r["pos"]: r["total"] for r in DI.feature_sums(enc.apply(new)).collect()}
    assert all(abs(sums.get(i, 0.0) - sum(r[i] for r in dense)) < 1e-12 for i in range(enc.width))


def test_empty_and_constant_columns(spark):
    df = spark.createDataFrame([(1.0, None, "k"), (2.0, None, "k")], "n double, p string, q string")
    enc = DI.fit_sparse(df, ["n"], ["p", "q"])
    assert enc.width == 1 and [r["features"].toArray().tolist() for r in enc.apply(df).collect()] == [[1.0], [2.0]]
    assert DI.fit_dictionary(df.limit(0), ["p", "q"]).collect() == []
    codes = DI.with_codes(df, DI.fit_dictionary(df, ["p"], null_text="nan"), ["p"], null_text="nan")
    assert [r["p_code"] for r in codes.collect()] == [0, 0]


# -------------------------------------------------------------------- the stream

class Ended(Exception):
    """The job ends here."""


def requests_of(n, bad):
    return [json.dumps({"request_id": str(i), "age": "abc" if i in bad else 30}) for i in range(n)]


def test_each_request_once_whatever_ends_the_job(spark, monkeypatch):
    def scored(requests, fm, model):
        c = SC.coerce_requests(requests)
        return c.select("request_id", "error", F.struct(F.col("v_age").alias("age")).alias("response"))

    monkeypatch.setattr(RQ, "score_requests", scored)
    src, out = scratch_path(spark, "in"), scratch_path(spark, "out")
    bad = {3, 7, 11}
    lines = requests_of(20, bad) + ["not json"]
    for part in range(4):  # four files, a batch each
        spark.createDataFrame([(x,) for x in lines[part::4]], "value string").coalesce(1).write.mode("append").text(src)
    written = RQ._write_batch
    at = {"n": 0}

    def ending(*args):
        write = written(*args)

        def run(df, batch):
            at["n"] += 1
            if at["n"] == 2:  # after the answers of the second batch, before its rejects
                monkeypatch.setattr(RQ, "coerce_requests", lambda *_: (_ for _ in ()).throw(Ended("between the two writes")))
            try:
                write(df, batch)
            finally:
                monkeypatch.setattr(RQ, "coerce_requests", SC.coerce_requests)
            if at["n"] == 4:  # both written, not noted as done
                raise Ended("before the commit")
        return run

    monkeypatch.setattr(RQ, "_write_batch", ending)

    def start():
        q = RQ.start_answers(spark, src, f"{out}/answers", f"{out}/rejects", None, None, f"{out}/ckpt", max_files_per_trigger=1)
        q.awaitTermination()

    for _ in range(2):
        with pytest.raises(Exception, match="between the two writes|before the commit"):
            start()
    start()
    good = sorted(int(r["request_id"]) for r in spark.read.parquet(f"{out}/answers").collect())
    rejects = spark.read.parquet(f"{out}/rejects").collect()
    assert good == [i for i in range(20) if i not in bad]
    assert sorted((r["request_id"] or "", r["request"]) for r in rejects) == sorted(
        [("", "not json")] + [(str(i), lines[i]) for i in bad])
    assert all(r["error"] for r in rejects) and at["n"] >= 6
    assert len({r["batch"] for r in spark.read.parquet(f"{out}/answers").collect()}) == 4
