"""The pipeline, the registry and the SQL twins on the smallest tables."""

import re

import pytest

import __spark_entry__ as E
import corpus_pipeline
from casebook.llm import jaccard, toxicity
from test_llm_operators import brute_components, brute_contamination

SF = "/root/testdata/sf0.001"


def test_registry():
    q = E.queries()
    assert [n for n in q if re.match(r"op\d+_", n)] == [n for n in sorted(q, key=lambda n: int((re.findall(r"^op(\d+)_", n) or [0])[0]))
                                                        if re.match(r"op\d+_", n)]
    assert len([n for n in q if re.match(r"op\d+_", n)]) == 13 and q["pipeline"] is corpus_pipeline.run


@pytest.mark.parametrize("name", ["op3_jaccard_join", "op4_source_mix", "op6_decontaminate"])
def test_sql_twins(spark, duck, name):
    for t in ("documents", "benchmark"):
        duck.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = E.queries()[name](spark, SF).toPandas(), duck.execute(E.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols and (got[cols].dtypes == want[cols].dtypes).all()
    assert sorted(map(tuple, got[cols].itertuples(index=False))) == sorted(map(tuple, want[cols].itertuples(index=False)))


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["toxicity", "jaccard", "decontamination", "mixing", "tokens"]

    clean = stage["toxicity"](spark, docs, SF)
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    score = model.scorer()
    want = {r["doc_id"] for r in docs.collect() if score(r["text"] or "")[0] < 0.3}
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == want

    single = stage["jaccard"](spark, docs, SF)
    comps = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert single.columns == docs.columns
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(i for i, (_, c) in comps.items() if i == c)

    apart = stage["decontamination"](spark, docs, SF)
    found = brute_contamination([(r["doc_id"], r["text"]) for r in docs.collect()], bench)
    assert apart.columns == docs.columns
    assert sorted(r["doc_id"] for r in apart.collect()) == sorted(i for i, x in found.items() if not x[4])

    mixed = stage["mixing"](spark, docs, SF)
    assert mixed.columns == docs.columns
    words = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in docs.collect()}
    assert abs(sum(words[r["doc_id"]] for r in mixed.collect()) / sum(words.values()) - 1) < 0.1

    ids = stage["tokens"](spark, mixed, SF)
    assert ids.count() == mixed.count()


def test_whole_run(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    starts = sorted((r["start"], r["n_tokens"]) for r in got)
    assert got and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
