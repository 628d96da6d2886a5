"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty
tables and extra columns whose names an operator uses itself."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from casebook.llm import decontamination, extract, fingerprints, jaccard, linededup, mixing, tokens, toxicity, unigram, warc
from casebook.llm.common import scratch
from casebook.llm.queries import tokenizer_path

CLASH = ("row", "n", "key", "shard", "size", "component", "line", "d1", "__k", "__b", "text_hash", "at", "bucket", "token")
LONG = "word and other words, " * 20000
TEXTS = [(1, "one two three four five six", "a"), (2, None, None), (3, "", "a"), (4, LONG, "b"),
         (5, "one two three four five six", "a"), (5, "one two three four five six", "a"), (None, "no id at all here now", "c"),
         (7, " \t\n ", None), (8, "x", "b"), (9, "ünïcode ß Σας 中文 \U0001f600", "c")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string, source string").repartition(3)
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "one two three"), (1, "one two three"), (2, None), (3, ""), (None, "x"), (4, "nowhere")],
                                 "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (5, 0), (5, 1), (8, None), (None, 1)], "doc_id long, toxic int")


def results(spark, docs, bench, labels):
    def ids(d):
        path = scratch(spark, "edge-ids")
        tokens.write_ids(d, path, tokenizer_path("word_bpe_49k.json"))
        return tokens.digests(spark, path)

    return {
        "tokens": ids(docs),
        "jaccard": jaccard.jaccard_components(docs),
        "mixing": mixing.mix(docs).documents,
        "decontamination": decontamination.contamination(docs, bench),
        "unigram": unigram.token_counts(docs, {"▁": -1.0, "▁word": -2.0, "o": -3.0}),
        "toxicity": toxicity.score(docs, toxicity.fit(docs, labels)),
        "fingerprints": fingerprints.edited_pairs(docs),
    }


def test_one_row_per_row(spark, docs, bench, labels):
    for name, df in results(spark, docs, bench, labels).items():
        got = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in df.collect())
        assert got == sorted((i is None, i or 0) for i, _, _ in TEXTS), name


def test_empty_tables(spark, docs, bench, labels):
    for name, df in results(spark, docs.limit(0), bench.limit(0), labels.limit(0)).items():
        assert df.collect() == [], name
    assert linededup.dedup_lines(docs.limit(0)).collect() == []
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert extract.extract(pages, extract.fit(pages)).collect() == []
    assert warc.derive(warc.responses(pages)).collect() == []
    assert decontamination.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert jaccard.one_of_each(docs.limit(0)).collect() == []
    assert mixing.copies(docs.limit(0), mixing.mix(docs.limit(0)).documents).collect() == []
    assert decontamination.drop_contaminated(docs.limit(0), bench).collect() == []


def test_filters_keep_rows_and_columns(spark, docs, bench, labels):
    one = jaccard.one_of_each(docs)
    assert one.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in one.collect()) == [0, 1, 2, 3, 4, 7, 8, 9]
    clean = decontamination.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in clean.collect()) == [0, 2, 3, 4, 7, 9]  # 8 is an item without an id
    hit = {r["doc_id"]: r for r in decontamination.contamination(docs, bench).collect()}[8]
    assert (hit["n_items"], hit["items"], hit["items_sha256"]) == (1, [None], hashlib.sha256(b"").hexdigest())
    model = toxicity.Model(-6.0, {"six": 12.0})
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 2, 3, 4, 7, 8, 9]


def test_pages_with_nulls(spark):
    pages = spark.createDataFrame([(1, None, None), (None, "u\r\nX: y", "<p>a</p>"), (2, "u", ""), (2, "u", "")],
                                  "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("type", F.lit(2))
    got = extract.extract(pages, extract.Weights()).collect()
    assert sorted((r["text"], r["n_chars"]) for r in got) == [("", 0), ("", 0), ("", 0), ("a", 1)]
    records = warc.derive(warc.responses(pages)).collect()
    assert len(records) == 8 and all("\n" not in r["uri"] for r in records)


def test_quiet_sentences_say_nothing(spark):
    """A clean text stays clean however long it is, and the score is the noisy-or of the
    sentences with a weighted word."""
    model = toxicity.Model(-3.0, {"bad": 2.0, "wors*": 1.5})
    long = "Nothing to see in this sentence. " * 20_000
    texts = [(1, long), (2, long + "Bad worse thing."), (3, "Bad. Worse? Bad worse!\nquiet"), (4, None)]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    p = lambda z: 1 / (1 + math.exp(-(z - 3)))
    assert got[1] == 0 and got[4] == 0
    assert abs(got[2] - p(3.5)) < 1e-12
    assert abs(got[3] - (1 - (1 - p(2)) * (1 - p(1.5)) * (1 - p(3.5)))) < 1e-12
    rest = toxicity.Model(-3.0, {"bad": 2.0}, 0.1)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(texts, "doc_id long, text string"), rest).collect()}
    assert 0.09 < got[1] < 0.1 and got[4] == 0
    assert abs(got[3] - (1 - (1 - p(2)) ** 2 * (1 - 0.1 * 2 / 22))) < 1e-12


def test_training_leaves_out_what_does_not_fit(spark):
    rows = [(i, ("you are an awful idiot. " if i % 2 else "a fine day for a walk. ") + f"word{i} ") for i in range(60)]
    rows += [(100, "endless " * 40_000)] + [(1, "you are an awful idiot. again " * 9)] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(100, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, train_chars=10_000)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, model).where("doc_id < 60").collect()}
    assert all(got[i] == i % 2 for i in range(60))
    assert toxicity.fit(docs, labels, train_chars=3).weights == {}
