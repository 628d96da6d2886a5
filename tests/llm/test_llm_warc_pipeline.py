"""WARC files that came from elsewhere, and the pipeline on odd tables."""

import gzip

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from casebook.llm import warc
from casebook.llm.common import scratch


def record(kind, block, **headers):
    head = [("WARC-Type", kind), *((k.replace("_", "-"), v) for k, v in headers.items()), ("Content-Length", str(len(block)))]
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


PAGE = "<html><body><h1>Größe</h1><p>über &amp; unter</p></body></html>"
FILES = {
    # a gzip member for each record, as crawlers write them
    "crawl-1.warc.gz": [
        record("warcinfo", b"software: test\r\n", WARC_Record_ID="<urn:info>", Content_Type="application/warc-fields"),
        record("response", b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\nSet-Cookie: a=1\r\nSet-Cookie: b=2\r\n\r\n" + PAGE.encode("latin-1"),
               WARC_Record_ID="<urn:one>", WARC_Target_URI="http://a.example/x", WARC_Date="2020-01-01T00:00:00Z", WARC_Payload_Digest="sha1:GIVEN",
               Content_Type="application/http; msgtype=response"),
        record("response", b"HTTP/1.1 301 Moved Permanently\r\nLocation: http://a.example/new\r\n\r\n", WARC_Record_ID="<urn:two>",
               WARC_Target_URI="http://a.example/old", WARC_Date="2020-01-01T00:00:01Z")],
    # lower-case header names, no URI, no date, a body with an empty line and an unknown charset
    "crawl-2.warc": [
        b"WARC/1.1\r\nwarc-type: response\r\nwarc-record-id:<urn:three>\r\ncontent-length: %d\r\n\r\n" % 90
        + b"HTTP/1.1 200 OK\nContent-Type: text/html; charset=none-such\n\n<p>a</p>\n\n<p>b</p>".ljust(90) + b"\r\n\r\n",
        record("request", b"GET / HTTP/1.1\r\n\r\n", WARC_Record_ID="<urn:four>")],
}


@pytest.fixture(scope="module")
def crawl(spark):
    path = scratch(spark, "crawl")
    local = path.removeprefix("file:")
    import os
    os.makedirs(local)
    for name, records in FILES.items():
        with open(f"{local}/{name}", "wb") as f:
            f.write(b"".join(gzip.compress(r) if name.endswith(".gz") else r for r in records))
    return path


def test_responses_of_other_files(spark, crawl):
    got = {r["record_id"]: r for r in warc.read_responses(spark, crawl).collect()}
    assert set(got) == {"<urn:one>", "<urn:two>", "<urn:three>"}
    one, two, three = (got[f"<urn:{x}>"] for x in ("one", "two", "three"))
    assert one["body"] == PAGE and one["payload_digest"] == "sha1:GIVEN" and one["http"].count("Set-Cookie") == 2
    assert two["body"] == "" and two["payload_digest"] == warc.digest(b"") and "Location: http://a.example/new" in two["http"]
    assert three["uri"] is None and three["date"] is None and three["body"].rstrip() == "<p>a</p>\n\n<p>b</p>"


def test_derive_write_and_read_back(spark, crawl):
    path = scratch(spark, "derived")
    warc.write(warc.derive(warc.read_responses(spark, crawl)), path)
    got = {(r["refers_to"], r["type"]): r for r in warc.read(spark, path).collect()}
    assert len(got) == 6 and all(r["intact"] for r in got.values())
    meta = got["<urn:one>", "metadata"]["block"].split("\r\n")
    assert meta[:4] == ["sourceRecordID: <urn:one>", "sourcePayloadDigest: sha1:GIVEN", f"sourceContentLength: {len(PAGE.encode())}",
                        "sourceStatus: HTTP/1.1 200 OK"]
    assert [x for x in meta if "Set-Cookie" in x] == ["sourceHeader: Set-Cookie: a=1", "sourceHeader: Set-Cookie: b=2"]
    assert got["<urn:one>", "conversion"]["block"] == "Größe\nüber & unter" and got["<urn:two>", "conversion"]["n_bytes"] == 0
    assert "sourceHeader: Location: http://a.example/new" in got["<urn:two>", "metadata"]["block"]
    assert got["<urn:three>", "conversion"]["block"] == "a\nb" and got["<urn:three>", "conversion"]["uri"] == ""


def test_read_of_any_records(spark, crawl):
    got = {r["record_id"]: r for r in warc.read(spark, crawl, glob="*.warc*").collect()}
    assert got["<urn:info>"]["type"] == "warcinfo" and got["<urn:info>"]["refers_to"] is None and got["<urn:info>"]["intact"] is None
    assert got["<urn:four>"]["block"].startswith("GET /") and len(got) == 5


def test_one_pass_is_both_passes(spark):
    pages = spark.createDataFrame([(1, "http://x/", PAGE), (None, None, None), (2, "u", ""), (2, "u", ""), (3, "long", "<p>" + "word " * 200_000)],
                                  "page_id long, url string, html string").withColumn("record", F.lit("x"))
    a, b = (sorted(map(tuple, df.collect())) for df in (warc.derive(warc.responses(pages)), warc.derive_pages(pages)))
    assert a == b and len(a) == 10


# -- the pipeline ----------------------------------------------------------------------

NEAR = "a near copy of this sentence stands in several documents of the table and differs in its very last word "
ROWS = ([(i, NEAR + f"w{i}", "en", "a", 1) for i in range(5)] + [(10, None, None, None, None), (11, "", "en", "b", 0), (11, "", "en", "b", 0),
        (12, "clean " * 50_000, "en", "b", 9), (None, "no id here, but words enough for a document of its own", "de", "c", 2),
        (None, "another one without an id, and with other words than the first", "de", "c", 2), (13, "x", None, "c", 1), (14, "benchmark phrase", "en", "a", 1)]
        + [(20 + i, f"document number {i} has its own text, about {i * 7} and {i * 13} and nothing else " * 3, "en", "abc"[i % 3], 1) for i in range(30)])


def tables(spark, docs, labels, bench):
    path = scratch(spark, "odd-tables")
    docs.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    bench.write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs = docs.select("*", *[F.lit("x").alias(c) for c in ("row", "n", "key", "size", "component", "taken", "digest", "unit", "word")])
    labels = spark.createDataFrame([(1, 0, 0), (20, 1, 1), (None, 0, 1), (21, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "benchmark phrase"), (None, None), (2, "")], "item_id long, text string")
    return docs, labels, bench


def test_pipeline_on_odd_rows(spark, odd):
    path = tables(spark, *odd)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
    ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
    assert 14 not in ids and len([i for i in ids if i in range(5)]) <= 3 and None in ids
    got = corpus_pipeline.run(spark, path).collect()
    starts = sorted((r["start"], r["n_tokens"]) for r in got)
    assert got and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_pipeline_on_empty_tables(spark, odd):
    docs, labels, bench = odd
    assert corpus_pipeline.run(spark, tables(spark, docs.limit(0), labels.limit(0), bench.limit(0))).collect() == []
    assert corpus_pipeline.run(spark, tables(spark, docs, labels.limit(0), bench.limit(0))).count() > 0


def test_scratch_can_be_cleared(spark, monkeypatch):
    from casebook.llm import common
    monkeypatch.setattr(common, "_MADE", [])
    df = common.store(spark.range(3), "to-clear")
    path = common._MADE[0]
    assert df.count() == 3 and common.clear_scratch(spark) == 1 and common.clear_scratch(spark) == 0
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
