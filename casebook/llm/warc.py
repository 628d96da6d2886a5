"""Operator 2: WARC derivatives: metadata and plain-text conversion records.

Every response record gives two records that refer to it: ``metadata`` (the
source's headers and digests as warc-fields) and ``conversion`` (its text).
Files are written by Spark's text writer: a record is one value, and the two line
ends that close a record in the format are the writer's line separator.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.llm.common import bounded_batches, pick
from casebook.llm.extract import plain_text

RESPONSE = "record_id string, uri string, date string, http string, body string, payload_digest string"
RECORD = ("record_id string, type string, refers_to string, uri string, date string, content_type string, "
          "block_digest string, n_bytes long, record string")
#: Records in a file at most: a file is read back as a whole.
FILE_RECORDS = 5_000


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(parts))}>"


def one_line(value: str) -> str:
    """A header value: no line end can start another header."""
    return re.sub(r"[\x00-\x1f\x7f]+", " ", value).strip()


def format_record(headers: list[tuple[str, str]], block: str) -> str:
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n" + block


def _response(i: str, u: str, h: str, date: str) -> tuple:
    """A response record's columns (RESPONSE) for a page that came without its headers."""
    body = h.encode("utf-8", "surrogatepass")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n"
    payload = digest(body)
    return record_id("response", i, u, payload), u, date, http, h, payload


def _derived(own_id: str, uri: str, date: str, http: str, body: str, payload: str):
    """The rows (RECORD) of a response's metadata and conversion records."""
    uri, lines = one_line(uri), [one_line(x) for x in re.split(r"\r\n|\n", http) if x.strip()]
    fields = [("sourceRecordID", own_id), ("sourcePayloadDigest", payload), ("sourceContentLength", str(len(body.encode("utf-8", "surrogatepass"))))]
    fields += [("sourceStatus", lines[0])] * bool(lines) + [("sourceHeader", h) for h in lines[1:]]
    for kind, content, block in (("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields)),
                                 ("conversion", "text/plain; charset=utf-8", plain_text(body))):
        data = block.encode("utf-8", "surrogatepass")
        own, sha = record_id(kind, own_id), digest(data)
        headers = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Refers-To", own_id),
                   ("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Block-Digest", sha),
                   ("Content-Type", content), ("Content-Length", str(len(data)))]
        yield own, kind, own_id, uri, date, content, sha, len(data), format_record(headers, block)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _page_columns(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    bounded_batches(pages.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return pick(pages, page_id=id_col, url=url_col, html=html_col).select(text("page_id"), text("url"), text("html"))


def responses(pages: DataFrame, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url",
              html_col: str = "html") -> DataFrame:
    """Response records of a table of pages.  NULL html is an empty body, a NULL url
    an empty one; the record id is derived from id, url and body, so reruns agree."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([_response(i, u, h, date) for i, u, h in zip(pdf["page_id"], pdf["url"], pdf["html"])], columns=_names(RESPONSE))

    return _page_columns(pages, id_col, url_col, html_col).mapInPandas(run, RESPONSE)


def derive(source: DataFrame) -> DataFrame:
    """Two records for each response row (columns of RESPONSE).  A response without
    text has a conversion of no bytes; NULL values are empty; repeated responses
    give repeated records; a body is read whole, whatever its length."""
    bounded_batches(source.sparkSession)

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([x for r in pdf.itertuples(index=False) for x in _derived(*r)], columns=_names(RECORD))

    return source.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in _names(RESPONSE)]).mapInPandas(run, RECORD)


def derive_pages(pages: DataFrame, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url",
                 html_col: str = "html") -> DataFrame:
    """``derive(responses(pages))`` in one pass over the pages."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([x for i, u, h in zip(pdf["page_id"], pdf["url"], pdf["html"]) for x in _derived(*_response(i, u, h, date))],
                               columns=_names(RECORD))

    return _page_columns(pages, id_col, url_col, html_col).mapInPandas(run, RECORD)


def write(records: DataFrame, path: str) -> None:
    """One WARC file for each partition and FILE_RECORDS records, gzipped."""
    (records.select(F.col("record").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
     .option("maxRecordsPerFile", FILE_RECORDS).text(path))


_CANONICAL = {x.lower(): x for x in ("WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI", "WARC-Date", "WARC-Block-Digest",
                                     "WARC-Payload-Digest", "Content-Type", "Content-Length")}


def _canonical(name: str) -> str:
    return _CANONICAL.get(name.strip().lower(), name)


def parse(data: bytes):
    """(headers, block) of each record; lengths come from the headers, so a block may
    hold any bytes."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        # header names count without case; a value may follow the colon at once
        headers = {_canonical(k): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(headers["Content-Length"])
        yield headers, data[end + 4:end + 4 + n]
        at = end + 4 + n + 4


READ = ("type string, record_id string, refers_to string, uri string, date string, content_type string, "
        "block_digest string, n_bytes long, intact boolean, block string")


def _unpacked(name: str, content: bytes) -> bytes:
    """A file's bytes; a gzip file may have a member for each record."""
    return gzip.decompress(content) if name.endswith(".gz") else content


def read(spark: SparkSession, path: str, glob: str = "*.txt.gz") -> DataFrame:
    """The records of the files under ``path``, of any type; headers that a record lacks
    are NULL.  ``intact``: the block has its digest (NULL without one)."""

    def run(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                rows = []
                for h, block in parse(_unpacked(name, content)):
                    sha = h.get("WARC-Block-Digest")
                    rows.append((h.get("WARC-Type"), h.get("WARC-Record-ID"), h.get("WARC-Refers-To"), h.get("WARC-Target-URI"), h.get("WARC-Date"),
                                 h.get("Content-Type"), sha, len(block), None if sha is None else digest(block) == sha,
                                 block.decode("utf-8", "replace")))
                    if len(rows) == 500:
                        yield pd.DataFrame(rows, columns=_names(READ)).astype({"intact": "boolean"})
                        rows = []
                yield pd.DataFrame(rows, columns=_names(READ)).astype({"intact": "boolean"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", "content").mapInPandas(run, READ)


def read_responses(spark: SparkSession, path: str, glob: str = "*.warc*") -> DataFrame:
    """The response records of WARC files (columns of RESPONSE), for ``derive``: the HTTP
    block is cut at its empty line into status and headers, kept as they are, and the
    body, in the charset the headers name (UTF-8 without; bytes that don't decode are
    replaced).  The payload digest is the record's own, or that of the body.  Records of
    other types are left out; one without an empty line is all headers."""

    def run(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                rows = []
                for h, block in parse(_unpacked(name, content)):
                    if h.get("WARC-Type") != "response":
                        continue
                    cut = re.search(rb"\r?\n\r?\n", block)
                    head, body = (block, b"") if cut is None else (block[:cut.start()], block[cut.end():])
                    http = head.decode("iso-8859-1")
                    said = re.search(r"(?im)^content-type:.*?charset=[\"']?([\w.:-]+)", http)
                    try:
                        text = body.decode(said[1] if said else "utf-8", "replace")
                    except LookupError:
                        text = body.decode("utf-8", "replace")
                    rows.append((h.get("WARC-Record-ID"), h.get("WARC-Target-URI"), h.get("WARC-Date"), http, text,
                                 h.get("WARC-Payload-Digest") or digest(body)))
                    if len(rows) == 100:
                        yield pd.DataFrame(rows, columns=_names(RESPONSE))
                        rows = []
                yield pd.DataFrame(rows, columns=_names(RESPONSE))

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", "content").mapInPandas(run, RESPONSE)
