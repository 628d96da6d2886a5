"""Registered queries of the operators, over the whole given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from casebook.llm import (alignment, decontamination, extract, fingerprints, jaccard, licenses, linededup, mixing, periods, tokens,
                          toxicity, unigram, warc)
from casebook.llm.common import scratch, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written and read back: doc_id, start, n_tokens, ids_crc32."""
    path = scratch(spark, "ids")
    tokens.write_ids(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"), end_id=2)
    return tokens.digests(spark, path)


def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of all pages, written as WARC files and read back."""
    path = scratch(spark, "warc")
    warc.write(warc.derive_pages(table(spark, sf_dir, "pages")), path)
    return warc.read(spark, path).selectExpr("type", "record_id", "refers_to", "uri", "date", "content_type", "block_digest",
                                             "n_bytes", "intact", "char_length(block) as n_chars")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with shingle Jaccard similarity of 0.8 or more."""
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mixing.mix(table(spark, sf_dir, "documents")).documents.select("doc_id", "size", "source_size", "target", "taken")


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    pages = table(spark, sf_dir, "pages")
    return extract.extract(pages, extract.fit(pages))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in all documents."""
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop(
        "starts", "ends", "items")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of all documents."""
    return unigram.token_counts(table(spark, sf_dir, "documents"), unigram.zipf_scores(tokenizer_path("piece_bpe_32k.model")))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of each line of all documents."""
    return linededup.dedup_lines(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))).selectExpr(
        "doc_id", "held_out", "score", "predicted", "size(offending) as n_offending")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints.edited_pairs(table(spark, sf_dir, "documents"))


def op11_align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of two tokenizers' tokens of all documents."""
    return alignment.scored(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of all documents, a tenth of which repeat a passage."""
    return periods.digests(periods.periodic_runs(periods.looped(table(spark, sf_dir, "documents"))))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License detections of all documents."""
    return licenses.detect(table(spark, sf_dir, "documents")).drop("detections")


QUERIES = {f.__name__: f for f in (op1_token_ids, op2_warc_derivatives, op3_jaccard_join, op4_source_mix, op5_main_text,
                                   op6_decontaminate, op7_token_counts, op8_line_dedup, op9_toxicity, op10_fingerprints, op11_align_tokens,
                                   op12_periodic_runs, op13_license_scan)}
