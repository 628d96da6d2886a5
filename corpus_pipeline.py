"""A training corpus from raw documents, as stages that are each written as Parquet
and read again: toxicity, n-gram Jaccard join, benchmark decontamination, mixing
sources to target weights, token-ID output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from casebook.llm import decontamination, jaccard, mixing, tokens, toxicity
from casebook.llm.common import scratch, table
from casebook.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, trained on this stage's labelled documents, rejects go."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them."""
    return mixing.copies(docs, mixing.mix(docs).documents)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix; per document what they hold."""
    path = scratch(spark, "pipeline-ids")
    tokens.write_ids(docs, path, tokenizer_path("word_bpe_49k.json"), end_id=2)
    return tokens.digests(spark, path)


STAGES = [("toxicity", drop_toxic), ("jaccard", drop_near_copies), ("decontamination", drop_contaminated),
          ("mixing", mix_sources), ("tokens", write_tokens)]

#: Trained weights and token files have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.

    NULL and empty texts pass the filters and end as the end id alone, as often as the
    mix takes them (0 times, as they have no words); rows of NULL or repeated ids are
    known by their text as well; columns beyond those of ``documents``, whatever their
    names, go along to the last stage; an empty table gives no rows; without labels or
    benchmark items nothing is toxic or contaminated."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = scratch(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
