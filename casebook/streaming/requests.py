"""K1: request scoring as a Structured Streaming job.

Scoring is stateless (no aggregation, no watermark): JSON request files
arriving in a folder (one JSON document a line) are parsed, scored with the same
``score_requests`` plan as the batch job, and appended to a sink.  The
checkpoint location lives in the shared checkpoint folder, so a restarted
driver resumes where it stopped.

``start_answers`` writes answers and rejected requests to two tables, each batch into a
folder of its own number: a batch that is run again, because the job ended between the
two writes or before the batch was noted as done, replaces what it had written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from casebook.plans.scoring import coerce_requests, parse_requests, score_coerced, score_requests
from casebook.session import drop_path, scratch_path


def request_stream(spark: SparkSession, source_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return parse_requests(r.text(source_dir))


def start_scoring(spark: SparkSession, source_dir: str, sink_dir: str, fm, model,
                  checkpoint_dir: str | None = None, available_now: bool = True,
                  processing_time: str | None = None):
    """Start the streaming scorer; returns the ``StreamingQuery``."""
    scored = score_requests(request_stream(spark, source_dir), fm, model)
    w = (scored.writeStream.format("parquet").outputMode("append")
               .option("path", sink_dir)
               .option("checkpointLocation", checkpoint_dir or scratch_path(spark, "stream-ckpt")))
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()


def score_folder(spark: SparkSession, source_dir: str, fm, model) -> DataFrame:
    """Run the stream over everything in ``source_dir`` (availableNow), to its end
    however long that takes, and return the sink as a batch DataFrame.  A failed
    query raises."""
    sink = scratch_path(spark, "stream-out")
    start_scoring(spark, source_dir, sink, fm, model).awaitTermination()
    return spark.read.parquet(sink)


def _write_batch(fm, model, answers_dir: str, rejects_dir: str):
    def write(lines: DataFrame, batch: int) -> None:
        spark = lines.sparkSession
        # each request is parsed once: stored coerced, as both tables are made from it
        path = scratch_path(spark, "requests-coerced")
        c = coerce_requests(parse_requests(lines, keep_text="request")).drop("body")
        c.withColumn("request", F.when(F.col("error").isNotNull(), F.col("request"))).write.parquet(path)
        coerced = spark.read.parquet(path)
        # the model runs for good rows only; bad ones are known before it
        scored = score_coerced(coerced.where(F.col("error").isNull()), fm, model)
        scored.select("request_id", "response").write.mode("overwrite").parquet(f"{answers_dir}/batch={batch}")
        bad = coerced.where(F.col("error").isNotNull())
        bad.select("request_id", "error", "request").write.mode("overwrite").parquet(f"{rejects_dir}/batch={batch}")
        drop_path(spark, path)
    return write


def start_answers(spark: SparkSession, source_dir: str, answers_dir: str, rejects_dir: str, fm, model, checkpoint_dir: str,
                  max_files_per_trigger: int | None = None, processing_time: str | None = None):
    """Start the scorer with a place for each outcome: ``answers_dir`` (batch, request_id,
    response) and ``rejects_dir`` (batch, request_id, error, request: its text).  Every
    request is in one of them, once, however often the job is ended and started again
    with its ``checkpoint_dir``.  Without ``processing_time`` the query ends when all
    that is there has been answered."""
    r = spark.readStream
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    w = (r.text(source_dir).writeStream.foreachBatch(_write_batch(fm, model, answers_dir, rejects_dir))
         .option("checkpointLocation", checkpoint_dir))
    w = w.trigger(processingTime=processing_time) if processing_time else w.trigger(availableNow=True)
    return w.start()
