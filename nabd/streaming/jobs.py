"""Continuous versions: sentiment timeline, duplicate removal, request processing."""

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nabd.operators.clean import clean_posts, valid_posts
from nabd.operators.dedup import text_hash
from nabd.operators.sentiment import sentiment_timeline, with_lexicon_sentiment
from nabd.plans.analysis import analyze, completed_results
from nabd.plans.staging import scope, stage
from nabd.schema import POST, REQUEST
from nabd.sources import versioned
from nabd.sources.control import (
    admitted,
    append,
    audit_rows,
    first_arrivals,
    notifications,
    save_results,
    status_event,
    status_log,
)


def read_posts(spark: SparkSession, path: str, **options) -> DataFrame:
    """Canonical post files as they arrive, with the time `arrived` of their batch."""
    posts = spark.readStream.schema(POST).options(**options).parquet(path)
    return posts.withColumn("arrived", F.current_timestamp())


def timeline_stream(posts: DataFrame) -> DataFrame:
    """Posts per day and class, by the rules of the batch timeline.

    State is one row per day, so no day is ever closed and late posts count; a batch sends the days it
    changed: see `write_timeline`.
    """
    return sentiment_timeline(with_lexicon_sentiment(valid_posts(clean_posts(posts))))


def write_timeline(daily: DataFrame, path: str, checkpoint_path: str, trigger: dict | None = None):
    """Replace the days that a micro-batch changed, all at once; returns the started query.

    Readers use `read_timeline` and see the days as of the last batch that ended, also during a write.
    """

    def replace(rows: DataFrame, batch_id: int) -> None:
        versioned.upsert(rows, path, "day")

    return (
        daily.writeStream.outputMode("update")
        .foreachBatch(replace)
        .option("checkpointLocation", checkpoint_path)
        .trigger(**(trigger or {"processingTime": "30 seconds"}))
        .start()
    )


def read_timeline(spark: SparkSession, path: str, schema) -> DataFrame:
    return versioned.read(spark, path, schema)


def dedup_stream(posts: DataFrame, delay: str | None = None) -> DataFrame:
    """The first copy of each text, dated or not.

    State holds one hash per text seen; with `delay` only those of texts that arrived within it.
    Arrival never runs backwards, so no post is dropped as late.
    """
    hashed = posts.withColumn("text_hash", text_hash(F.coalesce("text", F.lit(""))))
    if delay is None:
        unique = hashed.dropDuplicates(["text_hash"])
    else:
        unique = hashed.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["text_hash"])
    return unique.drop("text_hash", "arrived")


def process_requests(
    spark: SparkSession,
    posts: DataFrame,
    requests_path: str,
    output_path: str,
    checkpoint_path: str,
    trigger: dict | None = None,
    source_options: dict | None = None,
    **analysis_options,
):
    """Analyze request files as they arrive; returns the started query.

    The checkpoint remembers the files seen. Admission is decided by the status log that earlier
    batches left under `output_path`: a request that is completed or under way is answered so and not
    analysed again, one that failed may be sent again. Of several rows of a request in a batch the
    one created first counts. Results are replaced by request id and the other rows by batch, so a
    batch that is repeated after a failure leaves the same tables. The requests of a batch share one
    scan of the posts. What a batch stages is deleted at its end.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        with scope(spark):
            log = status_log(spark, f"{output_path}/status", batch_id)
            arrived = stage(first_arrivals(batch.filter("status = 'pending'")), "arrived")
            answers = stage(admitted(arrived, log), "admitted")
            append(answers, f"{output_path}/admissions", batch_id)
            queued = answers.filter("admission = 'queued'").select("request_id")
            pending = stage(arrived.join(queued, "request_id", "left_semi"), "pending")
            if not pending.isEmpty():
                run(pending, batch_id)

    def run(pending: DataFrame, batch_id: int) -> None:
        started = time.monotonic()

        def note(changes: DataFrame, part: str) -> None:
            append(status_event(changes), f"{output_path}/status/part={part}", batch_id)

        def progress(state: str, percent: int) -> DataFrame:
            error = F.lit(None).cast("string").alias("error_message")
            return pending.select("request_id", F.lit(state).alias("status"), F.lit(percent).alias("progress"), error)

        note(progress("collecting", 10), "1")
        results = stage(analyze(posts, pending, **analysis_options), "results")
        note(progress("analyzing", 50), "2")
        save_results(completed_results(results), f"{output_path}/results")
        final = results.select("request_id", "status", F.lit(0).alias("progress"), "error_message")
        note(final, "3")
        append(notifications(pending, results), f"{output_path}/notifications", batch_id)
        append(audit_rows(results, time.monotonic() - started), f"{output_path}/audit", batch_id)

    requests = spark.readStream.schema(REQUEST).options(**(source_options or {})).json(requests_path)
    return (
        requests.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint_path)
        .trigger(**(trigger or {"processingTime": "30 seconds"}))
        .start()
    )
