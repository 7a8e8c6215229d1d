"""Requests, results, notifications and the audit log as tables."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nabd import fixed_values as fv
from nabd.plans.staging import exists
from nabd.sources import versioned


def pending_requests(requests: DataFrame, limit: int = 20) -> DataFrame:
    """Oldest pending requests first."""
    pending = requests.filter(F.col("status") == "pending")
    return pending.orderBy(F.asc("created_at"), F.asc("request_id")).limit(limit)


def request_status(requests: DataFrame) -> DataFrame:
    return requests.select(
        "request_id",
        F.coalesce("status", F.lit("unknown")).alias("status"),
        F.coalesce(F.col("progress").cast("int"), F.lit(0)).alias("progress"),
        "error_message",
        "updated_at",
    )


def admission(requests: DataFrame) -> DataFrame:
    """What a trigger answers for each request."""
    status = F.col("status")
    return requests.select(
        "request_id",
        F.when(status == "completed", "already_completed")
        .when(status.isin("collecting", "analyzing"), "already_processing")
        .otherwise("queued")
        .alias("admission"),
    )


def first_arrivals(requests: DataFrame) -> DataFrame:
    """One row per request: the one created first, ties by content."""
    order = [F.asc_nulls_last("created_at"), F.to_json(F.struct(*requests.columns))]
    placed = F.row_number().over(Window.partitionBy("request_id").orderBy(*order))
    return requests.withColumn("_place", placed).filter("_place = 1").drop("_place")


def admitted(requests: DataFrame, events: DataFrame | None) -> DataFrame:
    """(request_id, admission) of arriving requests, given the status log so far.

    The log decides where it knows a request; the arriving row does for others.
    """
    if events is None:
        return admission(requests)
    known = current_status(events.join(requests.select("request_id"), "request_id", "left_semi"))
    known = known.select("request_id", F.col("status").alias("_known"))
    joined = requests.join(known, "request_id", "left")
    return admission(joined.withColumn("status", F.coalesce("_known", "status")))


def status_log(spark: SparkSession, path: str, before_batch: int) -> DataFrame | None:
    """The status log of earlier batches; what a batch wrote before it failed does not count."""
    if not exists(spark, path):
        return None
    return spark.read.parquet(path).filter(F.col("batch_id") < before_batch)


def status_event(changes: DataFrame) -> DataFrame:
    """Rows for the status log from request_id, status, progress, error_message.

    Completion sets the progress to 100 and stamps `completed_at`.
    """
    done = F.col("status") == "completed"
    now = F.current_timestamp()
    return changes.select(
        "request_id",
        "status",
        F.when(done, 100).otherwise(F.col("progress")).cast("int").alias("progress"),
        "error_message",
        now.alias("updated_at"),
        F.when(done, now).alias("completed_at"),
    )


def current_status(events: DataFrame) -> DataFrame:
    """Latest state per request. A field an event leaves null keeps its earlier value."""
    stamp = F.struct("updated_at", "progress")
    latest = {c: F.max_by(c, stamp).alias(c) for c in ("status", "progress")}
    kept = {
        c: F.max_by(c, F.when(F.col(c).isNotNull(), stamp)).alias(c)
        for c in ("error_message", "completed_at")
    }
    return events.groupBy("request_id").agg(
        *latest.values(), *kept.values(), F.max("updated_at").alias("updated_at")
    )


def save_results(results: DataFrame, path: str) -> None:
    """Replace the rows of exactly the requests in `results`; other requests stay.

    The change is committed at once and may be repeated: see `nabd.sources.versioned`.
    """
    versioned.upsert(results, path, "request_id")


def read_results(spark: SparkSession, path: str, schema) -> DataFrame:
    """The results as last committed."""
    return versioned.read(spark, path, schema)


def fetch_results(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Every request with its result, or `ready = false` while there is none."""
    packed = results.select(
        "request_id", F.struct(*[c for c in results.columns if c != "request_id"]).alias("results")
    )
    joined = requests.select("request_id", "status", "progress").join(packed, "request_id", "left")
    return joined.withColumn("ready", F.col("results").isNotNull())


def notifications(requests: DataFrame, results: DataFrame) -> DataFrame:
    """One notification per completed request that has a user."""
    done = results.filter("status = 'completed'").select("request_id")
    title = F.coalesce("title", F.lit(""))
    before, after = fv.NOTICE_BODY.split("{title}")
    return (
        requests.filter(F.coalesce("user_id", F.lit("")) != "")
        .join(done, "request_id", "left_semi")
        .select(
            "user_id",
            F.lit("analysis_complete").alias("type"),
            F.lit(fv.NOTICE_TITLE).alias("title"),
            F.concat(F.lit(before), title, F.lit(after)).alias("body"),
            F.concat(F.lit("#analysis-"), "request_id").alias("link"),
            F.lit(False).alias("is_read"),
        )
    )


def audit_rows(results: DataFrame, duration_seconds: float) -> DataFrame:
    """One audit row per request: totals and datasets, or the error."""
    done = F.col("status") == "completed"
    finished = F.struct(
        F.col("total_posts"),
        F.lit(float(duration_seconds)).alias("duration_seconds"),
        F.col("datasets_used"),
    )
    failed = F.struct(F.col("error_message").alias("error"))
    return results.select(
        F.lit(None).cast("string").alias("actor_id"),
        F.when(done, "ANALYSIS_COMPLETED").otherwise("ANALYSIS_FAILED").alias("action"),
        F.lit("analysis_request").alias("entity_type"),
        F.col("request_id").alias("entity_id"),
        F.when(done, F.to_json(finished)).otherwise(F.to_json(failed)).alias("metadata"),
    )


def append(rows: DataFrame, path: str, batch_id: int) -> None:
    """Add the rows of one micro-batch; a batch that is repeated replaces its own rows."""
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
