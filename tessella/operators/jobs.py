"""Conversion jobs: strict requests, state fold, outbox and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UUID = r"\A[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\z"
#: 3 to 63 lowercase letters, digits or single hyphens, with a letter or digit at both ends.
CONTAINER = r"\A(?=.{3,63}\z)(?!.*--)[a-z0-9][a-z0-9-]*[a-z0-9]\z"
ALIAS = r"\A[a-z][a-z0-9_]{0,31}\z"
DOT_SEGMENT = r"(\A|[/\\])\.\.?([/\\]|\z)"
TERMINAL = ("succeeded", "failed")
#: Status and retry of the error codes (fixed values).
ERRORS = {"INVALID_REQUEST": 400, "NOT_FOUND": 404, "JOB_ID_CONFLICT": 409, "NOT_READY": 409, "EXPIRED": 410, "INPUT_TOO_LARGE": 413, "UNSUPPORTED_TYPE": 415, "ENCRYPTED_DOCUMENT": 422, "BUSY": 429, "PROCESSING_FAILED": 500, "SUBMISSION_FAILED": 503}
FIELDS = {1: ["version", "jobId", "input", "output"], 2: ["version", "jobId", "input", "output", "metadata", "notification", "expectedETag", "ocr"]}


def request_error(body: Column) -> Column:
    """First failed rule of a request, or null. Duplicate keys and trailing text
    are no JSON; unknown fields, wrong types and fields of a later version are errors."""
    parsed = F.try_parse_json(body)
    # Only one JSON value may stand in the body: a second one after it is trailing text.
    whole = body.rlike(r"(?s)\A\s*\{.*\}\s*\z") & F.try_parse_json(F.concat(F.lit("["), body, F.lit("]"))).isNotNull() & (F.json_array_length(F.concat(F.lit("["), body, F.lit("]"))) == 1)
    field = lambda path, kind: F.try_variant_get(parsed, path, kind)
    version = field("$.version", "int")
    keys = F.json_object_keys(body)
    extra = lambda v: F.size(F.array_except(keys, F.array(*[F.lit(x) for x in FIELDS[v]]))) > 0
    typed = F.regexp_like(F.schema_of_variant(parsed), F.lit(r"version: BIGINT")) & F.regexp_like(F.schema_of_variant(parsed), F.lit(r"jobId: STRING"))
    return (
        F.when(body.isNull() | parsed.isNull() | ~whole, "INVALID_JSON")
        .when(version.isNull() | ~version.isin(1, 2) | ~typed, "INVALID_VERSION")
        .when(((version == 1) & extra(1)) | ((version == 2) & extra(2)), "UNKNOWN_FIELD")
        .when(~F.coalesce(field("$.jobId", "string").rlike(UUID), F.lit(False)), "INVALID_JOB_ID")
        .when(~F.coalesce(field("$.input.container", "string").rlike(CONTAINER), F.lit(False)), "INVALID_CONTAINER")
        .when(~F.coalesce(F.coalesce(field("$.output.storage", "string"), F.lit("default")).rlike(ALIAS), F.lit(False)), "INVALID_ALIAS")
        .when(~blob_path(field("$.input.path", "string"), 1024), "INVALID_PATH")
    )


def blob_path(path: Column, longest: int) -> Column:
    """Whether a path may name an input: not blank, without control characters and dot segments."""
    fine = (F.length(path) <= longest) & path.rlike(r"\S") & ~path.rlike(r"\p{Cc}") & ~path.rlike(DOT_SEGMENT)
    return F.coalesce(fine, F.lit(False))


def canonical(metadata: Column) -> Column:
    """A map with its keys in order, for the comparison of requests."""
    return F.map_from_entries(F.array_sort(F.map_entries(metadata)))


def folded(events: DataFrame, by: list[str], seq: str) -> DataFrame:
    """events: by, seq, kind (submitted, running, succeeded, failed), request, ts. The
    state of each job: its first terminal event settles it, later ones are counted as
    duplicates; a submission that differs from the first is a conflict."""
    terminal = F.col("kind").isin(*TERMINAL)
    order = F.struct(seq, "kind", "ts", "request")
    return events.groupBy(*by).agg(
        F.min(F.when(terminal, order)).alias("_end"),
        F.max(order).alias("_last"),
        F.min(F.when(F.col("kind") == "submitted", order)).alias("_first"),
        F.sum(F.when(terminal, 1).otherwise(0)).alias("_ends"),
        F.sum(F.when(F.col("kind") == "running", 1).otherwise(0)).alias("attempts"),
        F.collect_set(F.when(F.col("kind") == "submitted", F.col("request"))).alias("_requests"),
    ).select(
        *by,
        F.coalesce("_end.kind", F.when(F.col("attempts") > 0, "running"), "_last.kind").alias("status"),
        F.coalesce("_end.ts", "_last.ts").alias("updated"),
        "attempts",
        F.greatest(F.col("_ends") - 1, F.lit(0)).alias("duplicates"),
        (F.size("_requests") > 1).alias("conflict"),
    )


def outbox(states: DataFrame, sent: DataFrame, job: str) -> DataFrame:
    """Notifications of terminal jobs that were not sent: a stable event id, sent at
    least once."""
    event = F.concat_ws(":", F.col(job).cast("string"), "status")
    return states.where(F.col("status").isin(*TERMINAL)).withColumn("event_id", event).join(sent.select("event_id"), "event_id", "left_anti").select(job, "event_id", "status")


def expired(updated: Column, notified: Column, days: int, now: Column) -> Column:
    """Retention counts from the later of the last change and the notification."""
    return F.greatest(updated, F.coalesce(notified, updated)) + F.make_interval(days=F.lit(days)) <= now


def read_status(status: Column, gone: Column) -> Column:
    """HTTP status of a result read."""
    return F.when(status.isNull(), 404).when(gone, 410).when(~status.isin(*TERMINAL), 409).when(status == "failed", 422).otherwise(200)
