"""Messages of a queue: decoding, what is malformed, and what was delivered too often."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_DELIVERIES = 5
KINDS = ("submitted", "running", "succeeded", "failed")
BODY = "job string, kind string, request string"
#: A notification's size, in bytes (fixed value).
MOST_BYTES = 48 << 10


def decoded(messages: DataFrame, most: int = MOST_DELIVERIES) -> DataFrame:
    """messages: id, body (base64 of a UTF-8 JSON object) and deliveries, batch or stream. Adds job, kind, request and
    route: malformed for what is no base64, no UTF-8, no JSON object, or names no job and known kind; poison for what
    is well-formed and was delivered more than ``most`` times; else job."""
    text = F.try_validate_utf8(F.try_to_binary(F.col("body"), F.lit("base64")).cast("string"))
    out = messages.withColumn("_m", F.from_json(text, BODY))
    fine = (F.trim(F.col("_m.job")) != "") & F.col("_m.kind").isin(*KINDS)
    route = F.when(~F.coalesce(fine, F.lit(False)), "malformed").when(F.col("deliveries") > most, "poison").otherwise("job")
    field = lambda c: F.when(route != "malformed", F.col(f"_m.{c}")).alias(c)
    return out.select(*messages.columns, *[field(c) for c in ("job", "kind", "request")], route.alias("route"))


def routed(messages: DataFrame) -> dict[str, DataFrame]:
    """messages: of decoded(). The events for jobs, failures for jobs whose messages are poison, and the side table of
    malformed ones, which go no further."""
    return {
        "events": messages.where("route = 'job'").select("job", "kind", "request", "id"),
        "failures": messages.where("route = 'poison'").select("job", F.lit("failed").alias("kind"), F.lit("PROCESSING_FAILED").alias("error"), "id"),
        "malformed": messages.where("route = 'malformed'").select("id", "body", "deliveries"),
    }


def notification(job: Column, status: Column, result: Column, detail: Column, most: int = MOST_BYTES) -> Column:
    """The JSON of a job's notification, with a stable id; without its detail where it would be too large, and
    null where it is too large even so."""
    head = [F.concat_ws(":", job, status).alias("eventId"), job.alias("jobId"), status.alias("status"), result.alias("result")]
    whole, short = F.to_json(F.struct(*head, detail.alias("detail"))), F.to_json(F.struct(*head))
    return F.when(F.octet_length(whole) <= most, whole).when(F.octet_length(short) <= most, short)
