"""Boundaries of a service: versioned reads, bodies, settings and the maintenance cursor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAINTENANCE_IDS = 100  # ids of one maintenance pass


def matched(requests: DataFrame, files: DataFrame, path: str = "path", version: str = "version") -> DataFrame:
    """requests with status: 200 where the file has the version asked for (or none was),
    404 without the file, 409 where it has been replaced. A path names one file."""
    held = files.select(F.col(path), F.col(version).alias("_held"))
    asked = F.col(version)
    status = F.when(F.col("_held").isNull(), 404).when(asked.isNotNull() & (asked != F.col("_held")), 409).otherwise(200)
    return requests.join(held, path, "left").withColumn("status", status).drop("_held")


def body_error(content_type: Column, size: Column, most: int) -> Column:
    """Why a raw body is refused, or null: a form, an empty body, one over the limit."""
    return F.when(F.coalesce(F.lower(F.trim(content_type)), F.lit("")).startswith("multipart/"), "MULTIPART").when(F.coalesce(size, F.lit(0)) < 1, "EMPTY").when(size > most, "INPUT_TOO_LARGE")


def parts_error(parts: Column, most_request: int, most_file: int) -> Column:
    """Why a form is refused, or null. parts: array of (name, size): exactly one file and
    one request, each within its limit, the file not empty."""
    named = lambda n: F.filter(parts, lambda p: p["name"] == n)
    size = lambda n: F.element_at(named(n), 1)["size"]
    return F.when((F.size(parts) != 2) | (F.size(named("file")) != 1) | (F.size(named("request")) != 1), "INVALID_MULTIPART").when(size("request") > most_request, "REQUEST_TOO_LARGE").when(size("file") > most_file, "INPUT_TOO_LARGE").when(size("file") == 0, "EMPTY")


def ocr_error(endpoint: Column, key: Column, timeout: Column) -> Column:
    """State of recognition settings: disabled where the address or key is missing, invalid,
    or configured. The address is an https origin; the key is visible ASCII; 1 to 180 seconds."""
    blank = lambda c: ~F.coalesce(c.rlike(r"\S"), F.lit(False))
    origin = endpoint.rlike(r"(?i)\Ahttps://[A-Za-z0-9.-]+(:\d{1,5})?/?\z")
    port = F.try_to_number(F.nullif(F.regexp_extract(endpoint, r":(\d{1,5})/?\z", 1), F.lit("")), F.lit("99999"))
    seconds = F.when(blank(timeout), 60).otherwise(F.expr("0") + timeout.try_cast("int"))
    fine = origin & F.coalesce(port.between(1, 65535), F.lit(True)) & key.rlike(r"\A[!-~]+\z") & F.coalesce(seconds.between(1, 180), F.lit(False))
    return F.when(blank(endpoint) | blank(key), "disabled").when(fine, "configured").otherwise("invalid")


def limit_setting(text: Column, default: int, *, zero: bool = False) -> Column:
    """A limit from a setting: the default where it is blank, null where it is no number of
    the kind (positive, or with zero not negative)."""
    n = F.trim(text).try_cast("long")
    return F.when(~F.coalesce(text.rlike(r"\S"), F.lit(False)), F.lit(default).cast("long")).when(n >= (0 if zero else 1), n)


def next_ids(index: DataFrame, after: str | None, most: int = MAINTENANCE_IDS) -> DataFrame:
    """The ids of the next maintenance pass: the first ones after the cursor. The limit is
    the pass's own; the cursor that follows is the greatest of them."""
    rows = index.select("id").where(F.lit(True) if after is None else F.col("id") > after)
    return rows.orderBy("id").limit(most)


def swept(index: DataFrame, most: int = MAINTENANCE_IDS) -> DataFrame:
    """index (bucket, id) with the pass that reaches each id, if a cursor goes through each
    bucket in order of ids, most at a time."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("bucket").orderBy("id"))
    return index.withColumn("pass", F.expr("0L") + F.floor((k - 1) / most))
