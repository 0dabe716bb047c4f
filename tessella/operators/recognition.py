"""The protocol of a recognition service as a fold over its answers; nothing is sent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RETRIES, POLLS = 2, 180
SLOWEST, FASTEST, DEFAULT = 10, 1, 2  # seconds between requests
RESPONSE_BYTES = 8 << 20
#: Codes of answers that end the exchange (fixed values).
FAILURES = {"OCR_AUTHENTICATION_FAILED": (401, 403), "OCR_IMAGE_REJECTED": (400, 413, 415, 422), "OCR_RATE_LIMITED": (429,), "OCR_SERVICE_UNAVAILABLE": (500, 502, 503, 504)}
#: How a busy service answers by application: it waits, or refuses (fixed values).
BUSY = {"documents": None, "page images": (503, "CONVERSION_BUSY"), "audio": (503, "CONVERSION_BUSY"), "slides": (429, "BUSY")}
TIMEOUT, LONGEST = 180, 210  # seconds of a conversion


def failure(status: Column) -> Column:
    out = F.lit("OCR_INVALID_RESPONSE")
    for code, statuses in FAILURES.items():
        out = F.when(status.isin(*statuses), code).otherwise(out)
    return out


def pause(retry: Column) -> Column:
    """Seconds to wait, from the answer's Retry-After: clamped, the default if it is no number."""
    return F.least(F.greatest(F.coalesce(F.trim(retry).try_cast("int"), F.lit(DEFAULT)), F.lit(FASTEST)), F.lit(SLOWEST))


def outcome(answers: Column, budget: float) -> Column:
    """answers: array of (status, retry, state, bytes, seconds) in their order, the first to
    the submission, the others to polls. succeeded, a failure's code, or pending. Answers
    429 and 503 are asked again, twice at most; waiting and asking use up the budget."""
    start = F.struct(F.lit(None).cast("string").alias("result"), F.lit(False).alias("polling"), F.lit(0).alias("tries"), F.lit(0).alias("polls"), F.lit(float(budget)).alias("left"))

    def step(s: Column, a: Column) -> Column:
        left = s["left"] - a["seconds"]
        wait = pause(a["retry"])
        late = left - wait <= 0
        again, busy = a["status"].isin(429, 503), a["state"].isin("running", "notStarted")
        polls = F.when(s["polling"] & (s["tries"] == 0), s["polls"] + 1).otherwise(s["polls"])
        ended = F.when(a["state"] == "succeeded", "succeeded").when(a["state"].isin("failed", "canceled", "skipped"), "OCR_ANALYSIS_FAILED").when(busy, F.when(late, "OCR_TIMEOUT")).otherwise("OCR_INVALID_RESPONSE")
        result = (
            F.when(left <= 0, "OCR_TIMEOUT").when(polls > POLLS, "OCR_TIMEOUT").when(a["bytes"] > RESPONSE_BYTES, "OCR_RESPONSE_LIMIT").when(a["status"].between(300, 399), "OCR_UNSAFE_RESPONSE")
            .when(again & (s["tries"] >= RETRIES), failure(a["status"])).when(again, F.when(late, "OCR_TIMEOUT"))
            .when(~s["polling"], F.when(a["status"] != 202, failure(a["status"])).when(late, "OCR_TIMEOUT")).when(a["status"] != 200, failure(a["status"])).otherwise(ended)
        )
        new = F.struct(result.alias("result"), (s["polling"] | ~again).alias("polling"), F.when(again, s["tries"] + 1).otherwise(0).alias("tries"), polls.alias("polls"), (left - wait).alias("left"))
        return F.when(s["result"].isNotNull(), s).otherwise(new)

    return F.aggregate(answers, start, step, lambda s: F.coalesce(s["result"], F.lit("pending")))


def admission(app: Column, busy: Column) -> Column:
    """wait, or the status and code with which a busy application refuses; null if it is free."""
    out = F.lit(None).cast("string")
    for name, told in BUSY.items():
        out = F.when(app == name, "wait" if told is None else f"{told[0]} {told[1]}").otherwise(out)
    return F.when(busy, out)


def timeout(setting: Column) -> Column:
    """Seconds of a conversion: the default where the setting is blank, null where it is not
    between 1 and the longest."""
    n = F.trim(setting).try_cast("int")
    return F.when(~F.coalesce(setting.rlike(r"\S"), F.lit(False)), F.lit(TIMEOUT)).when(n.between(1, LONGEST), n)
