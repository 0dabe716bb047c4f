"""Limits one by one and together; messages and notifications."""

import base64
import json

from pyspark.sql import functions as F

from tessella.operators import blocks
from tessella.streaming import queue


def test_first_limit(spark):
    rows = [("a", 1, 5, 1), ("a", 2, 5, 1), ("a", 3, 5, 9), ("b", 1, 50, 9), ("c", 1, 9, 2), ("d", 1, 11, 6)]
    df = spark.createDataFrame(rows, "doc string, n long, x long, y long")
    most = F.when(F.col("doc") == "b", 0).otherwise(10)
    limits = {"y": (F.col("y"), F.lit(5)), "x": (F.col("x"), most), "both": (F.col("x") + F.col("y"), blocks.combined_limit(most, F.lit(5)))}
    got = {r.doc: (r.code, r["at"], r.n_x, r.n_y, r.n_both) for r in blocks.limited(df.withColumn("y", F.when(F.col("doc") == "b", 1).otherwise(F.col("y"))), ["doc"], "n", limits).collect()}
    # Both limits are passed by one row: the one that is looked at first tells. Without a limit for x, both together have none.
    assert got == {"a": ("y", 3, 15, 11, 26), "b": (None, None, 50, 1, 51), "c": (None, None, 9, 2, 11), "d": ("y", 1, 11, 6, 17)}


def test_messages(spark):
    good = json.dumps({"job": "j", "kind": "running", "request": "é", "more": [1]}, ensure_ascii=False).encode()
    code = lambda b: base64.b64encode(b).decode()
    bodies = {1: code(good), 2: code(good)[:-3] + "*", 3: code(b"\xc3\x28"), 4: code(b"null"), 5: code(b'{"job": " ", "kind": "running"}'), 6: code(b'{"job": "j", "kind": "other"}'), 7: None, 8: "", 9: code(good)}
    df = spark.createDataFrame([(k, b, 9 if k == 9 else 1) for k, b in bodies.items()], "id int, body string, deliveries int")
    out = queue.decoded(df)
    assert {r.id: r.route for r in out.collect()} == {1: "job", **{k: "malformed" for k in range(2, 9)}, 9: "poison"}
    parts = {k: v.collect() for k, v in queue.routed(out).items()}
    assert [tuple(r) for r in parts["events"]] == [("j", "running", "é", 1)] and [tuple(r) for r in parts["failures"]] == [("j", "failed", "PROCESSING_FAILED", 9)] and len(parts["malformed"]) == 7


def test_notifications(spark):
    df = spark.createDataFrame([("j", "ok", "r", "é" * 10), ("j", "ok", "r", "é" * 30_000), ("j", "ok", "r" * 50_000, "x")], "job string, status string, result string, detail string")
    got = [r[0] for r in df.select(queue.notification(*[F.col(c) for c in df.columns])).collect()]
    assert json.loads(got[0]) == {"eventId": "j:ok", "jobId": "j", "status": "ok", "result": "r", "detail": "é" * 10}
    assert json.loads(got[1]) == {"eventId": "j:ok", "jobId": "j", "status": "ok", "result": "r"} and got[2] is None
