"""Two writers and a crash; expiry by timers whatever the batches."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.streaming import jobs, results, retention


def test_two_writers_and_a_crash(spark, tmp_path):
    root, schema = f"file://{tmp_path}/r", "job string, n long"
    rows = lambda *xs: spark.createDataFrame([*xs], schema)
    seen = lambda: sorted(map(tuple, results.committed(spark, root, schema).collect()))
    assert seen() == []
    a, b = results.begin(spark, root, 1), results.begin(spark, root, 1)
    na, nb = results.write_parts(rows(("x", 1), ("y", 2)), root, a), results.write_parts(rows(("x", 9)), root, b)
    assert (na, nb) == (2, 1) and seen() == []  # parts without a manifest
    assert results.commit(spark, root, 1, b, nb) and not results.commit(spark, root, 1, a, na)
    assert seen() == [("x", 9, 1)]
    crashed = results.begin(spark, root, 2)
    results.write_parts(rows(("z", 3)), root, crashed)
    results.begin(spark, root, 2)  # crashed before its parts
    assert seen() == [("x", 9, 1)]
    results.sink(root)(rows(("z", 4)), 2)
    results.sink(root)(rows(("z", 5)), 2)  # the batch runs again
    assert seen() == [("x", 9, 1), ("z", 4, 2)]
    assert results.cleaned(spark, root, lambda x: x.where("batch = 1")) == 1
    assert results.cleaned(spark, root) == 2 and results.cleaned(spark, root) == 0
    assert seen() == [("x", 9, 1), ("z", 4, 2)]
    assert len(list((tmp_path / "r/attempts").iterdir())) == 2 and not list((tmp_path / "r/manifests").glob("*.tmp"))


def test_replaced_files_are_not_owned(spark):
    ledger = spark.createDataFrame([("a", "t1", 1), ("b", "t2", None), ("c", "t3", 3), ("d", "t4", 4), ("e", "t5", 1)], "path string, token string, version int")
    stored = spark.createDataFrame([("a", "t1", 1), ("b", "t2", 7), ("c", "other", 3), ("d", "t4", 5)], "path string, token string, version int")
    assert sorted(r.path for r in results.owned(ledger, stored, ["path"]).collect()) == ["a", "b"]


@pytest.mark.parametrize("files", [1, 100])
def test_expiry_whatever_the_batches(spark, tmp_path, files):
    rng = random.Random(3)
    events = sorted((rng.randint(0, 2000) * 60, k, str(rng.randint(0, 3)), rng.choice(["submitted", "submitted", "running", "succeeded", "failed"])) for k in range(80))
    events.append((9000 * 60, 99, "last", "submitted"))
    day = F.timestamp_seconds(F.col("s"))
    for k in range(0, len(events), 27):
        part = spark.createDataFrame(events[k : k + 27], "s long, seq long, job string, kind string").withColumn("ts", day).withColumn("request", F.lit("r"))
        part.coalesce(1).select("job", "seq", "kind", "request", "ts").write.mode("append").json(f"{tmp_path}/in")
    hour, state, want = 3_600_000, {}, []
    for s, _, job, kind in [*events, *((9000 * 60, 0, j, "end") for j in "0123")]:
        status, since, fell = retention.advanced(*state.get(job, ("new", 0)), s * 1000, hour, 2 * hour)
        want += [(job, *x) for x in fell]
        if kind == "submitted" and status == "new":
            status, since = "queued", s * 1000
        elif kind == "running" and status == "queued":
            status, since = "running", s * 1000
        elif kind in ("succeeded", "failed") and status in ("queued", "running"):
            status, since = kind, s * 1000
            want.append((job, kind, since))
        state[job] = status, since
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, jobs.PROVIDER)
    try:
        out = retention.expiring(jobs.read_events(spark, f"{tmp_path}/in", files), hour, 2 * hour)
        out.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/state").foreachBatch(results.sink(f"{tmp_path}/out")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(key)
    got = sorted(tuple(r)[:3] for r in results.committed(spark, f"{tmp_path}/out", retention.OUT).collect())
    assert got == sorted(want) and {"SUBMISSION_EXPIRED", "expired", "gone"} <= {w for _, w, _ in got}


def test_deadlines():
    assert retention.advanced("queued", 0, 99, 100, 300) == ("queued", 0, [])
    assert retention.advanced("queued", 0, 400, 100, 300) == ("new", 100, [("SUBMISSION_EXPIRED", 100), ("expired", 200), ("gone", 400)])
    assert retention.advanced("running", 0, 10**9, 100, 300) == ("running", 0, [])
    assert retention.advanced("failed", 0, 10**9, 0, 300) == ("failed", 0, [])
