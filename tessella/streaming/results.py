"""Results of batches that become visible as a whole: the manifest comes last.

A writer registers an attempt in the ledger before it writes anything, writes its parts into a
folder of the attempt, and commits by putting the batch's manifest if there is none. The first one
wins; a crash before that leaves parts that no reader sees. Cleanup deletes only what the ledger
owns: attempts without a manifest whose folder still carries their token and version.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "token string, batch long"
MANIFEST = "batch long, token string, rows long"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Puts a small file whole, or not at all if there is one: it is written beside and renamed,
    which fails if the name is taken."""
    jvm = spark._jvm
    target, fs = _fs(spark, path)
    beside, _ = _fs(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(beside, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    kind = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    none[0] = next(e for e in kind.getEnumConstants() if e.toString() == "NONE")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else fs.getUri(), spark._jsparkSession.sessionState().newHadoopConf())
    try:
        context.rename(fs.makeQualified(beside), fs.makeQualified(target), none)
        return True
    except Exception as failure:
        fs.delete(beside, False)
        if "FileAlreadyExistsException" in str(failure):
            return False
        raise


def begin(spark: SparkSession, root: str, batch: int) -> str:
    """Registers an attempt, before it writes anything; its token."""
    token = uuid.uuid4().hex
    put_if_absent(spark, f"{root}/_owned/{token}.json", json.dumps({"token": token, "batch": batch}))
    return token


def write_parts(df: DataFrame, root: str, token: str) -> int:
    """Writes the attempt's parts; the number of its rows."""
    path = f"{root}/attempts/token={token}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path).count()


def commit(spark: SparkSession, root: str, batch: int, token: str, rows: int) -> bool:
    """Makes an attempt the batch's result; False if another one is."""
    return put_if_absent(spark, f"{root}/manifests/{batch:012d}.json", json.dumps({"batch": batch, "token": token, "rows": rows}))


def _listed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    at, fs = _fs(spark, path)
    return spark.read.schema(schema).option("pathGlobFilter", "*.json").json(path) if fs.exists(at) else spark.createDataFrame([], schema)


def manifests(spark: SparkSession, root: str) -> DataFrame:
    return _listed(spark, f"{root}/manifests", MANIFEST)


def committed(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The rows of committed attempts alone, with their batch."""
    at, fs = _fs(spark, f"{root}/attempts")
    if not fs.exists(at):
        return spark.createDataFrame([], f"{schema}, batch long")
    parts = spark.read.schema(f"{schema}, token string").parquet(f"{root}/attempts")
    return parts.join(manifests(spark, root).select("batch", "token"), "token").drop("token")


def sink(root: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a batch that was committed before, by whichever writer, is not written again."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        at, fs = _fs(spark, f"{root}/manifests/{number:012d}.json")
        if not fs.exists(at):
            token = begin(spark, root, number)
            commit(spark, root, number, token, write_parts(batch, root, token))

    return write


def owned(ledger: DataFrame, stored: DataFrame, by: list[str]) -> DataFrame:
    """ledger: by, token, version (null before the write was confirmed). stored: by, token, version of
    what is there now. The rows of the ledger that may be deleted: what is there still carries their token and,
    if known, their version; what somebody else has put there since is not theirs."""
    there = stored.select(*by, "token", F.col("version").alias("_now"))
    same = F.col("version").isNull() | (F.col("version") == F.col("_now"))
    return ledger.join(there, [*by, "token"]).where(same).drop("_now").distinct()


def cleaned(spark: SparkSession, root: str, finished: Callable[[DataFrame], DataFrame] = lambda x: x) -> int:
    """Deletes the attempts that lost or crashed, with their ledger entries; how many. finished: which
    rows of the ledger (token, batch) belong to writers that have ended, all by default."""
    ledger = finished(_listed(spark, f"{root}/_owned", LEDGER))
    lost = ledger.join(manifests(spark, root).select("token"), "token", "left_anti")
    n = 0
    for r in lost.select("token").toLocalIterator():  # a name for each attempt that failed
        for path, deep in ((f"{root}/attempts/token={r.token}", True), (f"{root}/_owned/{r.token}.json", False)):
            at, fs = _fs(spark, path)
            fs.delete(at, deep)
        n += 1
    return n
