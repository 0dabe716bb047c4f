"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the word rule ``[^\x20\x09-\x0D]+`` (fixed values).
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows in one Arrow batch handed to Python: bounds a worker's memory when texts are long.
BATCH_ROWS = 512


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def returned() -> None:
    """Gives memory that a worker has freed back to the machine: workers are used again by
    later stages, and what one stage has needed would add up with the next one's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Where it is unset, a
    session on one machine gets a folder of its own; a cluster's is an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessella-"))
        found = sc.getCheckpointDir()
    return found


def table(df: DataFrame) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: this cuts the
    lineage, so that a lost executor costs a read and not a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Deletes the files of tables that nothing still to be computed reads."""
    for t in tables:
        if t is not None and (path := getattr(t, "_stored", None)):
            jvm = t.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def few(df: DataFrame, most: int = 10_000) -> bool:
    """Whether a table is small enough to be sent to every executor."""
    return df.limit(most + 1).count() <= most


def sealed(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df under plain column names, and the plain name of each of its own, so that an
    operator's columns cannot clash with any that the input carries along."""
    plain = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*plain), dict(zip(df.columns, plain, strict=True))


def opened(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(p).alias(n) for n, p in names.items()])


def n_words(text: Column) -> Column:
    """Words of a text, without building them; 0 for null."""
    marks = F.regexp_replace(text, r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++", "x")
    return F.coalesce(F.length(F.translate(marks, SPACES, "")), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def locate(points: DataFrame, at: str, spans: DataFrame, carry: list[str], width: int) -> DataFrame:
    """points with the carry columns of the span [lo, lo + len) that holds their
    position; spans tile the positions and are sorted by a sweep over slices of
    ``width`` positions, so the cost is linear in points + spans + slices."""
    w = F.lit(int(width))
    cut = spans.where("len > 0").withColumn("_slice", F.explode(F.sequence(F.expr(f"lo div {int(width)}"), F.expr(f"(lo + len - 1) div {int(width)}"))))
    cut = cut.select("_slice", F.greatest("lo", F.col("_slice") * w).alias("_at"), F.struct(*carry).alias("_span"))
    rest = [F.col(c) for c in points.columns]
    left = points.select(F.expr(f"{at} div {int(width)}").alias("_slice"), F.col(at).alias("_at"), F.struct(*rest).alias("_point"))
    both = left.unionByName(cut, allowMissingColumns=True)
    order = Window.partitionBy("_slice").orderBy("_at", F.col("_point").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_span", F.last("_span", ignorenulls=True).over(order)).where("_point is not null")
    return found.select("_point.*", *[F.col(f"_span.{c}").alias(c) for c in carry])


_CHUNK = 1 << 22
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 ** 64."""
    if not _POWERS or len(_POWERS[0]) < n:
        base = 0x9E3779B97F4A7C15
        size = max(n, 1 << 16)
        _POWERS[:] = [np.cumprod(np.full(size, x, np.uint64)) for x in (base, pow(base, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words of a UTF-8 text, the same on every machine: a
    polynomial over bytes, read off one running sum for each chunk of the text."""
    out, at = [], 0
    while len(raw) - at > _CHUNK:
        cut = max(raw.rfind(s, at, at + _CHUNK) for s in (b" ", b"\n"))
        if cut <= at:  # one long word: up to its end
            cut = min((x for s in (b" ", b"\n") if (x := raw.find(s, at + _CHUNK)) > 0), default=len(raw))
        out.append(_hashes(raw[at:cut]))
        at = cut
    out.append(_hashes(raw[at:]))
    return np.concatenate(out) if len(out) > 1 else out[0]


def _hashes(raw) -> np.ndarray:
    a = np.frombuffer(raw, np.uint8)
    if not len(a):
        return np.empty(0, np.uint64)
    gap = np.ones(len(a) + 2, bool)
    gap[1:-1] = (a == 32) | ((a >= 9) & (a <= 13))
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = _powers(len(a))
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)], out=total[1:])
    return _mixed((total[ends] - total[starts]) * down[starts])
