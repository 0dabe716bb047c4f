"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession

MOST_ROWS = 4096  # that a worker holds besides what a fold keeps itself


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, set as the session's checkpoint folder. Where it is
    unset, a session on one machine gets a folder of its own; a cluster's is an error."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if found is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessella-"))
        found = named or sc.getCheckpointDir()
    return found


def table(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read back. Unlike a checkpoint, which keeps its
    plan's estimate of sizes, a table has the size of its files; in rounds of joins the
    estimates would grow without end."""
    path = f"{folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored = path
    return out


def spread(df: DataFrame) -> DataFrame:
    """df dealt out to four tasks a core: a file of a few MB is one task or two, however
    much work its rows are."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def folded(rows: DataFrame, by: list[str], order: list[str | Column], columns: list[str], outputs: dict[str, str], fold: Callable[[Iterator[tuple]], Iterable[tuple]]) -> DataFrame:
    """by and outputs: what fold() makes of the rows (columns) of each section, which it reads in order. A task
    reads its sections one after the other, so many small ones cost no frame each. outputs: for
    each name int, long or the column whose type it has."""
    kinds, n, plain = dict(rows.dtypes), len(by), {"int": pa.int32(), "long": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: list[pa.DataType] = []

        def read() -> Iterator[tuple]:
            for b in batches:
                types[:] = [plain.get(c) or b.schema.field(c).type for c in [*by, *outputs.values()]]
                yield from zip(*[b.column(c).to_pylist() for c in [*by, *columns]], strict=True)

        def made(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), types, strict=True)], [*by, *outputs])

        out: list[tuple] = []
        for key, section in groupby(read(), lambda r: r[:n]):
            for row in fold(r[n:] for r in section):
                out.append((*key, *row))
                if len(out) >= MOST_ROWS:
                    yield made(out)
                    out = []
        if out:
            yield made(out)

    dealt = rows.select(*by, *columns).repartition(*by).sortWithinPartitions(*by, *order)
    return dealt.mapInArrow(run, ", ".join([f"{c} {kinds[c]}" for c in by] + [f"{c} {kinds.get(k, k)}" for c, k in outputs.items()]))


def release(*tables: DataFrame) -> None:
    """Deletes the files of tables that nothing still to be computed reads."""
    for t in tables:
        at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._stored)
        at.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
