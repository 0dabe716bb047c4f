"""Job lifecycle as a stream: one keyed state for each job, an outbox with stable ids.

Input is at least once and in any order within a job. The first terminal event
settles a job and later ones only redeliver; a request that differs from the first is
a conflict. What is never settled keeps its state; retention is jobs.expired, in batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENT = "job string, seq long, kind string, request string, ts timestamp"
OUT = "job string, status string, attempts int, conflict boolean, redelivered boolean, event_id string"
STATE = "status string, attempts int, request string, conflict boolean"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TERMINAL = ("succeeded", "failed", "expired")
MOST_ATTEMPTS = 10


class Lifecycle(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, attempts, request, conflict = self.state.get() if self.state.exists() else ("new", 0, None, False)
        told = []
        events = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for e in events.itertuples(index=False):
            if e.kind == "submitted":
                if request is None:
                    request = e.request
                    status = "queued" if status == "new" else status
                elif e.request != request:
                    conflict = True
            if status in TERMINAL:
                if e.kind in ("succeeded", "failed", "submitted"):
                    told.append((key[0], status, attempts, conflict, True, f"{key[0]}:{status}"))
                continue
            if e.kind == "running":
                attempts += 1
                status = "failed" if attempts > MOST_ATTEMPTS else "running"
            elif e.kind in ("succeeded", "failed"):
                status = e.kind
            if status in TERMINAL:
                told.append((key[0], status, attempts, conflict, False, f"{key[0]}:{status}"))
        self.state.update((status, attempts, request, conflict))
        yield pd.DataFrame(told, columns=[x.split()[0] for x in OUT.split(", ")])

    def close(self) -> None:
        pass


def lifecycle(events: DataFrame) -> DataFrame:
    """Notifications of a stream of events (schema EVENT): a row when a job settles, and
    one marked as redelivered for each later delivery."""
    return events.groupBy("job").transformWithStateInPandas(Lifecycle(), outputStructType=OUT, outputMode="append", timeMode="none")


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Events from JSON files that land in a folder."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).json(path)


def outbox(path: str):
    """For foreachBatch: notifications appended once for each event id and batch; a batch
    that runs again overwrites its own folder, so a crash loses and repeats nothing."""

    def write(batch: DataFrame, number: int) -> None:
        batch.where("NOT redelivered").dropDuplicates(["event_id"]).write.mode("overwrite").json(f"{path}/batch={number}")

    return write


def windowed(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events by kind in tumbling windows, with a watermark for late ones."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "kind").agg(F.count("*").alias("n"))
