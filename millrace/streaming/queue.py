"""The streaming surface: watching folders, keyed task state, micro-batch ingestion."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators.maintenance import debounced


def watch(spark: SparkSession, root: str, extensions: tuple[str, ...] = ("md", "json", "html")) -> DataFrame:
    """A stream of (path, ts, hash): files that appear under root. Deletions are found by reconcile(), not by a stream."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{','.join(extensions)}}}").load(root)
    return raw.select("path", F.col("modificationTime").alias("ts"), F.sha2("content", 256).alias("hash"))


def batches(changes: DataFrame, quiet: int = 30, late: str = "1 minute") -> DataFrame:
    """Debounced batches of a stream of (path, ts): a batch closes after `quiet` seconds without a change."""
    return debounced(changes.withWatermark("ts", late), quiet)


TASK = "type string, identity string, event string, status string, attempts int, next_attempt_at bigint"


def tasks(events: DataFrame) -> DataFrame:
    """Stream of (type, identity, event, at) into the latest state of each touched task: payload of the last event,
    pending, no attempts, due at its time. State is one row a key."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        event, at = state.get if state.exists else (None, -1)
        for frame in frames:
            rows = frame.sort_values("at", kind="stable")
            if len(rows) and int(rows["at"].iloc[-1]) >= at:
                event, at = rows["event"].iloc[-1], int(rows["at"].iloc[-1])
        state.update((event, at))
        yield pd.DataFrame([(*key, event, "pending", 0, at)], columns=[c.split()[0] for c in TASK.split(", ")])

    return events.groupBy("type", "identity").applyInPandasWithState(step, TASK, "event string, at bigint", "update", GroupStateTimeout.NoTimeout)


def worker(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True):
    """Runs handle on each micro-batch; with available_now until what is there is done."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).outputMode("update")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
