"""Shared-folder tables and Arrow batch bounds used by operators that run in several jobs."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch sent to a Python worker; a batch always holds one row at least.
ARROW_BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where unset on a local master (tests), a temporary one that becomes it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="millrace-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df once into the shared folder and read it back: cuts lineage and survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


#: A table of fewer partitions than this, at most some gigabytes, may be dealt anew to keep all cores busy.
FEW_PARTITIONS = 64


def spread(df: DataFrame) -> DataFrame:
    """df, or where it has fewer partitions than both the cluster has cores and FEW_PARTITIONS, df dealt over that many:
    a small table in one file is read by one task otherwise. Larger tables are left as they are."""
    wanted = min(df.sparkSession.sparkContext.defaultParallelism, FEW_PARTITIONS)
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)


def numbered(df: DataFrame, column: str, start: int, order: list[str]) -> DataFrame:
    """df with consecutive numbers from start + 1 in the given order, written to the shared folder.

    Rows are sorted by range partitions, and each number is the rows of the partitions before plus the place within
    its own: no task holds all rows; the driver gets one count a partition.
    """
    spark = df.sparkSession
    place = fresh([*df.columns, column], "place")
    dealt = df.repartitionByRange(*map(quoted, order)).sortWithinPartitions(*map(quoted, order)) if order else df
    rows = materialize(dealt.withColumn(place, F.monotonically_increasing_id()), "numbered")
    part = F.shiftright(place, 33)
    sizes = {r["part"]: r["count"] for r in rows.groupBy(part.alias("part")).count().collect()}
    before, at = [], start
    for k in sorted(sizes):
        before.append((k, at))
        at += sizes[k]
    offsets = spark.createDataFrame(before, f"{place}_part bigint, {place}_before bigint")
    number = F.col(f"{place}_before") + 1 + F.col(place).bitwiseAND((1 << 33) - 1)
    joined = rows.join(F.broadcast(offsets), part == F.col(f"{place}_part"))
    return joined.withColumn(column, number).select(*map(quoted, df.columns), column)


def discard(df: DataFrame) -> None:
    """Delete a table written by materialize that nothing reads any more."""
    path = getattr(df, "_millrace_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def quoted(name: str) -> str:
    """A column name that may hold dots or back-ticks, for select and col."""
    return "`" + name.replace("`", "``") + "`"


def fresh(columns: Iterable[str], name: str) -> str:
    """A column name that none of columns has, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def bound_batches(spark: SparkSession, size: int = ARROW_BATCH_BYTES) -> None:
    """Hold Arrow batches to `size` bytes, so that a run of very long texts cannot fill a worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(key, str(2**31 - 2)).rstrip("b") or 0)
    if now > size:
        spark.conf.set(key, str(size))


def release() -> None:
    """Give memory that this Python worker no longer uses back to the system: workers outlive their tasks."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow that releases memory when its task ends."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped
