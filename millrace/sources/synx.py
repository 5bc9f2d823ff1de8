"""The vector interchange format: a 20-byte header, then rows of a 4-byte id and 4-byte floats, by id."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The format's magic, version and header length.
MAGIC, VERSION, HEADER = b"SYNX", 1, 20


def pack(ids: np.ndarray, vectors: np.ndarray) -> bytes:
    """A file's bytes; equal ids keep their order."""
    if vectors.ndim != 2 or vectors.shape[1] == 0:
        raise ValueError("vectors need a positive length")
    order = np.argsort(ids, kind="stable")
    rows = np.zeros(len(ids), np.dtype([("id", "<u4"), ("v", "<f4", (vectors.shape[1],))]))
    rows["id"], rows["v"] = ids[order], vectors[order]
    head = MAGIC + np.array([VERSION, vectors.shape[1]], "<u4").tobytes() + np.array([len(ids)], "<u8").tobytes()
    return head + rows.tobytes()


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors; a wrong magic, version or length raises."""
    if data[:4] != MAGIC:
        raise ValueError("bad magic")
    if len(data) < HEADER:
        raise ValueError("cut off in the header")
    version, dim = (int(x) for x in np.frombuffer(data[4:12], "<u4"))
    if version != VERSION:
        raise ValueError(f"version {version} is unknown")
    n = int(np.frombuffer(data[12:20], "<u8")[0])
    kind = np.dtype([("id", "<u4"), ("v", "<f4", (dim,))])
    if len(data) < HEADER + n * kind.itemsize:
        raise ValueError("cut off in the rows")
    rows = np.frombuffer(data, kind, n, HEADER)
    return rows["id"].astype(np.int64), rows["v"].copy()


def read(spark: SparkSession, path: str) -> DataFrame:
    """(chunk_id, embedding) of all files under a path, one task a file."""
    import pyarrow as pa

    def rows(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                ids, vectors = unpack(data)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(list(vectors), pa.list_(pa.float32()))], names=["chunk_id", "embedding"])

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.synx").load(path)
    return raw.select("content").mapInArrow(rows, "chunk_id bigint, embedding array<float>")


def write(vectors: DataFrame, path: str, partitions: int) -> None:
    """(chunk_id, embedding) as `partitions` files of ascending id ranges, written by the executors through Hadoop."""
    import pyarrow as pa

    def rows(batches):
        from pyspark import TaskContext

        found = [b for b in batches if b.num_rows]
        if found:
            table = pa.Table.from_batches(found)
            data = pack(table["chunk_id"].to_numpy(), np.array(table["embedding"].to_pylist(), np.float32))
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([data])], names=["part", "data"])

    packed = vectors.select("chunk_id", F.col("embedding").cast("array<float>").alias("embedding")).repartitionByRange(partitions, "chunk_id").mapInArrow(rows, "part bigint, data binary")
    spark = vectors.sparkSession
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for row in packed.toLocalIterator():
        out = fs.create(jvm.org.apache.hadoop.fs.Path(path, f"part-{row['part']:05d}.synx"))
        try:
            out.write(bytearray(row["data"]))
        finally:
            out.close()
