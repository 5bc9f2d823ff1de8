"""Embedding near-duplicates by an epsilon grid order join over blocks of vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.simhash import least_labels
from millrace.operators.components import connected_components
from millrace.operators.skew import join_spread
from millrace.runtime import bound_batches, discard, materialize, releasing

#: Rows of the sample that the principal directions are fitted on: its bound. They only steer the order, never the result.
SAMPLE = 8192
#: Leading directions that give grid cells and bounding boxes, and vectors of a block.
LEADING, BLOCK = 8, 1024
#: Intervals up to this length are compared outright.
LEAF = 256
#: Bits of a block's number within its range partition, and parts of an interval of blocks.
NUMBER_BITS, FAN = 28, 32
#: Slack of the skipping tests against rounding; the cosine itself decides about each pair that is compared.
SLACK = 1e-9


def usable(vector: str, label: str) -> str:
    """SQL test for rows that may link: a label, and a vector of finite components that are not all zero."""
    return f"{label} is not null and {vector} is not null and size({vector}) > 0 and not exists({vector}, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists({vector}, x -> x <> 0)"


def rotations(vectors: DataFrame, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """Principal directions by vector length, most variance first, from the `sample` rows of lowest hash."""
    rows = vectors.select("vector").orderBy(F.xxhash64("vector")).limit(sample).toArrow()["vector"].to_pylist()
    found: dict[int, np.ndarray] = {}
    for dim in {len(r) for r in rows}:
        x = np.array([r for r in rows if len(r) == dim], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        found[dim] = np.linalg.eigh(np.cov(x.T).reshape(dim, dim) if len(x) > 1 else np.eye(dim))[1][:, ::-1][:, :LEADING]
    return found


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def packed_floats(x: np.ndarray) -> bytes:
    """The numbers as 4-byte floats where those hold them exactly, else as 8-byte ones."""
    with np.errstate(over="ignore"):
        small = x.astype("<f4")
    return (small if np.array_equal(small, x) else x).tobytes()


def unpacked(raw: bytes, rows: int, dim: int) -> np.ndarray:
    return np.frombuffer(raw, "<f4" if len(raw) == 4 * rows * dim else "<f8").astype(float).reshape(rows, dim)


def blocks(vectors: DataFrame, turn: Broadcast, radius: float, block: int = BLOCK) -> DataFrame:
    """One row for each block of up to `block` vectors of one label and length, in grid order.

    vectors has (label, h1, h2, vector array<double>, copies, least). Rows are sorted by label and by their cells of
    width `radius` along the leading directions, first direction first; a hot label spreads over many range
    partitions. low and high bound the block along those directions.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    bits = max(1, math.ceil(math.log2(2 / radius + 3)))
    dims = min(LEADING, 62 // bits)

    def lead_of(x: np.ndarray) -> np.ndarray:
        dim = x.shape[1]
        lead = _unit(x) @ turn.value.get(dim, np.eye(dim)[:, :LEADING])
        return np.pad(lead, ((0, 0), (0, LEADING - lead.shape[1])))

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_pylist()
            cell, lead = np.zeros(len(rows), np.int64), np.zeros((len(rows), LEADING))
            sizes = np.array([len(r) for r in rows])
            for dim in set(sizes.tolist()):
                at = np.flatnonzero(sizes == dim)
                lead[at] = lead_of(np.array([rows[k] for k in at], float))
            for d in range(dims):
                cell = (cell << bits) | np.clip(np.floor((lead[:, d] + 1) / radius).astype(np.int64) + 1, 0, (1 << bits) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(list(lead)), *batch.columns], names=["cell", "lead", *batch.schema.names])

    columns = ["vector", "label", "h1", "h2", "copies", "least"]
    kinds = {n: t for n, t in vectors.dtypes}
    schema = "cell bigint, lead array<double>, " + ", ".join(f"{c} {kinds[c]}" for c in columns)
    # dealing by range reads its input twice
    ordered = materialize(vectors.select(*columns).mapInArrow(releasing(order), schema).withColumn("dim", F.size("vector")), "ordered")
    dealt = ordered.repartitionByRange("label", "dim", "cell", "h1", "h2").sortWithinPartitions("label", "dim", "cell", "h1", "h2")
    out = f"block bigint, label {kinds['label']}, dim int, low array<double>, high array<double>, vectors binary, h1 array<bigint>, h2 array<int>, copies array<bigint>, least array<{kinds['least']}>"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, at = TaskContext.get().partitionId() << NUMBER_BITS, [], None
        names: list[str] = []

        def flush() -> pa.RecordBatch:
            nonlocal number, held
            get = lambda c: [r[names.index(c)] for r in held]
            lead = np.array(get("lead"))
            cols = [[number], [at[0]], [at[1]], [lead.min(axis=0).tolist()], [lead.max(axis=0).tolist()], [packed_floats(np.array(get("vector"), "<f8"))], [get("h1")], [get("h2")], [get("copies")], [get("least")]]
            number, held = number + 1, []
            return pa.Table.from_pydict(dict(zip(target.names, cols, strict=True)), schema=target).to_batches()[0]

        target = None
        for batch in batches:
            names = batch.schema.names
            kind = batch.schema.field
            target = target or pa.schema([("block", pa.int64()), ("label", kind("label").type), ("dim", pa.int32()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("vectors", pa.binary()), ("h1", pa.list_(pa.int64())), ("h2", pa.list_(pa.int32())), ("copies", pa.list_(pa.int64())), ("least", pa.list_(kind("least").type))])
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = (row[names.index("label")], row[names.index("dim")])
                if held and (key != at or len(held) >= block):
                    yield flush()
                at = key
                held.append(row)
        if held:
            yield flush()

    found = materialize(dealt.mapInArrow(releasing(pack), out), "blocks")
    discard(ordered)
    return found


def block_pairs(packed: DataFrame, radius: float, fan: int = FAN) -> DataFrame:
    """(left, right): blocks whose bounding boxes come within the radius, each block with itself as well.

    Blocks of one label and length form a sequence in grid order. Its intervals are joined recursively: the whole
    sequence with itself, then of each pair that is left the parts, `fan` a side, whose boxes come within the radius,
    down to single blocks. A key holds the partners of one interval, never a label's blocks.
    """
    at = F.shiftright("block", NUMBER_BITS)
    sizes = packed.select(at.alias("part")).groupBy("part").count().orderBy("part").collect()
    before = dict(zip([r["part"] for r in sizes], np.cumsum([0, *(r["count"] for r in sizes)]).tolist(), strict=False))
    total = sum(r["count"] for r in sizes)
    offsets = packed.sparkSession.createDataFrame([*before.items()], "part bigint, before bigint")  # one row a range partition
    corners = [F.get("low", k).alias(f"l{k}") for k in range(LEADING)] + [F.get("high", k).alias(f"h{k}") for k in range(LEADING)]
    placed = packed.select(at.alias("part"), "block", "label", "dim", *corners).join(F.broadcast(offsets), "part")
    leaves = placed.select("label", "dim", (F.col("before") + F.col("block").bitwiseAND((1 << NUMBER_BITS) - 1)).alias("node"), *[f"{c}{k}" for c in "lh" for k in range(LEADING)], "block")
    bits = fan.bit_length() - 1
    levels = [leaves]
    while total > 1 << bits * (len(levels) - 1):
        boxes = [F.min(f"l{k}").alias(f"l{k}") for k in range(LEADING)] + [F.max(f"h{k}").alias(f"h{k}") for k in range(LEADING)]
        levels.append(leaves.groupBy("label", "dim", F.shiftright("node", bits * len(levels)).alias("node")).agg(*boxes))
    pairs = levels[-1].select("label", "dim", F.col("node").alias("left"), F.col("node").alias("right"))
    if len(levels) == 1:
        levels.append(leaves)
        pairs = leaves.select("label", "dim", F.lit(0).cast("bigint").alias("left"), F.lit(0).cast("bigint").alias("right")).distinct()
    for level in reversed(levels[:-1]):
        side = lambda s, level=level: level.select("label", "dim", F.shiftright("node", bits).alias(s), F.col("node").alias(f"{s}_part"), *(F.col(f"{c}{k}").alias(f"{s}_{c}{k}") for c in "lh" for k in range(LEADING)), *([F.col("block").alias(f"{s}_block")] if level is leaves else []))
        gap = lambda k: F.greatest(F.col(f"left_l{k}") - F.col(f"right_h{k}"), F.col(f"right_l{k}") - F.col(f"left_h{k}"), F.lit(0.0))
        apart = sum((gap(k) * gap(k) for k in range(1, LEADING)), gap(0) * gap(0))
        met = pairs.join(side("left"), ["label", "dim", "left"]).join(side("right"), ["label", "dim", "right"])
        met = met.filter((F.col("left_part") <= F.col("right_part")) & (apart <= radius * radius + SLACK))
        if level is leaves:
            return met.select(F.col("left_block").alias("left"), F.col("right_block").alias("right"))
        pairs = met.select("label", "dim", F.col("left_part").alias("left"), F.col("right_part").alias("right"))
    raise AssertionError("the levels end with the blocks")


def join_intervals(a: np.ndarray, b: np.ndarray, lead_a: np.ndarray, lead_b: np.ndarray, cosine: float, radius: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of unit rows with dot >= cosine, by halving both sequences and skipping intervals whose boxes lie apart."""
    out_i, out_j = [], []
    stack = [(0, len(a), 0, len(b))]
    while stack:
        i, i_end, j, j_end = stack.pop()
        if same and j_end <= i:
            continue
        apart = np.maximum(np.maximum(lead_a[i:i_end].min(axis=0) - lead_b[j:j_end].max(axis=0), lead_b[j:j_end].min(axis=0) - lead_a[i:i_end].max(axis=0)), 0)
        if (apart * apart).sum() > radius * radius + SLACK:
            continue
        if max(i_end - i, j_end - j) <= LEAF:
            p, q = np.nonzero(a[i:i_end] @ b[j:j_end].T >= cosine)
            if same:
                p, q = p[(up := p + i < q + j)], q[up]
            out_i.append(p + i)
            out_j.append(q + j)
        elif i_end - i >= j_end - j:
            mid = (i + i_end) // 2
            stack += [(i, mid, j, j_end), (mid, i_end, j, j_end)]
        else:
            mid = (j + j_end) // 2
            stack += [(i, i_end, j, mid), (i, i_end, mid, j_end)]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_i]), np.concatenate([none, *out_j])


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of table.

    Rows link if their labels are equal and not null, their vectors have one length and the cosine in double precision
    is at least `cosine`. Vectors that are null, empty, zero or hold null or non-finite components link with nothing:
    0 links, a component of their own. Equal vectors of a label are joined once and counted as copies, so a large group
    of copies adds one row; of dense groups of different vectors only counts and a spanning forest leave a task.
    component_id is the least non-null id reached; a null id is kept if it is alone. Repeated rows are vectors each of
    their own; an empty table gives no rows; other columns are not read.
    """
    spark = table.sparkSession
    radius = math.sqrt(max(0.0, 2 - 2 * cosine)) or SLACK
    rows = table.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    linked = F.expr(f"coalesce({usable('vector', 'label')}, false)")
    keyed = rows.withColumn("usable", linked).withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.hash("vector"))
    distinct = keyed.filter("usable").groupBy("label", "h1", "h2").agg(F.first("vector").alias("vector"), F.count("*").alias("copies"), F.min("id").alias("least"))
    turn = spark.sparkContext.broadcast(rotations(distinct, sample))
    packed = blocks(distinct, turn, radius, block)
    pairs = block_pairs(packed, radius)
    side = lambda s: packed.select(F.col("block").alias(s), F.col("dim").alias(f"dim_{s}"), F.col("vectors").alias(f"v_{s}"), F.col("copies").alias(f"n_{s}"))
    work = pairs.join(side("left"), "left").join(side("right"), "right").select("left", "right", "dim_left", "v_left", "v_right", "n_left", "n_right")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right, dim, va, vb, na, nb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = (_unit(unpacked(v, len(n), dim)) for v, n in ((va, na), (vb, nb)))
                lead = turn.value.get(dim, np.eye(dim)[:, :LEADING])
                same = left == right
                i, j = join_intervals(a, b, a @ lead, b @ lead, cosine, radius, same)
                if not len(i):
                    continue
                j_all = j if same else j + len(a)
                total = len(a) if same else len(a) + len(b)
                weight = np.array(na if same else [*na, *nb], np.int64)
                count = np.bincount(i, weight[j_all], total) + np.bincount(j_all, weight[i], total)
                label = least_labels(total, i, j_all)
                node = np.concatenate([(left << 11) + np.arange(len(a)), (right << 11) + np.arange(len(b))])[:total]
                some = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[label[some]]), pa.array(count[some].astype(np.int64))], names=["node", "head", "n"])

    if block > 2048:
        raise ValueError("a block holds 2048 vectors at most")
    found = materialize(work.mapInArrow(releasing(link), "node bigint, head bigint, n bigint"), "links")
    counted = found.groupBy("node").agg(F.sum("n").alias("n"))
    roots = connected_components(found, "node", "head").select("node", F.col("component").alias("root"))
    nodes = packed.select("block", "label", F.explode(F.arrays_zip("h1", "h2", "copies", "least", F.sequence(F.lit(0), F.size("h1") - 1).alias("at"))).alias("v"))
    nodes = nodes.select((F.shiftleft("block", 11) + F.col("v.at")).alias("node"), "label", "v.h1", "v.h2", "v.copies", "v.least")
    named = nodes.join(counted, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    facts = join_spread(named, classes, "root", "members").select("label", "h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id", F.lit(True).alias("usable"), "copies")
    joined = join_spread(keyed.drop("vector"), facts, ["label", "h1", "h2", "usable"], "copies", "left")
    class_id = F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("id"))
    return joined.select("id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), class_id.alias("component_id"), F.col("id").eqNullSafe(class_id).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT r, vec_id, label, e FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT r, r FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.r) AS n_links, m.c AS component_id, v.vec_id = m.c AS kept
FROM v JOIN (SELECT reach.a, min(w.vec_id) AS c FROM reach JOIN v w ON w.r = reach.b GROUP BY reach.a) m ON m.a = v.r
"""
