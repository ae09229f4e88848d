"""Near-duplicate vectors by an epsilon grid order join.

On the unit sphere a cosine of at least c is a distance of at most eps = sqrt(2 - 2c).  Vectors are turned to their principal axes and
sorted by their grid cells (side eps) on the leading ones; runs of the sorted sequence are blocks, runs of blocks are intervals.  Pairs of
intervals are split recursively, and a pair goes as soon as the boxes around its two sides are farther apart than eps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.ann import usable
from skyledger.llm.common import arrow_batches, stored
from skyledger.llm.components import components

THRESHOLD = 0.98
#: Axes whose cells order the vectors, and axes of the boxes.
CELL_AXES, BOX_AXES = 4, 8
BLOCK_ROWS = 2048
FAN = 16


def _unit(column: pa.Array, width: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def principal_axes(vectors: DataFrame, width: int, count: int) -> np.ndarray:
    """The leading axes of all unit vectors; sums of products are merged in two steps, so few reach the driver."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((width + 1, width))
        for batch in batches:
            if batch.num_rows:
                x = _unit(batch.column("vec"), width)
                sums[:width] += x.T @ x
                sums[width] += x.sum(0)
        yield pa.RecordBatch.from_pydict({"sums": pa.array([sums.tobytes()], pa.binary())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((width + 1) * width)
        for batch in batches:
            for x in batch.column("sums").to_pylist():
                sums += np.frombuffer(x)
        yield pa.RecordBatch.from_pydict({"sums": pa.array([sums.tobytes()], pa.binary())})

    rows = vectors.select("vec").mapInArrow(total, "sums binary").repartition(16).mapInArrow(merge, "sums binary").collect()
    n = max(1, vectors.count())
    sums = sum(np.frombuffer(r[0]) for r in rows).reshape(width + 1, width)
    mean = sums[width] / n
    return np.linalg.eigh(sums[:width] / n - np.outer(mean, mean))[1][:, ::-1][:, :count]


def _blocks(vectors: DataFrame, width: int, eps: float) -> DataFrame:
    """Vectors in grid order with ``part`` and ``block``, runs of at most ``BLOCK_ROWS`` rows of one label, and their ``place`` on the box axes."""
    axes = principal_axes(vectors, width, min(BOX_AXES, width))
    shared = vectors.sparkSession.sparkContext.broadcast(axes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _unit(batch.column("vec"), width) @ shared.value
            cells = np.floor(at[:, :CELL_AXES] / eps).astype(np.int32)
            columns = [*batch.columns, pa.array(list(at), pa.list_(pa.float64())), pa.array(list(cells), pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "place", "cells"])

    placed = vectors.mapInArrow(place, "label string, vid long, copies long, vec array<double>, place array<double>, cells array<int>")
    cells = [F.get("cells", i) for i in range(min(CELL_AXES, width))]
    ordered = stored(placed, "grid-cells").repartitionByRange("label", *cells, "vid").sortWithinPartitions("label", *cells, "vid").drop("cells")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, label, size = TaskContext.get().partitionId(), -1, None, BLOCK_ROWS
        for batch in batches:
            out = []
            for x in batch.column("label").to_pylist():
                if x != label or size == BLOCK_ROWS:
                    block, label, size = block + 1, x, 0
                size += 1
                out.append(block)
            columns = [*batch.columns, pa.array(np.full(len(out), part), pa.int32()), pa.array(out, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "part", "block"])

    return stored(ordered.mapInArrow(number, "label string, vid long, copies long, vec array<double>, place array<double>, part int, block int"), "grid-blocks")


def near_blocks(blocks: DataFrame, eps: float) -> DataFrame:
    """Pairs ``a <= b`` of block numbers within a label whose boxes are at most ``eps`` apart, found from the top of the tree of intervals."""
    axes = blocks.select(F.max(F.size("place"))).collect()[0][0] or 0

    def boxed(rows: DataFrame, low: str, high: str, *by: str) -> DataFrame:
        each = lambda f, c: F.array(*[f(F.get(c, i)) for i in range(axes)])
        return rows.groupBy(*by).agg(each(F.min, low).alias("low"), each(F.max, high).alias("high"))

    number = F.row_number().over(Window.partitionBy("label").orderBy("part", "block")) - 1
    leaves = stored(boxed(blocks, "place", "place", "label", "part", "block").withColumn("node", number.cast("long")), "grid-boxes")
    levels = [leaves.select("label", "node", "low", "high")]
    most = leaves.agg(F.max("node")).collect()[0][0] or 0
    while most:
        up = levels[-1].withColumn("node", F.floor(F.col("node") / FAN))
        levels.append(boxed(up, "low", "high", "label", "node"))
        most //= FAN
    pairs = levels[-1].select("label", F.col("node").alias("a"), F.col("node").alias("b"))
    gap = F.zip_with(F.col("low"), F.col("b_high"), lambda x, y: F.greatest(x - y, F.lit(0.0)))
    other = F.zip_with(F.col("b_low"), F.col("high"), lambda x, y: F.greatest(x - y, F.lit(0.0)))
    apart = F.aggregate(F.zip_with(gap, other, lambda x, y: x + y), F.lit(0.0), lambda s, d: s + d * d)
    for level in reversed(levels[:-1]):
        children = level.withColumn("up", F.floor(F.col("node") / FAN))
        left = pairs.join(children.select("label", F.col("up").alias("a"), F.col("node").alias("node_a"), "low", "high"), ["label", "a"])
        both = left.join(children.select("label", F.col("up").alias("b"), F.col("node").alias("node_b"), F.col("low").alias("b_low"), F.col("high").alias("b_high")), ["label", "b"])
        pairs = both.where((F.col("node_a") <= F.col("node_b")) & (apart <= eps * eps * (1 + 1e-9))).select("label", F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    named = leaves.select("label", "node", "part", "block")
    return pairs.join(named.select("label", F.col("node").alias("a"), F.col("part").alias("part_a"), F.col("block").alias("block_a")), ["label", "a"]).join(
        named.select("label", F.col("node").alias("b"), F.col("part").alias("part_b"), F.col("block").alias("block_b")), ["label", "b"]
    )


def _join(blocks: DataFrame, width: int, threshold: float, eps: float) -> DataFrame:
    """Per vector and pair of blocks with links: ``vid``, its ``links``, and ``root``, the smallest vector it reaches inside the pair."""
    pairs = stored(near_blocks(blocks, eps).select(F.monotonically_increasing_id().alias("pair"), "part_a", "block_a", "part_b", "block_b"), "grid-pairs")
    sides = pairs.select("pair", F.col("part_a").alias("part"), F.col("block_a").alias("block"), F.lit(True).alias("first")).unionByName(
        pairs.select("pair", F.col("part_b").alias("part"), F.col("block_b").alias("block"), F.lit(False).alias("first")).where((F.col("part_a") != F.col("part_b")) | (F.col("block_a") != F.col("block_b")))
    )

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        first = group.column("first").to_numpy(zero_copy_only=False)
        x, ids, copies = _unit(group.column("vec").combine_chunks(), width), group.column("vid").to_numpy(), group.column("copies").to_numpy()
        a, own = np.flatnonzero(first), first.all()
        b = a if own else np.flatnonzero(~first)
        linked = x[a] @ x[b].T >= threshold
        if own:
            np.fill_diagonal(linked, False)
        rows, columns = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
        linked, a, b = linked[np.ix_(rows, columns)], a[rows], b[columns]
        root_a, root_b = ids[a].copy(), ids[b].copy()
        while len(a):
            new_a = np.minimum(root_a, np.where(linked, root_b[None, :], np.iinfo(np.int64).max).min(1))
            new_b = np.minimum(root_b, np.where(linked, new_a[:, None], np.iinfo(np.int64).max).min(0))
            if own:
                new_a = new_b = np.minimum(new_a, new_b)
            if (new_a == root_a).all() and (new_b == root_b).all():
                break
            root_a, root_b = new_a, new_b
        found = [(ids[a], linked @ copies[b], root_a)] + ([] if own else [(ids[b], copies[a] @ linked, root_b)])
        vid, links, root = (np.concatenate([f[i] for f in found]).astype(np.int64) for i in range(3))
        return pa.table({"vid": pa.array(vid), "links": pa.array(links), "root": pa.array(root)})

    return blocks.select("part", "block", "vid", "copies", "vec").join(sides, ["part", "block"]).select("pair", "first", "vid", "copies", "vec").groupBy("pair").applyInArrow(compare, "vid long, links long, root long")


def near_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row per key: ``key, n_links, component_id, kept``.

    Rows link if their labels are equal and not NULL and the cosine of their vectors, in double precision, is at least ``threshold``.
    Vectors that are NULL, zero, or hold NULL or non-finite components link with nothing, nor do vectors of different lengths.  Equal
    vectors are compared once and counted by their number.  Repeated rows are one row; a key with several vectors has the sum of
    their links and one component.  Rows with a NULL key are left out, for they cannot be named.
    """
    arrow_batches(rows.sparkSession, 4000)
    spark = rows.sparkSession
    eps = float(np.sqrt(max(0.0, 2.0 - 2.0 * threshold))) + 1e-9
    named = rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("vec")).where("id IS NOT NULL")
    taking = named.where(F.col("label").isNotNull() & usable(F.col("vec"))).distinct()
    distinct = stored(taking.groupBy("label", "vec").agg(F.min("id").alias("vid"), F.count("*").alias("copies")).select("label", "vid", "copies", "vec"), "vectors")
    widths = sorted(r[0] for r in distinct.select(F.size("vec")).distinct().collect())
    found = spark.createDataFrame([], "vid long, links long, root long")
    for width in widths:
        own = distinct.where(F.size("vec") == width)
        found = found.unionByName(_join(_blocks(own, width, eps), width, threshold, eps))
    found = stored(found, "vector-links")
    degree = found.groupBy("vid").agg(F.sum("links").alias("links"))
    members = taking.join(distinct, ["label", "vec"]).select("id", "vid", "copies")
    counted = members.join(degree, "vid", "left").groupBy("id").agg(F.sum(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    # A key with several vectors ties their groups together.
    ties = found.where("vid <> root").select(F.col("vid").alias("a"), F.col("root").alias("b")).unionByName(members.where("id <> vid").select(F.col("id").alias("a"), F.col("vid").alias("b")))
    groups = components(ties, "a", "b")
    out = named.select("id").distinct().join(counted, "id", "left").join(groups.withColumnRenamed("node", "id"), "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
