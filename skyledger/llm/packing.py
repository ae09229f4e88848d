"""Best-fit packing of documents into fixed-width sequences by hierarchical residual packing.

Partitions pack their own items best-fit and close the nearly full bins.  The underfull bins become items of the next round: they are
merged into fewer groups, packed again, and so on, until one group is left or a round no longer helps.  Only lengths move between rounds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.llm.common import arrow_batches, releasing, stored
from skyledger.llm.tokens import coder

WIDTH = 2048
#: Items that one task packs at once.
GROUP_ITEMS = 20_000
#: Bytes of text that are encoded at once.
_STEP_BYTES = 1 << 18
#: A bin with less room than this share of the width is closed.
NEARLY_FULL = 64


def token_pieces(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", end_id: int = 0, width: int = WIDTH, with_ids: bool = False, keep_words: bool = True) -> DataFrame:
    """Documents as pieces of at most ``width`` ids: ``key, piece, start, length, ids_crc32`` and, if asked for, ``ids``.

    A document is its whole text's ids and ``end_id``; only longer ones are cut.  A NULL text is empty, so it is one piece of one id.
    NULL keys and repeated rows give pieces of their own; other columns are not read.  Without ``keep_words`` a worker frees its vocabulary
    after each task, which costs time and leaves memory to others.
    """
    arrow_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    fields = [rows.schema["key"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    schema = T.StructType(fields + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids)
    names = schema.names

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = coder(vocabulary)
        for batch in batches:
            for row, end, ids, at in tool.encode(batch.column(1), _STEP_BYTES):
                ids = np.insert(ids, at[1:], end_id).astype("<i4")
                sizes = np.diff(at) + 1
                firsts = np.cumsum(sizes) - sizes
                counts = -(-sizes // width)
                owner = np.repeat(np.arange(len(sizes)), counts)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
                start = piece * width
                length = np.minimum(width, sizes[owner] - start)
                data = memoryview(ids.tobytes())
                begin = firsts[owner] + start
                sums = [zlib.crc32(data[4 * b : 4 * (b + n)]) for b, n in zip(begin.tolist(), length.tolist(), strict=True)]
                columns = [batch.column(0).slice(row, end - row).take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(sums, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(begin, len(ids)), pa.int32()), pa.array(ids)))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(releasing(cut, caches=not keep_words), schema)


def best_fit(sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Best-fit decreasing: each item's bin and offset, and each bin's fill.  An item of ``width`` or more gets a bin of its own."""
    bins, offsets, fills = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    open_bins: list[list[int]] = [[] for _ in range(width + 1)]  # by room
    rooms = 0  # bit r: some bin has room r
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        fitting = rooms >> size if size <= width else 0
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            target = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            target, room = len(fills), max(width, size)
            fills.append(0)
        bins[item], offsets[item] = target, fills[target]
        fills[target] += size
        room -= size
        if 0 < room <= width:
            open_bins[room].append(target)
            rooms |= 1 << room
    return bins, offsets, fills


def _pack_local(items: DataFrame, width: int, level: int) -> DataFrame:
    """One round: every column of ``items`` and ``__bin, __offset, __fill, __head`` (first item of its bin)."""
    added = [("__bin", T.LongType()), ("__offset", T.LongType()), ("__fill", T.LongType()), ("__head", T.BooleanType())]
    schema = T.StructType([*items.schema.fields, *(T.StructField(n, t) for n, t in added)])
    names, column = schema.names, items.columns.index("__size")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = (level << 56) | (TaskContext.get().partitionId() << 32)
        waiting: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal first
            rows = pa.Table.from_batches(waiting).combine_chunks()
            waiting.clear()
            bins, offsets, fills = best_fit(rows.column(column).to_numpy(), width)
            head = np.zeros(len(bins), bool)
            head[np.unique(bins, return_index=True)[1]] = True
            columns = [*rows.columns, pa.array(first + bins), pa.array(offsets), pa.array(np.array(fills, np.int64)[bins]), pa.array(head)]
            first += len(fills)
            yield from pa.Table.from_arrays(columns, names=names).to_batches(10_000)

        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= GROUP_ITEMS:
                yield from flush()
        if sum(b.num_rows for b in waiting):
            yield from flush()

    return items.mapInArrow(releasing(pack), schema)


def pack(items: DataFrame, length: str = "length", width: int = WIDTH) -> DataFrame:
    """Every column of ``items`` with ``sequence_id`` and ``offset``: its sequence, and its place there, without gaps from 0.

    ``length`` counts the item's tokens; NULL counts as 0.  Items longer than ``width`` get a sequence of their own.  Equal and repeated
    rows are packed each by itself; columns named like the results are replaced.  Every round is written to the shared folder, so lost
    executors recompute nothing that later rounds have used.  A task packs at most about ``GROUP_ITEMS`` items at a time.
    """
    arrow_batches(items.sparkSession)
    kept = [c for c in items.columns if c not in ("sequence_id", "offset")]
    sized = items.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__row"), F.coalesce(F.col(length).cast("long"), F.lit(0)).alias("__size"))
    # Items are written before they are packed, so that a task never runs the workers that made them and those that pack them side by side.
    packed = stored(_pack_local(stored(sized, "pack-items"), width, 0), "pack-0")
    room = width // NEARLY_FULL
    underfull = F.col("__fill") < width - room
    rest = packed.where(F.col("__head") & underfull).select(F.col("__bin").alias("child"), F.col("__fill").alias("__size"))
    left, level, links = rest.count(), 1, []
    while left > 1:
        groups = -(-left // GROUP_ITEMS)
        merged = stored(_pack_local(rest.repartition(groups), width, level), f"pack-{level}")
        links.append(merged.select("child", F.col("__bin").alias("parent"), F.col("__offset").alias("shift")))
        rest = merged.where(F.col("__head") & underfull).select(F.col("__bin").alias("child"), F.col("__fill").alias("__size"))
        before, left, level = left, rest.count(), level + 1
        if groups == 1 or left > 0.99 * before:
            break
    columns = [F.col(f"__row.`{c}`") for c in kept]
    if not links:
        return packed.select(*columns, F.col("__bin").alias("sequence_id"), F.col("__offset").alias("offset"))
    place = links.pop()
    while links:
        above = place.select(F.col("child").alias("parent"), F.col("parent").alias("top"), F.col("shift").alias("more"))
        place = links.pop().join(above, "parent", "left").select("child", F.coalesce("top", "parent").alias("parent"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
    closed = packed.where(~underfull).select(*columns, F.col("__bin").alias("sequence_id"), F.col("__offset").alias("offset"))
    moved = packed.where(underfull).join(place, F.col("__bin") == F.col("child"), "left")
    return closed.unionByName(moved.select(*columns, F.coalesce("parent", "__bin").alias("sequence_id"), (F.col("__offset") + F.coalesce("shift", F.lit(0))).alias("offset")))


def sequences(packed: DataFrame) -> DataFrame:
    """The ids of every sequence in order, for pieces that carry ``ids``.  A sequence has at most ``width`` ids, so groups are small."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(parts.getField("ids")).alias("ids"))
