"""Token ids as binary blocks compressed by Re-Pair grammars, with random access to each document.

A file row is one block: consecutive documents in key order, the grammar rules (two symbols each) of the block, every rule's expansion
length, and the symbols that are left.  Symbols below ``base`` are token ids, ``base + i`` is rule ``i``.  Numbers are little-endian.
Blocks are rows of a Parquet table, so any store that Spark can write holds them, and a lost task leaves no half-written block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.llm.common import arrow_batches
from skyledger.llm.tokens import coder

BLOCK_TOKENS = 1 << 20
#: A pair is replaced while it has so many places, the most frequent ones of a round together.
LEAST_USES = 8
PAIRS_A_ROUND = 2048
_BUCKET_BITS = 18


def compress(ids: np.ndarray, base: int, rounds: int | None = None, least: int = LEAST_USES) -> tuple[np.ndarray, np.ndarray]:
    """Rules and symbols for ``ids``.

    A round counts the adjacent pairs, gives the most frequent ones a new symbol each and replaces their places from left to right
    without overlap; in a run of frequent pairs every second place takes part, and the others may in the next round.  It goes on until a round
    finds no frequent pair, or after ``rounds``.  Pairs are counted in hash buckets first, so that only places of frequent buckets are
    compared exactly.  With ids below 65,536 the number of rules keeps symbols in two bytes.
    """
    room = 65536 - base if base < 65536 else 1 << 20
    # A pair is one number: of 32 bits while symbols have 16.
    kind, half, factor = (np.uint32, 16, 0x9E3779B1) if base < 65536 else (np.uint64, 32, 0x9E3779B97F4A7C15)
    symbols, rules = ids.astype(kind), []
    while (rounds is None or rounds > 0) and len(symbols) >= 2 and room > 0:
        rounds = None if rounds is None else rounds - 1
        pairs = (symbols[:-1] << kind(half)) | symbols[1:]
        bucket = ((pairs * kind(factor)) >> kind(2 * half - _BUCKET_BITS)).astype(np.int64)
        counts = np.bincount(bucket, minlength=1 << _BUCKET_BITS)
        most = min(PAIRS_A_ROUND, room)
        bar = max(least, int(np.partition(counts, -most)[-most]))
        at = np.flatnonzero(counts[bucket] >= bar)
        if not len(at):
            break
        run = np.concatenate([[True], np.diff(at) != 1])
        place = np.arange(len(at))
        at = at[(place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0]
        coded = pa.array(pairs[at]).dictionary_encode()
        which, found = coded.indices.to_numpy(), coded.dictionary.to_numpy()
        uses = np.bincount(which, minlength=len(found))
        chosen = np.flatnonzero(uses >= least)
        chosen = chosen[np.argsort(-uses[chosen], kind="stable")][:room]
        if not len(chosen):
            break
        new = np.full(len(found), -1, np.int64)
        first = base + sum(len(r) for r in rules)
        new[chosen] = first + np.arange(len(chosen))
        rules.append(np.stack([found[chosen] >> kind(half), found[chosen] & kind((1 << half) - 1)], axis=1).astype(np.int64))
        room -= len(chosen)
        put = new[which]
        replaced = put >= 0
        at = at[replaced]
        symbols[at] = put[replaced]
        left = np.ones(len(symbols), bool)
        left[at + 1] = False
        symbols = symbols[left]
    return (np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)), symbols.astype(np.int64)


def rule_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """How many ids each rule stands for."""
    out = np.zeros(len(rules), np.int64)
    waiting = np.arange(len(rules))
    while len(waiting):
        body = rules[waiting]
        sizes = np.where(body < base, 1, out[np.maximum(body - base, 0)])
        ready = (sizes > 0).all(1)
        out[waiting[ready]] = sizes[ready].sum(1)
        waiting = waiting[~ready]
    return out


class Block:
    """A decoded grammar: all ids of the block, or those of any span without the rest."""

    def __init__(self, base: int, rules: bytes, lengths: bytes, symbols: bytes, width: int) -> None:
        self.base = base
        self.rules = np.frombuffer(rules, "<u4").astype(np.int64).reshape(-1, 2)
        self.lengths = np.frombuffer(lengths, "<u4").astype(np.int64)
        self.symbols = np.frombuffer(symbols, f"<u{width}").astype(np.int64)
        self.ends = np.cumsum(self._sizes(self.symbols))

    def _sizes(self, symbols: np.ndarray) -> np.ndarray:
        sizes = np.ones(len(symbols), np.int64)
        big = symbols >= self.base
        sizes[big] = self.lengths[symbols[big] - self.base]
        return sizes

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        while (big := symbols >= self.base).any():
            to = np.cumsum(1 + big) - 1 - big
            out = np.empty(len(symbols) + int(big.sum()), np.int64)
            out[to] = symbols
            body = self.rules[symbols[big] - self.base]
            out[to[big]], out[to[big] + 1] = body[:, 0], body[:, 1]
            symbols = out
        return symbols

    def span(self, start: int, length: int) -> np.ndarray:
        """The ids at ``start`` and after; only the symbols over them are expanded."""
        if length <= 0:
            return np.zeros(0, np.int64)
        low = int(np.searchsorted(self.ends, start, "right"))
        high = int(np.searchsorted(self.ends, start + length, "left"))
        skip = start - (int(self.ends[low - 1]) if low else 0)
        return self._expand(self.symbols[low : high + 1])[skip : skip + length]

    def all(self) -> np.ndarray:
        """All ids: every rule is expanded once and copied to its places, unless the rules alone are longer than the block."""
        if self.lengths.sum() > max(BLOCK_TOKENS, int(self.ends[-1]) if len(self.ends) else 0):
            return self._expand(self.symbols)
        pool = np.concatenate([np.arange(self.base), self._expand(np.arange(self.base, self.base + len(self.lengths)))])
        firsts = np.concatenate([np.arange(self.base), self.base + np.cumsum(self.lengths) - self.lengths])
        sizes = np.diff(self.ends, prepend=0)
        return pool[np.repeat(firsts[self.symbols] - (self.ends - sizes), sizes) + np.arange(sizes.sum())]


def write_token_blocks(docs: DataFrame, vocabulary: str, path: str, key: str = "doc_id", text: str = "text", end_id: int = 2, block_tokens: int = BLOCK_TOKENS) -> None:
    """Encode whole texts, add ``end_id`` to each, and write blocks in ascending key order below ``path``.

    NULL texts are empty, NULL keys come first, repeated rows are written each time (rows with equal keys by a hash of the text), an empty table gives an
    empty file set, other columns are not read.  Documents are dealt by ranges of the key, so one task holds one block in memory.
    """
    arrow_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    # Rows with one key are dealt by a hash of the text: range bounds come from a sample that the driver sees, so it must not hold texts.
    code = F.xxhash64("text")
    ordered = rows.repartitionByRange("key", code).sortWithinPartitions("key", code)
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("keys", T.ArrayType(rows.schema["key"].dataType)), T.StructField("lengths", T.ArrayType(T.LongType())),
        T.StructField("base", T.IntegerType()), T.StructField("rules", T.BinaryType()), T.StructField("rule_lengths", T.BinaryType()),
        T.StructField("width", T.IntegerType()), T.StructField("symbols", T.BinaryType()),
    ])
    names = schema.names

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = coder(vocabulary)
        base = max(tool.full.get_vocab_size(), end_id + 1)
        part, count = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        keys: list[pa.Array] = []
        lengths: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            nonlocal count
            flat, sizes, own = np.concatenate(ids), np.concatenate(lengths), pa.concat_arrays(keys)
            rules, symbols = compress(flat, base)
            width = 2 if base + len(rules) <= 65536 else 4
            columns = [
                pa.array([part], pa.int32()), pa.array([count], pa.int32()), pa.array([len(flat)], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), pa.array([sizes.tolist()], pa.list_(pa.int64())),
                pa.array([base], pa.int32()), pa.array([rules.astype("<u4").tobytes()], pa.binary()), pa.array([rule_lengths(rules, base).astype("<u4").tobytes()], pa.binary()),
                pa.array([width], pa.int32()), pa.array([symbols.astype(f"<u{width}").tobytes()], pa.binary()),
            ]
            count += 1
            ids.clear(), keys.clear(), lengths.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        size = 0
        for batch in batches:
            for row, end, got, at in tool.encode(batch.column(1)):
                ids.append(np.insert(got, at[1:], end_id))
                lengths.append(np.diff(at) + 1)
                keys.append(batch.column(0).slice(row, end - row))
                size += len(ids[-1])
                if size >= block_tokens:
                    yield close()
                    size = 0
        if ids:
            yield close()

    ordered.mapInArrow(blocks, schema).write.parquet(path)


def read_token_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: ``key``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids_crc32``.

    Blocks are numbered in two steps, sums over a part's blocks and sums over parts, so no task sees all blocks.
    """
    files = spark.read.parquet(path)
    sizes = files.select("part", "block", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("part_start"))
    inner = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("base_start", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0))).join(parts, "part")
    starts = starts.select("part", "block", (F.col("base_start") + F.col("part_start")).alias("block_start"))
    kind = files.schema["keys"].dataType.elementType
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("key", kind),
        T.StructField("at", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    ])
    names = schema.names

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x = {name: batch.column(name)[row] for name in batch.schema.names}
                ids = Block(*(x[n].as_py() for n in ("base", "rules", "rule_lengths", "symbols", "width"))).all().astype("<u4")
                lengths, keys = x["lengths"].values.to_numpy(), x["keys"].values
                ends = np.cumsum(lengths)
                data = memoryview(ids.tobytes())
                sums = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                n = len(lengths)
                columns = [pa.array(np.full(n, x[c].as_py(), np.int32)) for c in ("part", "block")]
                columns += [keys, pa.array(ends - lengths), pa.array(lengths), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    read = files.mapInArrow(decode, schema)
    return read.join(starts, ["part", "block"]).select("key", (F.col("at") + F.col("block_start")).alias("start"), "n_tokens", "ids_crc32")
