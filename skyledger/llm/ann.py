"""Approximate nearest neighbours by largest inner product, with cross-polytope hashing.

Each table turns vectors by a fast pseudo-rotation (three rounds of random signs and a Hadamard transform); a vector's bucket is the signed
axis nearest to it, or a pair of them from two rotations for large tables.  A query probes the buckets whose axes are nearest to it in every
table.  Rows are held as 16-bit codes, whose error is known, so what a query finds there is bounded from both sides; only what may be
among its nearest is fetched and ranked exactly.  A probed bucket makes no row: a query carries how near its last probed bucket is in each
table, a row its buckets, and blocks of both meet in a task that compares what the probes reach.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.common import arrow_batches, stored

TABLES = 4
#: Rows of a block at least; a larger table has up to ``BLOCKS`` blocks, and more of them only if their vectors hold more than ``BLOCK_VALUES``.
BLOCK_ROWS = 4096
BLOCKS = 16
BLOCK_VALUES = 1 << 22
#: Blocks of queries have as many values at most, a quarter as many rows of the width 64.
QUERY_VALUES = 1 << 20
#: Pairs of a query and a row, or of a query and a bucket, that are looked at at once.
STEP_CELLS = 1 << 21
#: Rows of a block that are compared first.
HEAD_ROWS = 1024
#: Queries that the number of probes is calibrated on, and the share of their true neighbours that the probes must reach.
CALIBRATION_QUERIES = 64
CALIBRATION_RECALL = 0.96


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Hadamard transform of each row; the width is a power of two."""
    rows, width = x.shape
    half = 1
    while half < width:
        x = x.reshape(rows, -1, 2, half)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(rows, width)
        half *= 2
    return x / np.sqrt(width)


@dataclass(frozen=True)
class Hashing:
    width: int  # of a vector
    depth: int  # rotations whose axes make up a bucket
    tables: int = TABLES
    lift: float = 0.0  # largest norm if norms differ: a further component then turns inner products into angles
    seed: int = 0

    @property
    def padded(self) -> int:
        return 1 << max(0, (self.width + (self.lift > 0) - 1).bit_length())

    @property
    def buckets(self) -> int:
        return (2 * self.padded) ** self.depth

    def axes(self, vectors: np.ndarray, table: int, is_query: bool) -> list[np.ndarray]:
        """How near each vector is to each axis of a table's rotations."""
        x = np.zeros((len(vectors), self.padded))
        x[:, : self.width] = vectors
        norms = np.linalg.norm(vectors, axis=1, keepdims=True)
        if self.lift and not is_query:
            x[:, : self.width] /= self.lift
            x[:, self.width] = np.sqrt(np.maximum(0.0, 1.0 - (norms[:, 0] / self.lift) ** 2))
        else:
            x[:, : self.width] /= norms
        out = []
        for level in range(self.depth):
            signs = np.random.default_rng([self.seed, table, level]).choice([-1.0, 1.0], (3, self.padded))
            y = x
            for s in signs:
                y = hadamard(y * s)
            out.append(np.concatenate([y, -y], axis=1))
        return out

    def near(self, vectors: np.ndarray, table: int, is_query: bool) -> np.ndarray:
        """How near each vector is to each bucket's axes in a table."""
        out = np.zeros((len(vectors), 1))
        for y in self.axes(vectors, table, is_query):
            out = (out[:, :, None] + y[:, None, :]).reshape(len(vectors), -1)
        return out

    def bucket(self, vectors: np.ndarray, table: int) -> np.ndarray:
        """The nearest bucket of each row: the nearest axis of each rotation."""
        out = np.zeros(len(vectors), np.int64)
        for y in self.axes(vectors, table, False):
            out = out * y.shape[1] + y.argmax(1)
        return out

    def bars(self, vectors: np.ndarray, table: int, count: int) -> np.ndarray:
        """How near each query is to the last of its ``count`` nearest buckets, a few queries at a time, since pairs of axes make many buckets."""
        out, step = [np.zeros(0)], max(1, STEP_CELLS // self.buckets)
        for i in range(0, len(vectors), step):
            near = self.near(vectors[i : i + step], table, True)
            out.append(np.partition(near, self.buckets - count, axis=1)[:, self.buckets - count])
        return np.concatenate(out)


def usable(vector: Column) -> Column:
    """Neither NULL nor zero, all components finite."""
    value = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, value) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


#: Steps of a code on either side of zero.
_STEPS = 32767


def _coded(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector as 16-bit steps, and the size of its step."""
    step = np.maximum(np.abs(vectors).max(1) / _STEPS, np.finfo(float).tiny)
    return np.rint(vectors / step[:, None]).astype("<i2"), step


def _decoded(codes: pa.Array, steps: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors from codes, their norms, and how far each may lie from its original."""
    x = np.frombuffer(b"".join(codes.to_pylist()), "<i2").reshape(-1, width) * steps[:, None]
    # Half a step for each component, and a little for the rounding of sums.
    norms = np.linalg.norm(x, axis=1)
    return x, norms, 0.5001 * steps * np.sqrt(width) + 1e-12 * norms


def _calibrate(queries: DataFrame, base: DataFrame, hashing: Hashing, k: int) -> int:
    """Probes per table with which a small sample of queries reaches enough of its true neighbours, found by comparing it with all rows."""
    width = hashing.width
    sample = queries.select("vid", "vec").orderBy(F.xxhash64("vid"), "vid").limit(CALIBRATION_QUERIES).toArrow()
    if not sample.num_rows:
        return 1
    ids, vectors = sample.column("vid").to_numpy(), _matrix(sample.column("vec").combine_chunks(), width)
    shared = base.sparkSession.sparkContext.broadcast((ids, vectors))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, wanted = shared.value
        best: list[tuple] = [(np.zeros(0), np.zeros((0, width)))] * len(own)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("vec"), width)
            scores = wanted @ x.T
            scores[own[:, None] == batch.column("vid").to_numpy()[None, :]] = -np.inf
            for i, row in enumerate(scores):
                top = np.argpartition(-row, min(k, len(row)) - 1)[:k]
                s, v = np.concatenate([best[i][0], row[top]]), np.concatenate([best[i][1], x[top]])
                top = np.argpartition(-s, min(k, len(s)) - 1)[:k]
                best[i] = (s[top], v[top])
        for i, (s, v) in enumerate(best):
            if len(s):
                yield pa.RecordBatch.from_pydict({"q": pa.array(np.full(len(s), i, np.int32)), "score": pa.array(s), "vec": pa.array(list(v), pa.list_(pa.float64()))})

    found = base.select("vid", "vec").mapInArrow(nearest, "q int, score double, vec array<double>").where(F.col("score") > float("-inf"))
    top = found.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))).where(F.col("n") <= k).select("q", "vec").toArrow()
    if not top.num_rows:
        return 1
    which, near = top.column("q").to_numpy(), _matrix(top.column("vec").combine_chunks(), width)
    ranks = np.full(len(which), hashing.buckets)
    for table in range(hashing.tables):
        goal = hashing.bucket(near, table)
        for q in np.unique(which):
            mine = which == q
            scores = hashing.near(vectors[q : q + 1], table, True)[0]
            ranks[mine] = np.minimum(ranks[mine], (scores[None, :] > scores[goal[mine]][:, None]).sum(1))
    return int(np.quantile(ranks, CALIBRATION_RECALL, method="higher")) + 1


def nearest(base: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", probes: int | None = None) -> DataFrame:
    """The ``k`` rows of ``base`` with the largest inner product found for each query: ``query_id, rank`` from 1, ``key, score``.

    Double precision; nearest first, ties to the smaller key; a row is not its own neighbour.  NULL keys take no part, nor do vectors that are
    NULL, zero, or hold NULL or non-finite components, nor those whose length differs from the most frequent one.  Repeated rows are one row;
    equal vectors are compared once and ranked by key, so a group of copies costs as much as one vector and ``k + 1`` keys.

    Every usable row is indexed.  ``probes`` per table come from a sample of ``CALIBRATION_QUERIES`` queries, compared with all rows.  Buckets are
    never capped; buckets as near as a query's last probed one are probed, too.  Rows are dealt by hash into blocks, queries too, and each pair of
    blocks gives ``k + 1`` rows for a query and what their errors leave open.
    """
    arrow_batches(base.sparkSession, 4000)
    both = base.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & usable(F.col("vec")))
    asked = queries.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & usable(F.col("vec")))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    facts = both.groupBy(F.size("vec").alias("width")).agg(F.count("*").alias("n"), F.min(norm).alias("low"), F.max(norm).alias("high")).orderBy(F.desc("n"), "width").limit(1).collect()
    result = "query_id long, rank int, vec_id long, score double"
    if not facts:
        return base.sparkSession.createDataFrame([], result).withColumnRenamed("vec_id", key)
    width, n, low, high = facts[0]
    lift = float(high) if low < 0.999 * high else 0.0
    axes = 2 * Hashing(width, 1, lift=lift).padded
    hashing = Hashing(width, 1 if n <= axes * BLOCK_ROWS else 2, lift=lift)
    both, asked = both.where(F.size("vec") == width), asked.where(F.size("vec") == width)

    # Equal vectors are one candidate with its k + 1 smallest keys.
    first = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    copies = both.dropDuplicates(["id", "vec"]).withColumn("n", first).where(F.col("n") <= k + 1).groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    distinct = stored(copies.select(F.get("ids", 0).alias("vid"), "vec", "ids"), "ann-vectors")
    wanted = asked.dropDuplicates(["id", "vec"])
    query_vectors = stored(wanted.groupBy("vec").agg(F.min("id").alias("vid")).select("vid", "vec"), "ann-queries")
    probes = probes or _calibrate(query_vectors, distinct, hashing, k)
    probes = min(probes, hashing.buckets)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = _matrix(batch.column("vec"), width)
                codes, steps = _coded(vectors)
                buckets = np.stack([hashing.bucket(vectors, table) for table in range(hashing.tables)], axis=1)
                yield pa.RecordBatch.from_pydict({"vid": batch.column("vid"), "code": pa.array([x.tobytes() for x in codes], pa.binary()), "step": pa.array(steps), "buckets": _lists(buckets.astype(np.int32))})

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = _matrix(batch.column("vec"), width)
                bars = np.stack([hashing.bars(vectors, table, probes) for table in range(hashing.tables)], axis=1)
                yield pa.RecordBatch.from_pydict({"vid": batch.column("vid"), "vec": _lists(vectors), "bars": _lists(bars)})

    indexed = stored(distinct.select("vid", "vec").mapInArrow(index, "vid long, code binary, step double, buckets array<int>"), "ann-buckets")
    probing = stored(query_vectors.mapInArrow(probe, "vid long, vec array<double>, bars array<double>"), "ann-probes")
    # Each block of rows meets each block of queries in a task of its own, which tells from bars and buckets what a query probes.
    rows = indexed.count()
    blocks = math.ceil(rows / max(1, min(max(BLOCK_ROWS, math.ceil(rows / BLOCKS)), BLOCK_VALUES // width)))
    query_blocks = max(1, math.ceil(probing.count() / max(1, QUERY_VALUES // width)))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(1, n) - 1)))
    own = lambda n: F.pmod(F.xxhash64("vid"), F.lit(max(1, n))).cast("int")
    pairs = indexed.withColumns({"block": own(blocks), "query_block": numbers(query_blocks)}).unionByName(
        probing.withColumns({"block": numbers(blocks), "query_block": own(query_blocks)}), allowMissingColumns=True
    )

    def compare(group: pa.Table) -> pa.Table:
        asks = pc.is_valid(group.column("bars"))
        base, asked = group.filter(pc.invert(asks)).combine_chunks(), group.filter(asks).combine_chunks()
        ids, qids = base.column("vid").to_numpy(), asked.column("vid").to_numpy()
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))]
        if len(ids) and len(qids):
            vectors, norms, error = _decoded(base.column("code"), base.column("step").to_numpy(), width)
            # Sums of single precision are this far off, at most.
            vectors, error = vectors.astype(np.float32), error + (width + 4) * 2.0**-24 * norms
            buckets = base.column("buckets").combine_chunks().flatten().to_numpy().reshape(-1, hashing.tables).astype(np.int64)
            axes = [np.unravel_index(buckets[:, table], (2 * hashing.padded,) * hashing.depth) for table in range(hashing.tables)]
            wanted = _matrix(asked.column("vec").combine_chunks(), width)
            bars = _matrix(asked.column("bars").combine_chunks(), hashing.tables)
            most, step = min(k + 1, len(ids)), max(1, STEP_CELLS // len(ids))
            for i in range(0, len(qids), step):
                q = wanted[i : i + step]
                turned = [hashing.axes(q, table, True) for table in range(hashing.tables)]

                def met(a: np.ndarray, b: np.ndarray, turned: list[list[np.ndarray]] = turned, bars: np.ndarray = bars[i : i + step]) -> np.ndarray:
                    """Whether queries ``a`` probe a bucket of rows ``b``."""
                    out = False
                    for table, (ys, xs) in enumerate(zip(turned, axes, strict=True)):
                        out |= sum(y[a, x[b]] for y, x in zip(ys, xs, strict=True)) >= bars[a, table]
                    return out

                scores = q.astype(np.float32) @ vectors.T
                # The inner product of the originals is at most this far off.
                size = np.linalg.norm(q, axis=1)
                # What the first rows hold rules out most others before their buckets are looked at.
                head = min(len(ids), max(HEAD_ROWS, most))
                first = np.where(met(np.arange(len(q))[:, None], np.arange(head)[None, :]), scores[:, :head], np.float32(-np.inf))
                last = np.partition(first, head - most, axis=1)[:, head - most]
                a, b = np.nonzero(scores >= (last - 2.001 * size * error.max()).astype(np.float32)[:, None])
                own = met(a, b)
                a, b = a[own], b[own]
                score, off = scores[a, b].astype(np.float64), size[a] * error[b]
                low, high = score - off, score + off
                counts = np.bincount(a, minlength=len(q))
                order = np.lexsort((-low, a))
                full = np.flatnonzero(counts >= most)
                bar = np.full(len(q), -np.inf)
                bar[full] = low[order[(np.cumsum(counts) - counts)[full] + most - 1]]
                near = high >= bar[a]
                found.append((qids[i + a[near]], ids[b[near]], low[near], high[near]))
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["qid", "vid", "low", "high"])

    # Few rows make much work, so each pair gets a partition of its own, more or less.
    pairs = pairs.repartition(max(1, 2 * blocks * query_blocks), "block", "query_block")
    found = pairs.groupBy("block", "query_block").applyInArrow(compare, "qid long, vid long, low double, high double")
    # Whatever may be among the k + 1 nearest of all that was found; equal vectors stand for one another.
    ranked = found.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("low"))))
    bar = F.min(F.when(F.col("n") <= k + 1, F.col("low"))).over(Window.partitionBy("qid"))
    near = ranked.withColumn("bar", bar).where("high >= bar").select("qid", "vid")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                scores = np.einsum("nd,nd->n", _matrix(batch.column("asked"), width), _matrix(batch.column("vec"), width))
                yield pa.RecordBatch.from_arrays([batch.column("qid"), batch.column("vid"), pa.array(scores), batch.column("ids")], names=["qid", "vid", "score", "ids"])

    kind = distinct.schema["ids"].dataType.simpleString()
    fetched = near.join(distinct, "vid").join(query_vectors.select(F.col("vid").alias("qid"), F.col("vec").alias("asked")), "qid")
    found = fetched.select("qid", "vid", "asked", "vec", "ids").mapInArrow(exact, f"qid long, vid long, score double, ids {kind}")

    def best(rows: DataFrame, by: str, ident: str, n: int) -> DataFrame:
        order = Window.partitionBy(by).orderBy(F.desc("score"), ident)
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)

    top = best(found, "qid", "vid", k + 1).drop("rank")
    top = best(top.select("qid", "score", F.explode("ids").alias(key)), "qid", key, k + 1).groupBy("qid").agg(F.collect_list(F.struct("score", key)).alias("near"))
    # Queries with equal vectors share their search.
    members = wanted.join(query_vectors.withColumnRenamed("vid", "qid"), "vec").select(F.col("id").alias("query_id"), "qid")
    each = members.join(top, "qid").select("query_id", F.explode("near").alias("x")).select("query_id", f"x.{key}", "x.score").where(F.col(key) != F.col("query_id"))
    return best(each, "query_id", key, k).select("query_id", F.col("rank").cast("int").alias("rank"), key, "score")
