"""What several operators share: stored intermediate tables, Arrow batches cut by bytes, and word hashes of raw bytes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.session import scratch_path

#: Bytes of text that one vectorised step works on; a longer text is a step of its own.
STEP_BYTES = 1 << 20
#: Rows of an Arrow batch, so that a batch of long texts stays small.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches small: texts have no upper length, so 10,000 of them may not fit a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the cluster's shared folder and read back: later steps survive lost executors and prune columns."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of a key's text modulo ``n``; a NULL key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd number modulo 2**64 and of its inverse, grown as longer texts need them."""

    base = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    @staticmethod
    def _series(step: int, n: int) -> np.ndarray:
        out = np.full(n, step, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, STEP_BYTES + 1)
            self.up, self.down = self._series(self.base, size), self._series(pow(self.base, -1, 1 << 64), size)
        return self.up, self.down


_POWERS = _Powers()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


#: Caches that outlive a task in a Python worker, which Spark uses for one operator after the other.
_HELD: list[dict] = []


def hold(cache: dict) -> dict:
    """Let ``cache`` outlive tasks until the worker turns to an operator that has no use for it."""
    _HELD.append(cache)
    return cache


def let_go() -> None:
    """Free what other operators have left in this worker."""
    for cache in _HELD:
        cache.clear()


def _trim() -> None:
    """Give memory that is free in this worker back to the machine; idle workers stay for later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library has no such call
        pass


def releasing(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], caches: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` that leaves no free memory behind in its worker, nor, if asked, what it would keep for the next task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            if caches:
                let_go()
            _trim()

    return run


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets into them; NULL is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def steps(at: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``most`` bytes each, or of one longer row."""
    row, n = 0, len(at) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        yield row, end
        row = end


def spans(solid: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs in ``solid``; ``firsts`` are positions where a run may not go on from before."""
    if not len(solid):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(len(solid) + 1, bool)
    cut[firsts] = True
    before = np.zeros(len(solid), bool)
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | cut[:-1]))
    after = np.zeros(len(solid), bool)
    after[:-1] = solid[1:]
    cut[-1] = True
    return starts, np.flatnonzero(solid & (~after | cut[1:])) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, from prefix sums of a polynomial, so that the cost is one pass over the bytes."""
    up, down = _POWERS.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix(((sums[ends] - sums[starts]) * down[starts]) ^ ((ends - starts).astype(np.uint64) << np.uint64(48)))


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each row, A-Z lower-cased, and the rows' offsets into them.

    A word is a run of bytes other than 0x20 and 0x09 to 0x0D; it never goes on from one row to the next.
    """
    data, at = data[at[0] : at[-1]], at - at[0]
    starts, ends = spans(~_SPACE[data], at[:-1])
    return span_hashes(_LOWER[data], starts, ends), np.searchsorted(starts, at)


def each_step(column: pa.Array, most: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, end row, word hashes and word offsets for each step of a string column."""
    let_go()
    data, at = string_bytes(column)
    for row, end in steps(at, most):
        yield row, end, *words(data, at[row : end + 1])


def strings(column: pa.Array) -> Iterable[str]:
    return column.fill_null("").to_pylist()
