"""Order-preserving packing: the documents' ids are one stream, cut into windows by dynamic programming.

Windows end at document ends, sentence ends or, where a sentence is long, anywhere.  The cuts minimise padding plus penalties for cutting
documents and sentences.  A window of n ids is padded to the full width, so the cheapest way to end at p is the least of (cost up to s) + s
over the starts s within one width before p; a monotone queue keeps that minimum while p moves on.  A window whose length is a power of two is
not padded, so the few starts at such distances are tried as well.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.llm.common import arrow_batches
from skyledger.llm.tokens import coder

WIDTH = 4096
#: What a cut between two sentences of a document, a cut inside a sentence and a further sequence cost, in ids of padding.
SENTENCE_CUT = 8
HARD_CUT = 48
SEQUENCE_COST = 8
#: A longer sentence may be cut after every id.
LONG_SENTENCE = 256
#: Ids that are cut together.  The last windows of a block wait for the next block, so blocks leave no seams.
BLOCK_IDS = 1 << 20
_WAITING_WINDOWS = 3


def window_cuts(positions: Sequence[int], penalties: Sequence[int], width: int = WIDTH, sequence_cost: int = SEQUENCE_COST) -> list[int]:
    """Indexes into ``positions`` where windows end, at least cost; ``positions`` ascend from 0 by at most ``width`` and the last one ends a window."""
    at = np.asarray(positions, np.int64)
    index = np.full(int(at[-1]) + 1, -1, np.int32)
    index[at] = np.arange(len(at), dtype=np.int32)
    ends, starts = [], []
    for size in (1 << k for k in range(width.bit_length()) if 1 << k <= width):
        end = np.flatnonzero(at >= size)
        start = index[at[end] - size]
        ends.append(end[start >= 0])
        starts.append(start[start >= 0])
    order = np.argsort(np.concatenate(ends), kind="stable")
    exact_end, exact_start = np.append(np.concatenate(ends)[order], len(at)).tolist(), np.concatenate(starts)[order].tolist()

    places, fines = at.tolist(), np.asarray(penalties).tolist()
    best, before = [0] * len(places), [0] * len(places)
    keys = [0] * len(places)  # best + position
    queue, head, exact = [0], 0, 0  # starts by ascending key
    for j in range(1, len(places)):
        place = places[j]
        while places[queue[head]] < place - width:
            head += 1
        start = queue[head]
        cost = keys[start] + width - place
        while exact_end[exact] == j:
            other = exact_start[exact]
            if best[other] < cost:
                cost, start = best[other], other
            exact += 1
        cost += fines[j] + sequence_cost
        best[j], before[j] = cost, start
        key = keys[j] = cost + place
        while len(queue) > head and keys[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    out, j = [], len(places) - 1
    while j:
        out.append(j)
        j = before[j]
    return out[::-1]


def cut_places(document_ends: np.ndarray, sentence_ends: np.ndarray, width: int, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window may end, from 0, and their penalties.  ``last``: nothing follows, so the last window's ids may be cut anywhere."""
    total = int(document_ends[-1])
    fines = np.full(total + 1, -1, np.int64)
    fines[sentence_ends] = SENTENCE_CUT
    fines[document_ends] = 0
    fines[0] = 0
    soft = np.flatnonzero(fines >= 0)
    long = np.flatnonzero(np.diff(soft) > min(LONG_SENTENCE, width))
    edges = np.zeros(total + 2, np.int64)
    edges[soft[long]] += 1
    edges[soft[long + 1]] -= 1
    anywhere = np.cumsum(edges[:-1]) > 0
    if last:
        anywhere[max(0, total - width) :] = True
    fines[anywhere & (fines < 0)] = HARD_CUT
    places = np.flatnonzero(fines >= 0)
    return places, fines[places]


def sentence_end_ids(vocabulary: dict[str, int]) -> np.ndarray:
    """By id, whether a token ends a sentence: signs without letters or digits that hold one of ``. ! ?``."""
    out = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
    for token, i in vocabulary.items():
        sign = token.removesuffix("</w>")
        out[i] = any(c in sign for c in ".!?") and not any(c.isalnum() for c in sign)
    return out


class _Stream:
    """Documents whose ids wait to be cut, and the windows of those that are complete."""

    def __init__(self, width: int, ends: np.ndarray, with_ids: bool, names: list[str]) -> None:
        self.width, self.ends, self.with_ids, self.names = width, ends, with_ids, names
        self.parts: list[np.ndarray] = []
        self.keys: list[pa.Array] = []
        self.sizes: list[np.ndarray] = []
        self.waiting, self.begun, self.number = 0, 0, TaskContext.get().partitionId() << 40

    def add(self, ids: np.ndarray, sizes: np.ndarray, keys: pa.Array) -> None:
        self.parts.append(ids)
        self.sizes.append(sizes)
        self.keys.append(keys)
        self.waiting += len(ids)

    def cut(self, last: bool) -> pa.RecordBatch:
        ids, sizes, keys = np.concatenate(self.parts), np.concatenate(self.sizes), pa.concat_arrays(self.keys)
        ends = np.cumsum(sizes) - self.begun  # the first document may have begun in windows that are gone
        firsts = ends - sizes
        places, fines = cut_places(ends, np.flatnonzero(self.ends[np.minimum(ids, len(self.ends) - 1)]) + 1, self.width, last)
        stops = places[window_cuts(places, fines, self.width)]
        if not last:
            stops = stops[:-_WAITING_WINDOWS]
        done = int(stops[-1]) if len(stops) else 0
        edges = np.union1d(stops, ends[ends <= done])
        starts, lengths = np.concatenate([[0], edges[:-1]])[: len(edges)], np.diff(edges, prepend=0)
        owner = np.searchsorted(ends, starts, "right")
        window = np.searchsorted(stops, starts, "right")
        opens = np.concatenate([[0], stops])[window] if len(stops) else starts
        data = memoryview(ids.astype("<u4").tobytes())
        sums = [zlib.crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
        columns = [keys.take(pa.array(owner)), *(pa.array(x.astype(np.int64)) for x in (starts - firsts[owner], lengths, np.array(sums, np.int64), sizes[owner], self.number + window, starts - opens))]
        if self.with_ids:
            columns.append(pa.ListArray.from_arrays(pa.array(np.append(starts, done), pa.int32()), pa.array(ids[:done].astype(np.int32))))
        self.number += len(stops)
        left = int(np.searchsorted(ends, done, "right"))
        self.begun = int(done - firsts[left]) if left < len(ends) else 0
        self.parts, self.keys, self.sizes = [ids[done:]], [keys.slice(left)], [sizes[left:]]
        self.waiting = len(ids) - done
        return pa.RecordBatch.from_arrays(columns, names=self.names)


def pack_in_order(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", end_id: int = 2, width: int = WIDTH, order: Sequence[str] = (), with_ids: bool = False) -> DataFrame:
    """One row per piece: ``key, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, if asked for, ``ids``.

    A document is its whole text's ids and ``end_id``; ``start`` counts the document's ids before the piece, ``offset`` the sequence's.  A
    NULL text is empty, so it is one piece of one id; NULL keys and repeated rows are documents of their own, in the order in which they are
    read; an empty table gives no rows; other columns are not read.  Without ``order`` the stored order is kept and nothing is
    shuffled; with it, rows are dealt by its ranges and sorted.  Each task cuts its own part of the stream, block by block, so it holds one block and
    one batch of texts.
    """
    arrow_batches(docs.sparkSession)
    if order:
        docs = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    counts = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    fields = [rows.schema["key"], *(T.StructField(name, T.LongType()) for name in counts)]
    schema = T.StructType(fields + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids)
    names = schema.names

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = coder(vocabulary)
        stream = _Stream(width, sentence_end_ids(tool.full.get_vocab()), with_ids, names)
        for batch in batches:
            for row, end, ids, at in tool.encode(batch.column(1)):
                stream.add(np.insert(ids, at[1:], end_id), np.diff(at) + 1, batch.column(0).slice(row, end - row))
                if stream.waiting >= BLOCK_IDS:
                    yield stream.cut(False)
        if stream.waiting:
            yield stream.cut(True)

    return rows.mapInArrow(cut, schema)
