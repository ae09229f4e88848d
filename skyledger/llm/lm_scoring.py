"""N-gram language model in a log-frequency Bloom filter.

Counts of words and word pairs are quantised to levels; an n-gram of level q is in the filter as (n-gram, 1) to (n-gram, q), so its level is
found by probing 1, 2, ... until one is absent.  The filter is built in segments by hash of the n-gram and holds every n-gram at any size.  While
it is small it is broadcast; a larger one stays in its segments, to which the n-grams of the texts are sent.  Both ways give the same levels.
A token's probability mixes its relative frequency after the previous token with its smoothed frequency.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import arrow_batches, each_step, mix, stored

#: Bound of a broadcast filter; n-grams are sent to the segments of a larger one.
MAX_FILTER_BITS = 1 << 30
BITS_PER_ENTRY = 8
PROBES = 4
#: Bound of the broadcast table of exact counts, in words; rarer words are looked up by a join.
MAX_FREQUENT = 1 << 18
#: Tokens that a task counts before it hands sums on, and n-grams of a segment of the filter.
FLUSH_TOKENS = 1 << 21
SEGMENT_TOKENS = 1 << 20
#: Bytes of text whose n-grams are sent to the segments together.
ASK_BYTES = 1 << 22
WEIGHTS = np.array([0.0, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])

END = np.uint64(0x243F6A8885A308D3)
_PAIR = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_BLOCK_BITS = 512


def _thresholds(growth: float = 1.3) -> np.ndarray:
    out = [1]
    while out[-1] < 1 << 60:
        out.append(max(out[-1] + 1, int(out[-1] * growth)))
    return np.array(out, np.int64)


#: An n-gram has level q if its count is at least THRESHOLDS[q - 1].
THRESHOLDS = _thresholds()
#: What a level stands for: the middle of its counts; level 0 is 0.
VALUES = np.concatenate([[0.0], (THRESHOLDS[:-1] + THRESHOLDS[1:] - 1) / 2.0])


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(THRESHOLDS, counts, "right")


def _tokens(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of each row with one end after them, and the rows' offsets."""
    return np.insert(words, at[1:], END), at + np.arange(len(at))


def pairs(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash for each token after its predecessor; a text begins after an end."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[at[:-1]] = END
    return mix(before * _PAIR[0] + tokens * _PAIR[1])


def _word_counts(texts: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(waiting), return_counts=True)
            waiting.clear()
            return pa.RecordBatch.from_pydict({"word": pa.array(found.view(np.int64)), "n": pa.array(n.astype(np.int64))})

        for batch in batches:
            for _, _, words, at in each_step(batch.column(0)):
                waiting.append(_tokens(words, at)[0])
            if sum(map(len, waiting)) >= FLUSH_TOKENS:
                yield flush()
        if waiting:
            yield flush()

    return texts.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _rest(grams: np.ndarray, bits: int) -> np.ndarray:
    return (grams >> np.uint64(32 - bits)) & np.uint64((1 << 32) - 1)


def _packed(grams: np.ndarray, counts: np.ndarray, bits: int) -> pa.RecordBatch:
    """Sums by segment, the leading ``bits`` of the hash, as bytes: the next 32 bits and the counts.

    Segments have about as many n-grams at any size of the corpus, so 32 more bits tell them apart far better than the filter does.
    """
    segment = (grams >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(grams), np.int64)
    rest, n = _rest(grams, bits).astype("<u4"), counts.astype("<u4")
    edges = np.flatnonzero(np.diff(segment, prepend=-1))
    stops = np.append(edges[1:], len(grams))
    part = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(edges, stops, strict=True)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(segment[edges].astype(np.int32)), part(rest), part(n)], names=["segment", "rest", "n"])


def _probe_bits(keys: np.ndarray, level: int, blocks: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """A key's block among ``blocks`` and its bits there, for one level."""
    g = mix(keys + np.uint64(level * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))
    return ((g >> np.uint64(36)) * blocks.astype(np.uint64)) >> np.uint64(28), [(g >> np.uint64(9 * i)) & np.uint64(_BLOCK_BITS - 1) for i in range(PROBES)]


def _build(group: pa.Table, least: int, bits: int) -> pa.Table:
    """The filter of one segment: n-grams are summed and their levels entered."""
    rest, n = (np.frombuffer(b"".join(group.column(c).to_pylist()), "<u4") for c in ("rest", "n"))
    order = np.argsort(rest)
    rest, n = rest[order].astype(np.uint64), n[order].astype(np.int64)
    starts = np.flatnonzero(np.diff(rest, prepend=rest[:1] ^ np.uint64(1)))
    rest, n = rest[starts], np.add.reduceat(n, starts) if len(starts) else n
    rest, n = rest[n >= least], n[n >= least]
    levels = level_of(n)
    blocks = max(1, -(-int(levels.sum()) * BITS_PER_ENTRY // _BLOCK_BITS))
    field = np.zeros(blocks * _BLOCK_BITS, bool)
    keys, left = rest, levels
    level = 1
    while len(keys):
        block, places = _probe_bits(keys, level, np.full(len(keys), blocks))
        for p in places:
            field[(block * np.uint64(_BLOCK_BITS) + p).astype(np.int64)] = True
        level += 1
        keys, left = keys[left >= level], left[left >= level]
    return pa.table({"segment": group.column("segment").slice(0, 1).cast(pa.int32()), "entries": pa.array([int(levels.sum())], pa.int64()), "field": pa.array([np.packbits(field, bitorder="little").tobytes()], pa.binary())})


@dataclass
class Filter:
    bits: int  # of the hash that choose a segment
    blocks: np.ndarray  # by segment
    starts: np.ndarray  # first byte of each segment
    field: np.ndarray  # bytes

    def levels(self, grams: np.ndarray) -> np.ndarray:
        """Levels by repeated membership probes; an n-gram that was never entered has level 0 but for false positives."""
        out = np.zeros(len(grams), np.int64)
        segment = (grams >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(grams), np.int64)
        keys = _rest(grams, self.bits)
        where, level = np.flatnonzero(self.blocks[segment] > 0), 1
        while len(where):
            here = segment[where]
            block, places = _probe_bits(keys[where], level, self.blocks[here])
            first = self.starts[here] + block.astype(np.int64) * (_BLOCK_BITS // 8)
            found = np.ones(len(where), bool)
            for p in places:
                found &= (self.field[first + (p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
            where = where[found]
            out[where] = level
            level += 1
        return out


@dataclass
class Model:
    tokens: int  # N
    words: int  # V
    counts: DataFrame  # word, n: all exact counts
    bar: int  # counts from here on are in the broadcast table
    frequent: object  # broadcast: sorted word hashes, counts
    bits: int  # of the hash that choose a segment
    segments: DataFrame  # segment, entries, field: the filter
    filter: object  # broadcast Filter; None if it is too large
    weights: np.ndarray  # of the pair frequency, by level of the first token


def _pair_rows(texts: DataFrame, bits: int) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        for batch in batches:
            for _, _, words, at in each_step(batch.column(0)):
                waiting.append(pairs(*_tokens(words, at)))
            if sum(map(len, waiting)) >= FLUSH_TOKENS:
                yield _packed(*np.unique(np.concatenate(waiting), return_counts=True), bits)
                waiting.clear()
        if waiting:
            yield _packed(*np.unique(np.concatenate(waiting), return_counts=True), bits)

    return texts.mapInArrow(pack, "segment int, rest binary, n binary")


def _word_rows(counts: DataFrame, bits: int) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = mix(batch.column("word").to_numpy().view(np.uint64))
            order = np.argsort(grams)
            if len(order):
                yield _packed(grams[order], np.minimum(batch.column("n").to_numpy()[order], (1 << 32) - 1), bits)

    return counts.mapInArrow(pack, "segment int, rest binary, n binary")


def fit(docs: DataFrame, text: str = "text") -> Model:
    """Learn from every row of ``docs``; a NULL text counts as an empty one, which is an end alone."""
    model = counted(docs, text)
    return tuned(model, measure(docs.select(F.lit(0).alias("key"), F.col(text).alias("text")), model, "key", "text"))


def counted(docs: DataFrame, text: str = "text") -> Model:
    """A model with counts and filter, but without mixing weights."""
    spark = docs.sparkSession
    arrow_batches(spark)
    texts = docs.select(F.col(text).cast("string").alias("text"))
    counts = stored(_word_counts(texts), "word-counts")
    by_size = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("size")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).orderBy(F.desc("size")).collect()
    tokens, words = sum(r["n"] for r in by_size), sum(r["words"] for r in by_size)
    bar, held = 1 << 62, 0
    for r in by_size:
        held += r["words"]
        if held > MAX_FREQUENT:
            break
        bar = 1 << r["size"]
    frequent = counts.where(F.col("n") >= bar).toArrow()
    known, n = frequent.column("word").to_numpy().view(np.uint64), frequent.column("n").to_numpy()
    order = np.argsort(known)

    bits = max(0, min(20, (tokens // SEGMENT_TOKENS).bit_length()))
    rows = _pair_rows(texts, bits).unionByName(_word_rows(counts, bits))
    segments = stored(rows.groupBy("segment").applyInArrow(lambda group: _build(group, 1, bits), "segment int, entries long, field binary"), "filter")
    size = segments.agg(F.sum(F.length("field").cast("long"))).first()[0] or 0
    context = spark.sparkContext
    shared = context.broadcast(_whole(segments, bits)) if size * 8 <= MAX_FILTER_BITS else None
    return Model(tokens, words, counts, bar, context.broadcast((known[order], n[order])), bits, segments, shared, np.zeros(len(VALUES)))


def _whole(segments: DataFrame, bits: int) -> Filter:
    built = segments.toArrow()
    segment, fields = built.column("segment").to_numpy(), built.column("field")
    sizes = np.zeros(1 << bits, np.int64)
    sizes[segment] = [len(x.as_buffer()) for x in fields]
    starts = np.cumsum(sizes) - sizes
    field = np.zeros(int(sizes.sum()), np.uint8)
    for s, x in zip(segment, fields, strict=True):
        field[starts[s] : starts[s] + sizes[s]] = np.frombuffer(x.as_buffer(), np.uint8)
    return Filter(bits, sizes * 8 // _BLOCK_BITS, starts, field)


def _distinct(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct tokens, and each token's place among them."""
    coded = pa.array(tokens).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy()


Levels = Callable[[np.ndarray], np.ndarray]


def _token_levels(tokens: np.ndarray, at: np.ndarray, levels: Levels) -> tuple[np.ndarray, np.ndarray]:
    """Per token: its level, and that of it after its predecessor."""
    distinct, place = _distinct(tokens)
    own = levels(mix(distinct))[place]
    distinct, place = _distinct(pairs(tokens, at))
    return own, levels(distinct)[place]


def _levels_before(own: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Levels of the predecessors; a text begins after an end, which is its last token, too."""
    before = np.empty_like(own)
    before[1:] = own[:-1]
    before[at[:-1]] = own[at[1:] - 1]
    return before


def _probabilities(own: np.ndarray, before: np.ndarray, pair: np.ndarray, total: int, vocabulary: int, left_out: float | np.ndarray = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """From levels: smoothed frequency, and relative frequency after the predecessor."""
    single = (np.maximum(VALUES[own] - left_out, 0.0) + 1.0) / (total + vocabulary + 1.0)
    both = np.maximum(VALUES[pair] - left_out, 0.0)
    return single, both / np.maximum(np.maximum(VALUES[before] - left_out, both), 1.0)


def _asked(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Every n-gram that ``_token_levels`` looks up, sorted."""
    return np.unique(np.concatenate([pairs(tokens, at), mix(_distinct(tokens)[0])]))


def _each_step(rows: DataFrame, model: Model, work: Callable[[int, pa.Array, np.ndarray, np.ndarray, Levels], pa.RecordBatch], schema: str) -> DataFrame:
    """``work(number of the first row, keys, tokens, offsets, levels)`` on steps of ``rows``, which are a key and a text.

    With a broadcast filter that is one pass.  Otherwise each step sends its n-grams, once each and by segment, to the segments, where they
    meet the filter; the levels go back to the step's texts.
    """
    if model.filter is not None:
        shared = model.filter

        def at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number = TaskContext.get().partitionId() << 36
            for batch in batches:
                for row, end, words, at in each_step(batch.column(1)):
                    yield work(number, batch.column(0).slice(row, end - row), *_tokens(words, at), shared.value.levels)
                    number += end - row

        return rows.mapInArrow(at_once, schema)

    kind, bits = rows.schema[0].dataType.simpleString(), model.bits
    names = ["step", "number", "key", "text", "segment", "rest"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            for row, end, words, at in each_step(batch.column(1), ASK_BYTES):
                n, step, (keys, texts) = end - row, number, (c.slice(row, end - row) for c in batch.columns)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, step)), pa.array(number + np.arange(n)), keys, texts, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
                grams = _asked(*_tokens(words, at))
                packed = _packed(grams, np.zeros(len(grams), np.int64), bits)
                n = packed.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, step)), pa.nulls(n, pa.int64()), pa.nulls(n, keys.type), pa.nulls(n, texts.type), *packed.columns[:2]], names=names)
                number += end - row

    def answer(asked: pa.Table, built: pa.Table) -> pa.Table:
        rests = [np.frombuffer(x.as_buffer(), "<u4").astype(np.uint64) << np.uint64(32) for x in asked.column("rest")]
        sizes = np.cumsum([0, *map(len, rests)])
        levels = np.zeros(sizes[-1], np.uint8)
        if built.num_rows and len(rests):
            field = np.frombuffer(built.column("field")[0].as_buffer(), np.uint8)
            levels = Filter(0, np.array([len(field) * 8 // _BLOCK_BITS]), np.zeros(1, np.int64), field).levels(np.concatenate(rests)).astype(np.uint8)
        found = pa.array([levels[a:b].tobytes() for a, b in zip(sizes, sizes[1:], strict=False)], pa.binary())
        return pa.table({"step": asked.column("step"), "segment": asked.column("segment"), "levels": found})

    def finish(texts: pa.Table, answers: pa.Table) -> pa.Table:
        texts, answers = texts.sort_by("number").combine_chunks(), answers.sort_by("segment")
        found = np.frombuffer(b"".join(answers.column("levels").to_pylist()), np.uint8).astype(np.int64)
        keys, column = (pa.concat_arrays(texts.column(c).chunks) for c in ("key", "text"))
        ((_, _, words, at),) = each_step(column, 1 << 60)
        tokens, at = _tokens(words, at)
        grams = _asked(tokens, at)
        return pa.Table.from_batches([work(texts.column("step")[0].as_py(), keys, tokens, at, lambda wanted: found[np.searchsorted(grams, wanted)])])

    steps = stored(rows.mapInArrow(cut, f"step long, number long, key {kind}, text string, segment int, rest binary"), "lm-steps")
    asked = steps.where("segment IS NOT NULL").select("step", "segment", "rest")
    answers = asked.groupBy("segment").cogroup(model.segments.select("segment", "field").groupBy("segment")).applyInArrow(answer, "step long, segment int, levels binary")
    texts = steps.where("segment IS NULL").select("step", "number", "key", "text")
    return texts.groupBy("step").cogroup(answers.groupBy("step")).applyInArrow(finish, schema)


def measure(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", learned: Column | None = None) -> DataFrame:
    """What the model knows of every token of ``docs``, written once, so that tuning and scoring read it instead of the texts.

    Per row: ``row``, ``key`` (the key as ``of``, and whether the model ``learned`` from the row), ``n_tokens``, the levels of its tokens as bytes (``own``, and ``pair`` after the predecessor), and of the exact counts
    those of the frequent words (``n_known``, ``base``) and the words that must be looked up (``rare``).
    """
    arrow_batches(docs.sparkSession)
    known_row = F.lit(False) if learned is None else F.coalesce(learned, F.lit(False))
    rows = docs.select(F.struct(F.col(key).alias("of"), known_row.alias("learned")).alias("key"), F.col(text).cast("string").alias("text"))
    frequent = model.frequent

    def note(number: int, keys: pa.Array, tokens: np.ndarray, at: np.ndarray, levels: Levels) -> pa.RecordBatch:
        known, n = frequent.value
        logs = np.log10(n + 1.0)
        distinct, of = _distinct(tokens)
        order = np.argsort(distinct)
        place = np.zeros(len(distinct), np.int64)
        place[order] = np.minimum(np.searchsorted(known, distinct[order]), max(0, len(known) - 1))
        hit = known[place] == distinct if len(known) else np.zeros(len(distinct), bool)
        found, exact = hit[of], (np.where(hit, logs[place], 0.0) if len(known) else np.zeros(len(distinct)))[of]
        sums = [np.add.reduceat(x, at[:-1]) for x in (found.astype(np.int64), exact)]
        rest = np.concatenate([[0], np.cumsum(~found)])[at].astype(np.int32)
        offsets = pa.py_buffer(at.astype(np.int32))
        packed = [pa.Array.from_buffers(pa.binary(), len(keys), [None, offsets, pa.py_buffer(x.astype(np.uint8))]) for x in _token_levels(tokens, at, levels)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(number + np.arange(len(keys))), keys, pa.array(np.diff(at).astype(np.int64)), *map(pa.array, sums), *packed,
                pa.ListArray.from_arrays(pa.array(rest), pa.array(tokens[~found].view(np.int64))),
            ],
            names=["row", "key", "n_tokens", "n_known", "base", "own", "pair", "rare"],
        )

    kind = rows.schema["key"].dataType.simpleString()
    return stored(_each_step(rows, model, note, f"row long, key {kind}, n_tokens long, n_known long, base double, own binary, pair binary, rare array<long>"), "lm-levels")


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own levels, pair levels and row offsets of a batch of measured rows."""
    sides = []
    for name in ("own", "pair"):
        column = batch.column(name).cast(pa.large_binary())
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        sides.append(np.frombuffer(data, np.uint8)[at[0] : at[-1]].astype(np.int64))
    return *sides, at - at[0]


def tuned(model: Model, measured: DataFrame) -> Model:
    """``model`` with the mixing weights by level of the first token that give the measured rows, each token left out of its counts, the best score.

    Levels decide a token's score, so counts of their combinations are all that is summed.  A level that no token follows gets the weight of
    the nearest one, the lower of two.
    """
    n_levels = len(VALUES)

    def combinations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(waiting), return_counts=True)
            waiting.clear()
            return pa.RecordBatch.from_pydict({"levels": pa.array(found.astype(np.int64)), "n": pa.array(n.astype(np.int64))})

        for batch in batches:
            if batch.num_rows:
                own, both, at = _unpacked(batch)
                waiting.append(((_levels_before(own, at) * n_levels + own) * n_levels + both).astype(np.int32))
            if sum(map(len, waiting)) >= FLUSH_TOKENS:
                yield flush()
        if waiting:
            yield flush()

    rows = measured.select("own", "pair").mapInArrow(combinations, "levels long, n long")
    got = rows.groupBy("levels").agg(F.sum("n").alias("n")).orderBy("levels").toArrow()
    found, n = got.column("levels").to_numpy(), got.column("n").to_numpy()
    own, before, both = found // n_levels % n_levels, found // n_levels**2, found % n_levels
    seen = np.unique(before)
    weights = np.zeros(n_levels)
    if len(seen):
        single, pair = _probabilities(own, before, both, model.tokens, model.words, 1.0)
        sums = np.stack([np.bincount(before, n * np.log10(w * pair + (1.0 - w) * single), n_levels) for w in WEIGHTS], 1)
        nearest = seen[np.abs(np.arange(n_levels)[:, None] - seen).argmin(1)]
        weights = WEIGHTS[sums.argmax(1)][nearest]
    return replace(model, weights=weights)


def score_measured(measured: DataFrame, model: Model) -> DataFrame:
    """``key, n_tokens, n_known, base_score, score`` of measured rows.

    Rows that the model learned from are scored as if each token had occurred once less, so their scores compare with those of other rows: only
    what occurs elsewhere, too, counts for them.  ``base_score`` uses exact counts with one added: the words that are not in the bounded table of frequent ones are joined, and the corpus
    holds none of them often.
    """
    total, vocabulary, weights = model.tokens, model.words, model.weights
    schema = measured.select("row", "key", "n_tokens", "n_known", "base").withColumn("score", F.lit(0.0)).schema
    names = schema.names

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own, both, at = _unpacked(batch)
            before = _levels_before(own, at)
            learned = batch.column("key").field("learned").to_numpy(zero_copy_only=False)
            single, pair = _probabilities(own, before, both, total, vocabulary, np.repeat(learned.astype(float), np.diff(at)))
            weight = weights[before]
            logged = np.log10(weight * pair + (1.0 - weight) * single)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(np.add.reduceat(logged, at[:-1]))], names=names)

    scored = measured.select("row", "key", "n_tokens", "n_known", "base", "own", "pair").mapInArrow(add_up, schema)
    looked = measured.select("row", F.explode("rare").alias("word")).join(model.counts.where(F.col("n") < model.bar), "word")
    looked = looked.groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + F.lit(1.0))).alias("more_base"))
    base = F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(total + vocabulary + 1.0))
    return scored.join(looked, "row", "left").select(F.col("key.of").alias("key"), "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), base.alias("base_score"), "score")


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``key, n_tokens, n_known, base_score, score``.

    ``score`` is the model's log10 probability of the text.  Keys may be NULL or repeated; a NULL text has one token, its end; other columns are not read.
    """
    return score_measured(measure(docs, model, key, text), model)


def learn_and_score(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text") -> tuple[Model, DataFrame]:
    """A model of the rows where ``learn`` holds, and the scores of all rows, reading each text's n-grams once after the counts."""
    model = counted(docs.where(learn), text)
    measured = measure(docs, model, key, text, learn)
    model = tuned(model, measured.where("key.learned"))
    return model, score_measured(measured, model)
