"""How far the sources of a language differ, from an index of term counts that is built in a single pass over the texts.

1. Block postings: a task counts terms per (language, source) in memory until it holds as many postings as it may, then spills them as a
   run sorted by term.  Terms are told apart by their bytes, never by a hash.
2. Runs are dealt into shards by hash of term and group.  Each shard's sorted runs are merged (Spark's sort merges them from a heap) and equal
   postings that then lie next to each other are added up: the frequencies.
3. A term's smoothed share p in a group depends on its count alone, and most groups lack most terms.  A pair's divergence starts as if both
   sources lacked every term; the postings of both are streamed against each other and correct it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.common import arrow_batches, let_go, spans, steps, stored, string_bytes

#: Postings that a task holds before it spills a run, and distinct postings of a shard, about.
BLOCK_POSTINGS = 1_500_000
SHARD_POSTINGS = 2_000_000
#: A kept term occurs in so many documents of its language.
MIN_DOCUMENTS = 10
#: What 1 is as a whole number.
UNIT = 1_000_000_000
#: Best terms that are listed per group.
TOP_TERMS = 10
#: Sources of a language that one task sets against as many others, postings of the terms it takes at once, and pairs of postings of a step.
BLOCK_SOURCES = 128
CHUNK_POSTINGS = 200_000
STEP_PAIRS = 1 << 19

_POSTING = "lang string, source string, term string, n long, docs long"

# Terms are runs of ASCII letters and of all that is beyond ASCII; in UTF-8 the latter are the bytes from 0x80 on.
_OF_TERM = np.zeros(256, bool)
_OF_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Small numbers that are equal where values are; NULL is -1."""
    whole = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return whole.dictionary_encode().indices.fill_null(-1).to_numpy()


def _step_postings(data: np.ndarray, at: np.ndarray, groups: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of some texts, and per (group, term): both numbers, occurrences and documents."""
    low = _LOWERED[data]
    solid = _OF_TERM[low]
    starts, ends = spans(solid, at[:-1])
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    terms = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(low[solid])]).dictionary_encode()
    code, kinds = terms.indices.to_numpy().astype(np.int64), max(1, len(terms.dictionary))
    row = np.searchsorted(at, starts, "right") - 1
    pairs, times = np.unique(row * kinds + code, return_counts=True)
    keys = groups[pairs // kinds] * kinds + pairs % kinds
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    n = np.add.reduceat(times, first) if len(first) else times
    return terms.dictionary, keys[first] // kinds, keys[first] % kinds, n, np.diff(np.append(first, len(keys)))


class _Block:
    """Postings in memory: (group, term) with occurrences and documents."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.clear()

    def clear(self) -> None:
        self.terms: list[pa.Array] = []
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.known = self.size = 0

    def add(self, terms: pa.Array, group: np.ndarray, term: np.ndarray, n: np.ndarray, docs: np.ndarray) -> None:
        self.terms.append(terms)
        self.parts.append((group, term + self.known, n, docs))
        self.known += len(terms)
        self.size += len(group)

    def compact(self) -> None:
        """Add up equal postings."""
        coded = pa.concat_arrays(self.terms).dictionary_encode()
        group, term, n, docs = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        kinds = max(1, len(coded.dictionary))
        keys = group * kinds + coded.indices.to_numpy()[term]
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        sums = [np.add.reduceat(x[order], first) if len(first) else x for x in (n, docs)]
        self.clear()
        self.add(coded.dictionary, keys[first] // kinds, keys[first] % kinds, *sums)

    def spill(self) -> Iterator[pa.RecordBatch]:
        """The block as a run in order of terms, and an empty block."""
        self.compact()
        (terms,), ((group, term, n, docs),) = self.terms, self.parts
        rank = np.empty(len(terms), np.int64)
        rank[pc.sort_indices(terms).to_numpy()] = np.arange(len(terms))
        order = np.lexsort((group, rank[term]))
        names = list(self.groups)
        langs, sources = (pa.array([g[i] for g in names], pa.string()) for i in range(2))
        for first in range(0, len(order), 50_000):
            part = order[first : first + 50_000]
            of = pa.array(group[part])
            yield pa.RecordBatch.from_arrays([langs.take(of), sources.take(of), terms.take(pa.array(term[part])).cast(pa.string()), pa.array(n[part]), pa.array(docs[part])], names=["lang", "source", "term", "n", "docs"])
        self.clear()


def _runs(rows: DataFrame, most: int) -> DataFrame:
    """Runs of block postings, each sorted by term; ``rows`` are language, source and text without NULL."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        block = _Block()
        for batch in batches:
            names = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            groups = np.fromiter((block.groups.setdefault(g, len(block.groups)) for g in names), np.int64, batch.num_rows)
            data, at = string_bytes(batch.column(2))
            for row, end in steps(at):
                block.add(*_step_postings(data[at[row] : at[end]], at[row : end + 1] - at[row], groups[row:end]))
                if block.size >= most:
                    block.compact()
                    if block.size >= most // 2:
                        yield from block.spill()
        if block.size:
            yield from block.spill()

    return rows.mapInArrow(index, _POSTING)


def _merged(runs: DataFrame, shards: int) -> DataFrame:
    """Frequencies: shards of the runs in term order, equal neighbours added up batch by batch."""
    names = ["term", "lang", "source"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_rows: pa.Table | None = None  # the last posting, which may go on in the next batch
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if open_rows is None else pa.concat_tables([open_rows, rows])
            new = np.zeros(rows.num_rows, bool)
            new[:1] = True
            for name in names:
                code = _codes(rows.column(name))
                new[1:] |= code[1:] != code[:-1]
            starts = np.flatnonzero(new)
            if not len(starts):
                continue
            out = rows.take(pa.array(starts))
            for c in ("n", "docs"):
                out = out.set_column(out.schema.get_field_index(c), c, pa.array(np.add.reduceat(rows.column(c).to_numpy(), starts)))
            open_rows = out.slice(out.num_rows - 1)
            yield from out.slice(0, out.num_rows - 1).combine_chunks().to_batches()
        if open_rows is not None:
            yield from open_rows.combine_chunks().to_batches()

    return runs.repartition(shards, *names).sortWithinPartitions(*names).mapInArrow(add, _POSTING)


def frequencies(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", block: int = BLOCK_POSTINGS) -> DataFrame:
    """``lang, source, term, n, docs``: a term's occurrences in the group and the documents that hold it.

    NULL languages, sources and texts count as empty; A-Z are lower-cased; every row is a document; other columns are not read.  A task
    holds one block of postings and one batch of texts.
    """
    arrow_batches(docs.sparkSession)
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))))
    runs = stored(_runs(rows, block), "divergence-runs")
    return _merged(runs, max(1, -(-runs.count() // SHARD_POSTINGS)))


def _share(count: Column | str, total: str, terms: str) -> Column:
    """The smoothed share as a whole number; products exceed 64 bits, so they are decimals."""
    return F.expr(f"1 + cast({UNIT} * cast({count} + 2 AS decimal(20, 0)) AS decimal(38, 0)) div cast({total} + 2 * {terms} AS decimal(20, 0))")


def _differ(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _corrections(group: pa.Table) -> pa.Table:
    """What the postings of some terms change in the divergence of the sources of two blocks.

    Rows without a term are the sources themselves with the share p of a term that they lack.  For a term that only one source has,
    its own p meets the other's share of a lacking term; that depends on counts alone, so equal ones are taken together.  Where both have the
    term, what both sides have been given is taken back and the real divergence added.
    """
    side, number, p = (group.column(c).to_numpy() for c in ("side", "number", "p"))
    code = _codes(group.column("term"))
    here = code >= 0
    whole = bool(group.column("block_a")[0].as_py() == group.column("block_b")[0].as_py())
    sides = (0, 0) if whole else (0, 1)
    lacking, names, rows = [], [], []
    for s in sides:
        own = np.flatnonzero(~here & (side == s))
        own = own[np.argsort(number[own])]
        names.append(number[own])
        lacking.append(p[own])
        at = np.flatnonzero(here & (side == s))
        rows.append(at[np.argsort(code[at], kind="stable")])
    none = _differ(lacking[0][:, None], lacking[1][None, :])
    total = np.zeros_like(none)
    index = [np.searchsorted(names[s], number[rows[s]]) for s in range(2)]
    for s in range(2):
        # One source has the term: p against all sources of the other side.
        kinds, times = np.unique(np.stack([index[s], p[rows[s]]]), axis=1, return_counts=True)
        for first in range(0, kinds.shape[1], 4096):
            own, share = kinds[:, first : first + 4096]
            change = _differ(share[:, None], lacking[1 - s][None, :]) - (none[own] if s == 0 else none.T[own])
            np.add.at(total if s == 0 else total.T, own, change * times[first : first + 4096, None])
    # Both have it.
    other = code[rows[1]]
    low, high = np.searchsorted(other, code[rows[0]], "left"), np.searchsorted(other, code[rows[0]], "right")
    ends = np.cumsum(high - low)
    first = 0
    while first < len(ends):
        stop = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + STEP_PAIRS, "right")))
        counts = (high - low)[first:stop]
        a = np.repeat(np.arange(first, stop), counts)
        b = np.repeat(low[first:stop] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        own, theirs, x, y = p[rows[0][a]], p[rows[1][b]], index[0][a], index[1][b]
        change = _differ(own, theirs) - _differ(own, lacking[1][y]) - _differ(lacking[0][x], theirs) + none[x, y]
        np.add.at(total, (x, y), change)
        first = stop
    a, b = np.nonzero(names[0][:, None] < names[1][None, :])
    lang = pa.array([group.column("lang")[0].as_py()] * len(a), pa.string())
    return pa.table({"lang": lang, "a": pa.array(names[0][a]), "b": pa.array(names[1][b]), "change": pa.array(total[a, b])})


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_documents: int = MIN_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every (language, source) that occurs.

    A language keeps the terms of at least ``min_documents`` of its documents.  In a group of N kept occurrences a kept term with c of them has
    the share p = 1 + floor(10^9 (c + 2) / (N + 2 V)), and the divergence of shares p and q is floor((p - q)^2 / (p + q)).  Part ``pair``
    ranks all other sources of the language by the sum over all kept terms; part ``term`` ranks the group's ``top`` terms with p above the share q in
    the whole language.  Equal values are ranked by item.  NULL languages, sources and texts count as empty; rows repeat as they are; a
    group without terms has pairs only, a single source of a language no pairs; an empty table gives no rows.
    """
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source")))).distinct()
    found = stored(frequencies(docs, lang, source, text), "divergence-frequencies")
    kept = found.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_documents)
    kept = stored(kept.select("lang", "term", "all_n"), "divergence-terms")
    langs = stored(kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all_n").alias("all_total")), "divergence-langs")
    postings = stored(found.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "divergence-postings")
    totals = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("held"))
    numbered = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    numbered = numbered.select("lang", "source", number.cast("long").alias("number"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "held", "terms", "all_total")))
    sources = stored(numbered.withColumn("block", F.floor(F.col("number") / BLOCK_SOURCES)), "divergence-sources")
    lacking = F.when(F.col("terms") > 0, _share("0", "total", "terms")).otherwise(1)

    shared = postings.join(sources.select("lang", "source", "number", "block", "total", "terms", "all_total"), ["lang", "source"])
    shared = shared.select("lang", "source", "number", "block", "term", _share("n", "total", "terms").alias("p"), _share("all_n", "all_total", "terms").alias("q"))
    value = F.expr("(p - q) * (p - q) div (p + q)")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    above = shared.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value.alias("value"))
    best = above.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)

    # Every pair of blocks of sources, each with chunks of the terms; a chunk's size follows from the postings of both blocks.
    blocks = sources.groupBy("lang", "block").agg(F.sum("held").alias("held"))
    left, right = (blocks.select("lang", F.col("block").alias(f"block_{s}"), F.col("held").alias(f"held_{s}")) for s in "ab")
    pairs = left.join(right, "lang").where("block_a <= block_b")
    pairs = stored(pairs.select("lang", "block_a", "block_b", F.greatest(F.lit(1), F.ceil((F.col("held_a") + F.col("held_b")) / CHUNK_POSTINGS)).alias("chunks")), "divergence-blocks")
    sides = pairs.select("*", F.col("block_a").alias("block"), F.lit(0).alias("side")).unionByName(pairs.where("block_a < block_b").select("*", F.col("block_b").alias("block"), F.lit(1).alias("side")))
    columns = ["lang", "block_a", "block_b", "chunk", "side", "number", "term", "p"]
    chunk = F.pmod(F.xxhash64("term"), F.col("chunks"))
    theirs = shared.join(sides, ["lang", "block"]).withColumn("chunk", chunk).select(columns)
    heads = sources.select("lang", "block", "number", lacking.alias("p")).join(sides, ["lang", "block"])
    heads = heads.withColumn("chunk", F.explode(F.expr("sequence(0L, chunks - 1)"))).withColumn("term", F.lit(None).cast("string")).select(columns)
    dealt = theirs.unionByName(heads).groupBy("lang", "block_a", "block_b", "chunk")
    changes = dealt.applyInArrow(_corrections, "lang string, a long, b long, change long").groupBy("lang", "a", "b").agg(F.sum("change").alias("change"))
    changes = stored(changes, "divergence-pairs")
    ends = sources.select("lang", "source", "number", lacking.alias("p"), "terms")
    pair = changes.join(ends.select("lang", F.col("number").alias("a"), F.col("source").alias("source_a"), "p", "terms"), ["lang", "a"])
    pair = pair.join(ends.select("lang", F.col("number").alias("b"), F.col("source").alias("source_b"), F.col("p").alias("q")), ["lang", "b"])
    pair = pair.select("lang", "source_a", "source_b", (F.col("change") + F.col("terms") * value).alias("value"))
    both = pair.select("lang", F.col("source_a").alias("source"), F.lit("pair").alias("part"), F.col("source_b").alias("item"), "value")
    both = both.unionByName(pair.select("lang", F.col("source_b").alias("source"), F.lit("pair").alias("part"), F.col("source_a").alias("item"), "value"))
    ranked = both.withColumn("rank", F.row_number().over(by_value))
    return ranked.unionByName(best).select("lang", "source", "part", "item", "value", "rank")
