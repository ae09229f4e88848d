"""Exact Jaccard self-join on word n-grams with a token-group matrix.

1. Texts become sets of shingle hashes; equal sets are one from here on.
2. Candidates: in a class of set sizes two sets that link differ in at most k tokens, so of k + 1 or more ranges of the token space at least
   one holds the same tokens in both.  A set's signatures are the hashes of its ranges, and sets that share one meet in a bucket.
   Very common tokens are left out of the ranges: what is left of two linked sets differs by no more than the sets do, and a common line
   makes no buckets.  Sets that consist of common tokens, such as those of a large group of copies, are listed with them, too.
3. Each bucket's most central set is its leader; members are compared with their leaders only, which connects a group of copies in linear work.
   A sketch of parities, in which common tokens cancel out, bounds how much two sets differ, so that only texts of likely pairs are moved.
4. Buckets that still hold several components need more.  Their sets are partitioned into groups of similar ones (by leader, in chunks); a
   group's matrix lists the members of each token.  For a pair of groups that share such a bucket, a set's overlap with the other group's token
   union bounds its similarity with every member, and only groups that qualify are opened and compared exactly.  Of two groups only the sets
   that share such a bucket with a set of the other one, and may link with it by the sketches, are listed.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.common import arrow_batches, each_step, mix, releasing, stored
from skyledger.llm.components import components

GROUP_ROWS = 256
#: Members of buckets that are compared by their sketches at once.
UNIT_ROWS = 2048
SKETCH_BITS = 1024
#: Tokens that so many sampled documents hold are common; so many are told apart at most.  The share of documents sampled doesn't shrink as
#: they grow in number: a passage is common from about 50 documents on at any size, so those that meet pairwise are no more in a larger table.
COMMON_COUNT = 4
COMMON_SHARE = 0.08
MAX_COMMON = 1 << 18
#: The texts that are needed are first picked by so many hash values of their keys: a broadcast of at most that many numbers.
PICK_BUCKETS = 1 << 20
_GROWTH = 1.4
_FACTORS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the word ``n``-grams; of a shorter text, one hash of all its words; of no words, none."""
    size = len(words)
    if not size:
        return np.zeros(0, np.uint64)
    width = min(n, size)
    sums = np.full(size - width + 1, width, np.uint64)
    for i in range(width):
        sums += words[i : size - width + 1 + i] * _FACTORS[i]
    return np.unique(mix(sums))


class Classes:
    """Size classes for a threshold of ``num`` / ``den``, with the number of ranges that finds every linked pair."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        self.tops = [-(-num // (den - num))]  # different sets of at most this size can't link

    def top(self, c: int) -> int:
        while len(self.tops) <= c:
            self.tops.append(int(self.tops[-1] * _GROWTH) + 1)
        return self.tops[c]

    def of(self, size: int) -> list[int]:
        """The class of a set, and all further ones that a larger partner may be in."""
        while self.top(len(self.tops) - 1) * self.num < size * self.den:
            self.top(len(self.tops))
        c = bisect.bisect_left(self.tops, size)
        out = [c] if c else []
        while size * self.den >= self.num * (self.top(c) + 1):
            c += 1
            out.append(c)
        return out

    def ranges(self, c: int) -> tuple[int, int]:
        """Ranges of class ``c``, and how many of them may be empty without being listed.

        With e more ranges than needed, linked sets agree on at least 1 + e; if one of them has at most e empty ranges, they agree on one that
        holds tokens.  Only sets with more empty ranges, which are rare, list those, too.
        """
        least = 2 * self.top(c) * (self.den - self.num) // (self.den + self.num) + 1
        empty = least * math.exp(-(self.top(c - 1) + 1) / least)
        spare = int(empty + 4 * math.sqrt(empty)) + 1
        return least + spare, spare


def _range_codes(tokens: np.ndarray, c: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The code of each range of a class, and whether it holds tokens."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens ^ np.uint64(0x5BD1E9955BD1E995)), dtype=np.uint64)])
    edges = ((np.arange(1, count, dtype=np.uint64) << np.uint64(32)) // np.uint64(count)) << np.uint64(32)
    at = np.concatenate([[0], np.searchsorted(tokens, edges), [len(tokens)]])
    return mix((sums[at[1:]] - sums[at[:-1]]) ^ mix(np.arange(count, dtype=np.uint64) + (np.uint64(c) << np.uint64(40)))), at[1:] > at[:-1]


def signatures(tokens: np.ndarray, classes: Classes, common: np.ndarray) -> np.ndarray:
    """Codes of the ranges without ``common`` tokens (sorted hashes).

    Linked sets agree on 1 + spare ranges at least.  If one of them has at most ``spare`` ranges without such tokens, they agree on one that
    holds some.  If both have more, they are listed with all their tokens as well, by the same rule.
    """
    out = []
    rare = tokens
    if len(common):
        rare = tokens[common[np.minimum(np.searchsorted(common, tokens), len(common) - 1)] != tokens]
    for c in classes.of(len(tokens)):
        count, spare = classes.ranges(c)
        code, held = _range_codes(rare, c, count)
        out.append(code[held])
        if (~held).sum() > spare:
            code, held = _range_codes(tokens, c, count)
            code = mix(code + np.uint64(1))
            out.append(code if (~held).sum() > spare else code[held])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def common_tokens(texts: DataFrame, n: int, documents: int) -> np.ndarray:
    """Hashes of shingles that many documents hold, at most ``MAX_COMMON``, from ``COMMON_SHARE`` of the documents (4,000 at least) by hash.

    Which tokens are in it changes the work, never the result.
    """
    share = min(1.0, max(4000.0, documents * COMMON_SHARE) / max(1, documents))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, words, at in each_step(batch.column(0), 1 << 22):
                sets = [shingle_set(words[a:b], n) for a, b in zip(at, at[1:], strict=False)]
                found, times = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_pydict({"token": pa.array(found.view(np.int64)), "n": pa.array(times.astype(np.int64))})

    chosen = texts.where(F.pmod(F.xxhash64("key", F.lit("common")), F.lit(1 << 30)) < int(share * (1 << 30))).select("text")
    counted = chosen.mapInArrow(releasing(count), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON_COUNT)
    top = counted.groupBy(F.floor(F.log2("n")).alias("size")).count().orderBy(F.desc("size")).collect()
    bar, held = 1 << 62, 0
    for size, times in top:
        held += times
        if held > MAX_COMMON:
            break
        bar = 1 << size
    tokens = counted.where(F.col("n") >= max(bar, COMMON_COUNT)).select("token").toArrow().column("token").to_numpy()
    return np.sort(tokens.view(np.uint64))


def parities(tokens: np.ndarray) -> np.ndarray:
    """Whether each part of the token space holds an odd number of tokens, as 64-bit numbers; a large set has more parts.

    The sketches of two sets differ in at most as many bits as the sets differ in tokens.  Parts are numbered by the low bits of a
    hash, so the exclusive or of a sketch's halves is the sketch with half as many parts.
    """
    bits = SKETCH_BITS << max(0, (2 * len(tokens) // SKETCH_BITS).bit_length() - 1)
    odd = np.bincount((mix(tokens) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _folded(sketch: Column, other: Column) -> Column:
    """A sketch as short as the other one; sizes of sets that may link differ by less than two, so one fold is enough."""
    half = F.size(other)
    halves = F.zip_with(F.slice(sketch, F.lit(1), half), F.slice(sketch, half + 1, half), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(sketch) > half, halves).otherwise(sketch)


def _described(docs: DataFrame, n: int) -> DataFrame:
    """Size of the shingle set, two digests that name it, and its sketch."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, words, at in each_step(batch.column(1)):
                sets = [shingle_set(words[a:b], n) for a, b in zip(at, at[1:], strict=False)]
                marks = [[mix(s + np.uint64(k)).sum(dtype=np.uint64) for s in sets] for k in (1, 2)]
                marked = [parities(s) for s in sets]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in marked])]).astype(np.int32)
                columns = [batch.column(0).slice(row, end - row), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(np.array(m, np.uint64).view(np.int64)) for m in marks)]
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(marked))))
                yield pa.RecordBatch.from_arrays(columns, names=["key", "n", "mark_a", "mark_b", "sketch"])

    return docs.mapInArrow(releasing(describe), "key long, n long, mark_a long, mark_b long, sketch array<long>")


def _coded(docs: DataFrame, n: int, num: int, den: int, common: np.ndarray) -> DataFrame:
    """Digests and signatures of the sets that have any."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = Classes(num, den)
        for batch in batches:
            for row, end, words, at in each_step(batch.column(1)):
                sets = [shingle_set(words[a:b], n) for a, b in zip(at, at[1:], strict=False)]
                marks = [[mix(s + np.uint64(k)).sum(dtype=np.uint64) for s in sets] for k in (1, 2)]
                codes = [signatures(s, classes, shared.value) for s in sets]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in codes])]).astype(np.int32)
                columns = [batch.column(0).slice(row, end - row), *(pa.array(np.array(m, np.uint64).view(np.int64)) for m in marks)]
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(codes).view(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, names=["key", "mark_a", "mark_b", "codes"])

    return docs.mapInArrow(releasing(code), "key long, mark_a long, mark_b long, codes array<long>").where(F.size("codes") > 0)


def _matrix_links(x: list[np.ndarray], y: list[np.ndarray], comp_x: np.ndarray, comp_y: np.ndarray, num: int, den: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each set of ``x``, the members of group ``y`` in other components that it links with."""
    sizes = np.array([len(s) for s in y])
    tokens, member = np.concatenate(y), np.repeat(np.arange(len(y)), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, member = tokens[order], member[order]
    for i, s in enumerate(x):
        low, high = np.searchsorted(tokens, s, "left"), np.searchsorted(tokens, s, "right")
        union_overlap = int((high > low).sum())
        if union_overlap * den < num * len(s):  # no member can share enough of this set
            continue
        counts = high - low
        rows = np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        shared = np.bincount(member[rows], minlength=len(y))
        linked = (den * shared >= num * (len(s) + sizes - shared)) & (comp_y != comp_x[i])
        if linked.any():
            yield i, np.flatnonzero(linked)


def _compared(rows: DataFrame, by: list[str], n: int, num: int, den: int) -> DataFrame:
    """Links ``a, b`` between the two sides of every task; a task without a second side is compared with itself."""

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids, comp = group.column("key").to_numpy(), group.column("comp").to_numpy()
        first = group.column("first").to_numpy(zero_copy_only=False)
        sets = [shingle_set(words[p:q], n) for c in group.column("text").chunks for _, _, words, at in each_step(c) for p, q in zip(at, at[1:], strict=False)]
        a = np.flatnonzero(first)
        b = a if first.all() else np.flatnonzero(~first)
        found: list[tuple[int, int]] = []
        if len(a) and len(b):
            for i, linked in _matrix_links([sets[j] for j in a], [sets[j] for j in b], comp[a], comp[b], num, den):
                # One link for each other component connects as well as all of them.
                other = b[linked]
                found += [(ids[a[i]], ids[j]) for j in other[np.unique(comp[other], return_index=True)[1]]]
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return rows.select(*by, "first", "key", "comp", "text").groupBy(*by).applyInArrow(compare, "a long, b long")


def _met(members: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Sets with the groups of those sets of other components in their buckets that they may link with by the sketches.

    ``members`` has ``code, key`` of each bucket with its ``size``, ``leader`` and the leader's number of ``units``; ``sets`` has the keys' sets.
    A bucket is compared in memory, one of more than ``GROUP_ROWS`` sets in pairs of blocks of about that many, and a pair that the sketches
    rule out makes no row.  Buckets with the same leader have many sets in common and meet in units of about ``UNIT_ROWS`` members, so that
    a set's sketch is moved once a unit, not once a bucket.
    """
    blocks = F.ceil(F.col("size") / GROUP_ROWS).cast("long")
    dealt = members.repartition("key").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("leader", "units", "key", F.struct("code", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "block").alias("at"))
    at = ["leader", "unit"]
    placed = dealt.withColumn("unit", F.pmod(F.xxhash64("at.code", "at.low", "at.high"), F.col("units")))
    once = placed.groupBy(*at, "key").agg(F.collect_list("at").alias("at")).join(sets, "key")
    once = once.select(*at, "at", "key", "comp", "n", "group.home", "group.chunk", "sketch").repartition(*at).sortWithinPartitions(*at)
    out = "key long, comp long, group struct<home: long, chunk: long>, other struct<home: long, chunk: long>"

    def compare(found: pa.Table) -> pa.RecordBatch:
        """All units of some rows, each whole."""
        found = found.combine_chunks()
        comp, sizes = found.column("comp").to_numpy(), found.column("n").to_numpy()
        group = np.unique(np.stack([found.column(c).to_numpy() for c in ("home", "chunk")]), axis=1, return_inverse=True)[1].reshape(-1)
        sketch, lists = found.column("sketch").combine_chunks(), found.column("at").combine_chunks()
        parts, offsets = sketch.values.to_numpy(), sketch.offsets.to_numpy()
        code, low, high, block = (lists.flatten().field(c).to_numpy() for c in ("code", "low", "high", "block"))
        row = np.repeat(np.arange(len(found)), np.diff(lists.offsets.to_numpy()))
        order = np.lexsort((row, high, low, code))
        row, block, place = row[order], block[order], np.stack([code, low, high])[:, order]
        edges = np.flatnonzero(np.concatenate([[True], (place[:, 1:] != place[:, :-1]).any(0), [True]]))
        pairs = []
        for p, q in zip(edges, edges[1:], strict=False):
            at, c = row[p:q], comp[row[p:q]]
            if (c == c[0]).all():
                continue
            n, width = sizes[at], (offsets[at + 1] - offsets[at]).min()
            folded = np.stack([np.bitwise_xor.reduce(parts[offsets[i] : offsets[i + 1]].reshape(-1, width), axis=0) for i in at])
            bits = np.unpackbits(folded.view(np.uint8), axis=1).astype(np.float32)
            a = np.flatnonzero(block[p:q] == place[1, p])
            b = a if place[1, p] == place[2, p] else np.flatnonzero(block[p:q] != place[1, p])
            weight, m, k = bits.sum(1), n[a][:, None], n[b][None, :]
            differing = weight[a][:, None] + weight[b][None, :] - 2 * (bits[a] @ bits[b].T)
            near = (differing * (den + num) <= (m + k) * (den - num)) & (m * den >= k * num) & (k * den >= m * num) & (c[a][:, None] != c[b][None, :])
            i, j = np.nonzero(near)
            i, j = at[a[i]], at[b[j]]
            pairs += [np.stack([i, group[j], j]), np.stack([j, group[i], i])]
        # One row for a set and each group it meets.
        pair = np.concatenate([np.zeros((3, 0), np.int64), *pairs], axis=1)
        i, _, j = pair[:, np.unique(pair[0] * len(found) + pair[1], return_index=True)[1]]
        names = ["home", "chunk"]
        sides = [pa.StructArray.from_arrays([pa.array(found.column(c).to_numpy()[x]) for c in names], names) for x in (i, j)]
        return pa.RecordBatch.from_arrays([*(pa.array(found.column(c).to_numpy()[i]) for c in ("key", "comp")), *sides], names=["key", "comp", "group", "other"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            found = pa.Table.from_batches([batch])
            if held is not None:
                found = pa.concat_tables([held, found])
            # The last unit may go on in the next batch.
            place = np.stack([found.column(c).to_numpy() for c in ("leader", "unit")])
            start = int(np.flatnonzero((place != place[:, -1:]).any(0)).max(initial=-1)) + 1
            held = found.slice(start)
            if start:
                yield compare(found.slice(0, start))
        if held is not None:
            yield compare(held)

    return once.mapInArrow(releasing(meet), out).distinct()


def _admitted(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Of each pair of groups, the sets that some set of another component on the other side may link with by the sketches."""
    out = "group_a struct<home: long, chunk: long>, group_b struct<home: long, chunk: long>, first boolean, key long"

    def admit(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        first = group.column("first").to_numpy(zero_copy_only=False)
        comp, sizes = group.column("comp").to_numpy(), group.column("n").to_numpy()
        sketches = [np.asarray(x) for x in group.column("sketch").to_numpy()]
        width = min(len(x) for x in sketches)
        folded = np.stack([np.bitwise_xor.reduce(x.reshape(-1, width), axis=0) for x in sketches])
        bits = np.unpackbits(folded.view(np.uint8), axis=1).astype(np.float32)
        a = np.flatnonzero(first)
        b = a if first.all() else np.flatnonzero(~first)
        weight = bits.sum(1)
        differing = weight[a][:, None] + weight[b][None, :] - 2 * (bits[a] @ bits[b].T)
        near = (differing * (den + num) <= (sizes[a][:, None] + sizes[b][None, :]) * (den - num)) & (comp[a][:, None] != comp[b][None, :])
        rows = np.concatenate([a[near.any(1)], b[near.any(0)]]) if b is not a else a[near.any(1)]
        return group.select(["group_a", "group_b", "first", "key"]).take(pa.array(rows))

    return rows.select("group_a", "group_b", "first", "key", "comp", "n", "sketch").groupBy("group_a", "group_b").applyInArrow(admit, out)


def _with_texts(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """``asked`` with the texts of its keys; a key with several texts brings them all.

    A bounded broadcast of hash values keeps most other texts out of the shuffle.
    """
    bucket = F.pmod(F.xxhash64("key"), F.lit(PICK_BUCKETS)).alias("bucket")
    picked = F.broadcast(asked.select(bucket).distinct())
    few = texts.where("key IS NOT NULL").select("*", bucket).join(picked, "bucket", "left_semi").drop("bucket")
    return asked.join(few.hint("merge"), "key")


def join_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """One row per key: ``key, n_shingles, component``, the smallest key reachable by links.

    A-Z are lower-cased, words are runs of bytes other than ASCII white space; two documents link when ``den`` * intersection >= ``num`` *
    union of their shingle sets, for a threshold of one half at least.  The result is exact: no bucket is capped, and a large one is compared in blocks.  Texts without words, and
    NULL texts, have empty sets and link with nothing.  Keys are integers.  Rows with one key are one document that links when any of their
    texts does, and shows the size of the largest set.  A NULL key gets one row without a component.
    """
    if 2 * num < den:
        raise ValueError("the threshold must be one half at least")
    arrow_batches(docs.sparkSession)
    texts = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    base = stored(_described(texts, n), "jaccard-sets")
    sets = base.where("n > 0 AND key IS NOT NULL")
    same = ["mark_a", "mark_b"]
    reps = sets.groupBy(*same).agg(F.min("key").alias("rep"))
    copies = sets.select("key", *same).join(reps, same).where("key <> rep").select(F.col("key").alias("a"), F.col("rep").alias("b"))
    # Equal sets have equal codes, so any row's stand for the group.
    common = common_tokens(texts.where("key IS NOT NULL"), n, base.count())
    coded = _coded(texts.where("key IS NOT NULL"), n, num, den, common).groupBy(*same).agg(F.min("key").alias("key"), F.any_value("codes").alias("codes"))
    # One pass over the dealt codes keeps those of two sets or more; a set lists a code once.
    dealt = coded.select("key", F.explode("codes").alias("code")).where("code IS NOT NULL")
    shared = stored(dealt.withColumn("size", F.count("key").over(Window.partitionBy("code"))).where("size > 1").select("code", "key", "size"), "jaccard-buckets")

    # The leader of a bucket shares most buckets with most others.
    central = shared.groupBy("key").agg(F.sum("size").alias("weight"))
    ranked = shared.select("code", "key").join(central, "key").select("code", "key", F.struct("weight", (-F.col("key")).alias("key")).alias("rank"))
    leaders = stored(ranked.groupBy("code").agg(F.max("rank").alias("top")).select("code", (-F.col("top.key")).alias("leader"), F.col("top.weight").alias("lead")), "jaccard-leaders")
    led = shared.select("code", "key").join(leaders, "code")
    stars = stored(led.groupBy("key", "leader").agg(F.max("lead").alias("lead")), "jaccard-stars")
    sketches = sets.select("key", "n", "sketch")
    followed = stars.where("key <> leader").select("key", "leader").join(sketches, "key").join(sketches.select(F.col("key").alias("leader"), F.col("n").alias("m"), F.col("sketch").alias("other")), "leader")
    followed = followed.where((F.col("n") * den >= F.col("m") * num) & (F.col("m") * den >= F.col("n") * num))
    followed = followed.select("key", "leader", "n", "m", _folded(F.col("sketch"), F.col("other")).alias("sketch"), _folded(F.col("other"), F.col("sketch")).alias("other"))
    differing = F.aggregate(F.zip_with("sketch", "other", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    likely = stored(followed.where(differing * (den + num) <= (F.col("n") + F.col("m")) * (den - num)).select("key", "leader").distinct(), "jaccard-likely")
    blocks = likely.groupBy("leader").agg(F.ceil(F.count("*") / GROUP_ROWS).alias("blocks"))
    followers = likely.join(blocks, "leader").select("leader", F.pmod(F.xxhash64("key"), F.col("blocks")).alias("block"), "key", F.lit(True).alias("first"))
    heads = blocks.select("leader", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("leader").alias("key"), F.lit(False).alias("first"))
    asked = followers.unionByName(heads).withColumn("comp", F.col("key"))
    links = stored(_compared(_with_texts(asked, texts), ["leader", "block"], n, num, den), "jaccard-links")

    # Buckets whose members are still in several components.
    joined = components(links, "a", "b").withColumnRenamed("node", "key")
    home = stars.groupBy("key").agg(F.max(F.struct("lead", (-F.col("leader")).alias("leader"))).alias("h")).select("key", (-F.col("h.leader")).alias("home"))
    sizes = home.groupBy("home").agg(F.ceil(F.count("*") / GROUP_ROWS).alias("chunks"))
    grouped = home.join(sizes, "home").join(joined, "key", "left").select("key", F.coalesce("component", "key").alias("comp"), F.struct("home", F.pmod(F.xxhash64("key"), F.col("chunks")).alias("chunk")).alias("group"))
    grouped = stored(grouped, "jaccard-groups")
    placed = shared.select("code", "key").join(grouped, "key").groupBy("code", "group").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    placed = stored(placed, "jaccard-placed")
    mixed = placed.groupBy("code").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("code")
    # Buckets with the same members say the same, so one of them is enough.
    met = shared.select("code", "key").join(mixed, "code")
    hashes = [F.xxhash64("key"), F.xxhash64("key", F.lit("other"))]
    parts = [part for h in hashes for part in (F.shiftrightunsigned(h, 32), h.bitwiseAND(0xFFFFFFFF))]  # sums of 32 bits don't overflow
    digest = met.groupBy("code").agg(F.count("*").alias("size"), *[F.sum(part).alias(f"sum_{i}") for i, part in enumerate(parts)])
    once = digest.groupBy(*[c for c in digest.columns if c != "code"]).agg(F.min("code").alias("code")).select("code", "size")
    once = once.join(leaders.select("code", "leader"), "code")
    units = once.groupBy("leader").agg(F.ceil(F.sum(F.col("size") * F.ceil(F.col("size") / GROUP_ROWS)) / UNIT_ROWS).cast("long").alias("units"))
    members = stored(met.join(once.join(units, "leader"), "code"), "jaccard-members")
    asks = _met(members, grouped.join(sketches, "key"), num, den)
    first = F.col("group") <= F.col("other")
    listed = asks.select(
        F.when(first, F.col("group")).otherwise(F.col("other")).alias("group_a"), F.when(first, F.col("other")).otherwise(F.col("group")).alias("group_b"), first.alias("first"), "key", "comp"
    )
    admitted = stored(_admitted(listed.join(sketches, "key"), num, den), "jaccard-admitted")
    asked = admitted.select("group_a", "group_b", "first", "key").distinct().join(grouped.select("key", "comp"), "key")
    more = stored(_compared(_with_texts(asked, texts), ["group_a", "group_b"], n, num, den), "jaccard-more-links")
    groups = components(copies.unionByName(links).unionByName(more), "a", "b")
    out = base.groupBy("key").agg(F.max("n").alias("n_shingles"))
    return out.join(groups.withColumnRenamed("node", "key"), "key", "left").select("key", "n_shingles", F.coalesce("component", "key").alias("component"))
