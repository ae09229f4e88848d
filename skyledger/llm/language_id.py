"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.llm.common import arrow_batches, let_go, releasing, stored

#: The matrix has at most so many cells, 64 MB; with very many languages it gets fewer buckets.
MAX_CELLS = 1 << 24
MAX_BUCKETS = 1 << 15
NGRAMS = (1, 2, 3)
UNKNOWN = "und"

#: A text with a smaller share of letters among its signs is no language; short ones may have fewer.
LEAST_LETTERS = 0.25

_LETTER = re.compile(r"[^\W\d_]")
_LETTERS = re.compile(r"[^\W\d_]+")
_SPACES = re.compile(r"\s+")
_STEP_CHARS = 1 << 20


@dataclass(frozen=True)
class Model:
    languages: list[str]
    prior: np.ndarray  # log, by language
    weights: np.ndarray  # log, by bucket and language
    bars: np.ndarray  # by language: least mean log-likelihood per n-gram, and its scatter per n-gram

    @property
    def buckets(self) -> int:
        return self.weights.shape[0]


def bucket_counts(texts: list[str], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text, the buckets its n-grams fall into and how many fall there.

    Letters are lower-cased and everything else counts as a space; n-grams of spaces alone are left out, so junk signs carry no evidence.
    """
    let_go()
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    lowered = [t.lower() for t in texts]
    row = 0
    while row < len(lowered):
        end, size = row, 0
        while end < len(lowered) and (end == row or size + len(lowered[end]) <= _STEP_CHARS):
            size += len(lowered[end])
            end += 1
        points = np.frombuffer("".join(lowered[row:end]).encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = ((points >= 97) & (points <= 122)) | ((points >= 0xC0) & (points != 0xD7) & (points != 0xF7) & ~((points >= 0x2000) & (points < 0x2C00)) & ~((points >= 0x3000) & (points < 0x3040)))
        points = np.where(letters, points, np.uint32(32))
        hashed, rolling, filled = [], np.zeros(len(points), np.uint32), np.zeros(len(points), bool)
        for n in range(1, max(NGRAMS) + 1):
            rolling = rolling[: max(0, len(points) - n + 1)] * np.uint32(0x01000193) + points[n - 1 :] * np.uint32(0x85EBCA6B) + np.uint32(n)
            filled = filled[: len(rolling)] | letters[n - 1 :]
            if n in NGRAMS:
                x = (rolling ^ (rolling >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                hashed.append((n, ((x ^ (x >> np.uint32(12))) * np.uint32(0x297A2D39)) >> shift, filled))
        at = 0
        for text in lowered[row:end]:
            stop = at + len(text)
            parts = [h[at : max(at, stop - n + 1)][f[at : max(at, stop - n + 1)]] for n, h, f in hashed]
            counts = np.bincount(np.concatenate(parts), minlength=buckets)
            used = np.flatnonzero(counts)
            yield used, counts[used]
            at = stop
        row = end


def letters_of(text: str) -> tuple[int, int]:
    """How many characters of ``text`` are letters, and how many are not white space."""
    return sum(map(len, _LETTERS.findall(text))), len(_SPACES.sub("", text))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", docs_per_language: int = 2000, max_languages: int = 4096) -> Model:
    """Learn from rows with a language.

    Bounds: of each of the ``max_languages`` most frequent languages the ``docs_per_language`` different texts with the smallest hashes, so
    reruns agree, every language teaches, and copies of a text teach once.  Whole texts are read.  Rows with a NULL text or language
    teach nothing.  Without labelled rows the model has no language.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    counted = sorted((r[0], r[1]) for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect())
    languages = [name for name, _ in counted]
    buckets = MAX_BUCKETS
    while buckets > 256 and buckets * len(languages) > MAX_CELLS:
        buckets //= 2
    totals = np.array([n for _, n in counted], float)
    if not languages:
        return Model([], np.zeros(0), np.zeros((buckets, 0)), np.zeros((0, 2)))
    slots = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(counted)], "slot int, lang string")
    hashed = rows.join(F.broadcast(slots), "lang").select("slot", "text", F.xxhash64("text").alias("code"))
    # Hashes alone are ranked; equal texts of a language are one before and after.
    codes = hashed.select("slot", "code").distinct()
    least = codes.withColumn("rank", F.row_number().over(Window.partitionBy("slot").orderBy("code"))).where(F.col("rank") <= docs_per_language).groupBy("slot").agg(F.max("code").alias("last"))
    chosen = hashed.join(F.broadcast(least), "slot").where("code <= last").groupBy("slot", "code").agg(F.first("text").alias("text"))
    chosen = stored(chosen.select("slot", "text"), "language-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            slots = batch.column("slot").to_pylist()
            for slot, (used, n) in zip(slots, bucket_counts(batch.column("text").to_pylist(), buckets), strict=True):
                if slot not in sums:
                    sums[slot] = np.zeros(buckets, np.int64)
                sums[slot][used] += n
        for slot, total in sums.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"slot": pa.array(np.full(len(used), slot), pa.int32()), "bucket": pa.array(used, pa.int32()), "n": pa.array(total[used])})

    # The sample is bounded, so a few tasks hold it and the sums they send stay few.
    sums = chosen.repartition(8).mapInArrow(releasing(count), "slot int, bucket int, n long").groupBy("slot", "bucket").agg(F.sum("n").alias("n"))
    got = sums.toArrow()
    table = np.zeros((buckets, len(languages)))
    table[got.column("bucket").to_numpy(), got.column("slot").to_numpy()] = got.column("n").to_numpy()
    weights = np.log((table + 0.5) / (table.sum(0) + 0.5 * buckets))
    return Model(languages, np.log(totals / totals.sum()), weights.astype(np.float32), _bars(table, weights))


def _bars(table: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """By language: the mean log-likelihood per n-gram halfway between its texts and n-grams drawn at random, and its scatter per n-gram."""
    totals = np.maximum(table.sum(0), 1.0)
    expected = (table * weights).sum(0) / totals
    scatter = np.sqrt(np.maximum((table * weights**2).sum(0) / totals - expected**2, 0.0))
    return np.stack([(expected + weights.mean(0)) / 2.0, scatter], axis=1)


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, unusual: str | None = None) -> DataFrame:
    """Each row's ``keep`` columns (all by default) with ``lang_pred`` and ``score``, the posterior of that language.

    The posterior compares languages and is near 1 for any longer text.  With ``unusual`` a column of that name says whether the text is
    unlike those of its language: its n-grams are nearer to random ones than to those that taught the language, or letters are few.  The
    bars are lower the shorter the text is, as short texts vary more.
    Evidence is the whole text alone.  A NULL text, or one without a letter, and any text if the model has no language, is
    ``und`` with score 0.  Rows are neither merged nor lost; kept columns named like the results are replaced by them.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.col(text).cast("string").alias("__text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *([T.StructField(unusual, T.BooleanType())] if unusual else [])])
    shared = spark.sparkContext.broadcast((model.languages, model.prior, model.weights, model.bars))
    fields = schema.names

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, prior, weights, bars = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            found, scores, odd = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            rows = [i for i, t in enumerate(texts) if languages and _LETTER.search(t)]
            for i, (used, n) in zip(rows, bucket_counts([texts[i] for i in rows], weights.shape[0]), strict=True):
                logs = prior + n @ weights[used].astype(np.float64)
                best = int(logs.argmax())
                found[i], scores[i] = languages[best], 1.0 / np.exp(logs - logs[best]).sum()
                if unusual:
                    (letters, chars), (least, scatter), size = letters_of(texts[i]), bars[best], max(1, int(n.sum()))
                    # Neighbouring n-grams share letters, so they count as a third.
                    unlikely = (logs - prior)[best] / size < least - 6.0 * scatter * np.sqrt(3.0 / size)
                    odd[i] = unlikely or letters / max(1, chars) < LEAST_LETTERS - 1.0 / np.sqrt(max(1, chars))
            columns = [*batch.columns[:-1], pa.array(found, pa.string()), pa.array(scores), *([pa.array(odd)] if unusual else [])]
            yield pa.RecordBatch.from_arrays(columns, names=fields)

    return rows.mapInArrow(releasing(score), schema)
