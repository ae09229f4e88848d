"""A corpus from raw documents to packed sequences, stage by stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm import language_id, line_dedup, mixing, ngram_jaccard, packing
from skyledger.llm.common import stored, table

#: Documents whose language is less certain than this go.
MIN_LANGUAGE_SCORE = 0.5


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language that are not unlike its other texts.

    Rows without letters or text go; without any label to learn from, all others stay.
    """
    model = language_id.train(docs)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    found = language_id.identify(rows, model, text="__row.text", keep=["__row"], unusual="__unusual")
    sure = (F.col("score") >= MIN_LANGUAGE_SCORE) & ~F.col("__unusual") if model.languages else F.col("__row.text").rlike("\\p{L}")
    return found.where(sure).select("__row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without chunks of lines that occurred before; documents that lose every word go, NULL and empty texts stay."""
    out = line_dedup.dedup_lines(docs)
    emptied = (F.col("__removed_chunks") > 0) & ~F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    kept = out.where(~F.coalesce(emptied, F.lit(False)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        kept = kept.withColumn("n_chars", F.when(F.col("__removed_chunks") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8), the one with the smallest id.

    Rows without an id can't be told apart by it and stay; rows that share an id stay or go together.
    """
    found = ngram_jaccard.join_groups(docs.select("doc_id", "text"), n=5, num=80, den=100)
    gone = found.where("key <> component").select(F.col("key").alias("__gone"))
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; rows taken twice appear twice."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 2048 tokens."""
    pieces = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), keep_words=False)
    return packing.pack(pieces).withColumnRenamed("key", "doc_id")


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", keep_one_of_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: Learned language models and tokenizer ids are beyond SQL; tests compare the stages with plain versions on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each stage returns is written in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
