"""Line dedup by content-defined chunks of lines, with DataFrame functions only.

Every line that holds more than white space gets a hash, and a rolling hash runs over the hashes of each such line and the next.  A chunk
ends where the rolling hash occurs nowhere else, so chunks are the longest runs of lines whose neighbours were seen together before: a
passage of two lines or more is cut at its own ends, whatever stands around it.  Each link of a chunk, two lines, is compared byte by byte with its
first occurrence in all documents; chunks are removed except where their links occur first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import stored

#: Documents that take part in a join of texts are first picked by so many hash values: a broadcast of at most that many numbers.
PICK_BUCKETS = 1 << 20
_FULL = "[^\\x20\\x09-\\x0D]"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once: as a variable of a lambda it is not put in for each element of the lambdas inside."""
    return F.get(F.transform(F.array(value), use), 0)


def _full_lines(lines: Column) -> Column:
    """Numbers, from 1, of the lines that hold more than white space; ``lines`` is a bound value."""
    numbers = F.when(F.size(lines) > 0, F.sequence(F.lit(1), F.size(lines)))
    return F.filter(numbers, lambda i: F.element_at(lines, i).rlike(_FULL))


def _full_texts(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(_FULL))


def _links(text: Column) -> Column:
    """The rolling hash of every full line and the next one, in order."""
    def rolling(hashes: Column) -> Column:
        return F.transform(F.slice(hashes, 2, F.greatest(F.size(hashes) - 1, F.lit(0))), lambda after, i: F.xxhash64(F.get(hashes, i), after))

    return _bound(F.transform(_full_texts(text), lambda line: F.xxhash64(line)), rolling)


def _linked_texts(text: Column, places: Column) -> Column:
    """Both lines of the links at ``places`` (structs with ``place``), as structs with everything of the place and ``chunk``."""
    def pick(full: Column) -> Column:
        both = lambda p: F.concat(F.element_at(full, p), F.lit("\n"), F.element_at(full, p + 1))
        return F.transform(places, lambda x: x.withField("chunk", both(x.getField("place"))))

    return _bound(_full_texts(text), pick)


def _without(text: Column, lost: Column) -> Column:
    """The text without its lost links and how many lines that takes; a lost link takes its two lines and the blank ones between them."""
    def rest(lines: Column) -> Column:
        dropped = _bound(_full_lines(lines), lambda full: F.flatten(F.transform(lost, lambda p: F.sequence(F.element_at(full, p), F.element_at(full, p + 1)))))
        stay = F.array_except(F.sequence(F.lit(1), F.size(lines)), dropped)
        return _bound(stay, lambda kept: F.struct(F.array_join(F.transform(kept, lambda i: F.element_at(lines, i)), "\n").alias("text"), (F.size(lines) - F.size(kept)).alias("removed")))

    return _bound(F.split(text, "\n"), rest)


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without repeated chunks: all columns, ``text`` rewritten, and ``__lines``, ``__removed_lines``, ``__removed_chunks``.

    The first occurrence in order of (key, hash of the text, line) stays, so every line stays somewhere.  Single lines are not compared, lines of
    white space only go with the chunk around them, a NULL text stays NULL, and a text that loses everything becomes empty.  Rows with equal key
    and text are one document: they share the outcome.  A NULL key is a key like any other and comes first.  Columns named like the results are
    replaced.  Links are found by hashes and places alone; texts are moved only for documents that hold a repeated link, and at the end for
    those that lose one.  No group of equal links is gathered, so a passage in a third of all texts is a skewed join that Spark splits.
    """
    results = ("__lines", "__removed_lines", "__removed_chunks")
    kept = [c for c in docs.columns if c not in results]
    body = F.col(f"__row.`{text}`").cast("string")  # a row holds its text once, so that a join moves it once
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__row")).withColumns({"__key": F.col(f"__row.`{key}`"), "__hash": F.xxhash64(body)})
    bucket = F.pmod(F.xxhash64("__key", "__hash"), F.lit(PICK_BUCKETS))

    found = rows.select("__key", "__hash", F.posexplode(_links(body)).alias("place", "code"))
    links = stored(found.select("code", F.struct("__key", "__hash", (F.col("place") + 1).alias("place")).alias("at")), "line-links")
    seen = links.groupBy("code").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first < last").select("code", "first")
    repeated = links.join(seen, "code").groupBy("at.__key", "at.__hash")
    repeated = repeated.agg(F.collect_set(F.struct(F.col("at.place").alias("place"), "code", (F.col("at") == F.col("first")).alias("first"))).alias("places"))
    repeated = stored(repeated.select(F.col("__key").alias("__of"), F.col("__hash").alias("__of_hash"), "places", F.pmod(F.xxhash64("__key", "__hash"), F.lit(PICK_BUCKETS)).alias("bucket")), "line-repeated")

    same = F.col("__key").eqNullSafe(F.col("__of")) & (F.col("__hash") == F.col("__of_hash"))
    some = rows.select("__key", "__hash", body.alias("__text"), bucket.alias("bucket")).join(F.broadcast(repeated.select("bucket").distinct()), "bucket", "left_semi")
    spoken = some.drop("bucket").join(repeated.drop("bucket"), same).dropDuplicates(["__key", "__hash"])
    chunks = stored(spoken.select("__key", "__hash", F.explode(_linked_texts(F.col("__text"), F.col("places"))).alias("c")).select("__key", "__hash", "c.*"), "line-chunks")
    originals = chunks.where("first").select("code", F.col("chunk").alias("original"))
    gone = chunks.where("NOT first").join(originals, "code").where("chunk = original")
    lost = gone.groupBy("__key", "__hash").agg(F.array_sort(F.collect_set("place")).alias("__lost"))
    lost = stored(lost.select(F.col("__key").alias("__of"), F.col("__hash").alias("__of_hash"), "__lost", bucket.alias("bucket")), "line-lost")

    picked = F.broadcast(lost.select("bucket").distinct())
    marked = rows.withColumn("bucket", bucket)

    def shown(new: Column, lines: Column, removed: Column, runs: Column) -> list[Column]:
        columns = [new.alias(c) if c == text else F.col(f"__row.`{c}`") for c in kept]
        return [*columns, lines.alias("__lines"), removed.cast("int").alias("__removed_lines"), runs.cast("int").alias("__removed_chunks")]

    count = F.when(body.isNull(), 0).otherwise(F.length(body) - F.length(F.replace(body, F.lit("\n"))) + 1)
    whole = marked.join(picked, "bucket", "left_anti").select(*shown(body, count, F.lit(0), F.lit(0)))
    cut = marked.join(picked, "bucket", "left_semi").drop("bucket").join(lost.drop("bucket"), same, "left")
    cut = cut.withColumn("__rest", F.when(F.col("__lost").isNotNull(), _without(body, F.col("__lost"))))
    new = F.when(F.col("__lost").isNull(), body).otherwise(F.col("__rest.text"))
    removed = F.when(F.col("__lost").isNull(), 0).otherwise(F.col("__rest.removed"))
    # A chunk begins at a link whose predecessor stays.
    runs = F.when(F.col("__lost").isNull(), 0).otherwise(F.size(F.array_except("__lost", F.transform("__lost", lambda p: p + 1))))
    return whole.unionByName(cut.select(*shown(new, count, removed, runs)))
