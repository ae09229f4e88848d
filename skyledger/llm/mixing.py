"""Mixing sources to target weights by Pareto order sampling.

A source whose target is r times its words gives every document floor(r) certain copies.  What is left of the target is a sample with unequal
probabilities: a document's inclusion probability is proportional to its size, those that reach one are certain, too, and the scale is such that
the expected words are what is left.  Each other document draws U from a hash of its id, its rank is its odds U/(1-U) divided by the odds of its
inclusion probability, and the source takes documents in order of rank until their words come nearest to what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.common import stored

WORD = "[^\\x20\\x09-\\x0D]+"
#: Ranks lie in (0, 1); sums over so many equal parts find the part in which a source's sample ends.
PARTS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draws(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix") -> DataFrame:
    """``docs`` with what sampling needs: source (NULL apart), size in words, and 52 random bits from the id."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")).cast("binary"))
    return docs.withColumns({
        "__no_source": F.col(source).isNull(), "__source": F.coalesce(F.col(source).cast("string"), F.lit("")), "__size": word_count(F.col(text).cast("string")),
        "__draw": F.conv(F.substring(digest, 1, 13), 16, 10).cast("long"),
    })


SOURCE = ["__no_source", "__source"]


def targets(rows: DataFrame, share: float = 1.5, weights: tuple[int, ...] = (5, 2, 1), most: int = 2) -> DataFrame:
    """Per source its words, target, certain copies, and the words that are left to sample.

    Sources in order of code points, NULL last, take ``weights`` in turn and share ``share`` times all words.  Targets stop at ``most``
    times the source's words and the excess goes to the others by weight: sorted by cap per weight, the first source that stays below its
    cap fixes the level.  Both windows run over one row per source.
    """
    sums = rows.groupBy(*SOURCE).agg(F.sum("__size").alias("source_size"))
    number = F.row_number().over(Window.orderBy("__no_source", "__source"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((number - 1) % len(weights) + 1).cast("int")).cast("long")
    capped = sums.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    everything = Window.partitionBy()
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "__no_source", "__source")
    lower = by_level.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("cap").over(lower), F.lit(0))) / F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    levels = capped.withColumn("level", level).withColumn("first", F.row_number().over(by_level))
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("first", "level"))
    levels = levels.withColumn("level", F.min(fits).over(everything).getField("level"))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    ratio = F.coalesce(F.try_divide(target, F.col("source_size")), F.lit(0.0))
    whole = F.floor(ratio)
    return levels.select(*SOURCE, "source_size", target.alias("target"), whole.alias("whole"), (target - whole * F.col("source_size")).alias("left"))


def inclusion(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """``goals`` with ``scale`` and ``bound``: a document of size s up to ``bound`` is sampled with probability ``scale`` * s, a larger one is certain.

    ``rest`` is what the sampled ones are to give.  Sizes are counted first; the running sums go over a source's distinct sizes, from the
    largest on, to the first that need not be certain.
    """
    sizes = rows.where("__size > 0").groupBy(*SOURCE, "__size").agg(F.count("*").alias("n")).join(goals, SOURCE)
    larger = Window.partitionBy(*SOURCE).orderBy(F.desc("__size")).rowsBetween(Window.unboundedPreceding, -1)
    words, squares = F.col("__size") * F.col("n"), F.col("__size") * F.col("__size") * F.col("n")
    certain = F.coalesce(F.sum(words).over(larger), F.lit(0))
    below = F.sum(squares).over(Window.partitionBy(*SOURCE)) - F.coalesce(F.sum(squares).over(larger), F.lit(0))
    steps = sizes.withColumn("certain", certain).withColumn("scale", (F.col("left") - F.col("certain")) / below)
    found = steps.where("scale * __size <= 1").groupBy(*SOURCE).agg(F.max(F.struct(F.col("__size").alias("bound"), "scale", "certain")).alias("f"))
    return goals.join(found, SOURCE, "left").select("*", "f.bound", "f.scale", (F.col("left") - F.col("f.certain")).alias("rest")).drop("f")


def _rank(size: Column, draw: Column, of: Column) -> Column:
    """Pareto rank q as q / (1 + q), which keeps the order and lies in [0, 1); NULL for a document that is certain or never sampled."""
    u = (draw + F.lit(0.5)) / F.lit(float(1 << 52))
    p = of.getField("scale") * size
    q = u * (1 - p) / (u * (1 - p) + (1 - u) * p)
    return F.when((size <= of.getField("bound")) & (p > 0), q)


def sample_ends(rows: DataFrame) -> DataFrame:
    """The targets of all sources with the last part and the last (rank, draw) that each source's sample takes, as a struct ``__mix``.

    A large source is not sorted: word sums of ``PARTS`` parts of the rank show in which part the sample ends, and only that part is.
    What is known per source is written, so that Spark sees its size and broadcasts it only if it is small.
    """
    goals = stored(inclusion(rows, stored(targets(rows), "mix-targets")), "mix-inclusion")
    known = goals.select(*SOURCE, F.struct("scale", "bound").alias("of"), "rest")
    ranked = rows.select(*SOURCE, "__size", "__draw").join(known, SOURCE).withColumn("rank", _rank(F.col("__size"), F.col("__draw"), F.col("of")))
    ranked = ranked.where("rank IS NOT NULL").withColumn("part", F.floor(F.col("rank") * PARTS)).drop("of")
    sums = ranked.groupBy(*SOURCE, "part", "rest").agg(F.sum("__size").alias("words"))
    total = F.sum("words").over(Window.partitionBy(*SOURCE).orderBy("part"))
    ends = sums.withColumn("total", total).where("total >= rest").groupBy(*SOURCE).agg(F.min(F.struct("part", (F.col("total") - F.col("words")).alias("before"))).alias("end"))
    ends = ends.select(*SOURCE, F.col("end.part").alias("part"), F.col("end.before").alias("before"))
    last = ranked.join(ends, [*SOURCE, "part"]).groupBy(*SOURCE, "rank", "__draw", "before", "rest").agg(F.sum("__size").alias("words"))
    total = F.sum("words").over(Window.partitionBy(*SOURCE).orderBy("rank", "__draw")) + F.col("before")
    taken = last.withColumn("total", total).where("total - words / 2 <= rest").groupBy(*SOURCE).agg(F.max(F.struct("rank", "__draw")).alias("end"))
    joined = goals.join(ends.select(*SOURCE, F.col("part").alias("end_part")), SOURCE, "left").join(taken, SOURCE, "left")
    return stored(joined.select(*SOURCE, F.struct(*[c for c in joined.columns if c not in SOURCE]).alias("__mix")), "mix-ends")


def copies(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """``rows`` with the struct ``__mix`` of their source and ``__copies``: how often the mix takes each."""
    joined = rows.join(ends, SOURCE, "left").withColumn("__rank", _rank(F.col("__size"), F.col("__draw"), F.col("__mix")))
    part = F.floor(F.col("__rank") * PARTS)
    end_part = F.col("__mix.end_part")
    inside = (part < end_part) | ((part == end_part) & (F.struct(F.col("__rank").alias("rank"), "__draw") <= F.col("__mix.end")))
    # A sample that no part ends (what is left equals all words but for rounding) takes all.
    sampled = F.when(F.col("__rank").isNull(), F.col("__size") > F.col("__mix.bound")).when(end_part.isNull(), F.lit(True)).otherwise(F.coalesce(inside, F.lit(False)))
    return joined.withColumn("__copies", (F.col("__mix.whole") + F.coalesce(sampled, F.lit(False)).cast("long")).cast("int")).drop("__rank")


def mix_sizes(rows: DataFrame) -> DataFrame:
    """The whole operator on rows of ``draws``: all their columns with ``__copies``, ``source_size`` and ``target``.

    The draw depends on the id alone, so reruns agree and repeated rows share their fate; a NULL id counts as the empty text.  A NULL
    source is a source of its own, a NULL text has size 0.  A document is taken at most twice; targets of empty sources are 0.  Columns
    named like the results are replaced.
    """
    kept = [c for c in rows.columns if c not in ("__copies", "__mix", "__rank", "source_size", "target")]
    out = copies(rows.select(*[F.col(f"`{c}`") for c in kept]), sample_ends(rows))
    return out.select(*[F.col(f"`{c}`") for c in kept], "__copies", F.col("__mix.source_size").alias("source_size"), F.col("__mix.target").alias("target"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixed documents with all their columns: rows taken twice appear twice, rows not taken are left out.

    Texts are not shuffled: where each source's sample ends is a small table that every row is joined with.
    """
    bare = docs.select(F.col(key), F.col(text), F.col(source))
    # Words are counted once for all that is known per source.
    rows = stored(draws(bare, key, text, source).select(*SOURCE, "__size", "__draw"), "mix-sizes")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(key).alias("__key"), F.col(text).alias("__text"), F.col(source).alias("__from"))
    taken = copies(draws(whole, "__key", "__text", "__from"), sample_ends(rows))
    again = taken.where("__copies > 0").select("__row", F.explode(F.sequence(F.lit(1), "__copies")).alias("__copy"))
    return again.select("__row.*")
