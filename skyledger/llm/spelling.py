"""Spelling variants: words that differ by one code point, found with permuterm rotations.

A word and a terminator after it form a ring; a word of n code points has n + 1 rotations.  If the edited place is turned to the end, two
words that differ by a replaced code point share all but the last sign of a rotation, and a word with one code point more starts with a whole
rotation of the other.  So both edits are equal prefixes of rotations: rotations are dealt and sorted by the prefix that skips the edited
place, each group of equal prefixes is scanned, and its members are one another's neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import stored

#: Never part of a word that is compared.
TERMINATOR = "\0"
#: Letters of the Latin-1 alphabets with the two signs between them.
LETTERS = "[A-Za-zÀ-ÿ]"
#: How much more frequent a word's form is than the word.
RATIO = 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def letter_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = 1, letters: str = LETTERS) -> DataFrame:
    """``key, run`` for every maximal run of letters with at least ``min_length`` code points, A-Z lower-cased.

    NULL and empty texts have no runs; equal runs and repeated rows give a row each; NULL keys stay NULL; other columns are not read.
    """
    found = F.regexp_extract_all(F.col(text).cast("string"), F.lit(f"{letters}{{{min_length},}}"), F.lit(0))
    runs = docs.select(F.col(key).alias("key"), F.explode(found).alias("run"))
    # lower() is fast and right for ASCII; other letters keep their case.
    ascii_only = F.octet_length("run") == F.length("run")
    return runs.select("key", F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", _UPPER, _LOWER)).alias("run"))


def counted_words(words: DataFrame, word: str = "word", min_length: int = 7, min_count: int = 2) -> DataFrame:
    """``word, n`` of the distinct words that are long and frequent enough; NULL words count for nothing."""
    long = words.where(F.length(word) >= min_length)
    return long.groupBy(F.col(word).alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _prefixes(words: DataFrame) -> DataFrame:
    """Every rotation of the marked words as the prefixes that its neighbours share: ``prefix, edit, word, n``.

    ``edit`` 0 is a whole rotation.  1 and 2 skip the code point at the end of one; 2 where the code point before is the same, so that
    removing either gives the same word and one of them is enough.
    """
    size = F.length("word")
    place = F.col("place")
    turn = lambda first, stop: F.concat(F.expr(f"substr(word, {first})"), F.lit(TERMINATOR), F.expr(f"substr(word, 1, {stop})"))
    doubled = F.expr("place > 1 AND substr(word, place, 1) = substr(word, place - 1, 1)")
    rows = words.where(size > 0).where(~F.contains("word", F.lit(TERMINATOR))).select("word", "n", F.explode(F.sequence(F.lit(1), 2 * size + 1)).alias("place"))
    skips = place <= size
    return rows.select(
        F.when(skips, turn("place + 1", "place - 1")).otherwise(turn("place - length(word)", "place - length(word) - 1")).alias("prefix"),
        F.when(~skips, 0).when(doubled, 2).otherwise(1).alias("edit"), "word", "n",
    )


def _groups(words: DataFrame) -> DataFrame:
    """Members of each prefix with company, most frequent first.  They differ in one place, so a group is no larger than the alphabet and one more."""
    member = F.struct((-F.col("n")).alias("rank"), "word", "edit")
    return _prefixes(words).groupBy("prefix").agg(F.array_sort(F.collect_list(member)).alias("members")).where(F.size("members") > 1)


def _others(members: Column, own: Column) -> Column:
    """The neighbours of one member of a group."""
    edit = lambda m: m.getField("edit")
    return F.filter(members, lambda m: (m.getField("word") != own.getField("word")) & (((edit(m) > 0) & (edit(own) > 0)) | (edit(m) + edit(own) == 1)))


def neighbours(words: DataFrame) -> DataFrame:
    """``word, near, near_n``: all pairs of the distinct ``word`` with ``n`` that differ by one inserted, deleted or replaced code point, both ways.

    A pair is found once.  Empty words and words that hold the terminator have no neighbours; NULL words are left out.
    """
    seen = _groups(words).select(F.explode("members").alias("own"), "members")
    return seen.select(F.col("own.word").alias("word"), F.explode(_others(F.col("members"), F.col("own"))).alias("near")).select("word", F.col("near.word").alias("near"), (-F.col("near.rank")).alias("near_n"))


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """One row per row of ``words`` (``word``, distinct, and its count ``n``): ``word, form, root, n, n_near, form_n``.

    ``form`` is the most frequent neighbour, the first in code-point order of equals, if it is at least ``ratio`` (2 or more) times as frequent;
    ``root`` is where forms lead in the end, the word itself if it has none.  An empty table gives no rows.
    """
    if ratio < 2:
        raise ValueError("a form must be more frequent than its word")
    words = stored(words.where("word IS NOT NULL").select("word", F.col("n").cast("long").alias("n")), "spelling-words")
    seen = _groups(words).select(F.explode("members").alias("own"), "members")
    found = seen.select(F.col("own.word").alias("word"), _others(F.col("members"), F.col("own")).alias("others")).where(F.size("others") > 0)
    near = found.groupBy("word").agg(F.sum(F.size("others")).cast("long").alias("n_near"), F.min(F.col("others")[0]).alias("best"))
    joined = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.word").alias("form"), (-F.col("best.rank")).alias("form_n"))
    enough = F.col("form_n") >= ratio * F.col("n")
    out = stored(joined.select("word", F.when(enough, F.col("form")).alias("form"), "n", "n_near", F.when(enough, F.col("form_n")).alias("form_n")), "spelling-forms")

    # Counts grow by the ratio with every step, so paths are short; each round doubles what is known of them.
    roots = out.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        roots = stored(roots, "spelling-roots")
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if not roots.join(further, "root", "left_semi").limit(1).count():
            break
        roots = roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
