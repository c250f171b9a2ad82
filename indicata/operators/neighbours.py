"""Nearest names of words within a few edits, by an index of deletion neighbourhoods.

Two strings at most k edits apart become equal if each loses k code points at most. So both
sides are laid out as all their strings with up to k deletions, met by equality, and the pairs that
meet are measured exactly. No word is ever compared with all names.

Scale: each distinct word and name is laid out once, as some length to the power k rows, k being as
many edits as its length allows; words that are longer than the longest name by more than k can't be near and aren't laid out. The
join is an equi-join on a 64-bit hash; what meets by chance is measured like the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

#: As in the additive score: least lengths of word and name, share of a name's length that edits must stay below, share of common letters.
LEAST_WORD, LEAST_NAME, SHARE, COMMON = 5, 4, 0.25, 0.5
EDITS = 2


def _without_one(values: Column) -> Column:
    """All strings that lack one code point of one of the given ones."""

    def cut(value: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(value)), lambda i: F.concat(F.substring(value, F.lit(1), i - 1), F.substring(value, i + 1, F.length(value))))

    return F.array_distinct(F.flatten(F.transform(F.filter(values, lambda v: v != ""), cut)))


def deletions(value: Column, edits: int = EDITS) -> Column:
    """The string and all that lack up to ``edits`` of its code points."""

    def grow(found: Column, last: Column, left: int) -> Column:
        return found if not left else let(_without_one(last), lambda more: grow(F.array_union(found, more), more, left - 1))

    return let(F.array(value), lambda one: grow(one, one, edits))


def _laid_out(df: DataFrame, column: str, edits: int, share: float) -> DataFrame:
    """Each string under its deletions: as many as the share allows between it and a longer one."""

    def most(k: int) -> Column:
        # k edits of a string to one that is k longer at most are below the share
        return F.lit(k) / (F.length(column) + k) < share

    forms = deletions(F.col(column), 0)
    for k in range(1, edits + 1):
        forms = F.when(most(k), deletions(F.col(column), k)).otherwise(forms)
    return df.select(column, F.explode(forms).alias("_part")).select(column, F.xxhash64("_part").alias("_part"))


def common_letters(a: Column, b: Column) -> Column:
    """Share of the distinct letters of the one that has more which both have."""
    letters = lambda x: F.array_distinct(F.filter(F.split(x, ""), lambda c: c != ""))
    one, two = letters(a), letters(b)
    return F.size(F.array_intersect(one, two)) / F.greatest(F.size(one), F.size(two))


def near_names(words: DataFrame, names: DataFrame, *, edits: int = EDITS, share: float = SHARE, common: float = COMMON, least_word: int = LEAST_WORD, least_name: int = LEAST_NAME) -> DataFrame:
    """(word, name, distance): all names near a word, the word itself excluded, each pair once.

    ``words`` has a column word, ``names`` a column name; nulls and repeats are passed over.
    A pair counts if it is at most ``edits`` edits apart, fewer than ``share`` of the
    longer one's length, and ``common`` of its letters are common.
    """
    names = names.select(F.col("name").cast("string")).where(F.length("name") >= least_name).distinct()
    longest = names.agg(F.max(F.length("name"))).first()[0] or 0
    words = words.select(F.col("word").cast("string")).where((F.length("word") >= least_word) & (F.length("word") <= longest + edits)).distinct()
    met = _laid_out(words, "word", edits, share).join(_laid_out(names, "name", edits, share), "_part").where("word <> name").select("word", "name").distinct()
    distance = F.levenshtein("word", "name", edits)
    near = met.withColumn("distance", distance).where((F.col("distance") >= 0) & (F.col("distance") / F.greatest(F.length("word"), F.length("name")) < share))
    return near.where(common_letters(F.col("word"), F.col("name")) >= common)


def nearest_name(words: DataFrame, names: DataFrame, **options) -> DataFrame:
    """(word, name, distance): the nearest name of each word that has one; of several, the first in code point order."""
    best = near_names(words, names, **options).groupBy("word").agg(F.min(F.struct("distance", "name")).alias("b"))
    return best.select("word", "b.name", "b.distance")
