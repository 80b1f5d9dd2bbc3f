"""Column helpers over text: words, squeezed text, trimming, bigrams, clocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def word_count(text: Column) -> Column:
    """The number of words(text), without making them."""
    return F.regexp_count(F.lower(text), F.lit(r"[\p{L}\p{N}]+")).cast("long")


def trim_all(text: Column) -> Column:
    """text without blanks, tabs and line breaks at its ends."""
    return F.regexp_replace(text, r"^[ \t\n\r]+|[ \t\n\r]+$", "")


def squeeze(text: Column) -> Column:
    """text with runs of white space as one blank."""
    return trim_all(F.regexp_replace(text, r"[ \t\n\r]+", " "))


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters of the lower-cased text without white space."""
    letters = F.array_remove(F.split(F.regexp_replace(F.lower(text), r"[ \t\n\r]+", ""), ""), "")
    n = F.greatest(F.size(letters) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(letters, F.lit(1), n), F.slice(letters, F.lit(2), n), lambda a, b: F.concat(a, b)))


def char_grams(text: Column, sizes: list[int]) -> Column:
    """Distinct runs of neighbouring characters of the given sizes, none for null; linear in the text, as characters are
    looked up in an array that is bound by a lambda, and so is made once a text and not once a character."""

    def grams(letters: Column) -> Column:
        n = F.size(letters)
        starts = lambda k: F.when(n >= k, F.sequence(F.lit(0), F.greatest(n - k, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        joined = lambda k: F.transform(starts(k), lambda i: F.concat(*(F.get(letters, i + j) for j in range(k))))
        return F.concat(*(joined(k) for k in sizes))

    return F.array_distinct(F.flatten(F.transform(F.array(F.array_remove(F.split(text, ""), "")), grams)))


def clock_seconds(clock: Column) -> Column:
    """Seconds of h:m:s, m:s or s, with a comma or point before fractions; null where it is none of these."""
    parts = F.transform(F.split(F.replace(clock, F.lit(","), F.lit(".")), ":"), lambda x: x.try_cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda acc, x: acc * 60 + x)
