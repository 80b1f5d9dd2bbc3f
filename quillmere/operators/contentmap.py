"""Content maps and reports: units of windows, overview groups, synthesis coverage, text forms, agreement of judges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import char_grams, trim_all
from .planning import claim_text

_SPACE = r"[ \t\n\r\x0b\f]+"
#: Fixed value: how an answer that declines begins.
ABSTENTION = r"^(?:不知道|无法回答)(?:[。！!]|$)"


def estimated_tokens(text: Column) -> Column:
    return F.floor((F.char_length(text) + 3) / 4).cast("long")


def normal_language(lang: Column) -> Column:
    """Trimmed lower-case tag with dashes; empty for null."""
    return F.replace(F.lower(F.regexp_replace(F.coalesce(lang, F.lit("")), r"(?U)^\s+|\s+$", "")), F.lit("_"), F.lit("-"))


def file_name_part(value: Column, fallback: str) -> Column:
    """value with runs of other than letters, digits, points, underscores and dashes as one dash, bare of dashes and points
    at its ends; fallback where nothing is left."""
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(value, "[^A-Za-z0-9._-]+", "-"), F.lit("-.")), F.lit("")), F.lit(fallback))


def solid(text: Column) -> Column:
    """text without white space."""
    return F.regexp_replace(text, _SPACE, "")


def letters_and_digits(text: Column) -> Column:
    """Lower-case ASCII letters and digits, and CJK characters, of a text."""
    return F.regexp_replace(F.lower(text), "[^0-9a-z㐀-鿿]+", "")


def word_bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring word characters of the lower-case text, or its only one."""
    bare = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", "")
    return F.when(F.char_length(bare) == 1, F.array(bare)).otherwise(char_grams(bare, [2]))


def clock(seconds: Column) -> Column:
    """hh:mm:ss, or mm:ss under an hour, of seconds rounded half to even and not below 0."""
    s = F.greatest(F.bround(seconds).cast("long"), F.lit(0).cast("long"))
    hours = F.floor(s / 3600)
    rest = F.format_string("%02d:%02d", F.floor(s % 3600 / 60), s % 60)
    return F.when(hours > 0, F.concat(F.format_string("%02d:", hours), rest)).otherwise(rest)


def required_units(units: DataFrame, key: list[str], pos: str, major: Column) -> DataFrame:
    """(key, pos): of each window its first major unit, or else its first."""
    order = Window.partitionBy(*key).orderBy(F.when(major, 0).otherwise(1), pos)
    return units.withColumn("_n", F.row_number().over(order)).where("_n = 1").select(*key, pos)


def assigned_groups(windows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """(key, window, group): every window with the one of the groups that claim it, or of all where none does, that shares
    most bigrams with it; ties go to the group that claims the nearest other window, then to the smaller group.

    windows: key, window (its position), grams; groups: key, group, claimed (positions), grams. A document has few groups.
    A group that claims no other window is as far as there are windows.
    """
    sizes = windows.groupBy(key).agg(F.countDistinct("window").alias("_n"))
    pairs = windows.join(groups.withColumnRenamed("grams", "own"), key).join(sizes, key)
    pairs = pairs.withColumn("_claims", F.coalesce(F.array_contains("claimed", F.col("window")), F.lit(False)))
    pairs = pairs.withColumn("_any", F.bool_or("_claims").over(Window.partitionBy(key, "window"))).where(F.col("_claims") | ~F.col("_any"))
    shared = F.size(F.array_intersect("grams", "own"))
    others = F.transform(F.filter("claimed", lambda c: c != F.col("window")), lambda c: F.abs(c - F.col("window")))
    order = Window.partitionBy(key, "window").orderBy(F.desc(shared), F.coalesce(F.array_min(others), F.col("_n")), "group")
    return pairs.withColumn("_n", F.row_number().over(order)).where("_n = 1").select(key, "window", "group")


def coverage(units: DataFrame, key: str, window: str, covered: Column, omitted: Column, required: Column) -> DataFrame:
    """(key, n_missing, n_both, n_required_missing, n_windows_uncovered, complete) of a synthesis that lists covered and
    omitted units: every unit is in one of both lists, required ones are covered, and so is a unit of each window."""
    per = units.groupBy(key, window).agg(
        F.count_if(~covered & ~omitted).alias("m"), F.count_if(covered & omitted).alias("b"), F.count_if(required & ~covered).alias("r"), F.count_if(covered).alias("c")
    )
    out = per.groupBy(key).agg(F.sum("m").alias("n_missing"), F.sum("b").alias("n_both"), F.sum("r").alias("n_required_missing"), F.count_if(F.col("c") == 0).alias("n_windows_uncovered"))
    return out.withColumn("complete", (F.col("n_missing") + F.col("n_both") + F.col("n_required_missing") + F.col("n_windows_uncovered")) == 0)


def matched_terms(text: Column, terms: list[str]) -> Column:
    """The terms of two characters or more that a text holds, in the list's order and once each."""
    known = list(dict.fromkeys(t for t in terms if len(t) >= 2))
    return F.array_compact(F.array(*(F.when(F.contains(F.lower(text), F.lit(t.lower())), F.lit(t)) for t in known)))


def abstains(answer: Column) -> Column:
    """Whether the first line that isn't blank, bare of citations, list and heading marks, says that the answer isn't known."""
    lines = F.filter(F.transform(F.split(answer, "\n"), trim_all), lambda x: x != "")
    return F.coalesce(claim_text(F.get(lines, F.lit(0))).rlike(ABSTENTION), F.lit(False))


def macro_scores(rows: DataFrame, truth: Column, guess: Column, by: list[str]) -> DataFrame:
    """(by, n, accuracy, macro_f1) of two-valued verdicts; a label that neither has counts as F1 0."""
    f1 = lambda tp, wrong: F.when(2 * tp + wrong > 0, 2 * tp / (2 * tp + wrong)).otherwise(0.0)
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(truth & guess).alias("_t"), F.count_if(~truth & ~guess).alias("_f"))
    wrong = F.col("n") - F.col("_t") - F.col("_f")
    return out.select(*by, "n", F.round((F.col("_t") + F.col("_f")) / F.col("n"), 4).alias("accuracy"), F.round((f1(F.col("_t"), wrong) + f1(F.col("_f"), wrong)) / 2, 4).alias("macro_f1"))
