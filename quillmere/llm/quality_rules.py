"""Quality rules as a short-circuit cascade of native expressions.

Each rule is a condition that rejects a document. On a sample, one aggregation gives how often rules reject together and
the mean sizes (characters, words, lines) their costs are estimated from, feature by feature; rules run in descending
order of rejections per cost, each among the documents that the earlier ones leave. Once a rule has fired, later ones and
the features they need are skipped. The order changes the cost and which of several failing rules is named, never whether
a document is kept.

Defined results: a null or empty text has no words and fails the base rule; repeated rows are judged each alike; an empty
table gives an empty result and the declared order of rules. Texts of any length are judged whole. Input columns other
than id and text are ignored by the features and kept by `apply_rules`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, and the characters counted as symbols.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Share of rows in the sample that orders the rules.
SAMPLE_FRACTION, SAMPLE_SEED = 0.02, 7


@dataclass(frozen=True)
class Rule:
    """A named rejecting condition over feature columns, and the features it needs."""

    name: str
    rejects: Column
    needs: tuple[str, ...]


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE_PATTERN), "")


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda acc, x: acc + x)


def _repeat_words(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs at least twice, from the windows' hashes in order."""
    n = F.size(hashes)
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    pairs = F.zip_with(F.slice(placed, 1, F.greatest(n - 1, F.lit(0))), F.slice(placed, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    return F.sort_array(F.array_distinct(F.flatten(pairs)))


def _hashes(n: Column) -> Column:
    windows = F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice(F.col("_words"), i, WINDOW)))
    return F.when(n > WINDOW, windows).otherwise(F.array().cast("array<bigint>"))


def _covered(starts: Column) -> Column:
    k = F.size(starts)
    gaps = F.zip_with(F.slice(starts, 1, F.greatest(k - 1, F.lit(0))), F.slice(starts, 2, F.greatest(k - 1, F.lit(0))), lambda a, b: F.least(b - a, F.lit(WINDOW)))
    return F.when(starts.isNull(), F.lit(0)).otherwise(_total(gaps) + WINDOW)


#: Features over `_text` in the order they build on each other: (name, expression, features it needs, unit and weight of
#: its cost). Windows of eight words are compared by 64-bit hash.
FEATURES: dict[str, tuple[Column, tuple[str, ...], str, float]] = {}


def _features() -> dict[str, tuple[Column, tuple[str, ...], str, float]]:
    if not FEATURES:
        text, long = F.col("_text"), lambda c: c.cast("long")
        lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, SPACE_CHARS, "") != "")
        repeats = F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), _repeat_words(F.col("_hashes")))
        FEATURES.update({
            "_words": (_words(text), (), "chars", 1.0),
            "_lines": (lines, (), "chars", 0.5),
            "n_words": (long(F.size("_words")), ("_words",), "chars", 0.0),
            "word_chars": (long(F.char_length(F.translate(text, SPACE_CHARS, ""))), (), "chars", 0.1),
            "n_symbols": (long(F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))), (), "chars", 0.1),
            "n_dup_lines": (long(F.size("_lines") - F.size(F.array_distinct("_lines"))), ("_lines",), "lines", 2.0),
            "n_lines": (long(F.size("_lines")), ("_lines",), "lines", 0.0),
            "_hashes": (_hashes(F.size("_words")), ("_words",), "words", 8.0),
            "_starts": (repeats, ("_hashes",), "words", 4.0),
            "n_repeat_words": (long(_covered(F.col("_starts"))), ("_starts",), "words", 0.5),
        })
    return FEATURES


OUTPUTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _need(name: str, have: list[str]) -> list[str]:
    """The features still missing for `name`, in the order they build on each other."""
    if name in have:
        return []
    out: list[str] = []
    for x in _features()[name][1]:
        out += [y for y in _need(x, have) if y not in out]
    return [*out, name]


def with_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and n_chars of every whole text."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    df = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("_text"))
    have: list[str] = []
    for step in (("_words", "_lines"), ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "_hashes"), ("_starts",), ("n_repeat_words",)):
        df = df.select(*df.columns, *(_features()[c][0].alias(c) for c in step))
        have += step
    return df.select("doc_id", *OUTPUTS, F.char_length("_text").cast("long").alias("n_chars"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def default_rules() -> list[Rule]:
    """The base rule and those for symbol noise, repeated lines and word lengths that no prose has."""
    words, chars, symbols, dups, lines = (F.col(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines"))
    return [
        Rule("few_words", words < 20, ("n_words",)),
        Rule("repeated_words", F.col("n_repeat_words") * 100 > words * 30, ("n_words", "n_repeat_words")),
        Rule("symbols", symbols * 10 > words, ("n_words", "n_symbols")),
        Rule("repeated_lines", dups * 100 > lines * 50, ("n_dup_lines", "n_lines")),
        Rule("short_words", chars < words * 2, ("n_words", "word_chars")),
        Rule("long_words", chars > words * 16, ("n_words", "word_chars")),
    ]


def rule_cost(rule: Rule, sizes: dict[str, float], have: list[str]) -> float:
    """Estimated cost of a rule for one document: its own test and the features that are still missing."""
    missing = [f for name in rule.needs for f in _need(name, have)]
    return 1.0 + sum(_features()[f][3] * sizes[_features()[f][2]] for f in dict.fromkeys(missing))


def order_rules(features: DataFrame, rules: list[Rule]) -> list[Rule]:
    """Rules by rejections per cost on a sample's features; one row of sums comes back to the driver.

    Step by step, the rule with the most rejections per cost goes next; features that an earlier rule needed cost nothing
    more, and rejections count among documents that no earlier rule rejects: the sums hold each set of rules that reject
    a document together.
    """
    units = {"chars": "n_chars", "words": "n_words", "lines": "n_lines"}
    marks = F.array(*(F.coalesce(r.rejects, F.lit(False)) for r in rules))
    rows = features.groupBy(marks.alias("marks")).agg(F.count("*").alias("n"), *(F.sum(c).alias(u) for u, c in units.items())).collect()
    if not rows:
        return list(rules)
    total = sum(r["n"] for r in rows)
    sizes = {u: sum(r[u] or 0 for r in rows) / total for u in units}
    left, have, out = list(range(len(rules))), [], []
    while left:
        alive = [r for r in rows if not any(r["marks"][k] for k in out)]
        worth = {k: sum(r["n"] for r in alive if r["marks"][k]) / total / rule_cost(rules[k], sizes, have) for k in left}
        k = min(left, key=lambda k: (-worth[k], rule_cost(rules[k], sizes, have), k))
        left.remove(k)
        out.append(k)
        for name in rules[k].needs:
            have += _need(name, have)
    return [rules[k] for k in out]


def failed_rule(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects, null for a document that passes all."""
    case = F.when(rules[0].rejects, F.lit(rules[0].name))
    for r in rules[1:]:
        case = case.when(r.rejects, F.lit(r.name))
    return case


def _ordered(docs: DataFrame, rules: list[Rule] | None) -> list[Rule]:
    # the sample is drawn before the features, so that they are worked out for its rows alone
    return order_rules(with_features(docs.sample(fraction=SAMPLE_FRACTION, seed=SAMPLE_SEED)), rules or default_rules())


def quality_cascade(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Features of every document with failed_rule and kept, by the cascade; as all features are returned, all are worked
    out, and the order only says which rule is named. `keep_passing` skips what it doesn't reach."""
    ordered = _ordered(docs, rules)
    return with_features(docs).withColumn("failed_rule", failed_rule(ordered)).withColumn("kept", F.col("failed_rule").isNull())


def keep_passing(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that no rule rejects.

    A feature is worked out where the cascade first needs it, under the condition that no earlier rule has rejected the
    row, so the costly windows are built only for documents that pass what stands before.
    """
    ordered, failed = _ordered(docs, rules), F.col("_failed")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    df = docs.select(row, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"), F.lit(False).alias("_failed"))
    have: list[str] = []
    for rule in ordered:
        for name in rule.needs:
            for f in _need(name, have):
                df = df.withColumn(f, F.when(~failed, _features()[f][0]))
                have.append(f)
        df = df.withColumn("_failed", failed | F.coalesce(rule.rejects, F.lit(False)))
    # a filter would be pushed below the features and work each of them out anew in one condition; it can't pass a row number
    judged = df.withColumn("_at", F.monotonically_increasing_id())
    return judged.where(~failed & (F.col("_at") >= 0)).select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, base verdict and cascade verdict of all documents."""
    out = quality_cascade(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), "kept", "n_lines")
