"""Evidence: claims and citations, admission, safety, output gate, fingerprints, freshness, coverage, context budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trim_all

CITATION = r"\[S(\d{4})\]"


def claims(answers: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, line, claim, n_citations, first_ref): lines that hold more than citations; headings and blanks are none."""
    rows = answers.select(*key, F.posexplode(F.split(text, "\n")).alias("_p", "raw"))
    bare = trim_all(F.regexp_replace("raw", CITATION, ""))
    refs = F.regexp_extract_all(F.col("raw"), F.lit(CITATION), F.lit(1))
    out = rows.select(*key, (F.col("_p") + 1).cast("long").alias("line"), bare.alias("claim"), F.size(refs).cast("long").alias("n_citations"), F.when(F.size(refs) > 0, refs[0]).alias("first_ref"))
    return out.where((F.col("claim") != "") & ~F.col("claim").startswith("#"))


def admitted(units: DataFrame, key: str, valid: Column, policy_ok: Column) -> DataFrame:
    """(key, n_units, allowed): a claim is allowed if it has units, all valid, and none under a summary policy."""
    return units.groupBy(key).agg(F.count("*").alias("n_units"), F.bool_and(valid & policy_ok).alias("allowed"))


def output_gate(judged: DataFrame, key: str, order: list[str], blocked: Column) -> DataFrame:
    """(key, action, blocked_lines): allow, redact (some lines) or block (all lines). A line is named by its order columns,
    joined by points."""
    bad = F.count_if(blocked)
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(blocked, F.struct(*order)))), lambda x: F.concat_ws(".", *(x[c].cast("string") for c in order))), ",")
    action = F.when(bad == 0, "allow").when(bad == F.count("*"), "block").otherwise("redact")
    return judged.groupBy(key).agg(action.alias("action"), lines.alias("blocked_lines"))


def safety_decision(in_scope: Column, high_risk: Column, block_term: Column, warn_term: Column, has_source: Column) -> Column:
    """allow, warn or block, by precedence; a null source counts as none."""
    return (
        F.when(~in_scope & ~high_risk, "allow")
        .when(block_term, "block")
        .when(~F.coalesce(has_source, F.lit(False)), "block")
        .when(high_risk | warn_term, "warn")
        .otherwise("allow")
    )


def fingerprint(*fields: Column) -> Column:
    """Hash over the fields in order, nulls as their own mark."""
    return F.sha2(F.concat_ws(chr(31), *(F.coalesce(f.cast("string"), F.lit(chr(30))) for f in fields)), 256)


def freshness(recorded: DataFrame, current: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, status): recorded evidence against the current table: unchanged, changed or missing."""
    now = current.select(F.col(key), F.col(digest).alias("_now"), F.lit(True).alias("_there"))
    status = F.when(F.col("_there").isNull(), "missing").when(F.col(digest).eqNullSafe(F.col("_now")), "unchanged").otherwise("changed")
    return recorded.join(now, key, "left").select(key, status.alias("status"))


def roll_up(parts: DataFrame, key: str, covered: Column) -> DataFrame:
    """(key, n_parts, n_covered, overall): covered, partial or unsupported over a question's parts."""
    n = F.count_if(covered)
    overall = F.when(n == F.count("*"), "covered").when(n == 0, "unsupported").otherwise("partial")
    return parts.groupBy(key).agg(F.count("*").alias("n_parts"), n.alias("n_covered"), overall.alias("overall"))


def within_budget(rows: DataFrame, key: str, order: list, size: str, budget: int) -> DataFrame:
    """Rows of each key up to the first that would pass the budget, with used (their sizes so far, the first cut)."""
    w = Window.partitionBy(key).orderBy(*order)
    total = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("_total", total).withColumn("_n", F.row_number().over(w))
    out = out.where((F.col("_total") <= budget) | (F.col("_n") == 1))
    return out.withColumn("used", F.least("_total", F.lit(budget).cast("long"))).drop("_total", "_n")


def confidence(n_claims: Column, n_supported: Column, n_sources: Column) -> Column:
    """high, medium or low, by precedence."""
    return F.when(n_claims == 0, "low").when((n_supported == n_claims) & (n_sources >= 2), "high").when(n_supported * 2 >= n_claims, "medium").otherwise("low")
