"""Question plans and claim checks: parts of a question, traceability, citations of answer lines against evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim_all

#: Marks and conjunctions that part a question, what is stripped from parts, and marks that don't count.
PART_MARKS = "[?？；;。]|(?:以及|并且|还有|同时|分别)"
PART_STRIP = " ，,、"
PUNCTUATION = r"[ \t\n\r\x0b\f，。？！；;,.!?]"
#: The forms of citations, list and heading prefixes, and source references.
CITATION = r"\[\s*([A-Za-z0-9_-]+)\s*\|\s*([^\]]*)\]"
LIST_PREFIX, HEADING = r"^(?:[-*]|\d+[.)、])\s*", r"^【[^】]+】\s*"
SOURCE_REF = r"\b(S\d{4})\b"


def question_parts(text: Column, most: int = 3) -> Column:
    """Up to `most` parts of a question, or the question itself where nothing is left."""
    parts = F.filter(F.transform(F.split(text, PART_MARKS), lambda x: F.btrim(x, F.lit(PART_STRIP))), lambda x: x != "")
    return F.when(F.size(parts) > 0, F.slice(parts, 1, most)).otherwise(F.array(text))


def plan_confidence(parts: Column) -> Column:
    return F.when(F.size(parts) == 1, "high").otherwise("medium")


def is_complex(text: Column, parts: Column) -> Column:
    """Whether a plan has several parts or its question over 80 characters."""
    return (F.size(parts) > 1) | (F.char_length(text) > 80)


def traceable(original: Column, query: Column) -> Column:
    """Whether a word of two or more ASCII letters, digits or underscores of the query stands in the original, or else a
    fifth of the query's distinct characters, punctuation and white space aside."""
    folded, asked = F.lower(original), F.lower(query)
    tokens = F.regexp_extract_all(asked, F.lit("([a-z0-9_]{2,})"), F.lit(1))
    letters = lambda c: F.array_remove(F.array_distinct(F.split(F.regexp_replace(c, PUNCTUATION, ""), "")), "")
    own = letters(asked)
    shared = F.size(F.array_intersect(letters(folded), own))
    return F.exists(tokens, lambda t: F.contains(folded, t)) | ((F.size(own) > 0) & (shared * 5 >= F.size(own)))


def claim_text(line: Column) -> Column:
    """A line without citations, list mark and heading mark."""
    bare = trim_all(F.regexp_replace(line, CITATION, ""))
    return trim_all(F.regexp_replace(trim_all(F.regexp_replace(bare, LIST_PREFIX, "")), HEADING, ""))


def checked_claims(lines: DataFrame, key: list[str], evidence: DataFrame, by: list[str]) -> DataFrame:
    """(key, claim, n_citations, valid, errors, chunk_ids): every line that makes a claim, with its citations checked.

    lines: key columns and text, one row a line. evidence: `by` columns (part of the key), chunk_id, refs and rank, the
    chunks that were retrieved; of a chunk that comes twice the row with the smallest rank counts. Each citation must name a retrieved chunk and only references of it; `N/A` or nothing is right
    where the chunk has none. errors: distinct and sorted; chunk_ids: those of right citations.
    """
    rows = lines.select(*key, trim_all(F.col("text")).alias("_line")).withColumn("claim", claim_text(F.col("_line")))
    rows = rows.where((F.col("_line") != "") & ~F.col("_line").rlike(HEADING + "$") & (F.col("claim") != ""))
    found = F.arrays_zip(F.regexp_extract_all("_line", F.lit(CITATION), F.lit(1)).alias("chunk"), F.regexp_extract_all("_line", F.lit(CITATION), F.lit(2)).alias("raw"))
    cited = rows.select(*key, "claim", F.explode_outer(found).alias("c")).select(*key, "claim", F.col("c.chunk").alias("chunk_id"), F.trim("c.raw").alias("raw"))
    known = evidence.groupBy(*by, "chunk_id").agg(F.min_by("refs", "rank").alias("_refs")).withColumn("_there", F.lit(True))
    joined = cited.join(known, [*by, "chunk_id"], "left")
    refs = F.array_distinct(F.regexp_extract_all("raw", F.lit(SOURCE_REF), F.lit(1)))
    error = (
        F.when(F.col("chunk_id").isNull(), "missing_citation")
        .when(F.col("_there").isNull(), "chunk_not_in_retrieval")
        .when(F.col("raw").isin("N/A", ""), F.when(F.size("_refs") > 0, "source_refs_missing"))
        .when(F.size(refs) == 0, "source_refs_malformed")
        .when(F.size(F.array_except(refs, F.col("_refs"))) > 0, "source_refs_not_in_chunk")
    )
    judged = joined.withColumn("error", error)
    return judged.groupBy(*key, "claim").agg(
        F.count("chunk_id").alias("n_citations"),
        (F.count("error") == 0).alias("valid"),
        F.array_sort(F.collect_set("error")).alias("errors"),
        F.array_sort(F.collect_set(F.when(F.col("error").isNull(), F.col("chunk_id")))).alias("chunk_ids"),
    )


def claim_rates(claims: DataFrame, by: list[str]) -> DataFrame:
    """(by, claim_count, grounded_claim_count, rate): the share of claims with right citations."""
    counts = claims.groupBy(*by).agg(F.count("*").alias("claim_count"), F.count_if("valid").alias("grounded_claim_count"))
    return counts.withColumn("rate", F.round(F.col("grounded_claim_count") / F.col("claim_count"), 4))
