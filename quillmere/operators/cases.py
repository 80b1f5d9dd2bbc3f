"""Integrity of evaluation material: all rules of a table are evaluated in one pass, and every one that is broken is named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .payloads import VERDICTS

#: States of a claim's annotation.
ANNOTATION = ["reviewed", "pending_human_review"]
_trim = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def broken(rules: dict[str, Column]) -> Column:
    """The names of the rules whose condition, which tells a fault, holds."""
    return F.array_compact(F.array(*(F.when(F.coalesce(fault, F.lit(False)), F.lit(name)) for name, fault in rules.items())))


def evaluation_cases(questions: DataFrame, expected: DataFrame) -> DataFrame:
    """(id, question, category, expected_sources, answer_points, risk_level, expected_answer, violations): one row an id.

    questions: id, question, category; expected: id, expected_video_ids, expected_source_refs, expected_sources (video_id,
    source_ref), answer_points, risk_level, expected_answer (null: true). Ids are unique and stand on both sides; answerable
    cases have videos and references, others have none; a case of several videos names its pairs, which are whole and have
    the same references. A case of one video pairs it with each reference. Of rows that repeat an id the first by their
    text is shown."""
    none = F.array().cast("array<string>")
    first = lambda df, name: df.withColumn("id", F.coalesce("id", F.lit(""))).groupBy("id").agg(F.count("*").alias(f"n_{name}"), F.min_by(F.struct(*[c for c in df.columns if c != "id"]), F.to_json(F.struct(*[c for c in df.columns if c != "id"]))).alias(name))
    rows = first(questions, "q").join(first(expected, "e"), "id", "full_outer")
    videos, refs = F.coalesce("e.expected_video_ids", none), F.coalesce("e.expected_source_refs", none)
    named, answer = F.col("e.expected_sources"), F.coalesce("e.expected_answer", F.lit(True))
    whole = F.forall(named, lambda s: (F.coalesce(s["video_id"], F.lit("")) != "") & (F.coalesce(s["source_ref"], F.lit("")) != ""))
    own = F.transform(named, lambda s: s["source_ref"])
    pairs = F.when(named.isNotNull(), named).when(F.size(videos) > 0, F.transform(refs, lambda r: F.struct(videos[0].alias("video_id"), r.alias("source_ref")))).otherwise(F.array().cast("array<struct<video_id:string,source_ref:string>>"))
    labelled = F.col("n_e").isNotNull()
    faults = broken({
        "empty_id": F.col("id") == "", "repeated_question": F.col("n_q") > 1, "repeated_label": F.col("n_e") > 1, "no_label": F.col("n_e").isNull(), "no_question": F.col("n_q").isNull(), "empty_question": F.col("n_q").isNotNull() & (_trim(F.col("q.question")) == ""),
        "no_sources": labelled & answer & ((F.size(refs) == 0) | (F.size(videos) == 0)), "has_sources": labelled & ~answer & ((F.size(refs) > 0) | (F.size(videos) > 0)), "needs_pairs": labelled & named.isNull() & (F.size(videos) > 1),
        "pair_incomplete": ~whole, "pairs_differ": whole & ((F.size(F.array_except(own, refs)) > 0) | (F.size(F.array_except(refs, own)) > 0)),
    })
    return rows.select("id", _trim(F.col("q.question")).alias("question"), F.coalesce("q.category", F.lit("other")).alias("category"), pairs.alias("expected_sources"), F.coalesce("e.answer_points", none).alias("answer_points"), F.coalesce("e.risk_level", F.lit("low")).alias("risk_level"), answer.alias("expected_answer"), faults.alias("violations"))


def claim_cases(rows: DataFrame) -> DataFrame:
    """rows with violations: each claim has an id of its own, a text, a known label and state, and evidence whose chunks
    are named, have a text and come once. rows: id, claim, label, annotation_status (null: reviewed), evidence (chunk_id,
    text)."""
    counts = rows.groupBy(_trim(F.col("id")).alias("_id")).agg(F.count("*").alias("_n"))
    held = rows.withColumn("_id", _trim(F.col("id"))).join(counts, "_id")
    chunks = F.transform("evidence", lambda e: e["chunk_id"])
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    faults = broken({
        "empty_id": F.col("_id") == "", "repeated_id": (F.col("_id") != "") & (F.col("_n") > 1), "empty_claim": _trim(F.col("claim")) == "", "label": ~F.lower(_trim(F.col("label"))).isin(VERDICTS), "status": ~_trim(F.coalesce("annotation_status", F.lit("reviewed"))).isin(ANNOTATION),
        "no_evidence": F.col("evidence").isNull() | (F.size("evidence") == 0), "evidence_incomplete": F.exists("evidence", lambda e: e.isNull() | blank(e["chunk_id"]) | blank(e["text"])), "repeated_chunk": F.size(F.array_distinct(chunks)) < F.size(chunks),
    })
    return held.withColumn("violations", faults).drop("_id", "_n")
