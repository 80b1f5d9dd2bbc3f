"""Review rules parsed from checklists, and the safety gate that reads them.

Texts meet the rules' terms in a narrow map: each text is one pass of an automaton over a bounded block of terms, and only
the numbers of the terms found leave a task. No text is shuffled, and any number of rules is that many blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import materialize

#: The forms of issues, headings and pending items, what parts terms, the heading of pending items, its
#: issue, marks of blocking issues, and what makes a question one of high risk.
ISSUE = r"〔([^：〕]+)：([^〕]+)〕"
HEADER = r"^#{2,3}\s+(.+?)\s*$"
PENDING = r"^-\s+`([^`]+)`"
TERM_MARKS = r"\s*(?:、|，|,|/|\s+或\s+)\s*"
PENDING_SECTION, PENDING_ISSUE = "仍需人工确认", "人工确认"
BLOCKING = ["转写错误", "待核", "信息缺失", "疾病名", "机制表述"]
HIGH_RISK = "剂量|用药|停药|加药|处方|诊断|确诊|治疗|手术|急救|胸痛|呼吸困难|大出血|昏迷|怀孕|妊娠|儿童|婴儿|HIV|艾滋|梅毒|淋病|癌|肿瘤|脑梗|心梗"
#: Terms of an automaton; texts are read once for each block of so many.
BLOCK_TERMS = 65_536
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
UNREVIEWED, AMBIGUOUS, PENDING_SUMMARY = "medical evidence has not been human reviewed", "retrieved evidence contains ambiguous terminology", "retrieved summary is pending review"
PENDING_TERMS, SUMMARY_ONLY, NO_SOURCE = "retrieved evidence contains terminology pending human review", "derived summary requires raw evidence for high-risk answers", "high-risk medical answer lacks raw or human-reviewed evidence"

_trim = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def split_terms(value: Column) -> Column:
    """Distinct terms of a list, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(value, "(?U)" + TERM_MARKS), _trim), lambda x: x != ""))


def review_rules(checklists: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_number, pos, issue_type, severity, terms, section, note): the rules of each checklist.

    A line gives a rule for each `〔kind：terms〕` it holds, and one more for a pending item under the heading for these.
    The section is the last heading up to the line.
    """
    lines = checklists.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), LINE_BREAK)).alias("n", "line"))
    upto = Window.partitionBy("doc_id").orderBy("n")
    title = F.when(F.col("line").rlike("(?U)" + HEADER), F.regexp_extract("line", "(?U)" + HEADER, 1))
    rows = lines.withColumn("section", F.coalesce(F.last(title, ignorenulls=True).over(upto), F.lit("")))
    severity = lambda kind: F.when(F.exists(F.array(*map(F.lit, BLOCKING)), lambda m: F.contains(kind, m)), "block").otherwise("warn")
    issues = F.zip_with(F.regexp_extract_all("line", F.lit(ISSUE), F.lit(1)), F.regexp_extract_all("line", F.lit(ISSUE), F.lit(2)), lambda kind, terms: F.struct(_trim(kind).alias("issue_type"), severity(_trim(kind)).alias("severity"), split_terms(terms).alias("terms")))
    pending = F.when((F.col("section") == PENDING_SECTION) & F.col("line").rlike("(?U)" + PENDING), F.array(F.struct(F.lit(PENDING_ISSUE).alias("issue_type"), F.lit("block").alias("severity"), split_terms(F.regexp_extract("line", "(?U)" + PENDING, 1)).alias("terms"))))
    both = F.concat(issues, F.coalesce(pending, F.array().cast("array<struct<issue_type:string,severity:string,terms:array<string>>>")))
    out = rows.select("doc_id", (F.col("n") + 1).cast("long").alias("line_number"), "section", _trim(F.col("line")).alias("note"), F.posexplode(both).alias("pos", "r"))
    return out.select("doc_id", "line_number", F.col("pos").cast("long").alias("pos"), "r.issue_type", "r.severity", "r.terms", "section", "note")


def rule_counts(rules: DataFrame) -> DataFrame:
    """(doc_id, rule_count, blocking_rule_count, warning_rule_count) of each checklist."""
    return rules.groupBy("doc_id").agg(F.count("*").alias("rule_count"), F.count_if(F.col("severity") == "block").alias("blocking_rule_count"), F.count_if(F.col("severity") == "warn").alias("warning_rule_count"))


def term_finder(terms: list[str]):
    """Batches of (_key, low) to (_key, term), distinct within each batch: which of the terms the texts of a key hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for term in terms:
            automaton.add_word(term, term)
        automaton.make_automaton()
        for batch in batches:
            keys, found = batch.column(0).dictionary_encode("encode"), {}
            for code, low in zip(keys.indices.to_pylist(), batch.column(1)):
                found.setdefault(code, set()).update(term for _, term in automaton.iter(low.as_py()))
            rows = [(code, term) for code, own in found.items() for term in own]
            yield pa.RecordBatch.from_arrays([keys.dictionary.take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.string())], ["_key", "low"])

    return run


def matched_terms(texts: DataFrame, rules: DataFrame, key: str, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(key, severity, terms): the rules' terms of two characters or more that some text of the key holds, case aside, in
    the order of the rules and once each.

    texts: key, text. The distinct lower-case terms come to the driver, a block at a time, and go out with the tasks."""
    wanted = rules.select("severity", "line_number", "pos", F.posexplode("terms").alias("k", "term")).where(F.char_length("term") >= 2)
    wanted = materialize(wanted.groupBy("severity", "term").agg(F.min(F.struct("line_number", "pos", "k")).alias("place")).withColumn("low", F.lower("term")), "terms")
    low = texts.select(F.col(key).alias("_key"), F.lower("text").alias("low")).where(F.char_length("low") >= 2)
    schema, found = f"_key {low.schema['_key'].dataType.simpleString()}, low string", low.limit(0)
    for terms in _blocks(wanted.select("low").distinct(), block_terms):
        found = found.unionByName(low.mapInArrow(term_finder(terms), schema).distinct())
    listed = found.join(wanted, "low").groupBy("_key", "severity").agg(F.array_sort(F.collect_list(F.struct("place", "term"))).alias("t"))
    return listed.select(F.col("_key").alias(key), "severity", F.transform("t", lambda x: x["term"]).alias("terms"))


def _blocks(terms: DataFrame, each: int) -> Iterator[list[str]]:
    block: list[str] = []
    for row in terms.toLocalIterator():
        block.append(row[0])
        if len(block) == each:
            yield block
            block = []
    if block:
        yield block


def safety_gate(questions: DataFrame, results: DataFrame, rules: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """(qid, action, risk_level, reasons, matched_terms) of each question with the results retrieved for it.

    questions: qid, question; results: qid, text, domain, risk_level, chunk_type, quality, answer_policy, source_of_truth,
    nulls as not set; rules: severity, terms and their order; texts: qid, text of the results, where these have none, so
    that texts needn't go through the joins that fields come from. Questions outside the domain and without risk pass; terms
    under a blocking rule block; answers of high risk need raw or reviewed evidence; the rest may warn.
    """
    is_ = lambda c, v: F.coalesce(F.col(c) == v, F.lit(False))
    per = results.groupBy("qid").agg(
        F.bool_or(is_("domain", "medical") | is_("risk_level", "high")).alias("domain"),
        F.bool_or(is_("risk_level", "high")).alias("risk"),
        F.bool_or(is_("quality", "human_reviewed")).alias("reviewed"),
        F.bool_or(is_("chunk_type", "raw_transcript")).alias("raw"),
        F.bool_or(is_("answer_policy", "summary_requires_raw_evidence") & ~F.coalesce(F.col("source_of_truth"), F.lit(False))).alias("summary"),
        F.bool_or(is_("quality", "derived_pending_review")).alias("pending"),
    )
    texts = questions.select("qid", F.col("question").alias("text")).unionByName((results if texts is None else texts).select("qid", "text"))
    terms = matched_terms(texts, rules, "qid").groupBy("qid").agg(*(F.first(F.when(F.col("severity") == s, F.col("terms")), ignorenulls=True).alias(s) for s in ("block", "warn")))
    flags = ["domain", "risk", "reviewed", "raw", "summary", "pending"]
    rows = questions.join(per, "qid", "left").join(terms, "qid", "left").withColumns({f: F.coalesce(F.col(f), F.lit(False)) for f in flags})
    none = F.array().cast("array<string>")
    rows = rows.withColumns({"high": F.col("question").rlike(HIGH_RISK) | F.col("risk"), "block": F.coalesce("block", none), "warn": F.coalesce("warn", none)})
    high, some = F.col("high"), lambda c: F.size(c) > 0
    warned = F.array_compact(F.array(F.when(high & ~F.col("reviewed"), F.lit(UNREVIEWED)), F.when(some("warn"), F.lit(AMBIGUOUS))))
    case = lambda action, risk, reasons, terms=none: F.struct(F.lit(action).alias("action"), risk.alias("risk_level"), reasons.alias("reasons"), terms.alias("matched_terms"))
    level = F.when(high, "high").otherwise("medium")
    decision = (
        F.when(~F.col("domain") & ~high, case("allow", F.lit("low"), none))
        .when(some("block"), case("block", level, F.array(F.lit(PENDING_TERMS)), F.col("block")))
        .when(high & F.col("summary") & ~F.col("raw"), case("block", F.lit("high"), F.array(F.lit(SUMMARY_ONLY))))
        .when(high & ~F.col("reviewed") & ~F.col("raw"), case("block", F.lit("high"), F.array(F.lit(NO_SOURCE))))
        .when(high | some("warn") | F.col("pending"), case("warn", level, F.when(some(warned), warned).otherwise(F.array(F.lit(PENDING_SUMMARY))), F.col("warn")))
        .otherwise(case("allow", F.lit("low"), none))
    )
    return rows.select("qid", decision.alias("d")).select("qid", "d.*")
