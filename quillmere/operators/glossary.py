"""Glossary hints in transcripts: aliases found by one automaton, gated by context, marked reversibly.

Each text is one pass of the automaton, and everything after it is linear in the places found. A narrow map: nothing is
shuffled, and no text is joined to itself.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Characters looked at on either side, the form of a mark, and that of a line's times.
CONTEXT_CHARS = 120
MARK_OPEN, MARK_NOTE, MARK_CLOSE = "〔疑似术语：", "；", "〕"
LINE_TIMES = re.compile(r"\[(\d+(?:\.\d+)?)s\s*->\s*(\d+(?:\.\d+)?)s\]")

RECORD = {"start_char": "int", "end_char": "int", "canonical": "string", "entry": "int", "alias": "int", "original": "string", "candidate": "string", "note": "string", "matched_contexts": "array<string>", "segment_start": "double", "segment_end": "double", "grounded": "boolean", "marked": "boolean"}
_ARROW = {"int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def glossary_entries(rows: DataFrame) -> DataFrame:
    """(entry, canonical, candidate, aliases, context, note): usable entries in order.

    rows: pos, canonical, candidate, aliases, context, note. Canonical and candidate stand in for each other, blanks are
    trimmed, blank aliases and contexts dropped; an entry without names or with null aliases is none, and one with the
    canonical and aliases of an earlier one is left out.
    """
    trim = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")
    listed = lambda c: F.filter(F.transform(c, trim), lambda x: x != "")
    named = F.nullif(F.col("canonical"), F.lit(""))
    other = F.nullif(F.col("candidate"), F.lit(""))
    first = rows.select("pos", trim(F.coalesce(named, other)).alias("canonical"), trim(F.coalesce(other, named)).alias("candidate"), listed(F.col("aliases")).alias("aliases"), listed(F.coalesce(F.col("context"), F.array().cast("array<string>"))).alias("context"), trim(F.col("note")).alias("note"))
    good = first.where((F.col("canonical") != "") & (F.col("candidate") != "") & F.col("aliases").isNotNull())
    firsts = good.groupBy("canonical", "aliases").agg(F.min_by(F.struct("pos", "candidate", "context", "note"), "pos").alias("e"))
    return firsts.select(F.col("e.pos").alias("entry"), "canonical", "e.candidate", "aliases", "e.context", "e.note")


class LineTimes:
    """Start and end of the `[1.0s -> 2.0s]` mark that the line of a place begins with."""

    def __init__(self, text: str):
        self.text, self.starts, self.known = text, [0, *(m.end() for m in re.finditer("\n", text))], {}

    def of(self, place: int) -> tuple[float | None, float | None]:
        line = bisect_right(self.starts, place) - 1
        if line not in self.known:
            m = LINE_TIMES.match(self.text, self.starts[line])
            whole = m and (line + 1 == len(self.starts) or m.end() < self.starts[line + 1])
            self.known[line] = (float(m[1]), float(m[2])) if whole else (None, None)
        return self.known[line]


class Taken:
    """Places that are marked already; none overlap."""

    def __init__(self):
        self.starts, self.ends = [], []

    def add(self, a: int, z: int) -> bool:
        """Takes a place if it is free."""
        k = bisect_left(self.starts, z)
        if k and self.ends[k - 1] > a:
            return False
        self.starts.insert(k, a)
        self.ends.insert(k, z)
        return True


def records_of(text: str, automaton: ahocorasick.Automaton, owners: dict[str, list[tuple]]) -> list[dict]:
    """All places of each alias, those of one alias not overlapping, by place and canonical."""
    found, upto, times = [], {}, LineTimes(text)
    for last, alias in automaton.iter(text) if owners else ():
        start, end = last + 1 - len(alias), last + 1
        if start < upto.get(alias, 0):
            continue
        upto[alias] = end
        around = text[max(0, start - CONTEXT_CHARS) : start] + text[end : end + CONTEXT_CHARS]
        for entry, k, canonical, candidate, context, note in owners[alias]:
            matched = [c for c in context if c in around]
            found.append(dict(zip(RECORD, (start, end, canonical, entry, k, alias, candidate, note, matched, *times.of(start), bool(matched) or not context, False))))
    taken = Taken()
    for r in sorted(found, key=lambda r: (r["entry"], r["alias"], r["start_char"])):
        r["marked"] = r["grounded"] and taken.add(r["start_char"], r["end_char"])
    return sorted(found, key=lambda r: (r["start_char"], r["end_char"], r["canonical"], r["entry"], r["alias"]))


def alias_records(docs: DataFrame, entries: list, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, records): one record a place, by place and canonical. A place is grounded where the entry names no
    context or some of it stands within 120 characters on either side. Records that are marked in the text have `marked`:
    grounded ones, in the order of entries, aliases and places, that don't overlap one marked before.

    entries: rows of glossary_entries, which come to the driver; a glossary is written by hand. A null text has no records.
    """
    owners: dict[str, list[tuple]] = {}
    for e in sorted(entries, key=lambda e: e["entry"]):
        for k, alias in enumerate(e["aliases"]):
            owners.setdefault(alias, []).append((e["entry"], k, e["canonical"], e["candidate"], list(e["context"]), e["note"]))
    kind = pa.list_(pa.struct([(c, _ARROW[t]) for c, t in RECORD.items()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for alias in owners:
            automaton.add_word(alias, alias)
        automaton.make_automaton()
        for batch in batches:
            found = [records_of(text or "", automaton, owners) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, kind)], ["doc_id", "text", "records"])

    fields = ",".join(f"{c}:{t}" for c, t in RECORD.items())
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, text string, records array<struct<{fields}>>")


def _marks(records: Column) -> tuple[Column, Column]:
    """Ends and marks of the marked records, in order, as two arrays."""
    marked = F.filter(records, lambda r: r["marked"])
    note = lambda r: F.when(r["note"] != "", F.concat(F.lit(MARK_NOTE), r["note"])).otherwise("")
    return F.transform(marked, lambda r: r["end_char"]), F.transform(marked, lambda r: F.concat(F.lit(MARK_OPEN), r["candidate"], note(r), F.lit(MARK_CLOSE)))


@F.pandas_udf(StringType())
def _with_marks(text: pd.Series, ends: pd.Series, marks: pd.Series) -> pd.Series:
    def one(t: str, e: list, m: list) -> str:
        cuts = [0, *e]
        return "".join(t[a:z] + x for a, z, x in zip(cuts, e, m)) + t[cuts[-1] :]

    return pd.Series([None if t is None else one(t, list(e), list(m)) for t, e, m in zip(text, ends, marks)])


@F.pandas_udf(StringType())
def _without_marks(text: pd.Series, ends: pd.Series, marks: pd.Series) -> pd.Series:
    def one(t: str, e: list, m: list) -> str:
        out, at, more = [], 0, 0
        for end, mark in zip(e, m):
            out.append(t[at : end + more])
            more += len(mark)
            at = end + more
        return "".join(out) + t[at:]

    return pd.Series([None if t is None else one(t, list(e), list(m)) for t, e, m in zip(text, ends, marks)])


def annotated(records: DataFrame) -> DataFrame:
    """records with `annotated`: the text with a mark after each marked alias."""
    return records.withColumn("annotated", _with_marks("text", *_marks(F.col("records"))))


def restored(rows: DataFrame) -> DataFrame:
    """rows with `restored`: the annotated text without the marks that the records tell of, which is the text again."""
    return rows.withColumn("restored", _without_marks("annotated", *_marks(F.col("records"))))


def corrections(records: DataFrame) -> DataFrame:
    """(doc_id, start_char, end_char, ..., confidence, action, review_needed): one row a record."""
    rows = records.select("doc_id", F.explode("records").alias("r")).select("doc_id", "r.*")
    return rows.withColumns({"confidence": F.when(F.col("grounded"), "medium").otherwise("low"), "action": F.when(F.col("grounded"), "annotated").otherwise("retained"), "review_needed": F.col("grounded")})
