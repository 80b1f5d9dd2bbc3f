"""Notes and transcripts cut for retrieval: heading sections, merged short sections, packed sentences, source blocks, windows.

Rules that only look at neighbours are window functions. Greedy rules, where each cut depends on the last one, are small
folds over the lengths of one document's lines; the texts themselves stay in SQL.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trim_all

#: Longest chunk and shortest section of their own, and the form of a source reference.
MAX_CHARS, MIN_CHARS, REF = 600, 80, r"\b(S\d{4})\b"
SENTENCE_END = r"(?<=[。！？.\n])"


def refs_of(text: Column) -> Column:
    """Distinct source references of a text, as they first occur."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(REF), F.lit(1)))


def sections(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, section, body): the parts under `##` and `###` headings; a `###` part is named `parent > title`. What
    stands before the first heading is no section."""
    parts = docs.select("doc_id", F.posexplode(F.split("text", r"(?m)^(?=#{2,3}\s)")).alias("pos", "part"))
    head = r"^(#{2,3})\s+([^\n]+?)\s*(?:\n|$)"
    rows = parts.select("doc_id", F.col("pos").cast("long").alias("pos"), F.regexp_extract("part", head, 1).alias("level"), F.regexp_extract("part", head, 2).alias("title"), trim_all(F.regexp_replace("part", r"^[^\n]*\n?", "")).alias("body"))
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    parent = F.last(F.when(F.col("level") == "##", F.col("title")), ignorenulls=True).over(before)
    name = F.when((F.col("level") == "###") & parent.isNotNull(), F.concat(parent, F.lit(" > "), "title")).otherwise(F.col("title"))
    return rows.withColumn("section", name).where("level <> ''").select("doc_id", "pos", "section", "body")


def merged_sections(parts: DataFrame) -> DataFrame:
    """(doc_id, chunk, section, content, refs): a section with a body under MIN_CHARS and no references joins the chunk
    before it, if there is one. Empty sections and those named Transcript are left out; references are the first's."""
    content = F.concat(F.lit("## "), F.col("section"), F.lit("\n"), F.col("body"))
    rows = parts.where((F.lower("section") != "transcript") & (F.col("body") != "")).withColumn("content", content)
    order = Window.partitionBy("doc_id").orderBy("pos")
    joins = (F.char_length("body") < MIN_CHARS) & (F.size(refs_of(F.col("content"))) == 0) & (F.row_number().over(order) > 1)
    rows = rows.withColumn("_new", F.when(joins, 0).otherwise(1)).withColumn("chunk", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    held = F.array_sort(F.collect_list(F.struct("pos", "section", "content")))
    grouped = rows.groupBy("doc_id", "chunk").agg(held.alias("held"))
    pick = lambda field, by: F.array_join(F.transform("held", lambda x: x[field]), by)
    return grouped.select("doc_id", "chunk", pick("section", " + ").alias("section"), pick("content", "\n\n").alias("content"), refs_of(F.col("held")[0]["content"]).alias("refs"))


def sentence_runs(sizes: list[int], limit: int) -> list[tuple[int, int, int]]:
    """(first, last, cut) of each chunk of sentences with these lengths: from `first` to `last`, or, where cut is not -1,
    the piece of one overlong sentence that begins there. A chunk begins with the last sentence of the one before where
    both fit together; nothing overlaps an overlong sentence."""
    runs, first, total = [], None, 0
    for i, n in enumerate(sizes):
        if n > limit:
            runs += [(i, i, k) for k in range(0, n, limit)]
            first = None
        elif first is not None and total + n <= limit:
            total += n
            runs[-1] = (first, i, -1)
        else:
            again = 0 if first is None or sizes[i - 1] + n > limit else sizes[i - 1]
            first, total = (i - 1 if again else i), again + n
            runs.append((first, i, -1))
    return runs


def packed_text(text: str | None, limit: int) -> list[str]:
    """The chunks of one text."""
    own = [x for x in (part.strip(" \t\n\r") for part in re.split(SENTENCE_END, text or "")) if x]
    return ["".join(own[first : last + 1]) if cut < 0 else own[first][cut : cut + limit] for first, last, cut in sentence_runs([len(x) for x in own], limit)]


def packed(rows: DataFrame, text: str = "text", limit: int = MAX_CHARS) -> DataFrame:
    """rows with `piece` (from 0) and `chunk`: the text's sentences packed into chunks of up to `limit` characters."""

    @F.pandas_udf("array<string>")
    def chunks(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: packed_text(x, limit))

    out = rows.select(*rows.columns, F.posexplode(chunks(F.coalesce(F.col(text), F.lit("")))).alias("piece", "chunk"))
    return out.withColumn("piece", F.col("piece").cast("long"))


def section_chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, chunk, piece, section, content, refs): merged sections, those over MAX_CHARS packed by sentences; a piece
    without references of its own has its section's."""
    merged = merged_sections(sections(docs))
    short = merged.where(F.char_length("content") <= MAX_CHARS).select("doc_id", "chunk", F.lit(0).cast("long").alias("piece"), "section", "content", "refs")
    long = packed(merged.where(F.char_length("content") > MAX_CHARS).withColumnRenamed("chunk", "_c"), "content")
    own = refs_of(F.col("chunk"))
    long = long.select("doc_id", F.col("_c").alias("chunk"), "piece", "section", F.col("chunk").alias("content"), F.when(F.size(own) > 0, own).otherwise(F.col("refs")).alias("refs"))
    return short.unionByName(long)


def line_groups(sizes: list[int], limit: int) -> list[int]:
    """The group of each line where a group's lines, joined by one separator each, have up to `limit` characters."""
    out, total = [], 0
    for n in sizes:
        fits = bool(out) and total + 1 + n <= limit
        total = total + 1 + n if fits else n
        out.append((out[-1] if out else 0) + (not fits))
    return out


def block_groups(sizes: list[int], starts: list[float], ends: list[float], timed: list[bool], max_chars: int, max_seconds: float, max_gap: float) -> list[int]:
    """The source block of each line: a line opens a new one where it would pass max_chars, comes more than max_gap after
    the line before, or would make the block longer than max_seconds. Times don't count for lines without them."""
    out, chars, since = [], 0, 0.0
    for i, n in enumerate(sizes):
        late = i > 0 and timed[i] and (starts[i] - ends[i - 1] > max_gap or ends[i] - since > max_seconds)
        new = i == 0 or late or chars + 1 + n > max_chars
        chars, since = (n, starts[i]) if new else (chars + (1 if chars else 0) + n, since)
        out.append((out[-1] if out else 0) + new)
    return out


def window_bounds(sizes: list[int], starts: list[float], ends: list[float], timed: list[bool], seconds: float, max_chars: int, overlap: float) -> list[tuple[int, int, int]]:
    """(context, first, last) of each window over blocks: each block is primary once, context goes back while blocks end
    no more than `overlap` before the window's first."""
    out: list[tuple[int, int, int]] = []
    chars = 0
    for i, n in enumerate(sizes):
        first = out[-1][1] if out else 0
        if not out or chars + (1 if chars else 0) + n > max_chars or (timed[i] and ends[i] - starts[first] > seconds):
            context = i
            while timed[i] and context > 0 and starts[i] - ends[context - 1] <= overlap:
                context -= 1
            out.append((context, i, i))
            chars = n
        else:
            out[-1] = (*out[-1][:2], i)
            chars += (1 if chars else 0) + n
    return out


def _lines(rows: DataFrame, key: str) -> DataFrame:
    """Each document's lines in order, as one array; a document is the unit that cuts are made in."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "start", "end", "text", "timed"))).alias("lines"))


def _sizes(lines: str) -> list[Column]:
    return [F.transform(lines, lambda x: F.char_length(x["text"])), *(F.col(f"{lines}.{f}") for f in ("start", "end", "timed"))]


def raw_chunks(rows: DataFrame, key: str) -> DataFrame:
    """(key, chunk, first_ref, last_ref, start, end, content): numbered transcript lines packed up to MAX_CHARS.

    rows: key, pos, start, end, text, timed.
    """

    @F.pandas_udf("array<int>")
    def groups(sizes: pd.Series) -> pd.Series:
        return sizes.map(lambda own: line_groups(list(own), MAX_CHARS))

    ref = lambda i: F.format_string("S%04d", i + 1)
    line = lambda x, i: F.concat(F.lit("["), ref(i), F.format_string(" %.2fs-%.2fs] ", x["start"], x["end"]), x["text"])
    held = _lines(rows, key).withColumn("_t", F.transform("lines", line)).withColumn("_g", groups(F.transform("_t", F.char_length)))
    out = held.select(key, F.posexplode(F.arrays_zip("lines", "_t", "_g")).alias("i", "x")).select(key, "i", F.col("x._g").cast("long").alias("chunk"), "x.lines", F.col("x._t").alias("t"))
    inside = F.array_sort(F.collect_list(F.struct("i", "t")))
    return out.groupBy(key, "chunk").agg(ref(F.min("i")).alias("first_ref"), ref(F.max("i")).alias("last_ref"), F.min_by("lines.start", "i").alias("start"), F.max_by("lines.end", "i").alias("end"), F.array_join(F.transform(inside, lambda x: x["t"]), "\n").alias("content"))


def source_blocks(rows: DataFrame, key: str, max_chars: int = 400, max_seconds: float = 30.0, max_gap: float = 5.0) -> DataFrame:
    """(key, block, ref_id, start, end, text, timed) of transcript lines; rows: key, pos, start, end, text, timed."""

    @F.pandas_udf("array<int>")
    def groups(sizes: pd.Series, starts: pd.Series, ends: pd.Series, timed: pd.Series) -> pd.Series:
        return pd.Series([block_groups(list(a), list(b), list(c), list(d), max_chars, max_seconds, max_gap) for a, b, c, d in zip(sizes, starts, ends, timed)])

    held = _lines(rows, key).withColumn("_g", groups(*_sizes("lines")))
    out = held.select(key, F.explode(F.arrays_zip("lines", "_g")).alias("x")).select(key, F.col("x._g").cast("long").alias("block"), "x.lines.*")
    inside = F.array_sort(F.collect_list(F.struct("pos", "text")))
    grouped = out.groupBy(key, "block").agg(F.min_by("start", "pos").alias("start"), F.max_by("end", "pos").alias("end"), F.array_join(F.transform(inside, lambda x: x["text"]), "\n").alias("text"), F.bool_and("timed").alias("timed"))
    return grouped.withColumn("ref_id", F.format_string("S%04d", "block"))


def transcript_windows(blocks: DataFrame, key: str, seconds: float = 240.0, max_chars: int = 4800, overlap: float = 20.0) -> DataFrame:
    """(key, window_id, context_ref, first_ref, last_ref): windows over source blocks; blocks from context_ref up to the one
    before first_ref are context only."""

    @F.pandas_udf("array<struct<context:int,first:int,last:int>>")
    def cut(sizes: pd.Series, starts: pd.Series, ends: pd.Series, timed: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("context", "first", "last"), w)) for w in window_bounds(list(a), list(b), list(c), list(d), seconds, max_chars, overlap)] for a, b, c, d in zip(sizes, starts, ends, timed)])

    held = _lines(blocks.withColumnRenamed("block", "pos"), key).withColumn("_w", cut(*_sizes("lines")))
    ref = lambda f: F.format_string("S%04d", F.col(f"w.{f}") + 1)
    return held.select(key, F.posexplode("_w").alias("i", "w")).select(key, F.format_string("W%03d", F.col("i") + 1).alias("window_id"), ref("context").alias("context_ref"), ref("first").alias("first_ref"), ref("last").alias("last_ref"))
