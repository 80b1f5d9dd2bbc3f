"""Segments on a time line: line parsing, gap filling, runs, interval merging, range joins, blocks and windows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clock_seconds, squeeze, trim_all


def line_segments(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, line): the non-blank lines of each text that aren't comments, from 0 over all lines."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    kept = rows.select("doc_id", F.col("pos").cast("long").alias("pos"), trim_all(F.col("line")).alias("line"))
    return kept.where((F.col("line") != "") & ~F.col("line").startswith("#"))


def transcript_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, start, end, text, has_timestamp) of `[1.0s -> 2.0s] text` lines.

    Where a text has timestamped lines its plain lines are dropped; else all are kept without times.
    """
    form = r"^\[(\d+(?:\.\d+)?)s\s*->\s*(\d+(?:\.\d+)?)s\]\s*(.*)$"
    lines = line_segments(docs)
    start = F.regexp_extract("line", form, 1)
    rows = lines.select("doc_id", "pos", start.try_cast("double").alias("start"), F.regexp_extract("line", form, 2).try_cast("double").alias("end"), F.when(start != "", F.regexp_extract("line", form, 3)).otherwise(F.col("line")).alias("text"), (start != "").alias("has_timestamp"))
    timed = F.max("has_timestamp").over(Window.partitionBy("doc_id"))
    return rows.withColumn("_timed", timed).where(F.col("has_timestamp") | ~F.col("_timed")).drop("_timed")


def subtitle_cues(docs: DataFrame) -> DataFrame:
    """(doc_id, cue, start, end, text) of SRT and WebVTT texts.

    Cues without length are dropped, and so is a cue equal in text and start to the one before. Blocks are parted by
    blank lines; a block without a timing line (headers, notes, styles) is no cue.
    """
    blocks = docs.select("doc_id", F.posexplode(F.split(F.regexp_replace("text", "\r\n?", "\n"), r"\n[ \t]*\n+")).alias("pos", "block"))
    timing = r"(?m)^[ \t]*([0-9:.,]+)[ \t]*-->[ \t]*([0-9:.,]+)[^\n]*$"
    body = F.regexp_extract("block", r"(?s)-->[^\n]*\n(.*)$", 1)
    clean = squeeze(F.regexp_replace(F.array_join(F.split(body, "\n"), " "), "<[^>]*>", ""))
    cues = blocks.select("doc_id", "pos", clock_seconds(F.regexp_extract("block", timing, 1)).alias("start"), clock_seconds(F.regexp_extract("block", timing, 2)).alias("end"), clean.alias("text"))
    cues = cues.where((F.col("end") > F.col("start")) & (F.col("text") != ""))
    order = Window.partitionBy("doc_id").orderBy("pos")
    same = F.lag("text").over(order).eqNullSafe(F.col("text")) & F.lag("start").over(order).eqNullSafe(F.col("start"))
    kept = cues.withColumn("_same", same).where(~F.col("_same"))
    return kept.select("doc_id", (F.row_number().over(order) - 1).cast("long").alias("cue"), "start", "end", "text")


def fill_ends(rows: DataFrame, key: str, start: str, tie: str) -> DataFrame:
    """Adds `end`: the next row's start within the key, or the own start for the last."""
    order = Window.partitionBy(key).orderBy(start, tie)
    return rows.withColumn("end", F.coalesce(F.lead(start).over(order), F.col(start)))


def runs(rows: DataFrame, key: str, at: Column, tie: str, gap: float) -> DataFrame:
    """Adds `run`: numbers within the key that grow where the step from the row before reaches the gap."""
    order = Window.partitionBy(key).orderBy("_at", tie)
    stepped = rows.withColumn("_at", at).withColumn("_new", F.when(F.col("_at") - F.lag("_at").over(order) < gap, 0).otherwise(1))
    return stepped.withColumn("run", F.sum("_new").over(order)).drop("_new", "_at")


def longest_run(rows: DataFrame, key: str, at: Column, tie: str, gap: float) -> DataFrame:
    """(key, start, end, n) of the key's longest run, the first on ties."""
    runs_of = runs(rows.withColumn("_t", at), key, F.col("_t"), tie, gap)
    sized = runs_of.groupBy(key, "run").agg(F.min("_t").alias("start"), F.max("_t").alias("end"), F.count("*").alias("n"))
    order = Window.partitionBy(key).orderBy(F.desc("n"), "run")
    return sized.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(key, "start", "end", "n")


def merge_intervals(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, start, end, n): unions of overlapping or touching intervals."""
    order = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_new", F.when(F.col(start) <= reach, 0).otherwise(1)).withColumn("_group", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "_group").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n")).drop("_group")


def overlap_join(points: DataFrame, ranges: DataFrame, key: str, at: str, start: str, end: str, width: float) -> DataFrame:
    """Rows of points inside ranges of the same key. Both sides are dealt to cells of `width`, so that the join is an
    equi-join on key and cell however many points a key has; a range goes to the cells that it touches."""
    a = points.withColumn("_cell", F.floor(F.col(at) / width))
    cells = F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))
    b = ranges.withColumn("_cell", F.explode(cells))
    return a.join(b, [key, "_cell"]).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("_cell")


def nearest(points: DataFrame, key: str, at: str, tie: str, kind: Column) -> DataFrame:
    """For rows where `kind` is false, the tie value of the key's nearest earlier-or-equal row where it is true, or null."""
    order = Window.partitionBy(key).orderBy(at, tie).rowsBetween(Window.unboundedPreceding, 0)
    return points.withColumn("_k", kind).withColumn("nearest", F.last(F.when(F.col("_k"), F.col(tie)), ignorenulls=True).over(order)).where(~F.col("_k")).drop("_k")


def fixed_windows(rows: DataFrame, length: str, size: int, step: int) -> DataFrame:
    """Windows [w_start, w_end) of `size` every `step` over each row's length; the last ends with it."""
    n = F.col(length)
    starts = F.when(n > 0, F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0).cast("long")), F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return rows.withColumn("w_start", F.explode(starts)).withColumn("w_end", F.least(F.col("w_start") + size, n))


def source_blocks(rows: DataFrame, key: str, pos: str, text: str, max_chars: int) -> DataFrame:
    """(key, block, first_pos, last_pos, n_chars): lines packed in order; a line that would take the block (with one
    separator a line) over max_chars opens the next. One group is one document's lines."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        out, size = [], 0
        for p, n in zip(pdf["pos"], pdf["n"]):
            if out and size + 1 + n <= max_chars:
                size += 1 + n
                out[-1][3], out[-1][4] = p, size
            else:
                size = n
                out.append([pdf["key"].iloc[0], len(out), p, p, n])
        return pd.DataFrame(out, columns=["key", "block", "first_pos", "last_pos", "n_chars"])

    picked = rows.select(F.col(key).cast("long").alias("key"), F.col(pos).cast("long").alias("pos"), F.char_length(text).cast("long").alias("n"))
    return picked.groupBy("key").applyInPandas(pack, "key long, block long, first_pos long, last_pos long, n_chars long").withColumnRenamed("key", key)


def html_text(html: Column) -> Column:
    """Visible text of a page: scripts, styles, comments and tags dropped, white space squeezed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return squeeze(F.regexp_replace(F.regexp_replace(bare, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " "))


def language_rank(lang: Column, preferred: list[str]) -> Column:
    """Twice the index of the first preferred language that matches exactly, else of the first of its family plus one;
    twice the list's length where none does."""
    exact = F.array_position(F.array(*map(F.lit, preferred)), lang)
    family = F.array_position(F.array(*(F.lit(p.split("-")[0]) for p in preferred)), F.split(lang, "-")[0])
    return F.when(exact > 0, (exact - 1) * 2).when(family > 0, (family - 1) * 2 + 1).otherwise(2 * len(preferred)).cast("long")
