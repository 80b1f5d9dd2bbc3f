"""Transcript segments: cleaning, islands in time without a window over a whole key, and removal of near duplicates.

Rows of a key are dealt to cells of time. Each cell's summary (one row) is carried to the next cells of its key, and rows
are then ordered within their cell only, so a key that holds a third of all rows is as many groups as it has cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .matches import best_vectors

#: Kept segments a new one is compared with, similarity that alone makes a duplicate, and that of segments
#: that overlap for long.
LAST_KEPT, SAME_TEXT, SAME_TEXT_AND_TIME = 4, 0.9, 0.78
CELL_SECONDS = 600.0


def clean_segments(segments: DataFrame, start: str = "start", end: str = "end", text: str = "text") -> DataFrame:
    """Segments with trimmed text, without blank ones, times rounded to hundredths (halves to even)."""
    trimmed = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    rows = segments.withColumns({text: trimmed, start: F.bround(start, 2), end: F.bround(end, 2)})
    return rows.where(F.col(text) != "")


def carried_max(rows: DataFrame, key: list[str], cell: Column, order: list, value: Column, name: str, inclusive: bool = False) -> DataFrame:
    """rows with `name`: the largest value of the key's rows before each row (inclusive: or in it), null if there is none.

    `cell` must not fall as `order` goes on. Rows with a null key or cell are left out."""
    held = rows.withColumns({"_cell": cell, "_value": value})
    tops = held.groupBy(*key, "_cell").agg(F.max("_value").alias("_top"))
    cells = Window.partitionBy(*key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    before = tops.select(*key, "_cell", F.max("_top").over(cells).alias("_before"))
    inside = Window.partitionBy(*key, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return held.join(before, [*key, "_cell"]).withColumn(name, F.greatest("_before", F.max("_value").over(inside))).drop("_cell", "_value", "_before")


def islands(rows: DataFrame, key: list[str], start: str, end: str, tie: str, width: float = CELL_SECONDS) -> DataFrame:
    """rows with `island`: the start of the first row of the stretch of rows that overlap one another; a row that starts
    where all before it have ended begins a new one."""
    cell, order = F.floor(F.col(start) / width), [start, end, tie]
    reached = carried_max(rows, key, cell, order, F.col(end), "_reach")
    begins = F.when(F.col("_reach").isNull() | (F.col("_reach") <= F.col(start)), F.col(start))
    return carried_max(reached, key, cell, order, begins, "island", inclusive=True).drop("_reach")


def text_ratio_reaches(a: str, b: str, least: float) -> bool:
    """Whether the matching-blocks ratio of two texts is at least `least`; cheap upper bounds (lengths, then shared
    characters) come first."""
    m = SequenceMatcher(None, a, b)
    return m.real_quick_ratio() >= least and m.quick_ratio() >= least and m.ratio() >= least


def same_segment(a: tuple[float, float, str], b: tuple[float, float, str]) -> bool:
    """Whether segment b repeats segment a: they overlap in time, and one text holds the other or is much like it. Texts
    come without white space."""
    overlap = min(a[1], b[1]) - max(a[0], b[0])
    if overlap <= 0 or not a[2] or not b[2]:
        return False
    if a[2] in b[2] or b[2] in a[2]:
        return True
    half = min(a[1] - a[0], b[1] - b[0]) * 0.5
    return text_ratio_reaches(a[2], b[2], SAME_TEXT_AND_TIME if overlap >= min(2.0, max(0.5, half)) else SAME_TEXT)


def dedup_segments(segments: DataFrame, key: str, tie: str, start: str = "start", end: str = "end", text: str = "text") -> DataFrame:
    """The segments of each key, by start, end and tie, without those that repeat one of the last four kept.

    Only segments that overlap can be duplicates, so islands of overlapping segments are independent: each is streamed in
    order through one task that holds four segments, and a key's islands are dealt to all tasks. Segments with a null key
    or time are left out; null texts repeat nothing.
    """
    rows = segments.where(F.col(key).isNotNull() & F.col(start).isNotNull() & F.col(end).isNotNull())
    dealt = islands(rows, [key], start, end, tie).withColumn("_bare", F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?U)\s+", ""))
    ordered = dealt.repartition(key, "island").sortWithinPartitions(key, "island", start, end, tie)
    places = [ordered.columns.index(c) for c in (key, "island", start, end, "_bare")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, kept = None, []
        for batch in batches:
            good = []
            for k, island, a, z, bare in zip(*(batch.column(p).to_pylist() for p in places)):
                if (k, island) != current:
                    current, kept = (k, island), []
                own = (a, z, bare)
                good.append(not any(same_segment(x, own) for x in kept))
                if good[-1]:
                    kept = [*kept[1 - LAST_KEPT :], own] if len(kept) >= LAST_KEPT else [*kept, own]
            yield batch.filter(pa.array(good, pa.bool_()))

    return ordered.mapInArrow(run, ordered.schema).select(*segments.columns)


#: Segments that a chunk is aligned with at most, and the gap that parts them.
ALIGNED, APART_SECONDS = 8, 20.0


def align_time(chunks: DataFrame, segments: DataFrame) -> DataFrame:
    """(grp, chunk, start, end, n_segments): the time of each chunk by the segments that its vector is nearest to.

    chunks: grp, chunk, embedding; segments: grp, pos, start, end, embedding; a group is a document. Of a chunk's eight best
    segments in its document, ties to the earlier, the largest run counts (the first on ties): segments in order, less than
    20 seconds from the end of one to the start of the next. Chunks without a segment have null times.
    """
    found = best_vectors(segments.select("grp", F.col("pos").alias("doc_id"), "embedding"), chunks.select("grp", F.col("chunk").alias("qid"), "embedding"), ALIGNED)
    best = Window.partitionBy("grp", "qid").orderBy(F.desc(F.round("score", 6)), "doc_id")
    top = found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= ALIGNED).select("grp", F.col("qid").alias("chunk"), F.col("doc_id").alias("pos"))
    timed = top.join(segments.select("grp", "pos", "start", "end"), ["grp", "pos"])
    order = Window.partitionBy("grp", "chunk").orderBy("pos")  # eight rows at most
    apart = F.col("start") - F.lag("end").over(order) >= APART_SECONDS
    runs = timed.withColumn("_new", F.coalesce(apart, F.lit(False)).cast("int")).withColumn("_run", F.sum("_new").over(order))
    sized = runs.groupBy("grp", "chunk", "_run").agg(F.count("*").alias("n_segments"), F.min_by("start", "pos").alias("start"), F.max_by("end", "pos").alias("end"))
    largest = sized.groupBy("grp", "chunk").agg(F.max_by(F.struct("start", "end", "n_segments"), F.struct("n_segments", -F.col("_run"))).alias("r"))
    return chunks.select("grp", "chunk").join(largest, ["grp", "chunk"], "left").select("grp", "chunk", "r.start", "r.end", F.coalesce("r.n_segments", F.lit(0)).alias("n_segments"))
