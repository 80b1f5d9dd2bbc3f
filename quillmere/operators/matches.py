"""Every question against every row, in blocks: best vectors by inner product, and best sets by shared members.

Rows are dealt to lanes and questions to chunks, both of bounded size; each lane meets each chunk of its key once by a
grouped equi-join, and only the best of a lane leave a task. Lanes follow row counts, so a key that holds a third of all
rows has as many lanes as it needs. Nothing passes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a lane and questions of a chunk, about.
LANE_ROWS, LANE_TEXTS, CHUNK_QUESTIONS = 16_384, 2_048, 512


def dealt(rows: DataFrame, key: list[str], id_col: str, each: int, name: str) -> tuple[DataFrame, DataFrame]:
    """(rows with `name`, a piece of about `each` rows of the key by the hash of their id; key and `_n_<name>`, the number
    of pieces)."""
    pieces = rows.groupBy(*key).agg(F.ceil(F.count("*") / each).cast("long").alias(f"_n_{name}"))
    return rows.join(pieces, key).withColumn(name, F.pmod(F.xxhash64(id_col), f"_n_{name}")).drop(f"_n_{name}"), pieces


def meet(rows: DataFrame, asked: DataFrame, key: list[str], f: Callable[[pa.Table, pa.Table], pa.Table], schema: str, lane_rows: int = LANE_ROWS, chunk: int = CHUNK_QUESTIONS) -> DataFrame:
    """The results of f(lane of rows, chunk of questions) for all lanes and chunks that share a key, which has no nulls."""
    lanes, n_lanes = dealt(rows, key, "doc_id", lane_rows, "_lane")
    chunks, n_chunks = dealt(asked, key, "qid", chunk, "_chunk")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = lanes.join(n_chunks, key).withColumn("_chunk", every("_n__chunk")).drop("_n__chunk")
    right = chunks.join(n_lanes, key).withColumn("_lane", every("_n__lane")).drop("_n__lane")
    by = [*key, "_lane", "_chunk"]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return f(a, b) if a.num_rows and b.num_rows else empty

    empty = pa.table({c.split()[0]: pa.array([], {"long": pa.int64(), "double": pa.float64()}[c.split()[1]]) for c in schema.split(", ")})
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, schema)


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """rows whose vector is set and has only finite components, as doubles, with `_size`, its length."""
    doubles = rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).withColumn(vector, F.col(vector).cast("array<double>"))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return doubles.where(fine).withColumn("_size", F.size(vector).cast("long"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    held = column.combine_chunks()
    return held.flatten().to_numpy(zero_copy_only=False).reshape(len(held), -1)


def best_vectors(vectors: DataFrame, asked: DataFrame, k: int, lane_rows: int = LANE_ROWS, chunk: int = CHUNK_QUESTIONS) -> DataFrame:
    """(grp, qid, doc_id, score): of each question's vectors the k best by inner product within each lane; the k best of
    all are among them.

    vectors: grp, doc_id, embedding; asked: grp, qid, embedding; only vectors of one group and length meet. Null vectors
    and those with null or non-finite components take no part; ties, to six digits, go to the smaller doc_id."""

    def run(rows: pa.Table, own: pa.Table) -> pa.Table:
        docs, ids = rows.column("doc_id").to_numpy(), own.column("qid").to_numpy()
        scores = np.round(_matrix(own.column("embedding")) @ _matrix(rows.column("embedding")).T, 9)
        n = min(k, len(docs))
        out = []
        for s in scores:
            coarse = np.round(s, 6)
            if n < len(s):
                least = np.partition(coarse, len(s) - n)[len(s) - n]
                near = np.flatnonzero(coarse >= least)
            else:
                near = np.arange(len(s))
            out.append(near[np.lexsort((docs[near], -coarse[near]))][:n])
        at = np.concatenate(out)
        grp = pa.array(np.repeat(rows.column("grp").to_numpy()[:1], len(at)))
        return pa.table({"grp": grp, "qid": np.repeat(ids, n), "doc_id": docs[at], "score": scores[np.repeat(np.arange(len(ids)), n), at]})

    pick = lambda df, name: usable(df, "embedding").select(F.col("grp").cast("long").alias("grp"), "_size", F.col(name).cast("long").alias(name), "embedding").where(f"grp is not null and {name} is not null")
    return meet(pick(vectors, "doc_id"), pick(asked, "qid"), ["grp", "_size"], run, "grp long, qid long, doc_id long, score double", lane_rows, chunk)


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    held = column.combine_chunks()
    flat, ends = held.flatten().to_numpy(zero_copy_only=False), held.offsets.to_numpy()
    return [flat[a - ends[0] : z - ends[0]] for a, z in zip(ends, ends[1:])]


def vector_ranks(vectors: DataFrame, asked: DataFrame, candidates: DataFrame, lane_rows: int = LANE_ROWS, chunk: int = CHUNK_QUESTIONS) -> DataFrame:
    """(qid, doc_id, rank): the rank of each candidate among all vectors, by counting better ones; no list of all scores is
    made. vectors: doc_id, embedding; asked: qid, embedding; candidates: qid, doc_id, a bounded number a question. What
    has no usable vector has no rank. Ties as in best_vectors."""
    rows = usable(vectors, "embedding").select("_size", F.col("doc_id").cast("long").alias("doc_id"), "embedding")
    own = usable(asked, "embedding").select("_size", F.col("qid").cast("long").alias("qid"), "embedding")

    def scored(rows: pa.Table, own: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return rows.column("doc_id").to_numpy(), np.round(np.round(_matrix(own.column("embedding")) @ _matrix(rows.column("embedding")).T, 9), 6)

    def find(rows: pa.Table, own: pa.Table) -> pa.Table:
        docs, scores = scored(rows, own)
        out = [np.flatnonzero(np.isin(docs, wanted)) for wanted in _lists(own.column("docs"))]
        row = np.repeat(np.arange(len(out)), [len(x) for x in out])
        at = np.concatenate(out)
        return pa.table({"qid": own.column("qid").to_numpy()[row], "doc_id": docs[at], "score": scores[row, at]})

    def count(rows: pa.Table, own: pa.Table) -> pa.Table:
        docs, scores = scored(rows, own)
        qids, wanted, least = own.column("qid").to_numpy(), _lists(own.column("docs")), _lists(own.column("scores"))
        better = []
        for s, ids, low in zip(scores, wanted, least):
            order = np.argsort(s)
            above = len(s) - np.searchsorted(s[order], low, "right")
            level = [np.count_nonzero(docs[order[a:z]] < i) for a, z, i in zip(np.searchsorted(s[order], low), np.searchsorted(s[order], low, "right"), ids)]
            better.append(above + np.array(level, np.int64))
        return pa.table({"qid": np.repeat(qids, [len(w) for w in wanted]), "doc_id": np.concatenate(wanted), "better": np.concatenate(better)})

    wanted = candidates.groupBy("qid").agg(F.array_sort(F.collect_set(F.col("doc_id").cast("long"))).alias("docs"))
    known = meet(rows, own.join(wanted, "qid"), ["_size"], find, "qid long, doc_id long, score double", lane_rows, chunk)
    listed = known.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("doc_id", "score"))).alias("c")).select("qid", F.col("c.doc_id").alias("docs"), F.col("c.score").alias("scores"))
    counted = meet(rows, own.join(listed, "qid"), ["_size"], count, "qid long, doc_id long, better long", lane_rows, chunk)
    return counted.groupBy("qid", "doc_id").agg((F.sum("better") + 1).alias("rank"))


def best_overlaps(rows: DataFrame, asked: DataFrame, lane_rows: int = LANE_ROWS, chunk: int = CHUNK_QUESTIONS) -> DataFrame:
    """(qid, doc_id, shared): the rows that share most members with each question, all on ties, over all rows.

    rows: doc_id, members; asked: qid, members; arrays of distinct strings. Nothing shared is no row. A lane is an inverted
    list of its rows; a question adds up the lists of its members."""

    def run(lane: pa.Table, own: pa.Table) -> pa.Table:
        docs, held = lane.column("doc_id").to_numpy(), lane.column("members").combine_chunks()
        coded = held.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(docs)), np.diff(held.offsets.to_numpy()))
        order = np.argsort(codes, kind="stable")
        row = row[order]
        ends = np.searchsorted(codes[order], np.arange(len(coded.dictionary) + 1))
        number = {m: i for i, m in enumerate(coded.dictionary.to_pylist())}
        out: list[tuple] = []
        for qid, members in zip(own.column("qid").to_pylist(), own.column("members").to_pylist()):
            lists = [row[ends[i] : ends[i + 1]] for m in members if (i := number.get(m)) is not None]
            if lists:
                shared = np.bincount(np.concatenate(lists), minlength=len(docs))
                top = shared.max()
                out += [(qid, int(docs[i]), int(top)) for i in np.flatnonzero(shared == top)]
        return pa.table({c: pa.array([r[i] for r in out], pa.int64()) for i, c in enumerate(("qid", "doc_id", "shared"))})

    pick = lambda df, name: df.select(F.lit(0).cast("long").alias("_k"), F.col(name).cast("long").alias(name), F.coalesce("members", F.array().cast("array<string>")).alias("members")).where(f"{name} is not null")
    found = meet(pick(rows, "doc_id"), pick(asked, "qid"), ["_k"], run, "qid long, doc_id long, shared long", lane_rows, chunk)
    best = found.groupBy("qid").agg(F.max("shared").alias("_top"))
    return found.join(best, "qid").where(F.col("shared") == F.col("_top")).drop("_top")
