"""Exact top-k inner-product search over a bit-sliced index.

Components are quantised to integers. The index holds blocks of rows; within a block, each bit of each dimension is one
bitmap over the block's rows. A query's score is a sum of such bitmaps with powers of two as weights (complemented ones
where the query's component is negative); bitmaps of equal weight are added three at a time by carry-save steps, carries
going to the next weight, until one result bitmap a weight is left. The top rows are selected from the most significant
result bitmap downward; rows that tie at the boundary are resolved by the smaller id. Nothing is approximate.

The stated query set meets all rows block by block: query chunks are replicated to the blocks by an equi-join, every
block returns k rows a query at most, and a last ranking merges them.

Defined results: vectors that are null or hold null or non-finite components, and rows without an id, take no part; a
vector meets only vectors of its own length; rows with the query's id are no candidates for it; a repeated query row is
answered each time; fewer candidates than k give all of them; an empty table gives an empty result; extra columns are
ignored. Finite components of any size take part as long as no score can pass 64 bits; a table where one could is refused
with an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of an index block, and queries that travel together.
BLOCK_ROWS, CHUNK_QUERIES = 16384, 64
#: Copies of each block that work on different query chunks.
SLOTS = 8
#: Bound of a quantised component, so that differences fit 64 bits.
MOST = 1 << 61
INDEX_SCHEMA = "block int, dims int, rows int, bits int, ids binary, low binary, slices binary"
CHUNK_SCHEMA = "dims int, ids binary, vectors binary"


def build_block(ids: np.ndarray, values: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(bits, ids, low, slices) of a block: slices[j, b] is the bitmap of bit b of values[:, j] - low[j]."""
    order = np.argsort(ids, kind="stable")
    ids, values = ids[order], values[order]
    low = values.min(axis=0)
    shifted = (values - low).T
    bits = max(1, int(shifted.max()).bit_length())
    words = -(-len(ids) // 64)
    slices = np.zeros((shifted.shape[0], bits, words * 8), np.uint8)
    for b in range(bits):
        packed = np.packbits((shifted >> b & 1).astype(np.uint8), axis=1, bitorder="little")
        slices[:, b, : packed.shape[1]] = packed
    return bits, ids, low, slices.view(np.uint64)


def add_slices(both: np.ndarray, query: np.ndarray, bits: int) -> tuple[list[np.ndarray], int]:
    """Result bitmaps by weight of sum |q_j| * u_j, u_j complemented for negative q_j, and what complementing added.

    both: plain slices, then their complements, as (2, dims, bits, words).
    """
    columns: dict[int, list[np.ndarray]] = {}
    flat = both.reshape(-1, both.shape[-1])
    dims, size = len(query), np.abs(query)
    base = (np.arange(dims) + dims * (query < 0)) * bits
    for c in range(int(size.max(initial=0)).bit_length()):
        chosen = base[(size >> c & 1).astype(bool)]
        for b in range(bits):
            if len(chosen):
                columns.setdefault(b + c, []).append(flat[chosen + b])
    out, w = [], 0
    while columns:
        parts = columns.pop(w, [])
        m = np.concatenate(parts) if parts else np.zeros((1, both.shape[-1]), np.uint64)
        while len(m) > 1:
            t = len(m) // 3
            if t:
                x, y, z = m[:t], m[t : 2 * t], m[2 * t : 3 * t]
                xy = x ^ y
                carry = (x & y) | (xy & z)
                xy ^= z
            else:
                xy, carry = m[:1] ^ m[1:2], m[:1] & m[1:2]
            columns.setdefault(w + 1, []).append(carry)
            m = np.concatenate([xy, m[3 * t if t else 2 :]])
        out.append(m[0])
        w += 1
    return out, int(-size[query < 0].sum()) * ((1 << bits) - 1)


def select_top(result: list[np.ndarray], rows: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k rows with the largest values among the bitmap `rows`, ties to the smaller position."""
    sure, tied = np.zeros_like(rows), rows
    if int(np.bitwise_count(tied).sum()) > k:
        for s in reversed(result):
            x = sure | (tied & s)
            n = int(np.bitwise_count(x).sum())
            if n > k:
                tied = tied & s
            else:
                sure, tied = x, tied & ~s
                if n == k:
                    tied = np.zeros_like(rows)
                    break
    at = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
    more = np.flatnonzero(np.unpackbits(tied.view(np.uint8), bitorder="little"))[: k - len(at)]
    return np.concatenate([at, more])


def _quantised(col: str, scale: int) -> Column:
    return F.transform(F.col(col), lambda x: F.floor(x.cast("double") * scale))


def quantise(rows: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """vec_id and the integer vector floor(scale * x) of the rows that take part."""
    usable = F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col(id_col).isNotNull() & F.coalesce(usable, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), _quantised(vector_col, scale).alias("q"))


def _matrices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dims, ids, matrix) of up to `most` rows of one length."""
    held: dict[int, list] = {}
    for batch in batches:
        ids, q = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        flat, offsets = q.values.to_numpy(zero_copy_only=False), q.offsets.to_numpy()
        lengths = np.diff(offsets)
        for d in np.unique(lengths):
            at = np.flatnonzero(lengths == d)
            own = flat[offsets[at][:, None] + np.arange(d)].astype(np.int64)
            if own.size and (own.max() >= MOST or own.min() <= -MOST):
                raise ValueError(f"a component of {int(np.abs(own.astype(object)).max())} after scaling leaves no room for scores in 64 bits")
            held.setdefault(int(d), []).append((ids[at], own))
            while sum(len(i) for i, _ in held[int(d)]) >= most:
                i, m = (np.concatenate(x) for x in zip(*held[int(d)]))
                yield int(d), i[:most], m[:most]
                held[int(d)] = [(i[most:], m[most:])]
    for d, parts in held.items():
        i, m = (np.concatenate(x) for x in zip(*parts))
        if len(i):
            yield d, i, m


def build_index(vectors: DataFrame, n_blocks: int) -> DataFrame:
    """Bit-sliced blocks of quantised vectors; rows are dealt evenly, whatever their values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dims, ids, m in _matrices(batches, BLOCK_ROWS):
            bits, ids, low, slices = build_block(ids, m)
            row = [TaskContext.get().partitionId(), dims, len(ids), bits, ids.tobytes(), low.tobytes(), slices.tobytes()]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names=[f.split(" ")[0] for f in INDEX_SCHEMA.split(", ")])

    return vectors.repartition(n_blocks).mapInArrow(run, INDEX_SCHEMA)


def _chunks(vectors: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dims, ids, m in _matrices(batches, CHUNK_QUERIES):
            row = [dims, ids.tobytes(), m.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [pa.int32(), pa.binary(), pa.binary()])], names=[f.split(" ")[0] for f in CHUNK_SCHEMA.split(", ")])

    return vectors.mapInArrow(run, CHUNK_SCHEMA)


def _search(k: int):
    names = ["query_row", "query_id", "vec_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, low = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["low"], np.int64)
                slices = np.frombuffer(r["slices"], np.uint64).reshape(r["dims"], r["bits"], -1)
                both = np.stack([slices, ~slices])
                everyone = np.zeros(slices.shape[-1] * 8, np.uint8)
                packed = np.packbits(np.ones(len(ids), np.uint8), bitorder="little")
                everyone[: len(packed)] = packed
                queries = np.frombuffer(r["vectors"], np.int64).reshape(-1, r["dims"])
                largest = max(abs(int(low.min())), abs(int(low.max())), int((low.astype(object) + ((1 << r["bits"]) - 1)).max()))
                if queries.size and r["dims"] * largest * max(abs(int(queries.min())), int(queries.max())) >= 1 << 63:
                    raise ValueError("scores of these vectors could pass 64 bits")
                out: list[tuple] = []
                for n, (own, q) in enumerate(zip(np.frombuffer(r["query_ids"], np.int64), queries)):
                    rows = everyone.copy()
                    first, last = np.searchsorted(ids, own), np.searchsorted(ids, own, side="right")
                    for i in range(first, last):
                        rows[i // 8] &= ~np.uint8(1 << (i % 8))
                    result, added = add_slices(both, q, r["bits"])
                    base = added + int(q @ low)
                    for i in select_top(result, rows.view(np.uint64), k):
                        score = base + sum(int(s[i // 64] >> np.uint64(i % 64) & np.uint64(1)) << w for w, s in enumerate(result))
                        out.append((r["chunk"] * CHUNK_QUERIES + n, int(own), int(ids[i]), score))
                cols = list(zip(*out)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    return run


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id and integer score of each query's k best rows."""
    vectors = quantise(rows, id_col, vector_col, scale)
    n = max(1, -(-rows.count() // BLOCK_ROWS))
    slots = min(SLOTS, max(1, -(-queries.count() // CHUNK_QUERIES)))  # no more copies of a block than there are chunks
    blocks = build_index(vectors, n).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    chunks = _chunks(quantise(queries, id_col, vector_col, scale)).withColumn("chunk", F.monotonically_increasing_id())
    chunks = chunks.withColumn("slot", F.pmod(F.xxhash64("chunk"), F.lit(slots)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    width = n * slots
    pairs = (
        blocks.repartition(width, "block", "slot")
        .join(chunks.withColumnRenamed("ids", "query_ids").repartition(width, "block", "slot"), ["block", "slot", "dims"])
        .select("chunk", "query_ids", "vectors", "dims", "bits", "ids", "low", "slices")
    )
    best = pairs.mapInArrow(_search(k), "query_row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_row", "query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best rows of the whole table for each row whose vec_id is divisible by 50."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(rows, rows.where(F.col("vec_id") % 50 == 0), 5)
