"""Stored index generations: posting blocks, document fields and vectors as Parquet, with a manifest that is written last.

A generation is a folder `generation-<id>` below the store's root. A reader sees it only once its manifest is there, and
serves from it only after the gates: the manifest's version and model are the reader's, and each table holds the rows the
manifest tells of. A build that stops half-way leaves a folder without manifest, which nobody reads.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import bound_batches
from ..functions.text import word_count, words

SCHEMA_VERSION = 1
#: Document ids of a posting block, so that a block is bounded however common its term is.
BLOCK_IDS = 16_384
#: Words that a task lists at once, so that its memory doesn't follow the size of its input.
LISTED_WORDS = 2_000_000
MANIFEST = "generation string, created long, schema_version int, model string, inventory string, n_docs long, n_tokens long, n_terms_in_blocks long, n_blocks long, n_vectors long"


class IndexRefused(ValueError):
    """The store can't be served from: the message lists what is wrong."""


class Index(NamedTuple):
    """An opened generation. postings: term, block, doc_ids, tfs, lens; documents: doc_id, doc_len and the fields that
    filters use; vectors: doc_id, embedding."""

    generation: str
    n_docs: int
    n_tokens: int
    postings: DataFrame
    documents: DataFrame
    vectors: DataFrame


def inventory(docs: DataFrame, vectors: DataFrame) -> str:
    """Fingerprint of the rows that an index is built from: counts and sums of row hashes, combined before the shuffle."""
    total = lambda df: df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
    a, b = total(docs), total(vectors)
    return f"{a['n']}:{a['s']}:{b['n']}:{b['s']}"


def _ends(listed: pa.Array) -> np.ndarray:
    """Where the lists of an array without nulls begin and end in its flattened values."""
    ends = listed.offsets.to_numpy()
    return ends - ends[0]


def _lists(values: np.ndarray, heads: np.ndarray) -> pa.Array:
    """The values cut before each head."""
    return pa.ListArray.from_arrays(pa.array(np.append(heads, len(values)), pa.int32()), pa.array(values))


def _heads(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.ones(len(sorted_columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_columns])
    return np.flatnonzero(new)


def list_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (doc_id, w) to posting lists (term, block, first, ids, tfs, lens) of some documents each; ids are places
    in the block, in order, first the least of them."""

    def lists(ids: np.ndarray, held: list[pa.Array]) -> pa.RecordBatch:
        sizes = np.concatenate([np.diff(h.offsets.to_numpy()) for h in held])
        coded = pa.chunked_array([h.flatten() for h in held], pa.string()).combine_chunks().dictionary_encode()
        # rows of one id and length are one document
        order = np.lexsort((sizes, ids))
        heads = _heads(ids[order], sizes[order])
        number = np.empty(len(ids), np.int64)
        number[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(ids))))
        ids, lens = ids[order][heads], sizes[order][heads]
        keys, tfs = np.unique(coded.indices.to_numpy().astype(np.int64) * len(heads) + np.repeat(number, sizes), return_counts=True)
        code, doc = np.divmod(keys, max(len(heads), 1))
        block = ids[doc] // BLOCK_IDS
        cut, places = _heads(code, block), (ids[doc] - block * BLOCK_IDS).astype(np.int32)
        columns = [coded.dictionary.take(pa.array(code[cut])), pa.array(block[cut]), pa.array(places[cut]), _lists(places, cut), _lists(tfs.astype(np.int32), cut), _lists(lens[doc].astype(np.int32), cut)]
        return pa.RecordBatch.from_arrays(columns, ["term", "block", "first", "ids", "tfs", "lens"])

    ids, held, n = [], [], 0
    for batch in batches:
        ids.append(batch.column(0).to_numpy())
        held.append(batch.column(1))
        n += len(batch.column(1).values)
        if n >= LISTED_WORDS:
            yield lists(np.concatenate(ids), held)
            ids, held, n = [], [], 0
    if held:
        yield lists(np.concatenate(ids), held)


def merge_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of posting lists, sorted by term, block and first, to one list each term and block: (term, block, doc_ids,
    tfs, lens). Postings of one id and length are added up."""

    def merged(rows: pa.Table) -> pa.RecordBatch:
        term, block = rows.column("term").combine_chunks(), rows.column("block").to_numpy()
        ids, tfs, lens = (rows.column(c).combine_chunks() for c in ("ids", "tfs", "lens"))
        heads = _heads(term.dictionary_encode().indices.to_numpy(), block)
        group = np.zeros(len(block), np.int64)
        group[heads[1:]] = 1
        group = np.repeat(np.cumsum(group), np.diff(_ends(ids)))
        ids, tfs, lens = (c.flatten().to_numpy().astype(np.int64) for c in (ids, tfs, lens))
        at = group * BLOCK_IDS + ids
        if not (at[1:] > at[:-1]).all():
            order = np.lexsort((lens, at))
            own = _heads(at[order], lens[order])
            group, ids, lens, tfs = group[order][own], ids[order][own], lens[order][own], np.add.reduceat(tfs[order], own)
        cut = _heads(group)
        return pa.RecordBatch.from_arrays([term.take(pa.array(heads)), pa.array(block[heads]), _lists(block[heads][group] * BLOCK_IDS + ids, cut), _lists(tfs, cut), _lists(lens, cut)], ["term", "block", "doc_ids", "tfs", "lens"])

    rest: pa.Table | None = None
    for batch in chain(batches, [None]):
        # the last term and block of a batch may go on in the next
        table = pa.Table.from_batches([batch]) if batch is not None else None
        if rest is not None and table is not None:
            table = pa.concat_tables([rest, table])
        if table is None:
            if rest is not None:
                yield merged(rest)
            return
        if not table.num_rows:
            continue
        last = pc.and_(pc.equal(table.column("term"), table.column("term")[-1]), pc.equal(table.column("block"), table.column("block")[-1]))
        n = table.num_rows - pc.sum(last).as_py()
        if n:
            yield merged(table.slice(0, n))
        rest = table.slice(n)


def posting_blocks(docs: DataFrame) -> DataFrame:
    """(term, block, doc_ids, tfs, lens): the postings of each term by ranges of document ids, in id order.

    Each task lists its own documents, so that lists and not words are shuffled; lists of one term and block are merged."""
    tokens = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.coalesce("text", F.lit(""))).alias("w"))
    listed = tokens.mapInArrow(list_words, "term string, block long, first int, ids array<int>, tfs array<int>, lens array<int>")
    dealt = listed.repartition("term", "block").sortWithinPartitions("term", "block", "first")
    return dealt.mapInArrow(merge_lists, "term string, block long, doc_ids array<long>, tfs array<long>, lens array<long>")


def build(docs: DataFrame, vectors: DataFrame, root: str, model: str, fields: list[str] = (), known: str | None = None) -> str:
    """Writes a new generation and returns its id; other generations stay as they are.

    docs: doc_id, text and fields; vectors: doc_id, embedding; known: the inventory of these rows, where it is known. The
    words are listed once, for the postings; lengths are counted without them. Documents with null ids are left out.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    docs, vectors = docs.where("doc_id is not null"), vectors.where("doc_id is not null and embedding is not null")
    generation = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    path = f"{root}/generation-{generation}"
    posting_blocks(docs).write.parquet(f"{path}/postings")
    docs.select("doc_id", *fields, word_count(F.coalesce("text", F.lit(""))).alias("doc_len")).write.parquet(f"{path}/documents")
    vectors.select("doc_id", "embedding").write.parquet(f"{path}/vectors")
    tables = _tables(spark, path)
    sizes = _sizes(*tables)
    row = (generation, time.time_ns(), SCHEMA_VERSION, model, known or inventory(docs.select("doc_id", "text", *fields), vectors.select("doc_id", "embedding")), *sizes)
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.parquet(f"{path}/manifest")
    return generation


def _tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{t}") for t in ("postings", "documents", "vectors"))


def _sizes(postings: DataFrame, documents: DataFrame, vectors: DataFrame) -> tuple[int, ...]:
    """(documents, tokens, postings, blocks, vectors), none of which reads a text."""
    d = documents.agg(F.count("*").alias("n"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("t")).first()
    p = postings.agg(F.coalesce(F.sum(F.size("doc_ids")), F.lit(0)).alias("n"), F.count("*").alias("b")).first()
    return d["n"], d["t"], p["n"], p["b"], vectors.count()


def manifests(spark: SparkSession, root: str) -> list:
    """The manifests of the root's finished generations, the newest first; one row a generation."""
    try:
        rows = spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").parquet(f"{root}/generation-*/manifest")
        return sorted(rows.collect(), key=lambda r: r["generation"], reverse=True)
    except AnalysisException:  # no generation is finished
        return []


def open_index(spark: SparkSession, root: str, model: str, expected: str | None = None) -> Index:
    """The newest generation, after its gates; IndexRefused where it may not be served.

    expected: the inventory of the rows that should be served, if it is to be checked."""
    found = manifests(spark, root)
    if not found:
        raise IndexRefused(f"no finished generation below {root}")
    m = found[0]
    try:
        tables = _tables(spark, f"{root}/generation-{m['generation']}")
        sizes = _sizes(*tables)
    except AnalysisException as e:
        raise IndexRefused(f"generation {m['generation']}: a table is missing or unreadable") from e
    names = ("n_docs", "n_tokens", "n_terms_in_blocks", "n_blocks", "n_vectors")
    wrong = [f"{n}: manifest has {m[n]}, store has {v}" for n, v in zip(names, sizes) if m[n] != v]
    wrong += [f"{n}: manifest has {m[n]}, reader has {v}" for n, v in (("schema_version", SCHEMA_VERSION), ("model", model), ("inventory", expected)) if v is not None and m[n] != v]
    if wrong:
        raise IndexRefused(f"generation {m['generation']}: " + "; ".join(wrong))
    return Index(m["generation"], m["n_docs"], m["n_tokens"], *tables)


def serve(docs: DataFrame, vectors: DataFrame, root: str, model: str, fields: list[str] = ()) -> Index:
    """The newest generation if it was built from these rows, else a new one."""
    spark = docs.sparkSession
    own = inventory(docs.where("doc_id is not null").select("doc_id", "text", *fields), vectors.where("doc_id is not null and embedding is not null").select("doc_id", "embedding"))
    try:
        return open_index(spark, root, model, own)
    except IndexRefused:
        build(docs, vectors, root, model, fields, own)
        return open_index(spark, root, model, own)


def staged_rows(index: Index) -> DataFrame:
    """(doc_id, side) of documents without vector and vectors without document: what a validation of a generation lists."""
    a, b = index.documents.select("doc_id"), index.vectors.select("doc_id")
    only = lambda x, y, side: x.join(y, "doc_id", "left_anti").distinct().withColumn("side", F.lit(side))
    return only(a, b, "documents").unionByName(only(b, a, "vectors"))
