"""Language of texts by prediction by partial matching over bytes.

Each language has a context tree of up to ORDER bytes, with frozen counts from a sample of labelled texts. The code length
of a byte is exact: from its longest known context, a byte seen there costs log2((total + distinct) / count); any other
costs an escape, log2((total + distinct) / distinct), and goes on in the next shorter context, whose counts leave out the
bytes the longer one has seen; after the empty context, the unseen bytes are equally likely. The language that codes the
whole text in the fewest bits wins; ties go to the smaller name. Score: the posterior of that language under equal priors.

Counts of longer contexts are part of those of shorter ones, so the code length of a byte depends on the last ORDER + 1
bytes only; it is worked out once for each such gram of the sample, in all languages, and looked up while scoring.

The sample is bounded: TRAIN_BLOCKS blocks of BLOCK_CHARS characters over all languages, those with the smallest hashes of
doc_id and block number. All else covers whole texts of all rows.

Defined results: texts that are null or have no letter are `und` with score 0, and so is every text where nothing can be
learned; rows without doc_id are not held out; repeated rows are drawn once for training and scored each; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MULT, materialize
from .words import slices, text_bytes

ORDER = 4
TRAIN_BLOCKS = 6000
BLOCK_CHARS = 1000
#: The byte that stands before each text.
PAD = 10
#: Code lengths are whole numbers of 1/UNIT bits, so that sums don't depend on their order.
UNIT = 65536
SLICE_BYTES = 1 << 20


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, last ORDER + 1 bytes up to each byte, packed in an integer) of the rows."""
    at, raw = text_bytes(texts)
    padded = np.full(len(raw) + ORDER * (len(at) - 1), PAD, np.uint8)
    place = np.ones(len(padded), bool)
    begin = at[:-1] + ORDER * np.arange(len(at) - 1)
    for k in range(ORDER):
        place[begin + k] = False
    padded[place] = raw
    packed = padded.astype(np.int64)
    for width in (1, 2):  # now two bytes, now four
        wide = packed.copy()
        wide[width:] |= packed[:-width] << (8 * width)
        packed = wide
    packed[ORDER:] |= padded[:-ORDER].astype(np.int64) << (8 * ORDER)
    return at, packed[place]


class Tree:
    """One language's counts: for each order the sorted contexts with total and distinct symbols, and the sorted
    context-symbol keys with counts."""

    def __init__(self, gram: np.ndarray, count: np.ndarray):
        self.keys, self.counts, self.contexts, self.totals, self.distinct, self.masked, self.fresh = [], [], [], [], [], [], []
        for d in range(ORDER + 1):
            keys, where = np.unique(gram & ((1 << 8 * (d + 1)) - 1), return_inverse=True)
            counts = np.bincount(where, count, len(keys)).astype(np.int64)
            contexts, where = np.unique(keys >> 8, return_inverse=True)
            self.keys.append(keys)
            self.counts.append(counts)
            self.contexts.append(contexts)
            self.totals.append(np.bincount(where, counts, len(contexts)).astype(np.int64))
            self.distinct.append(np.bincount(where, minlength=len(contexts)))
            masked = fresh = np.zeros(len(contexts), np.int64)
            if d:  # what the next shorter context has beyond the bytes seen in this one
                parent = np.searchsorted(self.contexts[d - 1], contexts & ((1 << 8 * (d - 1)) - 1))
                seen = self.counts[d - 1][np.searchsorted(self.keys[d - 1], keys & ((1 << 8 * d) - 1))]
                masked = self.totals[d - 1][parent] - np.bincount(where, seen, len(contexts)).astype(np.int64)
                fresh = self.distinct[d - 1][parent] - self.distinct[d]
            self.masked.append(masked)
            self.fresh.append(fresh)

    def bits(self, gram: np.ndarray) -> np.ndarray:
        """Exact code length of the last byte of each gram after the others."""
        out = np.zeros(len(gram))
        left = np.arange(len(gram))
        escaped = np.zeros(len(gram), bool)
        total, distinct = np.zeros(len(gram), np.int64), np.zeros(len(gram), np.int64)
        for d in range(ORDER, -1, -1):
            g = gram[left]
            context = (g & ((1 << 8 * (d + 1)) - 1)) >> 8
            c = np.minimum(np.searchsorted(self.contexts[d], context), len(self.contexts[d]) - 1)
            known = self.contexts[d][c] == context
            begin = known & ~escaped[left]
            total[left[begin]], distinct[left[begin]] = self.totals[d][c[begin]], self.distinct[d][c[begin]]
            key = g & ((1 << 8 * (d + 1)) - 1)
            k = np.minimum(np.searchsorted(self.keys[d], key), len(self.keys[d]) - 1)
            hit = known & (self.keys[d][k] == key)
            t, q = total[left], distinct[left]
            out[left[hit]] += np.log2((t + q)[hit] / self.counts[d][k[hit]])
            miss = known & ~hit & (q > 0)
            out[left[miss]] += np.log2((t + q)[miss] / q[miss])
            escape = known & ~hit
            escaped[left[escape]] = True
            total[left[escape]], distinct[left[escape]] = self.masked[d][c[escape]], self.fresh[d][c[escape]]
            left = left[~hit]
        out[left] += np.log2(256 - len(self.keys[0]))
        return out


class KeyTable:
    """Places of 40-bit keys by open addressing; -1 for others."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[left[free]]
            placed = self.keys[slot] == keys[left]
            self.values[slot[placed]] = left[placed]
            left, slot = left[~placed], (slot[~placed] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(MULT)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.values[slot], -1)
        left = np.flatnonzero((out < 0) & (self.keys[slot] != -1))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot]
            hit = there == keys[left]
            out[left[hit]] = self.values[slot[hit]]
            go = ~hit & (there != -1)
            left, slot = left[go], slot[go]
        return out


class Model(NamedTuple):
    """The sample's counts by language; `scorer` builds trees and tables from them in each task."""

    key: str
    languages: list[str]
    gram: np.ndarray
    language: np.ndarray
    count: np.ndarray


class Scorer:
    def __init__(self, model: Model):
        self.trees = [Tree(model.gram[model.language == k], model.count[model.language == k]) for k in range(len(model.languages))]
        known = np.unique(model.gram)
        self.table, self.costs = KeyTable(known), self.costs_of(known)

    def costs_of(self, gram: np.ndarray) -> np.ndarray:
        return np.stack([np.rint(t.bits(gram) * UNIT).astype(np.int64) for t in self.trees], 1).astype(np.int32)

    def code_lengths(self, texts: pa.Array) -> np.ndarray:
        """Rows by languages: whole code lengths in 1/UNIT bits."""
        at, gram = grams(texts)
        out = np.zeros((len(at) - 1, len(self.trees)), np.int64)
        if not len(gram):
            return out
        place = self.table.find(gram)
        unknown = np.flatnonzero(place < 0)
        costs = self.costs[place]
        if len(unknown):
            distinct, where = np.unique(gram[unknown], return_inverse=True)
            costs[unknown] = self.costs_of(distinct)[where]
        full = np.flatnonzero(at[1:] > at[:-1])
        out[full] = np.add.reduceat(costs, at[:-1][full], axis=0, dtype=np.int64)
        return out


def sample_blocks(rows: DataFrame, text_col: str, lang_col: str, id_col: str, limit: int) -> DataFrame:
    """lang and block: at most `limit` blocks in all, the same number for each language, those with the smallest hashes.

    A first pass counts blocks; a hash threshold from that keeps about twice what is needed, of which each language's
    smallest are taken. Blocks after a text's first carry ORDER characters of what stands before."""
    spark = rows.sparkSession
    rows = rows.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where("t is not null and l is not null and t <> ''")
    n = F.ceil(F.length("t") / BLOCK_CHARS)
    # rows that repeat a doc_id have the same hashes, so blocks are counted as if each id came once
    counted = rows.groupBy("l").agg(F.sum(n).alias("n"), F.count("*").alias("rows"), F.approx_count_distinct("i").alias("ids"))
    sizes = {r["l"]: r["n"] * max(r["ids"], 1) / r["rows"] for r in counted.collect()}
    if not sizes:
        return spark.createDataFrame([], "lang string, block string")
    each = max(1, limit // len(sizes))
    shares = spark.createDataFrame([(k, min(1.0, 2.0 * each / v + 1e-4)) for k, v in sizes.items()], "l string, share double")
    picked = (
        rows.join(F.broadcast(shares), "l")
        .withColumn("k", F.explode(F.filter(F.sequence(F.lit(0).cast("long"), n - 1), lambda k: F.pmod(F.xxhash64(F.col("i"), k, F.lit(11)), F.lit(1 << 31)) < F.col("share") * (1 << 31))))
        .withColumn("h", F.xxhash64("i", "k", F.lit(12)))
        .select(F.col("l").alias("lang"), "h", F.when(F.col("k") == 0, F.substring("t", 1, BLOCK_CHARS)).otherwise(F.substring(F.col("t"), (F.col("k") * BLOCK_CHARS + (1 - ORDER)).cast("int"), F.lit(BLOCK_CHARS + ORDER))).alias("block"), (F.col("k") == 0).alias("begins"))
        .dropDuplicates(["lang", "h"])
    )
    picked = materialize(picked, "blocks")
    parts = [picked.where(F.col("lang") == k).orderBy("h").limit(each) for k in sorted(sizes)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", limit: int = TRAIN_BLOCKS) -> Model:
    """Gram counts of a bounded sample of labelled rows. What comes to the driver is at most one row for each byte of it."""
    blocks = sample_blocks(rows, text_col, lang_col, id_col, limit)
    if "begins" not in blocks.columns:
        return Model("", [], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, gram = grams(batch.column("block"))
            # a later block's first characters are only context
            skip = np.where(batch.column("begins").to_numpy(zero_copy_only=False), 0, ORDER)
            row = np.repeat(np.arange(len(at) - 1), np.diff(at))
            keep = np.arange(len(gram)) - at[row] >= skip[row]
            names = batch.column("lang").dictionary_encode()
            code = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row[keep]]
            found, n = np.unique(np.stack([code, gram[keep]], 1), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(found[:, 0])), pa.array(found[:, 1]), pa.array(n)], ["lang", "gram", "n"])

    counted = blocks.select("lang", "block", "begins").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    names = counted.column("lang").to_pylist()
    languages = sorted(set(names))
    number = {k: i for i, k in enumerate(languages)}
    language = np.array([number[k] for k in names], np.int64)
    gram, count = counted.column("gram").to_numpy(), counted.column("n").to_numpy()
    order = np.lexsort((gram, language))
    return Model(uuid.uuid4().hex, languages, gram[order], language[order], count[order])


_scorers: dict[str, Scorer] = {}


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every whole text; a narrow map. The model is broadcast: its size is bounded by the
    training sample's."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        key = own.key
        if own.languages and key not in _scorers:
            _scorers.clear()
            _scorers[key] = Scorer(own)
        for batch in batches:
            for part in slices(batch, "t", SLICE_BYTES):
                name, score = ["und"] * part.num_rows, np.zeros(part.num_rows)
                if own.languages:
                    lengths = _scorers[key].code_lengths(part.column("t"))
                    best = lengths.argmin(axis=1)
                    score = 1 / np.exp2((lengths.min(axis=1, keepdims=True) - lengths) / UNIT).sum(axis=1)
                    name = [own.languages[k] for k in best]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lettered"), pa.array(name), pa.array(score)], ["doc_id", "lettered", "name", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    found = rows.mapInArrow(run, "doc_id long, lettered boolean, name string, score double")
    return found.select("doc_id", F.when(F.col("lettered"), F.col("name")).otherwise("und").alias("lang_pred"), F.when(F.col("lettered"), F.col("score")).otherwise(0.0).alias("score"))


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions for all documents; rows whose crc32 modulo 4 is 2 give no labels."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = is_held_out(F.col("doc_id"))
    model = fit(docs.where(~held))
    return predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
