"""Importance resampling of documents towards the distribution of a target table.

Hashed features of words and word pairs are counted in both tables; a bucket's gain is the log ratio of its two smoothed
shares. The gains form an array that each task indexes by bucket, so a document's weight is one gather and one sum. Gumbel
noise, seeded by the row's key, turns the draw without replacement into a top-k by score.

The cutoff is found without sorting the table: a quantile sketch of the scores proposes nested brackets around it, exact
counts of what lies outside choose the narrowest bracket that holds it, and only that bracket is sorted.

Defined results: null and empty texts have no features, weight 0 and a score of their noise alone; rows without doc_id have
null score and are never drawn; repeated rows are rows of their own (equal keys go by n_features, then by place); empty
tables give an empty result, and an empty target table is one without features; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, new_path
from .words import ALPHANUMERIC, Words, slices, split_words

BUCKETS = 10_000
SEED = 7
LEAST_WORDS = 20
DRAW_PERCENT = 25
#: Longest second word, with its space, whose shift has a table.
SHIFT_MOST = 64
#: Rank error of the sketch is a row count over this.
SKETCH_ACCURACY = 10_000


class CrcShift:
    """CRC-32 of a joined pair from those of its parts: appending n bytes is linear in the first CRC, so four lookups, one
    for each of its bytes, and the second CRC give it. Tables are built for lengths as they occur."""

    def __init__(self):
        self.tables = np.zeros((SHIFT_MOST + 1, 4, 256), np.uint32)
        self.built = np.zeros(SHIFT_MOST + 1, bool)

    def prepare(self, lengths: np.ndarray) -> None:
        for n in np.unique(lengths[lengths <= SHIFT_MOST]):
            if not self.built[n]:
                zeros = bytes(int(n))
                base = zlib.crc32(zeros)
                self.tables[n] = [[zlib.crc32(zeros, v << 8 * k) ^ base for v in range(256)] for k in range(4)]
                self.built[n] = True

    def join(self, first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
        flat, at = self.tables.reshape(-1), length * 1024
        out = second.copy()
        for k in range(4):
            out ^= flat[at + (256 * k) + ((first >> np.uint32(8 * k)) & np.uint32(255))]
        return out


_shift = CrcShift()


def feature_buckets(words: Words, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each word, bucket of each word with its successor, whether that successor is in the same row)."""
    names = words.names.to_pylist()
    own = np.array([zlib.crc32(w) for w in names], np.uint32)
    spaced = np.array([zlib.crc32(b" " + w) for w in names], np.uint32)
    length = np.array([len(w) + 1 for w in names], np.int64)
    _shift.prepare(length)
    a, b = words.codes[:-1], words.codes[1:]
    size = length[b]
    pair = np.zeros(len(a), np.uint32)
    short = size <= SHIFT_MOST
    pair[short] = _shift.join(own[a[short]], spaced[b[short]], size[short])
    for i in np.flatnonzero(~short):
        pair[i] = zlib.crc32(b" " + names[b[i]], int(own[a[i]]))
    linked = np.ones(len(a), bool)
    ends = words.bounds[1:-1] - 1
    linked[ends[(ends >= 0) & (ends < len(a))]] = False
    return (own % buckets)[words.codes].astype(np.int64), (pair % np.uint32(buckets)).astype(np.int64), linked


def bucket_counts(table: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """bucket and n of all features; each task adds up its own array before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "t"):
                words = split_words(part.column("t"), ALPHANUMERIC, lower=True)
                if len(words.codes):
                    one, two, linked = feature_buckets(words, buckets)
                    total += np.bincount(one, minlength=buckets) + np.bincount(two[linked], minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], ["bucket", "n"])

    return table.select(F.col(text_col).alias("t")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(table: DataFrame, target: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket; at most `buckets` rows of either table's counts come to the driver."""
    counts = np.zeros((2, buckets), np.int64)
    for k, side in enumerate((table, target)):
        for r in bucket_counts(side, text_col, buckets).collect():
            counts[k, r["bucket"]] = r["n"]
    s, t = counts.tolist()
    all_s, all_t = float(sum(s) + buckets), float(sum(t) + buckets)
    return np.array([math.floor(1000 * math.log((b + 1.0) * all_s / ((a + 1.0) * all_t))) for a, b in zip(s, t)], np.int64)


def noise(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, floored, from the key's hash."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weighed(table: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features and weight of every row, by lookups in the array of gains."""
    buckets = len(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                words = split_words(part.column("t"), ALPHANUMERIC, lower=True)
                n = np.diff(words.bounds)
                total = np.zeros(len(n), np.int64)
                if len(words.codes):
                    one, two, linked = feature_buckets(words, buckets)
                    gain = gains[one]
                    gain[:-1] += np.where(linked, gains[two], 0)
                    sums = np.concatenate([[0], np.cumsum(gain)])
                    total = sums[words.bounds[1:]] - sums[words.bounds[:-1]]
                features = np.maximum(2 * n - 1, 0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(features), pa.array(total // np.maximum(features, 1))], ["doc_id", "n_words", "n_features", "weight"])

    return table.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def in_order(df: DataFrame, key: str, name: str) -> DataFrame:
    """df with `position`, each row's place (from 0) in the order of `key`, without a global window.

    Rows are range-partitioned, sorted and written; a row's place is its index in its file plus the sizes of the files
    before it, of which there is one row a partition."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.repartitionByRange(key).sortWithinPartitions(key).write.option("maxRecordsPerFile", 0).parquet(path)
    back = spark.read.schema(df.schema).parquet(path).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    sizes = sorted(((int(r["_file"].split("-")[1]), r["_file"], r["count"]) for r in back.groupBy("_file").count().collect()))
    offsets, before = [], 0
    for _, file, n in sizes:
        offsets.append((file, before))
        before += n
    starts = spark.createDataFrame(offsets, "_file string, _before long")
    return back.join(F.broadcast(starts), "_file").withColumn("position", F.col("_before") + F.col("_row")).drop("_file", "_row", "_before")


def cutoff_bracket(rows: DataFrame, column: str, share: float, size: int) -> tuple[int, int, int]:
    """(lowest, highest, rows above) of a bracket of values that holds the size-th highest.

    One sketch proposes brackets around the quantile, each eight times as wide as the one before, and the whole range; one
    exact count of what lies above and below each validates them, and the narrowest valid one is taken."""
    widths = [w for k in range(12) if (w := 2.0 / SKETCH_ACCURACY * 8**k) < 1] + [1.0]
    places = [p for w in widths for p in (max(0.0, share - w), min(1.0, share + w))]
    found = rows.agg(F.percentile_approx(column, places, SKETCH_ACCURACY).alias("q"), F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    brackets = [*zip(found["q"][0::2], found["q"][1::2]), (found["lo"], found["hi"])]
    counts = rows.agg(*[F.count_if(F.col(column) > hi).alias(f"above{k}") for k, (_, hi) in enumerate(brackets)], *[F.count_if(F.col(column) >= lo).alias(f"held{k}") for k, (lo, _) in enumerate(brackets)]).first()
    k = next(k for k in range(len(brackets)) if counts[f"above{k}"] < size <= counts[f"held{k}"])
    return brackets[k][0], brackets[k][1], counts[f"above{k}"]


def resample(table: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = DRAW_PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of table; rank is null where a row isn't drawn."""
    gains = bucket_gains(table, target, text_col, buckets)
    scored = weighed(table, gains, id_col, text_col).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = materialize(scored, "scored").select("*", F.struct((-F.col("score")).alias("s"), "doc_id", (-F.col("n_features")).alias("f"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")).alias("key"))
    out = ["doc_id", "n_features", "weight", "score"]
    eligible = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    size = scored.where(eligible).count() * percent // 100
    if not size:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    lo, hi, above = cutoff_bracket(scored.where(eligible), "score", 1 - percent / 100, size)
    last = in_order(scored.where(eligible & F.col("score").between(lo, hi)).select("key"), "key", "bracket").where(F.col("position") == size - above - 1).first()["key"]
    edge = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(last, scored.schema["key"].dataType.fields)])
    drawn = eligible & (F.col("key") <= edge)
    ranked = in_order(scored.where(drawn), "key", "drawn").select(*out, (F.col("position") + 1).alias("rank"))
    return ranked.unionByName(scored.where(~F.coalesce(drawn, F.lit(False))).select(*out, F.lit(None).cast("long").alias("rank")))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
