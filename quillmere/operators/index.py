"""Index tables: chunk identity, preferred copies, health, upsert, validation, inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trim_all


def chunk_ids(chunks: DataFrame) -> DataFrame:
    """Adds chunk_id: document_id and 16 hex digits of the hash over document, section and content."""
    digest = F.sha2(F.concat_ws("\n", "document_id", "section", "content"), 256)
    return chunks.withColumn("chunk_id", F.concat_ws("_", "document_id", F.substring(digest, 1, 16)))


def prefer(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key by `order`."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def health(expected: DataFrame, indexed: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, status): missing, orphaned, stale or current, by a full outer match of two inventories."""
    a, b = expected.select(F.col(key), F.col(digest).alias("_a"), F.lit(True).alias("_in_a")), indexed.select(F.col(key), F.col(digest).alias("_b"), F.lit(True).alias("_in_b"))
    status = F.when(F.col("_in_b").isNull(), "missing").when(F.col("_in_a").isNull(), "orphaned").when(~F.col("_a").eqNullSafe(F.col("_b")), "stale").otherwise("current")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def upsert(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """current without the keys of incoming, and incoming: the next generation of an index table."""
    return current.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)


def staged_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one of two staged stores has."""
    only = lambda a, b, side: a.select(key).exceptAll(b.select(key)).distinct().withColumn("side", F.lit(side))
    return only(left, right, "left").unionByName(only(right, left, "right"))


def last_per_key(rows: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """For each key the values of its last row and the number of rows."""
    return rows.groupBy(key).agg(F.count("*").alias("n_rows"), *(F.max_by(v, order).alias(v) for v in values))


def facets(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value, n): rows by value of each field, in one pass."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields)))
    return rows.select(pairs.alias("p")).groupBy("p.field", "p.value").agg(F.count("*").alias("n"))


def heading_sections(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, pos, section, body): Markdown text split at its headings, the part before the first with section ''."""
    parts = F.split(text, r"\n(?=#{1,6} )")
    rows = docs.select("doc_id", F.posexplode(parts).alias("pos", "part"))
    title = F.regexp_extract("part", r"^#{1,6} +([^\n]*)", 1)
    body = F.regexp_replace("part", r"^#{1,6} +[^\n]*\n?", "")
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), trim_all(title).alias("section"), trim_all(body).alias("body"))
