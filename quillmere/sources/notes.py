"""Sources and sinks of the knowledge base: Markdown notes with front matter, JSON lines, keyed Parquet stores."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEAD = r"(?s)^---\n(.*?)\n---\n?"


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """(path, modified, head, body, video_id) of all *.md files below a folder.

    head maps the scalar `key: value` lines of the front matter, quotes taken off; video_id is that of the head, else the
    first identifier in the body. A file without front matter has an empty head.
    """
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True)
    rows = files.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"))
    lines = F.filter(F.split(F.regexp_extract("value", HEAD, 1), "\n"), lambda x: x.rlike(r"^\w[\w -]*:"))
    entry = lambda x: F.struct(F.regexp_extract(x, r"^([\w -]+):", 1).alias("k"), F.regexp_replace(F.trim(F.regexp_extract(x, r"^[\w -]+:(.*)$", 1)), r"^(['\"])(.*)\1$", "$2").alias("v"))
    head = F.map_from_entries(F.transform(lines, entry))
    body = F.regexp_replace("value", HEAD, "")
    found = rows.select("path", "modified", head.alias("head"), body.alias("body"))
    named = F.nullif(F.coalesce(F.col("head")["video_id"], F.lit("")), F.lit(""))
    return found.withColumn("video_id", F.coalesce(named, F.nullif(F.regexp_extract("body", r"(?U)(BV\w+)", 1), F.lit(""))))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file under a schema; blank and # lines are skipped, a bad line fails the read."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("j")).select("j.*")


def write_new(rows: DataFrame, path: str, key: str) -> None:
    """Appends the rows whose key the store doesn't have yet."""
    try:
        known = rows.sparkSession.read.parquet(path).select(key)
    except AnalysisException:  # the store doesn't exist yet
        rows.write.parquet(path)
        return
    rows.join(known, key, "left_anti").write.mode("append").parquet(path)
