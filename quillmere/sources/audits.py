"""Evidence audits: what an answer rested on, kept append-only by day, held against the current index, and pruned by day.

A record is one row: audit_id, created_us, index_generation, question, answer, claims (claim_id, evidence_unit_ids),
evidence_units (evidence_id, evidence_fingerprint) and gate (the output gate's action). Scans never return question or
answer.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = "claim-evidence-audit-v1"
DAY_US = 86_400_000_000
#: The fields that a unit's fingerprint covers. The role that a retrieval gave it isn't one.
FIELDS = ["document_id", "chunk_id", "video_id", "text", "chunk_type", "risk_level", "review_status", "source_of_truth", "answer_policy"]
STATUSES = ["current", "generation_changed", "invalidated", "not_applicable"]


def fingerprint(fields: dict[str, Column], refs: Column) -> Column:
    """Hash of a unit's fields by name, and of its references in order; null fields differ from empty ones."""
    parts = [F.col(c).cast("string").alias(c) if c not in fields else fields[c].cast("string").alias(c) for c in sorted(FIELDS)]
    return F.sha2(F.to_json(F.struct(*parts, F.array_sort(refs).alias("source_refs")), {"ignoreNullFields": "false"}), 256)


def evidence_units(results: DataFrame, by: list[str]) -> DataFrame:
    """(by, evidence_id, evidence_fingerprint, fields, source_refs): one unit for each chunk of a retrieval, the row of the
    smallest rank; rows without chunk_id are none. results: by, rank, source_refs and FIELDS."""
    rows = results.withColumn("chunk_id", F.trim("chunk_id")).where(F.coalesce("chunk_id", F.lit("")) != "")
    firsts = rows.groupBy(*by, "chunk_id").agg(F.min_by(F.struct("source_refs", *[c for c in FIELDS if c != "chunk_id"]), "rank").alias("u")).select(*by, "chunk_id", "u.*")
    refs = F.array_distinct(F.coalesce("source_refs", F.array().cast("array<string>")))
    risk = F.coalesce("risk_level", F.lit("low"))
    return firsts.select(*by, F.concat(F.lit("E:"), "chunk_id").alias("evidence_id"), fingerprint({"risk_level": risk}, refs).alias("evidence_fingerprint"), *[risk.alias(c) if c == "risk_level" else F.col(c) for c in FIELDS], refs.alias("source_refs"))


def persist(records: DataFrame, path: str) -> int:
    """Appends the records whose audit_id the store doesn't have, by day; history is never written anew. The number of
    audits that were added."""
    spark = records.sparkSession
    fresh = records.dropDuplicates(["audit_id"]).withColumns({"schema_version": F.lit(SCHEMA_VERSION), "day": F.to_date(F.timestamp_micros("created_us"))})
    known = _stored(spark, path)
    if known is not None:
        fresh = fresh.join(known.select("audit_id"), "audit_id", "left_anti")
    before = 0 if known is None else known.count()
    fresh.repartition("day").write.mode("append").partitionBy("day").parquet(path)
    after = _stored(spark, path)
    return (0 if after is None else after.count()) - before


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:  # nothing is stored yet
        return None


def scan(records: DataFrame, current: DataFrame, generation: str, now_us: int, retention_days: int = 0) -> DataFrame:
    """(audit_id, status, age_days, expired, affected_claim_ids, changed, missing) of each audit, lists sorted.

    current: evidence_id, evidence_fingerprint of the index as it is. Changed or missing evidence invalidates an audit and
    the claims that rest on it; else an audit is of another generation, without evidence, or current. Ages are whole
    thousandths of a day; retention 0 keeps everything."""
    units = records.select("audit_id", F.explode("evidence_units").alias("u")).select("audit_id", "u.evidence_id", "u.evidence_fingerprint")
    now = current.groupBy("evidence_id").agg(F.min("evidence_fingerprint").alias("_now"))
    held = units.join(now, "evidence_id", "left")
    state = F.when(F.col("_now").isNull(), "missing").when(F.col("_now") != F.col("evidence_fingerprint"), "changed")
    ids = lambda s: F.array_sort(F.collect_set(F.when(state == s, F.col("evidence_id"))))
    found = held.groupBy("audit_id").agg(F.count("*").alias("n"), ids("changed").alias("changed"), ids("missing").alias("missing"))
    rows = records.select("audit_id", "created_us", "index_generation", "claims").join(found, "audit_id", "left")
    none = F.array().cast("array<string>")
    rows = rows.withColumns({"changed": F.coalesce("changed", none), "missing": F.coalesce("missing", none)})
    invalid = F.concat("changed", "missing")
    touched = F.filter("claims", lambda c: F.arrays_overlap(c["evidence_unit_ids"], invalid) & c["claim_id"].isNotNull() & (c["claim_id"] != ""))
    status = F.when(F.size(invalid) > 0, "invalidated").when(F.col("index_generation") != generation, "generation_changed").when(F.col("n").isNull(), "not_applicable").otherwise("current")
    age = F.greatest(F.lit(now_us) - F.col("created_us"), F.lit(0))
    expired = F.lit(retention_days > 0) & (age >= retention_days * DAY_US)
    return rows.select("audit_id", status.alias("status"), (F.floor(age * 1000 / DAY_US) / 1000).alias("age_days"), expired.alias("expired"), F.array_sort(F.transform(F.coalesce(touched, F.array().cast("array<struct<claim_id:string,evidence_unit_ids:array<string>>>")), lambda c: c["claim_id"])).alias("affected_claim_ids"), "changed", "missing")


def health(scanned: DataFrame) -> DataFrame:
    """One row: total, a count for each status, expired, and status: attention_required where an audit is invalidated or
    expired, else ok."""
    counted = scanned.agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in STATUSES), F.count_if("expired").alias("expired"))
    return counted.withColumn("status", F.when((F.col("invalidated") > 0) | (F.col("expired") > 0), "attention_required").otherwise("ok"))


def prune(spark: SparkSession, path: str, now_us: int, retention_days: int, apply: bool = False) -> list[str]:
    """The days whose audits have all expired, oldest first; they are deleted only with apply. Only folders `day=...`
    directly below the store are touched."""
    stored = _stored(spark, path)
    if stored is None or retention_days <= 0:
        return []
    days = stored.groupBy("day").agg(F.max("created_us").alias("last")).where(F.lit(now_us) - F.col("last") >= retention_days * DAY_US)
    expired = sorted(str(r["day"]) for r in days.where("day is not null").select("day").collect())  # one row a day
    if apply and expired:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for day in expired:
            folder = jvm.org.apache.hadoop.fs.Path(f"{path}/day={day}")
            folder.getFileSystem(conf).delete(folder, True)
    return expired
