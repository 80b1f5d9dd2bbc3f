"""Run state of documents by profile: stored states of two layouts made rows, and what is still to be done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The layout's version, and what older states leave out.
STATE_VERSION, DEFAULT_PROFILE, DEFAULT_SCHEMA = 2, "default", "v1"
STATE = "status string, md_path string, profile string, schema_version string, prompt_version string, transcript map<string,string>"


def run_states(stores: DataFrame, payload: str) -> DataFrame:
    """(video_id, profile, status, md_path, schema_version, prompt_version, transcript) of stored JSON states.

    The present layout has a version and `videos`, by video and profile; the older one has a state a video, which names its
    profile or is the default one's. States without status are none; a store that can't be read is empty. Of several states
    of a video and profile the last by their text counts."""
    new = F.from_json(payload, f"version int, videos map<string,map<string,struct<{STATE.replace(' ', ':').replace(',:', ',')}>>>")
    old = F.from_json(payload, f"map<string,struct<{STATE.replace(' ', ':').replace(',:', ',')}>>")
    rows = stores.select(new.alias("new"), old.alias("old"))
    present = (F.col("new.version") == STATE_VERSION) & F.col("new.videos").isNotNull()
    nested = rows.where(present).select(F.explode("new.videos").alias("video_id", "by")).select("video_id", F.explode("by").alias("profile", "s"))
    flat = rows.where(~F.coalesce(present, F.lit(False)) & F.col("old").isNotNull()).select(F.explode("old").alias("video_id", "s"))
    flat = flat.where(F.col("s.status").isNotNull()).select("video_id", F.coalesce("s.profile", F.lit(DEFAULT_PROFILE)).alias("profile"), "s")
    both = nested.unionByName(flat).where(F.col("s").isNotNull())
    last = both.groupBy("video_id", "profile").agg(F.max_by("s", F.to_json("s")).alias("s"))
    own = F.coalesce("s.profile", F.lit(DEFAULT_PROFILE))
    return last.select("video_id", "profile", "s.status", "s.md_path", own.alias("own_profile"), F.coalesce("s.schema_version", F.lit(DEFAULT_SCHEMA)).alias("schema_version"), "s.prompt_version", "s.transcript")


def transcript_matches(transcript: Column, config: Column) -> Column:
    """Whether a transcript fits an ASR configuration: it has a source, and where that is ASR, all the configuration's
    values; a null configuration asks for nothing."""
    source = F.coalesce(transcript["text_source"], F.lit(""))
    same = F.forall(F.map_entries(config), lambda e: transcript[e["key"]].eqNullSafe(e["value"]))
    return config.isNull() | F.coalesce((source != "") & ((source != "asr") | same), F.lit(False))


def to_do(wanted: DataFrame, states: DataFrame, notes: DataFrame, indexed: DataFrame) -> DataFrame:
    """(video_id, profile, reason) of the wanted runs that aren't done: new, unfinished, profile_changed,
    transcript_changed, note_missing or not_indexed, the first that holds.

    wanted: video_id, profile, schema_version, prompt_version, asr_config (map or null); notes: md_path of those that exist;
    indexed: video_id. All sides meet by equi-joins."""
    w, s = wanted.alias("w"), states.alias("s")
    rows = w.join(s, (F.col("w.video_id") == F.col("s.video_id")) & (F.col("w.profile") == F.col("s.profile")), "left")
    rows = rows.select("w.video_id", "w.profile", "w.schema_version", "w.prompt_version", "w.asr_config", F.struct("s.status", "s.md_path", F.col("s.own_profile").alias("profile"), "s.schema_version", "s.prompt_version", "s.transcript").alias("s"), F.col("s.video_id").isNotNull().alias("known"))
    rows = rows.withColumn("md_path", F.col("s.md_path")).join(notes.select("md_path").distinct().withColumn("_note", F.lit(True)), "md_path", "left").join(indexed.select("video_id").distinct().withColumn("_indexed", F.lit(True)), "video_id", "left")
    same = (F.col("s.profile") == F.col("profile")) & (F.col("s.schema_version") == F.col("schema_version")) & F.col("s.prompt_version").eqNullSafe(F.col("prompt_version"))
    reason = (
        F.when(~F.col("known"), "new")
        .when(~F.col("s.status").eqNullSafe(F.lit("completed")), "unfinished")
        .when(~F.coalesce(same, F.lit(False)), "profile_changed")
        .when(~transcript_matches(F.col("s.transcript"), F.col("asr_config")), "transcript_changed")
        .when(F.col("_note").isNull(), "note_missing")
        .when(F.col("_indexed").isNull(), "not_indexed")
    )
    return rows.select("video_id", "profile", reason.alias("reason")).where("reason is not null")
