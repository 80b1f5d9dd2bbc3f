"""Gates for nested answers of models: strict verdicts, query plans and window maps, read as VARIANT with what is wrong by path.

A payload is a text that may stand in a code fence. Every gate gives the cleaned fields and a list of violations; a payload
with violations has null fields. Nothing is raised, so one bad answer doesn't end a job over many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .planning import traceable

#: Verdicts, levels of confidence, kinds and importance of content, fields of window maps and units, bounds.
VERDICTS = ["supported", "contradicted", "insufficient_evidence"]
LEVELS = ["high", "medium", "low"]
CONTENT_TYPES = ["substantive", "intro_outro", "advertisement", "empty"]
IMPORTANCE = ["major", "supporting", "minor"]
MAP_FIELDS = ["content_type", "non_content_reason", "units"]
UNIT_FIELDS = ["importance", "key_points", "recommendations", "source_refs", "summary", "title", "uncertainties", "unit_type"]
QUERY_MOST, FIELD_MOST, UNITS_MOST = 600, 80, 12
FENCE = r"(?i)^```(?:json)?\s*|\s*```$"
INTRO = "片头|片尾|开场|结尾"
ADVERTISEMENT = "广告"

_trim = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def parsed(payload: Column) -> Column:
    """The payload as VARIANT, without its fence; null where it is no JSON. The parser passes over what follows a value, so
    the payload is read as the one item of a list."""
    bare = _trim(F.regexp_replace(_trim(payload), FENCE, ""))
    items = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), bare, F.lit("]"))), "$", "array<variant>")
    return F.when(F.size(items) == 1, F.get(items, F.lit(0)))


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _field(v: Column, path: str, missing: str) -> Column:
    """The field as trimmed text: `missing` where there is none, None where it is null, JSON where it is nested."""
    held = F.try_variant_get(v, path, "variant")
    return _trim(F.when(held.isNull(), missing).when(F.is_variant_null(held), "None").otherwise(F.coalesce(F.try_variant_get(held, "$", "string"), held.cast("string"))))


def _strings(v: Column, path: str) -> Column:
    """The field's list of strings; null where it is another thing, empty where there is none."""
    held = F.try_variant_get(v, path, "variant")
    kind = F.schema_of_variant(held)
    listed = F.try_variant_get(held, "$", "array<string>")
    return F.when(held.isNull() | (kind == "ARRAY<VOID>") & (F.size(F.try_variant_get(held, "$", "array<variant>")) == 0), F.array().cast("array<string>")).when(kind == "ARRAY<STRING>", listed)


def _first(*cases: tuple[Column, str]) -> Column:
    """The name of the first case that holds, or null."""
    out = F.lit(None).cast("string")
    for holds, name in reversed(cases):
        out = F.when(F.coalesce(holds, F.lit(False)), name).otherwise(out)
    return out


def judgments(rows: DataFrame, payload: str, allowed: str) -> DataFrame:
    """rows with verdict, confidence, rationale, evidence_chunk_ids and error of a claim judge's answers.

    allowed: the chunks that a judge was shown. A supported or contradicted claim cites at least one, and none but these;
    ids are trimmed and come once. error: invalid_json, not_object, verdict, confidence, rationale, chunk_ids,
    unknown_chunks or uncited, the first that holds; the fields are null then."""
    held = rows.withColumn("_v", parsed(F.col(payload)))
    v = F.col("_v")
    held = held.withColumns({"_verdict": F.lower(_field(v, "$.verdict", "")), "_confidence": F.lower(_field(v, "$.confidence", "")), "_rationale": _field(v, "$.rationale", ""), "_ids": _strings(v, "$.evidence_chunk_ids")})
    held = held.withColumn("_ids", F.array_distinct(F.filter(F.transform("_ids", _trim), lambda x: x != "")))
    error = _first(
        (v.isNull(), "invalid_json"), (~_is(v, "OBJECT"), "not_object"), (~F.col("_verdict").isin(VERDICTS), "verdict"), (~F.col("_confidence").isin(LEVELS), "confidence"),
        (F.col("_rationale") == "", "rationale"), (F.col("_ids").isNull(), "chunk_ids"), (F.size(F.array_except("_ids", F.coalesce(F.col(allowed), F.array().cast("array<string>")))) > 0, "unknown_chunks"),
        ((F.col("_verdict") != "insufficient_evidence") & (F.size("_ids") == 0), "uncited"),
    )
    out = held.withColumn("error", error)
    good = lambda c: F.when(F.col("error").isNull(), F.col(c))
    return out.select(*rows.columns, good("_verdict").alias("verdict"), good("_confidence").alias("confidence"), good("_rationale").alias("rationale"), good("_ids").alias("evidence_chunk_ids"), "error")


def plan_payloads(rows: DataFrame, question: str, payload: str, most: int = 3) -> DataFrame:
    """rows with sub_queries, intent, domain, confidence and error of a planner's answers.

    Each part has white space squeezed, 1 to 600 characters, and must be traceable to the question; parts come once. error:
    invalid_json, not_object, sub_queries, too_many, invalid_sub_query, untraceable or confidence, the first that holds;
    among parts, that of the first wrong one."""
    held = rows.withColumn("_v", parsed(F.col(payload)))
    v = F.col("_v")
    listed = F.try_variant_get(v, "$.sub_queries", "array<variant>")
    text = lambda x: F.coalesce(F.try_variant_get(x, "$", "string"), F.when(F.is_variant_null(x), "None"), x.cast("string"))
    held = held.withColumn("_q", F.transform(listed, lambda x: _trim(F.regexp_replace(F.coalesce(text(x), F.lit("None")), r"(?U)\s+", " "))))
    wrong = F.filter(F.transform("_q", lambda q: F.when((q == "") | (F.char_length(q) > QUERY_MOST), "invalid_sub_query").when(~traceable(F.col(question), q), "untraceable")), lambda x: x.isNotNull())
    held = held.withColumns({"_wrong": F.get(wrong, F.lit(0)), "_confidence": F.lower(_field(v, "$.confidence", "medium"))})
    error = _first(
        (v.isNull(), "invalid_json"), (~_is(v, "OBJECT"), "not_object"), (F.col("_q").isNull() | (F.size("_q") == 0), "sub_queries"), (F.size("_q") > most, "too_many"),
    )
    error = F.coalesce(error, F.col("_wrong"), _first((~F.col("_confidence").isin(LEVELS), "confidence")))
    out = held.withColumn("error", error)
    good = lambda c: F.when(F.col("error").isNull(), c)
    part = lambda path, missing: F.substring(_field(v, path, missing), 1, FIELD_MOST)
    return out.select(*rows.columns, good(F.array_distinct("_q")).alias("sub_queries"), good(part("$.intent", "fact_lookup")).alias("intent"), good(part("$.domain", "")).alias("domain"), good(F.col("_confidence")).alias("confidence"), "error")


def normal_window_map(v: Column) -> Column:
    """A window map repaired without changing its facts, as a struct; null where it is no object.

    Units that aren't objects, or have neither title nor summary nor key points, go; title and summary stand in for each
    other, then the first key point; kinds and importance fall back to other and supporting; lists lose blanks. A map with
    units is substantive; one without is named by its reason."""
    none = F.array().cast("array<string>")
    text = lambda x: _trim(F.coalesce(F.try_variant_get(x, "$", "string"), F.when(F.is_variant_null(x), "None"), x.cast("string")))

    def listed(u: Column, name: str) -> Column:
        return F.coalesce(F.filter(F.transform(F.try_variant_get(u, f"$.{name}", "array<variant>"), text), lambda x: x != ""), none)

    def unit(u: Column) -> Column:
        points = listed(u, "key_points")
        title, summary = F.nullif(_field(u, "$.title", ""), F.lit("")), F.nullif(_field(u, "$.summary", ""), F.lit(""))
        own = F.coalesce(title, summary, F.get(points, F.lit(0)))
        importance = _field(u, "$.importance", "")
        return F.struct(
            own.alias("title"), F.coalesce(summary, own).alias("summary"), F.coalesce(F.nullif(_field(u, "$.unit_type", "other"), F.lit("")), F.lit("other")).alias("unit_type"), F.when(importance.isin(IMPORTANCE), importance).otherwise("supporting").alias("importance"),
            points.alias("key_points"), listed(u, "recommendations").alias("recommendations"), listed(u, "uncertainties").alias("uncertainties"), _strings(u, "$.source_refs").alias("source_refs"),
            F.array_sort(F.json_object_keys(u.cast("string"))).alias("fields"),
        )

    units = F.coalesce(F.try_variant_get(v, "$.units", "array<variant>"), F.array().cast("array<variant>"))
    kept = F.filter(F.transform(F.filter(units, lambda u: _is(u, "OBJECT")), unit), lambda u: u["title"].isNotNull())
    reason = _field(v, "$.non_content_reason", "")
    kind = F.when(F.size(kept) > 0, "substantive").when(F.contains(reason, F.lit(ADVERTISEMENT)), "advertisement").when(reason.rlike(INTRO), "intro_outro").otherwise("empty")
    return F.when(_is(v, "OBJECT"), F.struct(kind.alias("content_type"), kept.alias("units"), F.when(F.size(kept) > 0, "").otherwise(reason).alias("non_content_reason"), F.array_sort(F.json_object_keys(v.cast("string"))).alias("fields")))


def window_maps(rows: DataFrame, payload: str, allowed: str, primary: str, most: int = UNITS_MOST) -> DataFrame:
    """rows with content_type, units, non_content_reason and violations (`path: what`, in order) of a window's map, after
    normal_window_map. allowed and primary: the references of the window, and those that aren't context only."""
    held = rows.withColumn("_v", parsed(F.col(payload))).withColumn("_m", normal_window_map(F.col("_v")))
    m = F.col("_m")
    extra = lambda have, want, must: F.size(F.array_except(have, F.array(*map(F.lit, want)))) + F.size(F.array_except(F.array(*map(F.lit, must)), have)) > 0

    def of(u: Column, i: Column) -> Column:
        name = F.concat(F.lit("units["), i.cast("string"), F.lit("]"))
        case = lambda holds, what: F.when(F.coalesce(holds, F.lit(False)), F.concat(name, F.lit(what)))
        refs = u["source_refs"]
        return F.array_compact(
            F.array(
                case(extra(u["fields"], UNIT_FIELDS, ["source_refs"]), ": fields do not match"), case(refs.isNull() | F.exists(refs, lambda x: _trim(x) == ""), ".source_refs: not a list of strings"), case(F.size(refs) == 0, ".source_refs: empty"),
                case(F.size(F.array_except(refs, F.col(allowed))) > 0, ".source_refs: unknown"), case((F.size(refs) > 0) & ~F.arrays_overlap(refs, F.col(primary)), ".source_refs: context only"),
            )
        )

    root = F.array_compact(
        F.array(
            F.when(F.col("_v").isNull(), "root: no JSON").when(m.isNull(), "root: not an object"), F.when(extra(m["fields"], MAP_FIELDS, ["units"]), "root: fields do not match"),
            F.when((F.size(m["units"]) == 0) & (m["non_content_reason"] == ""), "non_content_reason: empty"), F.when(F.size(m["units"]) > most, "units: too many"),
        )
    )
    found = F.concat(root, F.coalesce(F.flatten(F.transform(m["units"], of)), F.array().cast("array<string>")))
    return held.withColumn("violations", found).select(*rows.columns, m["content_type"].alias("content_type"), m["units"].alias("units"), m["non_content_reason"].alias("non_content_reason"), "violations")
