"""Brute-force tests of segments, glossary, review rules, stored index, matches and filtered fusion."""

import difflib
import json
import math
import random
import re
import time
from collections import Counter

import pyarrow as pa
import pytest

from quillmere.functions.text import char_grams
from quillmere.operators import cases, glossary, matches, payloads, planning, retrieval, review, runstate, segments
from quillmere.operators import chunking, contentmap
from quillmere.plans import knowledge, queries
from quillmere.sources import audits, index_store
from pyspark.sql import functions as F


# segments


def plain_duplicate(a, b):
    overlap = min(a[1], b[1]) - max(a[0], b[0])
    x, y = re.sub(r"\s+", "", a[2] or ""), re.sub(r"\s+", "", b[2] or "")
    if overlap <= 0 or not x or not y:
        return False
    ratio = difflib.SequenceMatcher(None, x, y).ratio()
    span = min(a[1] - a[0], b[1] - b[0])
    return x in y or y in x or ratio >= 0.9 or (overlap >= min(2.0, max(0.5, span * 0.5)) and ratio >= 0.78)


def plain_dedup(rows):
    kept = []
    for r in sorted(rows, key=lambda r: (r[2], r[3], r[1])):
        if not any(plain_duplicate(k[2:5], r[2:5]) for k in kept[-4:]):
            kept.append(r)
    return kept


def segment_rows(seed, key, n, spread):
    rng = random.Random(seed)
    base = ["the quick brown fox jumps over", "pack my box with five dozen jugs", "how vexingly quick daft zebras jump", "x" * 230 + "ab" * 30]
    out = []
    for i in range(n):
        text = list(rng.choice(base))
        for _ in range(rng.randrange(12)):
            text[rng.randrange(len(text))] = rng.choice("abc ")
        text = "".join(text)[: rng.randrange(1, 300)]
        start = round(rng.random() * spread, 1)
        out.append((key, i, start, round(start + rng.random() * 6, 1), text))
    return out


SEGMENTS = "key long, pos int, start double, end double, text string, island string"


def test_segment_dedup_equals_the_fold(spark):
    data = [segment_rows(1, 1, 400, 900.0), segment_rows(2, 2, 60, 20.0), segment_rows(3, 3, 5, 10_000.0), [(4, 0, 0.0, 1.0, None), (4, 1, 0.0, 1.0, None), (4, 2, 5.0, 5.0, "a"), (4, 3, 5.0, 5.0, "a")]]
    rows = [r for part in data for r in part]
    df = spark.createDataFrame([(*r, "clash") for r in rows] + [(None, 0, 0.0, 1.0, "no key", "c"), (5, 0, None, 1.0, "no time", "c")], SEGMENTS)
    got = segments.dedup_segments(df.drop("island"), "key", "pos")
    want = [r for part in data for r in plain_dedup(part)]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert segments.dedup_segments(df.drop("island").limit(0), "key", "pos").count() == 0


def test_overlapping_windows_keep_one_of_what_was_heard_twice(spark):
    rows = [(1, 0, 585.0, 595.0, "重叠内容"), (1, 1, 595.0, 600.0, "第一段"), (1, 2, 590.0, 595.0, "重叠内容"), (1, 3, 595.0, 605.0, "第二段")]
    got = segments.dedup_segments(spark.createDataFrame(rows, "key long, pos int, start double, end double, text string"), "key", "pos")
    assert sorted(r["pos"] for r in got.collect()) == [0, 1, 3]


def test_carried_maximum_of_a_hot_key(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(2), i, float(rng.randrange(3000)), float(rng.randrange(5000))) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, i int, at double, v double")
    for inclusive in (False, True):
        got = {r["i"]: r["m"] for r in segments.carried_max(df, ["k"], F.floor(F.col("at") / 100), ["at", "i"], F.col("v"), "m", inclusive).collect()}
        for k, i, at, v in rows:
            before = [x[3] for x in rows if x[0] == k and ((x[2], x[1]) < (at, i) or (inclusive and x[1] == i))]
            assert got[i] == max(before, default=None)


def test_time_alignment(spark):
    one = lambda x: [1.0, float(x)]
    parts = [(1, i, i * 10.0 if i < 6 else 200 + i * 10.0, i * 10.0 + 5 if i < 6 else 205 + i * 10.0, one(20 - i)) for i in range(10)] + [(2, 0, 7.0, 9.0, one(1)), (1, 99, 0.0, 1.0, [1.0, None])]
    segs = spark.createDataFrame(parts, "grp long, pos long, start double, end double, embedding array<double>")
    chunks = spark.createDataFrame([(1, 5, one(1)), (1, 6, one(-1)), (2, 7, one(0)), (3, 8, one(0)), (1, 9, None)], "grp long, chunk long, embedding array<double>")
    got = {r["chunk"]: tuple(r)[2:] for r in segments.align_time(chunks, segs).collect()}
    # the eight best of chunk 5 are 0..7: six together, then two; those of chunk 6 are 9..2: four and four
    assert got == {5: (0.0, 55.0, 6), 6: (20.0, 55.0, 4), 7: (7.0, 9.0, 1), 8: (None, None, 0), 9: (None, None, 0)}


# glossary


def plain_annotation(text, entries):
    records, replaced, used = [], [], []
    for e in entries:
        for alias in e["aliases"]:
            at = text.find(alias)
            while at >= 0:
                end = at + len(alias)
                around = text[max(0, at - 120) : at] + text[end : end + 120]
                matched = [c for c in e["context"] if c in around]
                grounded = bool(matched) or not e["context"]
                records.append((at, end, e["canonical"], alias, tuple(matched), grounded))
                if grounded and not any(at < z and end > a for a, z in used):
                    used.append((at, end))
                    replaced.append((at, end, f"{alias}〔疑似术语：{e['candidate']}{'；' + e['note'] if e['note'] else ''}〕"))
                at = text.find(alias, end)
    for a, z, mark in sorted(replaced, reverse=True):
        text = text[:a] + mark + text[z:]
    return text, sorted(records)


def test_annotation_equals_plain_python_and_is_reversible(spark):
    entries = sorted(knowledge.glossary(spark).collect(), key=lambda e: e["entry"])
    assert [(e["entry"], e["canonical"], e["candidate"], e["aliases"]) for e in entries] == [(0, "retition", "repetition", ["ing the", "ion the"]), (1, "thereof", "thereof", ["th the", "the"]), (2, "erent", "erent", ["ere"]), (5, "sur", "sur", ["ou", "our", "s,"])]
    rng = random.Random(8)
    texts = ["", None, "the there thethe", "[1.0s -> 2.5s] é the ere\n[3s->4s] our thing\nno time ou " + "x" * 200 + " ment", "〔疑似术语：x〕 the"]
    texts += [" ".join(rng.choice(["the", "there", "our", "thing", "ment", "s,", "é", "pion the", "\n"]) for _ in range(rng.randrange(200))) for _ in range(60)] + ["the ere " * 4000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, hits string")
    rows = {r["doc_id"]: r for r in glossary.restored(glossary.annotated(glossary.alias_records(docs, entries))).collect()}
    for i, t in enumerate(texts):
        if t is None:
            assert rows[i]["records"] == []
            continue
        text, records = plain_annotation(t, [e.asDict() for e in entries])
        assert rows[i]["annotated"] == text and rows[i]["restored"] == t
        assert sorted((r["start_char"], r["end_char"], r["canonical"], r["original"], tuple(r["matched_contexts"]), r["grounded"]) for r in rows[i]["records"]) == records
    times = {(r["original"], r["segment_start"], r["segment_end"]) for r in rows[3]["records"]}
    assert ("the", 1.0, 2.5) in times and ("our", 3.0, 4.0) in times and ("ou", None, None) in times


# review rules

CHECKLIST = """## 医疗逐字稿与总结
### 消化系统
- `〔疑似转写错误：胃尿保护剂、番茄印〕`：需要回听。
- `〔术语边界不清：反流〕`：需说明症状或疾病。

## 仍需人工确认
- `偏头痛等位征`：待专家确认。
"""


def rules_of(spark, text=CHECKLIST):
    return review.review_rules(spark.createDataFrame([(1, text)], "doc_id long, text string"))


def test_checklist_rules(spark):
    rows = sorted(rules_of(spark).collect(), key=lambda r: (r["line_number"], r["pos"]))
    assert [(r["issue_type"], r["severity"], r["terms"], r["section"], r["line_number"]) for r in rows] == [
        ("疑似转写错误", "block", ["胃尿保护剂", "番茄印"], "消化系统", 3),
        ("术语边界不清", "warn", ["反流"], "消化系统", 4),
        ("人工确认", "block", ["偏头痛等位征"], "仍需人工确认", 7),
    ]
    assert rules_of(spark, None).count() == 0
    assert rules_of(spark, "〔a：x/y 或 x〕 〔b待核：,〕\r\n## S\r〔c：d〕").select("line_number", "pos", "terms", "severity", "section").orderBy("line_number", "pos").collect() == [(1, 0, ["x", "y"], "warn", ""), (1, 1, [], "block", ""), (3, 0, ["d"], "warn", "S")]


RESULTS = "qid long, text string, domain string, risk_level string, chunk_type string, quality string, answer_policy string, source_of_truth boolean"


@pytest.mark.parametrize(
    "question, results, want",
    [
        ("胃痛怎么治疗？", [("可以使用胃尿保护剂", "medical", "high", "raw_transcript", "raw_unverified", None, None)], ("block", "high", [review.PENDING_TERMS], ["胃尿保护剂"])),
        ("这个药应该用多少剂量？", [("二次总结", "medical", "high", "structured_summary", "derived_pending_review", None, None)], ("block", "high", [review.NO_SOURCE], [])),
        ("怎么用药", [("总结", "medical", None, "structured_summary", "human_reviewed", "summary_requires_raw_evidence", None)], ("block", "high", [review.SUMMARY_ONLY], [])),
        ("what is it", [("反流", "medical", None, None, None, None, None)], ("warn", "medium", [review.AMBIGUOUS], ["反流"])),
        ("what is it", [("a", "medical", None, None, "derived_pending_review", None, None)], ("warn", "medium", [review.PENDING_SUMMARY], [])),
        ("what is it", [("番茄印", "cooking", "low", None, None, None, None)], ("allow", "low", [], [])),
        ("what is it", [], ("allow", "low", [], [])),
        ("手术", [("a", None, None, "raw_transcript", None, None, None)], ("warn", "high", [review.UNREVIEWED], [])),
    ],
)
def test_safety_gate(spark, question, results, want):
    found = review.safety_gate(spark.createDataFrame([(1, question)], "qid long, question string"), spark.createDataFrame([(1, *r) for r in results], RESULTS), rules_of(spark))
    assert [tuple(r)[1:] for r in found.collect()] == [want]


def test_terms_meet_all_texts(spark):
    rng = random.Random(6)
    make = lambda n: "".join(rng.choice("abcÉ漢 ") for _ in range(n))
    texts = [make(rng.randrange(60)) for _ in range(50)] + [None, "a"]
    terms = sorted({make(rng.randrange(1, 7)).strip() for _ in range(40)} - {""})
    rules = spark.createDataFrame([("warn", i, 0, [t]) for i, t in enumerate(terms)], "severity string, line_number long, pos long, terms array<string>")
    got = {r["k"]: r["terms"] for r in review.matched_terms(spark.createDataFrame(list(enumerate(texts)), "k long, text string"), rules, "k").collect()}
    assert got == {i: found for i, t in enumerate(texts) if (found := [x for x in terms if len(x) > 1 and t and x.lower() in t.lower()])}


def shuffled_bytes(spark) -> int:
    """Bytes that all stages so far have written to shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_are_not_shuffled_to_meet_terms(spark):
    rng = random.Random(8)
    texts = [(i % 7, "".join(rng.choice("abcdefghijklmnop ") for _ in range(2000))) for i in range(200)]
    terms = sorted({"".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 5))) for _ in range(50)})
    rules = spark.createDataFrame([("block", i, 0, [t.upper()]) for i, t in enumerate(terms)], "severity string, line_number long, pos long, terms array<string>")
    before = shuffled_bytes(spark)
    got = {r["k"]: r["terms"] for r in review.matched_terms(spark.createDataFrame(texts, "k long, text string"), rules, "k", block_terms=9).collect()}
    assert shuffled_bytes(spark) - before < sum(len(t) for _, t in texts)
    assert got == {k: [t.upper() for t in terms if any(t in x for i, x in texts if i == k)] for k in range(7)}


# matches and the stored index


def documents(spark, n=60, seed=3):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eta", f"w{rng.randrange(30)}"]) for _ in range(rng.randrange(1, 40))), rng.choice(["en", "de", "fr"])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string")


def vectors_of(spark, n, name, seed):
    rng = random.Random(seed)
    rows = [(i, [float(rng.randrange(-3, 4)) for _ in range(4)]) for i in range(n)]
    return rows, spark.createDataFrame(rows, f"{name} long, embedding array<double>")


def test_best_vectors_skip_unusable_ones(spark):
    rows, good = vectors_of(spark, 300, "doc_id", 1)
    own, asked = vectors_of(spark, 40, "qid", 2)
    odd = spark.createDataFrame([(900, None), (901, [1.0, None, 2.0, 3.0]), (902, [1.0, float("nan"), 0.0, 0.0]), (903, [9.0] * 3), (904, [float("inf")] * 4), (905, [])], "doc_id long, embedding array<double>")
    more = spark.createDataFrame([(90, None), (91, [1.0, 1.0, 1.0]), (92, [None] * 4)], "qid long, embedding array<double>")
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    for sizes in ((50, 7), (10_000, 1000)):
        one = F.lit(0).alias("grp")
        found = matches.best_vectors(good.unionByName(odd).select(one, "doc_id", "embedding"), asked.unionByName(more).select(one, "qid", "embedding"), 5, *sizes)
        got = {}
        for r in retrieval.ranked(found.select("qid", "doc_id", "score"), 5).collect():
            got.setdefault(r["qid"], {})[r["rank"]] = (r["doc_id"], r["score"])
        want = {q: dict(enumerate([(i, s) for s, i in sorted(((score(v, w), i) for i, w in rows), key=lambda x: (-x[0], x[1]))[:5]], 1)) for q, v in own}
        assert got == want | {91: {1: (903, 27.0)}}


def test_best_overlaps_are_over_all_rows(spark):
    rng = random.Random(4)
    sets = lambda n: [(i, rng.sample("abcdefghij", rng.randrange(6))) for i in range(n)]
    rows, asked = sets(200) + [(999, None)], sets(30)
    got = matches.best_overlaps(spark.createDataFrame(rows, "doc_id long, members array<string>"), spark.createDataFrame(asked, "qid long, members array<string>"), 40, 7)
    want = []
    for q, m in asked:
        shared = {i: len(set(m) & set(s or [])) for i, s in rows}
        want += [(q, i, n) for i, n in shared.items() if n and n == max(shared.values())]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def served(spark, tmp_path):
    rows, docs = documents(spark)
    vecs, vectors = vectors_of(spark, 55, "doc_id", 7)
    index_store.build(docs, vectors, str(tmp_path), "m", ["lang"])
    return rows, docs, vecs, vectors, index_store.open_index(spark, str(tmp_path), "m")


def test_index_is_served_only_past_its_gates(spark, tmp_path):
    rows, docs, vecs, vectors, index = served(spark, tmp_path)
    root = str(tmp_path)
    assert (index.n_docs, index.n_tokens) == (60, sum(len(t.split()) for _, t, _ in rows))
    assert sorted(tuple(r) for r in index_store.staged_rows(index).collect()) == [(i, "documents") for i in range(55, 60)]
    again = index_store.serve(docs, vectors, root, "m", ["lang"])
    assert again.generation == index.generation  # same rows, nothing is built
    with pytest.raises(index_store.IndexRefused, match="model"):
        index_store.open_index(spark, root, "other")
    changed = docs.withColumn("text", F.concat("text", F.lit(" new")))
    later = index_store.serve(changed, vectors, root, "m", ["lang"])
    assert later.generation > index.generation and later.n_tokens == index.n_tokens + 60
    # a table that lost rows, a generation that was never finished, and an empty root
    later.vectors.limit(10).write.mode("overwrite").parquet(f"{root}/lost")
    import shutil

    shutil.rmtree(f"{root}/generation-{later.generation}/vectors")
    with pytest.raises(index_store.IndexRefused, match="missing"):
        index_store.open_index(spark, root, "m")
    shutil.copytree(f"{root}/lost", f"{root}/generation-{later.generation}/vectors")
    with pytest.raises(index_store.IndexRefused, match="n_vectors"):
        index_store.open_index(spark, root, "m")
    shutil.rmtree(f"{root}/generation-{later.generation}/manifest")
    assert index_store.open_index(spark, root, "m").generation == index.generation
    with pytest.raises(index_store.IndexRefused, match="no finished"):
        index_store.open_index(spark, f"{root}/none", "m")


def test_filtered_fusion_equals_full_ranking(spark, tmp_path):
    rows, docs, vecs, vectors, index = served(spark, tmp_path)
    own, asked = vectors_of(spark, 12, "qid", 9)
    texts = [(q, t) for q, t, _ in documents(spark, 12, 5)[0]] + [(50, "alpha w3")]
    questions = spark.createDataFrame(texts, "qid long, text string")
    asked = asked.where("qid <> 3")
    dense = matches.best_vectors(vectors.select(F.lit(0).alias("grp"), "*"), asked.select(F.lit(0).alias("grp"), "*"), 1000)
    legs = [retrieval.ranked(dense.select("qid", "doc_id", "score")), retrieval.ranked(retrieval.bm25(index, questions))]
    for langs, first in ((["de"], 2), (["none"], 64)):
        allowed = docs.where(F.col("lang").isin(langs)).select("doc_id")
        full = retrieval.ranked(retrieval.fuse(*legs).join(allowed, "doc_id", "left_semi"), 5)
        got = retrieval.filtered_fusion(index, asked, questions, allowed, 5, first)
        key = lambda df: sorted((r["qid"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())
        assert key(got) == key(full)


def test_posting_lists_are_merged(monkeypatch):
    rng = random.Random(12)
    docs = [(rng.choice([-20_000, -3, 5, 16_383, 16_384, 40_000, *range(100, 140)]), [rng.choice("abcdefgh") for _ in range(rng.choice([0, 2, 5, 9]))]) for _ in range(120)]
    monkeypatch.setattr(index_store, "LISTED_WORDS", 40)
    batch = lambda rows, names, kinds: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)
    cut = lambda rows, n: [rows[i : i + n] for i in range(0, len(rows), n)]
    listed = pa.Table.from_batches(index_store.list_words(batch(part, ["doc_id", "w"], [pa.int64(), pa.list_(pa.string())]) for part in cut(docs, 7)))
    rows = sorted(([tuple(r.values()) for r in listed.to_pylist()]), key=lambda r: r[:3])
    assert len(rows) > len({r[:2] for r in rows})
    merged = [r for b in index_store.merge_lists(batch(part, listed.schema.names, listed.schema.types) for part in cut(rows, 3)) for r in b.to_pylist()]
    want = Counter((t, i // index_store.BLOCK_IDS, i, len(w)) for i, w in docs for t in w)
    got = [(r["term"], r["block"], *p) for r in merged for p in zip(r["doc_ids"], r["lens"], r["tfs"])]
    assert got == sorted((t, b, i, n, tf) for (t, b, i, n), tf in want.items())
    assert len(merged) == len({r[:2] for r in want})


def test_only_the_best_are_shuffled(spark, tmp_path):
    rng = random.Random(13)
    docs = [(i * 9, " ".join(rng.choice(["alpha", "beta", "gamma", f"w{rng.randrange(30)}"]) for _ in range(rng.randrange(1, 12)))) for i in range(4000)] + [(9, "beta beta w3 w3 w0")]
    asked = [(q, f"alpha beta gamma w{q % 30}") for q in range(60)] + [(70, "alpha nothing"), (71, "?")]
    spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    queries.bm25_topk(spark, str(tmp_path)).collect()  # builds the index
    before = shuffled_bytes(spark)
    got = [(r["qid"], r["rank"], r["doc_id"], r["score"]) for r in queries.bm25_topk(spark, str(tmp_path)).collect()]
    assert shuffled_bytes(spark) - before < 600_000  # 60 times 4000 scores are more
    counted, n = [(i, Counter(t.split())) for i, t in docs], len(docs)
    df, average = Counter(t for _, c in counted for t in c), sum(c.total() for _, c in counted) / n
    want = []
    for q, text in asked:
        scores = Counter()
        for i, c in counted:
            for t in set(text.split()) & set(c):
                scores[i] += (math.log(n / (df[t] + 1)) + 1) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * c.total() / average))
        best = sorted((-round(s, 6), i) for i, s in scores.items())[:12]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert [r[:3] for r in sorted(got)] == [r[:3] for r in want]
    assert all(abs(a[3] - b[3]) < 2e-6 for a, b in zip(sorted(got), want))


def test_filtered_fusion_shuffles_no_pairs(spark, tmp_path):
    rng = random.Random(14)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(["alpha", "beta", "gamma", f"w{rng.randrange(30)}"]) for _ in range(8)), rng.choice(["en", "fr"])) for i in range(4000)], "doc_id long, text string, lang string")
    _, vectors = vectors_of(spark, 300, "doc_id", 15)
    _, asked = vectors_of(spark, 40, "qid", 16)
    questions = spark.createDataFrame([(q, f"alpha beta gamma w{q % 30}") for q in range(40)], "qid long, text string")
    index_store.build(docs, vectors, str(tmp_path), "m", ["lang"])
    index = index_store.open_index(spark, str(tmp_path), "m")
    before = shuffled_bytes(spark)
    found = retrieval.filtered_fusion(index, asked, questions, docs.where("lang = 'en'"), 5)
    assert found.count() == 200
    assert shuffled_bytes(spark) - before < 2_000_000  # 40 times 4000 scores, again and again, are more


def test_containing_documents(spark, tmp_path):
    _, docs, _, _, index = served(spark, tmp_path)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    asked = ["ha", "alpha", "a b", "eta gamma", "lpha beta gam", texts[3][2:30], texts[7].upper(), "w2", "no such thing", "!", "delta delta d"]
    got = retrieval.containing(index, docs, spark.createDataFrame(list(enumerate(asked)), "qid long, text string"))
    want = [(q, i) for q, a in enumerate(asked) if re.search(r"\w", a) for i, t in texts.items() if a.lower() in t.lower()]
    assert sorted((r["qid"], r["doc_id"]) for r in got.collect()) == sorted(want)


def test_char_grams(spark):
    df = spark.createDataFrame([("é漢ab",), ("a",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(char_grams(F.col("t"), [1, 2])).collect()] == [["é", "漢", "a", "b", "é漢", "漢a", "ab"], ["a"], [], []]


def test_char_grams_of_a_long_text_are_linear(spark):
    n = 50_000
    df = spark.createDataFrame([("".join(chr(0x4E00 + i % 20_000) for i in range(n)),)], "t string")
    began = time.monotonic()
    found = df.select(F.size(char_grams(F.col("t"), [2, 3, 4]))).first()[0]
    assert found == 3 * 20_000 and time.monotonic() - began < 20


# earlier faults


def test_references_past_9999(spark):
    rows = spark.range(10_050).select(F.lit(1).alias("k"), F.col("id").alias("pos"), F.lit(0.0).alias("start"), F.lit(1.0).alias("end"), F.lit("line").alias("text"), F.lit(True).alias("timed"))
    chunks = sorted((r["chunk"], r["first_ref"], r["last_ref"]) for r in chunking.raw_chunks(rows, "k").collect())
    assert all(int(a[1:]) <= int(z[1:]) for _, a, z in chunks) and chunks[-1][2] == "S10050"


def test_repeated_evidence_counts_once(spark):
    lines = spark.createDataFrame([(1, 0, "a claim [c1 | S0001]")], "conv_id long, line int, text string")
    evidence = spark.createDataFrame([(1, "c1", ["S0001"], 1), (1, "c1", [], 2)], "conv_id long, chunk_id string, refs array<string>, rank int")
    row = planning.checked_claims(lines, ["conv_id", "line"], evidence, ["conv_id"]).first()
    assert (row["n_citations"], row["valid"]) == (1, True)


def test_abstention_with_citations(spark):
    texts = ["[c1 | S0001] 不知道。", "1. 【回答】 无法回答", "不知道吗", "", None, "\n\n- [x | N/A] 无法回答！"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(contentmap.abstains(F.col("t"))).collect()]
    assert got == [True, True, False, False, False, True]


# payloads of models


def plain_judgment(text, allowed):
    try:
        p = json.loads(re.sub(r"^```(?:json)?\s*|\s*```$", "", text.strip(), flags=re.I).strip())
    except ValueError:
        return "invalid_json"
    if not isinstance(p, dict):
        return "not_object"
    verdict, confidence, rationale = (str(p.get(k, "")).strip() for k in ("verdict", "confidence", "rationale"))
    ids = p.get("evidence_chunk_ids", [])
    if verdict.lower() not in payloads.VERDICTS:
        return "verdict"
    if confidence.lower() not in payloads.LEVELS:
        return "confidence"
    if not rationale:
        return "rationale"
    if not isinstance(ids, list) or any(not isinstance(x, str) for x in ids):
        return "chunk_ids"
    ids = list(dict.fromkeys(x.strip() for x in ids if x.strip()))
    if set(ids) - set(allowed):
        return "unknown_chunks"
    if verdict.lower() != "insufficient_evidence" and not ids:
        return "uncited"
    return verdict.lower(), confidence.lower(), rationale, ids


def test_judgments_equal_plain_python(spark):
    rng = random.Random(3)
    texts = ["", "{", "[1]", "null", "3", '"x"', "{}", "```json\n{}\n```", '{"verdict": null}', '{"verdict": {"a": 1}, "confidence": "high"}']
    for _ in range(150):
        p = {"verdict": rng.choice(["supported", " Contradicted", "insufficient_evidence", "no", 1]), "confidence": rng.choice(["high", "LOW", "medium", None]), "rationale": rng.choice(["ok", " ", 5, None, "a\nb", "漢"]), "evidence_chunk_ids": rng.choice([[], ["c1"], ["c2 ", "c2", ""], ["c3"], [1], ["c1", 1], "c1", None, {}])}
        p = {k: v for k, v in p.items() if rng.random() < 0.95}
        texts.append(rng.choice(["{}", "```json\n{}\n```", "```\n{}```", " {} \n", "{}x"]).replace("{}", json.dumps(p, ensure_ascii=False)))
    rows = spark.createDataFrame([(i, t, ["c1", "c2"], "clash") for i, t in enumerate(texts)] + [(-1, None, None, "clash")], "id long, payload string, shown array<string>, error_of string")
    got = {r["id"]: r["error"] or (r["verdict"], r["confidence"], r["rationale"], r["evidence_chunk_ids"]) for r in payloads.judgments(rows, "payload", "shown").collect()}
    assert got.pop(-1) == "invalid_json"
    for i, t in enumerate(texts):
        want = plain_judgment(t, ["c1", "c2"])
        if "null" in t and want == "chunk_ids" and '"evidence_chunk_ids": null' in t:
            assert got[i] in ("chunk_ids", "uncited")
            continue
        assert got[i] == want, t


@pytest.mark.parametrize(
    "payload, want",
    [
        ('{"sub_queries": ["what is  alpha", "beta now", "what is alpha"], "confidence": "HIGH"}', (["what is alpha", "beta now"], "fact_lookup", "", "high", None)),
        ('```json\n{"sub_queries": ["alpha"], "intent": "x", "domain": null}\n```', (["alpha"], "x", "None", "medium", None)),
        ('{"sub_queries": []}', (None, None, None, None, "sub_queries")),
        ('{"sub_queries": "alpha"}', (None, None, None, None, "sub_queries")),
        ('{"sub_queries": ["alpha", "alpha", "alpha", "alpha"]}', (None, None, None, None, "too_many")),
        ('{"sub_queries": ["alpha", "  "]}', (None, None, None, None, "invalid_sub_query")),
        ('{"sub_queries": ["漢字", ""]}', (None, None, None, None, "untraceable")),
        ('{"sub_queries": ["alpha"], "confidence": "sure"}', (None, None, None, None, "confidence")),
        ("[]", (None, None, None, None, "not_object")),
        ("{", (None, None, None, None, "invalid_json")),
        (None, (None, None, None, None, "invalid_json")),
    ],
)
def test_plan_payloads(spark, payload, want):
    rows = spark.createDataFrame([("what is alpha and beta now", payload)], "question string, payload string")
    assert tuple(payloads.plan_payloads(rows, "question", "payload").first())[2:] == want


UNIT = {"title": "t", "summary": "s", "unit_type": "fact", "importance": "major", "key_points": ["k"], "recommendations": [], "uncertainties": [], "source_refs": ["S0002"]}


@pytest.mark.parametrize(
    "data, kind, n, violations",
    [
        ({"content_type": "empty", "units": [UNIT], "non_content_reason": "x"}, "substantive", 1, []),
        ({"content_type": "substantive", "units": [], "non_content_reason": "这是广告"}, "advertisement", 0, []),
        ({"content_type": "substantive", "units": [], "non_content_reason": "片尾"}, "intro_outro", 0, []),
        ({"content_type": "substantive", "units": [], "non_content_reason": " "}, "empty", 0, ["non_content_reason: empty"]),
        ({"units": [{**UNIT, "title": "", "summary": ""}, {**UNIT, "title": "", "summary": " ", "key_points": [" "]}, 3], "content_type": "x", "non_content_reason": ""}, "substantive", 1, []),
        ({"units": [{**UNIT, "source_refs": ["S0001"]}, {**UNIT, "source_refs": ["S0009", "S0002"]}, {**UNIT, "source_refs": []}, {**UNIT, "source_refs": [1]}], "content_type": "x", "non_content_reason": ""}, "substantive", 4, ["units[0].source_refs: context only", "units[1].source_refs: unknown", "units[2].source_refs: empty", "units[3].source_refs: not a list of strings"]),
        ({"units": [{**UNIT, "more": 1}], "content_type": "x"}, "substantive", 1, ["units[0]: fields do not match"]),
        ({"units": [UNIT] * 13, "content_type": "x", "non_content_reason": "", "a": 1}, "substantive", 13, ["root: fields do not match", "units: too many"]),
        ([], None, None, ["root: not an object"]),
        ("{", None, None, ["root: no JSON"]),
    ],
)
def test_window_maps(spark, data, kind, n, violations):
    text = data if isinstance(data, str) else json.dumps(data, ensure_ascii=False)
    rows = spark.createDataFrame([(text, ["S0001", "S0002"], ["S0002"])], "payload string, allowed array<string>, own array<string>")
    row = payloads.window_maps(rows, "payload", "allowed", "own").first()
    assert (row["content_type"], len(row["units"]) if row["units"] is not None else None, row["violations"]) == (kind, n, violations)
    if n == 1 and kind == "substantive":
        assert row["units"][0]["title"] in ("t", "k") and row["units"][0]["summary"] in ("s", "k")


# evidence audits

UNIT_FIELDS = "conv_id long, rank int, chunk_id string, document_id string, video_id string, text string, chunk_type string, risk_level string, review_status string, source_of_truth boolean, answer_policy string, source_refs array<string>, retrieval_role string"


def units(spark, *rows):
    base = {"conv_id": 1, "rank": 1, "chunk_id": "raw-1", "document_id": "d", "video_id": "v", "text": "t", "chunk_type": "raw", "risk_level": None, "review_status": "approved", "source_of_truth": True, "answer_policy": "direct", "source_refs": ["S0002", "S0001"], "retrieval_role": "primary"}
    data = [tuple({**base, **r}[f.split()[0]] for f in UNIT_FIELDS.split(", ")) for r in rows]
    return audits.evidence_units(spark.createDataFrame(data, UNIT_FIELDS), ["conv_id"])


def test_evidence_units(spark):
    found = units(spark, {}, {"rank": 2, "text": "later"}, {"chunk_id": " b "}, {"chunk_id": " "}, {"chunk_id": None}).collect()
    assert sorted((r["evidence_id"], r["text"], r["risk_level"]) for r in found) == [("E:b", "t", "low"), ("E:raw-1", "t", "low")]
    prints = [units(spark, r).first()["evidence_fingerprint"] for r in ({}, {"retrieval_role": "raw_backtrace"}, {"source_refs": ["S0001", "S0002", "S0001"]}, {"risk_level": "low"}, {"answer_policy": "summary"}, {"review_status": None})]
    assert len(set(prints[:4])) == 1 and len(set(prints)) == 3


AUDITS = "audit_id string, created_us long, index_generation string, question string, answer string, claims array<struct<claim_id:string,evidence_unit_ids:array<string>>>, evidence_units array<struct<evidence_id:string,evidence_fingerprint:string>>, gate string"


def test_audits_are_kept_scanned_and_pruned(spark, tmp_path):
    now, day = 100 * audits.DAY_US, audits.DAY_US
    rows = [
        ("a", 10 * day, "g1", "secret question", "x", [("C1", ["E:1"]), ("C2", ["E:2"]), ("", ["E:1"])], [("E:1", "f1"), ("E:2", "f2")], "allow"),
        ("b", 95 * day, "g2", "q", "x", [], [("E:2", "f2")], "allow"),
        ("c", 95 * day, "g1", "q", "x", [("C1", ["E:2"])], [("E:2", "f2")], "allow"),
        ("d", 200 * day, "g2", "q", "x", None, [], "block"),
    ]
    path = f"{tmp_path}/audits"
    records = spark.createDataFrame(rows, AUDITS)
    assert audits.persist(records.limit(0), path) == 0
    assert audits.persist(records.where("audit_id <> 'd'").unionByName(records.where("audit_id = 'a'")), path) == 3
    assert audits.persist(records.withColumn("question", F.lit("rewritten")), path) == 1
    stored = spark.read.parquet(path)
    assert {r["audit_id"]: r["question"] for r in stored.collect()} == {"a": "secret question", "b": "q", "c": "q", "d": "rewritten"}
    current = spark.createDataFrame([("E:1", "other"), ("E:2", "f2")], "evidence_id string, evidence_fingerprint string")
    scanned = audits.scan(stored, current, "g2", now, 30)
    assert "question" not in scanned.columns and "answer" not in scanned.columns
    assert sorted(tuple(r) for r in scanned.collect()) == [("a", "invalidated", 90.0, True, ["C1"], ["E:1"], []), ("b", "current", 5.0, False, [], [], []), ("c", "generation_changed", 5.0, False, [], [], []), ("d", "not_applicable", 0.0, False, [], [], [])]
    gone = audits.scan(stored, current.limit(0), "g2", now).where("audit_id = 'a'").first()
    assert (gone["missing"], gone["affected_claim_ids"], gone["expired"]) == (["E:1", "E:2"], ["C1", "C2"], False)
    assert audits.health(scanned).first().asDict() == {"total": 4, "current": 1, "generation_changed": 1, "invalidated": 1, "not_applicable": 1, "expired": 1, "status": "attention_required"}
    assert audits.prune(spark, path, now, 30) == ["1970-01-11"] and spark.read.parquet(path).count() == 4  # only told
    assert audits.prune(spark, path, now, 30, apply=True) == ["1970-01-11"]
    assert sorted(r["audit_id"] for r in spark.read.parquet(path).collect()) == ["b", "c", "d"]
    assert audits.prune(spark, path, now, 0) == [] and audits.prune(spark, f"{tmp_path}/none", now, 5) == []


# evaluation cases


def test_case_rules(spark):
    q = spark.createDataFrame([("1", "one", "c"), ("1", "one", "c"), ("2", " ", None), ("3", "three", "c"), ("4", "four", "c"), (None, "x", "c"), ("6", "six", "c"), ("7", "seven", "c")], "id string, question string, category string")
    label = lambda i, videos, refs, sources=None, answer=None: (i, videos, refs, sources, ["p"], None, answer)
    e = spark.createDataFrame(
        [label("1", ["v"], ["S0001", "S0002"]), label("2", ["v", "w"], ["S0001"]), label("4", [], [], None, False), label("5", ["v"], ["S0001"]), label("6", ["v", "w"], ["S0001", "S0002"], [("v", "S0001"), ("w", "S0002")]), label("7", ["v"], ["S0001"], [("v", "S0002"), ("", "S0001")], False)],
        "id string, expected_video_ids array<string>, expected_source_refs array<string>, expected_sources array<struct<video_id:string,source_ref:string>>, answer_points array<string>, risk_level string, expected_answer boolean",
    )
    got = {r["id"]: (r["violations"], [tuple(p) for p in r["expected_sources"]]) for r in cases.evaluation_cases(q, e).collect()}
    assert got == {
        "1": (["repeated_question"], [("v", "S0001"), ("v", "S0002")]), "2": (["empty_question", "needs_pairs"], [("v", "S0001")]), "3": (["no_label"], []), "4": ([], []), "5": (["no_question"], [("v", "S0001")]),
        "": (["empty_id", "no_label"], []), "6": ([], [("v", "S0001"), ("w", "S0002")]), "7": (["has_sources", "pair_incomplete"], [("v", "S0002"), ("", "S0001")]),
    }


def test_claim_case_rules(spark):
    rows = [("1", "c", " Supported", None, [("a", "t")]), ("2", " ", "maybe", "done", []), ("2", "c", "supported", "reviewed", [("a", "t"), ("a", "u")]), (None, "c", "contradicted", "pending_human_review", [("a", "")]), ("3", "c", "supported", None, None)]
    df = spark.createDataFrame(rows, "id string, claim string, label string, annotation_status string, evidence array<struct<chunk_id:string,text:string>>")
    got = sorted((r["id"] or "", r["claim"], r["violations"]) for r in cases.claim_cases(df).collect())
    assert got == [("", "c", ["empty_id", "evidence_incomplete"]), ("1", "c", []), ("2", " ", ["repeated_id", "empty_claim", "label", "status", "no_evidence"]), ("2", "c", ["repeated_id", "repeated_chunk"]), ("3", "c", ["no_evidence"])]


# run state


def test_run_states_and_what_is_to_do(spark):
    done = {"status": "completed", "md_path": "m", "profile": "p", "schema_version": "v2", "prompt_version": "1", "transcript": {"text_source": "asr", "backend": "b"}}
    stores = [
        json.dumps({"version": 2, "videos": {"a": {"p": done}, "b": {"p": {**done, "prompt_version": "0"}}, "c": {"p": {**done, "status": "failed"}}, "d": {"p": {**done, "md_path": "gone"}}, "e": {"p": {**done, "transcript": {"text_source": "subtitle"}}}, "f": {"p": {**done, "transcript": {}}}}}),
        json.dumps({"old": {"status": "completed", "md_path": "m"}, "g": {"md_path": "m"}, "h": {**done, "transcript": {"text_source": "asr", "backend": "c"}}}), "{broken", "[]", None,
    ]
    states = runstate.run_states(spark.createDataFrame([(s,) for s in stores], "payload string"), "payload")
    assert sorted((r["video_id"], r["profile"], r["schema_version"]) for r in states.collect()) == [*((v, "p", "v2") for v in "abcdefh"), ("old", "default", "v1")]
    wanted = spark.createDataFrame([*((v, "p", "v2", "1", {"backend": "b"}) for v in "abcdefghi"), ("old", "default", "v1", None, None), ("a", "q", "v2", "1", None)], "video_id string, profile string, schema_version string, prompt_version string, asr_config map<string,string>")
    notes = spark.createDataFrame([("m",)], "md_path string")
    indexed = spark.createDataFrame([(v,) for v in "abcdfhi"] + [("old",)], "video_id string")
    got = {(r["video_id"], r["profile"]): r["reason"] for r in runstate.to_do(wanted, states, notes, indexed).collect()}
    assert got == {("b", "p"): "profile_changed", ("c", "p"): "unfinished", ("d", "p"): "note_missing", ("e", "p"): "not_indexed", ("f", "p"): "transcript_changed", ("g", "p"): "new", ("h", "p"): "transcript_changed", ("i", "p"): "new", ("a", "q"): "new"}
