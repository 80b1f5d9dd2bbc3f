import random
import re

import pyspark.sql.functions as F

from quillmere.operators import evaluation as ev
from quillmere.functions.text import bigrams, clock_seconds, squeeze
from quillmere.operators import index as ix
from quillmere.operators import chunking as ch
from quillmere.operators import timeline as tl
from quillmere.streaming import rates


def test_clock_squeeze_bigrams(spark):
    row = spark.createDataFrame([("00:03:06,500", " a \n b\t", "Ab c")], ["c", "s", "t"]).select(clock_seconds(F.col("c")), squeeze(F.col("s")), bigrams(F.col("t"))).first()
    assert tuple(row) == (186.5, "a b", ["ab", "bc"])


def test_transcript_lines_keep_timed_lines_only(spark):
    docs = spark.createDataFrame([(1, "# head\n[0.0s -> 1.5s] A\nplain\n[2s -> 3s] B"), (2, "first line\n\nsecond line")], ["doc_id", "text"])
    rows = [tuple(r) for r in tl.transcript_lines(docs).orderBy("doc_id", "pos").collect()]
    assert rows == [(1, 1, 0.0, 1.5, "A", True), (1, 3, 2.0, 3.0, "B", True), (2, 0, None, None, "first line", False), (2, 2, None, None, "second line", False)]


def test_subtitle_cues(spark):
    text = "WEBVTT\n\nNOTE x\n\n00:00:01.000 --> 00:00:03.500\n<i>one</i>  two\n\n00:00:01.000 --> 00:00:04.000\none two\n\n2\n00:03:04,250 --> 00:03:06,000\nthree\n\n00:09:00.000 --> 00:08:00.000\nbad"
    rows = [tuple(r) for r in tl.subtitle_cues(spark.createDataFrame([(1, text)], ["doc_id", "text"])).orderBy("cue").collect()]
    assert rows == [(1, 0, 1.0, 3.5, "one two"), (1, 1, 184.25, 186.0, "three")]


def test_heading_sections(spark):
    docs = spark.createDataFrame([(1, "intro\n# One\nbody 1\n## Two\nbody 2")], ["doc_id", "text"])
    assert [tuple(r) for r in ix.heading_sections(docs).orderBy("pos").collect()] == [(1, 0, "", "intro"), (1, 1, "One", "body 1"), (1, 2, "Two", "body 2")]


def test_sentence_runs_cover_and_bound():
    assert ch.sentence_runs([], 100) == []
    assert ch.sentence_runs([40, 50, 30, 250, 60, 60], 100) == [(0, 1, -1), (1, 2, -1), (3, 3, 0), (3, 3, 100), (3, 3, 200), (4, 4, -1), (5, 5, -1)]


def test_windows_take_each_block_once_with_context():
    got = ch.window_bounds([10, 10, 10, 10], [0.0, 30.0, 61.0, 95.0], [29.0, 60.0, 90.0, 99.0], [True] * 4, 60.0, 900, 20.0)
    assert got == [(0, 0, 1), (1, 2, 3)]
    assert ch.block_groups([5, 5, 5, 395], [0.0, 3.0, 20.0, 24.0], [2.0, 4.0, 22.0, 26.0], [True] * 4, 400, 30.0, 5.0) == [1, 1, 2, 3]


def test_rate_limit_expires_accepted_only():
    assert rates.accept([0, 1, 2, 3, 60, 61], 2, 60, [])[0] == [True, True, False, False, True, True]
    assert rates.accept([0, 0], 0, 60, [])[0] == [True, True]


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    rows = [(c, i, t * 1_000_000) for i, (c, t) in enumerate((c, t) for c in (1, 2) for t in (0, 1, 2, 70, 71, 72, 73))]
    df = spark.createDataFrame(rows, "user_id long, event_id long, us long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = rates.rate_limited_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "user_id", "us", "event_id", 2, 60_000_000)
    q = stream.writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).outputMode("append").start()
    q.awaitTermination(120)
    got = {(r.client, r.tie, r.accepted) for r in spark.table("limited").collect()}
    want = {(r.user_id, r.event_id, r.accepted) for r in rates.rate_limited(df, "user_id", "us", "event_id", 2, 60_000_000).collect()}
    assert got == want and len(want) == 14


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rate_limit_streams_clients(spark):
    rng = random.Random(8)
    rows = [(rng.choice([1, 1, 1, 2, None]), i, rng.randrange(400)) for i in range(600)]
    out = rates.rate_limited(spark.createDataFrame(rows, "user_id long, event_id long, us long").repartition(4), "user_id", "us", "event_id", 3, 20)
    want = set()
    for c in (1, 2, None):
        own = sorted((us, i) for who, i, us in rows if who == c)
        want |= {(c, i, ok) for (_, i), ok in zip(own, rates.accept([us for us, _ in own], 3, 20, [])[0])}
    assert {tuple(r) for r in out.collect()} == want
    assert "FlatMapGroups" not in plan_of(out)


def test_nearest_rank_sorts_ranges_only(spark):
    rng = random.Random(9)
    rows = [(k, rng.choice([1.5, rng.random() * 100])) for k in ("a", "b", None) for _ in range(700)] + [("a", None), ("c", 3.0)]
    out = ev.nearest_rank(spark.createDataFrame(rows, "k string, v double"), "k", "v", {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0})
    want = set()
    for k in ("a", "b", "c", None):
        v = sorted(x for who, x in rows if who == k and x is not None)
        want.add((k, len(v), *(v[round((len(v) - 1) * s)] for s in (0.0, 0.5, 0.95, 1.0))))
    assert {tuple(r) for r in out.collect()} == want
    assert "row_number" not in plan_of(out)
