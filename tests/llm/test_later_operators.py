"""Brute-force tests of importance resampling, language identification and periodic runs."""

import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quillmere.llm import importance, language_id, periodic_runs, words

SF = "/root/testdata/sf0.001"
data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, key string, rank string, position string, t string"


def docs_of(spark, rows):
    """Rows (doc_id, text, lang) with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(*r, "k", "r", "p", "t") for r in rows], DOCS)


# importance resampling


def features(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def plain_resample(rows, target, percent=25, buckets=10000):
    n = [[0] * buckets, [0] * buckets]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    for k, texts in enumerate(([t for _, t in rows], target)):
        for t in texts:
            for f in features(t)[1]:
                n[k][bucket(f)] += 1
    S, T = map(sum, n)
    gain = [math.floor(1000 * math.log((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))) for s, t in zip(*n)]
    out = []
    for doc_id, text in rows:
        w, f = features(text)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        score = None
        if doc_id is not None:
            h = int(hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(f), weight, score, None, len(w)])
    pool = sorted((r for r in out if r[5] >= 20 and r[0] is not None), key=lambda r: (-r[3], r[0], -r[1]))
    for k, r in enumerate(pool[: percent * len(pool) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def test_importance_equals_plain_python(spark):
    rng = random.Random(4)
    vocabulary = ["alpha", "Beta", "gämma", "ΔELTA", "x9", "long" * 30, "漢字", "e"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60)))) for i in range(150)]
    rows += [(i, None) for i in (900, 901)] + [(902, ""), (903, " ,;\x00 "), (None, "no key " * 30), (904, "z" * 100 + " one " * 5000)]
    rows += [(5, rows[5][1])] * 40 + [(7, rows[7][1] + " more")]  # repeated rows, and a repeated key with another text
    target = ["alpha beta e", None, "x9, x9; e LONG", ""]
    table = docs_of(spark, [(i, t, None) for i, t in rows])
    aim = spark.createDataFrame([(t, 1) for t in target], "text string, bucket int")
    got = importance.resample(table, aim)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_resample(rows, target)
    assert sorted((tuple(r) for r in importance.resample(table, aim.limit(0)).collect()), key=repr) == plain_resample(rows, [])
    assert importance.resample(table.limit(0), aim).count() == 0


def test_pair_checksums():
    texts = pa.array(["one two", None, "", "ab " + "c" * 80 + " d é", "x", "y z"])
    found = words.split_words(texts, words.ALPHANUMERIC, lower=True)
    one, two, linked = importance.feature_buckets(found, 1 << 31)
    names = [n.decode() for n in found.names.take(pa.array(found.codes)).to_pylist()]
    assert names == ["one", "two", "ab", "c" * 80, "d", "é", "x", "y", "z"]
    assert [x for x, k in zip(two, linked) if k] == [zlib.crc32(f.encode()) % (1 << 31) for f in ("one two", "ab " + "c" * 80, "c" * 80 + " d", "d é", "y z")]
    assert list(one) == [zlib.crc32(n.encode()) % (1 << 31) for n in names]


@pytest.mark.parametrize("size", [1, 3, 250, 999, 1000])
def test_bracket_holds_the_cutoff(spark, size):
    values = sorted([5] * 400 + list(range(600)), reverse=True)
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    for share in (0.0, 0.5, 1 - size / 1000):  # wrong guesses are widened
        lo, hi, above = importance.cutoff_bracket(rows, "v", share, size)
        assert above == sum(v > hi for v in values) < size <= sum(v >= lo for v in values)


# language identification


def plain_bits(counts, context, byte):
    """PPM code length straight from the definition; counts: context -> byte -> count."""
    excluded, bits = set(), 0.0
    while True:
        if context in counts:
            left = {b: n for b, n in counts[context].items() if b not in excluded}
            total, distinct = sum(left.values()), len(left)
            if byte in left:
                return bits + math.log2((total + distinct) / left[byte])
            if distinct:
                bits += math.log2((total + distinct) / distinct)
            excluded |= set(counts[context])
        if not context:
            return bits + math.log2(256 - len(excluded))
        context = context[1:]


def test_code_lengths_equal_the_definition():
    rng = random.Random(9)
    make = lambda al, n: "".join(rng.choice(al) for _ in range(n))
    samples = {"aa": [make("abc é", 80) for _ in range(5)], "bb": [make("bcd xyz", 60) for _ in range(6)]}
    grams, language, count, plain = [], [], [], []
    for k, texts in enumerate(samples.values()):
        found, n = np.unique(language_id.grams(pa.array(texts))[1], return_counts=True)
        grams.append(found)
        language.append(np.full(len(found), k))
        count.append(n)
        tree = {}
        for t in texts:
            raw = bytes([language_id.PAD]) * 4 + t.encode()
            for i in range(4, len(raw)):
                for d in range(5):
                    tree.setdefault(raw[i - d : i], {}).setdefault(raw[i], 0)
                    tree[raw[i - d : i]][raw[i]] += 1
        plain.append(tree)
    scorer = language_id.Scorer(language_id.Model("k", list(samples), *map(np.concatenate, (grams, language, count))))
    texts = ["", None, "abc", "zzz q", "é漢\x00b", make("abcdé xyz", 500), *samples["aa"]]
    got = scorer.code_lengths(pa.array(texts)) / language_id.UNIT
    for row, t in zip(got, texts):
        raw = bytes([language_id.PAD]) * 4 + (t or "").encode()
        want = [sum(plain_bits(tree, raw[i - 4 : i], raw[i]) for i in range(4, len(raw))) for tree in plain]
        assert np.allclose(row, want, atol=0.01)


def test_languages_of_a_fixture(spark):
    rng = random.Random(2)
    stems = {"aa": ["the", "and", "ing", "of"], "bb": ["der", "und", "ein", "ß"], "cc": ["que", "los", "ción"]}
    text = lambda lang, n: " ".join("".join(rng.choice(stems[lang]) for _ in range(2)) for _ in range(n))
    rows = [(i, text(lang, 40), lang) for i, lang in enumerate(list(stems) * 40)]
    rows += [(500, None, "aa"), (501, "", "bb"), (502, "12 34 !", "cc"), (503, text("bb", 20000), None), (None, text("cc", 30), None)]
    rows += [rows[0]] * 30
    table = docs_of(spark, rows)
    model = language_id.fit(table)
    assert model.languages == ["aa", "bb", "cc"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(table, model).collect()}
    assert got[500] == got[501] == got[502] == ("und", 0.0)
    assert got[503][0] == "bb" and got[None][0] == "cc"
    assert all(got[i][0] == lang and 0.5 < got[i][1] <= 1 for i, _, lang in rows[:120])
    nothing = language_id.fit(table.where("lang = 'none'"))
    assert {tuple(r)[1:] for r in language_id.predict(table, nothing).collect()} == {("und", 0.0)}
    assert language_id.predict(table.limit(0), model).count() == 0


def test_sample_is_bounded(spark):
    """A key that repeats, and long texts, don't take the sample over its limit."""
    table = docs_of(spark, [(1, "abc " * 2000, "aa")] * 200 + [(i, "defg " * 700, "bb") for i in range(50)])
    blocks = language_id.sample_blocks(table, "text", "lang", "doc_id", 20)
    assert {r["lang"]: r["n"] for r in blocks.groupBy("lang").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()} == {"aa": 8, "bb": 10}


@data
def test_held_out_accuracy(spark):
    found = language_id.op12_language_id(spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").where("held_out").collect()
    assert len(rows) > 30 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)


# periodic runs


def plain_runs(w):
    """All (start, period, length), by comparing the words with themselves at every distance."""
    found = {}
    for q in range(len(w) // 2, 0, -1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            a = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - a + q >= max(12, 2 * q):
                found[a, i - a + q] = q
    return sorted((a, q, size) for (a, size), q in found.items())


def periodic_text(rng):
    letters = "ab" if rng.random() < 0.6 else "abcdef"
    make = lambda n: [rng.choice(letters) for _ in range(n)]
    kind = rng.randrange(8)
    if kind == 0:
        return make(rng.randrange(90))
    if kind == 1:
        u = make(rng.randrange(1, 40))
        return make(5) + u * rng.randrange(2, 6) + u[: rng.randrange(len(u))] + make(4)
    if kind == 2:
        return (["a"] * rng.randrange(1, 90) + ["b"]) * rng.randrange(2, 4)
    if kind == 3:  # two highly periodic regions that meet out of step
        r = make(rng.randrange(1, 5))
        return (r * 200)[: rng.randrange(20, 120)] + (r[rng.randrange(len(r)) :] + r * 200)[: rng.randrange(20, 120)]
    if kind == 4:  # Fibonacci words
        a, b = "a", "ab"
        while len(b) < 150:
            a, b = b, b + a
        return list(b[rng.randrange(20) :])
    if kind == 5:  # Thue-Morse words, which fool hashes modulo a power of two
        t = "a"
        while len(t) < 2048:
            t += t.translate(str.maketrans("ab", "ba"))
        at = rng.randrange(1800)
        return list(t[at : at + 200]) * rng.randrange(1, 3)
    if kind == 6:
        v = make(rng.randrange(1, 6)) * rng.randrange(2, 30) + make(rng.randrange(3))
        return (v * 3)[:300]
    u = [str(x) for x in range(rng.randrange(1, 120))]
    return u * 2 + u[: rng.randrange(len(u))]


@pytest.mark.parametrize("seed", range(12))
def test_runs_equal_all_distances(seed):
    rng = random.Random(seed)
    texts = [periodic_text(rng) for _ in range(30)]
    got = periodic_runs.analyse([None] * 30, pa.array([" ".join(t) for t in texts]))
    for t, (_, n, runs, _) in zip(texts, got):
        assert n == len(t) and [tuple(r) for r in runs.tolist()] == plain_runs(t)


def test_wrong_hashes_are_caught():
    """Both halves of a long Thue-Morse word have equal polynomial hashes modulo 2**64."""
    t = "a"
    while len(t) < 4096:
        t += t.translate(str.maketrans("ab", "ba"))
    stretch = periodic_runs.Stretches(np.array([ord(c) for c in t], np.int64))
    i, d = np.array([0, 100]), np.array([2048, 2048])
    assert all(z == a for a, z, _ in zip(*stretch.of(i, d))) or all((t[a:z] == t[a + q : z + q]) for a, z, q in zip(*stretch.of(i, d)))


def plain_op13(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    drop = {i for a, q, size in runs for i in range(a + q, a + size)}
    best = min(((-size, a, q) for a, q, size in runs), default=None)
    longest = (best[1], -best[0], best[2], -best[0] * 1000 // best[2]) if best else (None,) * 4
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *longest, sha("".join(f"{a},{size},{q}\n" for a, q, size in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def test_periodic_runs_query_equals_plain_python(spark, tmp_path):
    rng = random.Random(3)
    texts = [None, "", " \t\n", "one", "\x00 \x00 a", "é  é\té\né " * 20, " ".join("abc" * 5000)]
    texts += ["\n ".join(periodic_text(rng)) for _ in range(150)]
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(None, "a b " * 9, None)] + [(20, texts[20], None)] * 3
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic_runs.op13_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted((plain_op13(i, t) for i, t, _ in rows), key=repr)
    assert periodic_runs.periodic_runs(docs_of(spark, rows).limit(0)).count() == 0


@data
def test_periodic_runs_of_whole_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 6000")
    found = periodic_runs.periodic_runs(docs, plant=False).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(found) == len(texts)
    for r in found:
        assert [(x["start"], x["period"], x["length"]) for x in r["runs"]] == plain_runs(WORD.findall(texts[r["doc_id"]]))
