"""Brute-force and oracle tests of the llm operators on small fixtures."""

import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest

from quillmere.llm import license_scan, ngram_join, packing, quality_rules, sentencepieces, suffix_dedup, suffix_sort, token_counts, topk_search, toxicity, warc
from quillmere.llm import registry
from quillmere.llm.common import shared_dir
from oracle import same_rows

SF = "/root/testdata/sf0.001"
data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, part string, keys string"


def docs_of(spark, texts, first=0):
    """Documents with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(first + i, t, "en", "s", len(t or ""), "p", "k") for i, t in enumerate(texts)], DOCS)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "ouen", "thea", "nd"]) + str(rng.randrange(50)) for _ in range(n))


def edge_texts():
    a, b = prose(1, 120), prose(2, 150)
    return [None, "", " \n\t", "one", "one two", "One TWO", a, a, a.upper(), a + " more words here", b, b[:300] + " cut " + b[300:], a + "\n" + b, "é" * 80, "xyz " * 3000, prose(3, 20000)]


@data
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    same_rows(spark, SF, registry.queries()[name], registry.oracle_sql()[name])


def test_token_counts_equal_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, rng = Tokenizer.from_file(path), random.Random(5)
    texts = edge_texts() + ["".join(rng.choice("ab e'st\n\t 12é漢!?\x1c\x85 ") for _ in range(80)) for _ in range(200)] + ["a<|endoftext|>b <|endoftext|>", "a" * 5000]
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs_of(spark, texts), path).collect()}
    assert got == {i: (len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)}
    assert token_counts.token_counts(docs_of(spark, []), path).count() == 0


def test_packing_is_whole_and_tight(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib, texts = Tokenizer.from_file(path), edge_texts() + [prose(i, 5 * i) for i in range(60)]
    rows = packing.pack(docs_of(spark, texts), path, capacity=256).collect()
    by, seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
    for i, t in enumerate(texts):
        want = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        assert b"".join(bytes(r.ids) for r in sorted(by[i], key=lambda r: r.start)) == want
    for own in seq.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        total = sum(r.length for r in own)
        assert total <= 256 and total & (total - 1) == 0
    assert packing.pack(docs_of(spark, []), path).count() == 0


def test_packed_ids_equal_the_library_on_any_text():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib, rng = Tokenizer.from_file(path), random.Random(9)
    special = [t.content for t in lib.get_added_tokens_decoder().values()]
    pieces = [*special, *map(str.upper, special), *(x[:5] + x[5:].title() for x in special), "\u0130.", "\u0130,", "I\u0307.", "\u01c5.", "\u00df,", "ab.", "CD, ", "\n", " ", "\t", "\u00e9.", "e\u0301,", "\u6f22.", "\U0001f600.", "12.5,", "it's."]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 9))) for _ in range(1500)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x250, 0x3000), 0x2E])) for _ in range(30)) for _ in range(500)]
    got = packing.encode(texts, path)
    for t, g in zip(texts, got):
        assert np.frombuffer(g, "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, t


def test_packed_ids_of_letters_that_normalisation_takes_apart():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    texts = [a + b for a in ("\u0958", "ab\u0958", "\ufb1d", "ab", "AB", "\u00e9\u00df", "\u00aa", "a'", "<|endoftext|>") for b in (".", ",", "!!", "$.", "'s.", "_", "")]
    for t, g in zip(texts, packing.encode(texts, path)):
        assert np.frombuffer(g, "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, t


def test_pieces_in_use_survive_a_full_cache():
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    packing._caches.clear()
    for i in range(40):
        packing.encode(["often " + " ".join(f"w{i}x{k}" for k in range(30))], path, 200)
        cache = packing._caches[path]
        assert "often" in cache.young and len(cache.young) + len(cache.old) <= 200
    packing._caches.clear()


def test_words_before_commas_and_points_are_kept_once():
    import public_tokenizers
    from tokenizers import Tokenizer

    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(5)
    library = Tokenizer.from_file(path)
    parts = ["quorvex", "a", "\u00e9t\u00e9", "\u012f", "7", "it's", "'s", ",", ".", ", ", ". ", " ", "\n", "\r", "\x85", "\u00a0", "\u00aa", "\u00b2", "\u00d7", '"', ")", "'", "Q", "_", "\x1c", "e\u0301", "<|EndOfText|>"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 12))) for _ in range(4000)] + ["vexquor, drelmu. " * 3]
    assert packing.encode(texts, path, 1000) == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    young = packing._caches[path].young
    assert {"vexquor", "drelmu"} <= young.keys() and not {"vexquor,", "drelmu."} & young.keys()


def test_closest_multiset_is_optimal():
    rng = random.Random(2)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(5)}
        reach = {0}
        for length, k in counts.items():
            for _ in range(k):
                reach |= {x + length for x in reach}
        chosen = packing.closest_multiset(counts, 50)
        assert all(k <= counts[x] for x, k in chosen.items())
        assert sum(x * k for x, k in chosen.items()) == max(x for x in reach if x <= 50)


def test_quality_features_equal_brute_force(spark):
    texts = edge_texts() + ["a b c d e f g h " * 4, "x\nx\n\n \nx", "# * & " + prose(4, 30), prose(9, 30) + "\n" + prose(9, 30)]
    got = {r.doc_id: r for r in quality_rules.quality_cascade(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = WORD.findall(t)
        grams = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {k + j for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        if len(w) < 20 or 100 * len(covered) > 30 * len(w):
            assert not r.kept
    kept = quality_rules.keep_passing(docs_of(spark, texts))
    assert kept.columns == docs_of(spark, []).columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    assert quality_rules.quality_cascade(docs_of(spark, [])).count() == 0


def shingles(t):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(texts, ids=None):
    """(size, component) by row; ids, given for rows that repeat an id, may hold None, which is linked with nothing."""
    ids = list(range(len(texts))) if ids is None else ids
    sets, group = [shingles(t) for t in texts], list(range(len(texts)))
    for i, x in enumerate(sets):
        for j in range(i):
            n = len(x & sets[j])
            if None not in (ids[i], ids[j]) and n and 100 * n >= 75 * (len(x) + len(sets[j]) - n):
                a, b = max(group[i], group[j]), min(group[i], group[j])
                group = [b if g == a else g for g in group]
    least = {g: min((ids[k] for k in range(len(ids)) if group[k] == g and ids[k] is not None), default=None) for g in set(group)}
    return {i: (len(s), least[group[i]]) for i, s in enumerate(sets)}


def near_copies(seed, n, words, edits):
    rng, base = random.Random(seed), prose(seed, words).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(999)}"
        out.append(" ".join(w))
    return out


def test_sets_are_sorted_and_not_hashed(monkeypatch):
    from quillmere.llm import ngram_join
    from quillmere.llm.common import distinct

    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 500):
        x = rng.integers(0, 90, n).astype(np.uint64)
        assert distinct(np.sort(x)).tolist() == sorted(set(x.tolist()))
    texts = [" ".join(rng.choice(list("abc"), n)) for n in (0, 3, 5, 40, 900)]
    monkeypatch.setattr(np, "unique", None)  # takes several times as long as a sort
    sets = ngram_join.shingle_sets(texts)
    assert [len(s) for s in sets] == [0, 1, *(len({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}) for t in texts[2:])]
    assert all((s[1:] > s[:-1]).all() for s in sets)


def test_ngram_join_equals_brute_force(spark):
    texts = edge_texts() + near_copies(11, 60, 90, 6) + near_copies(12, 30, 40, 3) + [prose(1, 120) + " " + prose(50 + i, 40) for i in range(30)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(docs_of(spark, texts).repartition(3)).collect()}
    assert got == brute_components(texts)
    assert ngram_join.join(docs_of(spark, [])).count() == 0


def test_ngram_join_deals_hot_buckets_in_slices(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 8)
    monkeypatch.setattr(ngram_join, "SLICE", 16, raising=False)
    written, materialize = {}, ngram_join.materialize
    monkeypatch.setattr(ngram_join, "materialize", lambda df, name: written.setdefault(name, materialize(df, name)) if name == "pairs" else materialize(df, name))
    texts, chain = near_copies(21, 90, 120, 5), prose(22, 300).split(" ")
    # neighbours in the chain link, its ends do not; all share the words at its middle
    texts += [" ".join(chain[i : i + 180]) for i in range(0, 120, 2)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(docs_of(spark, texts).repartition(3)).collect()}
    assert got == brute_components(texts)
    most = written["pairs"].where("kind = 2").selectExpr("max(octet_length(nodes) div 8)").first()[0]
    assert 0 < most <= 16 + 8 + 4
    assert written["pairs"].where("kind = 2").count() > 0


def test_ngram_join_tells_rows_of_one_id_apart(spark):
    a, b = prose(1, 120), prose(2, 150)
    rows = [(1, a), (2, a + " x"), (2, None), (1, None), (3, b), (3, b), (3, b + " y"), (None, b), (4, ""), (2, b + " z"), (5, a.upper())]
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).drop("text_key").collect()
    want = brute_components([t for _, t in rows], [i for i, _ in rows])
    assert sorted(map(tuple, got), key=str) == sorted(((i, *want[k]) if want[k][0] and i is not None else (i, want[k][0], i) for k, (i, _) in enumerate(rows)), key=str)


def test_pairs_of_a_pool_come_up_once(spark, monkeypatch):
    """Near copies share many keys, yet each candidate pair is written once."""
    written, materialize = {}, ngram_join.materialize
    monkeypatch.setattr(ngram_join, "materialize", lambda df, name: written.setdefault(name, materialize(df, name)))
    texts = near_copies(31, 80, 200, 3)
    ngram_join.join(docs_of(spark, texts).repartition(2)).count()
    n = written["pairs"].where("kind = 0").selectExpr("sum(octet_length(nodes) div 16)").first()[0]
    assert n <= 2 * len(texts)


def test_prefix_keys_take_six_bytes_at_most(spark):
    rows = ngram_join.prefix_rows(docs_of(spark, [" ".join(f"w{i}x{k}" for k in range(2000)) for i in range(5)]), np.zeros(0, np.uint64), np.zeros(0, np.int64)).collect()
    for r in rows:
        keys = ngram_join.expand(r["prefix"])
        assert len(keys) == r["n"] - (3 * r["n"] + 3) // 4 + 1 and (np.diff(keys.astype(np.int64)) > 0).all()
        assert len(r["prefix"]) < 6 * len(keys)



def test_count_tree_bounds_every_pair():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 3, (90, ngram_join.GROUPS)).astype(np.uint16)
    counts[1::3] = counts[::3]
    sizes = counts.sum(axis=1).astype(np.int64)
    got = {tuple(sorted(p)) for x, y in ngram_join.CountTree(counts, sizes).pairs() for p in zip(x.tolist(), y.tolist())}
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if ngram_join.linked(sizes[i], sizes[j], np.minimum(counts[i], counts[j]).sum())}
    assert got == want and want


def brute_repeats(texts):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        b, spans, own = (t or "").encode(), [], set()
        for k in range(len(b) - 49):
            s = b[k : k + 50]
            own.add(s)
            if s in seen:
                if spans and spans[-1][1] >= k:
                    spans[-1][1] = k + 50
                else:
                    spans.append([k, k + 50])
        seen |= own
        cut = [0, *(x for s in spans for x in s), len(b)]
        left = b"".join(b[x:y] for x, y in zip(cut[::2], cut[1::2]))
        out[i] = (len(b), len(b) - len(left), len(spans), hashlib.sha256(left).hexdigest())
    return out


def test_suffix_dedup_equals_brute_force(spark):
    passage, rng = prose(77, 15), random.Random(4)
    texts = edge_texts() + [prose(200 + i, 30) + passage[: rng.randint(40, len(passage))] + prose(300 + i, 20) for i in range(60)] + near_copies(13, 25, 60, 4) + ["ab" * 200, "ab" * 90, "a" * 49, "a" * 50, "a" * 51]
    rows = suffix_dedup.find_repeats(docs_of(spark, texts).repartition(3)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == brute_repeats(texts)
    out = suffix_dedup.dedup(docs_of(spark, texts))
    assert out.columns == docs_of(spark, []).columns and out.count() == len(texts)
    assert suffix_dedup.find_repeats(docs_of(spark, [])).count() == 0 == suffix_dedup.dedup(docs_of(spark, [])).count()


@pytest.mark.parametrize("rows", [[(1, prose(1, 40))], [(1, prose(1, 40)), (2, prose(2, 60))], [(1, None)], [(None, None)], [(1, "x" * 60), (1, "x" * 60)], [(7, "y" * 50), ((1 << 63) - 1, "y" * 50), (None, "y" * 50)]])
def test_suffix_dedup_without_shared_passages(spark, rows):
    got = {(r.doc_id, r.n_removed) for r in suffix_dedup.find_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(i, 50 if i == (1 << 63) - 1 else 0) for i, _ in rows}


def test_suffix_dedup_splits_hot_anchors(spark, monkeypatch):
    """Anchors with many different stretches are dealt by ranges of windows and, beyond that, one by one."""
    for name, value in (("HOT_MARKS", 2), ("HOT_BLOCKS", 5), ("BLOCK_BYTES", 2000)):
        monkeypatch.setattr(suffix_dedup, name, value)
    passage = prose(78, 14)
    texts = [prose(400 + i, 20) + passage[i % 7 :] + prose(500 + i, 20) for i in range(60)] + near_copies(14, 20, 60, 4)
    rows = suffix_dedup.find_repeats(docs_of(spark, texts).repartition(3)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == brute_repeats(texts)


def test_dedup_keeps_columns_of_any_name(spark):
    a = prose(5, 60)
    rows = [(1, a, 7, "x", None, [1]), (2, a, 7, "y", len(a), None), (3, None, 7, "z", 0, [2]), (4, "", 7, "", 0, [])]
    docs = spark.createDataFrame(rows, "doc_id int, text string, own_id int, block string, n_chars int, found array<int>")
    out = suffix_dedup.dedup(docs)
    assert out.schema == docs.schema
    assert [tuple(r) for r in out.orderBy("doc_id").collect()] == [rows[0], (2, "", 7, "y", 0, None), *rows[2:]]


@pytest.mark.parametrize("query", [suffix_dedup.find_repeats, suffix_dedup.dedup])
def test_blocks_are_shuffled_once(spark, query, monkeypatch):
    """The join with the shared keys and that with the found places take the blocks from one shuffle."""
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 2000)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = query(docs_of(spark, near_copies(15, 20, 60, 4)).repartition(3))
        assert len(df.collect()) == 20
        assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_large_lanes_are_split_exactly():
    texts = [bytes(f"{k:030d}", "ascii") + b"ANCHORANCHORANCHOR!!" + bytes(f"{k // 3:030d}", "ascii") for k in range(60)]
    raw = b"".join(texts)
    lanes = list(suffix_dedup.split_lanes([(k, 0, 30, 80 * k, 80) for k in range(60)], raw))
    assert max(map(len, lanes)) <= suffix_dedup.LANE_MOST or len(lanes) > 1
    items = np.array([(n, *item) for n, lane in enumerate(lanes) for item in lane], np.int64).T
    s, w, low = suffix_dedup.window_minima(np.frombuffer(raw, np.uint8), *items, np.arange(60))
    got = {(k, i): k for k in range(60) for i in range(31)}
    for k, i, x in zip(s.tolist(), w.tolist(), low.tolist()):
        got[k, i] = min(got[k, i], x)
    assert got == {(k, i): min(j for j, u in enumerate(texts) if u[i : i + 50] == t[i : i + 50]) for k, t in enumerate(texts) for i in range(31)}


def test_suffix_arrays():
    rng = random.Random(3)
    for _ in range(60):
        texts = [[rng.randint(1, rng.randint(1, 4)) for _ in range(rng.randint(0, 50))] + [0] for _ in range(rng.randint(1, 6))] + [[1, 2] * 15 + [0]]
        sa, base = suffix_sort.suffix_arrays(np.array(sum(texts, [])), np.array([len(t) for t in texts])), 0
        for t in texts:
            assert (sa[base : base + len(t)] - base).tolist() == sorted(range(len(t)), key=lambda i: t[i:])
            base += len(t)


def test_top_k_ties_nulls_and_lengths(spark):
    nan = float("nan")
    rows = [(i, [((i * 7) % 5) / 4 - 0.5, (i % 3) / 2]) for i in range(150)] + [(500, None), (501, [None, 1.0]), (502, [nan, 1.0]), (None, [1.0, 1.0]), (550, [1.0]), (551, [0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int".replace(", label int", ""))
    got = collections.defaultdict(list)
    for r in topk_search.top_k(df, df.where("vec_id % 50 = 0"), 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    q = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows if i is not None and v and None not in v and not any(map(np.isnan, v))}
    for a in (i for i in q if i % 50 == 0):
        want = sorted((-sum(x * y for x, y in zip(q[a], v)), i) for i, v in q.items() if i != a and len(v) == len(q[a]))[:5]
        assert got[a] == [(i, -s) for s, i in want]
    assert topk_search.top_k(df.limit(0), df.limit(0), 5).count() == 0


def test_top_k_takes_large_components_and_refuses_what_passes_64_bits(spark):
    rows = [(0, [2e6, -1.0]), (1, [2.5e6, 3.0]), (2, [-1e7, 0.0]), (3, [0.1, 1e6])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, slot string, chunk int")
    got = [(r.vec_id, r.score) for r in topk_search.top_k(df, df.where("vec_id = 0"), 5).orderBy("rank").collect()]
    q = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
    want = sorted(((-sum(x * y for x, y in zip(q[0], q[i])), i) for i in (1, 2, 3)))
    assert got == [(i, -s) for s, i in want]
    huge = spark.createDataFrame([(0, [1e12]), (50, [1e12])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        topk_search.top_k(huge, huge, 5).collect()


def test_warc_round_trip_and_pushdown(spark, tmp_path):
    html = [None, "", "<p>é</p>", "<p>é</p>", "x" * 300_000, "<p>é</p>", "y"]
    pages = spark.createDataFrame([(i, None if i == 2 else f"http://a/{i} b", h, "z") for i, h in enumerate(html)], "page_id long, url string, html string, sha string")
    path = str(tmp_path / "w")
    warc.write_archive(pages.repartition(2), path)
    rows = {r.record_id: r for r in warc.read_archive(spark, path).collect()}
    assert len(rows) == len(html)
    for i, h in enumerate(html):
        r, b = rows[f"<urn:page:{i}>"], (h or "").encode()
        best = max(k for k, x in enumerate(html) if (x or "") == (h or ""))
        assert (r.payload_bytes, r.payload_digest) == (len(b), warc.digest_of(b))
        assert (r.record_type, r.refers_to) == (("response", None) if best == i else ("revisit", f"<urn:page:{best}>"))
        assert r.payload == (b if best == i else None)
    only = warc.read_archive(spark, path).where("record_type = 'revisit'")
    assert only.count() == 3 and warc.read_archive(spark, path).where("record_id = '<urn:page:4>' and payload_bytes > 5").count() == 1
    warc.write_archive(pages.limit(0), str(tmp_path / "e"))
    assert warc.read_archive(spark, str(tmp_path / "e")).count() == 0


def test_warc_without_page_id_and_of_other_writers(spark, tmp_path):
    pages = spark.createDataFrame([(None, "u", "same"), (7, "u", "same"), (None, "u", "other"), (3, "u", "same"), (3, "u", "same")], "page_id long, url string, html string")
    warc.write_archive(pages, str(tmp_path / "w"))
    rows = sorted((r.record_id, r.record_type, r.refers_to or "") for r in warc.read_archive(spark, str(tmp_path / "w")).collect())
    none, seven, three = "<urn:page:none>", "<urn:page:7>", "<urn:page:3>"
    assert rows == sorted([(none, "response", ""), (none, "response", ""), (seven, "response", ""), (three, "revisit", seven), (three, "revisit", seven)])
    os.mkdir(tmp_path / "p")
    block = b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\nhello"
    one = b"WARC/1.0\r\nwarc-type:response\r\nWARC-Record-ID: <a>\r\nWARC-Target-URI: http://x/\r\n  folded\r\nCONTENT-LENGTH: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    (tmp_path / "p" / "x.warc").write_bytes(one + one.replace(b"<a>", b"<b>"))
    got = warc.read_archive(spark, str(tmp_path / "p"))
    assert [(r.record_id, r.record_type, r.target_uri, bytes(r.payload)) for r in got.orderBy("record_id").collect()] == [(x, "response", "http://x/ folded", b"hello") for x in ("<a>", "<b>")]
    assert got.where("record_id = '<b>'").count() == 1


def test_sampling_without_replacement(spark):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = ["then again", None, "", "a", "漢字 \U0001f600 x", "  two  blanks", prose(8, 400)]
    df = spark.createDataFrame([(i, i % 2, t, "x") for i, t in enumerate(texts)], "conv_id long, turn long, text string, ids string")
    rows = sentencepieces.decode(sentencepieces.sample_encode(df, ["conv_id", "turn"], path, k=4), path).collect()
    lattices = sentencepieces.lattices_of(path)
    for i, t in enumerate(texts):
        own = [r for r in rows if r.conv_id == i]
        assert len({tuple(r.ids) for r in own}) == len(own) >= 1
        assert {r.decoded for r in own} == {lattices.sp.decode(lattices.sp.encode(t or ""))}
        assert all(0 < r.inclusion <= 1 for r in own)
    again = sentencepieces.sample_encode(df, ["conv_id", "turn"], path, k=4).collect()
    assert sorted((r.conv_id, r.sample, r.ids) for r in rows) == sorted((r.conv_id, r.sample, r.ids) for r in again)


def test_first_sample_follows_the_lattice():
    import public_tokenizers

    lattices = sentencepieces.lattices_of(public_tokenizers.path("piece_bpe_32k.model"))
    words = sentencepieces.words_of("sub word", lattices.sp)
    seen, prob = collections.Counter(), {}
    for ((ids, phi, _),) in sentencepieces.sample_batch([words] * 3000, lattices, 1, [i.to_bytes(8, "little") for i in range(3000)]):
        seen[tuple(ids)] += 1
        prob[tuple(ids)] = np.exp(phi)
    for ids, n in seen.most_common(3):
        assert abs(n / 3000 - prob[ids]) < 0.04


def all_segmentations(words, lattices):
    """Every segmentation of the words with its log-probability, by plain enumeration over the vocabulary."""
    out = [((), 0.0)]
    for w in words:
        def rest(j, w=w):
            if j == len(w):
                return [((), 0.0)]
            found = []
            for z in range(j + 1, len(w) + 1):
                if w[j:z] in lattices.pieces:
                    i, weight = lattices.pieces[w[j:z]]
                    found += [((i, *h), weight + p) for h, p in rest(z)]
            if w[j] not in lattices.pieces:
                own = tuple(lattices.bytes[b] for b in w[j].encode())
                found += [((*own, *h), len(own) * lattices.byte_weight + p) for h, p in rest(j + 1)]
            return found
        out = [(a + b, x + y) for a, x in out for b, y in rest(0)]
    total = np.logaddexp.reduce([p for _, p in out])
    return {ids: p - total for ids, p in out}


@pytest.mark.parametrize("text,k", [("ab he", 2), ("sub word", 3), ("a", 4), ("\u6f22x", 2), ("then", 50)])
def test_samples_equal_enumeration(text, k):
    """Distinct segmentations with their log-probabilities, drawn in order without replacement; inclusion scores estimate
    sums over all segmentations without bias."""
    import public_tokenizers

    lattices = sentencepieces.lattices_of(public_tokenizers.path("piece_bpe_32k.model"))
    words, n = sentencepieces.words_of(text, lattices.sp), 4000
    want = all_segmentations(words, lattices)
    pairs, total = collections.Counter(), 0.0
    for rows in sentencepieces.sample_batch([words] * n, lattices, k, [i.to_bytes(8, "little") for i in range(n)]):
        ids = [tuple(r[0]) for r in rows]
        assert len(set(ids)) == len(ids) == min(k, len(want))
        for own, phi, inclusion in rows:
            assert abs(phi - want[tuple(own)]) < 1e-6 and 0 < inclusion <= 1
            total += np.exp(phi) / inclusion / n
        pairs[tuple(ids[:2])] += 1
    assert abs(total - 1) < 0.05
    for own, m in pairs.most_common(5):
        p = np.exp(want[own[0]])
        share = p if len(own) == 1 else p * np.exp(want[own[1]]) / (1 - p)
        assert abs(m / n - share) < 4 * np.sqrt(share * (1 - share) / n) + 1e-3


def test_decoding_in_the_same_pass_gives_the_same_rows(spark):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    df = docs_of(spark, [None, "", "a b", "\u00e9 \u6f22 \U0001f600", prose(4, 300)])
    both = sentencepieces.sample_encode(df, ["doc_id"], path, decoded=True)
    parted = sentencepieces.decode(sentencepieces.sample_encode(df, ["doc_id"], path), path)
    assert both.schema == parted.schema and sorted(both.collect(), key=repr) == sorted(parted.collect(), key=repr)
    with pytest.raises(ValueError):
        sentencepieces.sample_encode(df.withColumnRenamed("doc_id", "decoded"), ["decoded"], path, decoded=True)
    plan = sentencepieces.op3_sentencepieces(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1  # one Python worker a task


def test_sampling_refuses_clashing_keys_and_replaces_the_decoded_column(spark):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    df = spark.createDataFrame([(1, "a b", "x")], "sample long, text string, decoded string")
    with pytest.raises(ValueError, match="sample"):
        sentencepieces.sample_encode(df, ["sample"], path)
    rows = sentencepieces.sample_encode(df, ["decoded"], path, k=1)
    assert [r.decoded for r in sentencepieces.decode(rows, path).collect()] == ["a b"]


def test_label_model_recovers_planted_voters():
    """Rates of voters and a dependent pair, planted in votes without labels, are found again."""
    rng = np.random.default_rng(0)
    toxic = rng.random(20_000) < 0.15
    on, off = np.array([0.5, 0.4, 0.3, 0.6, 0.2, 0.35]), np.array([0.02, 0.01, 0.05, 0.03, 0.01, 0.02])
    votes = rng.random((20_000, 6)) < np.where(toxic[:, None], on, off)
    copy = votes[:, :1] & (rng.random((20_000, 1)) < 0.95) | (rng.random((20_000, 1)) < 0.005)
    p, got_on, got_off, corr = toxicity.label_model(np.concatenate([votes, copy], axis=1))
    assert np.abs(got_on[:6] - on).max() < 0.06 and np.abs(got_off[:6] - off).max() < 0.03
    assert corr[0, 6] > 0.7 and np.abs(corr[:6, :6] - np.eye(6)).max() < 0.2
    assert toxicity.blocks_of(corr).tolist() == [0, 1, 2, 3, 4, 5, 0]
    assert ((p > 0.5) == toxic).mean() > 0.94


def test_labels_do_not_make_the_posterior(spark):
    """With the labels of a tenth of the rows flipped, the scores still follow the voters."""
    rng, texts, labels, truth = random.Random(16), [], [], []
    for i in range(800):
        words = prose(3000 + i, 40).split()
        for _ in range(4 if i % 5 == 0 else 0):
            words[rng.randrange(40)] = rng.choice(["zorgle" + str(rng.randrange(9)), "idiot", "moron"])
        texts.append(" ".join(words))
        truth.append(i % 5 == 0)
        labels.append((i, 1, int(truth[-1] != (i % 10 == 3))))
    docs = docs_of(spark, texts)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), toxicity.is_held_out)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    cut = sorted(got.values())[-160]
    assert sum((got[i] >= cut) == truth[i] for i in range(800)) / 800 > 0.97
    assert model.accuracies["idiot"][0] > 0.3 > 0.05 > model.accuracies["idiot"][1]


def test_label_model_makes_the_scores(spark, monkeypatch):
    """Without the label model's posterior, nothing is left but one score; labels only scale and shift."""
    texts = [prose(5000 + i, 30) + (" idiot moron scum zorgle" if i % 5 == 0 else "") for i in range(300)]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    docs = docs_of(spark, texts)
    fitted = toxicity.fit(docs, labels, toxicity.is_held_out)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, fitted).collect()}
    assert min(scores[i] for i in range(0, 300, 5)) > max(scores[i] for i in range(300) if i % 5)
    model = toxicity.label_model
    monkeypatch.setattr(toxicity, "label_model", lambda votes, chosen=None: (np.full(len(votes), 0.2), *model(votes, chosen)[1:]))
    blank = [r.score for r in toxicity.score(docs, toxicity.fit(docs, labels, toxicity.is_held_out)).collect()]
    assert max(blank) - min(blank) < 0.02


def test_rare_blocks_that_were_chosen_count():
    """Voters of a language of its own never fire along with others; if chosen for their lift they still count."""
    rng = np.random.default_rng(1)
    toxic, other = rng.random(5000) < 0.12, rng.random(5000) < 0.1
    votes = np.zeros((5000, 8), bool)
    votes[:, :4] = (toxic & ~other)[:, None] & (rng.random((5000, 4)) < 0.7)
    votes[:, 4:] = (toxic & other)[:, None] & (rng.random((5000, 1)) < 0.9) & (rng.random((5000, 4)) < 0.95)
    p = toxicity.label_model(votes, np.ones(8, bool))[0]
    assert (p[votes[:, 4:].sum(axis=1) >= 3] > 0.5).all() and (p[votes[:, :4].sum(axis=1) >= 3] > 0.5).all()
    assert (p[~votes.any(axis=1)] < 0.2).all()


@data
def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    rows = toxicity.op9_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out and toxic in (0, 1)").collect()
    toxic, clean = [r.score for r in rows if r.toxic == 1], [r.score for r in rows if r.toxic == 0]
    auc = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) / (len(toxic) * len(clean))
    assert len(toxic) >= 50 and auc >= 0.97


def test_drop_toxic_keeps_columns_of_any_name(spark):
    model = toxicity.Model({"idiot": 6.0}, -3.0)
    docs = spark.createDataFrame([(1, "idiot", 0.5, "a"), (2, "kind", None, None), (2, "kind", None, None), (3, None, 0.1, "c")], "doc_id long, text string, score double, terms string")
    kept = toxicity.drop_toxic(docs, model)
    assert kept.schema == docs.schema and sorted(r.doc_id for r in kept.collect()) == [2, 2, 3]
    assert toxicity.drop_toxic(docs.limit(0), model).count() == 0


def test_quality_cascade_skips_what_it_does_not_reach(spark):
    """Windows of words are only built under the condition that no earlier rule has rejected the row, and the order is by
    rejections per cost, whatever the order that rules are given in."""
    texts = ["few words"] * 30 + [prose(i, 60) for i in range(10)] + [None, "", "a " * 200]
    docs = docs_of(spark, texts)
    rules = quality_rules.default_rules()
    features = quality_rules.with_features(docs)
    names = [r.name for r in quality_rules.order_rules(features, rules[::-1])]
    assert names[0] == "few_words" and names.index("repeated_words") > 0
    plan = quality_rules.keep_passing(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN NOT _failed" in plan
    kept = {r.doc_id for r in quality_rules.keep_passing(docs).collect()}
    assert kept == {r.doc_id for r in quality_rules.quality_cascade(docs).where("kept").collect()} == set(range(30, 40))
    assert quality_rules.keep_passing(docs.limit(0)).count() == 0
    again = docs.unionByName(docs)
    assert quality_rules.keep_passing(again).count() == 2 * len(kept)


def test_keep_one_of_each_component(spark):
    a, b = prose(1, 120), prose(2, 150)
    rows = [(1, a, "p"), (1, a, "q"), (1, a + " x", "r"), (2, a + " y", "s"), (3, b, None), (4, None, "t"), (4, None, "t"), (None, a, "u"), (5, b.upper(), "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    kept = ngram_join.keep_one(docs)
    assert kept.schema == docs.schema
    got = kept.collect()
    assert sorted([r.doc_id for r in got if r.doc_id is not None]) == [1, 3, 4, 4] and len(got) == 5
    assert ngram_join.keep_one(docs.limit(0)).count() == 0


def test_keep_one_leaves_only_what_its_rows_read(spark):
    """Tables of the join are deleted once the groups are written; what was there before stays."""
    docs = docs_of(spark, near_copies(16, 20, 60, 4))
    outer = suffix_dedup.materialize(docs, "outer")
    folder = os.path.join(shared_dir(spark).removeprefix("file://"), "quillmere")
    before = set(os.listdir(folder))
    kept = ngram_join.keep_one(outer)
    assert {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before} == {"groups", "others"}
    assert before <= set(os.listdir(folder))
    want = brute_components([r.text for r in docs.orderBy("doc_id").collect()])
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if i == c)
    assert outer.count() == 20


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(6)
    texts, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        words = prose(1000 + i, 40).split()
        for _ in range(3 if toxic else 0):
            words[rng.randrange(40)] = rng.choice(["zorgle" + str(rng.randrange(9)), "idiot"])
        texts.append(" ".join(words))
        labels.append((i, 1, int(toxic)))
    docs = docs_of(spark, texts + [None, ""])
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), toxicity.is_held_out)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((got[i] >= toxicity.PREDICT_AT) == (i % 5 == 0) for i in held)
    assert right / len(held) > 0.95 and all(0 <= s <= 1 for s in got.values()) and len(got) == 602
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), toxicity.is_held_out)
    assert toxicity.score(docs.limit(0), none).count() == 0


def test_license_scan(spark):
    texts = ["a b\nReleased under the MIT License.\nc", None, "", "nothing here at all", "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0!"]
    got = {r.doc_id: (r.license, r.line) for r in license_scan.license_scan(docs_of(spark, texts)).collect()}
    assert got == {0: ("MIT", 2), 1: (None, None), 2: (None, None), 3: (None, None), 4: ("CC-BY-NC-4.0", 1), 5: ("Apache-2.0", 1)}
    known, rng = license_scan.Templates(license_scan.TEMPLATES, 0.8), random.Random(1)
    pool = [t for ts in license_scan.TEMPLATES.values() for t in ts]
    for _ in range(300):
        words = rng.choice(pool).split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = rng.choice(["x", "the", "license"])
        text = " ".join(words)
        best = max(license_scan.dice(license_scan.bigrams(text), license_scan.bigrams(t)) for t in pool)
        found = known.best(text)
        assert (found is None) == (best < 0.8) and (found is None or abs(found[0] - best) < 1e-12)


def test_license_matches_across_lines(spark):
    mit, gpl = license_scan.TEMPLATES["MIT"][2], license_scan.TEMPLATES["GPL-3.0"][1]
    wrapped = lambda t: "\n# ".join(" ".join(t.split()[i : i + 9]) for i in range(0, len(t.split()), 9))
    long = prose(61, 400)
    texts = [f"{long}\n# {wrapped(mit)}\n{long}\n# {wrapped(gpl)}\n{long}", f"{long} Released under the MIT License. {long}", long, None, "İ" + long + "\n" + wrapped(mit)]
    rows = license_scan.license_matches(docs_of(spark, texts)).collect()
    got = {i: [(r.license, r.dice, texts[i][r.start : r.end]) for r in sorted(rows, key=lambda r: r.start or 0) if r.doc_id == i and r.license] for i in range(5)}
    assert [(x[0], x[1]) for x in got[0]] == [("MIT", 1.0), ("GPL-3.0", 1.0)]
    assert got[0][0][2] == wrapped(mit).rstrip(".") and got[0][1][2] == wrapped(gpl).rstrip(".")
    assert got[1] == [("MIT", 1.0, "Released under the MIT License")] and got[2] == got[3] == []
    assert got[4] == [("MIT", 1.0, wrapped(mit).rstrip("."))]
    assert {r.doc_id: r.license for r in license_scan.license_scan(docs_of(spark, texts)).collect()} == {0: "GPL-3.0", 1: "MIT", 2: None, 3: None, 4: "MIT"}


def test_license_windows_equal_brute_force():
    known, rng = license_scan.Templates(license_scan.TEMPLATES, 0.8), random.Random(3)
    pool = [(name, license_scan.bigrams(t), t) for name, ts in license_scan.TEMPLATES.items() for t in ts if len(t) < 130]
    for _ in range(40):
        words = prose(rng.randrange(999), 8).split() + rng.choice(pool)[2].split() + prose(rng.randrange(999), 8).split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = rng.choice(["x", "the", "license"])
        w = license_scan.WORD.findall(" ".join(words).lower())
        best = max(license_scan.dice(license_scan.Counter(zip(w[i:j], w[i + 1 : j])), grams) for i in range(len(w)) for j in range(i + 2, len(w) + 1) for _, grams, _ in pool if grams.total() / 1.5 <= j - i - 1 <= grams.total() * 1.5) if len(w) > 1 else 0
        found = known.matches(" ".join(words))
        assert bool(found) == (best >= 0.8) and all(m[3] <= best + 1e-12 for m in found)


def plain_pipeline(docs, model_scores):
    """What the first four stages keep, by plain Python: (doc_id, text)."""
    kept = []
    for i, t in docs:
        w, lines = WORD.findall(t or ""), [x for x in (t or "").split("\n") if WORD.search(x)]
        runs = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {k + j for k in range(len(w) - 7) if runs[tuple(w[k : k + 8])] > 1 for j in range(8)}
        symbols, chars = sum(c in "#*$%&|<>" for c in t or ""), sum(map(len, w))
        if len(w) < 20 or 100 * len(covered) > 30 * len(w) or symbols * 10 > len(w) or (len(lines) - len(set(lines))) * 100 > 50 * len(lines) or chars < 2 * len(w) or chars > 16 * len(w):
            continue
        kept.append((i, t))
    kept = [(i, t) for i, t in kept if model_scores[i] < toxicity.PREDICT_AT]
    groups = brute_components([t for _, t in kept], [i for i, _ in kept])
    kept = [(i, t) for k, (i, t) in enumerate(kept) if groups[k][1] == i]
    seen, out = set(), {}
    for i, t in sorted(kept):
        b = t.encode()
        own = [b[k : k + 50] for k in range(len(b) - 49)]
        gone = {k + j for k, x in enumerate(own) if x in seen for j in range(50)}
        seen.update(own)
        out[i] = bytes(x for k, x in enumerate(b) if k not in gone).decode(errors="replace")
    return out


def test_every_piece_of_a_word_is_found_and_no_other():
    import public_tokenizers

    from quillmere.llm import sentencepieces

    lattices, rng = sentencepieces.lattices_of(public_tokenizers.path("piece_bpe_32k.model")), random.Random(4)
    known = list(lattices.pieces)
    words = list({"".join(rng.choices(known, k=2)) for _ in range(300)} | {"".join(chr(rng.randrange(33, 0x3000)) for _ in range(6)) for _ in range(100)})
    built = sentencepieces.build_words(words, lattices)
    for w in words:
        for a in range(len(w)):
            for n in range(1, lattices.longest + 1):
                want = lattices.pieces.get(w[a : a + n], (-1, 0))[0] if a + n <= len(w) else -1
                assert built.ids[n - 1, built.begin[w] + a] == want, (w, a, n)


def test_pipeline_sends_whole_texts_in_bounded_batches(spark):
    import corpus_pipeline
    import pyarrow as pa

    from quillmere.llm.common import BATCH_BYTES, BATCH_CONF, SPARK_BYTES

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    before = spark.conf.get(BATCH_CONF)
    try:
        for name in ("near_duplicates", "passages", "packing"):
            spark.conf.set(BATCH_CONF, SPARK_BYTES)
            dict(corpus_pipeline.STAGES)[name](spark, docs_of(spark, [(1, "ab cd")]), "")
            wide = spark.range(0, 1500, 1, 1).selectExpr("id AS doc_id", "repeat('x', 10000) AS text")
            assert max(r.n for r in wide.mapInArrow(sizes, "n long").collect()) <= BATCH_BYTES + 20_000, name
        spark.conf.set(BATCH_CONF, "1000000")
        corpus_pipeline.packing(spark, docs_of(spark, [(1, "ab cd")]), "")
        assert spark.conf.get(BATCH_CONF) == "1000000"
    finally:
        spark.conf.set(BATCH_CONF, before)


@data
def test_pipeline_stages(spark):
    """Every stage of the pipeline against plain Python over the same rows; scores come from the fitted model."""
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    first = stages["quality"](spark, docs, SF)
    assert first.columns == docs.columns
    model = toxicity.fit(first, spark.read.parquet(f"{SF}/labels.parquet"), toxicity.is_held_out)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    want = plain_pipeline([(r.doc_id, r.text) for r in docs.collect()], scores)
    held = first
    for name in ("toxicity", "near_duplicates", "passages"):
        held = stages[name](spark, held, SF)
        assert held.columns == docs.columns, name
        held = spark.createDataFrame(held.collect(), docs.schema)
    assert {r.doc_id: r.text for r in held.collect()} == want
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed = collections.defaultdict(list)
    for r in stages["packing"](spark, held, SF).collect():
        packed[r.doc_id].append(r)
    for i, t in want.items():
        ids = np.array([*lib.encode(t, add_special_tokens=False).ids, 2], "<u4")
        own = sorted(packed.pop(i), key=lambda r: r.start)
        assert [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own] == [r.ids_crc32 for r in own]
        assert sum(r.length for r in own) == len(ids)
    assert not packed


def piece_texts(lattices, rng, count, words):
    """Texts of words that are made of pieces."""
    parts = [p.strip(sentencepieces.MARK) for p in list(lattices.pieces)[:3000]]
    return [" ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(words)) for _ in range(count)]


def test_sampling_two_segmentations_costs_a_few_times_an_encoding():
    import time

    import public_tokenizers

    lattices = sentencepieces.lattices_of(public_tokenizers.path("piece_bpe_32k.model"))
    texts = piece_texts(lattices, random.Random(5), 40, 500)
    seeds = [i.to_bytes(8, "little") for i in range(len(texts))]

    def cpu(run):
        times = []
        for _ in range(5):
            begun = time.process_time()
            run()
            times.append(time.process_time() - begun)
        return min(times)

    once = cpu(lambda: [lattices.sp.encode(t) for t in texts])
    sampled = cpu(lambda: sentencepieces.sample_batch([sentencepieces.words_of(t, lattices.sp) for t in texts], lattices, 2, seeds))
    assert sampled < 3 * once  # 1.8 times; 4.9 times when lattices were dense and every place was looked at


def test_lattices_take_memory_for_edges_alone():
    import tracemalloc

    import public_tokenizers

    lattices = sentencepieces.lattices_of(public_tokenizers.path("piece_bpe_32k.model"))
    words = list({w for t in piece_texts(lattices, random.Random(6), 20, 500) for w in sentencepieces.words_of(t, lattices.sp)})
    tracemalloc.start()
    try:
        sentencepieces.build_words(words, lattices)
        assert tracemalloc.get_traced_memory()[1] < 350 * sum(map(len, words))
    finally:
        tracemalloc.stop()


def test_shares_of_edges_equal_plain_sums_in_long_words_and_rare_characters():
    import public_tokenizers

    lattices = sentencepieces.lattices_of(public_tokenizers.path("piece_bpe_32k.model"))
    # the fourth and the last would leave the range of a double
    words = ["a", "then", "x漢\U0001f600then", "\U0001f9ff" * 40, "the" * 16, "the" * 16 + "n", "therandother" * 60, "\U0001f9ff漢a" * 100]
    built = sentencepieces.build_words(words, lattices)
    for w, rank in zip(words, built.rank.tolist()):
        sums = [0.0]
        for z in range(1, len(w) + 1):
            parts = {}
            for n in range(1, min(z, lattices.longest) + 1):
                if w[z - n : z] in lattices.pieces:
                    parts[n] = sums[z - n] + lattices.pieces[w[z - n : z]][1]
                elif n == 1:
                    parts[n] = sums[z - 1] + len(w[z - 1].encode()) * lattices.byte_weight
            sums.append(float(np.logaddexp.reduce(list(parts.values()))))
            got = built.shares(int(built.place[z - 1]) + rank)
            assert len(got) == len(parts)
            assert np.allclose(got, [np.exp(p - sums[-1]) for _, p in sorted(parts.items())], rtol=1e-9, atol=1e-300), (w, z)


def test_samples_do_not_depend_on_the_other_rows():
    import public_tokenizers

    lattices, rng = sentencepieces.lattices_of(public_tokenizers.path("piece_bpe_32k.model")), random.Random(7)
    texts = [*piece_texts(lattices, rng, 6, 300), "", "a", "\U0001f9ff" * 300, "therandother" * 60, *piece_texts(lattices, rng, 2, 3)]
    words, seeds = [sentencepieces.words_of(t, lattices.sp) for t in texts], [i.to_bytes(8, "little") for i in range(len(texts))]
    together = sentencepieces.sample_batch(words, lattices, 3, seeds)
    for w, seed, found in zip(words, seeds, together):
        ((alone),) = sentencepieces.sample_batch([w], lattices, 3, [seed])
        assert [(i.tolist(), p, x) for i, p, x in alone] == [(i.tolist(), p, x) for i, p, x in found]
    assert sentencepieces.sample_batch([], lattices, 2, []) == []


def test_decoding_equals_the_library():
    import public_tokenizers

    lattices, rng = sentencepieces.lattices_of(public_tokenizers.path("piece_bpe_32k.model")), random.Random(8)
    mark, byte = lattices.pieces[sentencepieces.MARK][0], list(lattices.bytes.values())
    size = lattices.sp.get_piece_size()
    lists = [[], [mark], [mark, mark], [mark, 500], [lattices.bytes[0x20], 500], [500, mark], [0], [1, mark, 500], [mark, 0, 500]]
    lists += [[lattices.bytes[b] for b in "漢a\U0001f600".encode()], [lattices.bytes[0xE6], 500], [byte[200], byte[100], 700]]
    lists += [rng.choices(range(size), k=rng.randrange(40)) for _ in range(300)] + [rng.choices(byte, k=5) for _ in range(50)]
    lists += [lattices.sp.encode(t) for t in (" then  again", "\U0001f9ff x", prose(9, 50))] + [[]]
    begin = np.cumsum([0, *map(len, lists)])
    got = sentencepieces.decode_ids(np.array([i for ids in lists for i in ids], np.int32), begin, lattices)
    assert got == [lattices.sp.decode(ids) for ids in lists]


def test_decode_takes_null_and_empty_lists(spark):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    lattices = sentencepieces.lattices_of(path)
    lists = [None, [], lattices.sp.encode("then again"), None, lattices.sp.encode("a漢\U0001f9ff"), []]
    df = spark.createDataFrame(list(enumerate(lists)), "k long, ids array<int>").coalesce(1)
    got = {r.k: r.decoded for r in sentencepieces.decode(df, path).collect()}
    assert got == {k: None if ids is None else lattices.sp.decode(ids) for k, ids in enumerate(lists)}
