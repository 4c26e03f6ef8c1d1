"""Training-data operators against brute force, on small fixtures with edge cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from frameloom.llm import bpe, components, eliasfano, fmindex, licenses, lines, lm, minhash, packing, quality, substrings, topk, urls

P = pytest.importorskip("public_tokenizers")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "Ünder", "x", "word", "größe", "and", "it's", "42", "…", "naïve", "a"] + [f"w{i}" for i in range(300)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    out = []
    for i in range(n):
        text = "\n".join(" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 8)))
        if i % 5 == 1 and out:
            text = rng.choice(out)[1]
        if i % 7 == 2:
            text = text + "\n" + passage
        if i % 9 == 3 and out:
            w = (rng.choice(out)[1] or "").split(" ")
            w[len(w) // 2] = "edited"
            text = " ".join(w)
        out.append((i, text))
    out += [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "one"), (n + 4, "one two"), (n + 5, "lone " * 400), (n + 6, "é" * 3000 + " end"), (None, "null id " * 20), (3, out[3][1])]
    return out


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id bigint, text string, row string, key bigint").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, row string, key bigint")


def words(t):
    return WORD.findall((t or "").encode())


ODD = ["", "'s it's  foo''re I'LL don't\n\n x  \t y 's\n's 'rest ''s .'s 12'3 ²Ⅷ x² ٣٤", "  ", "\n", " 's", "a" * 3000, "é" * 900 + "xyz " * 3, "　  日本語 🙂🙂'll", "\x85\xa0 a b\x1c\x1fz", "'", "'t", "x 'tis"]


def test_bpe_equals_the_library(rows):
    import base64

    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [t or "" for _, t in rows] + ODD
    flat, count = bpe.encoder(path).encode([t.encode() for t in texts])
    got = np.split(flat, np.cumsum(count)[:-1])
    assert [g.tolist() for g in got] == [enc.encode_ordinary(t) for t in texts]
    assert bpe.decode(bpe.encoder(path).v, flat, count) == [t.encode() for t in texts]


def test_bpe_rows(spark, docs, rows, empty):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    got = bpe.token_digests(docs, path).collect()
    assert len(got) == len(rows)
    assert {r.decoded_sha256 for r in got} == {hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows}
    assert bpe.token_digests(empty, path).count() == 0
    back = bpe.decode_documents(bpe.encode_documents(docs, path), path)
    assert all((r.text or "").encode() == bytes(r.decoded) for r in back.collect())


def test_packing(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    special = spark.createDataFrame([(900, "a<|endoftext|> b<|endoftext|>", "x", 1)], docs.schema)
    got = packing.pack(docs.unionByName(special), path, 64, keep_ids=True)
    k = Tokenizer.from_file(path)
    seqs, by_doc = collections.defaultdict(list), collections.defaultdict(list)
    for r in got.collect():
        seqs[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(np.array(r.token_ids, "<u4").tobytes()) == r.ids_crc32
        by_doc[r.doc_id].append((r.piece, r.start, list(r.token_ids)))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 64
    for i, t in [*rows, (900, "a<|endoftext|> b<|endoftext|>")]:
        if i not in (3, None):
            ids = k.encode(t or "", add_special_tokens=False).ids + [2]
            own = sorted(by_doc[i])
            assert [x for p in own for x in p[2]] == ids
            assert all(len(p[2]) == 64 for p in own[1:]) and [p[0] for p in own] == list(range(len(own)))
    total = sum(n for s in seqs.values() for _, n in s)
    bins = []  # best-fit decreasing, one by one
    for n in sorted((n for s in seqs.values() for _, n in s), reverse=True):
        if fit := [b for b in bins if b[0] >= n]:
            min(fit, key=lambda b: b[0])[0] -= n
        else:
            bins.append([64 - n])
    assert len(seqs) == len(bins)
    assert packing.pack(empty, path).count() == 0
    whole = packing.sequences(got).collect()
    assert sum(len(r.token_ids) for r in whole) == total


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_is_the_one_by_one_rule(seed):
    rng = random.Random(seed)
    sizes = sorted((rng.randrange(1, 33) for _ in range(200)), reverse=True)
    bins = []
    for s in sizes:
        fit = [b for b in bins if b[0] >= s]
        if fit:
            min(fit, key=lambda b: b[0])[0] -= s
        else:
            bins.append([32 - s])
    placed = packing.best_fit_decreasing(collections.Counter(sizes), 32)
    used = collections.Counter()
    for length, lo, hi, first, each, _ in placed:
        for r in range(hi - lo):
            used[first + r // each] += length
    assert sorted(used.values()) == sorted(32 - b[0] for b in bins)


def test_quality(spark, docs, rows, empty):
    got = quality.quality_rules(docs.drop("row")).collect()
    assert len(got) == len(rows)
    for r in got:
        w = words(r.text)
        g = collections.Counter(zip(w, w[1:], w[2:]))
        hit = {j for i in range(len(w) - 2) if g[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        ls = [x for x in (r.text or "").split("\n") if words(x)]
        s = r.stats
        assert (s.n_words, s.n_repeat_words, s.n_dup_lines) == (len(w), len(hit), len(ls) - len(set(ls)))
        assert s.word_chars == sum(len(x.decode()) for x in w)
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert quality.quality_rules(empty).count() == 0


def test_quality_slow_path_agrees(spark):
    """Windows whose packed bits clash are compared as word sequences."""
    old, quality.PLACE_BITS = quality.PLACE_BITS, 58
    try:
        d = spark.createDataFrame([(1, "a b c d a b c x y z " * 3), (2, "p q r s t u")], "doc_id int, text string")
        got = {r.doc_id: r.stats.n_repeat_words for r in quality.text_statistics(d).collect()}
    finally:
        quality.PLACE_BITS = old
    assert got == {1: 30, 2: 0}


def brute_components(rows, n, share):
    sets = []
    for _, t in rows:
        w = [x.lower() for x in words(t)]
        sets.append(set(zip(*(w[k:] for k in range(n)), strict=False)) if len(w) >= n else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= share * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((str(rows[i][0]), len(sets[i]), str(least.get(find(i)) if sets[i] else rows[i][0])) for i in range(len(rows)))


def test_near_duplicates(spark, docs, rows, empty):
    near = minhash.near_duplicates(docs, minhash.CONTRACT).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in near) == brute_components(rows, 3, 85)
    default = minhash.near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in default) == brute_components(rows, 5, 80)
    assert minhash.near_duplicates(empty).count() == 0


def test_large_bucket_in_blocks(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randrange(0, 14)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(minhash, "BLOCK", 16)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), minhash.CONTRACT).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_components(rows, 3, 85)


@pytest.mark.parametrize("bridge", [(3,), (None,), (None, None)])
def test_bridge_without_an_id_links(spark, bridge):
    base = [f"b{i}" for i in range(200)]
    text = lambda k: " ".join(["x"] * 0 + base[k:] + [f"new{i}" for i in range(k)])
    rows = [(1, text(0)), (2, text(24)), *[(b, text(12)) for b in bridge], (None, "of no one " + text(150)[:300])]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), minhash.CONTRACT).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_components(rows, 3, 85)
    assert {r.doc_id: r.component_id for r in got}[2] == 1


def test_hot_group_under_the_threshold(spark, monkeypatch):
    """A component ends where similarity ends, and links number fewer than documents."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.choice([3, 5, 6, 7])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    made = []
    keep = minhash.materialize
    monkeypatch.setattr(minhash, "materialize", lambda d, label: made.append((label, keep(d, label))) or made[-1][1])
    monkeypatch.setattr(minhash, "discard", lambda *t: None)
    monkeypatch.setattr(minhash, "BLOCK", 64)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), minhash.CONTRACT).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_components(rows, 3, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    blocks = next(t for n, t in made if n == "minhash-contacts").select("key", "block").distinct().count()
    assert [t for n, t in made if n == "minhash-links"][1].count() <= 300 * max(blocks, 1)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(5, 5)]
    import itertools

    parent = {x: x for e in edges for x in e}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert {(r.node, r.component) for r in got.collect()} == {(x, find(x)) for x in set(itertools.chain(*edges))}


def brute_substrings(rows, n):
    first = {}
    for d, t in rows:
        w = words(t)
        if d is not None:
            for i in range(len(w) - n + 1):
                k = tuple(w[i : i + n])
                first[k] = min(d, first.get(k, d))
    out = []
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if d is not None and first[tuple(w[i : i + n])] < d:
                gone[i : i + n] = [True] * n
        out.append((str(d), len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out)


def test_substrings(spark, docs, rows, empty):
    got = substrings.remove_repeats(docs, 13).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, bytes(r.kept_words)) for r in got) == brute_substrings(rows, 13)
    assert all(words(r.kept_text) == words(r.kept_words.decode()) for r in got)
    assert {r.row for r in got} == {"x"} and all(r.kept_text == r.text for r in got if not r.n_removed)
    assert substrings.remove_repeats(empty).count() == 0


def test_fm_index():
    rng = np.random.default_rng(3)
    text = np.append(rng.integers(1, 5, 500), 0)  # a 0 ends the text
    document = np.arange(501) // 50
    index = fmindex.FMIndex(text, 6, document)
    pattern = np.append(rng.integers(0, 7, 300), text[40:90])
    length, least = index.matching_statistics(pattern, np.arange(len(pattern)), 6)
    places = collections.defaultdict(list)
    for n in range(1, 7):
        for i in range(500 - n + 1):
            places[tuple(text[i : i + n])].append(int(document[i]))
    for e in range(len(pattern)):
        found = [n for n in range(1, min(6, e + 1) + 1) if tuple(pattern[e - n + 1 : e + 1]) in places]
        assert length[e] == max(found, default=0)
        if found:
            assert least[e] == min(places[tuple(pattern[e - max(found) + 1 : e + 1])])


@pytest.mark.parametrize("window", [2, 5, 40])
def test_substrings_of_other_windows(spark, docs, rows, window):
    got = substrings.remove_repeats(docs, window).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, bytes(r.kept_words)) for r in got) == brute_substrings(rows, window)


def brute_lines(rows, run):
    seqs = [[x for x in (t or "").split("\n") if words(x)] for _, t in rows]
    first = {}
    for (d, _), s in zip(rows, seqs, strict=True):
        if d is not None:
            for i in range(len(s) - run + 1):
                k = tuple(s[i : i + run])
                first[k] = min((d, i), first.get(k, (d, i)))
    out = []
    for (d, t), s in zip(rows, seqs, strict=True):
        gone = set()
        for i in range(len(s) - run + 1):
            if d is not None and first[tuple(s[i : i + run])] < (d, i):
                gone |= set(range(i, i + run))
        out.append((str(d), len(s), len(gone)))
    return sorted(out)


def test_lines(spark, docs, rows, empty):
    got = lines.dedup_lines(docs).collect()
    assert sorted((str(r.doc_id), r.n_lines, r.n_removed) for r in got) == brute_lines(rows, 3)
    assert all(r.kept_text == r.text for r in got if not r.n_removed)
    assert lines.dedup_lines(empty).count() == 0


def test_columns_of_added_names_give_way(spark):
    """Names of added columns, of inner ones, and ones that need quoting."""
    names = ["stats", "kept", "base_failed", "n_lines", "n_words", "kept_text", "host", "token_ids", "text2", "row", "key", "a.b", "words", "lines", "gone", "node", "Out"]
    d = spark.createDataFrame([(i, t, "http://a.org/x", *["own"] * len(names)) for i, t in [(1, "a b\nc d"), (2, "a b\nc d"), (None, None)]], ["doc_id", "text", "url", *names])
    e = spark.createDataFrame([("a.org", "block", "x", "2024-01-01")], "key string, action string, category string, day string")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    outs = [quality.quality_rules(d), lines.dedup_lines(d, 1, 1), substrings.remove_repeats(d, 2), urls.url_filter(d.withColumn("fetched", d.row), e), bpe.encode_documents(d, path), bpe.decode_documents(bpe.encode_documents(d, path), path, out="kept")]
    added = [{"stats", "kept", "base_failed"}, {"n_lines", "kept_text"}, {"n_words", "kept_text"}, {"host"}, {"token_ids"}, {"token_ids", "kept"}]
    for out, new in zip(outs[:3] + outs[4:], added[:3] + added[4:], strict=True):
        assert len(set(out.columns)) == len(out.columns)
        got = out.collect()
        assert len(got) == 3
        assert all(r[n] == "own" for r in got for n in names if n not in new)
    for stage in (quality.stage_quality, lines.stage_lines, substrings.stage_substrings, minhash.stage_near_duplicates):
        out = stage(spark, d, "")
        assert out.columns == d.columns
        assert all(r["a.b"] == "own" and r["kept"] == "own" for r in out.collect())
    assert packing.pack(d, P.path("byte_bpe_50k.json")).count() == 3


def test_stage_and_operator_judge_alike(spark, docs):
    kept = quality.quality_rules(docs.drop("row")).filter("kept")
    again = quality.stage_quality(spark, docs, "")
    assert sorted(str(r.key) for r in again.collect()) == sorted(str(r.key) for r in kept.collect())


def test_lines_that_share_only_a_fingerprint(spark):
    rows = [(1, "x\na\nb\ny"), (2, "z\na\nb\nc"), (3, "z\na\nb\nc"), (4, "q\nq\nq\nq\nq")]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((str(r.doc_id), r.n_lines, r.n_removed) for r in got) == brute_lines(rows, 3)
    assert {r.doc_id: r.kept_text for r in got}[3] == ""


def test_stage_removes_single_lines_and_pairs(spark, docs, rows):
    few = [(1, "x\na b\nc\n\ny"), (2, "z\na b\nc\nw"), (3, "only"), (4, "c\n\nown"), (5, "only"), (6, "q\nq")]
    out = lines.stage_lines(spark, spark.createDataFrame(few, "doc_id bigint, text string"), "")
    assert {r.doc_id: r.text for r in out.collect()} == {1: few[0][1], 2: "z\nw", 3: "only", 4: "\nown", 5: "", 6: "q"}
    got = lines.dedup_lines(docs, run=1, gram=1).collect()
    assert sorted((str(r.doc_id), r.n_lines, r.n_removed) for r in got) == brute_lines(rows, 1)


def test_topk(spark):
    rng = random.Random(4)
    vecs = [(i, [rng.gauss(0, 0.3) for _ in range(8)]) for i in range(250)]
    vecs[30] = (30, vecs[0][1])
    vecs += [(300, None), (301, [None] * 8), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (None, [1.0] * 8), (200, [0.5] * 8), (304, [2.0] * 3), (305, [])]
    d = spark.createDataFrame(vecs, "vec_id bigint, embedding array<double>").repartition(3)
    got = topk.search(d, d.filter("vec_id % 100 = 0"), 10).collect()
    ok = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in vecs if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v)]
    expect = []
    for i, q in ok:
        if i % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in ok if j != i)[:10]
            expect += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert sorted(tuple(r) for r in got) == sorted(expect)
    assert topk.search(d.filter("vec_id < 0"), d.filter("vec_id < 0")).count() == 0


def test_topk_of_huge_components_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 2)
    monkeypatch.setattr(topk, "RANGE", 16)
    rng = random.Random(6)
    vecs = [(i, [rng.gauss(0, 1) * 10.0 ** rng.choice([0, 0, 3]) for _ in range(4)]) for i in range(0, 600, 5)]
    vecs += [(1, [1e13, 0.0, -1e13, 1e-3]), (2, [1e4, 3.0, 1e13, 0.0]), (3, [1e306, 0.0, 0.0, 0.0]), (3, [0.5, 0.5, 0.5, 0.5])]
    d = spark.createDataFrame(vecs, "vec_id bigint, embedding array<double>").repartition(5)
    got = topk.search(d, d.filter("vec_id % 100 = 0 OR vec_id = 1"), 4).collect()
    ok = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in vecs if all(np.isfinite(1024 * x) for x in v)]
    expect = []
    for i, q in ok:
        if i % 100 == 0 or i == 1:
            best = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, v, strict=True)))), j) for j, v in ok if j != i)[:4]
            expect += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert sorted(tuple(r) for r in got) == sorted(expect)
    assert any(r.vec_id == 1 for r in got)


def test_select_in_words():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 2**64, 300, dtype=np.uint64) & rng.integers(0, 2**64, 300, dtype=np.uint64)
    for x in [*words.tolist(), 2**64 - 1, 1, 1 << 63]:
        places = [p for p in range(64) if x >> p & 1]
        assert eliasfano.select(np.full(len(places), x, np.uint64), np.arange(len(places), dtype=np.uint64)).tolist() == places


def test_order_by_several_keys():
    rng = np.random.default_rng(2)
    for top in (5, 1 << 20, 1 << 40, 1 << 62):
        keys = [rng.integers(0, top, 200) for _ in range(3)]
        got = lm._order(*keys)
        assert sorted(got.tolist()) == list(range(200))
        rows = list(zip(*(k[got].tolist() for k in keys)))
        assert rows == sorted(rows)
    assert not len(lm._order(*[np.zeros(0, np.int64)] * 3))


def test_elias_fano():
    rng = np.random.default_rng(1)
    for top, n in ((10, 50), (10**12, 1000), (5, 1)):
        v = np.sort(rng.integers(0, top, n)).astype(np.uint64)
        e = eliasfano.EliasFano(v)
        assert (e[np.arange(n)] == v).all()
        x = rng.integers(0, top, 100).astype(np.uint64)
        assert (e.successor(x, np.zeros(100), np.full(100, n)) == np.searchsorted(v, x)).all()
    pairs = np.unique(rng.integers(0, 40, (300, 2)), axis=0)
    t = eliasfano.TrieLevel(pairs[:, 0], pairs[:, 1], np.arange(len(pairs))).memory_mapped()
    a, b = (m.ravel() for m in np.mgrid[0:42, 0:42])
    want = {tuple(p): i for i, p in enumerate(pairs.tolist())}
    assert t.find(a, b).tolist() == [want.get(p, -1) for p in zip(a.tolist(), b.tolist(), strict=True)]


def brute_scores(rows, order):
    """Rows as score_documents gives them, with counts of whole word sequences."""
    import math

    texts = [(d, [0, *(x.lower() for x in words(t)), None]) for d, t in rows]  # 0 stands before a text
    c = collections.Counter()
    for d, t in texts:
        if not lm.held_out(d):
            for k in range(1, order + 1):
                c.update(tuple(t[i - k + 1 : i + 1]) for i in range(1, len(t)) if i - k + 1 >= 0)
    c[(0,)] = c[(None,)]
    n, v = sum(x for g, x in c.items() if len(g) == 1 and g != (0,)), sum(len(g) == 1 and g != (0,) and x > 0 for g, x in c.items())
    out = []
    for d, t in texts:
        base = score = 0.0
        for i in range(1, len(t)):
            p = (c[(t[i],)] + 1) / (n + v + 1)
            base += math.log10(p)
            for k in range(2, order + 1):
                if i - k + 1 >= 0:
                    w = lm.WEIGHTS.get(k, lm.WEIGHT)
                    p = (c[tuple(t[i - k + 1 : i + 1])] + w * p) / (c[tuple(t[i - k + 1 : i])] + w)
            score += math.log10(p)
        out.append((str(d), lm.held_out(d), len(t) - 1, sum(c[(x,)] > 0 for x in t[1:]), n, base, score))
    return out


@pytest.mark.parametrize("order", [2, 3, 4])
def test_lm(spark, docs, rows, empty, order, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", 20_000 if order == 3 else 3_000)  # several chunks share contexts
    got = lm.score_documents(docs, order=order).collect()
    by = lambda r: (r[0], r[2], r[3], round(r[5], 6))
    for a, b in zip(sorted(((str(r[0]), *r[1:]) for r in got), key=by), sorted(brute_scores(rows, order), key=by), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-6)
        assert abs(a[6] - b[6]) <= a[2] * order * 0.5 / lm.STEPS + 1e-6
    if order == 3:
        assert lm.score_documents(empty).count() == 0
        only = spark.createDataFrame([(next(i for i in range(100) if lm.held_out(i)), "a b a")], "doc_id bigint, text string").selectExpr("cast(doc_id as decimal(20,0)) doc_id", "text")
        assert [(r.n_known, r.train_tokens, r.score) for r in lm.score_documents(only).collect()] == [(0, 0, 0.0)]


def test_lm_sums_beyond_32_bits(spark):
    import math

    held = next(i for i in range(100) if lm.held_out(i))
    rest = [i for i in range(100) if not lm.held_out(i)][:40]
    many = 400_000
    rows = [(held, "new " * many)] + [(i, " ".join(f"w{i}x{k}" for k in range(3000))) for i in rest]
    got = {r.doc_id: r for r in lm.score_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}[held]
    v, n = 40 * 3000 + 1, 40 * 3001
    once = math.log10(1 / (n + v + 1))  # a pair of unknown words gives no more
    assert got.train_tokens == n and -many * once * lm.STEPS > 2**32
    assert got.score == pytest.approx(many * once, rel=1e-3)


def test_urls(spark):
    e = spark.createDataFrame([("bad.org", "block", "spam", "2024-01-10"), ("bad.org", "remove", None, "2024-02-01"), ("ok.bad.org", "allow", "x", "2024-01-01"), ("site.com/a/b", "block", "y", "2024-01-01"), (None, "block", "z", "2024-01-01")], "key string, action string, category string, day string")
    rows = [("http://bad.org/", "2024-01-09"), ("http://www.BAD.org:80/x", "2024-01-10"), ("http://bad.org", "2024-02-01"), ("https://ok.bad.org/q", "2024-01-15"), ("http://site.com/a/b/c?x", "2024-01-15"), ("http://site.com/a/bc", "2024-01-15"), ("http://notbad.org", "2024-01-15"), (None, "2024-01-15"), ("nonsense", None), ("http://u:p@bad.org/", "2024-01-15")]
    d = spark.createDataFrame(rows, "url string, fetched string")
    got = {(r.url, r.fetched): r.blocked for r in urls.url_filter(d, e).collect()}
    assert [got[r] for r in rows] == [False, True, False, False, True, False, False, False, False, True]
    assert urls.url_filter(d.limit(0), e).count() == 0 and urls.url_filter(d, e.limit(0)).filter("blocked").count() == 0


def test_licenses(spark, docs, empty):
    k = licenses.known_notices(spark)
    d = spark.createDataFrame([(1, "Copyright (c) 2020 A. Author\nreleased under THE MIT Licence!"), (2, "prose\nLicensed under CC BY-NC 4.0.\nmore"), (3, "MIT"), (4, None), (5, "")], "doc_id bigint, text string")
    got = {(r.doc_id, r.unit, r.line_no, r.license_id) for r in licenses.license_scan(d, k).collect()}
    assert got == {(1, "text", 0, "MIT"), (1, "line", 2, "MIT"), (2, "line", 2, "CC-BY-NC-4.0")}
    assert licenses.license_scan(empty, k).count() == 0


def test_licenses_of_repeated_rows_and_null_ids(spark):
    rows = [(None, "Licensed under CC BY 4.0."), ("a", "Licensed under CC BY 4.0."), ("a", "Licensed under CC BY 4.0."), ("b", "word " * 300_000 + "\n  LICENSED under cc-by 4.0"), ("c", "\n\n"), ("d", "© 2020 x\r\nLicensed under CC BY 4.0.\r")]
    d = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id string, text string, digest string, unit int")
    got = sorted((str(r.doc_id), r.unit, r.line_no) for r in licenses.license_scan(d, licenses.known_notices(spark)).collect())
    assert got == sorted([("None", "text", 0), ("None", "line", 1), ("a", "text", 0), ("a", "line", 1), ("a", "text", 0), ("a", "line", 1), ("b", "line", 2), ("d", "text", 0), ("d", "line", 2)])


def test_complete_licenses_and_wrapped_notices(spark, tmp_path):
    import pathlib

    texts = pathlib.Path(licenses.__file__).with_name("license_texts")
    rows = [(n, ("Copyright (c) 2021 B. Author\n\n" + (texts / f"{n}.txt").read_text()).upper()) for n in licenses.COMPLETE]
    rows += [("titled", "MIT License\n\nCopyright (c) 2021 B. Author\n\n" + (texts / "MIT.txt").read_text())]
    rows += [("wrapped", "prose\nmore\n \t\nThis work is licensed\nunder the MIT License.\n\nend"), ("one", "prose\n\nLicensed under CC BY 4.0.\n\nend"), ("part", "This work is licensed\nunder the MIT License.\nmore\n\nend")]
    spark.createDataFrame(rows, "doc_id string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id, r.unit, r.line_no, r.license_id) for r in licenses.op3_license_scans(spark, str(tmp_path)).collect())
    expect = [(n, "text", 0, n) for n in licenses.COMPLETE] + [("titled", "text", 0, "MIT"), ("wrapped", "block", 4, "MIT"), ("one", "line", 3, "CC-BY-4.0")]
    assert got == sorted(expect)


def test_pipeline_stages(spark, docs, rows):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    d = docs.select("doc_id", "text")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, d, "")
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == d.columns
        assert out.count() > 0, name
    assert corpus_pipeline.ORACLE_SQL is None


def plain_pipeline(rows):
    """{(doc_id, piece, start, length, ids_crc32)} of the five stages, one text at a time."""
    from tokenizers import Tokenizer

    def bad(t):
        w, ls = words(t), [x for x in t.split("\n") if words(x)]
        g = collections.Counter(zip(w, w[1:], w[2:]))
        hit = {j for i in range(len(w) - 2) if g[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        count = lambda s: len(re.findall(f"[{s}]", t))
        long_ = sum(len(x.decode()) for x in w)
        return (len(w) < 50 or 100 * len(hit) > 50 * len(w) or 100 * count("#*$%&|<>") > 10 * len(w) or 100 * (len(ls) - len(set(ls))) > 50 * len(ls)
                or not 2 * len(w) <= long_ <= 15 * len(w) or 100 * count("!") > 30 * len(w) or 100 * count("A-Z") > 50 * count("A-Za-z"))

    now, seen = [], set()
    for d, t in sorted((d, t) for d, t in rows if t is not None and not bad(t)):
        out = []
        for x in t.split("\n"):
            if not words(x) or x not in seen:
                out.append(x)
                if words(x):
                    seen.add(x)
        now.append((d, "\n".join(out)))
    stays = {i for i, _, c in brute_components(now, 5, 80) if i == c}
    now = [(d, t) for d, t in now if str(d) in stays]
    first = {}
    for d, t in now:
        w = words(t)
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), d)
    out, k = set(), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for d, t in now:
        w = words(t)
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < d for j in range(i, i + 13)}
        parts = re.findall(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", t.encode())
        rest = t.encode()[sum(map(len, parts)) :]
        ids = k.encode((b"".join(x for i, x in enumerate(parts) if i not in gone) + rest).decode(), add_special_tokens=False).ids + [2]
        edges = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        out |= {(d, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for p, (a, b) in enumerate(zip(edges, edges[1:]))}  # noqa: B905
    return out


def test_pipeline_against_plain_python(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(d, t) for d, t in corpus(seed=11, n=70)[:74] if d is not None] + [(900, "w " * 40), (901, "# | " * 60), (902, " ".join(f"LOUD{i}X" for i in range(80)))]
    long_ = " ".join(f"v{i * 7919 % 5003}" for i in range(1500))
    rows += [(903, long_), (904, long_[:4000] + " tail of another"), (905, "\n".join(f"line {i} of a text with its own words {i * i}" for i in range(30)))]
    rows = list({d: (d, t) for d, t in rows}.values())
    spark.createDataFrame([(d, t, "en", "x", len(t or "")) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    expect = plain_pipeline(rows)
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == expect and len(got) == len(expect)
    filled = collections.Counter()
    for r in got:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 1024 and {903, 904} <= {r.doc_id for r in got} and not {900, 901, 902} & {r.doc_id for r in got}
