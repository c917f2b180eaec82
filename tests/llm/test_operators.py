"""Operators against brute force on small tables, with nulls, ties, repeats and empty tables."""

from __future__ import annotations

import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}x" for i in range(400)]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", len(t) if t is not None else None) for k, t in rows], DOC)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    rows = [(k, prose(rng, rng.randint(60, 160))) for k in range(60)]
    base = prose(rng, 120).split()
    rows.append((100, " ".join(base)))
    for k in range(101, 141):  # near copies, more than one group's bound
        w = list(base)
        w[rng.randrange(120)] = f"edit{k}"
        rows.append((k, " ".join(w)))
    rows += [(150, rows[3][1]), (151, rows[3][1].upper()), (152, None), (153, ""), (154, "  \n"), (155, "one two"), (156, "One TWO"), (157, "ünï ☃ text"), (158, prose(rng, 9000))]
    passage = prose(rng, 70)
    for k in range(200, 206):
        rows.append((k, f"{prose(rng, 80)} {passage} {prose(rng, 80)}"))
    rows.append((100, " ".join(base)))  # a repeated row
    return rows


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components(sets, linked):
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if linked(a, b):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {k: find(k) for k in sets}


def test_jaccard_join_equals_brute_force(spark, corpus):
    from repolens.llm.jaccard_join import jaccard_groups

    sets = {k: shingles(t) for k, t in corpus}
    want = components(sets, lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))
    got = jaccard_groups(documents(spark, corpus)).collect()
    assert len(got) == len(corpus)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles == len(sets[r.doc_id]) for r in got)


def test_jaccard_signatures_meet_for_every_similar_pair():
    """The pigeonhole holds for small sets and at the threshold, whatever the differences."""
    from repolens.llm.jaccard_join import _HEAD, grouped, signatures

    rng = np.random.default_rng(3)
    for _ in range(150):
        size = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        b = a.copy()
        while True:
            c = np.unique(np.r_[b[rng.random(len(b)) > 0.08], rng.integers(0, 1 << 63, int(rng.integers(0, 2 + size // 12)), dtype=np.uint64)])
            both = len(np.intersect1d(a, c))
            if len(c) and 4 * both >= 3 * (len(a) + len(c) - both):
                break
        if np.array_equal(a, c):
            continue
        parts = signatures([a, c], np.array([1, 2], dtype=np.uint64), 1)
        pairs, _ = grouped(np.frombuffer(parts[0][1], dtype=_HEAD), np.frombuffer(parts[0][2], dtype="<u2").reshape(-1, 3))
        assert any((p["a"], p["b"]) == (1, 2) and p["n"] > p["room"] for p in pairs)


def test_jaccard_heads_are_packed():
    from repolens.llm import jaccard_join as j

    rng = np.random.default_rng(12)
    sets = [np.unique(rng.integers(1, 1 << 63, n, dtype=np.uint64)) for n in (1, 2, 5, 40, 300, 300, 1_000, 30_000)]

    def rows(head, low):
        at = np.repeat(np.arange(len(head)), head["n"])
        return sorted(zip(head["fp"][at].tolist(), head["band"][at].tolist(), head["room"][at].tolist(), map(tuple, low.tolist()), strict=True))

    for n in (1, 64):
        before = after = 0
        for _, heads, low in j.signatures(sets, np.arange(7, 7 + len(sets), dtype=np.uint64), n):
            both, moved = j.packed(heads, low)
            usual = np.frombuffer(heads, dtype=j._HEAD)["fp"] < 14  # the last set has several heads of a band in a bucket
            before, after = before + 12 * int(usual.sum()), after + 15 * int((np.frombuffer(both[: len(both) // 15 * 8], dtype="<u8") < 14).sum())
            one, other = ((h, np.frombuffer(x, dtype="<u2").reshape(-1, 3)) for h, x in ((np.frombuffer(heads, dtype=j._HEAD), low), (j.unpacked(both), moved)))
            assert rows(*one) == rows(*other)
        assert n == 1 or after < 0.8 * before


def test_jaccard_empty_table(spark):
    from repolens.llm.jaccard_join import jaccard_groups

    assert jaccard_groups(documents(spark, [])).collect() == []


def test_substring_passages(spark, corpus):
    from repolens.llm.substring_dedup import cut, passages

    docs = documents(spark, corpus + [(None, "a " * 60)])
    rows = passages(docs).collect()
    found = {r.doc_id for r in rows}
    assert set(range(200, 206)) <= found
    clean = {k for k in range(60) if k != 3}
    assert not found & clean
    first = [r for r in rows if r.doc_id == 200]
    assert len(first) == 1 and not first[0].duplicate and abs(first[0].start_word - 80) <= 2 and abs(first[0].n_words - 70) <= 4
    left = {r.doc_id: r for r in cut(docs).collect()}
    assert len(left[200].text.split()) == 230 and 155 <= len(left[203].text.split()) <= 165
    assert left[203].n_chars == len(left[203].text) and left[152].text is None and left[158].text == dict(corpus)[158]
    assert passages(documents(spark, [])).collect() == []


def test_passage_of_frequent_lines(spark):
    from repolens.llm.substring_dedup import passages

    rng = random.Random(21)
    lines = [" ".join(f"w{rng.randrange(5000)}" for _ in range(9)) for _ in range(60)]
    rows = [(k, " ".join(rng.choice(lines) for _ in range(30))) for k in range(600)]
    block = rng.sample(lines, 7)
    for k in (411, 502, 577):
        text = rows[k][1].split()
        rows[k] = k, " ".join(text[:90] + " ".join(block).split() + text[90:])
    got = {r.doc_id: r for r in passages(documents(spark, rows)).collect() if r.n_words >= 60}
    assert {k: (r.source_doc_id, r.duplicate) for k, r in got.items()} == {411: (411, False), 502: (411, True), 577: (411, True)}
    assert all(abs(r.start_word - 90) <= 6 and r.n_words >= 63 for r in got.values())


def test_compact_windows_are_the_cartesian_nodes():
    from repolens.llm import substring_dedup as s

    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    starts = np.array([0, 120, 300])
    for f, (c, l, r, _) in enumerate(s.compact_windows(h, starts, 20)):
        value = h * s._FACTORS[f]
        value ^= value >> np.uint64(32)
        value &= np.uint64((1 << 40) - 1)
        want = {(int(i + np.argmin(value[i : i + 20])), i) for a, z in ((0, 120), (120, 300)) for i in range(a, z - 19)}
        got = {(x, i) for x, a, z in zip(c.tolist(), l.tolist(), r.tolist(), strict=True) for i in range(a, z - 18)}
        assert got == want


def test_token_store_round_trip(spark, corpus):
    from repolens.llm import token_store as t
    from repolens.llm.encoder import encoder, default_path

    docs = documents(spark, corpus)
    blocks = t.write_store(docs, end_id=0)
    got = sorted(t.read_store(blocks).collect(), key=lambda r: (r.start,))
    model = encoder(default_path()).model
    at = 0
    for r, (k, text) in zip(got, sorted(corpus, key=lambda x: x[0]), strict=True):
        ids = np.array(model.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (k, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert t.read_store(t.write_store(documents(spark, []))).collect() == []


def test_elias_fano():
    from repolens.llm.token_store import EliasFano

    rng = np.random.default_rng(2)
    for n, top in ((1, 1), (5, 0), (700, 10), (1000, 1 << 40)):
        v = np.sort(rng.integers(0, top + 1, n)).astype(np.uint64)
        e = EliasFano.from_bytes(EliasFano.of(v).to_bytes())
        assert np.array_equal(e.all(), v)
        assert [e.select(i) for i in range(0, n, 7)] == v[::7].tolist()
    assert len(EliasFano.of(np.array([], dtype=np.uint64)).all()) == 0
    with pytest.raises(IndexError):
        EliasFano.of(v).select(n)


def test_encoder_equals_library():
    from repolens.llm.encoder import Encoder, default_path

    e = Encoder(default_path())
    texts = ["Hello  wörld's\n\n it'll 12 <|endoftext|> \t x", " a b", "日本語 text x", "", None, "\x1c odd", "éé Ünder_score--"] + ["word " * 50]
    want = [np.array(e.model.encode(t or "", add_special_tokens=False).ids, dtype=e.dtype).tobytes() for t in texts]
    assert e.encode(texts) == want and e.encode(texts) == want


def test_packing_covers_every_id(spark, corpus):
    from repolens.llm import packing as p

    rows = p.pack(documents(spark, corpus)).collect()
    by_doc: dict = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    texts = dict(corpus)
    for k, own in by_doc.items():
        if k == 100:
            continue  # the repeated row
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            ids = p.piece_ids(texts[k], r.start, r.length)
            assert r.start == at and len(ids) == r.length and r.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
            at += r.length
        assert at == own[0].doc_tokens
    total = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == total[r.sequence_id]
        total[r.sequence_id] += r.length
    assert max(total.values()) <= 2048 and set(by_doc) == set(texts)


def vectors_table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(16).tolist(), i % 3) for i in range(400)]
    for i in range(400, 460):
        rows.append((i, (np.array(rows[7][1]) + 0.01 * rng.standard_normal(16)).tolist(), 0))
    rows += [(500 + i, rows[9][1], 1) for i in range(20)]
    rows += [(600, None, 0), (620, [0.0] * 16, 0), (640, [float("nan")] * 16, 0), (660, [1.0, None] * 8, 0), (680, [1.0] * 4, 0)]
    return rows


def test_ann_against_brute_force(spark, vectors):
    from repolens.llm.ann import search

    ok = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v, _ in vectors if i < 600]
    ids, x = np.array([i for i, _ in ok]), np.array([v for _, v in ok])
    got: dict = {}
    for r in search(vectors_table(spark, vectors), F.pmod("vec_id", F.lit(20)) == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    hit = 0
    for q, rows in got.items():
        s = x @ x[ids == q][0]
        want = [k for k in np.lexsort((ids, -s)) if ids[k] != q][:20]
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 21)) and q not in {r[1] for r in rows}
        assert all(abs(r[2] - s[ids == r[1]][0]) < 1e-9 for r in rows)
        hit += len({r[1] for r in rows} & set(ids[want].tolist()))
    assert hit >= 0.9 * 20 * len(got)
    assert search(vectors_table(spark, []), F.lit(True)).collect() == []


def test_nn_descent_against_brute_force(spark, vectors):
    from repolens.llm.nn_descent import near_duplicates

    ok = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v, _ in vectors if i < 600]
    ids, x = np.array([i for i, _ in ok]), np.array([v for _, v in ok])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    want = components(dict.fromkeys(ids.tolist()), lambda a, b: near[np.searchsorted(ids, a), np.searchsorted(ids, b)])
    got = {r.vec_id: r for r in near_duplicates(vectors_table(spark, vectors)).collect()}
    assert len(got) == len(vectors)
    for i, n in zip(ids.tolist(), near.sum(axis=1).tolist(), strict=True):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (n, want[i], want[i] == i)
    assert all(got[k].n_links == 0 and got[k].kept for k in (600, 620, 640, 660, 680))
    assert near_duplicates(vectors_table(spark, [])).collect() == []


def test_language_model_counts(spark, corpus):
    from repolens.llm.lm import language_model

    rows = {}
    train = Counter()
    for k, t in corpus:
        w = (t or "").encode().lower().split()
        rows[k] = w
        if zlib.crc32(str(k).encode()) % 7 != 2:
            train.update([*w, "END"])
    n, v = sum(train.values()), len(train)
    got = language_model(documents(spark, corpus)).collect()
    assert len(got) == len(corpus)
    for r in got:
        t = [*rows[r.doc_id], "END"]
        base = sum(np.log10((train[w] + 1) / (n + v + 1)) for w in t)
        assert r.n_tokens == len(t) and r.train_tokens == n and r.n_known == sum(train[w] > 0 for w in t)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) and abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score < 0
    assert language_model(documents(spark, [])).collect() == []


def test_filter_holds_every_ngram():
    from repolens.llm.lm import Asks, answered, level, pair_hash

    rng = np.random.default_rng(8)
    n, batches = 3, []
    for k in range(2):
        vocabulary = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
        at = rng.zipf(1.3, 40_000) % 3000
        batches.append((k, vocabulary, np.r_[at[-1:], at[:-1]], at, at % 5 > 0))  # some tokens are held out
    batches.append((2, batches[0][1], *batches[0][2:4], np.zeros(40_000, bool)))  # asks only
    ranges, asks, tokens, types = [[] for _ in range(n)], {}, 0, 0
    for k, vocabulary, before, at, train in batches:
        asks[k] = a = Asks(vocabulary, before, at)
        pair_counts = np.add.reduceat(train[a.order].astype(np.int64), a.first)
        for b, *blobs in a.rows(vocabulary, pair_counts, np.bincount(at, train, 3000), n):
            ranges[b].append((k, *blobs))
    answers = {0: [], 1: [], 2: []}
    for b, got in enumerate(ranges):
        out, t, v = answered(got)
        tokens, types = tokens + t, types + v
        for k, *blobs in out:
            answers[k].append((b, *blobs))
    words, pairs = Counter(), Counter()
    for _, vocabulary, before, at, train in batches:
        words.update(vocabulary[at[train]].tolist())
        pairs.update(pair_hash(vocabulary[before], vocabulary[at])[train].tolist())
    assert (tokens, types) == (sum(words.values()), len(words)) and sum(c == 1 for c in pairs.values()) > 2000
    for k, vocabulary, before, at, _ in batches:
        got, lv, exact = asks[k].answers(answers[k])
        want = np.array([pairs[p] for p in pair_hash(vocabulary[before], vocabulary[at]).tolist()])
        counts = np.array([words[w] for w in vocabulary.tolist()])
        assert (exact == counts).all()
        for found, true in ((got, want), (lv, counts)):
            true = np.where(true > 0, level(true), 0)
            assert (found >= true).all() and (found > true).mean() < 0.03


def test_pairs_that_occur_once_count(spark):
    from repolens.llm.lm import language_model

    rng = random.Random(12)
    rows = [(k, prose(rng, 120)) for k in range(80)] + [(k, "the same five words here " * 20) for k in range(80, 90)]
    seen = [k for k in range(80) if zlib.crc32(str(k).encode()) % 7 != 2]
    again = [k for k in range(1000, 2000) if zlib.crc32(str(k).encode()) % 7 == 2][: len(seen)]
    for k, x in zip(again, seen, strict=True):  # the words of a training text in another order, held out
        words = rows[x][1].split()
        rng.shuffle(words)
        rows.append((k, " ".join(words)))
    got = {r.doc_id: r for r in language_model(documents(spark, rows)).collect()}
    assert len(got) == len(rows)
    for k, x in zip(again, seen, strict=True):
        assert got[k].held_out and abs(got[k].base_score - got[x].base_score) < 1e-6 and got[k].n_known == got[x].n_known
        assert got[x].score > got[k].score + 0.1


def test_bloom_filter_levels():
    from repolens.llm.lm import BITS, Filter, filter_part

    rng = np.random.default_rng(4)
    h, lv = rng.integers(0, 1 << 62, 2000, dtype=np.uint64), rng.integers(1, 12, 2000)
    size = int(lv.sum()) * BITS
    f = Filter([filter_part(h, lv, size)], [size])
    got = f.levels(h, np.zeros(2000, dtype=np.int64))
    assert (got >= lv).all() and (got > lv).mean() < 0.03
    other = f.levels(rng.integers(0, 1 << 62, 5000, dtype=np.uint64), np.zeros(5000, dtype=np.int64))
    assert (other > 0).mean() < 0.03


def test_language_identification(spark):
    from repolens.llm.langid import language

    rng = random.Random(6)
    stock = {"en": ["the", "thing", "with", "shall"], "de": ["über", "straße", "nicht", "schön"], "fr": ["été", "garçon", "où", "naïve"]}
    rows = [(k, " ".join(rng.choice(stock[l]) for _ in range(20)), l, "s", 1) for k, l in enumerate(["en", "de", "fr"] * 50)]
    rows += [(900, None, "en", "s", 0), (901, "12 34 !!", "en", "s", 0), (902, "the thing", None, "s", 0), (903, "", "de", "s", 0)]
    got = {r.doc_id: r for r in language(spark.createDataFrame(rows, DOC)).collect()}
    assert len(got) == len(rows) and all(got[k].lang_pred == "und" for k in (900, 901, 903)) and got[902].lang_pred == "en"
    held = [r for r in rows if r[0] < 900 and zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert all(got[r[0]].held_out for r in held) and np.mean([got[r[0]].lang_pred == r[2] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    none = spark.createDataFrame([(1, "text", None, "s", 4)], DOC)
    assert [r.lang_pred for r in language(none).collect()] == ["und"]


@pytest.fixture(scope="module")
def toxic(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for k in range(300):
        bad = k % 4 == 0
        t = prose(rng, 40) + (" " + " ".join(rng.choice(["vilexx", "scumyy", "trashzz"]) for _ in range(3)) if bad else "")
        rows.append((k, t))
        if k < 260:
            labels.append((k, 1, int(bad)))
    rows += [(400, None), (401, "")]
    labels += [(0, 1, None), (3000, 0, 1)]
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark, toxic):
    from repolens.llm.toxicity import toxicity

    got = {r.doc_id: r for r in toxicity(*toxic).collect()}
    assert len(got) == 302 and got[400].predicted == 0 and got[401].predicted == 0
    assert all(got[k].predicted == int(k % 4 == 0) for k in range(300))
    assert all(0 <= r.score <= 1 for r in got.values())
    none = toxic[1].where("false")
    assert {r.score for r in toxicity(toxic[0], none).collect()} == {0.0}


def test_toxicity_of_few_examples_keeps_their_terms(spark, toxic):
    from repolens.llm.toxicity import toxicity

    docs, labels = toxic[0].where("doc_id < 36"), toxic[1].where("doc_id < 28")
    got = {r.doc_id: r for r in toxicity(docs, labels).collect()}
    bad, good = [got[k].score for k in range(36) if k % 4 == 0], [got[k].score for k in range(36) if k % 4]
    assert min(bad) > max(good) and all(r.evidence for r in got.values())


def test_toxicity_search_is_exact():
    from repolens.llm.toxicity import Index

    rng = np.random.default_rng(12)
    names = [f"t{i}".encode() for i in range(40)]
    rows = [(i, int(rng.random() < 0.3), np.sort(rng.choice(40, 5, replace=False)), rng.integers(1, 4, 5).astype(float)) for i in range(500)]
    index = Index(names, rng.random(40) + 0.5, rows, (1.0, 1.0))
    dense = np.zeros((500, 40))
    for i, (_, _, at, n) in enumerate(rows):
        dense[i, at] = index.weights(at, n)
    for _ in range(30):
        at = np.sort(rng.choice(40, 4, replace=False))
        q = index.weights(at, np.ones(4))
        near, cos = index.nearest(at, q)
        full = dense[:, at] @ q
        want = np.lexsort((np.arange(500), -full))[: len(near)]
        assert np.allclose(cos, full[want]) and np.allclose(full[near], full[want])


def test_sentencepiece_nbest():
    from repolens.llm.sentencepiece_nbest import Pieces, default_path

    m = Pieces(default_path())
    rng = random.Random(1)
    for _ in range(60):
        t = "".join(rng.choice(["the", "an", "é", "  ", " ", "\n", "x", "stion", "☃", "ing"]) for _ in range(rng.randint(1, 7)))
        got = m.text_nbest([t], 4)[0]
        assert np.allclose([s for s, _ in m.nbest(m.normalized(t), 4)], [s for s, _ in got], rtol=1e-12)
        assert len({i for _, i in got}) == len(got)
        assert all(m.decode(np.frombuffer(i, "<u4")) == t for _, i in got)

    def every(text):  # all paths of a short lattice
        into = m.edges(text)
        paths = [[(0.0, ())]]
        for e in range(1, len(text) + 1):
            paths.append([(s + x, p + ids) for b, x, ids in into[e] for s, p in paths[b]])
        return sorted((s for s, _ in paths[-1]), reverse=True)

    assert np.allclose(every("▁nations")[:4], [s for s, _ in m.nbest("▁nations", 4)])


def test_sentencepiece_frames(spark):
    from repolens.llm.sentencepiece_nbest import decode, encode_nbest

    docs = documents(spark, [(1, "the nation"), (2, None), (3, "")])
    rows = encode_nbest(docs).collect()
    assert sorted(r["rank"] for r in rows if r.doc_id == 1) == [1, 2, 3, 4]
    assert [(r["rank"], r.n_pieces, r.score) for r in rows if r.doc_id == 2] == [(1, 0, 0.0)]
    assert {r.decoded for r in decode(encode_nbest(docs)).where("doc_id = 1").collect()} == {"the nation"}


def test_pipeline(spark, corpus, tmp_path):
    import corpus_pipeline as c

    documents(spark, corpus).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    near = c.near_duplicates(spark, docs, str(tmp_path))
    ids = sorted(r.doc_id for r in near.collect())
    assert near.columns == docs.columns and ids.count(100) == 1 and not set(range(101, 141)) & set(ids) and 150 not in ids
    kept = c.language(spark, docs, str(tmp_path))
    assert not {152, 153, 154} & {r.doc_id for r in kept.collect()}
    pieces = c.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == {k for k in ids if k not in (152, 153, 154)}


def test_pipeline_stages_give_back_heap(spark, monkeypatch):
    import corpus_pipeline as c

    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Young" not in b.getName() and "Concurrent" not in b.getName())
    docs = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    for name, stage in c.STAGES:
        if name in ("passages", "packing"):  # the others run jobs first
            before = full()
            stage(spark, docs, "")
            assert full() > before
