"""Clashing column names, repeated rows, very long texts, empty tables and ties of the operators."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_operators import DOC, documents, prose, vectors_table


def test_passages_of_a_doc_id_with_two_texts(spark):
    from repolens.llm.substring_dedup import cut, passages

    rng = random.Random(31)
    block = prose(rng, 80)
    long, short = f"{prose(rng, 90)} {block} {prose(rng, 60)}", prose(rng, 70)
    rows = [(1, long), (2, long), (2, short), (2, short), (3, f"{short} {prose(rng, 50)}"), (4, prose(rng, 100))]
    got = passages(documents(spark, rows)).collect()
    assert {(r.doc_id, r.duplicate) for r in got} == {(1, False), (2, True), (2, False), (3, True)}
    left = cut(documents(spark, rows)).collect()
    assert len(left) == len(rows)
    assert sorted(len(r.text.split()) for r in left if r.doc_id == 2) == [0, 70, 70]
    assert [len(r.text.split()) for r in left if r.doc_id == 3] == [50]


def test_passages_keep_clashing_columns(spark):
    from repolens.llm.substring_dedup import cut

    rng = random.Random(32)
    text = prose(rng, 120)
    rows = [(k, text, 7, [k], 0.5, k, "x", "y") for k in (1, 2)] + [(3, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, _spans array<int>, score double, row_key long, _doc string, spans string")
    left = {r.doc_id: r for r in cut(docs).collect()}
    assert cut(docs).schema == docs.schema
    assert left[1].text == text and left[1].n_chars == 7 and left[2].text == "" and left[2].n_chars == 0
    assert left[2]._spans == [2] and left[2].score == 0.5 and left[2].row_key == 2 and left[2].spans == "y" and left[3].text is None


def test_pipeline_stages_keep_clashing_columns(spark, tmp_path):
    import corpus_pipeline as c

    rng = random.Random(33)
    text = prose(rng, 60)
    rows = [(k, prose(rng, 60), "en", "s", 1, 0.25, "mine", 9, [1], "r", k) for k in range(1, 9)] + [(20, text, "en", "s", 1, 0.25, "mine", 9, [1], "r", 20)] * 2 + [(21, text, "en", "s", 1, 0.25, "mine", 9, [1], "r", 21)]
    docs = spark.createDataFrame(rows, f"{DOC}, score double, lang_pred string, predicted int, evidence array<int>, _repeated string, component_id long")
    spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for stage in (c.toxicity, c.language, c.near_duplicates, c.passages):
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns
        kept = {r.doc_id: r for r in got.collect()}
        assert set(range(1, 9)) <= set(kept)
        assert all((r.score, r.lang_pred, r.predicted, r.evidence, r._repeated, r.component_id) == (0.25, "mine", 9, [1], "r", k) for k, r in kept.items())
    assert sorted(r.doc_id for r in c.near_duplicates(spark, docs, str(tmp_path)).collect()) == [*range(1, 9), 20]


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline as c

    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert c.run(spark, str(tmp_path)).collect() == []


def test_letters_are_those_of_unicode():
    from repolens.llm.langid import has_letter

    assert not any(map(has_letter, ["½ ² ①", "Ⅷ", "12 _ !", "ⓐ", ""]))
    assert all(map(has_letter, ["½a", "ª", "ʰ", "中", "ǅ"]))


def test_language_of_long_repeated_and_extra(spark):
    from repolens.llm.langid import language

    rows = [(1, "the thing shall " * 20, "en", "s", 1, "x"), (7, "über straße nicht " * 20, "de", "s", 1, "x")] * 2 + [(3, "the thing " * 60_000, None, None, None, None), (None, "nicht schön", None, None, None, None)]
    got = language(spark.createDataFrame(rows, DOC + ", lang_pred string")).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got if r.doc_id == 3} == {"en"} and {r.lang_pred for r in got if r.doc_id == 7} == {"de"}
    assert language(documents(spark, [])).collect() == []


def test_toxicity_of_long_repeated_and_empty(spark):
    from repolens.llm.toxicity import toxicity

    rows = [(k, "vilexx scumyy trash" if k % 2 else f"kind words {k}") for k in range(1, 21)]
    rows += [(1, "another text of one id"), (2, rows[1][1]), (90, "vilexx " * 40_000), (None, "scumyy"), (91, None)]
    labels = spark.createDataFrame([(k, 0, k % 2) for k in range(1, 21)], "doc_id long, quality int, toxic int")
    docs = documents(spark, rows).withColumn("score", F.lit("own"))
    once, again = ({(r.doc_id, r.score) for r in toxicity(docs.repartition(n), labels).collect()} for n in (1, 7))
    assert once == again
    got = toxicity(docs, labels).collect()
    assert len(got) == len(rows) and [r.predicted for r in got if r.doc_id in (90, None)] == [1, 1]
    assert toxicity(documents(spark, []), labels).collect() == []


def test_toxicity_search_equals_all_cosines():
    """Block maxima leave out no neighbour: weights as skewed as chi-square makes them, ties, k beyond the examples."""
    from repolens.llm.toxicity import Index

    rng = np.random.default_rng(41)
    for size, terms in ((3, 5), (40, 30), (700, 2_500)):
        rows = []
        for i in range(size):
            at = np.unique((terms * rng.random(12) ** 3).astype(np.int64))
            rows.append((1_000 - i, int(rng.random() < 0.3), at, rng.integers(1, 4, len(at)).astype(float)))
        rows[-1] = (1_000 - size + 1, 0, *rows[0][2:])
        index = Index([str(i).encode() for i in range(terms)], np.exp(2 * rng.standard_normal(terms)), rows, (1.0, 1.0))
        dense = np.zeros((size, terms))
        for i, (_, _, at, n) in enumerate(rows):
            dense[i, at] = index.weights(at, n)
        texts = []
        for _ in range(60):
            at = np.unique((terms * rng.random(8) ** 3).astype(np.int64))
            texts.append((at, index.weights(at, np.ones(len(at)))))
        ids = np.array([r[0] for r in rows])
        for (at, w), (near, cos) in zip(texts, index.search(texts), strict=True):
            full = np.round(dense[:, at] @ w, 12)
            want = [i for i in np.lexsort((ids, -full)) if full[i] > 0][:15]
            assert near.tolist() == want and np.allclose(cos, full[want])


def test_nbest_of_long_chunks_and_whole_texts(spark):
    from repolens.llm.sentencepiece_nbest import Pieces, default_path, encode_nbest

    m = Pieces(default_path())
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefgh☃") for _ in range(200_000))
    got = m.text_nbest([long], 3)[0]
    assert len(got) == 3 and m.decode(np.frombuffer(got[0][1], "<u4")) == long

    def every(text):  # all paths of a whole text's lattice, without chunks
        into = m.edges(text)
        paths = [[(0.0, ())]]
        for e in range(1, len(text) + 1):
            paths.append([(s + x, p + ids) for b, x, ids in into[e] for s, p in paths[b]])
        return sorted((s for s, _ in paths[-1]), reverse=True)

    for text in ("an ox", "the é to", "a\nof it", "ing in"):
        assert np.allclose(every(m.normalized(text))[:6], [s for s, _ in m.text_nbest([text], 6)[0]])
    rows = encode_nbest(documents(spark, [(1, "the nation"), (1, "the nation"), (2, None), (None, "é ☃ x"), (4, "a▁b")]), ids=False, decoded=True).collect()
    assert len([r for r in rows if r.doc_id == 1]) == 8 and all(r.same_text for r in rows if r.doc_id != 4)


def test_packing_of_repeated_rows_and_empty(spark):
    from repolens.llm import packing as p

    rows = p.pack(documents(spark, [(1, "some words " * 900), (1, "some words " * 900), (2, None), (None, "x")])).collect()
    assert sum(r.length for r in rows if r.doc_id == 1) == 2 * max(r.doc_tokens for r in rows)
    assert p.pack(documents(spark, [])).collect() == []


def test_windows_hold_related_units(spark, monkeypatch):
    """Topics of 12 documents each (about two windows), far more of them than a shard holds: the share of
    window mates of one topic (by chance one pair in 40) is near that of a single index of all units."""
    from repolens.llm import packing as p
    from repolens.llm.encoder import default_path, encoder

    rng = random.Random(44)
    words = sorted(w[1:] for w in encoder(default_path()).model.get_vocab() if w[0] == "Ġ" and w[1:].isascii() and w[1:].isalpha() and len(w) > 4)
    topics = [rng.sample(words, 100) for _ in range(40)]
    docs = documents(spark, [(t * 100 + k, " ".join(rng.choice(own) for _ in range(300))) for t, own in enumerate(topics) for k in range(12)])

    def related(shard, parts):
        monkeypatch.setattr(p, "SHARD", shard)
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            windows: dict = {}
            for r in p.pack(docs).collect():
                windows.setdefault(r.sequence_id, []).append(r.doc_id // 100)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        pairs = [a == b for w in windows.values() for i, a in enumerate(w) for b in w[i + 1 :]]
        return np.mean(pairs)

    whole, sharded = related(4_096, 1), related(48, 4)
    print(f"window mates of one topic: one index {whole:.3f}, shards {sharded:.3f}")
    assert whole > 0.5 and sharded > 0.8 * whole


def test_search_with_few_candidates_and_ties(spark):
    from repolens.llm.ann import search

    rows = [(20, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [0.0, 1.0], 0)]
    got = sorted((r["rank"], r.vec_id) for r in search(vectors_table(spark, rows), F.pmod("vec_id", F.lit(20)) == 0).collect())
    assert got == [(1, 1), (2, 2), (3, 3)]


def test_links_report(spark):
    from repolens.llm.nn_descent import near_duplicates

    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 8))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(1_000 + i, (x[i] * (1 + i)).tolist(), 0) for i in range(40)]
    report: dict = {}
    got = {r.vec_id: r for r in near_duplicates(vectors_table(spark, rows), report=report).collect()}
    assert report["recall"] >= 0.999 and report["audited"] >= 32
    assert all(got[1_000 + i].component_id <= i for i in range(40))


@pytest.mark.parametrize("name", ["jaccard_groups", "language_model"])
def test_extra_columns_and_null_ids(spark, name):
    from repolens.llm import jaccard_join, lm

    run = getattr(jaccard_join, name, None) or getattr(lm, name)
    rows = [(1, "one two three four five six", 5), (None, "one two three four five six", 5), (None, None, 5), (3, "", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long").withColumn("bucket", F.lit("x")).withColumn("row_key", F.lit(1)).withColumn("score", F.lit(1))
    assert len(run(docs).collect()) == len(rows)


def test_pretokens_are_found_in_whole_arrays(monkeypatch):
    from repolens.llm import encoder as module

    e = module.Encoder(module.default_path())
    draw = random.Random(7)
    parts = ["'", "s", "t", "re", "ve", "ll", "'S", " ", "  ", "\n", "\t", "\r\n", "12", "²", "é", "ßa", "—", "€", "!!", "don't", "I'll", "x" * 30, "a" * 70, "-" * 80]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(1, 40))) for _ in range(3_000)]
    for t in texts:
        data = t.encode() + b"\0"
        at = e.starts(np.frombuffer(data, dtype=np.uint8)).tolist()
        assert [data[s:z].decode() for s, z in zip(at, at[1:], strict=False)] == e.words.findall(t)
    wanted = e._whole(texts)
    assert e.encode(texts) == wanted and e.encode(texts[::-1]) == wanted[::-1]
    held = e.held
    assert e.encode(texts) == wanted and e.held == held  # nothing is encoded twice
    monkeypatch.setattr(module, "CACHED", 40)
    monkeypatch.setattr(module, "AT_ONCE", 60)
    assert e.encode(texts) == wanted and e.held <= 40
    rare = " ".join(f"word{k}" for k in range(200))  # more new pre-tokens than are remembered
    assert e.encode([rare]) == e._whole([rare])


def test_near_passages_of_frequent_lines(spark, monkeypatch):
    from repolens.llm import substring_dedup

    rng = random.Random(41)
    rows = []
    for k in range(3):
        lines = [prose(rng, 16) for _ in range(6)]
        for j in range(5):  # every two neighbouring lines are frequent, before and between the two passages
            rows += [(at + 60 * k + 10 * j + i, f"{prose(rng, 40)} {lines[j]} {lines[j + 1]} {prose(rng, 40)}") for at in (0, 500) for i in range(10)]
        block = " ".join(lines).split()
        near = [*block[:47], f"changed{k}", *block[48:]]
        rows += [(300 + k, f"{prose(rng, 30)} {' '.join(block)} {prose(rng, 30)}"), (800 + k, f"{prose(rng, 30)} {' '.join(near)} {prose(rng, 30)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for rounds in (substring_dedup.ROUNDS, (1, None)):
        monkeypatch.setattr(substring_dedup, "ROUNDS", rounds)
        found = substring_dedup.passages(docs).where("duplicate").collect()
        assert sorted((r.doc_id, r.start_word, r.n_words, r.source_doc_id) for r in found) == [(800 + k, 30, 96, 300 + k) for k in range(3)]


def test_family_of_open_passages_goes_to_few_tasks(spark, monkeypatch):
    from repolens.llm import substring_dedup

    rng = random.Random(43)
    block, rows = prose(rng, 60).split(), []
    for k in range(60):  # every two members share 46 of 66 shingles: each has to be compared with all, none is similar
        own = [f"member{k}a" if i == 20 else f"member{k}b" if i == 40 else w for i, w in enumerate(block)]
        rows.append((k, " ".join([prose(rng, 30), *own, prose(rng, 30)])))
    rows.append((60, " ".join([prose(rng, 30), *rows[7][1].split()[30:90], prose(rng, 30)])))
    sent, table = [], substring_dedup.lookup_table

    def counted(df, array=None, **more):
        out = table(df, array, **more)
        if array == "needs":
            sent.append(sum(len(r.needs) for r in df.collect()))
        return out

    monkeypatch.setattr(substring_dedup, "lookup_table", counted)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        found = substring_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).where("duplicate").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [(r.doc_id, r.start_word, r.n_words, r.source_doc_id) for r in found] == [(60, 30, 60, 7)]
    assert max(sent) <= 61 * 16  # rows and columns of the grid, not one slice for every bucket


def test_rarest_shingles_ask():
    from repolens.llm.substring_dedup import SEEN, SHORTEST, asking

    rng = np.random.default_rng(7)
    n = SHORTEST
    at, sig, level = np.arange(n), rng.integers(1, 1 << 63, n, dtype=np.uint64), rng.integers(0, 40, n).astype(np.uint8)
    covered = np.arange(n) > 0
    asks = asking(at, np.ones(n, dtype=bool), covered, sig, level)
    assert asks.sum() == n - SEEN + 1 and level[asks].max() <= level[~asks].min()
    assert not asking(at, np.ones(n, dtype=bool), np.ones(n, dtype=bool), sig, level).any()  # covered ones are not open
    sig[10:] = sig[10]  # 11 different ones, of which 9 are enough
    assert asking(at, np.ones(n, dtype=bool), covered, sig, level).sum() == 3


def test_a_match_is_cut_at_any_gap():
    from repolens.llm.substring_dedup import matched

    a = np.arange(1, 301, dtype=np.uint64)
    b = a.copy()
    for k, at in enumerate((20, 35, 50, 65, 125, 140, 155)):  # a changed word takes five shingles; between 70 and 125 nothing is changed
        b[at : at + 5] = 1_000 + 10 * k + np.arange(5)
    b[160:] = np.arange(5_000, 5_000 + 140)
    found = [(s, e) for _, _, s, e in matched(a, b)]
    assert found and min(s for s, _ in found) <= 70 and max(e for _, e in found) >= 125
    shifted = np.r_[np.arange(9_000, 9_007, dtype=np.uint64), b]
    assert [(s - 7, e - 7) for _, _, s, e in matched(a, shifted)] == found


def test_dense_ranges_end_with_their_text():
    from repolens.llm.substring_dedup import LONGEST, SEEN, open_and_dense, overlapping

    at = np.r_[np.arange(SEEN + 5), 1_000 + np.arange(SEEN + 5)]  # two texts, dense up to their ends
    none = np.zeros(len(at), dtype=bool)
    _, _, lo, hi = open_and_dense(at, none, none)
    assert lo.tolist() == [0, SEEN + 5] and hi.tolist() == [SEEN + 5, 2 * SEEN + 10]
    at = np.sort(np.random.default_rng(1).choice(5_000, 3_000, replace=False))
    lo, hi = overlapping(at, np.array([0, 1_000]), np.array([1_000, 3_000]))
    assert (at[hi - 1] - at[lo] < 4 * LONGEST).all()
    for i in (*range(0, 900, 7), *range(1_000, 2_900, 7)):  # what lies within LONGEST stays together
        end = min(np.searchsorted(at, at[i] + LONGEST), 1_000 if i < 1_000 else 3_000)
        assert ((lo <= i) & (end <= hi)).any()


def test_places_with_like_surroundings():
    from repolens.llm.substring_dedup import LONGEST, surroundings

    family, level = np.arange(100, 150, dtype=np.uint64), np.full(50, 40, dtype=np.uint8)

    def near(before, more, start=0):
        at = start + np.r_[10, 20 + np.arange(50), 80]
        sig, own = np.r_[before, family, np.uint64(7)].astype(np.uint64), np.r_[more, level, 8].astype(np.uint8)
        return surroundings(at, sig, own)

    one, other, moved, frequent = near(1, 12), near(2, 16), near(1, 12, 3 * LONGEST), near(3, 48)
    assert (one[1:51] == other[1:51]).all() and (one == moved).all()  # rarer shingles beside the family's don't count
    assert (one[1:51] != frequent[1:51]).all() and one[51] == 0 and len(np.unique(one[1:51])) == 50
