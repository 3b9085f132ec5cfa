import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seriesframe.llm import elias_fano, lm_trie

FIELDS = "doc_id long, text string, score string, block long"


def words_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in lower.translate({c: " " for c in range(9, 14)}).split(" ") if w] + [None]


def brute(rows, is_held):
    """Every row's result from plain dictionaries of all words, pairs and triples."""
    one, two, three = Counter(), Counter(), Counter()
    for i, t in rows:
        if not is_held(i):
            w = [None, *words_of(t)]
            one.update(w[1:])
            two.update(zip(w, w[1:]))
            three.update(zip(w, w[1:], w[2:]))
    n, v = sum(one.values()), len(one)
    out = []
    for i, t in rows:
        w = [None, *words_of(t)]
        base = total = known = 0
        for k in range(1, len(w)):
            p = (one[w[k]] + 1) / (n + v + 1)
            base += math.log10(p)
            known += one[w[k]] > 0
            p = (two[w[k - 1], w[k]] + lm_trie.M2 * p) / (one[w[k - 1]] + lm_trie.M2)
            if k > 1:
                c = two[w[k - 2], w[k - 1]]
                p = (three[w[k - 2], w[k - 1], w[k]] + lm_trie.M3 * p) / (c + lm_trie.M3)
            total += math.log10(p)
        out.append((i, is_held(i), len(w) - 1, known, n, base, total))
    return out


def same(got, want):
    key = lambda r: (str(r[0]), str(r[1:5]), round(r[5], 6))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want):
        assert a[5] == pytest.approx(b[5], rel=1e-12, abs=1e-12)
        # a quantised term is at most half a step off
        assert abs(a[6] - b[6]) <= a[2] * 1.01 / elias_fano.STEPS + 1e-9


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(0, 1 << 44), max_size=200) | st.sets(st.integers(0, 40), max_size=40), st.lists(st.integers(0, 1 << 44)))
def test_sequences(values, others):
    values = sorted(values)
    s = elias_fano.Sequence(elias_fano.encode(np.array(values, np.int64)))
    assert s[np.arange(len(values))].tolist() == values
    asked = values + others + [v + 1 for v in values]
    places = {v: k for k, v in enumerate(values)}
    assert s.find(np.array(asked, np.int64)).tolist() == [places.get(v, -1) for v in asked]


def made_trie():
    grams = sorted({(a, b, c) for a, b, c in np.random.default_rng(1).integers(1, 12, (400, 3)).tolist()})
    pairs = sorted({g[:2] for g in grams} | {(3, 40), (50, 1)})
    first = sorted({a for a, _ in pairs})
    buffer = elias_fano.build(
        np.array(first), np.array([sum(p[0] == a for p in pairs) for a in first]), np.array([b for _, b in pairs]), np.linspace(0.9, 0.1, len(pairs)),
        np.linspace(0.2, 0.8, len(pairs)), np.array([sum(g[:2] == p for g in grams) for p in pairs]), np.array([c for *_, c in grams]), np.linspace(1, 1e-9, len(grams)))
    return grams, pairs, buffer


def test_trie_from_a_mapped_file(tmp_path):
    grams, pairs, buffer = made_trie()
    path = tmp_path / "trie"
    path.write_bytes(buffer)
    trie = elias_fano.Trie(np.memmap(path, np.uint8, "r"))
    asked = [(a, b, c) for a in range(1, 52) for b in range(1, 45) for c in range(1, 13)]
    first = np.arange(1, 52)
    second, parent = np.tile(np.arange(1, 45), 51), np.repeat(np.arange(51), 44)
    third, parent3 = np.tile(np.arange(1, 13), len(second)), np.repeat(np.arange(len(second)), 12)
    p2, left, p3 = map(elias_fano.restored, trie.search(first, second, parent, third, parent3))
    want2 = dict(zip(pairs, np.linspace(0.9, 0.1, len(pairs))))
    want3 = dict(zip(grams, np.linspace(1, 1e-9, len(grams))))
    assert np.allclose(p2, [want2.get((a, b), 0) for a in range(1, 52) for b in range(1, 45)], rtol=6e-4)
    assert np.allclose(p3, [want3.get(g, 0) for g in asked], rtol=6e-4)
    assert ((left > 0) == (p2 > 0)).all()


def test_quantised():
    p = np.array([0, 1, 0.5, 1e-12, 1e-31])
    got = elias_fano.restored(elias_fano.quantised(p))
    assert got[0] == 0 and np.abs(np.log10(got[1:]) - np.log10(p[1:])).max() <= 0.5 / elias_fano.STEPS + 1e-12


@given(st.lists(st.integers(0, 1 << 62)))
def test_packed_arrays(values):
    assert lm_trie.unpack(lm_trie.pack(np.array(values, np.int64))).tolist() == values


ROWS = [(i, " ".join(f"w{(i * k * k + k) % (3 + i % 40)}" for k in range(i % 37)) + " Same Ending\x0bof\tall\x0c ÄÖ\x1cx y") for i in range(150)] + [
    (200, ""), (201, None), (202, "once only here"), (7, "w1 w2 repeated id"), (7, "w1 w2 repeated id"), (None, "no id"), (None, None),
    (203, "long " * 5000 + "tail"), (204, "x" * 100_000)]


@pytest.mark.parametrize("shard_bytes,block", [(1 << 20, 1 << 20), (4000, 500)])
def test_held_out_like_plain_counts(spark, shard_bytes, block):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in ROWS], FIELDS).repartition(3)
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2
    number = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    got = lm_trie.score_held_out(docs, number % 7 == 2, shard_bytes, block).collect()
    same(got, brute(ROWS, held))


def test_a_hot_first_word_is_dealt_to_several_shards(monkeypatch):
    monkeypatch.setattr(lm_trie, "HOT", 50)
    block = lm_trie.Block()
    block.add(1, " ".join(f"hot w{k % 97}" for k in range(2000)), False)
    tokens, words = np.array(block.tokens), len(block.seen)
    counts = np.bincount(tokens)
    g = lm_trie.Grams(np.array(block.lengths), tokens, np.arange(1, words + 1), counts, np.ones(len(tokens), bool), 8)
    lists = {s: lm_trie.Query(data) for s, data in g.lists()}
    hot = block.seen[b"hot"] + 1
    assert sum(hot in q.first for q in lists.values()) > 4
    assert sorted(p for q in lists.values() for p in zip(q.first[q.parent_second].tolist(), q.second.tolist())) == sorted(zip(g.a.tolist(), g.b.tolist()))
    for q in lists.values():
        two, left, three = map(lm_trie.unpack, q.answer(lm_trie.Trie(lm_trie.merged_trie([q]))))
        assert (two > 0).all() and (left > 0).all() and (three > 0).all() and len(three) == len(q.third)


def test_a_kept_model_scores_other_texts(spark):
    train = [(i, t) for i, t in ROWS if i is not None and i % 2]
    model = lm_trie.train(spark.createDataFrame([(i, t, "x", 1) for i, t in train], FIELDS), 4000, 700)
    assert model.shards > 1
    texts = [(-1 - k, t) for k, (_, t) in enumerate(ROWS)]
    got = lm_trie.score(spark.createDataFrame([(i, t, "x", 1) for i, t in texts], FIELDS), model, 900).collect()
    want = brute(train + texts, lambda i: i < 0)[len(train):]
    same([(r[0], True, *r[1:]) for r in got], want)


def test_without_training_texts_and_without_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 1), (2, None, "x", 1)], FIELDS)
    got = lm_trie.score_held_out(docs, F.lit(True)).collect()
    assert sorted(map(tuple, got)) == [(1, True, 3, 0, 0, 0.0, 0.0), (2, True, 1, 0, 0, 0.0, 0.0)]
    assert lm_trie.score_held_out(docs.limit(0), F.lit(False)).count() == 0
    assert lm_trie.score(docs.limit(0), lm_trie.train(docs.limit(0))).count() == 0


def test_the_whole_query(spark):
    got = lm_trie.query(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = brute(list(map(tuple, docs)), lambda i: zlib.crc32(str(i).encode()) % 7 == 2)
    same(got, want)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(k).getName() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_")}


def test_steps_leave_no_shuffle_files(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(k, " ".join(f"w{int(rng.paretovariate(1))}" for _ in range(200))) for k in range(60)], "doc_id long, text string")
    before = _shuffle_files(spark)
    out = lm_trie.score_held_out(docs, F.col("doc_id") % 7 == 2, 2000, 1500)
    assert not _shuffle_files(spark) - before
    assert out.count() == 60


def test_texts_pack_by_frequency():
    rng = random.Random(5)
    block = lm_trie.Block()
    for k in range(40):
        block.add(k, " ".join(f"w{min(int(rng.paretovariate(0.5)), 5000)}" for _ in range(2000)), False)
    name, shard, data, ids, held = next(block.rows(0, 3))
    texts = next(lm_trie._numbered([(0, -1, 0, data, ids, held), (0, 0, 1, [lm_trie.pack(np.zeros(1, np.int64))] * 2, None, None)]))
    words = [b for r in list(block.rows(0, 3))[1:] for b in zstandard.decompress(r[2][0]).split(b"\n")]
    assert [words[t] for t in texts[4]] == [list(block.seen)[t] for t in block.tokens]
    assert len(data[1]) + len(data[2]) < len(lm_trie.pack(texts[4]))
