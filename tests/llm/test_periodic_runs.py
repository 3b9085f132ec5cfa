import hashlib
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from seriesframe.llm import periodic_runs


def brute(words):
    """Runs by comparing every word with the one p words on, for every p."""
    n, found = len(words), {}
    for p in range(1, n // 3 + 1):
        k = 0
        while k < n - p:
            e = k
            while e < n - p and words[e] == words[e + p]:
                e += 1
            if e - k + p >= max(24, 3 * p):
                found.setdefault((k, e - k + p), p)
            k = e + 1
    return sorted((s, n, p) for (s, n), p in found.items())


def brute_row(doc_id, text):
    words = [w for w in (text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]
    n = len(words)
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    found = brute(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None,) * 3
    dropped = {i for s, size, p in found for i in range(s + p, s + size)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *best, best[1] * 1000 // best[2] if found else None, sha("".join(f"{s},{size},{p}\n" for s, size, p in found)), sha(kept))


@st.composite
def sequences(draw):
    words = draw(st.lists(st.integers(0, draw(st.sampled_from([0, 1, 2, 40]))), max_size=60))
    for _ in range(draw(st.integers(0, 3))):
        unit = draw(st.lists(st.integers(0, 3), min_size=1, max_size=30))
        words += unit * draw(st.integers(1, 12)) + unit[:draw(st.integers(0, len(unit)))]
        words += draw(st.lists(st.integers(0, 3), max_size=10))
    return words


@settings(max_examples=500, deadline=None)
@given(sequences())
def test_runs_like_brute_force(words):
    assert periodic_runs.runs(np.array(words, np.int64)) == brute(words)


@settings(max_examples=200, deadline=None)
@given(sequences(), st.data())
def test_extensions_like_word_by_word(words, data):
    if len(words) < 2:
        return
    pairs = data.draw(st.lists(st.tuples(st.integers(0, len(words) - 1), st.integers(0, len(words) - 1)).filter(lambda p: p[0] < p[1]), min_size=1, max_size=30))
    got = periodic_runs.Extensions(np.array(words, np.int64))(*np.array(pairs, np.int64).T)
    for (i, j), k in zip(pairs, got.tolist()):
        assert words[i:i + k] == words[j:j + k]
        assert j + k == len(words) or words[i + k] != words[j + k]


def test_the_cover_reaches_every_pair():
    assert {(a - b) % periodic_runs.V for a in periodic_runs.COVER for b in periodic_runs.COVER} == set(range(periodic_runs.V))


def test_long_sequences_beyond_the_short_grid():
    words = np.random.default_rng(1).integers(0, 2000, 90_000)
    words[40_000:70_000] = np.tile(words[40_000:41_111], 28)[:30_000]
    words[75_000:75_024] = 5
    assert periodic_runs.runs(words) == [(40_000, 30_000, 1111), (75_000, 24, 1)]
    assert periodic_runs.runs(np.zeros(100_000, np.int64)) == [(0, 100_000, 1)]


def test_over_spark(spark):
    unit = "the same few words again "
    rows = [(i, (unit * (i % 9) + f"word{i} \x0b\tÜber all\x0c " * (i % 13) + " ".join(f"w{i * k % 31}" for k in range(90 + i))), "x") for i in range(120)]
    rows += [(None, "a " * 40, "x"), (None, None, None), (1000, "", "x"), (5, rows[5][1], "y"), (5, rows[5][1], "y"), (1001, "ab" * 50_000, "x"), (1002, "q\n" * 3000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_runs string")
    got = periodic_runs.detect(docs, periodic_runs.DIGEST, change=periodic_runs.periodised)
    order = lambda r: str(r)
    assert sorted(map(tuple, got.collect()), key=order) == sorted((brute_row(i, t) for i, t, _ in rows), key=order)
    assert got.columns == ["doc_id", *periodic_runs.DIGEST]
    assert periodic_runs.detect(docs.limit(0)).count() == 0


def test_runs_and_collapsed_texts(spark):
    docs = spark.createDataFrame([("a", "start " + "x y z " * 10 + "end")], "doc_id string, text string")
    (row,) = periodic_runs.detect(docs).collect()
    assert [tuple(r) for r in row.runs] == [(1, 30, 3)]
    assert row.collapsed == "start x y z end"


def test_the_whole_query(spark):
    got = periodic_runs.query(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, got)) == sorted(brute_row(*r) for r in docs)
