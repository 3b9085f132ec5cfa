import random
import re

import numpy as np
from pyspark.sql import functions as F

from seriesframe.llm import robust_quality as Q
from seriesframe.llm.common import shared

SCHEMA = "doc_id long, text string, lang string, source string, n_words int, bin int"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, covered = {}, set()
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i:i + 3]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            covered.update(p + k for p in places for k in range(3))
    n, r = len(words), len(covered)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), r, n < 50 or 100 * r > 50 * n


TEXTS = [
    None, "", " \n\t", "one", "a b c a b c a b", "x x x x x", "x\ny\nx\n\n \n \nx", "# * é😀 $%&|<>", "a\x0bb\x0cc\rd e", "a b c d a b c",
    "w " * 60, " ".join(f"w{i}" for i in range(80)), "\n".join(["same line here"] * 30), "ab c " * 4000, "é" * 20000, "a b\x1fc a b\x1fc a b\x1fc"]


def test_statistics(spark):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("ab #\n\t.") for _ in range(rng.randrange(400))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "en", None, 1, 2) for i, t in enumerate(texts)], SCHEMA)
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = {r.doc_id: tuple(r[c] for c in cols) for r in Q.statistics(docs).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute(t), repr(t)


def corpus():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 9)))
    good = [" ".join(word() for _ in range(rng.randrange(60, 200))) for _ in range(150)]
    caps = [g.upper() for g in good[:15]]
    junk = [re.sub(" ", "### ", g) for g in good[15:30]]
    return good[30:], caps + junk


def test_outliers_go_and_clean_documents_stay(spark):
    good, bad = corpus()
    rows = [(i, t, ["en", "de", None][i % 3], "s", 0, 0) for i, t in enumerate(good + bad)] + [(None, good[0], "xx", "rare", 0, 0)] * 2
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    stats = shared(Q.statistics(docs), "t")
    for min_group in (45, 100_000):
        out = Q.judge(stats, min_group=min_group).collect()
        assert len(out) == len(rows)
        assert {r.doc_id for r in out if not r.kept} == set(range(len(good), len(good + bad)))
    left = Q.keep_good(docs)
    assert left.columns == docs.columns and left.count() == len(rows) - len(bad)


def test_distances_are_those_of_the_estimate(spark):
    good, _ = corpus()
    stats = shared(Q.statistics(spark.createDataFrame([(i, t, "en", "s", 0, 0) for i, t in enumerate(good)], SCHEMA)), "t")
    sums = stats.groupBy("lang").agg(*Q._moments())
    est = Q._estimate(sums, ["lang"], 1.0).drop("lang", "logdet")
    rows = Q._distance(stats.crossJoin(F.broadcast(est))).select("d2", *Q.DIMS).collect()
    x = np.array([[r[d] for d in Q.DIMS] for r in rows])
    cov = np.cov(x.T, bias=True) + np.diag([f * f for f in Q.FLOORS.values()])
    z = x - x.mean(0)
    assert np.allclose([r.d2 for r in rows], np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z), rtol=1e-6)


def test_empty_tables_and_failed_groups(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert Q.judge(shared(Q.statistics(none), "t")).count() == 0
    short = shared(Q.statistics(spark.createDataFrame([(1, "few words", None, None, 0, 0), (1, None, None, None, 0, 0)], SCHEMA)), "t")
    assert [(r.base_failed, r.kept) for r in Q.judge(short).collect()] == [(True, False)] * 2
