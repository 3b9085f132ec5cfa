import random

import numpy as np

from seriesframe.llm import toxicity_chain as T

DOCS = "doc_id long, text string, toxic string, p_toxic int"
BAD = ["grumblit", "snorvak", "flobbert"]


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    rows = []
    for i in range(n):
        w, toxic = [word() for _ in range(rng.randrange(20, 80))], i % 6 == 0
        for _ in range(rng.randrange(2, 6) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(BAD) + rng.choice(["", "", word()]))
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def frames(spark, rows, more=()):
    docs = spark.createDataFrame([(a, b, "x", 1) for a, b, _ in rows] + [(a, b, None, None) for a, b in more], DOCS).repartition(3)
    return docs, spark.createDataFrame([(a, 1, t) for a, _, t in rows], "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = frames(spark, corpus(1, 900))
    chain = T.train(docs, labels)
    other = corpus(2, 300)
    odd = [(None, None), (1001, ""), (1002, "é 1 2"), (1003, other[0][1]), (1003, other[0][1]), (1004, "word " * 30000)]
    held, _ = frames(spark, other, odd)
    got = T.score(held, chain).collect()
    assert len(got) == len(other) + len(odd)
    by = {r.doc_id: r for r in got}
    assert np.mean([by[a].toxic == bool(t) for a, _, t in other]) > 0.97
    assert by[1003].toxic and by[1003].p_mention > 0.5 and not by[1001].toxic and not by[None].toxic and not by[1004].toxic
    assert all(0 <= r[f"p_{c}"] <= 1 for r in got for c in T.CATEGORIES)


def test_earlier_probabilities_are_out_of_fold():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(60, 40)), rng.integers(0, 2, 60).astype(float)  # pure noise: fitted in sample it would look certain
    chain = T.Chain.fit({}, np.zeros(38, bool), x, np.column_stack([y, y]))
    in_sample = T._sigmoid(np.column_stack([x, np.ones(60)]) @ chain.weights[0])
    assert np.mean((in_sample > 0.5) == y) > 0.9
    assert abs(chain.weights[1][40]) < 2  # the second model has seen that the first is no use on unseen rows
    assert len(chain.weights[1]) == 42


def test_empty_and_one_sided_tables(spark):
    docs, labels = frames(spark, corpus(1, 12))
    for some in (labels.limit(0), labels.where("toxic = 0")):
        got = T.score(docs, T.train(docs, some)).collect()
        assert len(got) == 12 and all(r.p_toxic == 0 and not r.toxic for r in got)
    assert T.score(docs.limit(0), T.train(docs.limit(0), labels)).count() == 0
