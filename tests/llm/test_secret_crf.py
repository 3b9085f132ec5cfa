import hashlib
import itertools
import random
import re

import numpy as np

from seriesframe.llm import secret_crf as S

DOCS = "doc_id long, text string, spans int, n_hex string"


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    key = lambda k, a="abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNP23456789": "".join(rng.choice(a) for _ in range(k))
    rows = []
    for i in range(n):
        w = [word().capitalize() if rng.random() < 0.1 else word() for _ in range(rng.randrange(20, 120))]
        if i % 4 == 0:
            w.insert(rng.randrange(len(w)), rng.choice([f'token = "{key(24)}"', f"password={key(12)}", f"AKIA{key(16, 'ABCDEFGHIJ0123456789')}", key(40, "0123456789abcdef"), f"API_KEY: '{key(20)}'"]))
        rows.append((i, " ".join(w)))
    return rows


def base(text):
    out = [("assign", *m.span()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    order = ["assign", "access", "hex"]
    return sorted(out, key=lambda s: (s[1], order.index(s[0])))


ODD = [
    (None, None), (1, ""), (2, " \n"), (3, "token=secret:abcdefgh"), (3, "token=secret:abcdefgh"), (4, "PassWord\" : 'é password=aaaaaaaa" + "0" * 32),
    (5, "AKIAAKIAAKIAAKIA1 AKIAABC" + "f" * 100), (6, "ſecret=abcdefghij toKen=abcdefghij"), (7, "x" * 50000 + " password=abcdefgh"), (8, "😀 token:abcdefgh,😀")]


def test_patterns_over_spark(spark):
    rows = corpus(1, 300) + ODD
    docs = spark.createDataFrame([(a, b, 0, "") for a, b in rows], DOCS).repartition(4)
    field = S.train(docs)
    got = sorted([tuple(r) for r in S.scan(docs, field).collect()], key=str)
    assert len(got) == len(rows)
    for (a, b), r in zip(sorted(rows, key=lambda r: str(r[0])), sorted(got, key=lambda r: str(r[0]))):
        if r[0] == 3 or [x for x, _ in rows].count(r[0]) == 1:
            want = base(b or "")
            text = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
            assert r[1:5] == (*[sum(w[0] == k for w in want) for k in ("assign", "access", "hex")], hashlib.sha256(text.encode()).hexdigest())
            assert [s for s in r[5].split(",") if s and not s.startswith("crf")] == (text.split(",") if text else [])
    left = S.redact(docs, field)
    assert left.columns == docs.columns and left.schema == docs.schema
    for r in left.collect():
        assert not base(r.text or "") and (r.text is None) == (r.doc_id is None and r.text is None)
    none = spark.createDataFrame([], DOCS)
    assert S.scan(none).count() == 0 and S.redact(none).count() == 0


def test_finds_what_the_patterns_miss_and_leaves_plain_texts(spark):
    docs = spark.createDataFrame([(a, b, 0, "") for a, b in corpus(2, 600)], DOCS)
    field = S.train(docs)
    rng = random.Random(9)
    found = 0
    for _ in range(40):
        key = "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNP23456789") for _ in range(24))
        text = f'ab cde fghi credentials = "{key}" jih gfe'
        found += any(k == 3 and key in text[a:b] for k, a, b in S.find(text, field))
    assert found >= 30
    plain = corpus(3, 200)
    wrong = sum(any(k == 3 for k, _, _ in S.find(t, field)) for i, t in plain if i % 4)
    assert wrong <= 3


def test_viterbi_is_exact():
    rng = np.random.default_rng(0)
    for _ in range(30):
        field = S.Field(rng.normal(0, 1, (4, 1 << S.BITS, 3)), np.zeros((S.FILES, 3)) + [0, 0, rng.uniform(0, 9)], rng.normal(0, 1, (3, 3)))
        tokens = [rng.choice(["a", "Bc", "d9", "=", '"', "token", "x-y"]) for _ in range(7)]
        s = field.scores(tokens, 3)
        total = lambda tags: sum(s[i, t] for i, t in enumerate(tags)) + sum(field.steps[a, b] for a, b in zip(tags, tags[1:]))
        best = max(itertools.product(range(3), repeat=7), key=total)
        assert total(field.tag(tokens, 3)) >= total(best) - 1e-9


def test_a_field_span_that_reaches_beyond_a_pattern(spark):
    key = "geheimnisschlüssel12"
    weights, files = np.zeros((4, 1 << S.BITS, 3), np.float32), np.zeros((S.FILES, 3), np.float32)
    files[:, S.O] = 5
    weights[S.OFFSETS.index(0), S.features(key), S.B] = 50
    field = S.Field(weights, files, np.zeros((3, 3), np.float32))
    text = f"ab password={key} cd"
    assert S.find(text, field) == [(0, 3, 3 + len("password=geheimnisschl")), (3, 12, 12 + len(key))]
    docs = spark.createDataFrame([(1, text, 0, "")], DOCS)
    assert S.redact(docs, field).first().text == "ab [secret] cd"
    assert S.find("ab password=geheimnis12 cd", field)[0][0] == 0
    assert S.shape("a" * 80 + "9") == "a0"
