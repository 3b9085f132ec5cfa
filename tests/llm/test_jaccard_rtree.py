import random
import re

import numpy as np
import pytest

from seriesframe.llm import jaccard_rtree as J

SCHEMA = "doc_id long, text string, n int, id string"


def brute(rows, percent=80):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(r[1]) for r in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                comp[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return sorted(((r[0], len(s), least.get(root(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets))), key=str)


def corpus(seed, groups, size):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 6)))
    passage = [word() for _ in range(50)]
    rows = [(None, "x y"), (900, None), (901, ""), (902, " \t\n"), (903, "one two"), (904, "One TWO"), (905, "one two three"), (906, "É é"), (907, "é é")]
    for g in range(groups):
        base = [word() for _ in range(rng.choice([8, 30, 120, 400]))]
        for _ in range(rng.randrange(1, size)):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, len(w) // 12))):
                w[rng.randrange(len(w))] = word()
            if rng.random() < 0.3:
                w += passage
            rows.append((len(rows), rng.choice([" ", "\n"]).join(w).replace("a", rng.choice("aA"))))
    rows += [(5, rows[-1][1]), (5, rows[-2][1]), rows[-3], rows[-3], (None, rows[-4][1])]
    return [(a, b, 1, "z") for a, b in rows]


@pytest.mark.parametrize("seed, groups, size, options", [(1, 12, 25, {}), (2, 4, 60, {"sample_docs": 30, "slice_rows": 7})])
def test_like_brute_force(spark, seed, groups, size, options):
    rows = corpus(seed, groups, size)
    got = J.link(spark.createDataFrame(rows, SCHEMA).repartition(3), **options)
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()], key=str) == brute(rows)


def test_empty_table(spark):
    assert J.link(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("docs, times", [(60, 20), (J.SCAN + 40, 3)])
def test_bound_and_tree(docs, times):
    rng = np.random.default_rng(0)
    for _ in range(times):
        base = rng.integers(0, 2**63, 300).astype(np.uint64)
        sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(180, 290), False), rng.integers(0, 2**63, rng.integers(0, 60)).astype(np.uint64)])) for _ in range(docs)]
        rows = [(i, i % 7, len(s), J.count_vector(s).tobytes(), 0.0, 0, (0, 0)) for i, s in enumerate(sets)]
        got = {p[:2] for p in J._search_block(rows, "all", 80)}
        for i, a in enumerate(sets):
            for j in range(i):
                k = len(np.intersect1d(a, sets[j]))
                if i % 7 != j % 7 and 100 * k >= 80 * (len(a) + len(sets[j]) - k):
                    assert (j, i) in got


def test_word_hashes():
    """Equal words have equal hashes wherever they stand, in a chunk, across chunks and longer than one."""
    words = ["ab", "ba", "b", "x" * (J.CHUNK + 5), "y" * J.CHUNK, "ab"] + ["w", "ww", "é"] * 200_000 + ["ab", "ba"]
    data = ("  " + "  ".join(words) + " ").encode()
    found = J.word_hashes(data).tolist()
    assert len(found) == len(words)
    assert len(set(zip(words, found))) == len(set(words)) == len(set(found))
    assert len(J.word_hashes(b"")) == len(J.word_hashes(b"   ")) == 0


def test_one_row_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(40))
    near = text + " more"
    rows = [(7, text), (3, near), (3, near), (3, "other words that link with nothing at all"), (9, text.upper()), (None, text), (None, "alone with no id"), (5, None), (5, None), (8, "")]
    docs = spark.createDataFrame([(a, b, 0, "") for a, b in rows], SCHEMA).repartition(2)
    left = J.keep_first(docs)
    assert left.columns == docs.columns
    want = [(3, near), (3, rows[3][1]), (None, "alone with no id"), (5, None), (5, None), (8, "")]
    assert sorted([(r.doc_id, r.text) for r in left.collect()], key=str) == sorted(want, key=str)


def test_every_link_is_given(spark):
    rows = corpus(4, 6, 12)
    sets = [frozenset(J.shingle_set(r[1] or "").tolist()) for r in rows]
    want = {}
    for i, a in enumerate(sets):
        for b in sets[:i]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                want[frozenset((a, b))] = want.get(frozenset((a, b)), 0) + 1
    got = J.pairs(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len({(r.class_a, r.class_b) for r in got}) == len(got) == len(want)
    assert sorted(r.n_links for r in got) == sorted(want.values())
    least = lambda s: min((r[0] for r, x in zip(rows, sets) if x == s and r[0] is not None), default=None)
    ends = lambda pair: sorted(map(str, (least(s) for s in (tuple(pair) * 2)[:2])))
    assert sorted([*sorted(map(str, (r.doc_a, r.doc_b))), r.n_links] for r in got) == sorted([*ends(p), n] for p, n in want.items())
    assert J.pairs(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("options", [{}, {"slice_rows": 64}])
def test_a_group_of_near_copies(spark, options):
    """300 near copies, some linked only through others, and texts that come close without a link."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(160)]
    rows = []
    for k in range(300):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
        rows.append((1000 - k, " ".join(w), 0, ""))
    got = J.link(spark.createDataFrame(rows, SCHEMA).repartition(4), **options)
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()], key=str) == brute(rows)


def test_a_forest_spans_what_all_pairs_connect():
    rng = np.random.default_rng(3)
    bases = [rng.integers(0, 2**63, 300).astype(np.uint64) for _ in range(4)]
    sets = [np.unique(np.concatenate([rng.choice(bases[k % 4], rng.integers(230, 300), False), rng.integers(0, 2**63, rng.integers(0, 40)).astype(np.uint64)])) for k in range(120)]
    rows = [(i, i, len(s), J.count_vector(s).tobytes(), (i * 7 % 11) / 11, 0, (0, 0)) for i, s in enumerate(sets)]

    def groups(pairs):
        joined = J.Joined()
        for a, b in pairs:
            joined.join(a, b)
        return [{j for j in range(len(rows)) if joined.root(j) == joined.root(i)} for i in range(len(rows))]

    forest, every = (list(J._search_block(rows, mode, 80)) for mode in ("forest", "all"))
    assert groups(forest) == groups(every) and len(forest) == len(rows) - len({min(g) for g in groups(every)})
    linked = [(i, j) for j in range(len(sets)) for i in range(j) if 100 * (k := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (len(sets[i]) + len(sets[j]) - k)]
    got = list(J._links_of([(i, 0.0, s) for i, s in enumerate(sets)], 80))
    assert set(got) <= set(linked) and groups(got) == groups(linked)
