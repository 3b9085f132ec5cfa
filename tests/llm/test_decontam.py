import random

from seriesframe.llm import decontam as D

DOCS = "doc_id long, text string, item_id int, h string"
ITEM = "A train leaves Boston at 40 km per hour while Maria walks 3 miles to meet Boston friends near the old bridge today."
ITEMS = [(1, ITEM), (2, "the quick brown fox jumps over it"), (3, None), (4, "2 3 4 5 6 7 8 9 10 11 12 13"), (None, "words of an item without any id but long enough to have several windows in it"), (1, ITEM)]


def run(spark, docs, items=ITEMS):
    out = D.leaks(spark.createDataFrame([(a, b, 0, "") for a, b in docs], DOCS), spark.createDataFrame(items, "item_id long, text string"))
    return sorted([(r.doc_id, r.item_id, r.matched == r.windows, r.reparameterised) for r in out.collect()], key=str)


def test_templates_and_slots(spark):
    filler = " ".join(f"filler{chr(97 + i)}" for i in range(20))
    other = ITEM.replace("Boston", "Denver").replace("40", "75").replace("km", "miles").replace("Maria", "Jose")
    docs = [
        (10, f"{filler}. {ITEM} {filler}"), (11, f"{filler}. {other}"), (12, other.replace("Denver friends", "Austin friends")), (13, filler), (14, None), (15, ""),
        (16, f"say {ITEMS[1][1].upper()} now and so on until the text is long enough"), (17, "the quick brown fox"), (18, "1 2 3 4 5 6 7 8 9 10 11 12 13 14"),
        (None, ITEM), (10, f"{filler}. {ITEM} {filler}"), (19, ITEMS[4][1])]
    assert run(spark, docs) == sorted([
        (10, 1, True, False), (11, 1, True, True), (16, 2, True, False), (None, 1, True, False), (19, None, True, False)], key=str)
    assert run(spark, []) == [] and run(spark, docs, []) == []


def test_like_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(2, 6)))
    items = [(i, " ".join(word() for _ in range(rng.randrange(12, 30)))) for i in range(15)]
    docs = []
    for d in range(80):
        w = [word() for _ in range(60)]
        if d % 3 == 0:
            part = rng.choice(items)[1].split()
            n = rng.randrange(8, len(part) + 1)
            w[20:20] = part[:n]
        docs.append((d, " ".join(w)))
    want = []
    for d, text in docs:
        w = text.split()
        grams = {tuple(w[k:k + D.WINDOW]) for k in range(len(w) - D.WINDOW + 1)}
        for i, item in items:
            v = item.split()
            own = [tuple(v[k:k + D.WINDOW]) for k in range(len(v) - D.WINDOW + 1)]
            if sum(g in grams for g in own) >= min(D.LEAST, len(own)):
                want.append((d, i))
    assert len(want) > 10
    assert [r[:2] for r in run(spark, docs, items)] == sorted(want, key=str)


def test_stage_keeps_clean_documents(spark):
    docs = spark.createDataFrame([(1, ITEM, 0, ""), (2, "fine", 0, ""), (None, None, 0, ""), (None, ITEM, 1, "")], DOCS)
    left = D.keep_clean(docs, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert left.columns == docs.columns and sorted(str(r.text) for r in left.collect()) == ["None", "fine"]


def test_items_with_few_windows_and_first_words(spark):
    table = "Add the rows 1 2 3 4 5 6 7 8 9 10 11 12"
    few = "seven tall men came to 3 4 5 6 7 8 9"
    named = "Trains leave Boston at noon and reach the coast at 9"
    items = [(1, table), (2, few), (3, named), (4, "What is 2 + 2?"), (5, "Paris Rome Oslo Bern Vienna Lisbon Madrid Prague Dublin Athens")]
    filler = " ".join(f"filler{chr(97 + i)}" for i in range(12))
    docs = [
        (1, f"{filler} {table}"), (2, f"{filler}: {few.upper()}, {filler}"), (3, f"{filler}: {named} {filler}"), (4, f"{filler}: what is 2 + 2? {filler}"),
        (5, f"{filler} {items[4][1]}"), (6, f"{filler}: {named.replace('Boston', 'Denver')} {filler}"), (7, few.replace("3 4 5", "4 5 6").replace("7 8 9", "8 9 1")),
        (8, "1 2 3 4 5 6 7 8 9 10 11 12"), (9, f"{filler} what is 2 + 3? {filler}"), (10, "Add the columns 1 2 3 4 5 6 7 8 9 10 11 12"), (11, "the rows 1 2 3 4 5 6 7 8 9 10 11 12")]
    assert run(spark, docs, items) == sorted([(1, 1, True, False), (2, 2, True, False), (3, 3, True, False), (4, 4, True, False), (5, 5, True, False), (6, 3, True, True), (7, 2, True, True)], key=str)


def test_few_eligible_windows_reparameterised(spark):
    item = "seven tall men came to the 3 4 5 6 7 8 9 10"  # windows at 0, 1 are eligible, the others are not
    got = D.leaks(spark.createDataFrame([(1, item.replace("3", "30"), 0, "")], DOCS), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [(r.item_id, r.matched, r.windows, r.reparameterised) for r in got] == [(1, 2, 2, True)]


def test_texts_hashed_together_keep_apart():
    texts = ["", "The 3", "km. Anna went", "Anna 12", "...", "Kg of rice", "7", ""]
    together = D.canonical(texts, D.Canon())
    alone = [D.canonical([t], D.Canon()) for t in texts]
    assert together[-1].tolist() == [k for k, c in enumerate(alone) for _ in c[-1]]
    for k in (2, 3, 4):
        assert together[k].tolist() == [x for c in alone for x in c[k].tolist()]
    assert [together[0][k] for k in together[1]] == [c[0][k] for c in alone for k in c[1]]


def test_no_window_spans_two_texts(spark):
    item = "who carried the old brass lantern over seven hills to warm the sleeping village below"
    words = item.split()
    docs = [(k, " ".join(words[k % len(words):][:7])) for k in range(40)]
    docs += [(90, " ".join(words[:8])), (91, " ".join(words[8:])), (92, "so " + item), (93, None)]
    got = D.leaks(spark.createDataFrame([(a, b, 0, "") for a, b in docs], DOCS).coalesce(1), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.matched, r.windows) for r in got] == [(92, 6, 6)]
