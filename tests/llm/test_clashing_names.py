"""Stages keep columns whose names their own helper columns have."""
from seriesframe.llm import decontam, jaccard_rtree, robust_quality

NAMES = ["_id", "_hash", "_OTHER", "n", "h", "_text"]


def docs(spark):
    good = " ".join(f"word{k} and more" for k in range(40))
    rows = [(i, good if i < 3 else f"{good} own{i} " * 2 + f"tail{i}", "en", "web", i * 7, i, i, i, i, i) for i in range(8)]
    rows += [(8, rows[7][1], "en", "web", 1, 2, 3, 4, 5, 6), (8, rows[7][1], "en", "web", 1, 2, 3, 4, 5, 6)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} long" for c in NAMES))


def held(df, left):
    assert left.columns == df.columns
    rows = {tuple(r) for r in df.collect()}
    got = [tuple(r) for r in left.collect()]
    assert got and set(got) <= rows
    return got


def test_near_duplicates(spark):
    df = docs(spark)
    got = held(df, jaccard_rtree.keep_first(df))
    assert len({r[0] for r in got}) == len(got) and 0 in {r[0] for r in got} and not {1, 2, 8} & {r[0] for r in got}


def test_decontamination(spark):
    df = docs(spark)
    item = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog near the old river bank")], "item_id long, text string")
    assert len(held(df, decontam.keep_clean(df, item))) == 10


def test_quality_rules(spark):
    df = docs(spark)
    held(df, robust_quality.keep_good(df, min_group=3))
