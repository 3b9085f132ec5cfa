from pyspark.sql import functions as F

from seriesframe.llm import url_cascade as U


def keys(spark, listed, unlisted):
    rows = [(f"in{i}", True) for i in range(listed)] + [(f"out{i}", False) for i in range(unlisted)]
    return spark.createDataFrame(rows or [], "k string, l boolean")


def check(spark, listed, unlisted, **options):
    uni = keys(spark, listed, unlisted)
    c = U.build(uni, "k", "l", **options)
    got = c.mark(uni.unionByName(uni), F.col("k"))
    assert got.count() == 2 * (listed + unlisted)
    assert got.where("listed != l").count() == 0
    return c


def test_exact_membership(spark):
    c = check(spark, 300, 5000, bits_per_key=4)
    assert len(c.levels) > 2 and c.shards == 1
    assert not [w for w in [c.mark(keys(spark, 3, 3), F.col("k"))._jdf.queryExecution().executedPlan().toString()] if "HashJoin" in w]


def test_shards_beyond_the_bound(spark):
    c = check(spark, 500, 2000, max_bytes=128)
    assert c.shards > 3


def test_empty_lists_and_universes(spark):
    check(spark, 0, 50)
    check(spark, 50, 0)
    c = U.build(keys(spark, 0, 0), "k", "l")
    assert c.levels == []


def test_judge_edge_cases(spark):
    rows = [
        (1, "https://WWW.Example.com/en/x?q", 0), (2, "https://a.example.com/en/", 0), (3, "http://x.net/es/1#t", 0),
        (4, "http://x.net/de/1", 0), (5, "http://y.net/de/1", 0), (6, None, 0), (7, "no scheme", 0), (8, "http://x.com", 0),
        (9, "a://b://c/d", 0), (9, "a://b://c/d", 0), (None, "", 0), (10, "http://notnet/es/", 0), (11, "http://net/es/", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(pages).collect()}
    assert got[1] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[2] == ("a.example.com", "/en/", "example.com/en/", "block")
    assert got[3] == ("x.net", "/es/1", "net/es/", "block")
    assert got[4] == ("x.net", "/de/1", None, "block")  # the host is listed by page 3
    assert got[5] == ("y.net", "/de/1", None, "allow")
    assert got[6] == got[7] == got[None] == ("", "", None, "allow")
    assert got[8] == ("x.com", "", None, "allow")
    assert got[9] == ("b:", "//c/d", None, "allow")
    assert got[10][2] is None and got[11][2] == "net/es/"
    assert U.judge(pages).count() == len(rows)
    assert U.judge(pages.limit(0)).count() == 0
