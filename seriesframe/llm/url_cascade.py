"""URL filter: path rules, then exact list membership by a Bloom filter cascade.

A cascade answers "is this key listed?" without a join and without errors, as
long as every key that will be asked is in the universe it was built over.
Level 1 is a Bloom filter of the listed keys. The unlisted keys it lets
through form level 2, the listed keys that level 2 lets through form level 3,
and so on until a level lets nothing through. A key's answer is the parity of
the first level that turns it away.

Everything runs as DataFrame expressions. The bits of a level are built by a
grouped ``bit_or`` (combined before the shuffle) and kept as arrays of longs.
One level holds at most ``max_bytes``; with more keys the cascade is sharded
by the key's hash. One shard is probed as a scalar subquery, so that pages are
only scanned; several shards are looked up by their number.

Defined results: null keys count as the empty key. Repeated keys count once,
and a key is listed where any of its rows is listed. An empty list lists
nothing. A key outside the universe gets an answer that may be wrong; the
query's universe is every host of the table it judges.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesframe.llm.common import UPPER, ascii_lower, read, shared

#: Fixed values of the query's contract: verdict, then host and path.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, URL, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """Text after the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def match_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls.

    Of rules of one length the first listed wins.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(reversed(rules), key=lambda r: len(r[1])):
        top, slash, rest = text.partition("/")
        top = top.translate(str.maketrans(UPPER, UPPER.lower()))
        fits = ((host == top) | host.endswith(f".{top}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


@dataclass
class Cascade:
    """Levels in order; each is (bits in a shard's filter, hash functions, table of shard and words)."""

    shards: int
    levels: list[tuple[int, int, DataFrame]]

    def mark(self, df: DataFrame, key: Column, out: str = "listed") -> DataFrame:
        """Add a boolean column: whether the key is listed."""
        hashed = df.withColumns(_hashes(key))
        answer = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            bits, k, table = self.levels[i]
            hashed, words = _attach(hashed, table, self.shards, f"_w{i}")
            answer = F.when(_hits(words, bits, k), answer).otherwise(F.lit(i % 2 == 1))
        return hashed.withColumn(out, answer).select(*df.columns, out)


def _hashes(key: Column) -> dict[str, Column]:
    key = F.coalesce(key, F.lit(""))
    return {"_h1": F.xxhash64(F.lit(1), key), "_h2": F.xxhash64(F.lit(2), key)}


def _shard(shards: int) -> Column:
    return F.pmod(F.shiftrightunsigned("_h2", 20), F.lit(shards))


def _positions(bits: int, k: int) -> list[Column]:
    return [F.pmod(F.col("_h1").bitwiseXOR(F.xxhash64(F.lit(i), F.col("_h2"))), F.lit(bits)) for i in range(k)]


def _hits(words: Column, bits: int, k: int) -> Column:
    hit = F.lit(True)
    for p in _positions(bits, k):
        hit = hit & (F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), p.bitwiseAND(63).cast("int")) == 1)
    return F.coalesce(hit, F.lit(False))


def _attach(df: DataFrame, table: DataFrame, shards: int, name: str) -> tuple[DataFrame, Column]:
    if shards == 1:
        return df, table.select("words").scalar()
    other = table.select(F.col("shard").alias("_s"), F.col("words").alias(name))
    return df.join(other, _shard(shards) == F.col("_s"), "left").drop("_s"), F.col(name)


def _level(members: DataFrame, shards: int, bits: int, k: int) -> DataFrame:
    """One row for each shard that has members: its filter as an array of longs."""
    set_bits = (members.select(_shard(shards).alias("shard"), F.explode(F.array(*_positions(bits, k))).alias("p"))
                .groupBy("shard", F.shiftright("p", 6).alias("word"))
                .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("v")))
    blank = members.sparkSession.range(bits // 64).select(
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))).alias("shard"),
        F.col("id").alias("word"), F.lit(0).cast("bigint").alias("v"))
    return (set_bits.unionByName(blank)
            .groupBy("shard", "word").agg(F.bit_or("v").alias("v"))
            .groupBy("shard").agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "v"))), lambda x: x["v"]).alias("words")))


def build(universe: DataFrame, key: str, listed: str, bits_per_key: int = 12, max_bytes: int = 4 << 20,
          max_levels: int = 64) -> Cascade:
    """Cascade over ``universe``: a row for each use of a key, ``listed`` says whether it is on the list.

    ``max_bytes`` bounds the filter that any task holds of a level.
    """
    keys = (universe.groupBy(F.coalesce(F.col(key), F.lit("")).alias("key"))
            .agg(F.max(F.coalesce(F.col(listed), F.lit(False))).alias("inside")))
    cur = shared(keys.select("inside", *[c.alias(n) for n, c in _hashes(F.col("key")).items()]), "cascade-keys")
    total = cur.agg(F.count_if("inside")).first()[0]
    shards = max(1, -(-total * bits_per_key // (max_bytes * 8)))
    levels: list[tuple[int, int, DataFrame]] = []
    while len(levels) < max_levels:
        most = cur.where("inside").groupBy(_shard(shards).alias("s")).count().agg(F.max("count")).first()[0]
        if not most:
            return Cascade(shards, levels)
        per_key = bits_per_key if not levels else max(6, bits_per_key // 2)
        bits = max(64, -(-most * per_key // 64) * 64)
        k = max(1, round(per_key * 0.69))
        table = shared(_level(cur.where("inside"), shards, bits, k), "cascade-level")
        levels.append((bits, k, table))
        probed, words = _attach(cur, table, shards, "_w")
        cur = shared(probed.where(F.col("inside") | _hits(words, bits, k))
                     .select((~F.col("inside")).alias("inside"), "_h1", "_h2"), "cascade-keys")
    raise RuntimeError(f"the cascade still lets keys through after {max_levels} levels")


def judge(pages: DataFrame, rules=RULES, **options) -> DataFrame:
    """Verdict for every url: the longest path rule's, else by the host list.

    The host list holds the hosts that serve a page which a rule blocks: the
    pages of such a host that no rule fits are blocked as well, all others are
    allowed. Null urls and urls without ``://`` have an empty host and path.
    """
    url = F.col("url")
    base = pages.select(F.col("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": rule, "by_rule": verdict})
    cascade = build(base.withColumn("on_list", F.col("by_rule").eqNullSafe("block")), "host", "on_list", **options)
    marked = cascade.mark(base, F.col("host"))
    method = F.when(F.col("listed"), "block").otherwise("allow")
    return marked.select("page_id", "host", "path", "rule", F.coalesce("by_rule", method).alias("verdict"))


def query(spark, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"))


SQL = r"""
WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') host,
  coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') path FROM pages),
r AS (SELECT *, CASE
  WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
  WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
  WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
  WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END rule FROM u),
v AS (SELECT *, CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END said FROM r)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN host IN (SELECT host FROM v WHERE said = 'block')
  THEN 'block' ELSE 'allow' END) verdict FROM v
"""
