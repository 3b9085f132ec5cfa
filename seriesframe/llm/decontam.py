"""Benchmark decontamination by template windows.

Texts become sequences of template tokens: numbers, units after a number and
names (capitalised words inside a sentence) are typed placeholders, all other
words are lower-cased literals. Windows of ``WINDOW`` tokens, at least half of
them literals, are hashed and hash-joined between documents and benchmark
items; where the first word of a window could be a name, it is read both ways.
Windows that lie on one alignment of a document with an item must be
slot-consistent: each slot value of the item stands for one value throughout.
Windows with at least one word are also joined word for word, whatever their
share of slots. An item leaks where ``LEAST`` windows (or all that it has) of
either sort match on one alignment; it is re-parameterised where a slot's value
differs.

Documents are read once. A bit map of ``BITS`` bits over the benchmark's
window hashes, whose size never grows, turns most windows away before the join;
with a huge benchmark it fills up and the join does the work. Windows of one
document and item meet in a group of at most as many rows as the item has
windows and the document copies of it.

Defined results: null texts have no tokens. Items with fewer tokens than a
window are one window as a whole; below ``SHORTEST`` tokens it matches word for
word only. Items of numbers and signs alone have no windows. Repeated documents and items count once. Null ids are
ids of their own.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesframe.llm.common import free, read, shared, text_of

WINDOW = 10
SHORTEST = 6
VERBATIM = 64  # more than a window, so that verbatim windows have hashes of their own
LEAST = 3
BITS = 1 << 22
#: Bytes of texts whose windows are hashed together.
CHUNK = 1 << 18
#: Words that are units when they follow a number.
UNITS = frozenset("""
mm cm m km in ft yd mi mg g kg t oz lb lbs ml cl l s min h hr hrs w kw kwh v hz khz mhz ghz kb mb gb tb mph
inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres
gram grams kilogram kilograms ounce ounces pound pounds ton tons liter liters litre litres gallon gallons
second seconds minute minutes hour hours day days week weeks month months year years
cent cents dollar dollars euro euros percent degree degrees
""".split())
TOKEN = re.compile(r"[.!?\n]+|\d+(?:[.,]\d+)*|[^\W\d_]+|[%$€£]").findall
LITERAL, NUMBER, NAME, UNIT, STOP, SIGN = range(6)
_MARK = np.array([0, 0x1F3D5B79, 0x2E4C6A88, 0x3D5B7997, 0, 0x3D5B7997], np.uint64)
_M1 = np.uint64(0x9E3779B97F4A7C15)


class Canon(dict):
    """Index of each raw token; ``hashes`` and ``kinds`` are by index."""

    def __init__(self):
        super().__init__()
        self.hashes = array("Q")
        self.kinds = array("b")

    def __missing__(self, token: str) -> int:
        c = token[0]
        if c in ".!?\n":
            kind = STOP
        elif c.isdigit():
            kind = NUMBER
        elif c in "%$€£":
            kind = SIGN
        elif token.lower() in UNITS:
            kind = UNIT
        else:
            kind = NAME if c.isupper() and (len(token) == 1 or token[1:].islower()) and len(token) > 1 else LITERAL
        self[token] = i = len(self.kinds)
        self.kinds.append(kind)
        self.hashes.append(xxhash.xxh3_64_intdigest(token.lower()))
        return i


def canonical(texts, canon: Canon):
    """Raw tokens of the texts, one after the other; places of those that are no stops, their hashes, which are slots,
    which could be but for their place, and the text of each."""
    raw, ends = [], []
    for text in texts:
        raw += TOKEN(text)
        raw.append("\n")  # a stop, so that no token is read after another text's
        ends.append(len(raw))
    if not raw:
        return raw, np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int8), np.empty(0, np.int8), np.empty(0, np.int64)
    index = np.fromiter(map(canon.__getitem__, raw), np.int64, len(raw))
    own = np.frombuffer(canon.kinds, np.int8)[index]
    before = np.concatenate([np.array([STOP], np.int8), own[:-1]])
    kinds = np.where(((own == NAME) & (before == STOP)) | ((own == UNIT) & (before != NUMBER)), np.int8(LITERAL), own)
    keep = np.flatnonzero(own != STOP)
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    return raw, keep, np.frombuffer(canon.hashes, np.uint64)[index[keep]], kinds[keep], own[keep], text[keep]


def windows(hashes: np.ndarray, size: int, seed: int, at=None, first=None):
    """Hash of each window of ``size`` tokens, or of those that begin ``at`` with ``first`` for their first tokens."""
    n = max(0, len(hashes) - size + 1)
    mixed = np.full(n if at is None else len(at), seed, np.uint64)
    shifted = np.empty_like(mixed)
    with np.errstate(over="ignore"):
        for k in range(size):
            mixed ^= hashes[k:k + n] if at is None else hashes[at + k] if k else first
            mixed *= _M1
            np.right_shift(mixed, np.uint64(31), out=shifted)
            mixed ^= shifted
    return mixed


def _counts(which: np.ndarray, size: int) -> np.ndarray:
    """Number of those in each window of ``size``."""
    sums = np.concatenate([np.zeros(1, np.int32), np.cumsum(which, dtype=np.int32)])
    return sums[size:] - sums[:-size]


def _chunks(column, most: int = CHUNK):
    """Stretches (from, to) of a column of texts with about ``most`` bytes, one text at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(sizes, most + (sizes[at - 1] if at else 0), side="right")))
        yield at, end
        at = end


_ROWS = pa.schema([("h", pa.int64()), ("id", pa.int64()), ("text_hash", pa.int64()), ("pos", pa.int32()), ("slots", pa.list_(pa.string())), ("windows", pa.int32()),
                   ("verbatim", pa.bool_()), ("other", pa.bool_())])


def _windows(texts: DataFrame, bitmap) -> DataFrame:
    """Rows of h, id, text_hash, pos, slots, windows, verbatim, other for the windows that ``bitmap`` lets through (None: all).

    ``other`` marks windows whose first word is read the other way.
    """

    def work(batches):
        canon = Canon()
        for batch in batches:
            for start, end in _chunks(batch.column(2)):
                keys, hashes, texts = (c.slice(start, end - start).to_pylist() for c in batch.columns)
                codes = canonical([t or "" for t in texts], canon)
                tokens = np.bincount(codes[-1], minlength=len(texts))
                rows = []
                # short items can lie inside a long document
                for size in {WINDOW, *bitmap.value[1]} if bitmap else set(np.minimum(tokens, WINDOW).tolist()) - {0}:
                    rows.extend(found(keys, hashes, tokens if bitmap is None else None, *codes, size))
                if len(canon) > 200_000:
                    canon = Canon()
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ROWS)], schema=_ROWS)

    def known(mixed):
        if bitmap is None:
            return np.ones(len(mixed), bool)
        low = (mixed & np.uint64(BITS - 1)).astype(np.int64)
        return ((bitmap.value[0][low >> 3] >> (low & 7).astype(np.uint8)) & 1).astype(bool)

    def found(keys, text_hashes, tokens, raw, keep, literal, kinds, own, text, size):
        """Rows for the windows of ``size`` tokens inside one text; with ``tokens``, of the texts for which this is the size."""
        n = max(0, len(keep) - size + 1)
        begin = text[:n]
        inside = begin == text[size - 1:]
        if tokens is not None:
            inside &= np.minimum(tokens, WINDOW)[begin] == size
        first_of = np.searchsorted(text, np.arange(len(keys)))
        mixed = windows(literal, size, size + VERBATIM)
        enough = inside & (_counts((own == LITERAL) | (own == NAME) | (own == UNIT), size) > 0)
        count = np.bincount(begin[enough], minlength=len(keys))
        for i in np.flatnonzero(enough & known(mixed)).tolist():
            d = begin[i]
            yield int(mixed[i].view(np.int64)), keys[d], text_hashes[d], int(i - first_of[d]), [], int(count[d]), True, False
        if size < SHORTEST:
            return
        hashes = np.where(kinds == LITERAL, literal, _MARK[kinds])
        literals = _counts(kinds == LITERAL, size)
        enough = inside & (2 * literals >= size)
        names = np.flatnonzero(inside & (own[:n] == NAME))
        if bitmap is None:
            names = names[names == first_of[begin[names]]]
        was = kinds[names] == LITERAL
        names, was = (x[2 * (literals[names] + np.where(was, -1, 1)) >= size] for x in (names, was))
        count = np.bincount(begin[enough], minlength=len(keys)) + np.bincount(begin[names[~enough[names]]], minlength=len(keys))

        def row(h, i, first, other):
            d = begin[i]
            slots = [f"{k}:{raw[t].lower()}" for k, t in zip((first, *kinds[i + 1:i + size]), keep[i:i + size]) if k != LITERAL]
            return int(h.view(np.int64)), keys[d], text_hashes[d], int(i - first_of[d]), slots, int(count[d]), False, other

        mixed = windows(hashes, size, size)
        for i in np.flatnonzero(enough & known(mixed)):
            yield row(mixed[i], i, kinds[i], False)
        if len(names):
            mixed = windows(hashes, size, size, names, np.where(was, _MARK[NAME], literal[names]))
            for k in np.flatnonzero(known(mixed)):
                yield row(mixed[k], names[k], NAME if was[k] else LITERAL, True)

    return texts.mapInArrow(work, "h long, id long, text_hash long, pos int, slots array<string>, windows int, verbatim boolean, other boolean")


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = LEAST) -> DataFrame:
    """A row for each document and item that leaks into it.

    Columns: doc_id, text_hash, item_id, matched (windows on the best
    alignment), windows (that the item has of that sort) and reparameterised.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), F.xxhash64("text").alias("text_hash"), text_of("text").alias("text")).distinct()
    bench = shared(_windows(items, None).select("h", F.col("id").alias("item_id"), F.col("text_hash").alias("item_hash"), F.col("pos").alias("item_pos"),
                                                F.col("slots").alias("item_slots"), F.col("windows"), F.col("verbatim"), F.col("other").alias("item_other")), "benchmark-windows")
    set_bits = bench.select(F.col("h").bitwiseAND(BITS - 1).alias("p")).distinct().collect()  # BITS at most
    bits = np.zeros(BITS >> 3, np.uint8)
    at = np.array([r.p for r in set_bits], np.int64)
    np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    sizes = items.mapInArrow(_short_sizes, "size int").distinct().collect()  # WINDOW at most
    bitmap = docs.sparkSession.sparkContext.broadcast((bits, [r["size"] for r in sizes]))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text_of("text")).alias("text_hash"), text_of("text").alias("text"))
    found = _windows(texts, bitmap).withColumnRenamed("id", "doc_id").drop("windows")
    return _aligned(found.join(bench, ["h", "verbatim"]), least)


def _short_sizes(batches):
    canon, found = Canon(), set()
    for batch in batches:
        texts = batch.column(2)
        for start, end in _chunks(texts):
            found.update(np.bincount(canonical([t or "" for t in texts.slice(start, end - start).to_pylist()], canon)[-1]).tolist())
    yield pa.RecordBatch.from_arrays([pa.array([s for s in found if 0 < s < WINDOW], pa.int32())], names=["size"])


def _aligned(pairs: DataFrame, least: int) -> DataFrame:
    slots = F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b"))
    key = ["doc_id", "text_hash", "item_id", "item_hash", "windows", "verbatim"]
    plain = ~F.col("other") & ~F.col("item_other")

    def seen(which):
        return F.struct(F.count_distinct(F.when(which, F.col("item_pos"))).alias("matched"), F.array_distinct(F.flatten(F.collect_set(F.when(which, slots)))).alias("slots"))

    by_place = pairs.withColumn("shift", F.col("pos") - F.col("item_pos")).groupBy(*key, "shift").agg(seen(plain).alias("plain"), seen(F.lit(True)).alias("all"))
    by_reading = by_place.select(*key, F.inline(F.array("plain", "all")))
    consistent = F.size(F.array_distinct(F.transform("slots", lambda s: s["a"]))) == F.size("slots")
    changed = F.exists("slots", lambda s: s["a"] != s["b"])
    good = by_reading.where(consistent & (F.col("matched") >= F.least(F.lit(least), F.col("windows"))))
    share = (F.col("matched") / F.col("windows")).alias("share")
    best = good.groupBy("doc_id", "text_hash", "item_id").agg(F.max(F.struct(share, "matched", "windows", (~changed).alias("same"))).alias("m"))
    return best.select("doc_id", "text_hash", "item_id", "m.matched", "m.windows", (~F.col("m.same")).alias("reparameterised"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those into which an item leaks."""
    own, text = free(docs, "_id"), free(docs, "_hash")
    bad = shared(leaks(docs, benchmark).select(F.col("doc_id").alias(own), F.col("text_hash").alias(text)).distinct(), "leaks")
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(own)) & (F.xxhash64(text_of("text")) == F.col(text)), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("text_hash")
