"""Language-model scoring with a sharded Elias-Fano n-gram trie.

The model is a word trigram model with hierarchical Dirichlet smoothing: with
c the count of a context and m a constant of its order,

    p(w | u v) = c(u v w) / (c(u v) + m3) + m3 / (c(u v) + m3) * p(w | v)
    p(w | v)   = c(v w) / (c(v) + m2)     + m2 / (c(v) + m2)   * p(w)
    p(w)       = (c(w) + 1) / (N + V + 1)

over lower-cased words and one end for each text; before a text stands an end,
and its first word has no trigram. The first terms and the weights left to the
lower order are quantised and kept in a trie by word, next word and third word
(``elias_fano.Trie``), whose levels and pointers are Elias-Fano sequences.

Nothing of the corpus's size is broadcast or held whole. Vocabulary and trie are
cut into shards, whose number follows the bytes of text: words by their hash,
pairs with all their followers by the first word's, and where that is hot
(``HOT``) by the second word's too. Texts are read once and become
blocks of numbered words of about ``BLOCK`` tokens, tables of packed arrays:

1. each block sends its distinct words with training counts to the vocabulary's
   shards, which answer with numbers and total counts;
2. each block sends its distinct pairs and triples, itself a small trie, to the
   trie's shards; a shard adds the counts up, builds its trie, and answers every
   block's list by searching the trie;
3. each block scores its texts from the answers.

A block sends a pair once, however often it occurs, so hot words, pairs and
passages are added up before they are sent. A shard holds the lists sent to it.

Lists and answers are many times as large as the tables kept of them, so each
step's shuffle files are dropped when the step has been written.

``train`` keeps the shards as tables and ``score`` searches them for other texts;
``score_held_out`` does both at once, so that lists are sent only once.

Defined results: null texts are empty; an empty text has its end only. Repeated
and null ids are rows of their own. Without training texts every word has
probability one.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesframe.llm.common import read, shared, shuffles_dropped, text_of
from seriesframe.llm.elias_fano import Trie, build, restored

#: Constants of the smoothing by order.
M2, M3 = 2000.0, 4.0
BLOCK = 1_500_000
SHARD_BYTES = 8 << 20
#: Occurrences of a first word for each shard that its pairs are dealt to.
HOT = 1 << 19
END = b""
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Rows that travel: the block, the shard, and packed arrays. Block -1 is a shard's own part of the model.
ROW = "block long, shard int, data array<binary>"
_ROW = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("data", pa.list_(pa.binary()))])


def _zip(data: bytes) -> bytes:
    return zstandard.compress(data, 3)


def pack(a: np.ndarray) -> bytes:
    """Non-negative integers as compressed planes of bytes."""
    width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    return bytes([width]) + _zip(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :data[0]] = planes.T
    return out.view("<i8").ravel()


def _rows(rows):
    """Record batches of (block, shard, data) rows, a few at a time."""
    for part in iter(lambda: [r for _, r in zip(range(16), rows)], []):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), _ROW)], schema=_ROW)


def _each(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            yield [c[k].as_py() for c in batch.columns]


class Block:
    """Texts as numbers of the block's own words."""

    def __init__(self):
        self.seen: dict = {}
        self.tokens, self.lengths, self.ids, self.held = [], [], [], []

    def add(self, doc_id, text: str, held: bool):
        words = text.encode().lower().split()  # bytes: A-Z and the six ASCII separators only
        words.append(END)
        seen = self.seen
        self.tokens.extend([seen.setdefault(w, len(seen)) for w in words])
        self.lengths.append(len(words))
        self.ids.append(doc_id)
        self.held.append(held)

    def rows(self, name: int, shards: int):
        """The numbered texts, and the block's words for each shard of the vocabulary."""
        words = list(self.seen)
        place = np.array([zlib.crc32(w) % shards for w in words], np.int64)
        order = np.argsort(place, kind="stable")
        number = np.empty(len(words), np.int64)
        number[order] = np.arange(len(words))
        tokens, lengths = number[np.array(self.tokens, np.int64)], np.array(self.lengths, np.int64)
        train = np.repeat(~np.array(self.held, bool), lengths)
        counts = np.bincount(tokens[train], minlength=len(words))
        # texts travel as places in the order of frequency, whose bytes pack best
        common = np.argsort(-np.bincount(tokens, minlength=len(words)), kind="stable")
        at = np.empty(len(words), np.int64)
        at[common] = np.arange(len(words))
        yield name, -1, [pack(lengths), pack(common), pack(at[tokens])], self.ids, self.held
        edges = np.searchsorted(place[order], np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(edges)).tolist():
            own = slice(edges[s], edges[s + 1])
            yield name, s, [_zip(b"\n".join([words[k] for k in order[own].tolist()])), pack(counts[own])], None, None


def blocks(docs: DataFrame, shards: int, size: int = BLOCK) -> DataFrame:
    """Blocks (shard -1) and their words by shard, of (doc_id, text, held_out)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches):
        part, at, block, ids = TaskContext.get().partitionId() << 32, 0, Block(), pa.null()

        def rows():
            for k, r in enumerate(block.rows(part + at, shards)):
                yield pa.RecordBatch.from_arrays([
                    *[pa.array([v], f.type) for v, f in zip(r[:3], _ROW)], pa.array([r[3]], pa.list_(ids)), pa.array([r[4]], pa.list_(pa.bool_()))],
                    names=[*_ROW.names, "ids", "held"])

        for batch in batches:
            ids = batch.schema.field(0).type
            for row in zip(*batch.columns):
                block.add(*(c.as_py() for c in row))
                if len(block.tokens) >= size:
                    yield from rows()
                    block, at = Block(), at + 1
        if block.lengths:
            yield from rows()

    return docs.select("doc_id", "text", "held_out").mapInArrow(work, f"{ROW}, ids array<{kind}>, held array<boolean>")


def _dealt(rows: DataFrame, by: str, parts: int) -> DataFrame:
    other = "shard" if by == "block" else "block"
    return rows.repartition(max(1, parts), by).sortWithinPartitions(by, *(["kind"] if "kind" in rows.columns else []), other)


def vocabulary(words: DataFrame, shards: int, model: DataFrame | None = None, keep: bool = False) -> DataFrame:
    """Numbers and training counts of the words that blocks ask for, by block and shard.

    Numbers start at 1 with each shard's commonest word; 0 is a word not in
    training. Rows of block -1 hold a shard's size and total, and with ``keep``
    its words with their numbers and counts. With ``model`` (such rows) nothing
    is counted.
    """
    asked = words.select(_ROW.names)
    asked = asked if model is None else model.unionByName(asked)

    def work(batches):
        def rows():
            for shard, group in groupby(_each(batches), key=lambda r: r[1]):
                held, known = [], None
                total: dict = {}
                for block, _, data in group:
                    if block < 0:
                        own = zstandard.decompress(data[1]).split(b"\n")
                        known = dict(zip(own, zip(unpack(data[2]).tolist(), unpack(data[3]).tolist())))
                        continue
                    held.append((block, data))
                    if known is None:
                        for w, c in zip(zstandard.decompress(data[0]).split(b"\n"), unpack(data[1]).tolist()):
                            total[w] = total.get(w, 0) + c
                if known is None:
                    ranked = sorted((w for w, c in total.items() if c), key=lambda w: (-total[w], w))
                    known = {w: (1 + shard + k * shards, total[w]) for k, w in enumerate(ranked)}
                    size = pack(np.array([len(known), sum(c for _, c in known.values())]))
                    rest = [_zip(b"\n".join(known)), *map(pack, np.array(list(known.values()), np.int64).reshape(-1, 2).T)] if keep and known else []
                    yield -1, shard, [size, *rest]
                for block, data in held:
                    got = np.array([known.get(w, (0, 0)) for w in zstandard.decompress(data[0]).split(b"\n")], np.int64)
                    yield block, shard, [pack(got[:, 0]), pack(got[:, 1])]

        return _rows(rows())

    return _dealt(asked, "shard", shards).mapInArrow(work, ROW)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * _MIX
    return (x ^ (x >> np.uint64(29))) * _MIX


class Grams:
    """Distinct pairs and triples of known words of one block, as a trie by shard."""

    def __init__(self, lengths, tokens, ids, counts, train, shards: int):
        names, rank = np.unique(ids, return_inverse=True)
        self.names, k = names, len(names)
        word = rank[tokens]
        first = np.cumsum(lengths) - lengths
        end = word[first[0] + lengths[0] - 1]
        before = np.concatenate([word[:1], word[:-1]])
        before[first] = end
        self.count = counts[tokens]
        count_of = np.zeros(k, np.int64)
        count_of[rank] = counts
        count_of[names == 0] = 0
        self.before_count = count_of[before]
        later = np.ones(len(word), bool)
        later[first] = False
        self.later = np.flatnonzero(later)
        pairs, self.pair = np.unique(before * k + word, return_inverse=True)
        triples, self.triple = np.unique(self.pair[self.later - 1] * k + word[self.later], return_inverse=True)
        a, b = names[pairs // k], names[pairs % k]
        self.first_count = count_of[pairs // k]
        # a first word's pairs go to one shard, those of a hot one to several, by the second word
        spread = _mixed(b) % (1 + self.first_count // HOT).astype(np.uint64)
        mixed = _mixed(a.astype(np.uint64) ^ (spread << np.uint64(40)))
        # a pair or triple with an unknown word is in no trie; its shard is none
        home = np.where((a > 0) & (b > 0), ((mixed >> np.uint64(33)) % np.uint64(shards)).astype(np.int64), shards)
        context, third = triples // k, names[triples % k]
        third_home = np.where(third > 0, home[context], shards)
        self.pairs = np.argsort(home, kind="stable")
        self.triples = np.argsort(third_home, kind="stable")
        self.pair_edges = np.searchsorted(home[self.pairs], np.arange(shards + 1))
        self.triple_edges = np.searchsorted(third_home[self.triples], np.arange(shards + 1))
        self.a, self.b, self.context, self.third = a, b, context, third
        self.pair_counts = np.bincount(self.pair[train], minlength=len(pairs))
        self.triple_counts = np.bincount(self.triple[train[self.later]], minlength=len(triples))

    def lists(self):
        """(shard, packed levels) for every shard with a pair."""
        for s in np.flatnonzero(np.diff(self.pair_edges)).tolist():
            p, t = self.pairs[self.pair_edges[s]:self.pair_edges[s + 1]], self.triples[self.triple_edges[s]:self.triple_edges[s + 1]]
            a = self.a[p]
            at = np.flatnonzero(np.concatenate([np.ones(1, bool), a[1:] != a[:-1]]))
            n_second = np.diff(np.append(at, len(a)))
            n_third = np.bincount(np.searchsorted(p, self.context[t]), minlength=len(p))
            yield s, [pack(x) for x in (_steps(a[at], at[:1] * 0), self.first_count[p][at], n_second, _steps(self.b[p], at), self.pair_counts[p],
                                        n_third, _steps(self.third[t], _starts(n_third)), self.triple_counts[t])]


def _starts(n: np.ndarray) -> np.ndarray:
    return (np.cumsum(n) - n)[n > 0]


def _steps(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ascending ids as differences, each parent's first id whole."""
    out = np.diff(ids, prepend=0)
    out[starts] = ids[starts]
    return out


def _whole(steps: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Undo ``_steps`` for children of n nodes."""
    total = np.cumsum(steps)
    starts = _starts(n)
    return total - np.repeat(total[starts] - steps[starts], n[n > 0])


class Query:
    """Levels of one block's list for one shard."""

    def __init__(self, data: list[bytes]):
        first, self.first_count, n_second, second, self.pair_counts, n_third, third, self.triple_counts = map(unpack, data)
        self.first = np.cumsum(first)
        self.second, self.third = _whole(second, n_second), _whole(third, n_third)
        self.parent_second = np.repeat(np.arange(len(self.first)), n_second)
        self.parent_third = np.repeat(np.arange(len(self.second)), n_third)

    def answer(self, trie: Trie) -> list[bytes]:
        return [pack(c) for c in trie.search(self.first, self.second, self.parent_second, self.third, self.parent_third)]


def _summed(keys: list, counts: list, width: int):
    """Distinct (parent, id) with a positive total, as parents, ids, totals; and the place of every input row among them."""
    key = np.concatenate([p * width + i for p, i in keys])
    distinct, at = np.unique(key, return_inverse=True)
    total = np.bincount(at, np.concatenate(counts), len(distinct)).astype(np.int64)
    live = total > 0
    at = np.where(live, np.cumsum(live) - 1, -1)[at]
    return distinct[live] // width, distinct[live] % width, total[live], at


def merged_trie(lists: list[Query], m2: float = M2, m3: float = M3) -> bytes:
    """The trie of all training counts in the blocks' lists."""
    ids = np.unique(np.concatenate([x for q in lists for x in (q.first, q.second, q.third)]))
    k, rank = len(ids), lambda x: np.searchsorted(ids, x)
    first_count = np.zeros(k, np.int64)
    for q in lists:
        first_count[rank(q.first)] = q.first_count
    a, b, pair_total, at = _summed([(rank(q.first)[q.parent_second], rank(q.second)) for q in lists], [q.pair_counts for q in lists], k)
    edges = np.cumsum([0, *(len(q.second) for q in lists)])
    parents = [at[edges[n] + q.parent_third] for n, q in enumerate(lists)]
    keys = [(p[p >= 0], rank(q.third)[p >= 0]) for p, q in zip(parents, lists)]
    context, c, triple_total, _ = _summed(keys, [q.triple_counts[p >= 0] for p, q in zip(parents, lists)], k)
    first, n_second = np.unique(a, return_counts=True)
    return build(ids[first], n_second, ids[b], pair_total / (first_count[a] + m2), m3 / (pair_total + m3),
                 np.bincount(context, minlength=len(a)), ids[c], triple_total / (pair_total[context] + m3))


def tries(lists: DataFrame, shards: int, model: DataFrame | None = None, keep: bool = False, answers: bool = True, m2: float = M2, m3: float = M3) -> DataFrame:
    """Answers to the blocks' lists, by block and shard; with ``keep`` also each shard's trie (block -1)."""
    asked = lists if model is None else model.unionByName(lists)

    def work(batches):
        def rows():
            for shard, group in groupby(_each(batches), key=lambda r: r[1]):
                buffer, held = None, []
                for block, _, data in group:
                    if block < 0:
                        buffer = data[0]
                    else:
                        held.append((block, Query(data)))
                if buffer is None:
                    buffer = merged_trie([q for _, q in held], m2, m3)
                    if keep:
                        yield -1, shard, [buffer]
                if answers:
                    trie = Trie(buffer)
                    for block, q in held:
                        yield block, shard, q.answer(trie)

        return _rows(rows())

    return _dealt(asked, "shard", shards).mapInArrow(work, ROW)


def _numbered(rows):
    """Each block's name, ids, held, lengths, tokens, word numbers and counts, and the trie's answers, from rows in order of kind and shard."""
    for block, group in groupby(rows, key=lambda r: r[0]):
        texts, words, answers = None, [], []
        for _, shard, kind, data, ids, held in group:
            if kind == 0:
                texts = ids, held, unpack(data[0]), unpack(data[1])[unpack(data[2])]
            else:
                (words if kind == 1 else answers).append((shard, [unpack(d) for d in data]))
        yield (block, *texts, *(np.concatenate([d[k] for _, d in words]) for k in (0, 1)), answers)


def _joined(made: DataFrame, words: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """Blocks with the answers that belong to them, one after the other."""
    none = [F.lit(None).cast(made.schema[c].dataType).alias(c) for c in ("ids", "held")]
    rows = made.where("shard < 0").select("block", "shard", F.lit(0).alias("kind"), "data", "ids", "held")
    for kind, table in enumerate((words, answers), 1):
        if table is not None:
            rows = rows.union(table.where("block >= 0").select("block", "shard", F.lit(kind), "data", *none))
    return rows


def grams(joined: DataFrame, shards: int, n_blocks: int) -> DataFrame:
    """The blocks' lists by shard of the trie."""

    def work(batches):
        def rows():
            for block, _, held, lengths, tokens, ids, counts, _ in _numbered(_each(batches)):
                train = np.repeat(~np.array(held, bool), lengths)
                for shard, data in Grams(lengths, tokens, ids, counts, train, shards).lists():
                    yield block, shard, data

        return _rows(rows())

    return _dealt(joined, "block", n_blocks).mapInArrow(work, ROW)


def scores(joined: DataFrame, shards: int, n_blocks: int, tokens_all: int, words_all: int, kind: str, m2: float = M2) -> DataFrame:
    """A row for every text of the blocks."""
    schema = pa.schema([("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def work(batches):
        ids_type = None

        def seen():
            nonlocal ids_type
            for batch in batches:
                ids_type = batch.schema.field("ids").type.value_type
                yield batch

        for _, doc_ids, held, lengths, tokens, ids, counts, answers in _numbered(_each(seen())):
            g = Grams(lengths, tokens, ids, counts, np.zeros(len(tokens), bool), shards)
            p_pair, rest, p_triple = np.zeros(len(g.a)), np.ones(len(g.a)), np.zeros(len(g.third))
            for s, (two, left, three) in answers:
                p, t = g.pairs[g.pair_edges[s]:g.pair_edges[s + 1]], g.triples[g.triple_edges[s]:g.triple_edges[s + 1]]
                p_pair[p], p_triple[t] = restored(two), restored(three)
                rest[p] = np.where(left > 0, restored(left), 1.0)
            single = (g.count + 1.0) / (tokens_all + words_all + 1.0)
            p = p_pair[g.pair] + m2 / (g.before_count + m2) * single
            p[g.later] = p_triple[g.triple] + rest[g.pair[g.later - 1]] * p[g.later]
            first = np.cumsum(lengths) - lengths
            add = lambda x: np.add.reduceat(x, first)
            cols = [held, lengths, add((g.count > 0).astype(np.int64)), add(np.log10(single)), add(np.log10(p))]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, ids_type), *[pa.array(c, f.type) for c, f in zip(cols, schema)]], names=["doc_id", *schema.names])

    out = _dealt(joined, "block", n_blocks).mapInArrow(work, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens_all).cast("long").alias("train_tokens"), "base_score", "score")


@dataclass
class Model:
    """Shards of the vocabulary and of the trie, with the number of training tokens and of distinct ones."""

    words: DataFrame
    tries: DataFrame
    shards: int
    tokens: int
    distinct: int
    m2: float


def _numbers(docs: DataFrame, shards: int, block: int, model: Model | None = None, keep: bool = False):
    made = shared(blocks(docs, shards, block), "lm-blocks")
    words = shared(vocabulary(made.where("shard >= 0"), shards, model.words if model else None, keep), "lm-words")
    return made, words, made.where("shard < 0").count()


def _total(words: DataFrame) -> tuple[int, int]:
    """Training tokens and distinct ones: sums over the vocabulary's shards."""
    sizes = words.where("block < 0").select(F.col("data")[0].alias("size"))
    schema = pa.schema([("v", pa.int64()), ("n", pa.int64())])

    def work(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.array([unpack(x.as_py()) for x in batch.column(0)]).T], schema=schema)

    got = sizes.mapInArrow(work, "v long, n long").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    return got.n or 0, got.v or 0


def _shards(docs: DataFrame, shard_bytes: int) -> int:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-size // shard_bytes))


def _texts(docs: DataFrame, held_out) -> DataFrame:
    return docs.select(F.col("doc_id"), text_of("text").alias("text"), held_out.alias("held_out"))


def train(docs: DataFrame, shard_bytes: int = SHARD_BYTES, block: int = BLOCK, m2: float = M2, m3: float = M3) -> Model:
    """A model of all texts of ``docs`` (doc_id, text)."""
    docs = _texts(docs, F.lit(False))
    with shuffles_dropped(docs.sparkSession):
        shards = _shards(docs, shard_bytes)
        made, words, n = _numbers(docs, shards, block, keep=True)
        kept = shared(tries(grams(_joined(made, words), shards, n), shards, keep=True, answers=False, m2=m2, m3=m3), "lm-tries")
        return Model(words.where("block < 0"), kept, shards, *_total(words), m2)


def score(docs: DataFrame, model: Model, block: int = BLOCK) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of each text under ``model``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    with shuffles_dropped(docs.sparkSession):
        made, words, n = _numbers(_texts(docs, F.lit(True)), model.shards, block, model)
        answers = shared(tries(grams(_joined(made, words), model.shards, n), model.shards, model.tries), "lm-answers")
    return scores(_joined(made, words, answers), model.shards, n, model.tokens, model.distinct, kind, model.m2).drop("held_out")


def score_held_out(docs: DataFrame, held_out, shard_bytes: int = SHARD_BYTES, block: int = BLOCK, m2: float = M2, m3: float = M3) -> DataFrame:
    """Scores of all texts under a model of those for which ``held_out`` (a column) is false."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = _texts(docs, held_out)
    with shuffles_dropped(docs.sparkSession):
        shards = _shards(docs, shard_bytes)
        made, words, n = _numbers(docs, shards, block)
        answers = shared(tries(grams(_joined(made, words), shards, n), shards, m2=m2, m3=m3), "lm-answers")
        tokens, distinct = _total(words)
    return scores(_joined(made, words, answers), shards, n, tokens, distinct, kind, m2)


def query(spark, sf_dir: str) -> DataFrame:
    number = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return score_held_out(read(spark, sf_dir, "documents"), number % 7 == 2)
