"""Secret scan: fixed patterns, and a linear-chain conditional random field.

The patterns find assignments, access keys and hexadecimal runs. The field adds
what they miss: it tags every token of a text as the begin (B) or inside (I) of
a secret or as outside (O), from the token's shape and the shapes and known
words of its neighbours and from the file (how many assignments and
quotes it has), and the best tagging is found by Viterbi.

Training is by the patterns' own findings in at most ``TRAIN_DOCS`` documents,
chosen by a hash of their ids, at most ``TRAIN_WINDOWS`` windows from each; the
log-likelihood is maximised by full-batch gradient steps on the driver, where
the windows are feature numbers. Weights are a few hundred kilobytes.

Decoding is exact. A token whose O score leads by more than any two transitions
can make good is O in every best path; Viterbi runs on the stretches between
such tokens, with O on either side. Whole texts are read, in Arrow batches.

Defined results: null and empty texts have no spans. Found spans that lie
inside a pattern's span, or are shorter than ``SHORTEST`` characters, are not
added; one that reaches further is.
Repeated rows are all returned. Without training documents the field adds
nothing.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesframe.llm.common import read, text_of

#: Fixed values of the query's contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A).finditer
ACCESS = re.compile(r"AKIA[A-Z0-9]+").finditer
HEX = re.compile(r"[0-9a-f]{32,}").finditer  # runs of fewer characters fail in any case
KINDS = ("assign", "access", "hex", "crf")

TRAIN_DOCS, TRAIN_WINDOWS, REACH = 4000, 4, 12
SHORTEST = 8
BITS = 12
OFFSETS = (-2, -1, 0, 1)
PER_TOKEN = 4
B, I, O = range(3)
TOKEN = re.compile(r"[\w+/.\-]+|[^\w\s]")
KEYWORDS = frozenset("password passwd secret token api apikey api_key key access credential credentials auth bearer authorization private pwd pass".split())


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans (kind, start, end) of the patterns; matches that are too short are dropped after matching."""
    out = [(0, *m.span()) for m in ASSIGN(text) if len(m[2]) >= 8]
    out += [(1, *m.span()) for m in ACCESS(text) if m.end() - m.start() >= 16]
    return out + [(2, *m.span()) for m in HEX(text)]


def _values(text: str) -> list[tuple[int, int]]:
    return [m.span(2) for m in ASSIGN(text) if len(m[2]) >= 8] + [m.span() for m in ACCESS(text) if m.end() - m.start() >= 16] + [m.span() for m in HEX(text)]


def shape(token: str) -> str:
    """Classes of the characters, runs as one: ``Ab9-`` is ``Aa0-``."""
    out = []
    for c in token:
        k = "0" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else "x" if c.isalpha() else c
        if not out or out[-1] != k:
            out.append(k)
            if len(out) == 8:
                break
    return "".join(out)


def features(token: str) -> list[int]:
    """``PER_TOKEN`` feature numbers: known word, shape, length with shape class, mixture."""
    n = len(token)
    if token.isalpha():
        kind = "l" if token.islower() else "u" if token.isupper() else "c" if token[1:].islower() else "m"
        digits = 0
        form = kind
    else:
        digits = sum(map(str.isdigit, token))
        form = shape(token)
        kind = "p" if n == 1 else "n" if digits == n else "d" if digits else "o"
    word = token.lower() if token.lower() in KEYWORDS or n == 1 else "-"
    changes = min(8, len(form))
    names = (f"w{word}", f"s{form}", f"l{kind}{min(n // 4, 12)}", f"m{kind}{min(4, 5 * digits // max(1, n))}{changes}{min(n // 8, 4)}")
    return [xxhash.xxh3_64_intdigest(x) & ((1 << BITS) - 1) for x in names]


def file_feature(text: str) -> int:
    n = len(text) + 1
    return min(3, text.count("=") * 2000 // n) * 4 + min(3, text.count('"') * 1000 // n)


FILES = 16


class Field:
    """Weights by offset, feature number and tag; by file feature and tag; transitions from tag to tag."""

    def __init__(self, weights, files, steps):
        self.weights, self.files, self.steps = weights, files, steps
        self.spread = 2 * float(steps.max() - steps.min())
        self.cache: dict = {}
        self.table: list = []

    def rows(self, tokens: list[str]) -> np.ndarray:
        """For each token its row in ``table``: scores by offset and tag."""
        find, out = self.cache.get, np.empty(len(tokens), np.int64)
        for k, t in enumerate(tokens):
            i = find(t)
            if i is None:
                key = tuple(features(t))
                i = find(key)
                if i is None:
                    i = self.cache[key] = len(self.table)
                    self.table.append(self.weights[:, list(key), :].sum(1))
                self.cache[t] = i
            out[k] = i
        return out

    def scores(self, tokens: list[str], file: int) -> np.ndarray:
        rows = self.rows(tokens)
        n = len(rows)
        by = np.array([self.table[i] for i in rows]) if n < 64 else self._gather(rows)
        out = np.broadcast_to(self.files[file], (n, 3)).copy()
        for k, off in enumerate(OFFSETS):
            lo, hi = max(0, -off), min(n, n - off)
            if lo < hi:
                out[lo:hi] += by[lo + off:hi + off, k]
        return out

    def _gather(self, rows):
        some, back = np.unique(rows, return_inverse=True)
        return np.array([self.table[i] for i in some])[back]

    def tag(self, tokens: list[str], file: int) -> np.ndarray:
        """The best tags."""
        n = len(tokens)
        out = np.full(n, O, np.int8)
        if not n:
            return out
        s = self.scores(tokens, file)
        unsure = np.flatnonzero(s[:, O] - np.maximum(s[:, B], s[:, I]) <= self.spread)
        if len(unsure):
            cuts = np.flatnonzero(np.diff(unsure) > 1) + 1
            for part in np.split(unsure, cuts):
                a, b = int(part[0]), int(part[-1]) + 1
                out[a:b] = viterbi(s[a:b], self.steps, a > 0, b < n)
        return out

    def shrink(self):
        if len(self.cache) > 400_000:
            self.cache, self.table = {}, []


def viterbi(scores: np.ndarray, steps: np.ndarray, after_o: bool, before_o: bool) -> np.ndarray:
    """Best tags of a stretch; O stands before and after it where said."""
    best = scores[0] + (steps[O] if after_o else 0)
    back = np.empty((len(scores), 3), np.int8)
    for t in range(1, len(scores)):
        all_ways = best[:, None] + steps
        back[t] = all_ways.argmax(0)
        best = all_ways.max(0) + scores[t]
    out = np.empty(len(scores), np.int8)
    out[-1] = (best + (steps[:, O] if before_o else 0)).argmax()
    for t in range(len(scores) - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


def _train_windows(batches):
    """Feature numbers and tags of windows around what the patterns found, and of one other place."""
    width = 2 * REACH + 1
    for batch in batches:
        rows = []
        for text in batch.column(0).to_pylist():
            tokens = [m.span() for m in TOKEN.finditer(text)]
            starts = np.array([a for a, _ in tokens], np.int64)
            tags = np.full(len(tokens), O, np.int8)
            hits = []
            for a, b in _values(text):
                lo, hi = np.searchsorted(starts, [a, b])
                lo = max(0, lo - 1) if lo and tokens[lo - 1][1] > a else lo
                if lo < hi:
                    tags[lo], tags[lo + 1:hi] = B, I
                    hits.append(lo)
            where = hits[:TRAIN_WINDOWS] + ([len(text) % len(tokens)] if tokens else [])
            for at in where:
                lo = max(0, at - REACH - 2)
                hi = min(len(tokens), lo + width)
                x = [f for a, b in tokens[lo:hi] for f in features(text[a:b])]
                rows.append((x, tags[lo:hi].tolist(), file_feature(text)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.list_(pa.int32()), pa.list_(pa.int8()), pa.int32()))], names=["x", "y", "file"])


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS, rounds: int = 80, rate: float = 0.3, decay: float = 2e-4) -> Field:
    """Fit the field to windows from about ``train_docs`` documents of ``docs`` (doc_id, text)."""
    step = max(1, docs.count() // max(1, train_docs))
    chosen = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0).select(text_of("text").alias("text"))
    got = chosen.mapInArrow(_train_windows, "x array<int>, y array<byte>, file int").collect()
    got = sorted([tuple(r) for r in got])[: 8 * train_docs]  # a bound where ids repeat
    weights, files, steps = np.zeros((len(OFFSETS), 1 << BITS, 3)), np.zeros((FILES, 3)), np.zeros((3, 3))
    files[:, O] = 5.0
    if any(t != O for r in got for t in r[1]):
        weights, files, steps = _fit(got, rounds, rate, decay)
    return Field(weights.astype(np.float32), files.astype(np.float32), steps.astype(np.float32))


def _fit(got, rounds, rate, decay):
    n, width = len(got), max(len(r[1]) for r in got)
    none = 1 << BITS
    x = np.full((n, width, PER_TOKEN), none, np.int64)
    y, live = np.full((n, width), O), np.zeros((n, width), bool)
    file = np.array([r[2] for r in got])
    for i, (f, t, _) in enumerate(got):
        x[i, :len(t)] = np.array(f).reshape(-1, PER_TOKEN)
        y[i, :len(t)], live[i, :len(t)] = t, True
    at = np.full((len(OFFSETS), n, width, PER_TOKEN), none, np.int64)
    for k, off in enumerate(OFFSETS):
        lo, hi = max(0, -off), min(width, width - off)
        at[k, :, lo:hi] = x[:, lo + off:hi + off]
    want = np.eye(3)[y] * live[..., None]
    params = [np.zeros((len(OFFSETS), none + 1, 3)), np.zeros((FILES, 3)), np.zeros((3, 3))]
    seen = [np.full_like(p, 1e-8) for p in params]
    pairs = (live[:, 1:] & live[:, :-1])
    for _ in range(rounds):
        w, fw, st = params
        s = sum(w[k][at[k]].sum(2) for k in range(len(OFFSETS))) + fw[file][:, None]
        p, q = _marginals(s, st, live)
        gap = (want - p) * live[..., None]
        g = [np.zeros_like(w), np.zeros_like(fw), np.zeros_like(st)]
        for k in range(len(OFFSETS)):
            for tag in range(3):
                each = np.repeat(gap[:, :, tag].ravel(), PER_TOKEN)
                g[0][k, :, tag] = np.bincount(at[k].ravel(), each, none + 1)
        g[0][:, none] = 0
        np.add.at(g[1], file, gap.sum(1))
        g[2] = np.einsum("nti,ntj,nt->ij", np.eye(3)[y[:, :-1]], np.eye(3)[y[:, 1:]], pairs) - (q * pairs[..., None, None]).sum((0, 1))
        for p_, g_, s_ in zip(params, g, seen):
            g_ = g_ / n - decay * p_
            s_ += g_ * g_
            p_ += rate * g_ / np.sqrt(s_)
    return params[0][:, :none], params[1], params[2]


def _marginals(s, steps, live):
    """Tag and tag-pair probabilities of all windows by forward and backward sums."""
    n, width, _ = s.shape
    fwd, bwd = np.zeros_like(s), np.zeros_like(s)
    fwd[:, 0] = s[:, 0]
    for t in range(1, width):
        here = np.logaddexp.reduce(fwd[:, t - 1, :, None] + steps, axis=1) + s[:, t]
        fwd[:, t] = np.where(live[:, t, None], here, fwd[:, t - 1])
    for t in range(width - 2, -1, -1):
        here = np.logaddexp.reduce(steps + (s[:, t + 1] + bwd[:, t + 1])[:, None, :], axis=2)
        bwd[:, t] = np.where(live[:, t + 1, None], here, 0.0)
    total = np.logaddexp.reduce(fwd[:, -1], axis=1)
    p = np.exp(np.minimum(fwd + bwd - total[:, None, None], 0.0))
    q = np.exp(np.minimum(fwd[:, :-1, :, None] + steps + (s[:, 1:] + bwd[:, 1:])[:, :, None, :] - total[:, None, None, None], 0.0))
    return p, q


def find(text: str, field: Field) -> list[tuple[int, int, int]]:
    """All spans (kind, start, end), by start and then kind."""
    base = pattern_spans(text)
    spans = list(base)
    tokens = TOKEN.findall(text)
    tags = field.tag(tokens, file_feature(text))
    inside = np.flatnonzero(tags != O)
    if len(inside):
        places = [m.span() for m in TOKEN.finditer(text)]
        begins = inside[(tags[inside] == B) | np.isin(inside - 1, inside, invert=True)]
        for a in begins:
            z = a
            while z + 1 < len(tags) and tags[z + 1] == I:
                z += 1
            lo, hi = places[a][0], places[z][1]
            if hi - lo >= SHORTEST and not any(s <= lo and hi <= e for _, s, e in base):
                spans.append((3, lo, hi))
    return sorted(spans, key=lambda s: (s[1], s[0], s[2]))


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, counts of the patterns' spans, their digest, and all spans, for each row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(_weights(field or train(docs)))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches):
        own = Field(*model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, rows = batch.slice(at, 512), []
                for text in part.column(1).to_pylist():
                    spans = find(text or "", own)
                    base = [s for s in spans if s[0] < 3]
                    count = [sum(s[0] == k for s in base) for k in range(3)]
                    rows.append((*count, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
                own.shrink()
                cols = [pa.array(c) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def _weights(field: Field):
    return field.weights, field.files, field.steps


def redact(docs: DataFrame, field: Field | None = None, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mask``; overlapping spans are one. Null texts stay null."""
    model = docs.sparkSession.sparkContext.broadcast(_weights(field or train(docs)))
    at = docs.columns.index("text")

    def hidden(text, own):
        out, end = [], 0
        for _, a, b in find(text, own):
            if a >= end:
                out += [text[end:a], mask]
            end = max(end, b)
        return "".join(out) + text[end:]

    def work(batches):
        own = Field(*model.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = [t if t is None else hidden(t, own) for t in part.column(at).to_pylist()]
                own.shrink()
                cols = list(part.columns)
                cols[at] = pa.array(texts, part.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(cols, schema=part.schema)

    return docs.mapInArrow(work, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
