"""Toxicity by a classifier chain.

Categories, in order: ``mention`` (the text holds a term of the lexicon),
``severe`` (a toxic text whose share of such terms is at least the toxic
texts' median) and ``toxic`` (the label). Each has a logistic regression whose
inputs are the text's terms and the probabilities of the earlier categories. In
training these come out of fold: a document's earlier probabilities are
predicted by models that have not seen it, as they will be for new documents.

Terms are words and word beginnings of four to six letters, so that inflected
and compound forms count. The vocabulary (at most ``TERMS``) and the lexicon are
those that differ most between toxic and other training documents, by counts of
documents that Spark aggregates. Training uses about ``TRAIN_ROWS`` labelled
documents, chosen by a hash of their ids. The models are fitted on the driver;
their inputs are short lists of term numbers. Scoring reads every whole text in
Arrow batches.

Defined results: null and empty texts have no terms and get the models' base
rates. Labels of one id that differ count as toxic. Repeated rows are all
scored. Without toxic and other labelled documents every probability is 0.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesframe.llm.common import read, shared, text_of

CATEGORIES = ("mention", "severe", "toxic")
TERMS, TRAIN_ROWS, FOLDS = 384, 12_000, 5
THRESHOLD = 0.5
LEAST_DOCS, LEAST_ODDS = 4, 3.0
STEMS = (4, 5, 6)
WORDS = re.compile(r"[^\W\d_]+").findall


def terms_of(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


class Terms(dict):
    """Numbers of a word's terms in a vocabulary, by word."""

    def __init__(self, vocabulary: dict):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> tuple:
        if len(self) > 300_000:
            self.clear()
        self[word] = out = tuple(i for t in terms_of(word.lower()) if (i := self.vocabulary.get(t)) is not None)
        return out

    def count(self, text: str) -> tuple[dict, int]:
        """Times that each term occurs, and the number of words."""
        words, counts = WORDS(text), {}
        for hit in map(self.__getitem__, words):
            for i in hit:
                counts[i] = counts.get(i, 0) + 1
        return counts, len(words)


def vector(counts: dict, n_words: int, lexicon: np.ndarray) -> np.ndarray:
    """Inputs of the models: terms, and how many and how dense the lexicon's are."""
    out = np.zeros(len(lexicon) + 2)
    for i, c in counts.items():
        out[i] = np.log1p(c)
    hits = sum(c for i, c in counts.items() if lexicon[i])
    out[-2:] = np.log1p(hits), 10 * hits / (n_words + 20)
    return out


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    toxic = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_toxic"))
    return docs.select("doc_id", text_of("text").alias("_text")).join(toxic, "doc_id")


def _distinct_terms(batches):
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = list({t for w in set(WORDS(text.lower())) for t in terms_of(w)})
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([toxic] * len(found), pa.int32())], names=["term", "toxic"])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Weights (the last is the constant) by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]
    for _ in range(rounds):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-6)) @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Chain:
    """Vocabulary, lexicon and one weight vector for each category."""

    def __init__(self, vocabulary: dict, lexicon: np.ndarray, weights: list):
        self.vocabulary, self.lexicon, self.weights = vocabulary, lexicon, weights

    def predict(self, x: np.ndarray) -> np.ndarray:
        """A column for each category; ``x`` has a row for each text."""
        out = np.zeros((len(x), 0))
        for w in self.weights:
            out = np.column_stack([out, _sigmoid(np.column_stack([x, out, np.ones(len(x))]) @ w)])
        return out if self.weights else np.zeros((len(x), len(CATEGORIES)))

    @classmethod
    def fit(cls, vocabulary, lexicon, x, targets, folds: int = FOLDS) -> Chain:
        """Train on rows ``x`` and a column of 0 and 1 for each category."""
        fold = np.arange(len(x)) % folds
        earlier, weights = np.zeros((len(x), 0)), []
        for y in targets.T:
            inputs = np.column_stack([x, earlier])
            unseen = np.zeros(len(x))
            for k in range(folds):
                rest = fold != k
                if rest.any() and (~rest).any():
                    unseen[~rest] = _sigmoid(np.column_stack([inputs[~rest], np.ones((~rest).sum())]) @ _logistic(inputs[rest], y[rest]))
            weights.append(_logistic(inputs, y))
            earlier = np.column_stack([earlier, unseen])
        return cls(vocabulary, lexicon, weights)


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, terms: int = TERMS) -> Chain:
    """Fit the chain to the labelled documents of ``docs`` (doc_id, text; labels: doc_id, toxic)."""
    step = max(1, labels.select("doc_id").distinct().count() // max(1, train_rows))
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0
    known = shared(_labelled(docs.where(chosen), labels.where(chosen)), "labelled")
    sizes = {r["_toxic"]: r["n"] for r in known.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Chain({}, np.zeros(0, bool), [])
    rate = lambda c, n: (F.col(c) + 0.5) / (n + 1.0)
    counts = known.select("_text", "_toxic").mapInArrow(_distinct_terms, "term string, toxic int").groupBy("term").agg(
        F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    odds = F.ln(rate("bad", sizes[1])) - F.ln(rate("good", sizes[0]))
    weight = F.abs(odds) * F.sqrt(F.abs(F.col("bad") / sizes[1] - F.col("good") / sizes[0]))
    top = (counts.where(F.col("bad") + F.col("good") >= LEAST_DOCS).select("term", "bad", odds.alias("odds"), weight.alias("weight"))
           .orderBy(F.desc("weight"), "term").limit(terms).collect())
    vocabulary = {r["term"]: i for i, r in enumerate(top)}
    lexicon = np.array([r["odds"] >= LEAST_ODDS and r["bad"] >= LEAST_DOCS for r in top], bool)
    source = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def counted(batches):
        own = Terms(source.value)
        for batch in batches:
            rows = []
            for key, text, toxic in zip(*(c.to_pylist() for c in batch.columns)):
                c, n = own.count(text)
                rows.append((key, toxic, n, list(c), list(c.values())))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())))],
                                                 names=["id", "toxic", "n", "i", "c"])

    texts = known.select(F.col("doc_id").cast("long").alias("id"), "_text", "_toxic")
    rows = sorted(tuple(r) for r in texts.mapInArrow(counted, "id long, toxic int, n int, i array<int>, c array<int>").collect())[: 2 * train_rows]
    x = np.array([vector(dict(zip(i, c)), n, lexicon) for _, _, n, i, c in rows]).reshape(len(rows), len(lexicon) + 2)
    toxic = np.array([r[1] for r in rows], float)
    dense = x[:, -1]
    typical = np.median(dense[toxic > 0]) if toxic.any() else 0.0
    targets = np.column_stack([x[:, -2] > 0, (toxic > 0) & (dense >= typical), toxic > 0]).astype(float)
    return Chain.fit(vocabulary, lexicon, x, targets)


def score(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, ``p_`` of each category and ``toxic`` for every row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast((chain.vocabulary, chain.lexicon, chain.weights))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches):
        own = Chain(*model.value)
        terms = Terms(own.vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = np.array([vector(*terms.count(t or ""), own.lexicon) for t in part.column(1).to_pylist()])
                p = np.round(own.predict(x), 9)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c) for c in p.T], pa.array(p[:, -1] >= threshold)],
                                                 names=["doc_id", *[f"p_{c}" for c in CATEGORIES], "toxic"])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, " + ", ".join(f"p_{c} double" for c in CATEGORIES) + ", toxic boolean")


def query(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, train(docs, read(spark, sf_dir, "labels")))
