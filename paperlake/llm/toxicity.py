"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Every word of a bounded sample of labelled documents is a term. A document is a vector of (1 + log tf) * idf * G-squared over them, of length 1: the
G-squared of a word's presence against the label, as a supervised term weight, lets telling words outweigh the many others. Postings are cut into
blocks of examples, and each term has its largest weight per block; a query adds these up to a bound for every block, visits
the blocks of the highest bounds, and then only those that can still reach its k-th best, which gives the exact neighbours. The k
nearest vote with their cosines; the examples' own rate counts as one more vote of a fixed small weight. The vote is calibrated by a logistic curve,
fitted to votes on folds of the examples by the weights and neighbours of the other folds. A document without any term is voted on by the examples without any.

The model has a bounded size, whatever the corpus; prediction streams whole texts without a shuffle.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperlake.llm.common import cut, labelled_sample, small_batches

SAMPLE_ROWS = 2500
K, PRIOR_WEIGHT = 25, 1.0
BLOCK, FIRST = 64, 4
FOLDS, CALIBRATION = 4, 600
CACHE = 50_000
EVIDENCE = 3
_SPACED = {c: 32 for c in range(128) if not chr(c).isalnum()}


def words(text: str) -> list[str]:
    """Words in lower case: what lies between white space and ASCII characters other than letters and digits."""
    return text.lower().translate(_SPACED).split()


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges [low, high) in a row, and the sizes of the ranges."""
    sizes = high - low
    return np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum()), sizes


class Index:
    """Examples (label, name, term numbers, term frequencies) behind a block-max inverted index."""

    def __init__(self, examples: list[tuple[int, str, np.ndarray, np.ndarray]], idf: np.ndarray, k: int = K, prior_weight: float = PRIOR_WEIGHT, block: int = BLOCK):
        self.idf, self.k, self.prior_weight, self.block = idf, k, prior_weight, block
        vectors = [(y, name, terms, self.weights(terms, tfs)) for y, name, terms, tfs in examples]
        # examples with the same heaviest term share blocks, which keeps the other blocks' bounds low
        vectors.sort(key=lambda v: ((int(v[2][v[3].argmax()]) if len(v[2]) else -1), v[1]))
        self.labels = np.array([v[0] for v in vectors], dtype=np.float64)
        self.names = [v[1] for v in vectors]
        self.prior = float((self.labels.sum() + 0.5) / (len(vectors) + 1)) if vectors else 0.5
        bare = [v[0] for v in vectors if not len(v[2])]
        self.bare = (sum(bare) + prior_weight * self.prior) / (len(bare) + prior_weight)
        sizes = [len(v[2]) for v in vectors]
        term = np.concatenate([np.zeros(0, np.int64), *(v[2] for v in vectors)]).astype(np.int64)
        weight = np.concatenate([np.zeros(0), *(v[3] for v in vectors)])
        example = np.repeat(np.arange(len(vectors)), sizes)
        by = np.lexsort((example, term))
        term, self.example, self.weight = term[by], example[by].astype(np.int32), weight[by]
        self.blocks = max(1, -(-len(vectors) // block))
        cell = term * self.blocks + self.example // block
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
        self.posting = np.append(first, len(cell))  # of each cell (a term in a block), where its postings begin
        self.cell_block = (cell[first] % self.blocks).astype(np.int32)
        self.cell_top = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.cells = np.searchsorted(cell[first] // self.blocks, np.arange(len(idf) + 1))
        self.slope, self.shift = 1.0, 0.0

    def weights(self, terms: np.ndarray, tfs: np.ndarray) -> np.ndarray:
        w = (1 + np.log(tfs)) * self.idf[terms]
        return w / np.sqrt((w**2).sum()) if len(w) else w

    def nearest(self, terms: np.ndarray, tfs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Examples of the k highest cosines over 0, and these; of equal ones, those first in the index."""
        w = self.weights(terms, tfs)
        cells, sizes = _ranges(self.cells[terms], self.cells[terms + 1])
        block, w = self.cell_block[cells], np.repeat(w, sizes)
        bounds = np.bincount(block, self.cell_top[cells] * w, minlength=self.blocks)
        scores = np.zeros(len(self.labels))
        visit, seen, floor = np.argsort(-bounds, kind="stable")[:FIRST], np.zeros(self.blocks, dtype=bool), 1e-9
        for _ in range(2):
            go = np.zeros(self.blocks, dtype=bool)
            go[visit] = True
            own = go[block]
            at, n = _ranges(self.posting[cells[own]], self.posting[cells[own] + 1])
            scores += np.bincount(self.example[at], self.weight[at] * np.repeat(w[own], n), minlength=len(scores))
            seen |= go
            if len(scores) > self.k:
                floor = max(1e-9, np.partition(scores, -self.k)[-self.k] - 1e-9)
            visit = np.flatnonzero(~seen & (bounds >= floor))
        sims = np.round(scores, 9)
        best = np.flatnonzero(sims > 0)
        if len(best) > self.k:
            best = best[sims[best] >= np.partition(sims[best], -self.k)[-self.k]]
        best = best[np.lexsort((best, -sims[best]))[: self.k]]
        return best, sims[best]

    def vote(self, best: np.ndarray, sims: np.ndarray) -> float:
        return float(((sims * self.labels[best]).sum() + self.prior_weight * self.prior) / (sims.sum() + self.prior_weight))

    def score(self, terms: np.ndarray, tfs: np.ndarray) -> tuple[float, list[str]]:
        if not len(terms):
            return self.bare, []
        best, sims = self.nearest(terms, tfs)
        v = self.vote(best, sims)
        return 1 / (1 + math.exp(-(self.slope * math.log(v / (1 - v)) + self.shift))), [self.names[i] for i in best[:EVIDENCE]]


def calibration(examples: list[tuple[int, str, np.ndarray, np.ndarray]], terms: int, folds: int = FOLDS, most: int = CALIBRATION) -> tuple[float, float]:
    """Slope and shift of the logistic curve that best turns a vote's logit into that of the label, from about ``most`` votes on folds of the examples.

    The fit is drawn to the vote as it is (1 and 0) by a ridge of one, which tells where examples are few; a curve that falls is not taken.
    """
    logits, truth = [], []
    for f in range(folds):
        rest = [e for e in examples if zlib.crc32(e[1].encode()) % folds != f]
        own = [e for e in examples if zlib.crc32(e[1].encode()) % folds == f and len(e[2])]
        if rest and own:
            index = Index(rest, term_weights(rest, terms))
            for e in own[:: max(1, len(own) * folds // most)]:
                v = index.vote(*index.nearest(e[2], e[3]))
                logits.append(math.log(v / (1 - v)))
                truth.append(float(e[0]))
    if not truth or min(truth) == max(truth):
        return 1.0, 0.0
    x, y, c = np.stack([logits, np.ones(len(logits))], axis=1), np.array(truth), np.array([1.0, 0.0])
    for _ in range(25):  # Newton's method
        p = 1 / (1 + np.exp(-(x @ c)))
        c = c - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(2), x.T @ (p - y) + (c - [1, 0]))
    return (float(c[0]), float(c[1])) if np.isfinite(c).all() and c[0] > 0 else (1.0, 0.0)


class Model:
    def __init__(self, terms: list[str], index: Index | None):
        self.terms, self.index = {t: i for i, t in enumerate(terms)}, index
        self.cache: dict[str | None, tuple[float, list[str]]] = {}

    def count(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers, rising, of the terms in a text, and how often each occurs."""
        found = Counter(filter(self.terms.__contains__, words(text or "")))
        terms, tfs = np.fromiter(map(self.terms.__getitem__, found), np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found))
        by = np.argsort(terms)
        return terms[by], tfs[by]

    def score(self, text: str | None) -> tuple[float, list[str]]:
        key = hash(text)
        if key not in self.cache:
            if len(self.cache) > CACHE:
                self.cache.clear()
            self.cache[key] = self.index.score(*self.count(text))
        return self.cache[key]


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", divisor: int = 4, remainder: int = 2, rows: int = SAMPLE_ROWS) -> Model:
    """Model from about ``rows`` labelled documents outside crc32(doc_id) mod ``divisor`` = ``remainder``.

    The sample's words are gathered in Spark; they and, for each example, its counts of them come to the driver. Without labelled documents the
    score is 0.5, with labels of one kind their value drawn to 0.5 by half an example each.
    """
    small_batches(docs.sparkSession)
    sample = cut(labelled_sample(docs.select("doc_id", "text"), labels, label, divisor, remainder, rows).select("doc_id", "text", F.least("_label", F.lit(1)).alias("label")))

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sorted({w for t in b.column("text").to_pylist() for w in words(t or "")}), pa.string())], ["word"])

    terms = sample.mapInArrow(distinct, "word string").distinct().orderBy("word").toArrow().column("word").to_pylist()
    counter = Model(terms, None)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tf = [counter.count(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("label"), b.column("doc_id").cast(pa.string()), pa.array([x[0] for x in tf], pa.list_(pa.int64())), pa.array([x[1] for x in tf], pa.list_(pa.int64()))], ["label", "name", "terms", "tfs"])

    got = sample.mapInArrow(vectors, "label int, name string, terms array<long>, tfs array<long>").toArrow()
    examples = [(y, name, t.values.to_numpy(), f.values.to_numpy()) for y, name, t, f in zip(got.column("label").to_pylist(), got.column("name").to_pylist(), got.column("terms"), got.column("tfs"), strict=True)]
    examples.sort(key=lambda e: e[1])
    index = Index(examples, term_weights(examples, len(terms)))
    index.slope, index.shift = calibration(examples, len(terms))
    return Model(terms, index)


def term_weights(examples: list[tuple[int, str, np.ndarray, np.ndarray]], terms: int) -> np.ndarray:
    """idf times G-squared of every term; a term that no example has gets the weight of one that tells nothing."""
    labels = np.array([e[0] for e in examples], dtype=np.float64)
    n, n1 = len(labels), float(labels.sum())
    at = np.concatenate([np.zeros(0, np.int64), *(e[2] for e in examples)])
    df = np.bincount(at, minlength=terms).astype(np.float64)
    a = np.bincount(at, np.repeat(labels, [len(e[2]) for e in examples]), minlength=terms)
    return (1 + np.log(max(n, 1) / np.maximum(df, 1))) * (g_squared(df, a, n, n1) if 0 < n1 < n else 1)


def g_squared(df: np.ndarray, a: np.ndarray, n: int, n1: float) -> np.ndarray:
    """G-squared, and at least a little, of words that occur in ``df`` of ``n`` examples, ``a`` of them among the ``n1`` of label 1."""

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12)), 0)

    rate = n1 / n
    rest = np.maximum(n - df, 1e-12)
    cells = part(a, df * rate) + part(df - a, df * (1 - rate)) + part(n1 - a, rest * rate) + part(n - n1 - (df - a), rest * (1 - rate))
    return np.maximum(2 * cells, 1e-3)


def predict(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``score`` and ``evidence``, the ids of the nearest examples, nearest first.

    Null texts count as empty and, like all texts without a term, have the rate of the examples without a term.
    """
    small_batches(docs.sparkSession)
    keep = [c for c in keep if c not in ("score", "evidence")]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("score", T.DoubleType()), T.StructField("evidence", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.score(t) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.list_(pa.string()))], [*keep, "score", "evidence"])

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)
