"""Language identification with spans of mixed-language text.

The script of a word narrows the candidate languages; each word has a score per candidate from its own frequency and
its character trigrams; Viterbi over the words, with a penalty for each switch, labels spans. A document whose best
language no run of words can beat by half the penalty needs no search: the best path is that language throughout.

The model is learned from a bounded sample of documents of every language and from at most ``VOCABULARY`` words of each, the most frequent ones;
prediction streams whole texts through Arrow batches without a shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperlake.llm.common import held_out, small_batches

SAMPLE_PER_LANGUAGE = 800
VOCABULARY = 50_000
PENALTY = 8.0
CACHE = 300_000
UNDETERMINED = "und"
_WORD = re.compile(r"[^\W\d_]+")

#: First code points of script ranges and the script that holds from there on.
SCRIPT_RANGES = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"),
    (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "other"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "other"),
    (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1380, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"),
)
_STARTS = [a for a, _ in SCRIPT_RANGES]


def script_of(word: str) -> str:
    """Script of the first letter."""
    return SCRIPT_RANGES[bisect_right(_STARTS, ord(next((c for c in word if c.isalpha()), "\0"))) - 1][1]


def trigrams(word: str) -> list[str]:
    w = f"_{word}_"
    return [w[i : i + 3] for i in range(len(w) - 2)]


class Model:
    """Log scores of words by language from (language, word, count) rows."""

    def __init__(self, rows: list[tuple[str, str, int]]):
        self.languages = sorted({r[0] for r in rows})
        at, k = {lang: i for i, lang in enumerate(self.languages)}, len(self.languages)
        words: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(k))
        grams: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(k))
        scripts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(k))
        for lang, word, n in rows:
            words[word][at[lang]] += n
            scripts[script_of(word)][at[lang]] += n * len(word)
            for g in trigrams(word):
                grams[g][at[lang]] += n
        self.words = self._scores(words, 0.5)
        self.grams = self._scores(grams, 0.2)
        letters = sum(scripts.values(), np.zeros(k))
        self.candidates = {s: v >= 0.01 * np.maximum(letters, 1) for s, v in scripts.items()}
        self.cache: dict[str, int] = {}
        self.rows = np.zeros((0, k), dtype=np.float32)

    @staticmethod
    def _scores(counts: dict[str, np.ndarray], add: float) -> tuple[dict[str, int], np.ndarray]:
        """Row numbers, and log likelihoods by language as differences to the best; the last row stands for what was never seen."""
        if not counts:
            return {}, np.zeros((1, 0), dtype=np.float32)
        m = np.stack([*counts.values()])
        m = np.log((m + add) / (m.sum(axis=0) + add * (len(m) + 1)))
        m = np.concatenate([np.maximum(m - m.max(axis=1, keepdims=True), -6), np.zeros((1, m.shape[1]))])
        return {w: i for i, w in enumerate(counts)}, m.astype(np.float32)

    def ids(self, words: list[str]) -> np.ndarray:
        """Rows of the words' scores in ``self.rows``; words met for the first time are scored together."""
        if len(self.cache) > CACHE:
            self.cache, self.rows = {}, self.rows[:0]
        fresh = [w for w in set(words) if w not in self.cache]
        if fresh:
            index, scores = self.grams
            lists = [[index.get(g, -1) for g in trigrams(w)] for w in fresh]
            sizes = np.array([len(x) for x in lists])
            got = np.add.reduceat(scores[np.array([g for x in lists for g in x])], np.cumsum(sizes) - sizes, axis=0)
            index, scores = self.words
            got = np.maximum(got, -12) + scores[[index.get(w, -1) for w in fresh]]
            for i, w in enumerate(fresh):
                may = self.candidates.get(script_of(w))
                if may is None or not may.any() or not any(map(str.isalpha, w)):
                    got[i] = 0
                elif not may.all():
                    got[i] = np.where(may, got[i], -20)
            got -= got.max(axis=1, keepdims=True)
            self.cache.update(zip(fresh, range(len(self.rows), len(self.rows) + len(fresh)), strict=True))
            self.rows = np.concatenate([self.rows, got.astype(np.float32)])
        return np.fromiter(map(self.cache.__getitem__, words), np.int64, len(words))


def viterbi(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """Best labels of each document (words x languages), all documents at once, longest first."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    sizes = np.array([len(scores[i]) for i in order])
    k = scores[order[0]].shape[1]
    best, back = np.zeros((len(order), k)), []
    for t in range(sizes[0]):
        n = int(np.searchsorted(-sizes, -t, side="left"))
        top = best[:n].argmax(axis=1)
        switched = best[np.arange(n), top][:, None] - penalty
        back.append(np.where(best[:n] >= switched, np.arange(k), top[:, None]).astype(np.int16))
        best[:n] = np.maximum(best[:n], switched) + np.stack([scores[i][t] for i in order[:n]])
    out = [np.zeros(0, dtype=np.int64)] * len(scores)
    for j, i in enumerate(order):
        labels = np.zeros(sizes[j], dtype=np.int64)
        at = int(best[j].argmax())
        for t in range(sizes[j] - 1, -1, -1):
            labels[t] = at
            at = back[t][j, at]
        out[i] = labels
    return out


def label_words(scores: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """Label of every word of a batch of documents of at least one word each, given in a row."""
    starts = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(sizes)), sizes)
    best = np.add.reduceat(scores, starts, axis=0, dtype=np.float64).argmax(axis=1)
    labels = best[doc]
    gain = scores - scores[np.arange(len(scores)), labels][:, None]
    # largest sum of a run of gains: running sums, with a 0 before each document, above their lowest value so far
    at = np.arange(len(scores)) + doc + 1
    sums = np.zeros((len(scores) + len(sizes), scores.shape[1]))
    sums[at] = gain
    sums = np.cumsum(sums, axis=0)
    zero = starts + np.arange(len(sizes))
    sums -= np.repeat(sums[zero], sizes + 1, axis=0)
    sums -= (np.repeat(np.arange(len(sizes)), sizes + 1) * (np.abs(sums).max() * 2 + 1))[:, None]
    highest = np.maximum.reduceat(sums - np.minimum.accumulate(sums, axis=0), zero, axis=0).max(axis=1)
    mixed = np.flatnonzero(highest > penalty / 2)
    for i in range(0, len(mixed), 256):
        some = mixed[i : i + 256]
        for d, found in zip(some, viterbi([scores[starts[d] : starts[d] + sizes[d]] for d in some], penalty), strict=True):
            labels[starts[d] : starts[d] + sizes[d]] = found
    return labels


def train(docs: DataFrame, text: str = "text", lang: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE, vocabulary: int = VOCABULARY) -> Model:
    """Model from about ``per_language`` different texts of each language, chosen by a hash of the text, and the ``vocabulary`` most frequent words of each.

    The shares are of different texts, so that a language of few texts in many copies is not left without any. The driver gets a number for
    each language and the words that the model holds.
    """
    docs = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).collect()}
    if not counts:
        return Model([])
    share = F.create_map(*(F.lit(x) for lang_, n in sorted(counts.items()) for x in (lang_, int(min(1.0, per_language / max(1, n)) * (1 << 30)))))
    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.element_at(share, F.col("lang")))
    words = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    ranked = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word")))
    got = ranked.where(F.col("rank") <= vocabulary).orderBy("lang", "rank").select("lang", "word", "n").toArrow()
    return Model(list(zip(*(got.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True)))


def predict(docs: DataFrame, model: Model, keep: list[str], text: str = "text", penalty: float = PENALTY) -> DataFrame:
    """The columns ``keep`` of ``docs`` with lang_pred, score and spans (start and end in characters, lang).

    ``lang_pred`` labels most letters; ``score`` is its share of the letters times the likelihood of its words under it
    against the other languages. Null texts and texts without a letter get ``und``, score 0 and no span; so does every text
    if there was nothing to learn from. Clashing columns are replaced; repeated rows stay.
    """
    small_batches(docs.sparkSession)
    keep = [c for c in keep if c not in ("lang_pred", "score", "spans")]
    schema = T.StructType([*(docs.schema[c] for c in keep), *T.StructType.fromDDL("lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>").fields])
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def judge(texts: list[str | None]) -> tuple[list, list, list]:
        langs, k = model.languages, len(model.languages)
        names, scores, spans = [UNDETERMINED] * len(texts), [0.0] * len(texts), [[] for _ in texts]
        flat, sizes, which = [], [], []
        for i, t in enumerate(texts):
            words = _WORD.findall(t.lower()) if t and k else []
            if words and any(map(str.isalpha, t)):
                flat += words
                sizes.append(len(words))
                which.append(i)
        if not which:
            return names, scores, spans
        size = np.array(sizes)
        starts = np.cumsum(size) - size
        rows = model.ids(flat)
        s = model.rows[rows]
        labels = label_words(s, size, penalty)
        letters = np.fromiter(map(len, flat), np.float64, len(flat))
        by = np.zeros((len(size), k))
        doc = np.repeat(np.arange(len(size)), size)
        np.add.at(by, (doc, labels), letters)
        top = by.argmax(axis=1)
        logs = np.add.reduceat(s * (labels == top[doc])[:, None], starts, axis=0)
        sure = 1 / np.exp(np.minimum(logs - logs[np.arange(len(size)), top][:, None], 50)).sum(axis=1)
        score = by[np.arange(len(size)), top] / by.sum(axis=1) * sure
        for j, i in enumerate(which):
            names[i], scores[i] = langs[top[j]], float(min(1.0, score[j]))
            own = labels[starts[j] : starts[j] + size[j]]
            edges = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist()]
            if len(edges) == 1:
                spans[i] = [{"start": 0, "end": len(texts[i]), "lang": langs[own[0]]}]
            else:
                begin = [m.start() for m in _WORD.finditer(texts[i].lower())]
                cuts = [0, *(min(begin[e], len(texts[i])) for e in edges[1:]), len(texts[i])]
                spans[i] = [{"start": a, "end": b, "lang": langs[own[e]]} for (a, b), e in zip(pairwise(cuts), edges, strict=True)]
        return names, scores, spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, spans = judge(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, spans_type)], [*keep, "lang_pred", "score", "spans"])

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)
