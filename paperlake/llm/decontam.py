"""Benchmark decontamination: an FM-index for each training shard, searched for the benchmark's phrases.

A phrase is 10 consecutive words of a benchmark item, or all words of a shorter one. A shard is about half a million words
of documents. Its text is written in the benchmark's vocabulary; a word or a pair of neighbours that no phrase holds
ends a stretch, since no phrase can lie across it, and equal stretches are indexed once. Phrases are found by backward
search over wavelet-matrix ranks and located by sampled suffix positions; overlapping occurrences merge into spans.

No shuffle: documents stream through once for each block of the benchmark. A block holds about ``BLOCK_BYTES`` of
benchmark text; its phrases are packed arrays of some 15 times that, which bounds the driver and what is broadcast. A benchmark of one block, the
usual case, is one pass; what a pass has found is written before the next one, so that workers hold one block at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperlake.llm.common import cut, small_batches
from paperlake.llm.fmindex import FMIndex

N = 10
BLOCK_BYTES = 4 << 20
SHARD_WORDS = 500_000
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = regex.compile(rb"[0-9A-Za-z\x80-\xff]+")
SPANS = "array<struct<start:int,end:int>>"


def words(text: bytes) -> list[bytes]:
    """Words of UTF-8 text: digits, letters a-z and all above ASCII, A-Z in lower case."""
    return text.translate(_FOLD).split()


class Phrases:
    """The benchmark's phrases as rows of word numbers, by length, each with the items that hold it.

    ``groups``: (length, phrases as rows, where each one's items begin in the next array, item numbers).
    """

    def __init__(self, items: list[tuple[str | None, bytes]], n: int = N):
        self.vocabulary: dict[bytes, int] = {}
        self.names = [item for item, _ in items]
        rows: dict[int, list[np.ndarray]] = {}
        owners: dict[int, list[np.ndarray]] = {}
        for k, (_, text) in enumerate(items):
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)], dtype=np.int32)
            if len(ids):
                m = min(n, len(ids))
                rows.setdefault(m, []).append(np.lib.stride_tricks.sliding_window_view(ids, m))
                owners.setdefault(m, []).append(np.full(len(ids) - m + 1, k, dtype=np.int32))
        self.top = len(self.vocabulary)
        self.groups = []
        for m in sorted(rows):
            phrases, which = np.unique(np.concatenate(rows.pop(m)), axis=0, return_inverse=True)
            held = np.unique(np.stack([which.ravel(), np.concatenate(owners.pop(m))], axis=1), axis=0)
            self.groups.append((m, phrases, np.searchsorted(held[:, 0], np.arange(len(phrases) + 1)), held[:, 1].astype(np.int32)))
        self.shortest = self.groups[0][0] if self.groups else 0
        pairs = [np.unique(p[:, :-1].astype(np.int64) * (self.top + 1) + p[:, 1:]) for m, p, _, _ in self.groups if m > 1]
        self.pairs = np.unique(np.concatenate([*pairs, np.zeros(0, dtype=np.int64)]))
        self.singles = self.groups[0][1][:, 0] if self.shortest == 1 else np.zeros(0, dtype=np.int64)
        self.sieve = np.zeros(1 << 22, dtype=bool)
        self.sieve[self._slot(self.pairs)] = True

    @staticmethod
    def _slot(pairs: np.ndarray) -> np.ndarray:
        return (pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(42)).astype(np.int64)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """Which places begin a pair of neighbours that some phrase holds."""
        pairs = ids[:-1].astype(np.int64) * (self.top + 1) + ids[1:]
        out = (ids[:-1] > 0) & (ids[1:] > 0)
        out &= self.sieve[self._slot(pairs)]
        maybe = np.flatnonzero(out)
        out[maybe] = self.pairs[np.minimum(np.searchsorted(self.pairs, pairs[maybe]), len(self.pairs) - 1)] == pairs[maybe]
        return out

    def stretches(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of all runs of words in which a phrase may lie."""
        joined = self.joined(ids) if len(ids) > 1 and len(self.pairs) else np.zeros(max(0, len(ids) - 1), dtype=bool)
        edge = np.diff(np.concatenate([[0], joined.astype(np.int8), [0]]))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
        if len(self.singles):
            alone = np.isin(ids, self.singles)
            alone[:-1] &= ~joined
            alone[1:] &= ~joined
            at = np.flatnonzero(alone)
            start, end = np.concatenate([start, at]), np.concatenate([end, at + 1])
        long_ = end - start >= self.shortest
        return start[long_], end[long_]


def occurrences(phrases: Phrases, stretches: list[np.ndarray]) -> list[tuple[int, int, int, list[str | None]]]:
    """(stretch, start, end, items) of every occurrence of a phrase, through an FM-index over the stretches."""
    if not stretches or not phrases.groups:
        return []
    sizes = np.array([len(s) + 1 for s in stretches])
    offset = np.cumsum(sizes) - sizes
    text = np.zeros(int(sizes.sum()), dtype=np.int64)
    for o, s in zip(offset, stretches, strict=True):
        text[o : o + len(s)] = s
    index, out = FMIndex(text, phrases.top), []
    for m, patterns, first, items in phrases.groups:
        low, high = index.search(patterns)
        n = high - low
        which = np.repeat(np.arange(len(patterns)), n)
        rows = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + low[which]
        at = index.locate(rows)
        stretch = np.searchsorted(offset, at, side="right") - 1
        out += [(s, a, a + m, [phrases.names[i] for i in items[first[w] : first[w + 1]]]) for s, a, w in zip(stretch.tolist(), (at - offset[stretch]).tolist(), which.tolist(), strict=True)]
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def search_shard(phrases: Phrases, ids: np.ndarray, starts: np.ndarray) -> dict[int, tuple[list[tuple[int, int]], set[str | None]]]:
    """Of a shard given as one row of word numbers, 0 after each document: by document, merged spans and items."""
    begin, end = phrases.stretches(ids)
    distinct: dict[bytes, int] = {}
    which = [distinct.setdefault(ids[a:b].tobytes(), len(distinct)) for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
    found: dict[int, tuple[list[tuple[int, int]], set[str | None]]] = {}
    for s, a, b, items in occurrences(phrases, [np.frombuffer(x, dtype=ids.dtype) for x in distinct]):
        f = found.setdefault(s, ([], set()))
        f[0].append((a, b))
        f[1].update(items)
    found = {s: (merged(spans), items) for s, (spans, items) in found.items()}
    out: dict[int, tuple[list[tuple[int, int]], set[str | None]]] = {}
    docs = np.searchsorted(starts, begin, side="right") - 1
    for s, d, a in zip(which, docs.tolist(), (begin - starts[docs]).tolist() if len(begin) else [], strict=True):
        if s in found:
            spans, items = out.setdefault(d, ([], set()))
            spans += [(a + x, a + y) for x, y in found[s][0]]
            items |= found[s][1]
    return out


def _scan(phrases: Phrases, text: str, finish, found: tuple[str, str] | None = None):
    """``finish(batch, word counts, spans, items)`` of every Arrow batch; ``found`` names columns of spans and items that an earlier pass has left."""

    def shard(rows: list[pa.RecordBatch], flat: list[bytes], counts: list[int]) -> Iterator[pa.RecordBatch]:
        ids = np.fromiter(map(phrases.vocabulary.get, flat, repeat(0)), np.int32, len(flat))
        sizes = np.array(counts, dtype=np.int64) + 1
        hits = search_shard(phrases, ids, np.cumsum(sizes) - sizes)
        at = 0
        for batch in rows:
            spans, items = [], []
            for i in range(batch.num_rows):
                s, x = hits.get(at + i, ([], ()))
                if found:
                    s = s + [(p["start"], p["end"]) for p in batch.column(found[0])[i].as_py()]
                    x = set(x) | set(batch.column(found[1])[i].as_py())
                spans.append(merged(s))
                items.append(sorted(i for i in x if i is not None))
            yield finish(batch, counts[at : at + batch.num_rows], spans, items)
            at += batch.num_rows

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[pa.RecordBatch] = []
        flat: list[bytes] = []
        counts: list[int] = []
        for batch in batches:
            for t in batch.column(text).cast(pa.binary()).to_pylist():
                ws = words(t or b"")
                flat += ws
                flat.append(b"")
                counts.append(len(ws))
            rows.append(batch)
            if len(flat) >= SHARD_WORDS:
                yield from shard(rows, flat, counts)
                rows, flat, counts = [], [], []
        if rows:
            yield from shard(rows, flat, counts)

    return scan


def _passes(docs: DataFrame, benchmark: DataFrame, text: str, n: int, block_bytes: int, finish, schema: T.StructType) -> DataFrame:
    """``finish`` over the documents and what all blocks of the benchmark find in them."""
    small_batches(docs.sparkSession)
    rows = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), F.encode("text", "UTF-8").alias("text"))
    blocks = max(1, -(-int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    own = [f.name for f in docs.schema.fields]
    names = ("spans_so_far", "items_so_far")
    while set(names) & set(own):
        names = tuple(f"_{x}" for x in names)
    more = T.StructType([*docs.schema.fields, *T.StructType.fromDDL(f"{names[0]} {SPANS}, {names[1]} array<string>").fields])

    def carry(batch: pa.RecordBatch, counts: list[int], spans: list, items: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), _spans(spans), pa.array(items, pa.list_(pa.string()))], [*own, *names])

    for b in range(blocks):
        block = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        phrases = Phrases(sorted(((r["item"], bytes(r["text"])) for r in block.toLocalIterator()), key=lambda x: (x[0] is None, x[0] or "", x[1])), n)
        found = names if b else None
        if b < blocks - 1:
            docs = cut(docs.mapInArrow(_scan(phrases, text, carry, found), more))
        else:
            return docs.mapInArrow(_scan(phrases, text, finish, found), schema)


def _spans(spans: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))


def find(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, text: str = "text", n: int = N, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns ``keep`` of ``docs`` (default: all) with n_words, spans and items.

    ``spans``: word positions [start, end) of merged occurrences, ``items``: ids, as text and sorted, of the benchmark items (item_id,
    text) of which a phrase occurs. An item without an id hits words like any other and is not among the items; items of one id are one
    item with the phrases of all. Null and empty texts have no words and no phrases. Columns of docs with one of the three names are replaced;
    an empty benchmark finds nothing. Repeated rows stay.
    """
    keep = [c for c in (keep or docs.columns) if c not in ("n_words", "spans", "items")]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("n_words", T.LongType()), *T.StructType.fromDDL(f"spans {SPANS}, items array<string>").fields])

    def finish(batch: pa.RecordBatch, counts: list[int], spans: list, items: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(counts, pa.int64()), _spans(spans), pa.array(items, pa.list_(pa.string()))], [*keep, "n_words", "spans", "items"])

    return _passes(docs.select(*dict.fromkeys([*keep, text])), benchmark, text, n, block_bytes, finish, schema)


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of the spans and what lies between words of one span."""
    data = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _WORD.finditer(data)]
    out, last = [], 0
    for a, b in spans:
        out.append(data[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, data[last:]]).decode("utf-8", "surrogatepass")


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text", n: int = N, min_left: int = 1, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs``, all its columns, with the benchmark's spans cut out of their texts; a contaminated document left with under ``min_left`` words goes."""
    names = docs.columns

    def finish(batch: pa.RecordBatch, counts: list[int], spans: list, items: list) -> pa.RecordBatch:
        if not any(spans):
            return batch.select(names)
        texts = batch.column(text).to_pylist()
        for i, s in enumerate(spans):
            if s:
                texts[i] = cut_spans(texts[i], s)
        stays = [not s or c - sum(b - a for a, b in s) >= min_left for s, c in zip(spans, counts, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text else batch.column(c) for c in names], names).filter(pa.array(stays))

    return _passes(docs, benchmark, text, n, block_bytes, finish, docs.schema)
