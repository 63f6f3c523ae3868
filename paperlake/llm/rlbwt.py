"""Suffix-array dedup: long repeats found in run-compressed Burrows-Wheeler transforms and removed wherever they stand.

A string of ``length`` bytes that also starts anywhere else, in another document or the same one, is removed at all its places.

1. Every such string holds an anchor: of the ``GRAM``-byte grams in it the one of the lowest hash. Equal strings
   have anchors of equal hash, so each document sends, about once in 140 bytes, its anchors' hashes and a hash of the
   anchor's surroundings (all strings that may hold it) to be counted. Anchors that occur once go no further.
2. Surroundings that occur twice as a whole are repeats as a whole. This takes copies of any number without comparing them.
3. Of the rest, one copy of each different surrounding is fetched, brought together by anchor hash, and indexed: pieces of one
   document that overlap are merged, so that no place is there twice. The text's suffixes are sorted, its transform
   is cut into runs, and the common lengths of neighbouring suffixes are computed at the ends of runs only. All other
   matching statistics follow in one pass over the text, each one less than that of the position before.
4. An anchor hash with more different surroundings than one index takes (``MOST``) is divided among several: a string that holds
   the anchor has at least half of its other bytes to the left of it or to the right, so the anchor grows by that half, once to
   each side, and the grown anchors go through steps 1 to 3 again, until every index is small enough or the anchor is the whole string.

The spans found go back to their documents by a 128-bit hash of the text, so ids may repeat or be null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperlake.llm.common import cut, small_batches
from paperlake.llm.fmindex import suffix_array

LENGTH, GRAM = 400, 128
INDEX_BYTES = 1 << 18
MOST = 4000
SLAB = 1 << 20
POSITION_BITS = 31

_rng = np.random.default_rng(9)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


class _Powers:
    """Powers of the base and of its inverse, as far as needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, dtype=np.uint64)])) for b in (_BASE, _INVERSE))
        return self.up[:n], self.down[:n]


_powers = _Powers()


class Hashed:
    """Polynomial hashes, modulo 2 ** 64, of all substrings of some bytes."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers.get(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start])

    def windows(self, n: int) -> np.ndarray:
        return _mix((self.sums[n:] - self.sums[:-n]) * self.down[: len(self.sums) - n])


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every n consecutive values, by doubling."""
    have = 1
    while have < n:
        step = min(have, n - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def anchors(docs: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(document, anchor hash, hash of the surroundings, start and end of the surroundings, number) of each anchor in a slab of documents.

    An anchor is the rightmost lowest gram of a string; one that is still in reach and equal to it is used again, so
    periodic text has no more anchors. Its number is then 2, since its strings may repeat within its surroundings, else 1.
    """
    sizes = np.array([len(d) for d in docs], dtype=np.int64)
    data = np.frombuffer(b"".join(docs), dtype=np.uint8)
    empty = tuple(np.zeros(0, np.int64) for _ in range(6))
    if len(data) < length:
        return empty
    hashed = Hashed(data)
    grams = hashed.windows(gram)
    mask = np.uint64((1 << POSITION_BITS) - 1)
    keyed = (grams & ~mask) | (mask - np.arange(len(grams), dtype=np.uint64))
    lowest = sliding_min(keyed, length - gram + 1)
    ends = np.cumsum(sizes)
    doc_at = np.repeat(np.arange(len(docs)), np.maximum(sizes - length + 1, 0))
    if not len(doc_at):
        return empty
    fit = np.maximum(sizes - length + 1, 0)
    starts = np.arange(len(doc_at)) - np.repeat(np.cumsum(fit) - fit, fit) + np.repeat(ends - sizes, fit)
    at = (mask - (lowest[starts] & mask)).astype(np.int64)
    change = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (doc_at[1:] != doc_at[:-1])))
    at, doc, last = at[change], doc_at[change], np.append(starts[change[1:] - 1], starts[-1])
    number = np.ones(len(at), dtype=np.int64)
    if len(at) > 1:
        again = np.flatnonzero((grams[at[1:]] == grams[at[:-1]]) & (doc[1:] == doc[:-1])) + 1
        if len(again):
            keep, current, before = np.ones(len(at), dtype=bool), -1, -2
            for r in again.tolist():
                if r != before + 1:
                    current = r - 1
                if at[current] >= last[r]:
                    keep[r] = False
                    number[current] = 2
                else:
                    current = r
                before = r
            at, doc, number = at[keep], doc[keep], number[keep]
    low, high = np.maximum(at - (length - gram), (ends - sizes)[doc]), np.minimum(at + length, ends[doc])
    around = hashed.of(low, high) ^ _mix((at - low).astype(np.uint64) << np.uint64(20) | (high - at).astype(np.uint64))
    base = (ends - sizes)[doc]
    return doc, grams[at].view(np.int64), around.view(np.int64), low - base, high - base, number


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of a text of symbols over 0, with samples at the ends of its runs."""

    def __init__(self, text: np.ndarray):
        text = np.append(text, np.zeros(1, dtype=text.dtype))
        self.n = len(text)
        order = suffix_array(text)
        bwt = text[order - 1]
        head = np.flatnonzero(np.append(True, bwt[1:] != bwt[:-1]))
        self.symbols, self.lengths = bwt[head], np.diff(np.append(head, self.n))
        self.heads = order[head].astype(np.int64)  # text positions of the first suffix of each run, and of its neighbour above
        self.above = np.append(-1, order[head[1:] - 1].astype(np.int64))
        tail = np.append(head[1:], self.n) - 1
        self.tails = order[tail].astype(np.int64)  # and of the last suffix, and of its neighbour below
        self.below = np.append(order[head[1:]].astype(np.int64), -1)
        self.hashed = Hashed(text.astype(np.int64) & 0xFF) if text.dtype != np.uint8 else Hashed(text)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of suffixes a and b, by binary search on hashes."""
        most = self.n - np.maximum(a, b)
        low, high = np.zeros(len(a), dtype=np.int64), most
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.hashed.of(a, a + mid) == self.hashed.of(b, b + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def matching_statistics(self) -> np.ndarray:
        """For every text position, the length of the longest match that starts anywhere else.

        Inside a run the match of a suffix with its neighbour is one longer for the position before, so going
        through the text each value is the one before less one, unless a run's end brings a new sample.
        """
        best = np.zeros(self.n, dtype=np.int64)
        for at, other in ((self.heads, self.above), (self.tails, self.below)):
            value = np.zeros(len(at), dtype=np.int64)
            inner = other >= 0
            value[inner] = self.common(at[inner], other[inner])
            sampled = np.full(self.n, -1, dtype=np.int64)
            sampled[at] = np.arange(len(at))
            last = np.maximum.accumulate(np.where(sampled >= 0, np.arange(self.n), -1))
            ends = np.where(last >= 0, last + value[sampled[last]], 0)
            best = np.maximum(best, ends - np.arange(self.n))
        return best[:-1]


def repeated(pieces: dict[tuple[int, int], list[tuple[int, int, bytes]]], length: int = LENGTH) -> list[tuple[int, int, int, int]]:
    """(document hash, document hash, start, end) of strings in these pieces (start, end, bytes) of documents that occur at two places of them."""
    segments: list[tuple[tuple[int, int], int, bytes]] = []
    for doc, own in pieces.items():
        own.sort(key=lambda p: (p[0], -p[1]))
        start, data = own[0][0], bytearray()
        for s, e, b in own:
            if s > start + len(data):
                segments.append((doc, start, bytes(data)))
                start, data = s, bytearray()
            if e > start + len(data):
                data += b[start + len(data) - s :]
        segments.append((doc, start, bytes(data)))
    segments = [s for s in segments if len(s[2]) >= length]
    if not segments:
        return []
    sizes = np.array([len(s[2]) for s in segments])
    first = np.cumsum(sizes + 1) - sizes - 1
    text = np.frombuffer(b"".join(s[2] + b"\0" for s in segments), dtype=np.uint8).astype(np.int16) + 2
    text[first + sizes] = 1
    hit = RunLengthIndex(text).matching_statistics() >= length
    inside = np.zeros(len(text) + 1, dtype=np.int32)
    inside[first] += 1
    np.add.at(inside, first + sizes - length + 1, -1)
    hit &= np.cumsum(inside[:-1]) > 0  # strings that end within their segment
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    out = []
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1 + length).tolist(), strict=True):
        i = int(np.searchsorted(first, a, side="right")) - 1
        doc, start, _ = segments[i]
        out.append((*doc, start + a - int(first[i]), start + b - int(first[i])))
    return out


def _anchor_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    def rows(d: list, docs: list[bytes]) -> pa.RecordBatch:
        doc, key, around, s, e, m = anchors(docs, length, _gram(length))
        d1, d2 = (np.array([x[i] for x in d], dtype=np.int64) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (d1[doc], d2[doc], key, around)] + [pa.array(x.astype(np.int32)) for x in (s, e, m)], ["d1", "d2", "key", "around", "s", "e", "m"])

    for batch in batches:
        d, docs, size = [], [], 0
        for x1, x2, t in zip(batch.column("d1").to_pylist(), batch.column("d2").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if t is None or len(t) < length:
                continue
            d.append((x1, x2))
            docs.append(t)
            size += len(t)
            if size >= SLAB:
                yield rows(d, docs)
                d, docs, size = [], [], 0
        if docs:
            yield rows(d, docs)


def _gram(length: int) -> int:
    return max(1, length * GRAM // LENGTH)


def grown(data: bytes, pieces: list[dict], length: int = LENGTH) -> list[tuple[int, ...]]:
    """Of surroundings (key, s, e, a, b, node) of anchors [a, b), the same for the anchors grown to either side by half of what a string has besides.

    ``node`` tells by its bits which ways an anchor has grown, so that equal strings meet at equal places of equal anchors. An anchor that has not grown yet
    (node 1) stands for all grams equal to it in its surroundings; surroundings that overlap are one, so that no place is there twice.
    """
    hashed, out = Hashed(np.frombuffer(data, dtype=np.uint8)), []
    gram = _gram(length)
    around: dict[int, list[tuple[int, int]]] = {}
    for p in pieces:
        if p["node"] == 1:
            around.setdefault(p["key"], []).append((p["s"], p["e"]))
    places = [(lo, hi, 1, key) for key, own in around.items() for lo, hi in merge(own)] + [(p["s"], p["e"], p["node"], p) for p in pieces if p["node"] > 1]
    for lo, hi, node, of in places:
        if node == 1:
            starts = np.arange(lo, hi - gram + 1)
            a = starts[hashed.of(starts, starts + gram).view(np.int64) == of]
            b = a + gram
        else:
            a, b = np.array([of["a"]]), np.array([of["b"]])
        half = (length - int(b[0] - a[0]) + 1) // 2
        for way, (x, y) in enumerate(((a - half, b), (a, b + half))):
            fits = (x >= lo) & (y <= hi)
            x, y = x[fits], y[fits]
            s, e = np.maximum(lo, y - length), np.minimum(hi, x + length)
            long_ = e - s >= length
            x, y, s, e = (v[long_] for v in (x, y, s, e))
            key = _mix(hashed.of(x, y) ^ _mix(np.full(len(x), 2 * node + way, dtype=np.uint64))).view(np.int64)
            same = (hashed.of(s, e) ^ _mix((x - s).astype(np.uint64) << np.uint64(20) | (e - x).astype(np.uint64))).view(np.int64)
            out += zip(key.tolist(), same.tolist(), s.tolist(), e.tolist(), x.tolist(), y.tolist(), [2 * node + way] * len(x), strict=True)
    return out


_PIECE = ("s", "e", "a", "b", "node")
_ROW = "d1 long, d2 long, key long, around long, s int, e int, m int, a int, b int, node int"


def find_repeats(docs: DataFrame, length: int = LENGTH, most: int = MOST) -> DataFrame:
    """d1, d2 and ``spans`` (array of start and end in bytes, unmerged) of all documents (d1, d2, text as binary) with repeats."""
    zero = [F.lit(0).alias(c) for c in ("a", "b")]
    rows = docs.mapInArrow(lambda it: _anchor_rows(it, length), "d1 long, d2 long, key long, around long, s int, e int, m int").select("*", *zero, F.lit(1).alias("node"))
    spans: DataFrame | None = None
    while True:
        rows = cut(rows)
        several = cut(rows.groupBy("key").agg(F.sum("m").alias("n")).where("n > 1").select("key"))
        rows = cut(rows.join(several, "key"))
        groups = rows.groupBy("key", "around").agg(F.count(F.lit(1)).alias("n"), F.max("m").alias("m"), F.min(F.struct("d1", "d2", *_PIECE)).alias("one"))
        groups = cut(groups.select("key", "around", "n", "m", "one.*"))
        whole = rows.join(groups.where("n > 1").select("key", "around"), ["key", "around"]).where(F.col("e") - F.col("s") >= length).select("d1", "d2", "s", "e").distinct()
        kinds = cut(groups.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.max("m").alias("most")).where("kinds > 1 OR most > 1").select("key", "kinds"))
        piece = F.struct("key", *_PIECE, (F.col("kinds") > most).alias("hot")).alias("piece")
        wanted = cut(groups.join(kinds, "key").select("d1", "d2", piece))
        here = cut(whole.union(_indexed(_pieces(docs, wanted.where("NOT piece.hot")), length)))
        spans = here if spans is None else spans.union(here)
        hot = wanted.where("piece.hot")
        if hot.isEmpty():
            return spans.distinct().groupBy("d1", "d2").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
        rows = _pieces(docs, hot).mapInArrow(lambda it: _grow(it, length), _ROW)


def _pieces(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Documents (d1, d2, text) with all their wanted ``pieces``; of copies each has them, and readers take one copy a task."""
    return docs.join(cut(wanted.groupBy("d1", "d2").agg(F.collect_list("piece").alias("pieces"))), ["d1", "d2"])


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int, bytes, list[dict]]]]:
    """d1, d2, text and pieces, by batch, of texts that are new to the task."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        keys = list(zip(batch.column("d1").to_pylist(), batch.column("d2").to_pylist(), strict=True))
        fresh = [i for i, k in enumerate(keys) if not (k in seen or seen.add(k))]
        yield [(*keys[i], batch.column("text")[i].as_py(), batch.column("pieces")[i].as_py()) for i in fresh]


def _arrow(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)], [name for name, _ in fields])


def _grow(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for some in _once(batches):
        yield _arrow([(d1, d2, key, around, s, e, 1, a, b, node) for d1, d2, t, ps in some for key, around, s, e, a, b, node in grown(t, ps, length)], _ROW)


def _indexed(sources: DataFrame, length: int) -> DataFrame:
    """Spans of strings that repeat among the pieces of a key, by run-length indexes of about ``INDEX_BYTES`` of whole keys."""
    data_schema, span_schema = "key long, d1 long, d2 long, s int, e int, data binary", "d1 long, d2 long, s int, e int"

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _once(batches):
            yield _arrow([(p["key"], d1, d2, p["s"], p["e"], t[p["s"] : p["e"]]) for d1, d2, t, ps in some for p in ps], data_schema)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[tuple[int, int], list] = {}
        size, last = 0, None
        for batch in batches:
            for key, x1, x2, s, e, data in zip(*(batch.column(c).to_pylist() for c in ("key", "d1", "d2", "s", "e", "data")), strict=True):
                if size >= INDEX_BYTES and key != last:
                    yield _arrow(repeated(pieces, length), span_schema)
                    pieces, size = {}, 0
                pieces.setdefault((x1, x2), []).append((s, e, data))
                size += len(data)
                last = key
        if pieces:
            yield _arrow(repeated(pieces, length), span_schema)

    return sources.mapInArrow(fetch, data_schema).repartition("key").sortWithinPartitions("key").mapInArrow(index, span_schema)


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text", length: int = LENGTH, most: int = MOST) -> DataFrame:
    """The id of each row with n_bytes, n_removed, n_spans, spans (start and end in bytes, merged) and kept (bytes left).

    ``kept`` is binary, since a repeat may begin or end inside a character. Null texts count as empty. Repeated rows are
    repeats of each other: all of their bytes go if there are at least ``length``. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs.select("id", F.xxhash64("text").alias("d1"), F.xxhash64(F.lit(1), "text").alias("d2"), F.col("text").cast("binary").alias("text"))
    spans = cut(find_repeats(docs.select("d1", "d2", "text"), length, most))
    id_type = docs.schema["id"].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                m = merge([(p["s"], p["e"]) for p in spans or []])
                at = [0, *(x for span in m for x in span), len(t)]
                rows.append((len(t), sum(e - s for s, e in m), len(m), [{"s": s, "e": e} for s, e in m], b"".join(t[a:b] for a, b in zip(at[::2], at[1::2], strict=True))))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], [id_column, "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    joined = docs.join(spans, ["d1", "d2"], "left").select("id", "text", "spans")
    return joined.mapInArrow(apply, f"`{id_column}` {id_type}, n_bytes long, n_removed long, n_spans long, spans array<struct<s:int,e:int>>, kept binary")
