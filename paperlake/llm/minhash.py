"""Near-duplicate detection by circulant MinHash, banding and exact Jaccard verification.

A document's set is its distinct 5-word shingles. One permutation places a shingle among D slots, a second one, shifted by
one more slot for every coordinate, ranks the slots; the lowest rank is the coordinate. 32 bands of 4 coordinates make
buckets, and two sets of likeness 0.85 share no bucket with a probability of 6e-11.

Documents with equal sets are one node from the start. In each bucket a leader is compared with all other members; leaders are those that
are in the fullest buckets, which in a group of edited copies is the text they were copied from. Members of a bucket that still belong to
different components are compared further: first those drop out whose shingles, but for ones that no other such document has,
are too few for any link; then all that is left of a bucket is compared in blocks, as products of matrices. So every pair that
shares a bucket is compared exactly, is connected already, or is provably below the threshold, while the pairs of a group are never
rows: comparisons with leaders stream sorted rows, a leader's text before its members', in salted runs of bounded length, and
two blocks give at most one edge per document. A bucket of many documents is dealt to many tasks wherever its rows are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperlake.llm.common import cut, salted, small_batches
from paperlake.llm.components import components

SHINGLE = 5
BANDS, ROWS = 32, 4
SLOTS = 1 << 20
PERCENT = 85
RUN = 512
BLOCK_SHINGLES, COLUMNS = 300_000, 512
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
_MULTIPLIERS = (np.arange(1, SHINGLE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
CACHE = 300_000


class _Hashes(dict):
    """Hash of each word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingles(texts: list[bytes], hashes: dict[bytes, int], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; fewer than ``size`` words make one shingle, no word makes none."""
    flat: list[bytes] = []
    counts = []
    for t in texts:
        ws = t.translate(_FOLD).split()
        flat += ws
        counts.append(len(ws))
    h = np.fromiter(map(hashes.__getitem__, flat), np.uint64, len(flat))
    n = len(h) - size + 1
    rolled = _mix(sum((h[j : j + n] * _MULTIPLIERS[j] for j in range(size)), np.zeros(max(n, 0), np.uint64))) if n > 0 else np.zeros(0, np.uint64)
    out, at = [], 0
    for c in counts:
        if c >= size:
            out.append(np.unique(rolled[at : at + c - size + 1]))
        else:
            out.append(_mix((h[at : at + c] * _MULTIPLIERS[:c]).sum(dtype=np.uint64, keepdims=True) + np.uint64(c)) if c else np.zeros(0, np.uint64))
        at += c
    return out


class Circulant:
    """MinHash signatures from two permutations of the slots, the second one shifted for each coordinate."""

    def __init__(self, coordinates: int = BANDS * ROWS, slots: int = SLOTS, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.scatter, self.shift = np.uint64(rng.integers(1, 1 << 62) * 2 + 1), np.uint64(64 - (slots.bit_length() - 1))
        rank = rng.permutation(slots).astype(np.int32)
        self.ranks = np.lib.stride_tricks.sliding_window_view(np.concatenate([rank, rank[: coordinates - 1]]), coordinates)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        """Coordinate k is the lowest rank of slot + k over the set, slots taken in a circle."""
        slots = (hashes * self.scatter >> self.shift).astype(np.int64)
        best = self.ranks[slots[:4096]].min(axis=0)
        for i in range(4096, len(slots), 4096):
            best = np.minimum(best, self.ranks[slots[i : i + 4096]].min(axis=0))
        return best


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """64-bit keys (documents x bands) of the bands of signatures."""
    s = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    key = _mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :].repeat(len(s), axis=0)
    for r in range(ROWS):
        key = _mix(key + s[:, :, r] + np.uint64(1))
    return key


def _sign(id_column: str, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        circulant, hashes = Circulant(), _Hashes()
        for batch in batches:
            sets = shingles([t or b"" for t in batch.column(text).cast(pa.binary()).to_pylist()], hashes)
            keys = band_keys(np.stack([circulant.signature(s) if len(s) else np.zeros(BANDS * ROWS, np.int32) for s in sets])).view(np.int64) if sets else np.zeros((0, BANDS), np.int64)
            digest = pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(id_column).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), digest, *(pa.array(np.ascontiguousarray(keys[:, b])) for b in range(BANDS))], ["id", "n", "digest", *(f"b{b}" for b in range(BANDS))])

    return run


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """100 * intersection >= percent * union of two sorted distinct arrays."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def verify(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets are linked. ``texts``: id, text of at least all ids in the pairs.

    Texts are joined by sort and merge whatever the sizes, so that small runs have the plan of large ones.
    A row for each pair carries b's text; a's text goes once to each run of about ``RUN`` of its pairs. Rows sorted by run stream
    through, a's first, so a task holds one set of a and an Arrow batch.
    """
    sizes = cut(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / RUN).cast("int").alias("runs")))
    heads = sizes.join(texts.hint("merge"), F.col("a") == F.col("id")).select("a", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run"), F.lit(0).alias("role"), F.col("a").alias("b"), "text")
    members = pairs.join(sizes, "a").withColumn("run", F.pmod(F.xxhash64("b"), F.col("runs")).cast("int")).join(texts.hint("merge"), F.col("b") == F.col("id")).select("a", "run", F.lit(1).alias("role"), "b", "text")
    rows = heads.unionByName(members).repartition("a", "run").sortWithinPartitions("a", "run", "role")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, head, own = _Hashes(), None, None
        for batch in batches:
            a, role, b = (batch.column(c).to_pylist() for c in ("a", "role", "b"))
            found = []
            for x, r, y, s in zip(a, role, b, shingles([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()], hashes), strict=True):
                if r == 0:
                    head, own = x, s
                elif head == x and len(s) and linked(own, s, percent):
                    found.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["a", "b"])

    return rows.select("a", "role", "b", "text").mapInArrow(compare, "a long, b long")


def _unshared(texts: DataFrame) -> DataFrame:
    """id and c: how many of its shingles another of these documents has too."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            ids = batch.column("id").to_pylist()
            sets = shingles([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()], hashes)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, dtype=np.int64), [len(s) for s in sets])), pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64))], ["id", "s"])

    rows = texts.mapInArrow(explode, "id long, s long")
    # a shingle of one document alone is known from its smallest and largest id; only those are sent back to their document
    alone = rows.groupBy("s").agg(F.min("id").alias("id"), F.max("id").alias("last")).where("id = last")
    return alone.groupBy("id").agg(F.count(F.lit(1)).alias("alone"))


def joined(sets: list[np.ndarray], left: int, percent: int) -> np.ndarray:
    """For each set the smallest position among sets it is connected with, where links are sought between the first ``left`` sets and the others, or within all if there are no others.

    Intersections of all pairs come from products of 0/1 matrices over the shingles that both sides have, some columns at a time.
    """
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    shingle, at = np.unique(np.concatenate(sets), return_inverse=True)
    split = 0 < left < len(sets)
    a, b = (slice(0, left), slice(left, None)) if split else (slice(None), slice(None))
    first = owner < left
    useful = (np.bincount(at[first], minlength=len(shingle)) > 0) & (np.bincount(at[~first], minlength=len(shingle)) > 0) if split else np.bincount(at, minlength=len(shingle)) > 1
    column = np.cumsum(useful) - 1
    keep = useful[at]
    owner, at = owner[keep], column[at[keep]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    both = np.zeros((len(sizes[a]), len(sizes[b])), dtype=np.float32)
    for c in range(0, int(useful.sum()), COLUMNS):
        low, high = np.searchsorted(at, (c, c + COLUMNS))
        x = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        x[owner[low:high], at[low:high] - c] = 1
        both += x[a] @ x[b].T
    link = 100 * both >= percent * (sizes[a][:, None] + sizes[b][None, :] - both)
    label = np.arange(len(sets))
    while True:
        near_a = np.where(link, label[b][None, :], len(sets)).min(axis=1, initial=len(sets))
        new_a = np.minimum(label[a], near_a)
        new_b = np.minimum(label[b], np.where(link, new_a[:, None], len(sets)).min(axis=0, initial=len(sets)))
        new = np.concatenate([new_a, new_b]) if split else np.minimum(new_a, new_b)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def compare_clusters(members: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Edges (a, b) that connect what is linked among members (bucket, id, n, size) of the same cluster of overlapping buckets.

    All pairs of a cluster are compared, in blocks: its documents are dealt by a hash to blocks of about ``BLOCK_SHINGLES`` shingles, and each
    two blocks meet in one task, which gives back at most one edge for each of their documents.
    """
    low = members.groupBy("bucket").agg(F.min("id").alias("b"), F.first("size").alias("size"))
    clusters = components(salted(members, low, "bucket", "size", "id", RUN).select(F.col("id").alias("a"), "b")).withColumnRenamed("component", "cluster")
    docs = clusters.join(members.select("id", "n").distinct(), "id")
    docs = cut(docs)
    blocks = cut(docs.groupBy("cluster").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks")))
    docs = docs.join(blocks, "cluster").withColumn("k", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    docs = docs.withColumn("l", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = docs.join(texts, "id").select("cluster", F.least("k", "l").alias("i"), F.greatest("k", "l").alias("j"), "k", "id", "text")
    rows = rows.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "k")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, key, ids, sides, sets = _Hashes(), None, [], [], []

        def emit() -> pa.RecordBatch:
            label = joined(sets, sum(s == key[1] for s in sides) if key[1] != key[2] else len(sets), percent)
            found = [(ids[x], ids[i]) for i, x in enumerate(label.tolist()) if x != i]
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["a", "b"])

        for batch in batches:
            found = shingles([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()], hashes)
            for c, i, j, k, x, s in zip(*(batch.column(c).to_pylist() for c in ("cluster", "i", "j", "k", "id")), found, strict=True):
                if (c, i, j) != key:
                    if sets:
                        yield emit()
                    key, ids, sides, sets = (c, i, j), [], [], []
                ids.append(x)
                sides.append(k)
                sets.append(s)
        if sets:
            yield emit()

    return rows.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``.

    Null and empty texts have no shingles and form components of their own; a row without an id has no component and is
    kept. Rows of one id are one node. Other columns are ignored, an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"))
    signed = cut(docs.mapInArrow(_sign("id", "text"), T.StructType.fromDDL("id long, n long, digest binary, " + ", ".join(f"b{b} long" for b in range(BANDS)))))
    full = signed.where("id IS NOT NULL AND digest IS NOT NULL")
    nodes = cut(full.groupBy("digest").agg(F.min("id").alias("id"), F.min("n").alias("n"), *(F.min(f"b{b}").alias(f"b{b}") for b in range(BANDS))))
    bands = nodes.select("id", "n", F.explode(F.array(*(f"b{b}" for b in range(BANDS)))).alias("bucket"))
    shared = cut(bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("n").alias("least")).where("size > 1"))
    members = cut(bands.join(shared, "bucket"))
    score = members.groupBy("id").agg(F.sum("size").alias("score"))
    members = cut(members.join(score, "id").withColumn("score", F.col("score") * (1 << 20) + F.pmod(F.xxhash64("id"), F.lit(1 << 20))))
    wanted = members.select("id").distinct()
    texts = cut(docs.join(wanted.hint("merge"), "id").join(nodes.select("id", "n"), "id").dropDuplicates(["id"]).select("id", "text"))
    fits = F.expr(f"100 * least(n, m) >= {percent} * greatest(n, m)")

    leaders = cut(members.groupBy("bucket").agg(F.max_by("id", "score").alias("a"), F.max_by("n", "score").alias("m"), F.first("size").alias("size")))
    pairs = salted(members, leaders, "bucket", "size", "id", RUN).where("id <> a").where(fits).select("a", F.col("id").alias("b")).distinct()
    edges = cut(verify(cut(pairs), texts, percent))
    members = members.join(leaders.select("bucket", F.col("a").alias("id")), ["bucket", "id"], "left_anti")
    labels = components(edges)

    def unsettled(m: DataFrame) -> DataFrame:
        """Members, with their component, of buckets whose members are of several components."""
        m = m.join(labels.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left").withColumn("c", F.coalesce("component", "id")).drop("_id", "component")
        open_ = m.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.first("size").alias("size")).where("low < high").select("bucket", "size")
        return cut(salted(m, open_, "bucket", "size", "id", RUN))

    open_ = unsettled(members)
    if not open_.isEmpty():
        few = texts.join(open_.select("id").distinct(), "id")
        open_ = open_.join(_unshared(few), "id", "left").withColumn("k", F.col("n") - F.coalesce("alone", F.lit(0)))
        open_ = open_.where(f"100 * k >= {percent} * (n + greatest(least, k) - k)").drop("k", "alone")
        open_ = unsettled(open_.drop("c"))
    if not open_.isEmpty():
        edges = edges.unionByName(cut(compare_clusters(open_, texts, percent)))
        labels = components(edges)

    to = nodes.select("digest", F.col("id").alias("node")).join(labels, F.col("node") == F.col("id"), "left").select(F.col("digest").alias("_digest"), F.coalesce("component", "node").alias("component"))
    to = cut(to)
    out = signed.select("id", "n", "digest").join(to, F.col("digest") == F.col("_digest"), "left")
    out = out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
