"""Quality classifier: a byte-level convolutional network in numpy.

A document is its UTF-8 bytes. Filters over 8 consecutive bytes slide over all of it; each chunk of 512 positions, half
overlapping the next, keeps every filter's maximum; a small dense layer turns a chunk's maxima into a logit, and the mean over all
chunks gives the document's probability. Training is by gradient descent on all chunks of a bounded sample of labelled documents, each document
with the same weight whatever its length; for prediction the embedding and the filters fold into lookup tables of byte pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperlake.llm.common import labelled_sample, small_batches

SAMPLE_ROWS = 2000
WIDTH, BLOCK = 8, 256
EMBEDDING, FILTERS, HIDDEN = 8, 24, 16
EPOCHS, BATCH, RATE = 6, 64, 0.004
SLAB = 64 * BLOCK


def padded(data: bytes) -> int:
    """Length of a document with at least WIDTH - 1 zero bytes after it, in whole blocks, two at least."""
    return max(2, -(-(len(data) + WIDTH - 1) // BLOCK)) * BLOCK


def chunks_of(data: bytes) -> list[bytes]:
    """All chunks from the start to the end of the document."""
    return [data[b * BLOCK : (b + 2) * BLOCK + WIDTH - 1] for b in range(padded(data) // BLOCK - 1)]


class Network:
    def __init__(self, prior: float = 0.5, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.p = {
            "e": rng.normal(0, 0.5, (256, EMBEDDING)), "w": rng.normal(0, 0.25, (WIDTH, EMBEDDING, FILTERS)), "b": np.zeros(FILTERS),
            "h": rng.normal(0, 0.3, (FILTERS + 1, HIDDEN)), "hb": np.zeros(HIDDEN), "o": rng.normal(0, 0.3, HIDDEN), "ob": np.array(np.log(max(prior, 1e-3) / max(1 - prior, 1e-3))),
        }
        self.p["e"][0] = 0
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.constant: float | None = None

    def _pool(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maxima and their places for bytes x (chunks x length)."""
        emb = self.p["e"][x]
        n = x.shape[1] - WIDTH + 1
        windows = np.lib.stride_tricks.sliding_window_view(emb.reshape(len(x), -1), WIDTH * EMBEDDING, axis=1)[:, ::EMBEDDING]
        conv = (windows.reshape(-1, WIDTH * EMBEDDING) @ self.p["w"].reshape(WIDTH * EMBEDDING, FILTERS)).reshape(len(x), n, FILTERS) + self.p["b"]
        at = conv.argmax(axis=1)
        return np.take_along_axis(conv, at[:, None], axis=1)[:, 0], at

    def _head(self, pooled: np.ndarray, fill: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``fill``: the share of the chunk that the document fills; a short one has lower maxima for no fault of its own."""
        a = np.concatenate([np.maximum(pooled, 0), fill[:, None].astype(np.float32)], axis=1)
        h = np.maximum(a @ self.p["h"] + self.p["hb"], 0)
        return a, h, h @ self.p["o"] + self.p["ob"]

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, seed: int = 7) -> None:
        """Adam on the log loss, chunks weighted; the maximum passes a gradient to one window per filter and chunk."""
        weight = np.ones(len(x), dtype=np.float32) if weight is None else weight.astype(np.float32)
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(p) for k, p in self.p.items()} for _ in range(2))
        t = 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(x))
            for i in range(0, len(x), BATCH):
                rows = order[i : i + BATCH]
                xb, yb = x[rows], y[rows]
                pooled, at = self._pool(xb)
                a, h, z = self._head(pooled, np.minimum(1, (xb > 0).sum(axis=1) / (2 * BLOCK)))
                dz = (1 / (1 + np.exp(-z)) - yb) * weight[rows] / len(rows)
                g = {"o": h.T @ dz, "ob": dz.sum()}
                dh = dz[:, None] * self.p["o"] * (h > 0)
                g |= {"h": a.T @ dh, "hb": dh.sum(axis=0)}
                da = (dh @ self.p["h"].T)[:, :FILTERS] * (pooled > 0)
                g["b"] = da.sum(axis=0)
                seen = xb[np.arange(len(rows))[:, None, None], at[:, :, None] + np.arange(WIDTH)]  # chunk, filter, byte
                emb = self.p["e"][seen]
                g["w"] = np.einsum("bf,bfje->jef", da, emb, optimize=True)
                de = np.einsum("bf,jef->bfje", da, self.p["w"], optimize=True)
                g["e"] = np.zeros_like(self.p["e"])
                np.add.at(g["e"], seen.ravel(), de.reshape(-1, EMBEDDING))
                g["e"][0] = 0
                t += 1
                rate = RATE * (1 if epoch < EPOCHS - 2 else 0.3)
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)

    def tables(self) -> list[np.ndarray]:
        """For each pair of neighbouring filter bytes, the sum of their contributions by the value of the pair."""
        one = [self.p["e"] @ self.p["w"][j] for j in range(WIDTH)]
        return [(one[j][:, None] + one[j + 1][None, :]).reshape(65536, FILTERS).astype(np.float32) for j in range(0, WIDTH, 2)]

    def score(self, texts: list[bytes], tables: list[np.ndarray]) -> np.ndarray:
        """Probability of label 1 of each whole text."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        sizes = np.array([padded(t) for t in texts])
        buffer = np.frombuffer(b"".join(t.ljust(n, b"\0") for t, n in zip(texts, sizes, strict=True)) + bytes(WIDTH), dtype=np.uint8)
        pairs = buffer[:-1].astype(np.uint16) << 8 | buffer[1:]
        total = int(sizes.sum())
        across = np.sort((np.cumsum(sizes)[:, None] - np.arange(1, WIDTH)).ravel())  # windows that would reach into the next document; of their own they see zeros
        blocks = np.empty((total // BLOCK, FILTERS), dtype=np.float32)
        for s in range(0, total, SLAB):
            e = min(total, s + SLAB)
            acc = tables[0][pairs[s:e]]
            for j in range(1, WIDTH // 2):
                acc += tables[j][pairs[s + 2 * j : e + 2 * j]]
            low, high = np.searchsorted(across, (s, e))
            acc[across[low:high] - s] = 0
            blocks[s // BLOCK : e // BLOCK] = acc.reshape(-1, BLOCK, FILTERS).max(axis=1)
        n = sizes // BLOCK
        first = np.cumsum(n) - n
        inner = np.ones(len(blocks), dtype=bool)
        inner[first + n - 1] = False  # a chunk is a block and the next one of the same document
        at = np.flatnonzero(inner)
        left = np.repeat([len(t) for t in texts], n) - (np.arange(len(blocks)) - np.repeat(first, n)) * BLOCK  # bytes from here to the end
        _, _, z = self._head(np.maximum(blocks[at], blocks[at + 1]) + self.p["b"], np.clip(left[at] / (2 * BLOCK), 0, 1))
        return 1 / (1 + np.exp(-(np.add.reduceat(z, first - np.arange(len(n))) / (n - 1)).astype(np.float64)))


def with_fragments(x: np.ndarray, y: np.ndarray, weight: np.ndarray, share: float = 0.3, longest: int = 80, seed: int = 11) -> tuple[np.ndarray, ...]:
    """Chunks and, for a share of them, a copy cut off after 1 to ``longest`` bytes, so that being short is no sign of either label."""
    rng = np.random.default_rng(seed)
    at = np.flatnonzero(rng.random(len(x)) < share)
    short = x[at].copy()
    short[np.arange(x.shape[1])[None, :] >= rng.integers(1, longest, len(short))[:, None]] = 0
    return np.concatenate([x, short]), np.concatenate([y, y[at]]), np.concatenate([weight, weight[at]])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", divisor: int = 5, remainder: int = 0, rows: int = SAMPLE_ROWS) -> Network:
    """Network from about ``rows`` labelled documents outside crc32(doc_id) mod ``divisor`` = ``remainder``, all chunks of which come to the driver.

    Without labelled documents the network answers 0.5, with labels of one kind their value drawn to 0.5 by one example each.
    """
    small_batches(docs.sparkSession)
    sample = labelled_sample(docs.select("doc_id", "text"), labels, label, divisor, remainder, rows).select("doc_id", "text", "_label")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(i, c, y, len(chunks)) for i, t, y in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), b.column("_label").to_pylist(), strict=True) for chunks in [chunks_of(t or b"")] for c in chunks]
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.int32(), pa.int32()))], ["doc_id", "chunk", "label", "of"])

    got = sample.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(take, "doc_id long, chunk binary, label int, of int").toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("chunk", "ascending")])
    y = (got.column("label").to_numpy() > 0).astype(np.float32)
    weight = 1 / np.maximum(1, got.column("of").to_numpy())
    net = Network(float((y * weight).sum() / weight.sum()) if len(y) else 0.5)
    if not len(y) or y.min() == y.max():
        ones, documents = (float(round((v * weight).sum())) for v in (y, np.ones(len(y))))
        net.constant = (ones + 1) / (documents + 2)
        return net
    x = np.frombuffer(b"".join(c.ljust(2 * BLOCK + WIDTH - 1, b"\0") for c in got.column("chunk").to_pylist()), dtype=np.uint8).reshape(len(y), -1)
    net.fit(*with_fragments(x, y, weight / weight.mean()))
    return net


def predict(docs: DataFrame, net: Network, keep: list[str], text: str = "text", out: str = "score") -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``out``, the score; null texts count as empty, and empty texts are scored like any other. A column named as ``out`` is replaced."""
    small_batches(docs.sparkSession)
    keep = [c for c in keep if c != out]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables()
        for batch in batches:
            texts = [t or b"" for t in batch.column(text).cast(pa.binary()).to_pylist()]
            scores: list[float] = []
            part, size = [], 0
            for t in texts:
                part.append(t)
                size += len(t)
                if size > 4 << 20:
                    scores += net.score(part, tables).tolist()
                    part, size = [], 0
            if part:
                scores += net.score(part, tables).tolist()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(scores, pa.float64())], [*keep, out])

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)
