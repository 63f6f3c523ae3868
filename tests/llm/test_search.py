"""Decontamination, repeats and near-duplicates against brute force, and their edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperlake.llm import decontam, minhash, rlbwt
from paperlake.llm.components import components
from paperlake.llm.fmindex import FMIndex, WaveletMatrix, suffix_array


def test_suffix_array_and_index():
    rng = np.random.default_rng(1)
    for _ in range(100):
        t = rng.integers(0, 4, rng.integers(1, 60))
        assert suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
        w = WaveletMatrix(t, 2)
        for c in range(4):
            assert [int(w.rank(np.array([c]), np.array([i]))[0]) for i in range(len(t) + 1)] == [int((t[:i] == c).sum()) for i in range(len(t) + 1)]
        f = FMIndex(t, 3, 4)
        for m in (1, 2, 3):
            p = rng.integers(1, 4, (5, m))
            low, high = f.search(p)
            for i in range(5):
                assert sorted(f.locate(np.arange(low[i], high[i])).tolist()) == [a for a in range(len(t) - m + 1) if (t[a : a + m] == p[i]).all()]


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(t):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))


def contaminated(docs, items, n):
    out = {}
    phrases = {}
    for i, t in items:
        w = fold(t)
        m = min(n, len(w))
        for k in range(len(w) - m + 1) if m else ():
            phrases.setdefault(tuple(w[k : k + m]), set()).update([str(i)] if i is not None else [])
    sizes = {len(p) for p in phrases}
    for d, t in docs:
        w, hit, found = fold(t), set(), set()
        for m in sizes:
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in phrases:
                    hit |= set(range(k, k + m))
                    found |= phrases[tuple(w[k : k + m])]
        out[d] = (len(w), hit, sorted(found))
    return out


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_decontamination(spark, block):
    rng = random.Random(4)
    v = ["a", "B", "c1", "é", "dd"]
    items = [(i, " ".join(rng.choice(v) for _ in range(rng.randint(0, 9)))) for i in range(12)] + [(50, "solo"), (51, None), (None, "a a"), (7, "B c1 é"), (7, "B c1 é"), (None, "zz zz zz zz a")]
    docs = [(i, ", ".join(rng.choice([*v, "zz", "solo"]) for _ in range(rng.randint(0, 60)))) for i in range(60)] + [(900, None), (901, ""), (902, "solo"), (903, "a " * 5000), (902, "solo")]
    df = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, spans int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = contaminated(docs, items, 5)
    got = decontam.find(df, bench, keep=["doc_id"], n=5, block_bytes=block).collect()
    assert {r["doc_id"]: (r["n_words"], {p for s in r["spans"] for p in range(s["start"], s["end"])}, r["items"]) for r in got} == expected
    assert decontam.find(df, bench.limit(0), keep=["doc_id"]).where("size(spans) > 0").count() == 0
    assert decontam.find(df.limit(0), bench).count() == 0


def test_removal(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id int, text string")
    df = spark.createDataFrame([(1, "Keep this. One, two; THREE! And that."), (2, "one two three"), (3, None)], "doc_id int, text string")
    assert {r["doc_id"]: r["text"] for r in decontam.remove(df, bench).collect()} == {1: "Keep this. ! And that.", 3: None}
    more = df.withColumns({"spans": F.lit("x"), "items": F.lit(1), "n_words": F.lit(True), "spans_so_far": F.lit(2.5)})
    bench = bench.union(spark.createDataFrame([(None, "keep this"), (4, "and that")], bench.schema))
    got = decontam.remove(more, bench, block_bytes=10)
    assert got.columns == more.columns and sorted((r["doc_id"], r["text"], r["spans"], r["items"], r["n_words"], r["spans_so_far"]) for r in got.collect()) == [(3, None, "x", 1, True, 2.5)]


def test_matching_statistics():
    rng = random.Random(1)
    for _ in range(100):
        t = [rng.choice([1, 2, 3]) for _ in range(rng.randint(2, 50))]

        def lcp(i, j, t=t):
            k = 0
            while max(i, j) + k < len(t) and t[i + k] == t[j + k]:
                k += 1
            return k

        got = rlbwt.RunLengthIndex(np.array(t, dtype=np.int16)).matching_statistics()
        assert got.tolist() == [max(lcp(i, j) for j in range(len(t)) if j != i) for i in range(len(t))]


def repeats(texts, length):
    c = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        m = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if c[t[i : i + length]] > 1:
                m[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(m)) if m[i] and (i == 0 or not m[i - 1]))
        out.append((len(t), sum(m), runs, hashlib.sha256(bytes(b for b, k in zip(t, m, strict=True) if not k)).hexdigest()))
    return out


@pytest.mark.parametrize("most", [4000, 3])
def test_repeats(spark, most):
    rng = random.Random(1)
    docs = [(i, "".join(rng.choice(["ab", "cd", "e", "fgh", "ij é"]) for _ in range(rng.randint(0, 60)))) for i in range(60)] + [(None, None), (None, "x" * 100), (3, "ab" * 30), (3, "ab" * 30), (4, "")]
    base = "".join(rng.choice("abcdefgh") for _ in range(50))
    noise = lambda: "".join(rng.choice("xyz") for _ in range(rng.randint(0, 30)))
    docs += [(100 + i, noise() + base[rng.randint(0, 5) : rng.randint(40, 50)] + noise()) for i in range(80)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, spans int")
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in rlbwt.remove_repeats(df, length=20, most=most).collect())
    assert got == sorted((str(i), *b) for (i, _), b in zip(docs, repeats([(t or "").encode() for _, t in docs], 20), strict=True))


def test_repeats_in_whole_table(spark, sf_dir):
    from paperlake.llm.queries import op6_repeats

    docs = [(r["doc_id"], (r["text"] or "").encode()) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    expected = {i: b for (i, _), b in zip(docs, repeats([t for _, t in docs], 400), strict=True)}
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in op6_repeats(spark, sf_dir).collect()} == expected


def test_repeats_empty(spark):
    assert rlbwt.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def near(docs, percent=85):
    def shingles(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or "")) if x]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = [(i, shingles(t)) for i, t in docs if i is not None]
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                ra, rb = sorted((find(a), find(b)))
                up[rb] = ra
    n = defaultdict(int)
    for i, s in sets:
        n[i] = max(n[i], len(s))
    return {i: (n[i], find(i)) for i, _ in sets}


def edited(rng, words, k):
    out = list(words)
    for _ in range(k):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return " ".join(out)


def test_near_duplicates(spark):
    rng = random.Random(8)
    docs, i = [], 0
    for _ in range(6):  # families with edits from none to too many, some without the text they come from
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(60, 200))]
        for _ in range(40):
            docs.append((i, edited(rng, base, rng.randint(0, 6))))
            i += 1
    docs += [(1000, ""), (1001, None), (1002, "Short one"), (1003, "short  ONE"), (1004, "\t"), (None, "short one"), (1005, " ".join(f"v{k}" for k in range(30000)))]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n int")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df).collect() if r["doc_id"] is not None}
    assert got == near(docs)
    alone = [r for r in minhash.near_duplicates(df).collect() if r["doc_id"] is None]
    assert len(alone) == 1 and alone[0]["kept"] and alone[0]["component_id"] is None
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_circulant_is_a_minhash():
    c = minhash.Circulant()
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    a, b = x[:900], x[100:]
    agree = (c.signature(a) == c.signature(b)).mean()
    assert abs(agree - 0.8) < 0.12


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100 + k, 101 + k) for k in range(40)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        ra, rb = sorted((find(a), find(b)))
        up[rb] = ra
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up if any(x in e and e[0] != e[1] for e in edges)}


def test_components_of_a_long_chain(spark):
    ids = list(range(7, 3007))
    random.Random(6).shuffle(ids)
    got = components(spark.createDataFrame([*zip(ids, ids[1:], strict=False), (1, 2)], "a long, b long")).collect()
    assert {r["id"]: r["component"] for r in got} == {1: 1, 2: 1} | dict.fromkeys(ids, 7) and len(got) == 3002


def test_clusters_in_blocks(spark, monkeypatch):
    """Families without the text they come from, compared in blocks far smaller than they are."""
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 700)
    rng = random.Random(4)
    docs, i = [], 0
    for _ in range(3):
        base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        for _ in range(60):
            docs.append((i, edited(rng, base, rng.randint(1, 5))))
            i += 1
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df).collect()} == near(docs)


def test_joined_against_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(40):
        sets = [np.unique(rng.integers(0, 30, rng.integers(1, 25)).astype(np.uint64)) for _ in range(12)]
        for left in (12, 5):
            pairs = [(x, y) for x in range(12) for y in range(x) if (left == 12 or (x >= left) != (y >= left)) and minhash.linked(sets[x], sets[y], 60)]
            up = list(range(12))
            for _ in range(12):
                for x, y in pairs:
                    up[x] = up[y] = min(up[x], up[y])
            assert minhash.joined(sets, left, 60).tolist() == up
