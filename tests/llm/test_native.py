"""URL filters, fingerprints, mixing and line dedup against brute force, and their edge cases."""

import hashlib
import random
import re

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperlake.llm import linededup, mixing, urlrules, winnow
from paperlake.llm.queries import RULES


def rules_of(spark, rules):
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def judge_one(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fit = [(len(h + p), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best[2] if best else None, best[1] if best else default


def test_urls_brute_force(spark):
    rng = random.Random(3)
    hosts = ["net", "a.net", "b.a.net", "com", "x.com", "xnet", "example.net", "www.example.net", "org", "q.org", "", "a..net", ".net"]
    paths = ["/", "", "/en/", "/en/x", "/e", "/de/y?z=/en/", "/fr/#x", "?q", "#f"]
    urls = [None, "", "nothing", "://", "HTTP://A.NET/en/"] + [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(300)]
    rules = [*RULES, ("a.net", "/en/", "block"), ("b.a.net", "/", "allow"), ("com", "/de/", "allow"), ("x.com", "/de/y", "block"), ("net", "/", "allow")]
    df = spark.createDataFrame([(i, u, "keep", "mine") for i, u in enumerate(urls)], "page_id int, url string, extra string, rule string")
    got = urlrules.judge(df, rules_of(spark, [*rules, (None, "/", "block")]), salts=3)
    assert got.columns == ["page_id", "url", "extra", "host", "path", "rule", "verdict"]
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()} == {i: judge_one(u, rules) for i, u in enumerate(urls)}


def test_urls_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, "http://a.net/"), (1, "http://a.net/")], "page_id int, url string")
    assert urlrules.judge(df, rules_of(spark, RULES)).count() == 2
    assert urlrules.judge(df.limit(0), rules_of(spark, RULES)).count() == 0
    assert [r["verdict"] for r in urlrules.judge(df, rules_of(spark, []), default="block").collect()] == ["block"] * 2


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def spark_hash(values, seed=42):
    for v in values:
        seed = xxhash.xxh64(v if isinstance(v, bytes) else v.to_bytes(8, "little", signed=True), seed=seed).intdigest()
        seed = signed(seed) & (1 << 64) - 1
    return signed(seed)


def winnow_one(text, k=winnow.K, w=winnow.W):
    h = [spark_hash([t.encode()]) for t in re.findall(r"\S{1,12}", (text or "").lower())]
    if not h:
        return []

    def value(part):
        total = 0
        for x in part:
            total = total << 1 ^ x & (1 << 64) - 1
        return (total & (1 << 64) - 1) >> 33

    top = [value(h)] if len(h) < k else [value(h[i : i + k]) for i in range(len(h) - k + 1)]
    picks = []
    for i in range(max(1, len(top) - w + 1)):
        part = top[i : i + w]
        at = i + max(j for j, x in enumerate(part) if x == min(part))
        if at not in picks:
            picks.append(at)
    return [f"{top[p]:x}:{p}" for p in picks]


def test_fingerprints_brute_force(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "Delta", "é", "a" * 30, "x"]
    texts = {i: " ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for i in range(0, 60, 2)} | {-5: None, 1000: "", 1001: "ab", 999: "same text here now", 998: "same text here now"}
    texts[2000] = " ".join(rng.choice(words) for _ in range(3000))
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, fp string")
    docs = winnow.with_next(df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", ["text"], "text", per_bucket=7)
    order = sorted(texts, reverse=True)
    nxt = {a: b for a, b in zip(order, order[1:] + order[:1], strict=True)}
    assert {r["doc_id"]: r["next_text"] for r in docs.collect()} == {i: texts[nxt[i]] or "" for i in texts}
    got = {r["doc_id"]: r for r in winnow.edited_fingerprints(df).collect()}
    assert len(got) == len(texts)
    for i, t in texts.items():
        t, n = t or "", texts[nxt[i]] or ""
        m = len(t) // 3
        edited = t[: len(t) - m] + n[:m]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"].split() == winnow_one(t) and r["edited_fingerprint"].split() == winnow_one(edited)
        a, b = ({x.split(":")[0] for x in winnow_one(x)} for x in (t, edited))
        assert r["near_edited"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
    assert got[999]["fingerprint"] == got[998]["fingerprint"] and got[999]["near_next"] == 1.0


@pytest.mark.parametrize(("per_bucket", "most"), [(7, 16384), (7, 3), (1000, 16384)])
def test_next_of_repeated_ids(spark, per_bucket, most):
    """A third of the rows without an id and a third of one id: the next rows make one circle through all, ids falling."""
    rng = random.Random(8)
    rows = [(None if i % 3 == 0 else 50 if i % 3 == 1 else rng.randint(-90, 190) * 2 + 1, f"t{i}") for i in range(150)]
    df = winnow.with_next(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", ["text"], "text", per_bucket, most)
    got = {r["text"]: (r["doc_id"], r["next_text"]) for r in df.collect()}
    assert len(got) == 150
    key = lambda t: -(1 << 63) if got[t][0] is None else got[t][0]
    at, seen, rises = "t2", [], 0
    while at not in seen:
        seen.append(at)
        rises += key(got[at][1]) > key(at)
        at = got[at][1]
    assert at == "t2" and len(seen) == 150 and rises == 1


def test_fingerprints_small_tables(spark):
    schema = "doc_id long, text string"
    assert winnow.edited_fingerprints(spark.createDataFrame([], schema)).count() == 0
    one = winnow.edited_fingerprints(spark.createDataFrame([(7, "abcdefghi")], schema)).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdefabc").hexdigest() and one["near_next"] == 1.0
    twins = winnow.edited_fingerprints(spark.createDataFrame([(7, "a b"), (7, "a b"), (None, "c")], schema))
    assert twins.count() == 3


def test_fingerprints_of_unspaced_text(spark):
    """One inserted character leaves the picks of all windows without it."""
    rng = random.Random(7)
    for first, last in ((0x4E00, 0x9FA5), (0x3041, 0x3096), (0x0E01, 0x0E2E)):
        t = "".join(chr(rng.randint(first, last)) for _ in range(3000))
        rows = [(t, e) for e in (chr(first) + t, t[:1500] + chr(first) + t[1500:])]
        df = winnow.fingerprint(winnow.fingerprint(spark.createDataFrame(rows, "a string, b string"), "a", "x"), "b", "y")
        assert min(r[0] for r in df.select(winnow.likeness("x", "y")).collect()) > 0.95


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), min_size=1, max_size=8), st.floats(0, 1))
def test_knapsack_is_the_best(counts, share):
    """Against every sum that can be made."""
    import numpy as np

    lengths, n = np.array(sorted(counts)), np.array([counts[k] for k in sorted(counts)])
    budget = int((lengths * n).sum() * share)
    sums = {0}
    for a, c in zip(lengths.tolist(), n.tolist(), strict=True):
        sums = {x + a * k for x in sums for k in range(c + 1)}
    take = mixing.knapsack(lengths, n, budget)
    assert (take >= 0).all() and (take <= n).all() and (lengths * take).sum() == max(x for x in sums if x <= budget)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), min_size=1, max_size=8), st.floats(0, 1))
def test_fit_is_near_the_best(counts, share):
    import numpy as np

    lengths, n = np.array(sorted(counts)), np.array([counts[k] for k in sorted(counts)])
    total = int((lengths * n).sum())
    budget = int(total * share)
    take = mixing.fit(lengths, n, budget)
    assert (take >= 0).all() and (take <= n).all() and (lengths * take).sum() <= budget
    assert budget - (lengths * take).sum() <= max(lengths)


def levels(sizes, weights=(1, 2, 3), cap=3):
    """Targets by resharing again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    target, open_, rest = {}, set(order), float(sum(sizes.values()))
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if rest * w[s] / total > cap * sizes[s]}
        if not over:
            return target | {s: rest * w[s] / total for s in open_}
        for s in over:
            target[s] = float(cap * sizes[s])
        rest -= sum(cap * sizes[s] for s in over)
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 1, "c": 5, None: 50}, {"a": 10}, {"a": 1, "b": 1, "c": 400, "d": 3, "e": 0}, {"a": 10, "b": 20, "c": 30}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    assert {r["source"]: pytest.approx(r["target"]) for r in mixing.targets(df).collect()} == levels(sizes)


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "b", "c", None]), " ".join(["w"] * rng.randint(0, 12))) for i in range(400)] + [(400 + i, "a", "five words of one length") for i in range(300)] + [(900, "z", None), (None, "z", "x y")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, size int")
    got = mixing.mix(df, slices=4).collect()
    assert len(got) == len(rows)
    for s in ("a", "b", "c", None):
        own = [r for r in got if r["source"] == s]
        assert all(0 <= r["copies"] <= 3 for r in own) and own[0]["source_size"] == sum(r["size"] for r in own)
        assert abs(sum(r["size"] * r["copies"] for r in own) - own[0]["target"]) <= 12
    again = mixing.mix(df.repartition(7), slices=4).collect()
    assert sorted((r["doc_id"] or -1, r["copies"]) for r in got) == sorted((r["doc_id"] or -1, r["copies"]) for r in again)
    assert mixing.mix(df.limit(0)).count() == 0


def without_common_lines(rows, ratio, copies):
    """Texts and dropped lines by brute force."""
    pages = [(s, t) for _, s, t in rows if t is not None]
    pages = pages if copies else list(dict.fromkeys(pages))
    bare = lambda t: {x.strip(" \t\r") for x in t.split("\n")} - {""}
    out = []
    for i, s, t in rows:
        own = [p for x, p in pages if x == s]
        common = {x for x in bare(t or "") if sum(x in bare(p) for p in own) - 1 > ratio * (len(own) - 1)}
        left = None if t is None else [x for x in t.split("\n") if x.strip(" \t\r") not in common]
        out.append((str(i), None if t is None else "\n".join(left), 0 if t is None else t.count("\n") + 1, 0 if t is None else t.count("\n") + 1 - len(left)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("ratio", "copies"), [(0.5, False), (0.5, True), (0.05, True), (0.05, False), (0.0, True)])
def test_line_dedup(spark, ratio, copies):
    rows = [(i, "s", f"menu\n  unique {i}\nmore {i % 9}") for i in range(20)] + [(100 + i, "s", "copy one\ncopy two") for i in range(20)]
    rows += [(200, "t", "menu\nother"), (201, None, "menu"), (202, "s", None), (203, "s", " menu \n"), (204, "s", ""), (205, None, "menu\nmenu"), (206, "null only", None), (None, "s", "menu"), (200, "t", "menu\nother"), (207, "u", "long line " * 100_000 + "\nshort")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id int, source string, text string, n_lines int")
    got = linededup.drop_lines(df, ratio=ratio, copies=copies)
    assert sorted(((str(r["doc_id"]), r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()), key=str) == without_common_lines(rows, ratio, copies)
    assert got.columns == ["doc_id", "source", "text", "n_lines", "n_dropped"] and linededup.drop_lines(df.limit(0)).count() == 0
