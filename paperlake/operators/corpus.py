"""Corpus quality: identity, exact and fuzzy deduplication, scores, quota fill, audits, catalog."""

from __future__ import annotations

import math
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlake.functions import numeric as N
from paperlake.functions import text as X
from paperlake.operators.order import written

# Weights of the quality components, and quotas of the fill.
WEIGHTS = {"relevance": 0.30, "completeness": 0.20, "abstract_quality": 0.15, "citation_signal": 0.10, "recency": 0.10, "fulltext_likelihood": 0.15}
QUOTAS = {"review": 0.10, "classic": 0.20, "recent": 0.20}
NEAR_TITLE, NEAR_LENGTH = 0.94, 24


def _s(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))


def identity(normalize: bool = True) -> Column:
    """doi:<doi>, else title:<folded title>, else null."""
    d, t = X.doi(F.col("doi")), X.title_key(F.col("title"), normalize)
    return F.when(d != "", F.concat(F.lit("doi:"), d)).when(t != "", F.concat(F.lit("title:"), t))


def richness() -> Column:
    has = lambda c, n: F.when(_s(c).isin("", "0"), 0).otherwise(n)
    return F.length(F.coalesce("abstract", F.lit(""))) + has("doi", 80) + has("venue", 20) + has("year", 10)


def deduplicate(papers: DataFrame, ord_column: str = "ord", normalize: bool = True) -> DataFrame:
    """The richest record of each identity, the earliest of equally rich ones, with ``first_ord`` for the order of first appearance and
    ``copies``. Records without an identity fall away.

    Two aggregations instead of a window: the winner is found by a comparison of structs, which combines before the shuffle.
    """
    keyed = papers.withColumn("_key", identity(normalize)).where("_key IS NOT NULL")
    best = keyed.groupBy("_key").agg(F.max(F.struct(richness().alias("r"), (-F.col(ord_column)).alias("o"))).alias("m"), F.min(ord_column).alias("first_ord"), F.count(F.lit(1)).alias("copies"))
    best = best.select("_key", (-F.col("m.o")).alias(ord_column), "first_ord", "copies")
    return keyed.join(best, ["_key", ord_column]).withColumnRenamed("_key", "identity")


def deduplicate_seen(papers: DataFrame, seen: DataFrame, ord_column: str = "ord") -> DataFrame:
    """First paper of each key (doi, else lower-cased title) that is not among the keys seen (one column: key)."""
    key = F.coalesce(F.nullif(X.doi(F.col("doi")), F.lit("")), F.nullif(F.lower(_s("title")), F.lit("")))
    keyed = papers.withColumn("_key", key).where("_key IS NOT NULL").join(seen.select(F.col("key").alias("_key")).distinct(), "_key", "left_anti")
    first = keyed.groupBy("_key").agg(F.min(ord_column).alias(ord_column))
    return keyed.join(first, ["_key", ord_column]).withColumnRenamed("_key", "key")


def longest_block(a: str, b: str) -> tuple[int, int, int]:
    """Where the longest block of two texts starts in each, and its length; the earliest in a, then in b, as difflib takes it."""
    if len(a) * len(b) <= 20_000:
        return tuple(SequenceMatcher(None, a, b, autojunk=False).find_longest_match())
    step, link, size, end = [{}], [-1], [0], [0]  # suffix automaton of b; end is where a state's texts end first
    last = 0
    for j, ch in enumerate(b, 1):
        new = len(size)
        step.append({}), link.append(0), size.append(j), end.append(j)
        p, last = last, new
        while p >= 0 and ch not in step[p]:
            step[p][ch] = new
            p = link[p]
        if p >= 0:
            q = step[p][ch]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                copy = len(size)
                step.append(step[q].copy()), link.append(link[q]), size.append(size[p] + 1), end.append(end[q])
                link[new] = link[q] = copy
                while p >= 0 and step[p].get(ch) == q:
                    step[p][ch] = copy
                    p = link[p]
    state = n = best = i_end = j_end = 0
    for i, ch in enumerate(a, 1):
        while state and ch not in step[state]:
            state = link[state]
            n = size[state]
        if ch in step[state]:
            state = step[state][ch]
            n += 1
            if n > best:
                best, i_end, j_end = n, i, end[state]
    return i_end - best, j_end - best, best


def common_letters(a: str, b: str) -> int:
    """Length of the longest common subsequence, a column of it in the bits of one number."""
    start = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    a, b = a[start:], b[start:]
    stop = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b), strict=False)) if x != y), min(len(a), len(b)))
    a, b = a[: len(a) - stop], b[: len(b) - stop]
    at: dict[str, int] = {}
    for ch in set(a) & set(b):
        at[ch] = int("".join("1" if x == ch else "0" for x in reversed(a)), 2)
    full = (1 << len(a)) - 1
    free = full
    for ch in b:
        if m := at.get(ch):
            u = free & m
            free = ((free + u) | (free - u)) & full
    return start + stop + len(a) - free.bit_count()


def near_titles(a: str, b: str, threshold: float = NEAR_TITLE) -> bool:
    """Ratcliff-Obershelp likeness of folded titles of at least 24 characters.

    Lengths, letters and the longest common subsequence rule most pairs out; of the others as many blocks are taken, as difflib takes them, as decide.
    """
    both = len(a) + len(b)
    if min(len(a), len(b)) < NEAR_LENGTH:
        return False
    like = lambda m: 2.0 * m / both >= threshold
    if not (like(min(len(a), len(b))) and SequenceMatcher(None, a, b, autojunk=False).quick_ratio() >= threshold and like(common_letters(a, b))):
        return False
    found, may, open_ = 0, min(len(a), len(b)), [(a, b)]  # characters in blocks, and those that can still come to lie in them
    while not like(found):
        if not open_ or not like(found + may):
            return False
        x, y = open_.pop(max(range(len(open_)), key=lambda k: len(open_[k][0])))
        i, j, n = longest_block(x, y)
        may -= min(len(x), len(y))
        found += n
        for rest in ((x[:i], y[:j]), (x[i + n :], y[j + n :])) if n else ():
            if rest[0] and rest[1]:
                open_.append(rest)
                may += min(len(rest[0]), len(rest[1]))
    return True


def sent(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is shuffled and sorted and never sent whole through the driver.

    Spark takes a title's many grams for one row, and a packed file's bytes for those of its rows, so what it finds below its threshold can be of any size.
    """
    return df.hint("merge")


def slot_length(threshold: float) -> int:
    """The most characters of a slot of which a title has more than the letters that a near one can change."""
    fits = [q for q in range(1, 9) if all(n // q > int(2 * (1 - threshold) * n + 1e-9) for n in range(NEAR_LENGTH, 4000))]
    if not fits:
        raise ValueError(f"no filter for a likeness of {threshold}")
    return fits[-1]


def title_grams(titles: DataFrame, n: int, step: int, within: list[str]) -> DataFrame:
    """ord, len, c (class of length), p and g: a hash of the n letters from p on, for every step-th p, and of the ``within`` columns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, rows = [], 0
        for pdf in batches:
            for o, t, w in zip(pdf["ord"], pdf["title_key"], pdf["w"], strict=True):
                codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
                g = np.full(len(codes) - n + 1, np.int64(w).astype(np.uint64))
                for k in range(n):
                    g = (g ^ codes[k : k + len(g)]) * np.uint64(0x9E3779B97F4A7C15)
                    g ^= g >> np.uint64(29)
                p = np.arange(0, len(g), step, dtype=np.int32)
                parts.append((np.full(len(p), o), np.full(len(p), len(codes), np.int32), p, g[::step].view(np.int64) if step == 1 else g[::step].copy().view(np.int64)))
                rows += len(p)
                if rows > 500_000:
                    yield pd.DataFrame(dict(zip(("ord", "len", "p", "g"), map(np.concatenate, zip(*parts, strict=True)), strict=True)))
                    parts, rows = [], 0
        if parts:
            yield pd.DataFrame(dict(zip(("ord", "len", "p", "g"), map(np.concatenate, zip(*parts, strict=True)), strict=True)))

    w = F.xxhash64(*within) if within else F.lit(0).cast("long")
    return titles.where(F.length("title_key") >= NEAR_LENGTH).select(F.col("ord").cast("long"), "title_key", w.alias("w")).mapInPandas(run, "ord long, len int, p int, g long")


def like_pairs(titles: DataFrame, threshold: float = NEAR_TITLE, within: list[str] | None = None) -> DataFrame:
    """a and b (ord of the earlier and the later one) of all titles that can be near, near ones among them, found by slots.

    Two near titles of s letters together have at most (1 - threshold) * s letters out of their common blocks, and a letter spoils one slot of the longer title at most. Of any
    slots of it, more than it has such letters, the rest stand in the shorter one, moved by no more than the letters that either has too many.
    The rarest slots are taken, some more for long titles, which need as many more then.
    """
    within = within or []
    q, shortest = slot_length(threshold), threshold / (2 - threshold)  # the shorter of two near titles, as a share of the longer
    spoilt = F.floor(F.col("len") * (2 * (1 - threshold)) + 1e-9)
    length_class = F.floor(F.ln("len") / math.log(1.01 / shortest)).cast("int")  # near ones are one class apart at most
    slots = written(title_grams(titles, q, q, within).where(F.col("p") + q <= F.col("len")))
    rank = F.row_number().over(Window.partitionBy("ord").orderBy("df", "g", "p"))
    rare = slots.join(sent(slots.groupBy("g").agg(F.count(F.lit(1)).alias("df"))), "g").withColumn("rank", rank)
    taken = F.least(spoilt + 1 + F.floor(F.col("len") / 50), F.floor(F.col("len") / q))
    rare = rare.where(F.col("rank") <= taken).select(F.col("ord").alias("x"), F.col("len").alias("xl"), F.col("p").alias("xp"), "g", F.explode(F.array(length_class, length_class - 1)).alias("c"), (taken - spoilt).alias("need"))
    matched = F.ceil((F.col("xl") + F.col("len")) * (threshold / 2) - 1e-9)
    longer = (F.col("xl") > F.col("len")) | ((F.col("xl") == F.col("len")) & (F.col("x") < F.col("ord")))
    moved = (F.col("p") - F.col("xp")).between(matched - F.col("xl"), F.col("len") - matched)
    hits = title_grams(titles, q, 1, within).withColumn("c", length_class).join(sent(rare), ["g", "c"]).where(longer & (F.col("len") >= F.lit(shortest - 1e-9) * F.col("xl")) & moved)
    pairs = hits.groupBy("x", "ord", "need").agg(F.count(F.lit(1)).alias("n")).where("n >= need")
    return pairs.select(F.least("x", "ord").alias("a"), F.greatest("x", "ord").alias("b"))


def near_of(pairs: DataFrame, titles: DataFrame, threshold: float = NEAR_TITLE, within: list[str] | None = None) -> DataFrame:
    """Those of the pairs whose titles are near."""
    within = within or []
    side = lambda o, t: titles.select(F.col("ord").alias(o), F.col("title_key").alias(t), *(F.col(c).alias(f"{t}_{c}") for c in within))
    texts = pairs.join(sent(side("a", "x")), "a").join(sent(side("b", "y")), "b")
    for c in within:
        texts = texts.where(F.col(f"x_{c}").eqNullSafe(F.col(f"y_{c}")))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.loc[[near_titles(y, x, threshold) for x, y in zip(pdf.x, pdf.y, strict=True)], ["a", "b"]]

    cores = titles.sparkSession.sparkContext.defaultParallelism
    return texts.select("a", "b", "x", "y").repartition(4 * cores).mapInPandas(verify, "a long, b long")


def near_pairs(titles: DataFrame, threshold: float = NEAR_TITLE, within: list[str] | None = None) -> DataFrame:
    """a and b (ord of the earlier and the later one) of near titles: all that an election in order needs.

    Pairs with a title that no open earlier one can be near to are compared first: it leads. Then pairs of followers need no comparison, but with earlier ones than
    the leader found. What is left after some rounds, or is little, is compared as a whole.
    """
    open_, near = written(like_pairs(titles, threshold, within)), []
    few = 4 * titles.count()
    for _ in range(6):
        if open_.count() <= few:
            break
        first = written(open_.select(F.col("a").alias("o")).distinct().join(sent(open_.select(F.col("b").alias("o")).distinct()), "o", "left_anti"))
        found = written(near_of(open_.join(sent(first), F.col("a") == F.col("o"), "left_semi"), titles, threshold, within))
        near.append(found)
        led = sent(found.groupBy(F.col("b").alias("o")).agg(F.min("a").alias("led")))
        rest = open_.join(sent(first), F.col("a") == F.col("o"), "left_anti").join(led, F.col("a") == F.col("o"), "left_anti")
        open_ = written(rest.join(led, F.col("b") == F.col("o"), "left").where("led IS NULL OR a < led").select("a", "b"))
    near.append(near_of(open_, titles, threshold, within))
    return reduce(DataFrame.unionByName, near)


def fuzzy_titles(titles: DataFrame, threshold: float = NEAR_TITLE, within: list[str] | None = None) -> DataFrame:
    """ord, title_key and leader: in order, each DOI-less title (ord, title_key) joins the earliest leader that it is near to, or leads.

    Exact copies meet first; ``within`` names further columns that must be equal. The election runs in rounds over the near pairs: a title whose earlier near ones are
    all followers leads, one with an earlier leader near it follows. In every round at least the earliest open title of each group of near titles is settled.
    """
    keyed = written(titles.where("coalesce(title_key, '') <> ''").groupBy("title_key", *(within or [])).agg(F.min("ord").alias("ord")))
    pairs = written(near_pairs(keyed, threshold, within))
    open_ = written(pairs.select(F.col("b").alias("o")).distinct())  # a title that no earlier one is near to leads
    leads = written(pairs.select(F.col("a").alias("o")).distinct().join(sent(open_), "o", "left_anti"))
    followers = written(open_.limit(0))
    while not open_.isEmpty():
        led = pairs.join(sent(leads), F.col("a") == F.col("o"), "left_semi").select(F.col("b").alias("o")).distinct().join(sent(open_), "o", "left_semi")
        followers = written(followers.unionByName(led))
        rest = written(open_.join(sent(followers), "o", "left_anti"))
        waits = pairs.join(sent(rest.withColumnRenamed("o", "a")), "a", "left_semi").select(F.col("b").alias("o")).distinct()
        leads = written(rest.join(sent(waits), "o", "left_anti"))  # earlier leaders have been heard, only the new ones count in the next round
        open_ = written(rest.join(sent(leads), "o", "left_anti"))
    first = sent(pairs.join(sent(followers), F.col("a") == F.col("o"), "left_anti").groupBy("b").agg(F.min("a").alias("leader")))
    return keyed.join(first, F.col("ord") == F.col("b"), "left").select("ord", "title_key", F.coalesce("leader", "ord").alias("leader"))


def likelihood() -> Column:
    """Chance of getting the full text: 1, .75, .45, .15 or .1, from links, source and DOI. Needs is_oa, pdf_url, source, has_structured, doi."""
    d = X.doi(F.col("doi"))
    linked = (_s("pdf_url") != "") | F.coalesce("is_oa", F.lit(False)) | (F.contains(F.lower(_s("source")), F.lit("memory")) & F.coalesce("has_structured", F.lit(False)))
    return F.when(linked | d.startswith("10.48550/"), 1.0).when(d.endswith(".s001") | d.startswith("10.1007/978-"), 0.15).when(d.startswith("10.1016/"), 0.75).when(d != "", 0.45).otherwise(0.1)


def access_class() -> Column:
    return F.when(_s("pdf_url") != "", "download_ready").when(F.coalesce("is_oa", F.lit(False)), "metadata_only").otherwise("restricted")


def quality(papers: DataFrame, requirement: str, as_of_year: int, weights: dict[str, float] | None = None) -> DataFrame:
    """Papers with the six components, ``score`` (0 to 100, unrounded) and ``issues``."""
    w = WEIGHTS | {k: float(v) for k, v in (weights or {}).items() if k in WEIGHTS}
    total = sum(w.values()) or 1.0
    year, abstract = F.coalesce(N.to_int(F.col("year")), F.lit(0)), _s("abstract")
    citations = F.greatest(F.coalesce(N.to_int(F.col("citation_count")), F.lit(0)), F.lit(0))
    d = X.doi(F.col("doi"))
    flag = lambda c: c.cast("int")
    parts = {
        "relevance": X.token_overlap(requirement, F.concat_ws(" ", _s("title"), abstract)),
        "completeness": (flag(_s("title") != "") + flag(d != "") + flag(_s("venue") != "") + flag(year != 0) + flag(F.length(abstract) >= 120)) / 5.0,
        "abstract_quality": F.least(F.length(abstract) / 800.0, F.lit(1.0)),
        "citation_signal": F.least(F.log1p(citations.cast("double")) / F.log1p(F.lit(500.0)), F.lit(1.0)),
        "recency": F.when(year == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - F.greatest(F.lit(0), F.lit(as_of_year) - year) / 20.0)),
        "fulltext_likelihood": likelihood(),
    }
    issues = F.array_compact(F.array(F.when(d == "", "missing_doi"), F.when(F.length(abstract) < 120, "short_or_missing_abstract"), F.when(_s("venue") == "", "missing_venue"), F.when(year == 0, "missing_year")))
    return papers.withColumns(parts).withColumns({"score": 100 * sum((F.lit(w[k]) * F.col(k) for k in WEIGHTS), F.lit(0.0)) / F.lit(total), "issues": issues})


def bucket(as_of_year: int) -> Column:
    """review by a word of the title, else recent, classic or primary_other by the year."""
    year = F.coalesce(N.to_int(F.col("year")), F.lit(0))
    review = F.lower(_s("title")).rlike(r"(?U)\b(review|survey|perspective|roadmap)\b")
    return F.when(review, "review").when((year != 0) & (year >= as_of_year - 5), "recent").when((year != 0) & (year <= as_of_year - 10), "classic").otherwise("primary_other")


def quota_fill(selected: DataFrame, candidates: DataFrame, target: int, floor: float, as_of_year: int, quotas: dict[str, float] | None = None) -> DataFrame:
    """Candidates taken to bring a selection up to ``target``: first to quotas of the buckets, in their order, then the best of all.

    Both frames: identity, source, year, title, score, ord. A candidate's rank is its score and a bonus for sources and decades that are rare in the selection as it was. The answer has at most ``target`` rows
    and needs the best ``target`` of each bucket only, which Spark finds before the shuffle; the sequential rule then runs on
    these few rows.
    """
    quotas = quotas or QUOTAS
    source = lambda: F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit("unknown"))
    have = selected.count()
    if have >= target:
        return candidates.limit(0).select("identity", F.lit(0).alias("rank"), F.lit("").alias("reason"), F.lit("").alias("bucket"))
    by_source = selected.groupBy(source().alias("s")).agg(F.count(F.lit(1)).alias("n_source"))
    by_decade = selected.groupBy(N.decade(F.col("year")).alias("d")).agg(F.count(F.lit(1)).alias("n_decade"))
    by_bucket = {r["b"]: r["n"] for r in selected.groupBy(bucket(as_of_year).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    pool = candidates.join(selected.select("identity").distinct(), "identity", "left_anti").where(F.col("score") >= floor)
    pool = pool.withColumns({"s": source(), "d": N.decade(F.col("year")), "bucket": bucket(as_of_year)}).join(by_source, "s", "left").join(by_decade, "d", "left")
    pool = pool.withColumn("total", F.col("score") + 5 / (1 + F.coalesce("n_source", F.lit(0))) + 4 / (1 + F.coalesce("n_decade", F.lit(0))))
    pool = pool.withColumn("i", F.row_number().over(Window.partitionBy("identity").orderBy(F.desc("total"), "ord"))).where("i = 1")
    need = target - have
    pool = pool.withColumn("r", F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("total"), "ord"))).where(F.col("r") <= need).select("identity", "bucket", "total", "ord")

    def fill(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [p for p in it if len(p)]
        pdf = pd.concat(parts) if parts else pd.DataFrame(columns=["identity", "bucket", "total", "ord"])
        pdf = pdf.sort_values(["total", "ord"], ascending=[False, True])
        taken: dict[str, tuple[str, str]] = {}
        for b, share in quotas.items():
            short = -int(-target * share // 1) - by_bucket.get(b, 0)
            for i in pdf[pdf.bucket == b].identity:
                if short <= 0 or len(taken) >= need:
                    break
                taken[i] = (f"quota_fill:{b}", b)
                short -= 1
        for i, b in zip(pdf.identity, pdf.bucket, strict=True):
            if len(taken) >= need:
                break
            taken.setdefault(i, ("quality_diversity_fill", b))
        yield pd.DataFrame([(i, n, r, b) for n, (i, (r, b)) in enumerate(taken.items(), 1)], columns=["identity", "rank", "reason", "bucket"])

    return pool.coalesce(1).mapInPandas(fill, "identity string, rank int, reason string, bucket string")


def audit(scored: DataFrame, as_of_year: int, duplicates: int = 0) -> DataFrame:
    """One row of corpus figures and acceptance checks over papers with score and issues."""
    year = N.to_int(F.col("year"))
    source = F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit("unknown"))
    row = scored.agg(
        F.count(F.lit(1)).alias("papers"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean_quality_score"), F.count_if(X.doi(F.col("doi")) != "").alias("with_doi"),
        F.count_if(~F.array_contains("issues", "short_or_missing_abstract")).alias("with_abstract"), F.countDistinct(source).alias("source_count"),
        F.coalesce(F.bool_or(F.coalesce(year, F.lit(as_of_year)) <= as_of_year - 10), F.lit(False)).alias("classic_coverage"), F.coalesce(F.bool_or(F.coalesce(year, F.lit(0)) >= as_of_year - 5), F.lit(False)).alias("recent_coverage"),
    )
    rate = F.when(F.col("papers") > 0, F.col("with_abstract") / F.col("papers")).otherwise(0.0)
    dup = F.lit(float(duplicates)) / F.greatest(F.col("papers") + duplicates, F.lit(1))
    return row.withColumns({"abstract_usable_rate": rate, "duplicate_rate": dup}).withColumns({"duplicates_ok": F.col("duplicate_rate") < 0.02, "abstracts_ok": F.col("abstract_usable_rate") > 0.90, "sources_ok": F.col("source_count") >= 2})


def fulltext_audit(texts: DataFrame, text: str = "text") -> DataFrame:
    """Rows with chars, tables, replacement_ratio, issues and usable."""
    t = F.coalesce(F.col(text), F.lit(""))
    low, n = F.lower(t), F.length(t)
    damaged = (n - F.length(F.replace(t, F.lit("�"), F.lit("")))) / F.greatest(n, F.lit(1))
    count = lambda c, s: (F.length(c) - F.length(F.replace(c, F.lit(s), F.lit("")))) / len(s)
    issues = F.array_compact(F.array(F.when(F.col(text).isNull(), "missing_fulltext"), F.when(n < 2000, "too_short"), F.when(~F.contains(low, F.lit("abstract")) & ~F.contains(t, F.lit("摘要")), "missing_abstract_marker"), F.when(~F.contains(low, F.lit("doi:")) & ~F.contains(F.substring(t, 1, 3000), F.lit("10.")), "missing_doi_metadata"), F.when(damaged > 0.001, "encoding_damage")))
    out = texts.withColumns({"chars": n.cast("long"), "tables": (count(low, "=== table") + count(low, "|---")).cast("long"), "replacement_ratio": damaged, "issues": issues})
    return out.withColumn("usable", ~F.arrays_overlap("issues", F.array(F.lit("missing_fulltext"), F.lit("too_short"), F.lit("encoding_damage"))))


def usable_rate(audited: DataFrame) -> DataFrame:
    return audited.agg(F.count(F.lit(1)).alias("papers"), F.count_if("usable").alias("usable"), F.coalesce(F.avg(F.col("usable").cast("double")), F.lit(0.0)).alias("usable_rate"))


def require_usable(audited: DataFrame, threshold: float, override: bool = False) -> None:
    """Raise unless enough texts are usable."""
    rate = usable_rate(audited).first()["usable_rate"]
    if rate < threshold and not override:
        raise ValueError(f"usable rate {rate:.3f} is below {threshold}")


def merge_catalog(existing: DataFrame, papers: DataFrame, batch: str) -> DataFrame:
    """Catalog (identity, title, abstract, doi, venue, year, score, batches) after a batch: the richer record of each identity, all batches in order of arrival, the new score."""
    new = papers.withColumns({"batches": F.array(F.lit(batch)), "side": F.lit(1)})
    both = existing.withColumn("side", F.lit(0)).unionByName(new.select(*existing.columns, "side"))
    record = F.struct(*(c for c in existing.columns if c not in ("identity", "batches", "score")))
    best = both.groupBy("identity").agg(F.max_by(record, F.struct(richness(), -F.col("side"))).alias("r"), F.max_by("score", "side").alias("score"), F.sort_array(F.collect_list(F.struct("side", "batches"))).alias("b"))
    batches = F.filter(F.array_distinct(F.flatten(F.transform("b", lambda x: x["batches"]))), lambda x: x != "")
    return best.select("identity", "r.*", "score", batches.alias("batches")).select(*existing.columns).orderBy(F.desc("score"), "title")


def select_by_response(papers: DataFrame, indices: list, ord_column: str = "ord") -> DataFrame:
    """Papers whose position a model's answer names: what casts to a number in range, first mention first."""
    seen: dict[int, int] = {}
    for i in indices:
        try:
            seen.setdefault(int(i), len(seen))
        except (TypeError, ValueError):
            continue
    if not seen:
        return papers.limit(0).withColumn("rank", F.lit(0))
    rank = F.try_element_at(F.create_map(*(F.lit(x) for kv in seen.items() for x in kv)), F.col(ord_column).cast("int"))
    return papers.withColumn("rank", rank).where("rank IS NOT NULL")
