"""Lexical search over memory and knowledge records, ranking of candidates, and citation expansion."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlake.functions import numeric as N
from paperlake.functions import text as X
from paperlake.operators.order import written


def _hits(c: Column, words: list[str]) -> Column:
    return sum((F.contains(c, F.lit(w)).cast("int") for w in words), F.lit(0))


def memory_search(records: DataFrame, query: str, k: int = 20) -> DataFrame:
    """The k best records (doi, title, batch, materials array, year, has_structured) by score, then the earlier year.

    An exact DOI counts 100, each term 3 in the title, 2 in the batch name and 4 in a material's name; a structured record gets 5 more, even without a hit.
    Parts of a DOI are no terms: the number of its registrant stands in many a title by chance.
    The query's terms become one expression, so records stream through a scan and a top-k.
    """
    dois = [d.lower().rstrip(".") for d in re.findall(r"10\.\d{4,9}/[\w.\-]+", query or "", re.I)]
    words = X.query_keywords(re.sub(r"10\.\d{4,9}/[a-z0-9_.\-]+", " ", query or "", flags=re.I))
    fold = lambda c: X.title_fold(c, keep_cjk=True)
    materials = F.aggregate(F.transform(F.coalesce("materials", F.array().cast("array<string>")), lambda m: _hits(F.regexp_replace(F.lower(m), f"[^a-z0-9{X.CJK}]+", ""), words)), F.lit(0), lambda a, x: a + x)
    score = F.when(X.doi_memory(F.col("doi")).isin(*dois), 100).otherwise(0) if dois else F.lit(0)
    score = score + 3 * _hits(fold(F.col("title")), words) + 2 * _hits(fold(F.col("batch")), words) + 4 * materials + F.when(F.coalesce("has_structured", F.lit(False)), 5).otherwise(0)
    return records.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), F.coalesce("year", F.lit(0)), "doi").limit(k)


def knowledge_terms(query: str) -> list[str]:
    import unicodedata

    q = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", query or "").lower())
    return list(dict.fromkeys(re.findall(r"[a-z0-9][a-z0-9_.:/-]{1,}", q) + re.findall(f"[{X.CJK}]{{2,}}", q)))


def knowledge_search(records: DataFrame, query: str, k: int = 5, normalize: bool = True) -> DataFrame:
    """The k records with most query terms anywhere in their values, ten more for the DOI that the query names, then by title or statement."""
    terms = knowledge_terms(query)
    if not terms:
        return records.withColumn("score", F.lit(0)).limit(0)
    text = F.concat_ws(" ", *(F.col(c).cast("string") for c in records.columns))
    hay = F.regexp_replace(F.lower(X.nfkc(text) if normalize else text), r"\s+", " ")
    has = lambda c: F.col(c) if c in records.columns else F.lit(None).cast("string")
    exact = F.when((F.coalesce(has("doi"), F.lit("")) != "") & F.contains(F.lit((query or "").lower()), F.lower(has("doi"))), 10).otherwise(0)
    matched = records.withColumn("_h", hay).withColumn("matched", _hits(F.col("_h"), terms)).where("matched > 0")
    return matched.withColumn("score", F.col("matched") + exact).drop("_h").orderBy(F.desc("score"), F.coalesce(has("title"), has("statement"), F.lit(""))).limit(max(0, k))


def rank_candidates(papers: DataFrame, as_of_year: int, ord_column: str = "ord") -> DataFrame:
    """Papers with rank_score, best first, equal ones in their order."""
    return papers.withColumn("rank_score", N.rank_score(F.col("citation_count"), F.col("year"), as_of_year)).orderBy(F.desc("rank_score"), ord_column)


def frontier_order(papers: DataFrame, n: int) -> DataFrame:
    return papers.orderBy(F.col("year").desc_nulls_last(), F.desc(F.coalesce("citation_count", F.lit(0)))).limit(n)


def snowball(edges: DataFrame, seeds: DataFrame, rounds: int = 2, per_seed: int | None = None, cap: int | None = None, salt: int = 0) -> DataFrame:
    """node and round reached from the seeds (column node) over edges (src, dst), seeds in round 0.

    Each round joins the frontier with the edges and leaves out what was seen. ``per_seed`` keeps that many neighbours of each node by a hash, ``cap`` so many new nodes in all.
    Each round's new nodes are written, so that no round computes those before it again.
    """
    seen = written(seeds.select("node").distinct().withColumn("round", F.lit(0)))
    frontier = seen
    for r in range(1, rounds + 1):
        near = edges.join(frontier.select(F.col("node").alias("src")), "src").select("src", "dst").distinct()
        if per_seed:
            order = Window.partitionBy("src").orderBy(F.xxhash64("src", "dst", F.lit(salt)), "dst")
            near = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_seed)
        new = near.select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("round", F.lit(r))
        if cap:
            new = new.orderBy(F.xxhash64("node", F.lit(salt)), "node").limit(cap)
        frontier = written(new)
        seen = seen.unionByName(frontier)
    return seen


def first_come(references: DataFrame, cap: int, seed_order: str = "seed_ord", order: str = "ref_ord") -> DataFrame:
    """The first ``cap`` references of all seeds, in the order of the seeds and of each one's references; cut before any deduplication."""
    return references.orderBy(seed_order, order).limit(cap)


def query_audit(hits: DataFrame) -> DataFrame:
    """Per query: raw hits, distinct ones and sources, from (query, doi, title, source)."""
    key = F.coalesce(F.nullif("doi", F.lit("")), F.col("title"))
    return hits.groupBy("query").agg(F.count(F.lit(1)).alias("raw_hits"), F.countDistinct(key).alias("distinct_hits"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))


def purge_ghosts(records: DataFrame, batches: DataFrame) -> DataFrame:
    """Records of batches that still exist (column batch) or of none; all of them if no batch exists."""
    if batches.isEmpty():
        return records
    known = records.join(batches.select("batch").distinct(), "batch", "left_semi")
    return known.unionByName(records.where("coalesce(batch, '') = ''").select(*known.columns))


def abstract_from_index(c: Column) -> Column:
    """Text of an inverted index, map<word, positions>."""
    pairs = F.flatten(F.transform(F.map_entries(c), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")
