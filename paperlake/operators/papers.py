"""Paper records: projections to one schema, memory and knowledge records, windows of years, translated queries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.functions import text as X
from paperlake.operators.search import abstract_from_index


def _first(df: DataFrame, *names: str, default: Column | None = None) -> Column:
    """First of these columns that is there and not blank."""
    found = [F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*found, F.lit("") if default is None else default)


def _array(df: DataFrame, *names: str) -> Column:
    found = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*found, F.array().cast(df.schema[next(n for n in names if n in df.columns)].dataType)) if found else F.array().cast("array<struct<pdf_url:string>>")


def contract(records: DataFrame, source: str = "unknown") -> DataFrame:
    """The handoff schema of thirteen columns from records with alternate names; rows without a DOI fall away."""
    is_oa = F.lit(False)
    for n in ("is_oa", "is_open_access"):
        if n in records.columns:
            is_oa = is_oa | F.coalesce(F.col(n), F.lit(False))
    number = lambda c: (F.col(c).cast("string").try_cast("int") if c in records.columns else F.lit(None).cast("int"))
    out = records.select(
        _first(records, "doi").alias("doi"), _first(records, "title").alias("title"), number("year").alias("year"), _first(records, "abstract").alias("abstract"), _first(records, "venue").alias("venue"), F.coalesce(number("citation_count"), F.lit(0)).alias("citation_count"),
        _first(records, "source", default=F.lit(source)).alias("source"), _first(records, "source_batch").alias("source_batch"), (F.col("best_oa_location") if "best_oa_location" in records.columns else F.lit(None).cast("struct<pdf_url:string>")).alias("best_oa_location"),
        _array(records, "oa_locations", "locations").alias("oa_locations"), _first(records, "pdf_url").alias("pdf_url"), _first(records, "fulltext_url", "oa_url").alias("fulltext_url"), is_oa.alias("is_oa"),
    )
    return out.where("doi <> ''")


def from_works(works: DataFrame, keyword: str) -> DataFrame:
    """Papers from works of an open catalogue: id columns, cited_by_count, and the abstract as an inverted index (map of word to positions)."""
    doi = X.doi(F.col("doi"))
    return works.select(
        F.lit(keyword).alias("keyword"), F.trim(F.coalesce("title", F.lit(""))).alias("title"), F.array().cast("array<string>").alias("authors"), F.col("publication_year").cast("int").alias("year"), F.coalesce("venue", F.lit("")).alias("venue"), doi.alias("doi"), F.lit("openalex").alias("source"),
        F.when(doi != "", F.concat(F.lit("https://doi.org/"), doi)).otherwise("").alias("url"), F.col("cited_by_count").cast("int").alias("citation_count"), X.clean_text(F.coalesce(abstract_from_index(F.col("abstract_inverted_index")), F.lit("")), 600).alias("abstract"),
    )


def within_years(papers: DataFrame, years: int, as_of_year: int) -> DataFrame:
    """Papers of the last ``years`` years; those of unknown year stay."""
    y = F.col("year").cast("string").try_cast("int")
    return papers.where(y.isNull() | (y >= as_of_year - years))


def merge_seeds(seeds: DataFrame, found: DataFrame) -> DataFrame:
    """DOI-keyed union in which a seed wins over what was found; ``kind`` tells them apart."""
    s, f = seeds.withColumn("kind", F.lit("seed")), found.withColumn("kind", F.lit("found"))
    both = s.unionByName(f, allowMissingColumns=True).withColumn("_k", X.doi(F.col("doi"))).where("_k <> ''")
    first = both.groupBy("_k").agg(F.max("kind").alias("kind"))
    return both.join(first, ["_k", "kind"], "left_semi").dropDuplicates(["_k"]).drop("_k")


def memory_index(*sources: DataFrame) -> DataFrame:
    """Memory records (doi, title, year, venue, batch, has_structured, source) of all sources, one per DOI and source."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out.where("coalesce(doi, '') <> ''").withColumn("doi", X.doi_memory(F.col("doi"))).dropDuplicates(["doi", "source"])


def memory_summary(records: DataFrame) -> DataFrame:
    return records.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("has_structured", F.lit(False))).alias("structured"))


def knowledge_docs(papers: DataFrame, gaps: DataFrame, reports: DataFrame, batch: str) -> DataFrame:
    """type, batch, doi, title, statement, body of papers, accepted gaps and reports: one table per batch."""
    p = papers.select(F.lit("paper").alias("type"), "doi", "title", F.lit(None).cast("string").alias("statement"), F.col("abstract").alias("body"))
    g = gaps.select(F.lit("gap").alias("type"), F.lit(None).cast("string").alias("doi"), F.lit(None).cast("string").alias("title"), "statement", F.col("reason").alias("body"))
    r = reports.select(F.lit("report").alias("type"), F.lit(None).cast("string").alias("doi"), "title", F.lit(None).cast("string").alias("statement"), "body")
    return p.unionByName(g).unionByName(r).withColumn("batch", F.lit(batch))


def accepted(verdicts: DataFrame) -> DataFrame:
    """Gaps from accepted verdicts; a refined statement and given evidence win over the candidate's."""
    has = lambda c: F.col(c) if c in verdicts.columns else F.lit(None).cast("string")
    return verdicts.where("accept").select("id", "type", "concept_a", "concept_b", F.coalesce(F.nullif(has("refined_statement"), F.lit("")), has("statement"), F.concat_ws(" / ", "concept_a", "concept_b")).alias("statement"), "confidence", "reason")


# Chinese names of materials and terms of the field, and their English, in the order in which they are looked for.
CN_MATERIALS = {
    "铝": "Aluminum", "氮化铝": "Aluminum nitride", "氮化镓": "gallium nitride", "氧化锌": "zinc oxide", "铌酸锂": "lithium niobate", "钛酸钡": "barium titanate", "钛酸锶": "strontium titanate", "碳化硅": "silicon carbide", "钙钛矿": "perovskite",
    "氧化物": "oxide", "金属": "metal", "合金": "alloy", "金刚石": "diamond", "氮化硼": "boron nitride", "二硫化钼": "MoS2", "碳纳米管": "carbon nanotube", "石墨烯": "graphene", "锗": "germanium", "硅": "silicon", "砷化镓": "gallium arsenide",
}
CN_TERMS = {
    "掺杂": "doping", "薄膜": "thin film", "滤波器": "filter", "谐振器": "resonator", "声表面波": "surface acoustic wave", "体声波": "bulk acoustic wave", "压电": "piezoelectric", "铁电": "ferroelectric", "沉积": "deposition", "溅射": "sputtering", "配方": "composition", "制备": "fabrication",
    "工艺": "process", "材料": "material", "器件": "device", "性能": "performance", "生长": "growth", "外延": "epitaxial", "微机电": "MEMS", "声学": "acoustic", "射频": "RF", "氮化铝": "AlN", "钪": "Scandium", "掺杂剂": "dopant",
}


def english_queries(requirement: str) -> list[str]:
    """English queries for a Chinese requirement: its first material and up to four words in all; none for a text without CJK."""
    if not re.search(f"[{X.CJK}]", requirement or ""):
        return []
    material = [en for cn, en in CN_MATERIALS.items() if cn in requirement][:1]
    words = (material + [en for cn, en in CN_TERMS.items() if cn in requirement])[:4]
    return [" ".join(words), " ".join([*words, "acoustic filter"])] if words else []
