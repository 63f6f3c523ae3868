"""Gap analytics over the three flat tables: material_props, material_struct, paper_concepts.

Everything is groupBy, join and window on the data's own keys. Candidate ids are numbers in a global order, which ranges of the candidates count
each for itself; they can be left out (``ids=False``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlake.operators.order import places

MIN_PAPERS = 2
TOP_MISSING = 200
EVIDENCE = 8


def numbered(df: DataFrame, prefix: str, *order: Column) -> DataFrame:
    """``df`` with ids like ``ug-001`` in the order of all rows."""
    return places(df, "_n", *order).withColumn("id", F.concat(F.lit(f"{prefix}-"), F.format_string("%03d", "_n"))).drop("_n")


def well_studied(props: DataFrame, struct: DataFrame, min_papers: int = MIN_PAPERS) -> DataFrame:
    """material_family and papers: families with at least ``min_papers`` distinct papers in either table."""
    seen = struct.select("material_family", "doi").union(props.select("material_family", "doi")).where("coalesce(material_family, '') <> ''")
    return seen.groupBy("material_family").agg(F.countDistinct("doi").alias("papers")).where(F.col("papers") >= min_papers)


def underexplored(props: DataFrame, struct: DataFrame, properties: DataFrame, min_papers: int = MIN_PAPERS, ids: bool = True) -> DataFrame:
    """(family, property) pairs that no row reports, of well-studied families and the measurable properties (one column property_key).

    The properties are a dimension of fixed size; Spark broadcasts it if its own size check allows.
    """
    covered = props.where("coalesce(material_family, '') <> '' AND coalesce(property_key, '') <> ''").select("material_family", "property_key").distinct()
    pairs = well_studied(props, struct, min_papers).crossJoin(properties.select("property_key").distinct())
    out = pairs.join(covered, ["material_family", "property_key"], "left_anti")
    out = numbered(out, "ug", F.col("material_family"), F.col("property_key")) if ids else out
    return out.select(*(["id"] if ids else []), F.lit("underexplored").alias("type"), F.col("material_family").alias("concept_a"), F.col("property_key").alias("concept_b"), F.col("papers").alias("support"))


def evidence(candidates: DataFrame, papers: DataFrame, family: str = "concept_a", limit: int | None = None) -> DataFrame:
    """Candidates with ``evidence``: array of doi and title of the papers (material_family, doi, title) of their family, by doi."""
    rows = papers.select(F.col("material_family").alias("_f"), "doi", "title").distinct()
    if limit:  # only the first ones of a family are gathered
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_f").orderBy("doi", "title"))).where(F.col("_n") <= limit)
    per = rows.groupBy("_f").agg(F.sort_array(F.collect_list(F.struct("doi", "title"))).alias("evidence"))
    return candidates.join(per, F.col(family) == F.col("_f"), "left").drop("_f")


def cooccurrence(concepts: DataFrame) -> DataFrame:
    """material, method, n: in how many papers both occur."""
    mats = concepts.where("type = 'materials'").select("doi", F.col("concept").alias("material")).distinct()
    methods = concepts.where("type = 'methods'").select("doi", F.col("concept").alias("method")).distinct()
    return mats.join(methods, "doi").groupBy("material", "method").agg(F.count(F.lit(1)).alias("n"))


def missing_links(concepts: DataFrame, min_papers: int = MIN_PAPERS, top: int | None = TOP_MISSING, ids: bool = True) -> DataFrame:
    """Materials and methods that both occur with partners, but never together, by their support.

    The grid of all supported materials and methods is what is asked for; it is enumerated in parallel. Ids number all empty cells before the cut at ``top``; without them
    only the top is sorted.
    Support counts (paper, partner) pairs, so one paper with two methods supports its material twice.
    """
    pairs = cooccurrence(concepts)
    rows = pairs.groupBy("material").agg(F.sum("n").alias("row_support")).where(F.col("row_support") >= min_papers)
    cols = pairs.groupBy("method").agg(F.sum("n").alias("col_support")).where(F.col("col_support") >= min_papers)
    out = rows.crossJoin(cols).join(pairs.select("material", "method"), ["material", "method"], "left_anti")
    out = out.withColumn("support_score", F.least("row_support", "col_support").cast("long"))
    out = numbered(out, "ml", F.col("material"), F.col("method")) if ids else out
    out = out.select(*(["id"] if ids else []), F.lit("missing_link").alias("type"), F.col("material").alias("concept_a"), F.col("method").alias("concept_b"), "support_score")
    return out.orderBy(F.desc("support_score"), "concept_a", "concept_b").limit(top) if top else out


def structure_contradictions(struct: DataFrame, min_papers: int = MIN_PAPERS) -> DataFrame:
    """Families that several papers give different crystal structures, with the papers of each structure."""
    rows = struct.where("material_family IS NOT NULL AND coalesce(crystal_norm, '') <> ''").select("material_family", "crystal_norm", "doi").distinct()
    per = rows.groupBy("material_family", "crystal_norm").agg(F.count("doi").alias("papers"))
    totals = rows.groupBy("material_family").agg(F.countDistinct("doi").alias("all_papers"), F.countDistinct("crystal_norm").alias("kinds")).where((F.col("all_papers") >= min_papers) & (F.col("kinds") >= 2))
    listed = per.join(totals, "material_family").groupBy("material_family", "all_papers", "kinds").agg(F.array_join(F.sort_array(F.collect_list(F.concat("crystal_norm", F.lit("("), "papers", F.lit(")")))), "; ").alias("structures"))
    return numbered(listed, "sc", F.col("material_family")).select("id", F.lit("contradiction").alias("type"), F.lit("structure").alias("subtype"), F.col("material_family").alias("concept_a"), F.lit("crystal_structure").alias("concept_b"), "all_papers", "kinds", "structures")


def numeric_contradictions(props: DataFrame, min_papers: int = MIN_PAPERS, rel_diff: float = 0.5, temp_bucket: float = 50, ids: bool = True) -> DataFrame:
    """Groups of family, property and temperature bucket whose values differ by more than ``rel_diff`` of the smallest.

    Claims from running text do not count. One shuffle: minimum, maximum and counts combine before it.
    """
    rows = props.where("coalesce(source, '') <> 'process_claim' AND material_family IS NOT NULL AND property_key IS NOT NULL")
    rows = rows.withColumn("bucket", F.coalesce(F.floor(F.col("temp_K") / temp_bucket).cast("double"), F.lit(-1.0)))
    low, high = F.min("value"), F.max("value")
    groups = rows.groupBy("material_family", "property_key", "bucket").agg(F.countDistinct("doi").alias("papers"), F.count("value").alias("n"), low.alias("low"), high.alias("high"))
    groups = groups.where((F.col("papers") >= min_papers) & (F.col("n") >= min_papers)).withColumn("spread", (F.col("high") - F.col("low")) / F.greatest(F.abs("low"), F.lit(1e-9)))
    out = groups.where(F.col("spread") > rel_diff)
    out = numbered(out, "nc", F.col("material_family"), F.col("property_key"), F.col("bucket")) if ids else out
    return out.select(*(["id"] if ids else []), F.lit("contradiction").alias("type"), F.lit("numeric").alias("subtype"), F.col("material_family").alias("concept_a"), F.col("property_key").alias("concept_b"), "bucket", "papers", "n", "low", "high", "spread")


def sufficiency(props: DataFrame) -> DataFrame:
    """One row: whether there are any numbers to compare, and a note if not."""
    n, structured = F.count(F.lit(1)), F.count_if(F.coalesce("source", F.lit("")) != "process_claim")
    return props.agg((structured > 0).alias("data_sufficient"), F.when(n == 0, "no comparable values").when(structured == 0, "no structured values").otherwise("").alias("note"))


def all_candidates(*candidates: DataFrame) -> DataFrame:
    out = candidates[0]
    for c in candidates[1:]:
        out = out.unionByName(c, allowMissingColumns=True)
    return out


def apply_verdicts(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Candidates with their verdict (id, accept, reason, confidence); without one they are rejected, verdicts without a candidate fall away."""
    joined = candidates.join(verdicts.select("id", "accept", "reason", "confidence").dropDuplicates(["id"]), "id", "left")
    return joined.withColumns({"accept": F.coalesce("accept", F.lit(False)), "reason": F.coalesce("reason", F.lit("no verdict")), "confidence": F.coalesce("confidence", F.lit(0.0))})


def accept_all(candidates: DataFrame) -> DataFrame:
    """Verdicts of a run without a judge: accepted with low confidence."""
    return candidates.select("id", F.lit(True).alias("accept"), F.lit("not judged").alias("reason"), F.lit(0.3).alias("confidence"))
