"""Claims with evidence, their quality, and evaluation of retrieval and extraction against gold sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlake.functions import numeric as N

CONDITIONS = ("sample_form", "phase_state", "measurement_method", "heating_rate", "film_thickness", "pulse_type", "pulse_width", "crystallization_definition", "value_origin", "endurance_basis", "evidence_table_row", "evidence_table_column")


def claims(props: DataFrame) -> DataFrame:
    """One claim per property row with a subject, a predicate and a value; missing context columns count as empty. Column expressions only."""
    col = lambda c: F.col(c).cast("string") if c in props.columns else F.lit(None).cast("string")
    txt = lambda c: F.trim(F.coalesce(col(c), F.lit("")))
    subject, predicate = (F.coalesce(F.nullif(txt(a), F.lit("")), F.nullif(txt(b), F.lit(""))) for a, b in (("material_raw", "material_family"), ("property_key", "property_symbol")))
    page = col("evidence_page").try_cast("double").cast("int")
    traceable = (txt("evidence_quote") != "") | F.coalesce(page != 0, F.lit(False)) | (txt("evidence_table") != "") | (txt("evidence_table_row") != "")
    conditions = F.map_filter(F.create_map(F.lit("temperature_K"), col("temp_K"), *(x for c in CONDITIONS for x in (F.lit(c), col(c)))), lambda k, v: F.coalesce(v, F.lit("")) != "")
    return props.where(subject.isNotNull() & predicate.isNotNull() & F.col("value").isNotNull()).select(
        N.claim_id(txt("doi"), subject, predicate, col("value"), col("unit"), col("temp_K")).alias("claim_id"), txt("doi").alias("doi"), subject.alias("subject"), predicate.alias("predicate"), F.col("value"), txt("unit").alias("unit"), conditions.alias("conditions"),
        F.struct(txt("evidence_section").alias("section"), page.alias("page"), txt("evidence_table").alias("table"), txt("evidence_table_row").alias("row"), txt("evidence_quote").alias("quote")).alias("locator"),
        F.coalesce(F.nullif(txt("source"), F.lit("")), F.lit("structured")).alias("extraction_method"), traceable.alias("traceable"), F.when(traceable, 0.75).otherwise(0.4).alias("confidence"), F.when(traceable, "unverified").otherwise("needs_review").alias("status"),
    )


def claim_quality(c: DataFrame, keys: tuple[str, ...] = ("sample_form", "phase_state", "measurement_method", "value_origin")) -> DataFrame:
    share = lambda x: F.coalesce(F.avg(x.cast("double")), F.lit(0.0))
    return c.agg(F.count(F.lit(1)).alias("claims"), F.count_if("traceable").alias("traceable_claims"), share(F.col("traceable")).alias("traceability_rate"), F.count_if(F.col("status") == "needs_review").alias("needs_review"), *(share(F.try_element_at("conditions", F.lit(k)).isNotNull()).alias(f"with_{k}") for k in keys))


def retrieval_metrics(relevant: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """recall and precision at k and the number missed, for relevant(doi) and ranked(doi, rank from 1)."""
    gold = relevant.select("doi").distinct()
    top = ranked.where(F.col("rank") <= k).groupBy("doi").agg(F.min("rank").alias("rank"))
    hit = gold.join(top.withColumn("hit", F.lit(1)), "doi", "left")
    row = hit.agg(F.count(F.lit(1)).alias("relevant"), F.count("hit").alias("found")).crossJoin(top.agg(F.count(F.lit(1)).alias("returned")))  # two rows of one each
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return row.select("relevant", "found", "returned", ratio("found", "relevant").alias("recall_at_k"), ratio("found", "returned").alias("precision_at_k"), (F.col("relevant") - F.col("found")).alias("missed"))


LEVELS = {"material": ("material",), "property": ("material", "property"), "value": ("material", "property", "value"), "full": ("material", "property", "value", "unit")}


def extraction_metrics(gold: DataFrame, predicted: DataFrame, levels: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """level, gold, predicted, common, precision, recall, f1 over distinct folded keys of growing width.

    Both sides are expanded to one row per level and key and meet in one aggregation.
    """
    levels = levels or LEVELS
    names = sorted({c for cs in levels.values() for c in cs})

    def keyed(df: DataFrame, side: str) -> DataFrame:
        folded = df.select(*(F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))).alias(c) for c in names))
        keys = F.array(*(F.struct(F.lit(level).alias("level"), F.concat_ws("\1", *cs).alias("key")) for level, cs in levels.items()))
        return folded.select(F.explode(keys).alias("k")).select("k.level", "k.key", F.lit(side).alias("side"))

    sides = keyed(gold, "g").unionByName(keyed(predicted, "p")).groupBy("level", "key").agg(F.bool_or(F.col("side") == "g").alias("g"), F.bool_or(F.col("side") == "p").alias("p"))
    t = sides.groupBy("level").agg(F.count_if("g").alias("gold"), F.count_if("p").alias("predicted"), F.count_if(F.col("g") & F.col("p")).alias("common"))
    p, r = F.when(F.col("predicted") > 0, F.col("common") / F.col("predicted")).otherwise(0.0), F.when(F.col("gold") > 0, F.col("common") / F.col("gold")).otherwise(0.0)
    t = t.withColumns({"precision": p, "recall": r})
    return t.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def missing_evidence(materials: DataFrame) -> DataFrame:
    """doi, name, field of entries without a quote: from doi, name, fields (map to arrays of maps)."""
    rows = materials.select("doi", "name", F.explode("fields").alias("field", "entries")).select("doi", "name", "field", F.posexplode("entries").alias("entry_no", "e"))
    return rows.where(F.coalesce(F.try_element_at("e", F.lit("evidence_quote")), F.lit("")) == "").select("doi", "name", "field", "entry_no")
