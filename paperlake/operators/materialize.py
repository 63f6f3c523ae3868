"""Nested extraction records to flat tables: property rows, structure rows, process claims, concepts, and the papers they belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlake.functions import numeric as N
from paperlake.functions import text as X
from paperlake.registry import CONTEXT_FIELDS, Spec, specs

ENTRY = "map<string,string>"


def _first(entry: Column, keys: list[str | None]) -> Column:
    return F.coalesce(*(F.nullif(F.trim(F.try_element_at(entry, F.lit(k))), F.lit("")) for k in keys if k), F.lit(None).cast("string"))


def property_rows(materials: DataFrame, wanted: list[Spec] | None = None, strict_units: bool = False) -> DataFrame:
    """One row per material, property and entry with a number.

    ``materials``: doi, name, fields (map of field name to an array of entries, each a map of strings). A zero under the property's own key falls through to ``value``. A temperature
    in degrees with a c in the unit becomes kelvin.
    """
    wanted = wanted or specs()
    # the registry is a fixed table: of its literal only the entries of fields that the material has go on
    dim = F.array(*(F.struct(F.lit(s.key).alias("key"), F.lit(s.symbol).alias("symbol"), F.lit(s.field).alias("field"), *(F.lit(v).cast("string").alias(a) for a, v in (("nk", s.numeric_key), ("uk", s.unit_key), ("tk", s.temperature_key), ("tuk", s.temperature_unit_key)))) for s in wanted))
    rows = materials.where("coalesce(name, '') <> ''").select("doi", "name", F.explode("fields").alias("field", "entries")).where(F.col("field").isin(sorted({s.field for s in wanted})))
    rows = rows.select("doi", "name", "entries", F.explode(F.filter(dim, lambda s: s["field"] == F.col("field"))).alias("s")).select("doi", "name", "s", F.explode("entries").alias("e"))
    get = lambda c: F.try_element_at(F.col("e"), c)
    text = lambda *cs: F.coalesce(*(F.nullif(F.trim(get(c)), F.lit("")) for c in cs))
    own = N.first_number(get(F.col("s.nk")))
    num = F.coalesce(F.nullif(own, F.lit(0.0)), N.first_number(get(F.lit("value"))))
    unit = F.coalesce(text(F.col("s.uk"), F.lit("unit"), F.lit("Unit")), F.lit(""))
    temp = N.first_number(text(F.col("s.tk"), F.lit("temperature"), F.lit("Temperature"), F.lit("T")))
    temp_unit = text(F.col("s.tuk"), F.lit("Temperature_unit"), F.lit("T_unit"), F.lit("temp_unit"))
    parsed = F.struct(num.alias("num"), unit.alias("unit0"), temp.alias("temp0"), temp_unit.alias("tu"))
    # parsed once: what an explode makes is not computed again by the filter and the columns above it
    rows = rows.select("doi", "name", "s", "e", F.explode(F.array(parsed)).alias("p")).select("doi", "name", "s", "e", "p.*").where("num IS NOT NULL")
    value, label = N.convert(F.col("num"), F.col("unit0"), F.col("s.key"), {s.key: s.target_unit for s in wanted if s.unit_known}, strict_units)
    context = [(F.coalesce(get(F.lit(k)), F.lit("")) if k != "evidence_page" else get(F.lit(k))).alias(k) for k in CONTEXT_FIELDS]
    return rows.select("doi", F.trim("name").alias("material_raw"), X.material_family(F.col("name")).alias("material_family"), F.col("s.key").alias("property_key"), F.col("s.symbol").alias("property_symbol"), value.alias("value"), label.alias("unit"), N.kelvin(F.col("temp0"), F.col("tu")).alias("temp_K"), F.lit("structured").alias("source"), *context)


def structure_rows(materials: DataFrame) -> DataFrame:
    """One row per material: doi, name, processing_method, crystal_structure, compound_type, space_group, dopants in; normalised out."""
    return materials.where("coalesce(name, '') <> ''").select(
        "doi", F.trim("name").alias("material_raw"), X.material_family(F.col("name")).alias("material_family"), X.method(F.col("processing_method")).alias("processing_method_norm"),
        X.crystal(F.col("crystal_structure")).alias("crystal_norm"), "compound_type", "space_group", F.coalesce("dopants", F.array().cast("array<string>")).alias("dopants"), F.lit("structured").alias("source"),
    )


def claim_rows(materials: DataFrame) -> DataFrame:
    """One row per advantage (doi, name, advantages array) with the first number in its text, if any."""
    rows = materials.where("coalesce(name, '') <> ''").select("doi", "name", F.explode("advantages").alias("detail"))
    return rows.select("doi", F.trim("name").alias("material_raw"), X.material_family(F.col("name")).alias("material_family"), F.lit("process_claim").alias("property_key"), F.lit("claim").alias("property_symbol"), N.first_number(F.col("detail")).alias("value"), F.lit("").alias("unit"), F.lit(None).cast("double").alias("temp_K"), F.lit("process_claim").alias("source"), "detail")


# Closed vocabularies of the rule-based concepts; materials keep their case.
MATERIALS = ("AlN", "ScAlN", "GaN", "BaTiO3", "PZT", "LiNbO3", "SiC", "Al2O3", "PVDF")
METHODS = ("MBE", "sputtering", "CVD", "MOCVD", "deposition", "annealing", "sintering")
PROPERTIES = ("seebeck", "resistivity", "conductivity", "permittivity", "coupling", "quality factor", "polarization")


def concepts(texts: DataFrame, doi: str = "doi", text: str = "text", materials=MATERIALS, methods=METHODS, properties=PROPERTIES) -> DataFrame:
    """doi, type, concept (lower case, distinct) of whole words from the vocabularies."""

    def found(words, flags: str) -> Column:
        return F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(rf"(?U{flags})\b(?:{'|'.join(words)})\b"), F.lit(0))

    kinds = F.create_map(F.lit("materials"), found(materials, ""), F.lit("methods"), found(methods, "i"), F.lit("properties"), found(properties, "i"))
    rows = texts.select(F.col(doi).alias("doi"), F.explode(kinds).alias("type", "words")).select("doi", "type", F.explode("words").alias("w"))
    return rows.select("doi", "type", F.lower(F.trim("w")).alias("concept")).where("concept <> ''").distinct()


def concept_rows(lists: DataFrame) -> DataFrame:
    """Concepts from lists: doi, materials, methods, properties (arrays)."""
    kinds = F.create_map(*(x for k in ("materials", "methods", "properties") for x in (F.lit(k), F.coalesce(k, F.array().cast("array<string>")))))
    rows = lists.select("doi", F.explode(kinds).alias("type", "words")).select("doi", "type", F.explode("words").alias("w"))
    return rows.select("doi", "type", F.lower(F.trim("w")).alias("concept")).where("concept <> ''")


def resolve(folders: DataFrame, authority: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """folder, doi, resolution: the folder's DOI by override, else decoded from its name, else by title, else by a prefix that one DOI alone has.

    ``folders``: folder, title; ``authority``: doi, title, ord (the first of equal ones counts); ``overrides``: folder, doi. Each tier is an equi-join; the prefix tier joins
    the folders' prefixes with all prefixes of each DOI.
    """
    a = authority.where("coalesce(doi, '') <> ''")
    first = lambda key: Window.partitionBy(key).orderBy("ord")
    by_doi = a.select("doi").distinct().withColumnRenamed("doi", "d_doi")
    by_title = a.withColumn("k", X.title_fold(F.col("title"))).where("k <> ''").withColumn("n", F.row_number().over(first("k"))).where("n = 1").select(F.col("k").alias("t_key"), F.col("doi").alias("t_doi"))
    f = folders.select("folder", "title", X.folder_doi(F.col("folder")).alias("decoded"), X.title_fold(F.col("title")).alias("key"), F.substring_index("folder", "_", 1).alias("prefix"))
    own = F.transform(F.sequence(F.lit(0), F.length("doi")), lambda n: F.left("doi", n))
    unique = a.select("doi").distinct().select("doi", F.explode(own).alias("p")).join(f.select(F.col("prefix").alias("p")).distinct(), "p").groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.min("doi").alias("p_doi")).where("n = 1").select("p", "p_doi")
    if overrides is None:
        f = f.withColumn("o_doi", F.lit(None).cast("string"))
    else:
        f = f.join(overrides.select(F.col("folder"), F.col("doi").alias("o_doi")), "folder", "left")
    f = f.join(by_doi, F.col("decoded") == F.col("d_doi"), "left").join(by_title, F.col("key") == F.col("t_key"), "left").join(unique, F.col("prefix") == F.col("p"), "left")
    tier = F.when(F.col("o_doi").isNotNull(), "override").when(F.col("d_doi").isNotNull(), "decode").when(F.col("t_doi").isNotNull(), "title").when(F.col("p_doi").isNotNull(), "prefix").otherwise("missing")
    return f.select("folder", F.coalesce("o_doi", "d_doi", "t_doi", "p_doi", F.nullif("decoded", F.lit("")), "folder").alias("doi"), tier.alias("resolution"))


def folder_of(dois: DataFrame, papers: DataFrame, ord_column: str = "ord") -> DataFrame:
    """``dois`` (doi) with the first folder of each, and its title, from papers (folder, doi, title, ord); empty strings where there is none."""
    first = papers.groupBy(F.col("doi").alias("_d")).agg(F.min_by(F.struct("folder", "title"), ord_column).alias("_f"))
    found = dois.join(first, F.col("doi") == F.col("_d"), "left")
    return found.withColumns({c: F.coalesce(F.col(f"_f.{c}"), F.lit("")) for c in ("folder", "title")}).drop("_d", "_f")


def table_totals(tables: DataFrame, records: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Per document the tables, their rows and the records from them; documents without tables are not listed."""
    t = tables.groupBy(id_column).agg(F.countDistinct("table_no").alias("tables"), F.count(F.lit(1)).alias("rows"))
    r = records.groupBy(id_column).agg(F.count(F.lit(1)).alias("records"))
    return t.join(r, id_column, "left").withColumn("records", F.coalesce("records", F.lit(0)))


def judged(entries: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Entries (material, property, value) without those a verdict (same columns) calls wrong."""
    return entries.join(verdicts.select("material", "property", "value").distinct(), ["material", "property", "value"], "left_anti")


def corpus_stats(papers: DataFrame) -> DataFrame:
    return papers.agg(F.count(F.lit(1)).alias("papers"), F.count_if("has_fulltext").alias("with_fulltext"), F.count_if("has_structured").alias("with_structured"), F.count_if(F.col("resolution") != "missing").alias("resolved"))
