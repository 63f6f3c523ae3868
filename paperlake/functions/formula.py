"""Chemical formulas and phase-change vocabulary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"([A-Z][a-z]?)(\d*(?:\.\d+)?)"


def with_counts(c: Column) -> Column:
    """Formula with a 1 behind each element that has no count."""
    names, counts = (F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TOKEN), F.lit(i)) for i in (1, 2))
    return F.array_join(F.zip_with(names, counts, lambda n, k: F.concat(n, F.when(k == "", "1").otherwise(k))), "")


# Short names of alloys.
ALLOYS = {"GST": "Ge2Sb2Te5"}


def composition(c: Column) -> Column:
    """struct: name with alloys spelled out, its elements in order, and the dopant before or after a colon or dash."""
    raw = F.trim(F.coalesce(c, F.lit("")))
    base = F.trim(F.regexp_replace(raw, r"[:：].*$|^[A-Z][a-z]?-(?=[A-Z])", ""))
    name = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in ALLOYS.items() for x in kv)), base), base)
    after = F.regexp_extract(raw, r"[:：]\s*([A-Z][a-z]?)", 1)
    before = F.regexp_extract(raw, r"^([A-Z][a-z]?)-(?=[A-Z])", 1)
    elements = F.array_distinct(F.regexp_extract_all(name, F.lit(r"[A-Z][a-z]?"), F.lit(0)))
    return F.struct(name.alias("name"), elements.alias("elements"), F.nullif(F.when(after != "", after).otherwise(before), F.lit("")).alias("dopant"))


# Vocabularies of phase-change records; what is in none of them is unknown.
PULSES = {"set": "SET", "reset": "RESET"}
PHASES = {"amorphous": "amorphous", "non-crystalline": "amorphous", "glass": "amorphous", "crystalline": "crystalline", "fcc": "fcc", "hcp": "hcp", "hexagonal": "hcp"}
ORIGINS = {"measured": "measured", "calculated": "calculated", "simulated": "calculated", "cited": "cited"}


def vocabulary(c: Column, words: dict[str, str]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in words.items() for x in kv)), F.lower(F.trim(c))), F.lit("unknown"))
