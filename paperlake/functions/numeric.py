"""Numbers, units, scores and hashes as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperlake.registry import unit_factors

# Unit patterns, compound ones first, and the tokens looked for when none of them is there.
UNIT_PATTERNS = (
    "µW/m·K²", "µW m[−-]1 K[−-]2", "μW/mK", "W/m·K", "W/mK", "W/cm·K", "mV/K", "V/K", "S/cm", "S/m", "mS/cm", "Ω·cm", "Ω.cm", "kΩ", "MΩ", "GPa", "MPa", "Pa", "eV", "meV",
    "pC/N", "nC/N", "µC/m²", "μC/m²", "C/m²", "kJ/mol", "kJ kg[−-]1 K[−-]1", "K", "°C", "oC", "%", "nm", "Å", "cm", "mm", "µm", "μm", "GHz", "MHz", "kHz", "Hz", "V", "mV", "kV", "A", "mA", "W", "mW",
)
TOKEN_UNITS = (
    "pC/N", "nC/N", "µC/m²", "μC/m²", "C/m²", "W/mK", "W/m·K", "mV/K", "V/K", "S/cm", "S/m", "mS/cm", "µW/mK²", "μW/mK²", "µW/m·K²", "μW/m·K²", "GPa", "MPa", "eV", "meV",
    "kJ/mol", "°C", "oC", "K", "%", "nm", "µm", "μm", "cm", "GHz", "MHz", "kHz", "Hz", "V", "mV", "kV", "A", "mA", "W", "mW", "Ω·cm", "Ω.cm", "kΩ", "MΩ",
)
UNIT = "|".join(UNIT_PATTERNS)
NOT_NUMBERS = ("—", "-", "–", "--", "n/a", "na", "none", "null", "", "...")
SKIPPED_CELLS = ("", "—", "-", "n/a", "None")


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _double(c: Column) -> Column:
    return c.try_cast("double")


def first_number(c: Column) -> Column:
    """First number in a text, thousands commas aside; null if there is none."""
    return _double(F.nullif(F.regexp_extract(F.replace(_text(c), F.lit(","), F.lit("")), r"-?\d+(\.\d+)?([eE][-+]?\d+)?", 0), F.lit("")))


def cell_number(c: Column) -> Column:
    """Main value of a table cell: the low end of a range, else the first number; a power of ten after a multiplication sign joins the number."""
    s = _text(c)
    low = F.regexp_extract(s, r"(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)\s*[–—−-]\s*-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?", 1)
    number = F.regexp_extract(s, r"(?i)((?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?:[eE][+-]?\d+)?(?:\s*[×x]\s*10\s*(?:\^?\{?[+-]?\d+\}?)?)?)", 1)
    number = F.replace(F.replace(number, F.lit(","), F.lit("")), F.lit("×"), F.lit("e"))
    plain = number.rlike(r"^\s*\d+(\.\d+)?([eE][+-]?\d+)?\s*$")
    return F.when(F.lower(F.trim(s)).isin(*NOT_NUMBERS), None).when(low != "", _double(low)).when(plain, _double(F.trim(number)))


def cell_unit(c: Column) -> Column:
    s = _text(c)
    by_pattern, by_token = F.regexp_extract(s, UNIT, 0), F.regexp_extract(s, "|".join(TOKEN_UNITS), 0)
    return F.when(F.lower(F.trim(s)).isin(*NOT_NUMBERS), None).otherwise(F.nullif(F.trim(F.when(by_pattern != "", by_pattern).otherwise(by_token)), F.lit("")))


def cell(c: Column) -> Column:
    """struct of raw, value, unit and is_numeric."""
    s = F.trim(_text(c))
    numeric = ~F.lower(s).isin(*NOT_NUMBERS) & (cell_number(s).isNotNull() | s.rlike(UNIT))
    return F.struct(s.alias("raw"), cell_number(s).alias("value"), cell_unit(s).alias("unit"), numeric.alias("is_numeric"))


def strip_unit(c: Column) -> Column:
    h = F.regexp_replace(_text(c), r"[\(\[（][^)\]]*[\)\]）]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(h, UNIT, " "), r"\s+", " "))


def convert(value: Column, unit: Column, property_key: Column, targets: dict[str, str], strict: bool = False) -> tuple[Column, Column]:
    """Value and unit brought to the property's target unit.

    By default a unit without a factor counts as 1 and is relabelled all the same; ``strict`` matches units whatever their case and
    gives null for an unknown one. Properties without a target keep both.
    """
    factors = F.create_map(*(F.lit(x) for (k, u), f in unit_factors(strict).items() for x in (f"{k}|{u}", f)))
    target = F.try_element_at(F.create_map(*(F.lit(x) for kv in targets.items() for x in kv)), property_key)
    known = target.isNotNull() & (F.coalesce(unit, F.lit("")) != "")
    factor = F.try_element_at(factors, F.concat(property_key, F.lit("|"), F.lower(F.trim(unit))))
    factor = factor if strict else F.coalesce(factor, F.lit(1.0))
    return F.when(known, value * factor).otherwise(value), F.when(known, target).otherwise(unit)


def kelvin(value: Column, unit: Column) -> Column:
    """Degrees with a c in their unit become kelvin; no unit counts as kelvin."""
    return F.when(F.contains(F.lower(F.coalesce(unit, F.lit("K"))), F.lit("c")), value + 273.15).otherwise(value)


def temperature_bucket(temp: Column, width: float = 50) -> Column:
    return F.coalesce(F.floor(temp / width).cast("double"), F.lit(-1.0))


def to_int(c: Column) -> Column:
    return c.try_cast("int")


def decade(year: Column) -> Column:
    y = F.coalesce(to_int(year), F.lit(0))
    return (F.floor(y / 10) * 10).cast("int")


def token_budget(tokens: Column) -> Column:
    """Output tokens granted for an input of so many; null (skip) for none."""
    return F.when(tokens <= 0, None).when(tokens <= 1000, 786).otherwise(F.least(F.lit(8129), 786 + 256 * F.floor((tokens - 1000) / 500))).cast("int")


def token_count(c: Column) -> Column:
    """Tokens of a text without a vocabulary: words and single marks."""
    return F.regexp_count(_text(c), F.lit(r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]")).cast("long")


def batch_stamp(c: Column) -> Column:
    """Last YYYY_MM_DD_HHMMSS stamp of a name."""
    return F.try_element_at(F.regexp_extract_all(_text(c), F.lit(r"\d{4}_\d{2}_\d{2}_\d{6}"), F.lit(0)), F.lit(-1))


def step_id(stage: Column, op: Column, params: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\0", stage, op, params), 256), 1, 12)


def claim_id(*parts: Column) -> Column:
    """claim- and 16 hex digits of the parts as a compact JSON array, nulls as null."""
    quoted = [F.coalesce(F.concat(F.lit('"'), F.regexp_replace(p.cast("string"), r'(["\\])', r"\\$1"), F.lit('"')), F.lit("null")) for p in parts]
    return F.concat(F.lit("claim-"), F.substring(F.sha2(F.concat(F.lit("["), F.concat_ws(",", *quoted), F.lit("]")), 256), 1, 16))


def rank_score(citations: Column, year: Column, as_of_year: int) -> Column:
    """ln(citations + 1), half a point more within five years."""
    c = F.coalesce(citations.try_cast("double"), F.lit(0.0))
    return F.log1p(F.greatest(c, F.lit(0.0))) + F.when(to_int(year) >= as_of_year - 5, 0.5).otherwise(0.0)


def hybrid_score(relevance: Column, citations: Column) -> Column:
    rel = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(relevance.try_cast("double"), F.lit(0.5))))
    return 0.7 * rel + 0.3 * F.least(F.log1p(F.greatest(F.coalesce(citations.try_cast("double"), F.lit(0.0)), F.lit(0.0))) / 5, F.lit(1.0))
