import pytest
from pyspark.sql import functions as F

from paperlake.functions import formula as FO
from paperlake.functions import jsonx as J
from paperlake.functions import numeric as N
from paperlake.functions import text as X


def one(spark, column, *values):
    """Value of a column expression over c (and d)."""
    names = ["c", "d"][: len(values)]
    df = spark.createDataFrame([tuple(values)], ", ".join(f"{n} {'string' if isinstance(v, str | type(None)) else 'double'}" for n, v in zip(names, values, strict=True)))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("f", "given", "expected"),
    [
        (X.material_family, "Sc0.3Al0.7N", "ScAlN"), (X.material_family, "GaN:Ge", "GaN"), (X.material_family, "BaTiO3 (001)", "BaTiO"), (X.material_family, "", ""), (X.material_family, "123", "123"),
        (X.method, "Molecular Beam Epitaxy (MBE)", "molecular beam epitaxy"), (X.method, "MOCVD (PAMBE)", "mocvd"), (X.crystal, "Hexagonal (hcp)", "hexagonalhcp"),
        (X.doi, " https://doi.org/10.1/AB. ", "10.1/ab"), (X.doi, "http://dx.doi.org/10.2/b", "10.2/b"), (X.doi, None, ""), (X.title_key, "Étude: ＡＢ 氮化镓!", "tudeab氮化镓"), (X.title_fold, "Étude AB", "etudeab"),
        (X.folder_name, "10.1/a b(c)", "10.1_abc"), (X.folder_doi, "10.1_abc", "10.1/abc"), (X.section_key, "=== 1. References: ===", "references"), (X.section_key, "## II. Methods", "methods"), (X.match_key, "epsilon_r", "εr"), (X.match_key, "ε_r", "εr"),
        (X.arxiv_id, "10.48550/arXiv.2401.12345v2", "2401.12345v2"), (X.arxiv_id, "https://x/ARXIV:2401.1234", "2401.1234"), (X.arxiv_id, "10.48550/arXiv.2401.1", None), (X.csv_cell, "a\r\nb\rc\nd", "a b c d"), (X.format_of, "/x/a.NXML", "xml"), (X.format_of, "/x/a", "unknown"), (N.strip_unit, "d33 (pC/N)", "d33"),
        (FO.with_counts, "Bi2Te", "Bi2Te1"),
    ],
)
def test_strings(spark, f, given, expected):
    assert one(spark, f(F.col("c")), given) == expected


@pytest.mark.parametrize(
    ("f", "given", "expected"),
    [
        (N.first_number, "1,234.5", 1234.5), (N.first_number, "-5e2", -500.0), (N.first_number, "abc", None), (N.first_number, None, None), (N.cell_number, "10-20", 10.0), (N.cell_number, "~4.5", 4.5), (N.cell_number, "n/a", None),
        (N.cell_number, "1.5×10³", 1.5e10), (N.cell_number, "1,200", 1200.0), (N.cell_number, "1.2e3", 1200.0), (N.cell_number, "220 pC/N", 220.0),
    ],
)
def test_numbers(spark, f, given, expected):
    assert one(spark, f(F.col("c")), given) == expected


def test_cells(spark):
    assert one(spark, N.cell_unit(F.col("c")), "220 pC/N") == "pC/N"
    assert one(spark, N.cell_unit(F.col("c")), "—") is None
    c = one(spark, N.cell(F.col("c")), " 25 °C ")
    assert (c["raw"], c["value"], c["unit"], c["is_numeric"]) == ("25 °C", 25.0, "°C", True)


def test_units(spark):
    target = {"thermoelectric:seebeck_coefficient": "μV/K"}
    key = F.lit("thermoelectric:seebeck_coefficient")
    value, unit = N.convert(F.lit(2.0), F.col("c"), key, target)
    assert one(spark, F.struct(value, unit), "V/K") == (2e6, "μV/K")
    assert one(spark, F.struct(value, unit), "furlong") == (2.0, "μV/K")
    assert one(spark, N.convert(F.lit(2.0), F.col("c"), key, target, strict=True)[0], "furlong") is None
    assert one(spark, N.kelvin(F.lit(100.0), F.col("c")), "°C") == pytest.approx(373.15)
    assert one(spark, N.kelvin(F.lit(100.0), F.col("c")), "℃") == 100.0


def test_budget(spark):
    got = [r[0] for r in spark.createDataFrame([(0,), (1000,), (1500,), (10**6,)], "c int").select(N.token_budget(F.col("c"))).collect()]
    assert got == [None, 786, 1042, 8129]


def test_json(spark):
    assert J.repair('```json\n{"a": 1,}\n```') == '{"a": 1}'
    assert J.repair("so {'a': None} it is") == '{"a": null}'
    assert J.repair("none here") is None
    assert J.fragments('x {"a": [1]} y [2] {bad') == ['{"a": [1]}', "[2]"]


def test_greek_order(spark):
    assert one(spark, X.greek_letters(F.col("c")), "theta") == "thη"


def test_keywords():
    assert X.query_keywords("氮化铝滤波器, AlN thin-film a") == ["氮化铝滤波器", "aln", "thin-film"]
