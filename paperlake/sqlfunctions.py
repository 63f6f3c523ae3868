"""The engine's functions and table functions for SQL text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf, udtf

from paperlake.functions import jsonx as J
from paperlake.operators.documents import _Html, parse_article
from paperlake.operators.tables import scan_tables

#: SQL-bodied functions: name, parameter, type, body. Catalyst inlines them.
SQL_FUNCTIONS = (
    ("doi_key", "s STRING", "STRING", r"rtrim('. ', regexp_replace(lower(trim(coalesce(s, ''))), r'^https?://(?:dx\.)?doi\.org/', ''))"),
    ("crystal_key", "s STRING", "STRING", "regexp_replace(lower(trim(coalesce(s, ''))), '[^a-z0-9]', '')"),
    ("first_number", "s STRING", "DOUBLE", r"try_cast(nullif(regexp_extract(replace(coalesce(s, ''), ',', ''), r'-?\d+(\.\d+)?([eE][-+]?\d+)?', 0), '') AS DOUBLE)"),
    ("token_budget", "n BIGINT", "INT", "CASE WHEN n <= 0 THEN NULL WHEN n <= 1000 THEN 786 ELSE cast(least(8129, 786 + 256 * floor((n - 1000) / 500)) AS INT) END"),
    ("decade_of", "y INT", "INT", "cast(floor(coalesce(y, 0) / 10) * 10 AS INT)"),
)


def register(spark: SparkSession) -> list[str]:
    """Make the functions and table functions known to a session; their names."""
    names = []
    for name, params, kind, body in SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {kind} RETURN {body}")
        names.append(name)

    @pandas_udf(T.StringType())
    def nfkc(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    @pandas_udf(T.StringType())
    def nfkd(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x))

    @udtf(returnType="table_no int, caption string, header array<string>, row_no int, cells array<string>")
    class PipeTables:
        def eval(self, text: str):
            for n, (caption, header, rows) in enumerate(scan_tables(text or ""), 1):
                for r, cells in enumerate(rows):
                    yield n, caption, header, r, cells

    @udtf(returnType="section string, line_no int, line string")
    class MdSections:
        def eval(self, text: str):
            for name, lines in parse_article(text or "")["sections"].items():
                for k, line in enumerate(lines):
                    yield name, k, line

    @udtf(returnType="ord int, json string")
    class JsonFragments:
        def eval(self, text: str):
            yield from enumerate(J.fragments(text or ""))

    @udtf(returnType="table_no int, row_no int, cells array<string>")
    class HtmlTables:
        def eval(self, html: str):
            page = _Html()
            page.feed(html or "")
            for n, rows in enumerate(page.tables, 1):
                for r, cells in enumerate(rows):
                    yield n, r, [" ".join(c.split()) for c in cells]

    @udtf(returnType="url string")
    class HtmlLinks:
        def eval(self, html: str):
            page = _Html()
            page.feed(html or "")
            for u in dict.fromkeys(page.links):
                yield (u,)

    for name, f in (("nfkc", nfkc), ("nfkd", nfkd), ("repair_json", J.repaired_json)):
        spark.udf.register(name, f)
        names.append(name)
    for name, f in (("pipe_tables", PipeTables), ("md_sections", MdSections), ("json_fragments", JsonFragments), ("html_tables", HtmlTables), ("html_links", HtmlLinks)):
        spark.udtf.register(name, f)
        names.append(name)
    return sorted(names)
