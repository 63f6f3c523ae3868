"""Providers of what comes from outside: bibliographic search, full texts, databases, language models.

An effect runs inside ``mapInPandas`` over a table of requests, so that concurrency is the number of partitions and a failed task
is tried again by Spark. The defaults answer offline and always the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


@dataclass
class Registry:
    """Named providers: functions from a request (dict) to a response (dict)."""

    functions: dict[str, Callable[[dict], dict]] = field(default_factory=dict)

    def register(self, name: str, f: Callable[[dict], dict]) -> None:
        self.functions[name] = f

    def call(self, name: str, requests: DataFrame, schema: str, tries: int = 3, concurrency: int | None = None) -> DataFrame:
        """Responses with ``ok`` and ``error``; a failing request is tried again and then answered with its error."""
        f = self.functions[name]
        columns = [c.split()[0] for c in schema.split(",")]

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                out = []
                for r in pdf.to_dict("records"):
                    error = ""
                    for _ in range(tries):
                        try:
                            got = f(r)
                            out.append([got.get(c) for c in columns] + [True, ""])
                            break
                        except Exception as e:  # the provider's fault, told in the row
                            error = f"{type(e).__name__}: {e}"
                    else:
                        out.append([r.get(c) for c in columns] + [False, error])
                yield pd.DataFrame(out, columns=[*columns, "ok", "error"])

        if concurrency:
            requests = requests.repartition(concurrency)
        return requests.mapInPandas(run, schema + ", ok boolean, error string")


def route_offline(text: Column) -> Column:
    """Type of a paper by its words alone: process, property, both or none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    process, prop = low.rlike("deposit|sputter|anneal|sinter|synthes|fabricat|grown"), low.rlike("conductivity|coefficient|polarization|resistivity|permittivity|figure of merit")
    return F.when(process & prop, "both").when(process, "process").when(prop, "property").otherwise("none")


def normalize_hits(hits: DataFrame) -> DataFrame:
    """Search hits (title, authors as text, year, venue, doi, url, citation_count, abstract, tldr, keyword, source) as papers; without title and DOI a hit falls away."""
    t = lambda c: F.nullif(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(""))
    doi, title = t("doi"), t("title")
    authors = F.filter(F.transform(F.split(F.coalesce(t("authors"), F.lit("")), "[;,]"), lambda x: F.trim(x)), lambda x: x != "")
    return hits.where(doi.isNotNull() | title.isNotNull()).select("keyword", title.alias("title"), authors.alias("authors"), F.col("year").cast("string").try_cast("int").alias("year"), t("venue").alias("venue"), doi.alias("doi"), F.coalesce(t("source"), F.lit("unknown")).alias("source"), F.coalesce(t("url"), F.concat(F.lit("https://doi.org/"), doi)).alias("url"), F.col("citation_count").cast("string").try_cast("int").alias("citation_count"), F.coalesce(t("abstract"), t("tldr"), F.lit("")).alias("abstract"))


class _Reader(DataSourceReader):
    def __init__(self, pages: int, fetch):
        self.pages, self.fetch = pages, fetch

    def partitions(self):
        return [InputPartition(i) for i in range(self.pages)]

    def read(self, partition):
        yield from self.fetch(partition.value)


class PaperSource(DataSource):
    """Batch source ``papers``: one partition per result page; option ``pages``. ``fetch`` is the transport, a page number to rows; the default has fixed rows for tests."""

    fetch = staticmethod(lambda page: [(f"10.1/{page}", f"Paper {page}", 2000 + page)])

    @classmethod
    def name(cls):
        return "papers"

    def schema(self):
        return "doi string, title string, year int"

    def reader(self, schema):
        return _Reader(int(self.options.get("pages", "1")), type(self).fetch)
