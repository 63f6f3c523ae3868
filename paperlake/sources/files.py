"""Scans and sinks of document folders, tables, JSON and ledgers."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperlake.functions import text as X
from paperlake.operators import documents as D
from paperlake.operators.order import finished

MAX_BYTES = 100 * 1024 * 1024


def scan_documents(spark: SparkSession, path: str, done: DataFrame | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """path, stem, format, length, content of the files under a folder, without those over the cap and those whose stem is done already."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") <= max_bytes)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(\.[A-Za-z0-9]+){1,2}$", "")
    files = files.select("path", stem.alias("stem"), X.format_of(F.col("path")).alias("format"), "length", "modificationTime", "content")
    return files if done is None else files.join(done.select("stem").distinct(), "stem", "left_anti")


def _decode(files: DataFrame) -> DataFrame:
    """path, format and raw text; gzipped files are unpacked, of an archive of LaTeX sources the main one is taken."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            raw = []
            for f, b in zip(pdf.format, pdf.content, strict=True):
                b = bytes(b)
                raw.append(D.main_tex(b) if f == "tex" else (gzip.decompress(b) if b[:2] == b"\x1f\x8b" else b).decode("utf-8", "replace"))
            yield pd.DataFrame({"path": pdf.path, "format": pdf.format, "raw": raw})

    return files.select("path", "format", "content").mapInPandas(run, "path string, format string, raw string")


def to_markdown(files: DataFrame) -> DataFrame:
    """path, text and status of scanned files by their format; PDFs need a provider and come back as unsupported."""
    decoded = files.withColumn("format", F.when(F.lower("path").endswith(".xml.gz"), "xml").otherwise(F.col("format")))
    decoded = _decode(decoded.where(F.col("format").isin("txt", "md", "xml", "tex"))).unionByName(decoded.where(~F.col("format").isin("txt", "md", "xml", "tex")).select("path", "format", F.lit(None).cast("string").alias("raw")))
    part = lambda f, how: D.convert(decoded.where(F.col("format") == f), how, "path", "raw")
    plain = decoded.where(F.col("format").isin("txt", "md")).select("path", F.col("raw").alias("text"), F.lit("ok").alias("status"))
    rest = decoded.where(~F.col("format").isin("txt", "md", "xml", "tex")).select("path", F.lit(None).cast("string").alias("text"), F.lit("unsupported").alias("status"))
    return plain.unionByName(part("xml", D.xml_to_markdown)).unionByName(part("tex", lambda t: (D.latex_to_markdown(t), "ok"))).unionByName(rest)


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """file, __table_row (2 for the first row under the header) and the cells of CSV tables, all as strings."""
    rows = spark.read.option("header", "true").option("multiLine", "true").csv(path).withColumn("file", F.col("_metadata.file_name"))
    order = Window.partitionBy("file").orderBy(F.monotonically_increasing_id())
    return rows.withColumn("__table_row", F.row_number().over(order) + 1)


def read_json(spark: SparkSession, path: str, schema: str | None = None, lines: bool = False) -> DataFrame:
    """JSON or JSONL in which damaged records are left out."""
    r = spark.read.option("mode", "DROPMALFORMED").option("multiLine", str(not lines).lower())
    return (r.schema(schema) if schema else r).json(path)


def read_dois(spark: SparkSession, path: str) -> DataFrame:
    t = spark.read.text(path).select(F.trim("value").alias("doi"))
    return t.where((F.col("doi") != "") & ~F.col("doi").startswith("#")).distinct()


def latest_batch(paths: DataFrame) -> DataFrame:
    """The path (path, mtime) with the newest stamp in its name, else the newest file time."""
    from paperlake.functions.numeric import batch_stamp

    return paths.agg(F.max_by("path", F.struct(F.coalesce(batch_stamp(F.col("path")), F.lit("")), F.col("mtime"))).alias("path"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV whose cells hold no line ends; empty strings stay empty strings when read again."""
    strings = [c for c, t in df.dtypes if t == "string"]
    df.withColumns({c: X.csv_cell(F.col(c)) for c in strings}).write.mode("overwrite").option("header", "true").option("quoteAll", "true").option("emptyValue", "").csv(path)


def write_batch(df: DataFrame, path: str, partition: str = "batch") -> None:
    """Idempotent overwrite of the batches in ``df`` alone."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def append_events(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_rules(records: DataFrame, path: str, schemas: DataFrame | None = None) -> None:
    """Records as JSON lines, and next to them their schemas if given."""
    records.write.mode("overwrite").json(f"{path}/records")
    if schemas is not None:
        schemas.write.mode("overwrite").json(f"{path}/schemas")


def write_extractions(rows: DataFrame, path: str) -> None:
    """Extracted entries as JSON, a folder for each batch, paper and kind (columns batch, doc, kind), of which those in ``rows`` are overwritten."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "doc", "kind").json(path)


def write_results(papers: DataFrame, path: str, keywords: list[str], ord_column: str = "ord") -> None:
    """doi_list (distinct, by first place), results and keywords of a retrieval."""
    dois = papers.where("coalesce(doi, '') <> ''").groupBy("doi").agg(F.min(ord_column).alias("o"))
    dois.orderBy("o").select("doi").write.mode("overwrite").text(f"{path}/doi_list")
    papers.write.mode("overwrite").json(f"{path}/results")
    papers.sparkSession.createDataFrame([(k,) for k in dict.fromkeys(keywords)], "value string").write.mode("overwrite").text(f"{path}/keywords")


def add_claims(claims: DataFrame, path: str) -> None:
    """Claims appended to a repository of JSON lines."""
    claims.write.mode("append").json(path)


def claims_of(spark: SparkSession, path: str, schema: str, status: str | None = None) -> DataFrame:
    """The repository's claims, the last one written of each claim_id; of one status if given."""
    rows = spark.read.schema(schema).json(path).withColumns({"_t": F.col("_metadata.file_modification_time"), "_p": F.col("_metadata.file_path")})
    last = rows.withColumn("_n", F.row_number().over(Window.partitionBy("claim_id").orderBy(F.desc("_t"), F.desc("_p")))).where("_n = 1").drop("_n", "_t", "_p")
    return last if status is None else last.where(F.col("status") == status)


def cached(rows: DataFrame, key: str, version: str, path: str, extract, schema: str) -> DataFrame:
    """``extract`` of rows, from a ledger of what was extracted before under this version; only rows whose key is not there go through it.

    The ledger is a table partitioned by version: another version starts anew and leaves the old one.
    """
    spark = rows.sparkSession
    place = f"{path}/version={version}"
    if finished(spark, place):
        known = spark.read.schema(schema).parquet(place)
        rows = rows.join(known.select(key).distinct(), key, "left_anti")
    extract(rows).write.mode("append").parquet(place)
    return spark.read.schema(schema).parquet(place)
