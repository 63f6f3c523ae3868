"""Training-corpus pipeline: quality classifier, line dedup, near-duplicates, decontamination, mixing.

Each stage takes all that its predecessor kept and returns the columns of ``documents`` (text and n_chars as the stage
leaves them); the last one adds how often the mix takes each document and leaves out those that it does not take.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.llm import decontam, linededup, minhash, mixing, quality
from paperlake.llm.common import cut, read, shared_dir
from paperlake.operators.order import spread

QUALITY_THRESHOLD = 0.3
NEAR_PERCENT = 80


def _free(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one that is not yet a column."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` with n_chars, where there is one, as the text is now."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return docs.select(*columns)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least the threshold; the held-out fifth of the labels is not learned from. A null text is judged as empty."""
    net = quality.train(docs, read(spark, sf_dir, "labels"))
    columns, score = docs.columns, _free(docs, "score")
    return quality.predict(docs, net, columns, out=score).where(F.col(score) >= QUALITY_THRESHOLD).select(*columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are boilerplate of their source; none goes.

    Rows of equal text count as one page here, so that copies don't make each other boilerplate before the next stage keeps one of them.
    Own columns n_lines and n_dropped stay.
    """
    own = {c: _free(docs, f"_{c}") for c in ("n_lines", "n_dropped") if c in docs.columns}
    kept = linededup.drop_lines(docs.withColumnsRenamed(own), copies=False).drop("n_lines", "n_dropped").withColumnsRenamed({v: k for k, v in own.items()})
    return _counted(kept, docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (likeness of at least ``NEAR_PERCENT``), the one of the lowest id.

    Rows of equal id and text are one document. A row without an id, or with an id that rows of other texts have too, goes by a hash
    of its id and text, so that two texts under one id are two documents.
    """
    key, one = _free(docs, "_key"), _free(docs, "_id")
    text = F.coalesce(F.xxhash64("text"), F.lit(0))
    several = cut(docs.groupBy(F.col("doc_id").alias(one)).agg(F.min(text).alias("low"), F.max(text).alias("high")).where(f"low < high OR `{one}` IS NULL").select(one))
    own = F.when(F.col(one).isNotNull() | F.col("doc_id").isNull(), F.xxhash64(F.col("doc_id").isNull(), "doc_id", text)).otherwise(F.col("doc_id").cast("long"))
    keyed = docs.join(several, F.col("doc_id").eqNullSafe(F.col(one)), "left").withColumn(key, own).drop(one)
    kept = minhash.near_duplicates(keyed.select(key, "text"), id_column=key, percent=NEAR_PERCENT).where("kept").select(F.col("doc_id").alias(one)).distinct()
    return keyed.join(kept, F.col(key) == F.col(one)).dropDuplicates([key]).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the benchmark's passages; one that is nothing but such passages goes."""
    return _counted(decontam.remove(docs, read(spark, sf_dir, "benchmark")), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with size, source_size, target and copies (1 to 3); columns of these four names are replaced."""
    made, key = ["size", "source_size", "target", "copies"], _free(docs, "_key")
    keyed = docs.drop(*made).withColumn(key, F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text"))
    mixed = mixing.mix(keyed.select(F.col(key).alias("doc_id"), "text", "source")).where("copies > 0").dropDuplicates(["doc_id"])
    return keyed.join(mixed.select(F.col("doc_id").alias(key), *made), key).drop(key)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_filter),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
]

#: The classifier and the knapsack have no SQL form; tests hold the operators against brute force, and the stages against cases of their edges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet to the shared folder and read again."""
    docs = spread(read(spark, sf_dir, "documents"))
    base = f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{base}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
