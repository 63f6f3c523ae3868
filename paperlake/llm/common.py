"""Shared helpers: reading tables, cutting lineage through written tables, Arrow batches as plain lists."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset in local mode (tests)."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="paperlake-")
        spark.sparkContext._conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def cut(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    The plan that follows starts from replicated files, so a lost executor costs no recomputation of what came
    before, and Spark knows the real size of what it reads when it chooses a join.
    """
    path = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    if partitions:
        df = df.coalesce(partitions)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(id_column: str, divisor: int, remainder: int):
    """Column: crc32 of the id as text leaves this remainder; an id of null counts as held out by no rule (false)."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % divisor == remainder, F.lit(False))


def small_batches(spark: SparkSession, rows: int = 2000, size: str = "16m") -> None:
    """Bound what one Arrow batch holds, so that very long texts do not add up in a Python worker. A smaller setting stays."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    except Exception:  # a version without that setting
        pass


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, divisor: int, remainder: int, rows: int, seed: int = 1) -> DataFrame:
    """Documents with their 0/1 ``label``: about ``rows`` of the labelled ones outside the held-out ids, chosen by a seeded hash of the id.

    The share kept is rows / labelled rows, so the sampled labels, which are broadcast, number about ``rows`` whatever
    the size of the table. Several labels of one id count as their maximum; rows with a null id or label are left out.
    Rows of one id give one example, the one of the highest text, so that repeated ids don't make the sample larger.
    """
    labels = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).where(~held_out("doc_id", divisor, remainder))
    labels = labels.groupBy("doc_id").agg(F.max(label).cast("int").alias("_label"))
    share = min(1.0, rows / max(1, labels.count()))
    labels = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))).select(F.col("doc_id").alias("_id"), "_label")
    found = docs.select("doc_id", "text").join(F.broadcast(labels), F.col("doc_id") == F.col("_id"))
    return found.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("_label").alias("_label"))


def salted(left: DataFrame, right: DataFrame, key: str, size: str, salt_by: str, run: int, how: str = "inner") -> DataFrame:
    """Join on ``key`` where ``left`` has many rows of a key and ``right`` one, both with ``size``, the key's rows in ``left``.

    A key of many rows is dealt, by a hash of ``salt_by``, to tasks of about ``run`` rows each, and the one row goes to each of them.
    """
    runs = F.ceil(F.col(size) / run).cast("int")
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), runs - 1))).drop(size)
    return left.withColumn("_salt", F.pmod(F.xxhash64(salt_by), runs).cast("int")).join(right, [key, "_salt"], how).drop("_salt")
