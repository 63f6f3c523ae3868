"""Order over whole tables without bringing them to one task, tables written between the steps of a loop, and small inputs dealt to all cores."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the folder that driver and executors share (spark.checkpoint.dir) and read again, which cuts its lineage."""
    context = df.sparkSession.sparkContext
    path = context.getConf().get("spark.checkpoint.dir")
    if not path:
        if context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="paperlake-")
        context._conf.set("spark.checkpoint.dir", path)
    path = f"{path.rstrip('/')}/steps/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, split_bytes: int = 64 << 20) -> DataFrame:
    """``df`` dealt to all cores where its input is small and comes in fewer splits than there are cores, as one file of one row group does.

    An input of more than ``split_bytes`` for each core stays as it is, and so does one that has splits enough.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < cores * split_bytes and df.select(F.spark_partition_id()).distinct().count() < cores:
        return df.repartition(cores)
    return df


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to the path to its end; an error in finding out is not taken for an answer."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def places(df: DataFrame, out: str, *order: Column) -> DataFrame:
    """``df`` with ``out``, the row's place in the order of all rows, from 1.

    Rows are dealt in ranges of the order and written; the driver learns the size of each range alone, and each range numbers its own rows.
    """
    names = [f"_o{i}" for i in range(len(order))]
    rows = df.withColumns(dict(zip(names, order, strict=True)))
    rows = written(rows.repartitionByRange(*names).withColumn("_range", F.spark_partition_id()))
    sizes = {r["_range"]: r["n"] for r in rows.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()}
    before = [sum(n for q, n in sizes.items() if q < p) for p in range(max(sizes, default=0) + 1)]
    first = F.get(F.from_json(F.lit(str(before)), "array<bigint>"), F.col("_range"))
    return rows.withColumn(out, first + F.row_number().over(Window.partitionBy("_range").orderBy(*names))).drop("_range", *names)
