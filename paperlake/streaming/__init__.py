"""Incremental and stateful behaviours on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from paperlake.operators.order import finished


def new_files(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", per_trigger: int | None = None) -> DataFrame:
    """Stream of files that were not read before; the checkpoint is the watermark of what has been."""
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger) if per_trigger else spark.readStream.schema(schema)
    return r.format(fmt).load(path)


def ingest(stream: DataFrame, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda d: d, ledger_key: str | None = None) -> None:
    """Process what is new and stop; with a ledger key, rows whose key was written before are skipped, failed ones too."""

    def each(batch: DataFrame, n: int) -> None:
        rows = batch
        if ledger_key:
            if finished(batch.sparkSession, out):
                rows = rows.join(batch.sparkSession.read.parquet(out).select(ledger_key).distinct(), ledger_key, "left_anti")
            rows = rows.dropDuplicates([ledger_key])
        transform(rows).write.mode("append").parquet(out)

    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per window and type; works on a stream and on a table alike."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def breaker_rows(rows: pd.DataFrame, state: tuple[int, float], threshold: int, cooldown: float) -> tuple[pd.DataFrame, tuple[int, float]]:
    """Availability before each event (t, failed, ok) and the state after: failures so far and when the breaker opened (below 0: closed)."""
    n, opened = state
    out = []
    for t, failed, ok in zip(rows.t, rows.failed, rows.ok, strict=True):
        if opened >= 0 and t - opened >= cooldown:
            n, opened = 0, -1.0
        out.append(opened < 0)
        if ok:
            n, opened = 0, -1.0
        elif failed:
            n += 1
            opened = t if n >= threshold else opened
    return rows.assign(available=out, failures=n), (n, opened)


def breaker(events: DataFrame, threshold: int = 5, cooldown: float = 600.0) -> DataFrame:
    """Events (provider, t, failed, ok) with whether the provider was available; a stream keeps the state, a table runs in time order per provider."""
    out = "provider string, t double, available boolean"
    if not events.isStreaming:
        return events.groupBy("provider").applyInPandas(lambda pdf: breaker_rows(pdf.sort_values("t"), (0, -1.0), threshold, cooldown)[0][["provider", "t", "available"]], out)

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else (0, -1.0)
        for pdf in batches:
            rows, now = breaker_rows(pdf.sort_values("t"), now, threshold, cooldown)
            yield rows[["provider", "t", "available"]]
        state.update(now)

    return events.groupBy("provider").applyInPandasWithState(step, out, "failures int, opened double", "append", GroupStateTimeout.NoTimeout)
