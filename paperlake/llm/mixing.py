"""Mixing sources to target weights by subset-sum budget fitting.

Each source has a target number of words. Whole passes over the source use up as much of it as they can; for what remains, documents are
counted by exact length, every length gives its proportional share of documents, and a bounded-knapsack dynamic
program over the lengths' remaining counts fits the rest of the budget. Which documents of a length are taken is
decided by a seeded hash.

What a task or the driver holds does not grow with the documents or the sources: the program sees one source's lengths and counts,
the driver one row of sums at a time. Documents of one source and length are split by their hash, so that a length that a third of all
documents share is ranked in many tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperlake.llm.common import cut
from paperlake.operators.order import places

WORD = r"[^\x20\x09-\x0D]+"
REPEATS = 3
SEED = 17
SLICES = 1024


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = REPEATS) -> DataFrame:
    """source, source_size, target for a frame of one row per source (source, source_size).

    Sources in code point order, null last, weigh 1, 2, 3 and again. A source's share of the sum by weight is weight * level; while a share is above
    ``repeats`` times its source's size, it stops there and the level rises for the others by what it leaves. Each round is one row of sums, and a source that
    has stopped stays so, so the rounds end.
    """
    df = places(sizes, "place", F.col("source").isNull(), F.col("source"))
    df = df.withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.pmod(F.col("place") - 1, F.lit(len(weights))).cast("int")).cast("long")).withColumn("cap", F.col("source_size") * repeats)
    df = cut(df.select("source", "source_size", "weight", "cap"))
    total, level, stopped = df.agg(F.sum("source_size")).first()[0] or 0, 0.0, -1
    while True:
        above = F.col("cap") < F.col("weight") * F.lit(level)
        n, capped, weight = df.agg(F.count_if(above), F.coalesce(F.sum(F.when(above, F.col("cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0))).first()
        if n == stopped or not weight:
            return df.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level)).alias("target"))
        stopped, level = n, (total - capped) / weight


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length, at most ``counts``, give the largest sum that is not above the budget.

    Bits of a number are the sums that can be made; each step adds a power-of-two bundle of one length. Only every so manieth of these numbers is
    kept, and those between are made again on the way back, so the memory is that of twice the root of the steps.
    """
    take = np.zeros(len(lengths), dtype=np.int64)
    steps: list[tuple[int, int]] = []
    for i, (a, c) in enumerate(zip(lengths.tolist(), counts.tolist(), strict=True)):
        left, bundle = min(c, budget // a), 1
        while left > 0:
            n = min(bundle, left)
            steps.append((i, n))
            left, bundle = left - n, bundle * 2
    mask, stride = (1 << (budget + 1)) - 1, max(1, math.isqrt(len(steps)))

    def after(reach: int, step: tuple[int, int]) -> int:
        return reach | reach << step[1] * int(lengths[step[0]]) & mask

    kept, reach, done = [], 1, 0
    for k, step in enumerate(steps):
        if reach >> budget & 1:
            break
        if k % stride == 0:
            kept.append(reach)
        reach, done = after(reach, step), k + 1
    at = reach.bit_length() - 1
    for block in range(len(kept) - 1, -1, -1):
        low, high = block * stride, min(done, (block + 1) * stride)
        before = [kept[block]]
        for step in steps[low : high - 1]:
            before.append(after(before[-1], step))
        for (i, n), reach in zip(reversed(steps[low:high]), reversed(before), strict=True):
            if not reach >> at & 1:
                take[i] += n
                at -= n * int(lengths[i])
    return take


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their lengths add up to the budget, or as near below it as the program can get.

    ``lengths`` are positive and distinct. Proportional shares first, rounded down; then one more document per length
    from the longest down while the rest is over the longest length; then an exact bounded knapsack over the rest, which
    is a few times the longest length at most and so does not grow with the corpus.
    """
    take = np.zeros(len(lengths), dtype=np.int64)
    total = sum(int(a) * int(b) for a, b in zip(lengths, counts, strict=True))
    budget = min(budget, total)
    if not len(lengths) or budget <= 0:
        return take
    take[:] = [int(c) * budget // total for c in counts]
    rest = budget - sum(int(a) * int(b) for a, b in zip(lengths, take, strict=True))
    order = np.argsort(-lengths, kind="stable")
    longest = int(lengths.max())
    for i in order:
        n = min(int(counts[i] - take[i]), max(0, rest - 2 * longest) // int(lengths[i]), 1)
        take[i] += n
        rest -= n * int(lengths[i])
    back = order[::-1]
    take[back] += knapsack(lengths[back], (counts - take)[back], rest)
    return take


def _fit_source(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("size", ignore_index=True)
    size, target = int(pdf.source_size[0]), float(pdf.target[0])
    whole = min(REPEATS, int(target // size)) if size else 0
    take = fit(pdf["size"].to_numpy(), pdf["n"].to_numpy(), round(target - whole * size)) if whole < REPEATS else np.zeros(len(pdf), dtype=np.int64)
    return pd.DataFrame({"source": pdf.source, "size": pdf["size"], "whole": whole, "quota": take})


def mix(docs: DataFrame, seed: int = SEED, slices: int = SLICES, repeats: int = REPEATS) -> DataFrame:
    """doc_id, source, size, source_size, target and ``copies`` (how often the mix takes the document, 0 to ``repeats``).

    Size is the number of words; null texts and texts without words have size 0 and are never taken. Documents of a null source are one source.
    Repeated rows are documents of their own; which of several rows with one id is taken is arbitrary, how many is not. Needs doc_id, text
    and source, drops other columns. An empty table gives no rows.
    """
    assert repeats == REPEATS, "fits are made for REPEATS"
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = cut(docs.select("doc_id", "source", size.alias("size"), F.xxhash64(F.lit(seed), "doc_id").alias("draw")))
    sized = sized.withColumn("slice", F.pmod(F.shiftright("draw", 40), F.lit(slices)).cast("int"))
    counts = cut(sized.groupBy("source", "size", "slice").agg(F.count(F.lit(1)).alias("n")))
    per_source = cut(targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))))
    renamed = per_source.select(F.col("source").alias("s"), "source_size", "target")
    lengths = counts.where("size > 0").groupBy("source", "size").agg(F.sum("n").alias("n")).join(renamed, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    fitted = lengths.groupBy("source").applyInPandas(_fit_source, "source string, size long, whole long, quota long")
    # full slices give all their documents, the one in which the quota ends gives its first
    running = Window.partitionBy("source", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    f = fitted.select(F.col("source").alias("fs"), F.col("size").alias("fz"), "whole", "quota")
    quotas = counts.where("size > 0").join(f, F.col("source").eqNullSafe(F.col("fs")) & (F.col("size") == F.col("fz")))
    left = F.col("quota") - F.coalesce(F.sum("n").over(running), F.lit(0))
    quotas = cut(quotas.select("source", "size", "slice", "whole", F.greatest(F.lit(0), F.least("n", left)).alias("give"), "n"))
    q = quotas.select(F.col("source").alias("qs"), F.col("size").alias("qz"), F.col("slice").alias("ql"), "whole", "give", "n")
    given = sized.join(q, F.col("source").eqNullSafe(F.col("qs")) & (F.col("size") == F.col("qz")) & (F.col("slice") == F.col("ql")), "left")
    given = given.join(renamed, F.col("source").eqNullSafe(F.col("s")), "left")
    partial = (F.col("give") > 0) & (F.col("give") < F.col("n"))
    cols = ["doc_id", "source", "size", "source_size", "target"]
    plain = given.where(~F.coalesce(partial, F.lit(False))).select(*cols, (F.coalesce("whole", F.lit(0)) + F.when(F.col("give") > 0, 1).otherwise(0)).alias("copies"))
    rank = F.row_number().over(Window.partitionBy("source", "size", "slice").orderBy("draw", "doc_id"))
    drawn = given.where(partial).withColumn("rank", rank).select(*cols, (F.col("whole") + F.when(F.col("rank") <= F.col("give"), 1).otherwise(0)).alias("copies"))
    return plain.unionByName(drawn)


def expand(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The documents that the mix takes, one row per copy, with ``copy`` 1, 2, ...; joined on doc_id, which must be unique."""
    taken = mixed.where("copies > 0").select(F.col("doc_id").alias("_id"), "copies")
    return docs.join(taken, F.col("doc_id") == F.col("_id")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("_id", "copies")
