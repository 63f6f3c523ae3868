"""Line dedup by site-relative frequency, in DataFrame operations only.

Within a site (the host of a page; the source of a document), the pages that hold a line are divided by the site's pages, and
lines over the ratio are boilerplate and are dropped. The page at hand counts on neither side of the fraction: what matters is on how many of the
site's other pages its line is. So a line of one page alone is boilerplate on no site, however small, without a minimum of pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlake.llm.common import cut

RATIO = 0.05
TRIM = r" \t\r"


def boilerplate(docs: DataFrame, site: str = "source", text: str = "text", ratio: float = RATIO, copies: bool = True) -> DataFrame:
    """site, n_pages, and ``lines``: hashes of the lines that more than ``ratio`` of the site's other pages hold.

    Every row is a page. With ``copies`` false, rows of equal text are one page: then a page that was fetched many times has
    no boilerplate for that, and is left to duplicate removal. All counting is on hashes and combines before the shuffle, so neither a large
    site nor a very common line meets in one task. A site has at most (mean lines of a page) / ratio such lines, which bounds the collected array.
    """
    pages = docs.select(F.col(site).alias("site"), F.xxhash64(text).alias("page"), F.col(text).alias("text")).where("text IS NOT NULL")
    lines = F.expr(f"array_distinct(transform(filter(transform(split(text, '\\n'), l -> trim(BOTH '{TRIM}' FROM l)), l -> l <> ''), l -> xxhash64(l)))")
    held = pages.select("site", "page", F.explode(F.array_append(lines, F.lit(None).cast("long"))).alias("line"))  # the null row stands for the page itself
    if not copies:
        held = held.groupBy("site", "line", "page").agg(F.lit(1).alias("one"))
    counts = cut(held.groupBy("site", "line").agg(F.count(F.lit(1)).alias("n")).where("line IS NULL OR n > 1"))
    totals = counts.where("line IS NULL").select(F.col("site").alias("s"), F.col("n").alias("n_pages"))
    common = counts.where("line IS NOT NULL").join(totals, F.col("site").eqNullSafe(F.col("s"))).where(F.col("n") - 1 > F.lit(ratio) * (F.col("n_pages") - 1))
    return common.groupBy("site", "n_pages").agg(F.collect_set("line").alias("lines"))


def drop_lines(docs: DataFrame, site: str = "source", text: str = "text", ratio: float = RATIO, copies: bool = True) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text`` and with ``n_lines`` and ``n_dropped``.

    Lines end at line feeds and are compared without spaces, tabs and carriage returns around them; blank lines stay. A page
    of nothing but boilerplate becomes empty. Null texts stay null with 0 lines and count as no page; documents of a null site form a
    site. Columns named n_lines or n_dropped are replaced.
    """
    common = cut(boilerplate(docs, site, text, ratio, copies)).select(F.col("site").alias("_site"), F.col("lines").alias("_common"))
    docs = docs.drop("n_lines", "n_dropped")
    joined = docs.join(common, F.col(site).eqNullSafe(F.col("_site")), "left")  # broadcast only if the written table is below Spark's threshold
    joined = joined.withColumn("_lines", F.split(text, "\n"))
    joined = joined.withColumn("_kept", F.expr(f"CASE WHEN _common IS NULL OR _lines IS NULL THEN _lines ELSE filter(_lines, l -> NOT array_contains(_common, xxhash64(trim(BOTH '{TRIM}' FROM l)))) END"))
    n_lines, n_dropped = F.coalesce(F.size("_lines"), F.lit(0)), F.coalesce(F.size("_lines") - F.size("_kept"), F.lit(0))
    sized = {k: F.when(F.col("_lines").isNull(), 0).otherwise(v).cast("long") for k, v in (("n_lines", n_lines), ("n_dropped", n_dropped))}
    return joined.withColumns({**sized, text: F.array_join("_kept", "\n")}).select(*docs.columns, "n_lines", "n_dropped")
