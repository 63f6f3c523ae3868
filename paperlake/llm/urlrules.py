"""URL filters: a sort-merge range join between urls and host/path rules, in DataFrame operations only.

A host is turned into its reversed labels, each followed by a dot (``www.example.net`` -> ``net.example.www.``), so
"this host and all its subdomains" is one interval of sorted keys. Intervals of such prefixes are nested or disjoint.
Urls and interval starts are sorted together; going through them in order, the stack of open intervals at any place is
the stack at the latest start, less those intervals that have ended since. Each start carries its own stack, which is
found among the rules alone. The path test and the choice of the longest rule then look at that stack only.

Partitions of the sort are (top-level label, salt); urls are salted by their hash, and a rule is repeated once per salt,
so a label or host that holds a third of all urls is spread over all salts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlake.llm.common import shuffle_partitions

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty for null or no ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null or no ``://``."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _stacks(rules: DataFrame) -> DataFrame:
    """One row per rule host: its key and the rules of all hosts whose interval holds it, its own included."""
    own = (
        rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
        .select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict")
        .withColumn("key", host_key(F.col("host")))
        .groupBy("key")
        .agg(F.collect_set(F.struct("key", "path", F.concat("host", "path").alias("rule"), "verdict")).alias("own"))
    )
    labels = F.split(F.expr("left(key, length(key) - 1)"), r"\.")
    above = own.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.array_join(F.slice(labels, 1, i), "."), F.lit(".")))).alias("up"))
    return above.join(own.select(F.col("key").alias("up"), "own"), "up").groupBy("key").agg(F.flatten(F.collect_list("own")).alias("stack"))


def judge(urls: DataFrame, rules: DataFrame, url_column: str = "url", default: str = "allow", salts: int | None = None) -> DataFrame:
    """All columns of ``urls`` with host, path, rule and verdict.

    ``rules`` has host, path and verdict (``block`` or ``allow``); a rule with a null in any of them is ignored. Of the
    rules that fit, the one with the longest host + path wins; of equal ones with both verdicts, ``block``. A url that no
    rule fits has a null rule and the verdict ``default``. Null urls have an empty host and path. Columns of ``urls``
    with one of the four result names are replaced. Repeated rows stay; an empty table gives an empty result. A stack is as long as
    the rules of one host and its parent hosts, so hosts with very many path rules make it slow.
    """
    salts = salts or max(8, shuffle_partitions(urls.sparkSession))
    kept = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    url, key = F.col(f"`{url_column}`"), F.col("key")
    first = F.substring_index(key, ".", 1)
    asked = urls.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), host_of(url).alias("host"), path_of(url).alias("path"), F.pmod(F.xxhash64(url), F.lit(salts)).cast("int").alias("salt"))
    asked = asked.withColumn("key", host_key(F.col("host"))).select("key", first.alias("top"), "salt", F.lit(1).alias("kind"), "host", "path", "row")
    starts = _stacks(rules).select("key", first.alias("top"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), "stack")
    sweep = Window.partitionBy("top", "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = asked.unionByName(starts, allowMissingColumns=True).withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
    best = F.expr("array_max(transform(filter(stack, r -> startswith(key, r.key) AND startswith(path, r.path)), r -> struct(length(r.rule) AS n, r.verdict AS verdict, r.rule AS rule)))")
    return swept.select("row", "host", "path", best.alias("best")).select("row.*", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
