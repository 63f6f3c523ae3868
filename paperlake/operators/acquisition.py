"""Acquisition of full texts: outcome classes, candidates, audits, breaker states, and steps of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Statuses after which another try makes sense.
RETRYABLE = (408, 425, 429, 500, 502, 503, 504)


def classify_response(status: Column, content_type: Column) -> Column:
    """struct of class and retryable."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    name = (
        F.when(status.isin(401, 403), "access_denied").when(status.isin(404, 410), "not_found").when(status == 429, "rate_limited").when(status.isin(*RETRYABLE), "provider_unavailable")
        .when(~status.between(200, 299), "http_error").when(F.contains(kind, F.lit("html")), "html_landing_page").when(F.contains(kind, F.lit("xml")) | F.contains(kind, F.lit("json")), "structured_response_not_pdf").otherwise("ok")
    )
    return F.struct(name.alias("class"), name.isin("rate_limited", "provider_unavailable").alias("retryable"))


def classify_exception(name: Column, message: Column, status: Column) -> Column:
    """struct of class and decision for an exception."""
    text = F.lower(F.concat_ws(" ", name, message))
    kind = (
        F.when(F.contains(text, F.lit("memory")), "resource").when((status == 429) | text.rlike("rate.?limit|too many requests"), "rate_limited").when(text.rlike("quota|insufficient|balance"), "quota")
        .when(status.isin(*RETRYABLE) | text.rlike("timeout|timed out|connection|network"), "network").when(text.rlike("json|parse|decode"), "parse").when(text.rlike("filenotfound|no such file"), "missing_input").otherwise("unknown")
    )
    decision = F.when(kind.isin("rate_limited", "network"), "retry").when(kind == "resource", "degrade").when(kind.isin("parse", "missing_input"), "skip").otherwise("abort")
    return F.struct(kind.alias("class"), decision.alias("decision"))


def is_quota_error(message: Column) -> Column:
    return F.coalesce(F.lower(message).rlike("quota|rate limit|insufficient|limit exceeded|429"), F.lit(False))


def distinct_candidates(candidates: DataFrame) -> DataFrame:
    """Candidates (doi, url, ord) with each url of a paper once, at its first place."""
    first = candidates.where("coalesce(url, '') <> ''").groupBy("doi", "url").agg(F.min("ord").alias("ord"))
    return candidates.join(first, ["doi", "url", "ord"])


def download_order(papers: DataFrame, n: int = 0, ord_column: str = "ord") -> DataFrame:
    """The n papers (all of them for 0) whose full text is likeliest to be had, likeliest first, equal ones in their order."""
    ordered = papers.orderBy(F.desc(F.coalesce("fulltext_likelihood", F.lit(0.0))), ord_column)
    return ordered.limit(n) if n > 0 else ordered


def first_folders(folders: DataFrame, n: int = 0, name: str = "folder") -> DataFrame:
    """The first n folders by name, all of them for 0."""
    return folders.orderBy(name).limit(n) if n > 0 else folders


def unique_names(batches: DataFrame, order: str, label: str = "label", stamp: str = "stamp") -> DataFrame:
    """``batches`` with ``directory``, label_stamp; of one label and stamp the second one is label_2_stamp, and so on."""
    n = F.row_number().over(Window.partitionBy(label, stamp).orderBy(order))
    return batches.withColumn("directory", F.concat_ws("_", F.col(label), F.when(n > 1, n.cast("string")), F.col(stamp)))


def first_success(results: DataFrame) -> DataFrame:
    """Of each paper's results (doi, provider, priority, status) the first ok one, else the best failure."""
    rank = F.struct(F.when(F.col("status") == "ok", 0).otherwise(1), F.col("priority"))
    return results.groupBy("doi").agg(F.min_by(F.struct("provider", "status"), rank).alias("r")).select("doi", "r.provider", "r.status")


def summary(events: DataFrame) -> DataFrame:
    """provider, outcome, n; successes counts distinct papers."""
    provider, outcome = (F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown")) for c in ("provider", "outcome"))
    return events.groupBy(provider.alias("provider"), outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.when(outcome == "success", F.col("doi"))).alias("papers"))


def failures(events: DataFrame) -> DataFrame:
    return events.where("coalesce(failure_class, '') <> ''").groupBy("failure_class").agg(F.count(F.lit(1)).alias("n"))


def progress(events: DataFrame, group: str, order: str, success: Column) -> DataFrame:
    """Events with running counts of successes and of all, per group."""
    so_far = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumns({"done": F.count_if(success).over(so_far), "seen": F.count(F.lit(1)).over(so_far)})


def step_review(states: DataFrame) -> DataFrame:
    """Step states (step_id, stage, status, attempts, error) with a suggestion for the failed ones."""
    error = F.lower(F.coalesce("error", F.lit("")))
    hint = F.when(error.rlike("50[0234]|timeout|connection"), "check the network and resume").when(error.rlike("429|rate"), "wait and resume").when(error.rlike("quota|balance"), "check the account").when(error.rlike("not found|no such"), "check the inputs").otherwise("read the log")
    return states.withColumn("suggestion", F.when(F.col("status") == "failed", hint))


def latest_incomplete(states: DataFrame) -> DataFrame:
    """The newest batch (batch, started, status per step) with a step that did not succeed."""
    return states.groupBy("batch").agg(F.max("started").alias("started"), F.bool_or(F.col("status") != "succeeded").alias("open")).where("open").orderBy(F.desc("started"), F.desc("batch")).limit(1)


def directory_digest(files: DataFrame) -> DataFrame:
    """directory and digest of its files (directory, name, size, mtime), whatever their order."""
    return files.groupBy("directory").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "name", "size", "mtime"))), "\n"), 256).alias("digest"))


def compare_formula(formulas: DataFrame, databases: dict[str, DataFrame]) -> DataFrame:
    """formula, database, status (skip, error, ok) and the first three results, for lookup tables (formula, error, results array)."""
    out = None
    for name, db in databases.items():
        j = formulas.select("formula").join(db, "formula", "left").select("formula", F.lit(name).alias("database"), F.when(F.coalesce("error", F.lit("")) != "", "error").when(F.col("results").isNull(), "skip").otherwise("ok").alias("status"), F.slice(F.coalesce("results", F.array().cast("array<string>")), 1, 3).alias("results"))
        out = j if out is None else out.unionByName(j)
    return out
