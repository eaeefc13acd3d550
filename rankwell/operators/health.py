"""Ingest runs: counts, status, error log, failure streaks, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankwell.constants import ALERT_FAILURES, MAX_RUN_ERRORS, PAUSE_FAILURES


def run_status(found: Column, failed: Column, had_error: Column) -> Column:
    """A run that found nothing failed, even without an error."""
    return (
        F.when((found == 0) & had_error, "failed")
        .when(had_error | (failed > 0), "partial")
        .when(found == 0, "failed")
        .otherwise("success")
    )


def run_counts(log: DataFrame, run: list[str], record: list[str], at: str, tie: str) -> DataFrame:
    """Per run: records found, new ones, repeats and failures.

    ``log`` has one row per attempt with ``is_error``. A record is new where it is seen first;
    the first sighting is found by an aggregate, not by ordering all rows of a source.
    """
    good = log.where(~F.col("is_error"))
    firsts = good.groupBy(*record).agg(F.min(F.struct(at, tie)).alias("_first"))
    marked = good.join(firsts, record).withColumn(
        "_new", F.col("_first") == F.struct(at, tie)
    )
    counted = marked.groupBy(*run).agg(
        F.count(F.lit(1)).alias("found"),
        F.sum(F.col("_new").cast("bigint")).alias("inserted"),
        F.sum((~F.col("_new")).cast("bigint")).alias("duplicates"),
    )
    all_runs = log.groupBy(*run).agg(
        F.sum(F.col("is_error").cast("bigint")).alias("failed"),
        F.max(at).alias("finished_at"),
        F.min(at).alias("started_at"),
        F.count(F.lit(1)).alias("api_calls"),
    )
    zero = F.lit(0).cast("bigint")
    filled = all_runs.join(counted, run, "left")
    for name in ("found", "inserted", "duplicates"):
        filled = filled.withColumn(name, F.coalesce(name, zero))
    return filled.withColumn(
        "status", run_status(F.col("found"), F.col("failed"), F.col("failed") > 0)
    )


def run_log(errors: DataFrame, run: list[str], message: str, order: list[str]) -> DataFrame:
    """Error count and the first twenty messages of each run, with a truncation flag.

    The messages are cut to twenty per run before they are collected.
    """
    counts = errors.groupBy(*run).agg(F.count(F.lit(1)).alias("error_count"))
    place = F.row_number().over(Window.partitionBy(*run).orderBy(*order))
    top = errors.withColumn("_n", place).where(F.col("_n") <= MAX_RUN_ERRORS)
    listed = top.groupBy(*run).agg(
        F.array_sort(F.collect_list(F.struct("_n", message))).alias("_listed")
    )
    return (
        counts.join(listed, run)
        .withColumn("errors", F.transform("_listed", lambda e: e[message]))
        .withColumn("truncated", F.col("error_count") > MAX_RUN_ERRORS)
        .drop("_listed")
    )


def failure_streaks(runs: DataFrame, source: str = "source_id", at: str = "finished_at") -> DataFrame:
    """Failed runs since the last run that did not fail, and the time of that run.

    Two aggregates and a join on the source; no source's runs are ordered in one task.
    """
    success = runs.where(F.col("status") != "failed").groupBy(source).agg(
        F.max(at).alias("last_success_at")
    )
    joined = runs.join(success, source, "left")
    late = (F.col("status") == "failed") & (
        F.col("last_success_at").isNull() | (F.col(at) > F.col("last_success_at"))
    )
    return joined.groupBy(source).agg(
        F.sum(late.cast("bigint")).alias("consecutive_failures"),
        F.max("last_success_at").alias("last_success_at"),
    )


def source_health(streaks: DataFrame) -> DataFrame:
    failures = F.col("consecutive_failures")
    state = (
        F.when(failures >= PAUSE_FAILURES, "paused")
        .when(failures >= ALERT_FAILURES, "alert")
        .otherwise("ok")
    )
    return streaks.withColumn("health", state)
