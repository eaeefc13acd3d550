"""The ranked feed: records joined with a user's scores and actions, filtered, sorted, paged."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankwell.constants import MIN_FEED_SCORE
from rankwell.functions.labels import score_band


def action_flags(actions: DataFrame, applications: DataFrame | None = None) -> DataFrame:
    """One row per (user, record): was it saved, dismissed, applied to?"""
    marks = actions.select("user_id", "job_id", "event")
    if applications is not None:
        marks = marks.unionByName(
            applications.select("user_id", "job_id", F.lit("apply").alias("event"))
        )
    return marks.groupBy("user_id", "job_id").agg(
        *[
            F.max(F.coalesce(F.col("event") == event, F.lit(False))).alias(flag)
            for event, flag in (("save", "saved"), ("dismiss", "dismissed"), ("apply", "applied"))
        ]
    )


def ranked_view(jobs: DataFrame, scores: DataFrame, flags: DataFrame) -> DataFrame:
    """Active records with scores and flags; a record without a score has a null user.

    The user is part of every join key, so one user's rows never meet another's.
    """
    scored = scores.join(flags, ["user_id", "job_id"], "left")
    for flag in ("saved", "dismissed", "applied"):
        scored = scored.withColumn(flag, F.coalesce(flag, F.lit(False)))
    return jobs.where(F.col("status") == "active").join(scored, "job_id", "left")


@dataclass(frozen=True)
class FeedFilter:
    """What a user may narrow the feed by; unset fields do not filter."""

    work_modes: tuple[str, ...] = ()
    seniorities: tuple[str, ...] = ()
    employment_types: tuple[str, ...] = ()
    bands: tuple[str, ...] = ()
    min_salary: float | None = None
    country: str | None = None
    remote_scope: str | None = None
    source_id: object | None = None
    posted_since: str | None = None
    cursor: tuple[float, str] | None = None

    def conditions(self) -> list[Column]:
        out = []
        for column, values in (
            ("work_mode", self.work_modes),
            ("seniority", self.seniorities),
            ("employment_type", self.employment_types),
        ):
            if values:
                out.append(F.col(column).isin(*values))
        if self.bands:
            out.append(score_band(F.col("final_score")).isin(*self.bands))
        if self.min_salary is not None:
            out.append(F.col("salary_max") >= self.min_salary)
        for column, value in (
            ("country_code", self.country),
            ("remote_scope", self.remote_scope),
            ("source_id", self.source_id),
        ):
            if value is not None:
                out.append(F.col(column) == value)
        if self.posted_since is not None:
            out.append(F.col("posted_at") >= F.lit(self.posted_since).cast("timestamp"))
        if self.cursor is not None:
            out.append(after_cursor(*self.cursor))
        return out


def after_cursor(score: float, job_id: str) -> Column:
    """Rows after (score, id) in the feed order; ties continue with smaller ids."""
    return (F.col("final_score") < score) | (
        (F.col("final_score") == score) & (F.col("job_id") < job_id)
    )


def feed_rows(view: DataFrame, narrow: FeedFilter | None = None) -> DataFrame:
    """Rows of the ranked view that belong into a feed."""
    rows = view.where(
        (F.col("final_score") >= MIN_FEED_SCORE) & ~F.col("dismissed") & ~F.col("applied")
    )
    for condition in (narrow or FeedFilter()).conditions():
        rows = rows.where(condition)
    return rows


def only_new(rows: DataFrame, visits: DataFrame) -> DataFrame:
    """Records first seen after the user's last visit; no known visit means no restriction."""
    seen = visits.select("user_id", "last_seen_feed_at")
    return rows.join(seen, "user_id", "left").where(
        F.col("last_seen_feed_at").isNull() | (F.col("first_seen_at") > F.col("last_seen_feed_at"))
    )


def _order(by: str) -> list[Column]:
    score, ident = F.desc("final_score"), F.desc("job_id")
    if by == "score":
        return [score, ident]
    if by == "date":
        return [F.desc_nulls_last("posted_at"), ident]
    if by == "salary":
        return [F.desc_nulls_last("salary_max"), ident]
    if by == "band":
        rank = F.when(F.col("final_score") >= 85, 0).when(F.col("final_score") >= 70, 1).otherwise(2)
        return [rank.asc(), F.desc_nulls_last("posted_at"), ident]
    raise ValueError(f"unknown feed order {by}")


def page(rows: DataFrame, size: int, by: str = "score") -> DataFrame:
    """First ``size`` rows of every user's feed with their position and a more-rows flag.

    One row beyond the page is read to know whether more follow. The row number is limited
    before the shuffle, so a user with a third of all rows sends a page per task.
    """
    w = Window.partitionBy("user_id").orderBy(*_order(by))
    top = rows.withColumn("position", F.row_number().over(w)).where(
        F.col("position") <= size + 1
    )
    more = F.max("position").over(Window.partitionBy("user_id")) > size
    return top.withColumn("has_more", more).where(F.col("position") <= size)


def with_total(page_rows: DataFrame, rows: DataFrame, pairs: str | None = None) -> DataFrame:
    """Adds the exact number of rows in each user's whole feed; ``pairs`` names a column of how many a row stands for."""
    counted = F.sum(pairs) if pairs else F.count(F.lit(1))
    totals = rows.groupBy("user_id").agg(counted.alias("total"))
    return page_rows.join(totals, "user_id", "left")


def recently_scored(jobs: DataFrame, scores: DataFrame, since: str) -> DataFrame:
    """(user, record) pairs of active records scored since a time."""
    fresh = scores.where(F.col("scored_at") >= F.lit(since).cast("timestamp"))
    active = jobs.where(F.col("status") == "active").select("job_id")
    return fresh.select("user_id", "job_id").join(active, "job_id", "left_semi")


def rescore_page(jobs: DataFrame, size: int, after: tuple[str | None, str] | None = None) -> DataFrame:
    """Next records to rescore: newest posting first, undated last, id ascending.

    ``after`` is (posted_at, id) of the last record done; a null date continues among the
    undated ones.
    """
    if after is not None:
        when, ident = after
        if when is None:
            rest = F.col("posted_at").isNull() & (F.col("job_id") > ident)
        else:
            at = F.lit(when).cast("timestamp")
            rest = (
                (F.col("posted_at") < at)
                | ((F.col("posted_at") == at) & (F.col("job_id") > ident))
                | F.col("posted_at").isNull()
            )
        jobs = jobs.where(rest)
    return jobs.orderBy(F.desc_nulls_last("posted_at"), F.asc("job_id")).limit(size)
