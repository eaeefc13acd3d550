"""Reports over records, scores, applications and the action log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankwell.constants import ALERT_SCORE, DIGEST_ITEMS, EXPIRED_DAYS, STALE_DAYS
from rankwell.functions.text import let
from rankwell.operators.ordered import with_previous

MEANINGFUL = ["save", "dismiss", "apply"]


def _ts(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def freshness(records: DataFrame, now: str, seen: str = "last_seen_at") -> DataFrame:
    """Status by days unseen: stale at 14, expired at 28."""
    days = F.date_diff(_ts(now), F.col(seen))
    status = F.when(days >= EXPIRED_DAYS, "expired").when(days >= STALE_DAYS, "stale")
    return records.withColumn("days_unseen", days).withColumn(
        "status", status.otherwise("active")
    )


def digest(users: DataFrame, feed_rows: DataFrame) -> DataFrame:
    """Top ten unseen matches per user since the last digest; users without any are skipped.

    ``users`` has ``alert_threshold`` and ``last_digest_at``; ``feed_rows`` holds neither
    dismissed nor applied records.
    """
    fresh = feed_rows.join(users, "user_id").where(
        (F.col("final_score") >= F.col("alert_threshold"))
        & (F.col("last_digest_at").isNull() | (F.col("acted_at") > F.col("last_digest_at")))
    )
    w = Window.partitionBy("user_id").orderBy(F.desc("final_score"), F.desc("job_id"))
    top = (
        fresh.withColumn("position", F.row_number().over(w))
        .where(F.col("position") <= DIGEST_ITEMS)
        .select("user_id", "job_id", "final_score", "position")
    )
    status = F.when(F.col("job_id").isNull(), "skipped").otherwise("sent")
    return users.select("user_id").join(top, "user_id", "left").withColumn("status", status)


def dismiss_clusters(actions: DataFrame, clusters: DataFrame) -> DataFrame:
    """Dismissing one member of a cluster dismisses all of it, for that user."""
    hidden = (
        actions.where(F.col("event") == "dismiss")
        .join(clusters, "job_id")
        .select("user_id", "cluster_id")
        .distinct()
    )
    return hidden.join(clusters, "cluster_id").select("user_id", "job_id", "cluster_id")


def funnel(actions: DataFrame) -> DataFrame:
    """Events and different users per kind of action."""
    return actions.groupBy("event").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("users")
    )


def weekly_actions(actions: DataFrame) -> DataFrame:
    """Active users, meaningful actions and actions per active user for each week."""
    week = F.date_trunc("week", F.col("acted_at")).alias("week")
    counted = actions.groupBy(week).agg(
        F.count_distinct("user_id").alias("active_users"),
        F.sum(F.col("event").isin(MEANINGFUL).cast("bigint")).alias("meaningful"),
    )
    return counted.withColumn("per_user", F.try_divide("meaningful", "active_users"))


def retention(actions: DataFrame) -> DataFrame:
    """Per day of first action: users, back within seven days, active in week four."""
    daily = actions.select("user_id", F.to_date("acted_at").alias("day")).distinct()
    first = daily.groupBy("user_id").agg(F.min("day").alias("first_day"))
    gap = F.date_diff("day", "first_day")
    per_user = daily.join(first, "user_id").groupBy("user_id", "first_day").agg(
        F.max(gap.between(1, 7)).alias("week1"), F.max(gap.between(21, 27)).alias("week4")
    )
    return per_user.groupBy("first_day").agg(
        F.count(F.lit(1)).alias("users"),
        F.sum(F.col("week1").cast("bigint")).alias("back_in_week1"),
        F.sum(F.col("week4").cast("bigint")).alias("active_in_week4"),
    )


def stickiness(actions: DataFrame, now: str) -> DataFrame:
    """Weekly and monthly active users before ``now`` and their ratio, null without users."""
    age = F.date_diff(_ts(now), "acted_at")
    last = actions.groupBy("user_id").agg(F.min(age).alias("age"))
    counted = last.groupBy().agg(
        F.sum((F.col("age") < 7).cast("bigint")).alias("wau"),
        F.sum((F.col("age") < 30).cast("bigint")).alias("mau"),
    )
    return counted.withColumn("ratio", F.try_divide("wau", "mau"))


def rates_by_band(rows: DataFrame, band: Column) -> DataFrame:
    """Per score band: surfaced records, saved and untouched ones, and both rates."""
    untouched = ~(F.col("saved") | F.col("dismissed") | F.col("applied"))
    counted = rows.groupBy(band.alias("band")).agg(
        F.count(F.lit(1)).alias("surfaced"),
        F.sum(F.col("saved").cast("bigint")).alias("saves"),
        F.sum(untouched.cast("bigint")).alias("untouched"),
    )
    return counted.withColumn("save_rate", F.try_divide("saves", "surfaced")).withColumn(
        "untouched_rate", F.try_divide("untouched", "surfaced")
    )


def days_to_first(history: DataFrame, start: str, end: str, key: str = "application_id") -> DataFrame:
    """Per week of the first ``start``: applications, those that reached ``end`` later, and the
    median of the whole days between. The median is exact; it holds one entry per distinct count.
    """
    first = lambda stage: F.min(F.when(F.col("to_stage") == stage, F.col("acted_at")))
    spans = (
        history.where(F.col("to_stage").isin(start, end))
        .groupBy(key)
        .agg(first(start).alias("_start"), first(end).alias("_end"))
        .where(F.col("_start").isNotNull())
    )
    days = F.when(F.col("_end") >= F.col("_start"), F.timestamp_diff("DAY", "_start", "_end"))
    return (
        spans.withColumn("_days", days)
        .groupBy(F.date_trunc("week", "_start").alias("week"))
        .agg(
            F.count(F.lit(1)).alias("applications"),
            F.count("_days").alias("reached"),
            F.percentile("_days", 0.5).alias("median_days"),
        )
    )


def run_success(runs: DataFrame) -> DataFrame:
    """Share of runs per source that did not fail."""
    return runs.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum((F.col("status") != "failed").cast("bigint")).alias("good_runs"),
    ).withColumn("success_rate", F.try_divide("good_runs", "runs"))


def usage(log: DataFrame, metric: str, at: str) -> DataFrame:
    """Quantity per user, metric and month."""
    month = F.date_format(at, "yyyy-MM").alias("month")
    return log.groupBy("user_id", F.col(metric).alias("metric"), month).agg(
        F.count(F.lit(1)).alias("quantity")
    )


def stage_stats(current: DataFrame, history: DataFrame, week_start: str) -> DataFrame:
    """One row: applications, applied since a date, response rate; null where nothing applies.

    The response rate is the share of applications ever applied that reached screening or later.
    """
    reached = history.groupBy("application_id").agg(
        F.max(F.col("to_stage") == "applied").alias("applied"),
        F.max(F.col("to_stage").isin("screening", "interview", "offer")).alias("answered"),
        F.max((F.col("to_stage") == "applied") & (F.col("acted_at") >= _ts(week_start))).alias("recent"),
    )
    number = lambda c: F.sum(F.col(c).cast("bigint"))
    totals = current.select("application_id").join(reached, "application_id", "left")
    return totals.groupBy().agg(
        F.count(F.lit(1)).alias("applications"),
        F.coalesce(number("applied"), F.lit(0)).alias("applied"),
        F.coalesce(number("recent"), F.lit(0)).alias("applied_this_week"),
        F.try_divide(
            F.sum((F.col("applied") & F.col("answered")).cast("bigint")),
            F.sum(F.col("applied").cast("bigint")),
        ).alias("response_rate"),
    )


def days_in_stage(history: DataFrame) -> DataFrame:
    """Mean days between entering a stage and leaving it, over all left stays."""
    linked = with_previous(history, ["application_id"], ["acted_at", "event_id"], ["to_stage", "acted_at"])
    days = (F.unix_micros("acted_at") - F.unix_micros("prev_acted_at")) / F.lit(86_400_000_000.0)
    return (
        linked.where(F.col("prev_to_stage").isNotNull())
        .groupBy(F.col("prev_to_stage").alias("stage"))
        .agg(F.count(F.lit(1)).alias("stays"), F.avg(days).alias("mean_days"))
    )


def follow_ups(applications: DataFrame, today: str) -> DataFrame:
    """Applications whose next action is due; earlier days are overdue."""
    due = F.to_date("next_action_at")
    day = F.lit(today).cast("date")
    return applications.where(due <= day).withColumn("overdue", due < day)


def search_previews(
    searches: DataFrame, rows: DataFrame, top: int = 5, block: int = 4_096, share: int = 2_048
) -> DataFrame:
    """Per saved search: number of matching feed rows and the best five.

    A filter left null does not restrict. Searches meet the feed of their own user only, as blocks of
    about ``block`` rows in feed order, so what leaves a (search, block) is a count and its best rows,
    never the matches themselves. A user's searches are cut into shares, each beside all its blocks.
    """
    item = F.struct("final_score", "job_id", "work_mode", "country_code", "salary_max").alias("_item")
    blocks = (
        _cut(rows, "job_id", block, "_slot")
        .select("user_id", "_slot", item)
        .groupBy("user_id", "_slot")
        .agg(F.sort_array(F.collect_list("_item"), asc=False).alias("_rows"))
    )
    shared = _cut(searches, "search_id", share, "_share")
    wanted = shared.select("user_id", "_share").distinct().join(blocks, "user_id").drop("_slot")
    free = lambda r, name: F.col(name).isNull() | (F.col(name) == r[name])
    hits = F.filter(
        "_rows",
        lambda r: free(r, "work_mode")
        & free(r, "country_code")
        & (F.col("min_salary").isNull() | (r["salary_max"] >= F.col("min_salary"))),
    )
    first = lambda h: F.transform(
        F.slice(h, 1, top), lambda r: F.struct(r["final_score"].alias("final_score"), r["job_id"].alias("job_id"))
    )
    found = shared.join(wanted, ["user_id", "_share"]).select(
        "search_id", let(hits, lambda h: F.struct(F.size(h).alias("n"), first(h).alias("best"))).alias("_hits")
    )
    best = F.slice(F.sort_array(F.flatten(F.collect_list(F.col("_hits")["best"])), asc=False), 1, top)
    counts = found.groupBy("search_id").agg(F.sum(F.col("_hits")["n"]).alias("matches"), best.alias("_best"))
    listed = searches.select("search_id").join(counts, "search_id", "left").select(
        "search_id", F.coalesce("matches", F.lit(0)).alias("matches"), F.posexplode_outer("_best").alias("_at", "_row")
    )
    return listed.select(
        "search_id", "matches", F.col("_row")["job_id"].alias("job_id"),
        F.col("_row")["final_score"].alias("final_score"), (F.col("_at") + 1).alias("position"),
    )


def _cut(rows: DataFrame, ident: str, size: int, name: str) -> DataFrame:
    """Adds ``name``: the rows of each user are dealt to parts of about ``size`` rows, counted first."""
    parts = rows.groupBy("user_id").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("_parts"))
    return rows.join(parts, "user_id").withColumn(name, F.pmod(F.xxhash64(ident), F.col("_parts"))).drop("_parts")


def digest_slots(users: DataFrame, day: str, sent: DataFrame) -> DataFrame:
    """UTC time of each user's digest on a local day; already sent slots are left out.

    An unknown or missing time zone falls back to UTC, so the slot is neither lost nor doubled.
    """
    zone = F.coalesce("time_zone", F.lit("UTC"))
    local = F.make_timestamp(
        F.year(F.lit(day)), F.month(F.lit(day)), F.day(F.lit(day)), F.col("send_hour"), F.lit(0),
        F.lit(0), F.lit("UTC"),
    )
    slots = users.withColumn("scheduled_for", F.to_utc_timestamp(local, zone))
    return slots.join(sent, ["user_id", "scheduled_for"], "left_anti")


def hourly_alerts(matches: DataFrame, in_digest: DataFrame, threshold: float = ALERT_SCORE) -> DataFrame:
    """High matches batched per user and hour; items of that day's digest are not repeated.

    The batch is counted, its items stay rows of ``matches``.
    """
    day = F.to_date("acted_at").alias("day")
    high = matches.where(F.col("score") >= threshold).withColumn("day", day)
    new = high.join(in_digest, ["user_id", "job_id", "day"], "left_anti")
    return new.groupBy("user_id", F.window("acted_at", "1 hour").alias("w")).agg(
        F.count(F.lit(1)).alias("items"), F.max("score").alias("best_score")
    ).select("user_id", F.col("w.start").alias("hour"), "items", "best_score")


def account_counts(accounts: DataFrame, key: str, parts: dict[str, DataFrame]) -> DataFrame:
    """Rows per account in each part, without their content."""
    out = accounts.select(key)
    for name, part in parts.items():
        counts = part.groupBy(key).agg(F.count(F.lit(1)).alias(name))
        out = out.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def export_rows(key: str, parts: dict[str, DataFrame]) -> DataFrame:
    """Everything an account owns as (key, part, payload) rows of JSON.

    One row per owned row: an account of any size streams out through many tasks. Write it with
    ``partitionBy`` of a key range, or filter it to one account.
    """
    rows = None
    for name, part in parts.items():
        own = part.select(key, F.lit(name).alias("part"), F.to_json(F.struct("*")).alias("payload"))
        rows = own if rows is None else rows.unionByName(own)
    return rows


def sessions(actions: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """Runs of a user's actions with less than the gap between neighbours.

    Actions are first combined per user and minute, so what is put in order is bounded by the
    length of the log, not by the number of actions of a busy user.
    """
    minutes = actions.groupBy("user_id", F.date_trunc("minute", F.col("acted_at")).alias("minute")).agg(
        F.min("acted_at").alias("first_at"), F.max("acted_at").alias("last_at"), F.count(F.lit(1)).alias("n")
    )
    w = Window.partitionBy("user_id").orderBy("minute")
    quiet = F.unix_micros("first_at") - F.unix_micros(F.lag("last_at").over(w))
    starts = F.coalesce((quiet >= gap_minutes * 60_000_000).cast("int"), F.lit(1))
    numbered = minutes.withColumn("_start", starts).withColumn(
        "session", F.sum("_start").over(w)
    )
    return numbered.groupBy("user_id", "session").agg(
        F.min("first_at").alias("started_at"),
        F.max("last_at").alias("ended_at"),
        F.sum("n").alias("actions"),
    )
