"""Queries: lifecycle, digests, usage, tracker statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankwell.functions.labels import score_band
from rankwell.functions.text import ascii_norm
from rankwell.operators import feed, reports, tracker
from rankwell.plans.adapters import CHECKS, LOG_END
from rankwell.plans.queries_ingest import jobs_of, stamp
from rankwell.plans.queries_match import feed_table, job_actions, stored_jobs, view_of
from rankwell.plans.queries_track import history_of, moves_of, runs_of
from rankwell.plans.registry import query

SEEN = "2001-09-01 00:00:00"


@query(f"""
select job_id, days::bigint as days_unseen, case when days >= 28 then 'expired' when days >= 14 then 'stale'
  else 'active' end as status
from (select job_id, date_diff('day', last_seen_at, timestamp '{SEEN}') as days from {{jobs}})
""")
def freshness(t):
    """Records by days unseen."""
    return reports.freshness(jobs_of(t), SEEN).select(
        "job_id", F.col("days_unseen").cast("bigint").alias("days_unseen"), "status"
    )


@query("""
select u.user_id, d.job_id, d.final_score, coalesce(d.n, 0) as position,
  case when d.job_id is null then 'skipped' else 'sent' end as status
from {cohorts} u left join (select f.*, row_number() over (partition by f.user_id
    order by final_score desc, job_id desc) as n
  from {feed_all} f where final_score >= 60 + f.user_id % 20
    and (f.user_id % 3 = 0 or first_seen_at > timestamp '1995-02-01')) d
  on d.user_id = u.user_id and d.n <= 10
""")
def digest(t):
    """Ten best new matches per cohort; cohorts without any are skipped."""
    users = t.cohorts.select(
        "user_id", (F.col("user_id") % 20 + 60).alias("alert_threshold"),
        F.when(F.col("user_id") % 3 != 0, F.lit("1995-02-01").cast("timestamp")).alias("last_digest_at"),
    )
    rows = feed.feed_rows(view_of(t)).withColumn("acted_at", F.col("first_seen_at"))
    return reports.digest(users, rows).select(
        "user_id", "job_id", "final_score",
        F.coalesce("position", F.lit(0)).cast("bigint").alias("position"), "status",
    )


@query("""
select distinct a.user_id, j.job_id from {job_actions} a join {jobs} x on x.job_id = a.job_id
join {jobs} j on regexp_replace(lower(j.title), '[^a-z0-9]', '', 'g')
  = regexp_replace(lower(x.title), '[^a-z0-9]', '', 'g') and j.company_name = x.company_name
where a.event = 'dismiss'
""")
def cluster_dismiss(t):
    """Dismissing a record dismisses all records of the same title and company."""
    key = F.concat_ws("|", ascii_norm(F.col("title")), "company_name")
    clusters = stored_jobs(t).select("job_id", key.alias("cluster_id"))
    return reports.dismiss_clusters(job_actions(t), clusters).select("user_id", "job_id")


@query("""
select event, count(*) as events, count(distinct user_id) as users from {actions}
where event is not null group by event
""")
def funnel(t):
    return reports.funnel(t.actions.where(F.col("event").isNotNull()))


@query("""
select strftime(date_trunc('week', acted_at), '%Y-%m-%d') as week, count(distinct user_id) as active_users,
  count(*) filter (where event in ('save', 'dismiss', 'apply')) as meaningful,
  count(*) filter (where event in ('save', 'dismiss', 'apply')) / count(distinct user_id) as per_user
from {actions} group by 1
""")
def weekly_actions(t):
    return reports.weekly_actions(t.actions.withColumn("event", F.coalesce("event", F.lit("")))).withColumn(
        "week", F.date_format("week", "yyyy-MM-dd")
    )


@query("""
select strftime(first_day, '%Y-%m-%d') as first_day, count(*) as users,
  count(*) filter (where w1) as back_in_week1, count(*) filter (where w4) as active_in_week4
from (select d.user_id, f.first_day, bool_or(date_diff('day', f.first_day, d.day) between 1 and 7) as w1,
    bool_or(date_diff('day', f.first_day, d.day) between 21 and 27) as w4
  from (select distinct user_id, acted_at::date as day from {actions}) d
  join (select user_id, min(acted_at)::date as first_day from {actions} group by 1) f
    on f.user_id = d.user_id group by 1, 2) group by 1
""")
def retention(t):
    return reports.retention(t.actions).withColumn(
        "first_day", F.date_format("first_day", "yyyy-MM-dd")
    )


@query(f"""
select count(*) filter (where age < 7) as wau, count(*) filter (where age < 30) as mau,
  count(*) filter (where age < 7) / count(*) filter (where age < 30) as ratio
from (select user_id, min(date_diff('day', acted_at, timestamp '{LOG_END}')) as age from {{actions}}
  group by user_id)
""")
def stickiness(t):
    return reports.stickiness(t.actions, LOG_END)


@query("""
select case when final_score >= 85 then 'strong' when final_score >= 70 then 'good'
    when final_score >= 55 then 'fair' when final_score > 0 then 'weak' else 'gated' end as band,
  count(*) as surfaced, count(*) filter (where saved) as saves,
  count(*) filter (where not (saved or dismissed or applied)) as untouched,
  count(*) filter (where saved) / count(*) as save_rate,
  count(*) filter (where not (saved or dismissed or applied)) / count(*) as untouched_rate
from {ranked} group by 1
""")
def band_rates(t):
    """Saves and untouched records per score band."""
    return reports.rates_by_band(
        view_of(t).where(F.col("user_id").isNotNull()), score_band(F.col("final_score"))
    )


@query("""
select source_id, count(*) as runs, count(*) filter (where status <> 'failed') as good_runs,
  count(*) filter (where status <> 'failed') / count(*) as success_rate
from {runs} group by source_id
""")
def run_success(t):
    return reports.run_success(runs_of(t))


@query("""
select user_id, event_type as metric, strftime(acted_at, '%Y-%m') as month, count(*) as quantity
from {actions} group by 1, 2, 3
""")
def usage(t):
    return reports.usage(t.actions, "event_type", "acted_at")


@query("""
select count(*) as applications, count(*) filter (where h.ap) as applied,
  count(*) filter (where h.recent) as applied_this_week,
  count(*) filter (where h.ap and h.answered) / count(*) filter (where h.ap) as response_rate
from {current} c left join (select application_id, bool_or(to_stage = 'applied') as ap,
    bool_or(to_stage in ('screening', 'interview', 'offer')) as answered,
    bool_or(to_stage = 'applied' and acted_at >= timestamp '2024-01-24') as recent
  from {history} group by 1) h on h.application_id = c.application_id
""")
def stage_stats(t):
    history = history_of(t)
    return reports.stage_stats(
        tracker.current_stage(moves_of(t)), history, "2024-01-24"
    )


@query("""
select stage, count(*) as stays, floor(avg(days) * 1000000 + 0.5) / 1000000 as mean_days
from (select lag(to_stage) over w as stage,
    (epoch_us(acted_at) - epoch_us(lag(acted_at) over w)) / 86400000000.0::double as days
  from {history} window w as (partition by application_id order by n)) where stage is not null
group by stage
""")
def days_in_stage(t):
    rows = reports.days_in_stage(history_of(t))
    return rows.withColumn(
        "mean_days", F.floor(F.col("mean_days") * 1000000 + 0.5) / F.lit(1000000.0)
    )


@query("""
select event_id, acted_at::date < date '2024-01-10' as overdue from {actions}
where event = 'apply' and acted_at::date <= date '2024-01-10'
""")
def follow_ups(t):
    """Applications due by a day; earlier ones are overdue."""
    due = t.actions.where(F.col("event") == "apply").withColumn("next_action_at", F.col("acted_at"))
    return reports.follow_ups(due, "2024-01-10").select("event_id", "overdue")


@query("""
select s.search_id, coalesce(h.matches, 0) as matches, h.job_id, h.final_score
from {searches} s left join (select * from (select search_id, job_id, final_score,
    count(*) over (partition by search_id) as matches,
    row_number() over (partition by search_id order by final_score desc, job_id desc) as n
  from (select s.search_id, f.job_id, f.final_score from {searches} s join {feed_all} f
    on f.user_id = s.user_id and (s.work_mode is null or s.work_mode = f.work_mode)
    and (s.country_code is null or s.country_code = f.country_code)
    and (s.min_salary is null or f.salary_max >= s.min_salary))) where n <= 5) h
  on h.search_id = s.search_id
""")
def search_preview(t):
    """Count and best five matches of one saved search per customer, in the cohort's feed."""
    rows = feed_table(t, "work_mode", "country_code", "salary_max")
    return reports.search_previews(t.searches, rows).select(
        "search_id", "matches", "job_id", "final_score"
    )


@query("""
select user_id, strftime(timestamp '2024-03-10 00:00:00' + to_hours(send_hour::bigint)
  - to_minutes(case time_zone when 'Asia/Kolkata' then 330 when 'America/New_York' then -240
    when 'Europe/Berlin' then 60 else 0 end::bigint),
  '%Y-%m-%d %H:%M:%S') as scheduled_for
from {slot_users} where send_hour <> 9
""")
def digest_slots(t):
    """UTC send time on the day the clocks change in one of the zones; sent slots are left out."""
    users = t.slot_users
    sent = users.where(F.col("send_hour") == 9)
    done = reports.digest_slots(
        sent, "2024-03-10", t.spark.createDataFrame([], "user_id bigint, scheduled_for timestamp")
    ).select("user_id", "scheduled_for")
    return reports.digest_slots(users, "2024-03-10", done).select("user_id", stamp("scheduled_for"))


@query("""
select user_id, strftime(date_trunc('hour', acted_at), '%Y-%m-%d %H:%M:%S') as hour, count(*) as items,
  max(value) as best_score
from {actions} a where value >= 90 and not exists (select 1 from {actions} d where d.user_id = a.user_id
  and d.k = a.k and d.acted_at::date = a.acted_at::date and d.event_type = 'signup')
group by 1, 2
""")
def hourly_alerts(t):
    """High values per user and hour, without items already in the digest of that day."""
    matches = t.actions.select("user_id", F.col("k").alias("job_id"), F.col("value").alias("score"), "acted_at")
    in_digest = t.actions.where(F.col("event_type") == "signup").select(
        "user_id", F.col("k").alias("job_id"), F.to_date("acted_at").alias("day")
    ).distinct()
    return reports.hourly_alerts(matches, in_digest).select("user_id", stamp("hour"), "items", "best_score")


@query("""
select c.c_custkey as user_id,
  (select count(*) from {orders} o where o.o_custkey = c.c_custkey) as orders,
  (select count(*) from {events} e where e.user_id = c.c_custkey) as events from {customer} c
""")
def account_counts(t):
    accounts = t.customer.select(F.col("c_custkey").alias("user_id"))
    return reports.account_counts(
        accounts, "user_id",
        {"orders": t.orders.withColumnRenamed("o_custkey", "user_id"), "events": t.events},
    )


@query("""
select user_id, 'events' as part, count(*) as n, sum(event_id)::bigint as total from {events} group by 1
union all select o_custkey, 'orders', count(*), sum(o_orderkey)::bigint from {orders} group by 1
""")
def account_export(t):
    """Export rows of all accounts, read back from their JSON."""
    rows = reports.export_rows(
        "user_id", {"orders": t.orders.withColumnRenamed("o_custkey", "user_id"), "events": t.events}
    )
    ident = F.coalesce(
        F.get_json_object("payload", "$.o_orderkey"), F.get_json_object("payload", "$.event_id")
    ).cast("bigint")
    return rows.groupBy("user_id", "part").agg(
        F.count(F.lit(1)).alias("n"), F.sum(ident).alias("total")
    )


@query("""
select user_id, count(*) as sessions, sum(n)::bigint as actions from (select user_id, s, count(*) as n
  from (select user_id, acted_at, sum(case when prev is null or epoch_us(acted_at) - epoch_us(prev) >= 1800000000
      then 1 else 0 end) over (partition by user_id order by acted_at, event_id) as s
    from (select *, lag(acted_at) over (partition by user_id order by acted_at, event_id) as prev
      from {actions})) group by 1, 2) group by 1
""")
def sessions(t):
    """Sessions per user with a gap of thirty minutes."""
    return reports.sessions(t.actions).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("actions").alias("actions")
    )


