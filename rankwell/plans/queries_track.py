"""Queries: applications, merges, profile updates, run health."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankwell.constants import SKILL_SEED
from rankwell.functions.parse import seniority_rank
from rankwell.operators import dedupe, health, merges, tracker
from rankwell.operators.ordered import with_row_number
from rankwell.plans.adapters import CHECKS
from rankwell.plans.queries_ingest import TIE, hashed, stamp
from rankwell.plans.queries_match import job_actions, ordered_pairs, packed, packed_scores, spelled, stored_jobs
from rankwell.plans.registry import Inputs, query

TIME = "'%Y-%m-%d %H:%M:%S'"


def text_time(col: str):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS")


# --- stage moves ------------------------------------------------------------------------------------

_LEGAL = """case {a} when 'discovered' then {b} = 'saved' when 'saved' then {b} in ('applied', 'discovered')
  when 'applied' then {b} in ('screening', 'rejected', 'withdrawn')
  when 'screening' then {b} in ('interview', 'rejected', 'withdrawn')
  when 'interview' then {b} in ('offer', 'rejected', 'withdrawn')
  when 'offer' then {b} in ('rejected', 'withdrawn') else false end"""
CHECKS["requests_n"] = """
select *, row_number() over (partition by application_id order by acted_at, event_id) as n
from {stage_requests}
"""
CHECKS["replayed"] = f"""
select application_id, event_id, acted_at, n, 'discovered' as from_stage, to_stage,
  case when to_stage = 'saved' then 'saved' else 'discovered' end as state
from {{requests_n}} where n = 1
union all
select q.application_id, q.event_id, q.acted_at, q.n, r.state, q.to_stage,
  case when {_LEGAL.format(a='r.state', b='q.to_stage')} then q.to_stage else r.state end
from replayed r join requests_n q on q.application_id = r.application_id and q.n = r.n + 1
"""
CHECKS["history"] = "select * from {replayed} where state <> from_stage"
CHECKS["current"] = """
select application_id, arg_max(to_stage, n) as stage, max(acted_at) as updated_at, count(*) as moves
from {history} group by application_id
"""


def moves_of(t: Inputs):
    return tracker.replay_moves(t.stage_requests, ["acted_at", "event_id"])


def history_of(t: Inputs):
    return moves_of(t).where(F.col("accepted")).select("application_id", "event_id", "acted_at", "from_stage", "to_stage")


@query("""
select application_id, event_id, from_stage, to_stage, state <> from_stage as accepted from {replayed}
""")
def stage_replay(t):
    """All stage requests in order, each with the stage it met and whether it was legal."""
    return moves_of(t).select("application_id", "event_id", "from_stage", "to_stage", "accepted")


@query("""
select case when from_stage = to_stage then 'already_in_stage'
    when from_stage in ('rejected', 'withdrawn') then 'terminal_stage' else 'illegal_move' end as reason,
  from_stage, count(*) as requests
from {replayed} where state = from_stage group by 1, 2
""")
def stage_rejects(t):
    refused = moves_of(t).where(~F.col("accepted"))
    return refused.groupBy("reason", "from_stage").agg(F.count(F.lit(1)).alias("requests"))


@query("""
select b.position::bigint as position, b.stage, count(c.application_id) as cards
from (values (0, 'applied'), (1, 'screening'), (2, 'interview'), (3, 'offer'), (4, 'rejected'),
  (5, 'withdrawn')) b(position, stage) left join {current} c on c.stage = b.stage group by 1, 2
""")
def stage_board(t):
    return tracker.board_counts(t.spark, tracker.current_stage(moves_of(t)))


@query("""
select application_id, event_id, to_stage,
  lag(to_stage) over (partition by application_id order by n) as prev_to_stage, from_stage
from {history}
""")
def timeline(t):
    """Accepted moves, each with the stage entered before it."""
    return tracker.timeline(history_of(t)).select(
        "application_id", "event_id", "to_stage", "prev_to_stage", "from_stage"
    )


@query("select from_stage, to_stage, count(*) as moves from {history} group by 1, 2")
def legal_moves_used(t):
    """How often each legal move was made; the join with the move table loses nothing."""
    used = history_of(t).join(tracker.move_table(t.spark), ["from_stage", "to_stage"])
    return used.groupBy("from_stage", "to_stage").agg(F.count(F.lit(1)).alias("moves"))


@query("""
select q.application_id, q.event_id, 'not_found' as reason from {stage_requests} q
left join (select application_id, min(user_id) as owner from {stage_requests} where k < 5
  group by application_id) o on o.application_id = q.application_id
where o.owner is null
""")
def stranger_requests(t):
    """Requests on applications without an owner among the known ones."""
    owners = t.stage_requests.where(F.col("k") < 5).groupBy("application_id").agg(
        F.min("user_id").alias("user_id")
    )
    _, refused = tracker.refuse_strangers(t.stage_requests, owners)
    return refused.select("application_id", "event_id", "reason")


# --- actions and applications ---------------------------------------------------------------------------

CHECKS["first_acts"] = """
select user_id, job_id, event, min((acted_at, event_id)) as f from {job_actions} group by 1, 2, 3
"""


@query(f"""
select user_id, job_id, event, event_id, strftime(acted_at, {TIME[:-1]}.%f') as acted_at from (select *,
  row_number() over (partition by user_id, job_id, event order by acted_at, event_id) as n
  from {{job_actions}}) where n = 1
""")
def first_actions(t):
    return tracker.first_actions(job_actions(t)).select(
        "user_id", "job_id", "event", "event_id", text_time("acted_at").alias("acted_at")
    )


@query("""
select distinct a.user_id, a.job_id, a.event from {job_actions} a
where a.acted_at >= timestamp '2024-01-15' and not exists (select 1 from {job_actions} b
  where b.user_id = a.user_id and b.job_id = a.job_id and b.event = a.event
    and b.acted_at < timestamp '2024-01-15')
""")
def new_actions(t):
    """Actions of the second half that the log of the first half does not hold."""
    acts, cut = job_actions(t), F.lit("2024-01-15").cast("timestamp")
    return tracker.new_actions(
        acts.where(F.col("acted_at") < cut), acts.where(F.col("acted_at") >= cut)
    ).select("user_id", "job_id", "event")


@query("""
select user_id, job_id from {ordered_jobs} o where not exists (select 1 from {job_actions} a
  where a.user_id = o.user_id and a.job_id = o.job_id and a.event in ('dismiss', 'apply'))
""")
def exclude_acted(t):
    """Ordered pairs without those dismissed or applied to."""
    acted = packed(job_actions(t).where(F.col("event").isin("dismiss", "apply")))
    return spelled(ordered_pairs(t).distinct().join(acted, ["user_id", "job_id"], "left_anti"))


CHECKS["applied"] = """
select a.user_id, a.job_id, a.acted_at as applied_at, a.event_id, j.title, j.company_name, j.salary_min,
  j.salary_currency
from (select *, row_number() over (partition by user_id, job_id order by acted_at, event_id) as n
  from {job_actions} where event = 'apply') a join {jobs} j on j.job_id = a.job_id where a.n = 1
"""


def applications_of(t: Inputs):
    requests = job_actions(t).where(F.col("event") == "apply").select(
        "user_id", "job_id", F.col("acted_at").alias("applied_at"), F.col("event_id").alias("request_id")
    )
    none = t.spark.createDataFrame([], "user_id bigint, job_id string")
    return tracker.apply_once(none, requests, stored_jobs(t))


@query("""
select user_id, job_id, event_id as request_id, 'applied' as stage, title, company_name, salary_min
from {applied}
""")
def apply_snapshot(t):
    """One application per (user, record) with the record frozen into it."""
    snap = F.col("job_snapshot")
    return applications_of(t).select(
        "user_id", "job_id", "request_id", "stage", snap["title"].alias("title"),
        snap["company_name"].alias("company_name"), snap["salary_min"].alias("salary_min"),
    )


@query("""
select user_id, job_id, salary_min >= 30000 as job_live, title, company_name as company,
  salary_currency as currency from {applied}
""")
def tracker_cards(t):
    """Cards where the cheaper records are gone from the catalogue: their snapshot carries the card."""
    live = stored_jobs(t).where(F.col("salary_min") >= 30000)
    return tracker.cards(applications_of(t), live).select(
        "user_id", "job_id", "job_live", "title", "company",
        F.coalesce(
            F.nullif(F.regexp_extract("salary", "([A-Za-z]+)$", 1), F.lit("")),
        ).alias("currency"),
    )


@query("""
select user_id, request_id, case when salary_min >= 30000 then job_id end as job_id
from (select user_id, event_id as request_id, salary_min, job_id from {applied})
""")
def deleted_jobs(t):
    """Applications of deleted records stay, without their record id."""
    live = stored_jobs(t).where(F.col("salary_min") >= 30000)
    return merges.clear_missing(applications_of(t), "job_id", live, "job_id").select(
        "user_id", "request_id", "job_id"
    )


@query("""
select a.user_id, a.job_id, j.title, s.final_score, p.event_id is not null as has_application
from (select distinct user_id, job_id from {job_actions}) a join {jobs} j on j.job_id = a.job_id
left join {given_scores} s on s.user_id = a.user_id and s.job_id = a.job_id
left join {applied} p on p.user_id = a.user_id and p.job_id = a.job_id
""")
def job_detail(t):
    """Record, score and application for every (user, record) of the action log."""
    rows = tracker.job_detail(
        packed(stored_jobs(t)), packed_scores(t), packed(applications_of(t)), packed(job_actions(t))
    )
    return spelled(rows).select(
        "user_id", "job_id", "title", "final_score",
        F.col("application_stage").isNotNull().alias("has_application"),
    )


@query("""
select h.dedupe_hash as job_id, source_url, count(*) as sighting_count,
  strftime(max(seen_at), '%Y-%m-%d %H:%M:%S') as last_seen_at
from {hashed} h where h.dedupe_hash in (select job_id from {job_actions})
group by h.dedupe_hash, source_url
""")
def sighting_list(t):
    """Sightings of every record in the action log, newest first within a record."""
    rows = dedupe.collapse(
        hashed(t).withColumnRenamed("dedupe_hash", "job_id"), ["job_id", "source_url"], [],
        "seen_at", TIE,
    )
    return tracker.sighting_list(rows, job_actions(t)).select(
        "job_id", "source_url", "sighting_count", stamp("last_seen_at")
    )


@query(f"""
select application_id, stage, moves, strftime(updated_at, {TIME[:-1]}.%f') as updated_at
from {{current}}
""")
def board_list(t):
    """All applications, the latest change first."""
    cards = tracker.current_stage(moves_of(t)).orderBy(F.desc("updated_at"), "application_id")
    return cards.select("application_id", "stage", "moves", text_time("updated_at").alias("updated_at"))


@query("""
select c.user_id, s.name, s.slug, s.aliases, p.skill_id is not null as selected
from (select c_custkey as user_id from {customer}) c
join {profile_skills} p on p.user_id = c.user_id
join (values ('TypeScript', 'typescript', 'ts'), ('React', 'react', 'react.js,reactjs'),
  ('PostgreSQL', 'postgresql', 'postgres,psql'), ('Python', 'python', 'py'),
  ('AWS', 'aws', 'amazon web services')) s(name, slug, aliases) on s.slug = p.skill_id
""")
def catalogue_list(t):
    """Selected skills of every profile with their catalogue entry, by name."""
    skills = t.spark.createDataFrame(
        SKILL_SEED, "name string, slug string, aliases array<string>, category string"
    )
    picked = t.profile_skills.join(t.profiles.select("user_id"), "user_id")
    return (
        picked.join(skills, F.col("skill_id") == F.col("slug"))
        .select(
            "user_id", "name", "slug", F.array_join("aliases", ",").alias("aliases"),
            F.lit(True).alias("selected"),
        )
        .orderBy("user_id", "name")
    )


# --- merges -----------------------------------------------------------------------------------------------

CHECKS["prices"] = """
select o.o_custkey as user_id, l.l_partkey::varchar as job_id, min(l.l_extendedprice) as low,
  max(l.l_extendedprice) as high, min(l.l_linenumber) as first_line
from {lineitem} l join {orders} o on o.o_orderkey = l.l_orderkey group by 1, 2
"""


@query("""
select user_id, job_id, case when first_line < 4 then high else low end as final_score,
  case when first_line > 1 then 'because of ' || job_id end as explanation
from {prices} where first_line < 4 or first_line > 1
""")
def score_merge(t):
    """New scores over old ones: the explanation of a known pair survives its rescoring."""
    lines = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    pairs = lines.groupBy(
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").cast("string").alias("job_id")
    ).agg(
        F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"),
        F.min("l_linenumber").alias("first_line"),
    )
    new = pairs.where(F.col("first_line") < 4).select(
        "user_id", "job_id", F.col("high").alias("final_score")
    )
    old = pairs.where(F.col("first_line") > 1).select(
        "user_id", "job_id", F.col("low").alias("final_score"),
        F.concat(F.lit("because of "), "job_id").alias("explanation"),
    )
    return merges.merge_scores(old, new)


def versions(t: Inputs):
    """Profiles with a version time, and one update per order customer."""
    base = t.profiles.select(
        "user_id", "seniority", "country_code", F.col("user_id").alias("updated_at")
    )
    updates = t.orders.groupBy((F.col("o_custkey") + 100).alias("user_id")).agg(
        F.min("o_orderkey").alias("k")
    )
    return base, updates.select(
        "user_id",
        F.when(F.col("k") % 3 == 0, F.col("user_id")).when(F.col("k") % 3 == 1, F.lit(-1)).alias(
            "expected_updated_at"
        ),
        F.lit(None).cast("string").alias("country_code"),
        F.lit("staff").alias("seniority"),
        F.when(F.col("k") % 2 == 0, F.array(F.lit("seniority")))
        .otherwise(F.array(F.lit("country_code"))).alias("given"),
    )


CHECKS["changes"] = """
select o_custkey + 100 as user_id, min(o_orderkey) as k from {orders} group by 1
"""
CHECKS["outcomes"] = """
select c.user_id, c.k, case when p.user_id is not null and c.k % 3 <> 1 then 'applied'
  when c.k % 3 <> 2 then 'edit_conflict' else 'not_found' end as outcome
from {changes} c left join {profiles} p on p.user_id = c.user_id
"""


@query("select user_id, outcome from {outcomes}")
def profile_conflicts(t):
    """Outcome of every update: its version matches, is stale, or there is no such profile."""
    base, updates = versions(t)
    return merges.update_outcomes(base, updates).select("user_id", "outcome")


@query("""
select p.user_id,
  case when o.outcome = 'applied' and o.k % 2 = 0 then 'staff' else p.seniority end as seniority,
  case when o.outcome = 'applied' and o.k % 2 <> 0 then null else p.country_code end as country_code,
  case when o.outcome = 'applied' then -5 else p.user_id end as updated_at
from {profiles} p left join {outcomes} o on o.user_id = p.user_id
""")
def partial_update(t):
    """Only the fields an update names change, also to null."""
    base, updates = versions(t)
    return merges.apply_updates(
        base, updates, ["seniority", "country_code"], F.lit(-5).cast("bigint")
    )


@query("""
select user_id, skill_id from {profile_skills} where user_id not in (select o_custkey from {orders})
union all
select distinct o_custkey, lower(o_orderpriority) from {orders}
where o_custkey in (select c_custkey from {customer})
""")
def replace_skills(t):
    """Skill sets of customers with orders are replaced by their order priorities."""
    touched = t.orders.select(F.col("o_custkey").alias("user_id")).distinct()
    new = t.orders.select(
        F.col("o_custkey").alias("user_id"), F.lower("o_orderpriority").alias("skill_id")
    ).distinct()
    return merges.replace_by_key(
        t.profile_skills.select("user_id", "skill_id"), new, "user_id", touched
    )


@query("""
select s_suppkey as user_id, case when s_suppkey % 4 = 0 then s_suppkey::varchar
    || '@no-email.invalid' else lower(s_name) || '@example.com' end as email,
  case when s_suppkey % 3 = 0 then null else s_name end as full_name
from {supplier} where s_suppkey not in (select c_custkey from {customer} where c_acctbal > 0)
  and (s_suppkey % 4 = 0 or s_acctbal >= 1000)
""")
def new_accounts(t):
    """Suppliers become accounts unless their id or e-mail is taken."""
    email = F.when(
        F.col("s_suppkey") % 4 != 0, F.concat(F.lower("s_name"), F.lit("@example.com"))
    )
    accounts = t.supplier.select(
        F.col("s_suppkey").alias("user_id"), email.alias("email"),
        F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.col("s_name")).alias("full_name"),
    )
    taken = t.supplier.where(F.col("s_acctbal") < 1000).select(
        (-F.col("s_suppkey") - 1).alias("user_id"),
        F.concat(F.lower("s_name"), F.lit("@example.com")).alias("email"),
    )
    known = t.customer.where(F.col("c_acctbal") > 0).select(
        F.col("c_custkey").alias("user_id"), F.lit(None).cast("string").alias("email")
    )
    return merges.new_accounts(known.unionByName(taken), accounts)


@query("""
select event_id from {events} where user_id not in (select c_custkey from {customer}
  where c_mktsegment <> 'BUILDING')
""")
def orphan_purge(t):
    """Log rows whose user has no profile outside one segment."""
    parents = t.customer.where(F.col("c_mktsegment") != "BUILDING")
    return merges.orphans(t.events.select("event_id", "user_id"), "user_id", parents, "c_custkey").select(
        "event_id"
    )


@query("""
select o_custkey as user_id,
  sum(case when o_orderpriority not in ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW') then 1 else 0 end)::bigint
    as unknown_items,
  sum(case when n > 1 then 1 else 0 end)::bigint as repeated_items, count(*) as item_count,
  sum(case when o_orderpriority not in ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW') or n > 1 then 1
    else 0 end) = 0 and count(*) >= 3 as acceptable
from (select o_custkey, o_orderpriority, count(*) as n from {orders} group by 1, 2) group by 1
""")
def ref_check(t):
    """Priorities a customer used, as a list that must refer to known ones without repeats."""
    known = t.orders.select("o_orderpriority").distinct().where(
        F.col("o_orderpriority") != "4-NOT SPECIFIED"
    )
    lists = t.orders.select(F.col("o_custkey").alias("user_id"), "o_orderpriority")
    return merges.reference_check(lists, "user_id", "o_orderpriority", known, "o_orderpriority")


@query("""
select doc_id, case when d.doc_id in (select doc_id from {labels} where quality = 1) then 'kept'
  when trim(text) = '' then 'failed' else 'completed' end as status
from {documents} d
""")
def doc_status(t):
    """Documents already completed are skipped, the others are processed."""
    done = t.labels.where(F.col("quality") == 1).select("doc_id").distinct()
    todo = t.documents.join(done, "doc_id", "left_anti")
    status = F.when(F.trim("text") == "", "failed").otherwise("completed")
    kept = t.documents.join(done, "doc_id", "left_semi").select(
        "doc_id", F.lit("kept").alias("status")
    )
    return kept.unionByName(todo.select("doc_id", status.alias("status")))


@query("""
select seniority_rank, count(*) as profiles from (select case seniority when 'junior' then 1.0
  when 'mid' then 2 when 'senior' then 3 when 'lead' then 4 end::double as seniority_rank
  from {profiles}) group by 1
""")
def profile_levels(t):
    rank = seniority_rank(F.col("seniority")).cast("double").alias("seniority_rank")
    return t.profiles.groupBy(rank).agg(F.count(F.lit(1)).alias("profiles"))


@query("""
select source_id, event_id, row_number() over (partition by source_id order by acted_at, event_id) as n
from {run_log}
""")
def numbered_log(t):
    """Position of each log row within its source, also where one source holds most rows."""
    return with_row_number(
        t.run_log.select("source_id", "acted_at", "event_id"), ["source_id"], ["acted_at", "event_id"], "n"
    ).select("source_id", "event_id", F.col("n").cast("bigint").alias("n"))


# --- run health -----------------------------------------------------------------------------------------------

CHECKS["attempts"] = """
select r.*, r.event_type = 'error' as is_error, a.k from {run_log} r
join {actions} a on a.event_id = r.event_id
"""
CHECKS["runs"] = """
select source_id, run_day, count(*) filter (where not is_error) as found,
  count(*) filter (where not is_error and n = 1) as inserted,
  count(*) filter (where not is_error and n > 1) as duplicates,
  count(*) filter (where is_error) as failed, max(acted_at) as finished_at,
  case when count(*) filter (where not is_error) = 0 then 'failed'
    when count(*) filter (where is_error) > 0 then 'partial' else 'success' end as status
from (select *, row_number() over (partition by source_id, k, is_error order by acted_at, event_id) as n
  from {attempts}) group by source_id, run_day
"""
CHECKS["streaks"] = """
select source_id, count(*) filter (where status = 'failed' and (ok is null or finished_at > ok))
  as consecutive_failures, max(ok) as last_success_at
from (select *, max(case when status <> 'failed' then finished_at end)
  over (partition by source_id) as ok from {runs}) group by source_id
"""


def attempts_of(t: Inputs):
    k = t.actions.select("event_id", "k")
    return t.run_log.join(k, "event_id").withColumn("is_error", F.col("event_type") == "error")


def runs_of(t: Inputs):
    return health.run_counts(
        attempts_of(t), ["source_id", "run_day"], ["source_id", "k"], "acted_at", "event_id"
    )


@query("""
select source_id, strftime(run_day, '%Y-%m-%d') as run_day, found, inserted, duplicates, failed, status
from {runs}
""")
def run_stats(t):
    """Counts and status of every run: new records, repeats, failures."""
    return runs_of(t).select(
        "source_id", F.date_format("run_day", "yyyy-MM-dd").alias("run_day"), "found", "inserted",
        "duplicates", "failed", "status",
    )


@query("""
select source_id, count(*) as error_count,
  array_to_string(list('error ' || event_id::varchar order by acted_at, event_id)[1:20], ';') as errors,
  count(*) > 20 as truncated
from {run_log} where event_type = 'error' group by source_id
""")
def run_errors(t):
    """First twenty error messages per source, with the full count."""
    errors = t.run_log.where(F.col("event_type") == "error").withColumn(
        "message", F.concat(F.lit("error "), F.col("event_id").cast("string"))
    )
    return health.run_log(errors, ["source_id"], "message", ["acted_at", "event_id"]).select(
        "source_id", "error_count", F.array_join("errors", ";").alias("errors"), "truncated"
    )


@query(f"""
select source_id, consecutive_failures,
  strftime(last_success_at, {TIME}) as last_success_at from {{streaks}}
""")
def failure_streak(t):
    return health.failure_streaks(runs_of(t)).select(
        "source_id", "consecutive_failures", stamp("last_success_at")
    )


@query("""
select source_id, case when consecutive_failures >= 5 then 'paused'
  when consecutive_failures >= 3 then 'alert' else 'ok' end as health from {streaks}
""")
def source_health(t):
    return health.source_health(health.failure_streaks(runs_of(t))).select("source_id", "health")
