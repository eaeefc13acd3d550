"""Queries: changes to tables that already hold rows, runs over bad records, weighted skills."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankwell.constants import SKILL_SEED
from rankwell.functions import resume
from rankwell.operators import dedupe, feed, merges, reports, scoring, tracker
from rankwell.plans.adapters import CHECKS, NOW
from rankwell.plans.queries_ingest import TIE, hashed, stamp
from rankwell.plans.queries_match import (
    job_actions, ordered_pairs, packed, packed_scores, scored_jobs, spelled, stored_jobs,
)
from rankwell.plans.queries_track import history_of, moves_of, text_time
from rankwell.plans.registry import Inputs, query
from rankwell.session import cut_lineage

_CUT = "2024-01-15"

# --- applications ---------------------------------------------------------------------------------


def _requests(t: Inputs):
    """Requests to apply, every second with a next action, every third with a note."""
    return job_actions(t).where(F.col("event") == "apply").select(
        "user_id", "job_id", F.col("acted_at").alias("applied_at"), F.col("event_id").alias("request_id"),
        F.when(F.col("event_id") % 2 == 0, F.col("acted_at") + F.expr("interval 7 days")).alias("next_action_at"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("note "), "event_id")).alias("notes"),
    )


def _both_halves(t: Inputs):
    """Applications of the first half, and what the whole log, sent afterwards, adds to them."""
    requests, jobs = t.stored("requests", lambda: _requests(t)), stored_jobs(t)
    none = t.spark.createDataFrame([], "user_id bigint, job_id string")
    early = requests.where(F.col("applied_at") < F.lit(_CUT).cast("timestamp"))
    old = tracker.apply_once(none, early, jobs)
    return old, tracker.apply_once(old, requests, jobs)


@query(f"""
select user_id, job_id, event_id as request_id, title,
  case when event_id % 2 = 0 then strftime(acted_at + interval 7 days, '%Y-%m-%d %H:%M:%S') end as next_action_at,
  case when event_id % 3 = 0 then 'note ' || event_id end as notes
from (select a.*, j.title, row_number() over (partition by a.user_id, a.job_id order by acted_at, event_id) as n
  from {{job_actions}} a join {{jobs}} j on j.job_id = a.job_id where event = 'apply')
where n = 1 and acted_at >= timestamp '{_CUT}'
""")
def apply_again(t):
    """The whole log of requests sent to a table that holds its first half: only the rest is new."""
    _, new = _both_halves(t)
    return new.select(
        "user_id", "job_id", "request_id", F.col("job_snapshot")["title"].alias("title"),
        stamp("next_action_at"), "notes",
    )


@query("""
select user_id, job_id, 'applied' as to_stage, case when event_id % 3 = 0 then 'note ' || event_id end as note,
  strftime(acted_at, '%Y-%m-%d %H:%M:%S') as acted_at
from (select a.*, row_number() over (partition by a.user_id, a.job_id order by acted_at, event_id) as n
  from {job_actions} a where event = 'apply') where n = 1
""")
def apply_history(t):
    """One first history row per application: half of the old ones had lost theirs, all are sent twice."""
    old, new = _both_halves(t)
    none = t.spark.createDataFrame([], "user_id bigint, job_id string, from_stage string, to_stage string")
    kept = tracker.first_history(old.where(F.col("user_id") % 2 == 0), none)
    rows = kept
    for _ in range(2):
        rows = rows.unionByName(tracker.first_history(old.unionByName(new), rows))
    return rows.select("user_id", "job_id", "to_stage", "note", stamp("acted_at"))


@query("""
select a.application_id, coalesce(c.stage, 'discovered') as stage,
  strftime(coalesce(c.updated_at, timestamp '2024-01-01'), '%Y-%m-%d %H:%M:%S') as updated_at,
  case when a.application_id not in (select application_id from {history} where to_stage = 'applied')
    then '2024-02-01 00:00:00' end as next_action_at
from (select distinct application_id from {stage_requests}) a
left join {current} c on c.application_id = a.application_id
""")
def moved_applications(t):
    """Applications after all their moves; a move to applied clears the next action."""
    at = lambda day: F.lit(day).cast("timestamp")
    table = t.stage_requests.select("application_id").distinct().select(
        "application_id", F.lit("discovered").alias("stage"), at("2024-01-01").alias("updated_at"),
        at("2024-02-01").alias("next_action_at"),
    )
    return tracker.apply_moves(table, moves_of(t)).select(
        "application_id", "stage", stamp("updated_at"), stamp("next_action_at")
    )


@query("""
select application_id, event_id, to_stage,
  row_number() over (partition by application_id order by acted_at desc, event_id desc) as position
from {history}
""")
def history_newest_first(t):
    """Accepted moves from the latest to the earliest."""
    rows = tracker.newest_first(history_of(t), ["application_id"], ["acted_at", "event_id"])
    return rows.select("application_id", "event_id", "to_stage", F.col("position").cast("bigint").alias("position"))


@query("""
select strftime(date_trunc('week', s), '%Y-%m-%d') as week, count(*) as applications, count(d) as reached,
  median(d)::double as median_days
from (select s, case when e >= s then date_sub('day', s, e) end as d
  from (select application_id, min(acted_at) filter (where to_stage = 'applied') as s,
      min(acted_at) filter (where to_stage = 'interview') as e from {history} group by 1) where s is not null)
group by 1
""")
def first_interviews(t):
    """Days from the application to the first interview, by week of application."""
    rows = reports.days_to_first(history_of(t), "applied", "interview")
    return rows.select(
        F.date_format("week", "yyyy-MM-dd").alias("week"), "applications", "reached", "median_days"
    )


# --- profiles ---------------------------------------------------------------------------------------

_SKILL_VALUES = ", ".join(
    f"('{name}', '{slug}', '{','.join(aliases)}')" for name, slug, aliases, _ in SKILL_SEED
)


@query(f"""
select p.user_id, p.seniority, p.country_code, s.name, s.slug, s.aliases, x.skill_id is not null as selected,
  case when x.skill_id is not null then coalesce(x.level, 'proficient') end as level
from {{profiles}} p cross join (values {_SKILL_VALUES}) s(name, slug, aliases)
left join {{profile_skills}} x on x.user_id = p.user_id and x.skill_id = s.slug
""")
def profile_catalogue(t):
    """Every profile with the whole catalogue, selected or not."""
    skills = t.spark.createDataFrame(
        SKILL_SEED, "name string, slug string, aliases array<string>, category string"
    )
    rows = tracker.profile_catalogue(
        t.profiles.select("user_id", "seniority", "country_code"), skills, t.profile_skills
    )
    return rows.withColumn("aliases", F.array_join("aliases", ","))


CHECKS["versions"] = """
select doc_id as resume_version_id, doc_id % 700 as user_id, n_chars,
  source || '/' || lang || '/' || doc_id || '.pdf' as file_path,
  timestamp '2024-01-01' + to_hours(n_chars::int) as created_at from {documents}
"""


@query("""
select c.c_custkey as user_id, v.resume_version_id || '.pdf' as name,
  case when v.user_id is not null then row_number() over (partition by c.c_custkey
    order by v.created_at desc, v.resume_version_id desc) else 0 end as position
from {customer} c left join {versions} v on v.user_id = c.c_custkey
""")
def resume_versions(t):
    """Résumé versions of every customer, newest first; customers without one have one empty row."""
    versions = t.documents.select(
        F.col("doc_id").alias("resume_version_id"), (F.col("doc_id") % 700).alias("user_id"),
        F.concat_ws("/", "source", "lang", F.concat("doc_id", F.lit(".pdf"))).alias("file_path"),
        F.timestamp_add("HOUR", F.col("n_chars").cast("int"), F.lit("2024-01-01").cast("timestamp")).alias("created_at"),
    )
    users = t.customer.select(F.col("c_custkey").alias("user_id"))
    return tracker.version_list(users, versions).select(
        "user_id", "name", F.coalesce("position", F.lit(0)).cast("bigint").alias("position")
    )


CHECKS["resume_fields"] = """
select c_custkey as doc_id, case c_custkey % 3 when 0 then 'Maria Lopez' when 1 then 'John Van Smith' end as full_name,
  case when c_custkey % 5 <> 0 then 'mail' || c_custkey || '@example.com' end as email,
  case when c_custkey % 4 <> 0 then '(415) 555-' || lpad((c_custkey % 10000)::varchar, 4, '0') end as phone,
  case when c_custkey % 7 = 0 then null when c_custkey % 7 < 3 then 'London' when c_custkey % 7 < 5 then 'Bangalore'
    else 'San Francisco' end as city,
  case when c_custkey % 7 = 0 then null when c_custkey % 7 < 3 then 'GB' when c_custkey % 7 < 5 then 'IN'
    else 'US' end as country_code,
  case c_custkey % 3 when 0 then 'Senior Software Engineer' when 1 then 'Data Analyst|Lead Product Manager'
    else '' end as titles,
  case c_custkey % 3 when 0 then 'senior' when 1 then 'lead' else case when c_custkey % 12 < 2 then 'junior'
    when c_custkey % 12 < 5 then 'mid' when c_custkey % 12 < 8 then 'senior' else 'lead' end end as seniority,
  (c_custkey % 12)::double as years_experience,
  case c_custkey % 4 when 0 then 'Python|Docker|SQL' when 1 then 'C++|C#|Go' when 2 then 'React|Node.js|CI/CD'
    else '' end as skills,
  case c_custkey % 5 when 1 then 'remote' when 2 then 'hybrid|onsite' else '' end as work_modes,
  case when c_custkey % 3 = 0 then 'B.Tech in Computing 2014:2014|Master of Arts, 1999:1999' else '' end as education,
  'Builds things that last and helps people' as summary,
  case when c_custkey % 2 = 0 then (50 + c_custkey % 100) * 1000.0::double end as min_salary,
  case when c_custkey % 2 = 0 then 'USD' end as salary_currency, case when c_custkey % 2 = 0 then 'year' end as salary_period,
  (case when c_custkey % 5 <> 0 then 20 else 0 end + case when c_custkey % 4 <> 0 then 10 else 0 end
    + case when c_custkey % 7 <> 0 then 15 else 0 end + case when c_custkey % 3 < 2 then 20 else 0 end
    + case when c_custkey % 4 < 3 then 20 else 0 end + 15) / 100.0::double as confidence
from {customer}
"""


def resumes_of(t: Inputs):
    """Résumés dealt evenly to the cores, as keys, before their texts are built.

    A file with few row groups gives few tasks with rows, however many splits it has.
    """
    keys = t.customer.select("c_custkey").repartition(2 * t.spark.sparkContext.defaultParallelism)
    return t.view_over("resumes", customer=keys)


@query("""
select *, confidence < 0.6 or email is null or titles = '' as needs_review,
  case when confidence >= 0.6 then 'rules' else 'fallback' end as method from {resume_fields}
""")
def resume_profiles(t):
    """All fields of a résumé per customer."""
    rows = resume.extract_profiles(resumes_of(t))
    place = F.col("location")
    degrees = F.transform("education", lambda e: F.concat_ws(":", e["degree"], e["year"].cast("string")))
    return rows.select(
        "doc_id", "full_name", "email", "phone", place["city"].alias("city"), place["country_code"].alias("country_code"),
        F.array_join("titles", "|").alias("titles"), "seniority", "years_experience",
        F.array_join("skills", "|").alias("skills"), F.array_join("work_modes", "|").alias("work_modes"),
        F.array_join(degrees, "|").alias("education"), "summary", "min_salary", "salary_currency", "salary_period",
        "confidence", "needs_review", "method",
    )


@query("""
select f.doc_id as user_id, f.titles, f.skills,
  case when f.work_modes <> '' then f.work_modes else array_to_string(coalesce(p.work_modes, []), '|') end as work_modes,
  coalesce(f.seniority, p.seniority) as seniority, f.years_experience, coalesce(f.country_code, p.country_code) as country_code,
  f.city, coalesce(f.min_salary, p.min_salary) as min_salary, coalesce(f.salary_currency, p.salary_currency) as salary_currency,
  coalesce(f.salary_period, p.salary_period) as salary_period,
  f.titles <> '' or f.skills <> '' or f.country_code is not null or f.work_modes <> '' as ready
from {resume_fields} f join {profiles} p on p.user_id = f.doc_id
""")
def resume_seeds(t):
    """Seeds from the résumés over the stored profiles: all columns, and whether a seed holds enough."""
    seed = resume.profile_seed(resume.extract_profiles(resumes_of(t))).withColumnRenamed("doc_id", "user_id")
    empty = lambda kind: F.lit(None).cast(kind)
    stored = t.profiles.select(
        "user_id", "seniority", "country_code", "work_modes", "min_salary", "salary_currency", "salary_period",
        empty("array<string>").alias("target_titles"), empty("array<string>").alias("skills"),
        empty("double").alias("years_experience"), empty("string").alias("city"),
    )
    ready = seed.select("user_id", resume.seed_ready().alias("ready"))
    merged = resume.merge_seed(stored, seed, "user_id").join(ready, "user_id")
    lists = {c: F.array_join(c, "|") for c in ("target_titles", "skills", "work_modes")}
    return merged.withColumns(lists).withColumnRenamed("target_titles", "titles")


@query("""
select c_custkey as doc_id, 'Builds things that last and helps people' as summary,
  case c_custkey % 3 when 0 then 'Senior Software Engineer - Acme' || chr(10)
    when 1 then 'Data Analyst | Beta' || chr(10) || 'Lead Product Manager – Gamma' || chr(10) else '' end
    || (c_custkey % 12) || ' years of experience in teams' as experience,
  case when c_custkey % 3 = 0 then 'B.Tech in Computing 2014' || chr(10) || 'Master of Arts, 1999'
    else 'School of life' end as education,
  case c_custkey % 4 when 0 then 'Python, SQL and Docker' when 1 then 'C++, C#, Go'
    when 2 then 'Node.js; React; CI/CD' else 'Cooking' end as skills,
  null::varchar as projects, null::varchar as certifications from {customer}
""")
def resume_sections(t):
    """Named sections of every résumé."""
    names = [name for name, _ in resume.HEADERS]
    return resumes_of(t).select("doc_id", *[resume.section(F.col("text"), n).alias(n) for n in names])


@query("""
select c_custkey as doc_id, case when c_custkey % 10 = 0 then 'failed' else 'completed' end as status,
  case when c_custkey % 3 <> 0 then 1 else 0 end + case when c_custkey % 3 = 0 or c_custkey % 5 = 0 then 1 else 0 end
    as attempts,
  case when c_custkey % 10 = 0 then 'no_email' end as error from {customer}
""")
def resume_status(t):
    """Two thirds of the résumés processed, then all sent: what is completed is not processed again.

    A résumé without an e-mail fails; at the second attempt half of them pass.
    """
    state = t.spark.createDataFrame([], "doc_id bigint, status string, attempts int, error string")
    queue = t.resumes
    for batch in (queue.where(F.col("doc_id") % 3 != 0), queue):
        todo = merges.pending(batch, state, "doc_id")
        missing = F.size(resume.emails(F.col("text"))) == 0
        bad = missing & (F.col("doc_id") % 2 == 0) if batch is queue else missing
        outcomes = todo.select("doc_id", F.when(bad, "no_email").alias("error"))
        state = cut_lineage(merges.after_processing(state, outcomes, "doc_id"))
    return state


# --- records ----------------------------------------------------------------------------------------


@query("""
select dedupe_hash as job_id, source_url, count(*) as sighting_count,
  strftime(min(seen_at), '%Y-%m-%d %H:%M:%S') as first_seen_at,
  strftime(max(seen_at), '%Y-%m-%d %H:%M:%S') as last_seen_at,
  arg_min(order_key, (seen_at, order_key, line_number)) as order_key
from {hashed} group by 1, 2
""")
def address_sightings(t):
    """Sightings merged on (record, address) in two batches; the first one's order stays."""
    rows = hashed(t).withColumnRenamed("dedupe_hash", "job_id")
    cut = F.lit("1995-01-01").cast("timestamp")
    keys, kept = ["job_id", "source_url"], ["order_key"]
    batch = lambda df: dedupe.collapse(df, keys, kept, "seen_at", TIE)
    old = batch(rows.where(F.col("seen_at") < cut))
    merged = dedupe.merge_state(old, batch(rows.where(F.col("seen_at") >= cut)), keys, kept)
    return merged.select(
        *keys, "sighting_count", stamp("first_seen_at"), stamp("last_seen_at"), "order_key"
    )


@query("""
select s.user_id, count(*) filter (where not bad) as scored, count(*) filter (where bad) as failed,
  count(*) filter (where not bad and not s.passed) as gated
from (select s.*, j.part_key % 7 = 0 or j.part_key % 11 = 0 as bad
  from {given_scores} s join {jobs} j on j.job_id = s.job_id) s group by 1
""")
def rescore_counters(t):
    """Scored, failed and gated pairs of each customer where some records hold no figure or no date."""
    part = F.col("part_key")
    raw = scored_jobs(t).withColumns(
        {
            "salary_min": F.when(part % 7 == 0, F.col("title")).otherwise(F.col("salary_min").cast("string")),
            "posted_at": F.when(part % 11 == 0, "1995-13-45").otherwise(F.col("posted_at").cast("string")),
        }
    )
    vectors = t.embeddings.select("vec_id", "embedding")
    rows = scoring.score_checked(
        ordered_pairs(t), packed(raw), {"salary_min": "double", "posted_at": "timestamp"},
        t.profiles.join(vectors, "vec_id", "left"), NOW, profile_skills=t.profile_skills,
    )
    return rows.groupBy("user_id").agg(*scoring.run_counters())


CHECKS["weighted_skills"] = """
select job_id, list(w) as ws, list(s) as ss, max(w) as top from (
  select job_id, unnest(list_sort(tags)) as s, (length(s) % 4 + 1) / 4.0::double as w from {job_tags}) group by 1
"""


@query("""
select x.user_id, x.job_id, case when w.job_id is null or p.sk is null then 0.5::double
  else floor(list_reduce(list_transform(range(len(w.ss)), lambda i:
      w.ws[i + 1] / w.top * coalesce(p.fc[list_position(p.sk, w.ss[i + 1])], 0.0)), lambda a, b: a + b)
    / list_reduce(list_transform(w.ws, lambda v: v / w.top), lambda a, b: a + b) * 100 + 0.5) / 100 end as skills_raw
from {ordered_jobs} x join {given_side} p on p.user_id = x.user_id
left join {weighted_skills} w on w.job_id = x.job_id
""")
def weighted_skill_score(t):
    """Skill component where a record asks for its skills with different weights."""
    jobs = packed(stored_jobs(t))
    skills = scoring.derive_job_skills(jobs).withColumn(
        "weight", (F.length("skill_id") % 4 + 1) / F.lit(4.0)
    )
    rows = scoring.score_given(
        ordered_pairs(t), jobs, t.profiles, NOW, skills, t.profile_skills
    )
    return spelled(rows).select("user_id", "job_id", F.get("breakdown", 0)["raw"].alias("skills_raw"))


# --- feed -------------------------------------------------------------------------------------------

CHECKS["dated_feed"] = """
select s.user_id, s.job_id, s.final_score, j.posted_at
from {given_scores} s join {jobs} j on j.job_id = s.job_id
where s.final_score >= 60 and j.part_key % 9 <> 0 and j.part_key % 3 = 1 and j.part_key % 4 in (0, 2)
  and j.posted_at >= timestamp '1992-06-01'
  and not exists (select 1 from {job_actions} a where a.user_id = s.user_id and a.job_id = s.job_id
    and a.event in ('dismiss', 'apply'))
"""


@query("""
select user_id, job_id, position from (select user_id, job_id,
  row_number() over (partition by user_id order by posted_at desc, job_id desc) as position from {dated_feed})
where position <= 10
""")
def feed_by_date(t):
    """Newest records of one source and of two employment types that are still open."""
    part = F.col("part_key")
    jobs = packed(stored_jobs(t)).withColumns(
        {
            "status": F.when(part % 9 == 0, "expired").otherwise("active"),
            "source_id": part % 3,
            "employment_type": F.element_at(
                F.array(*map(F.lit, ("full_time", "part_time", "contract", "internship"))),
                (part % 4 + 1).cast("int"),
            ),
        }
    ).drop("part_key")
    view = feed.ranked_view(jobs, packed_scores(t), feed.action_flags(packed(job_actions(t))))
    narrow = feed.FeedFilter(
        employment_types=("full_time", "contract"), source_id=1, posted_since="1992-06-01"
    )
    page = feed.page(feed.feed_rows(view, narrow), 10, "date")
    return spelled(page).select("user_id", "job_id", F.col("position").cast("bigint").alias("position"))


@query("""
select s.user_id, s.job_id from {given_scores} s join {jobs} j on j.job_id = s.job_id
where j.part_key % 9 <> 0 and j.part_key % 5 < 2
""")
def scored_since(t):
    """Pairs of open records whose last scoring is recent."""
    part = F.col("part_key")
    jobs = packed(stored_jobs(t)).withColumn("status", F.when(part % 9 == 0, "expired").otherwise("active"))
    ages = jobs.select("job_id", (part % 5).cast("int").alias("_age"))
    scores = packed_scores(t).join(ages, "job_id").withColumn(
        "scored_at", F.timestamp_add("DAY", -F.col("_age"), F.col("scored_at"))
    )
    return spelled(feed.recently_scored(jobs, scores, "1995-06-29 00:00:00"))
