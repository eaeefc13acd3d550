"""Queries: gates, rule scores, blend, feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankwell.constants import SCORE_BANDS
from rankwell.functions import labels
from rankwell.functions.text import round2
from rankwell.operators import dedupe, feed, reach, scoring, search
from rankwell.operators.ordered import with_row_number
from rankwell.plans.adapters import CHECKS, NOW
from rankwell.plans.queries_ingest import first_lines, hashed, jobs_of, numbered_jobs, stamp
from rankwell.plans.registry import Inputs, query
from rankwell.session import broadcast_if_small


def _vectors(t: Inputs, key: str):
    return t.embeddings.select(F.col("vec_id").alias(key), "embedding")


def stored_jobs(t: Inputs):
    return t.stored("jobs", lambda: numbered_jobs(t)).drop("job_no")


def scored_jobs(t: Inputs):
    return stored_jobs(t).join(_vectors(t, "part_key"), "part_key", "left")


def packed(rows):
    """Record ids as the 32 bytes their hex digits stand for: half of what a pair weighs in a shuffle."""
    return rows.withColumn("job_id", F.unhex("job_id"))


def spelled(rows):
    return rows.withColumn("job_id", F.lower(F.hex("job_id")))


def ordered_pairs(t: Inputs):
    """(customer, record) pairs of the order lines, record ids packed.

    Lines meet their orders while they are three numbers wide, and carry the customer as their order
    from there; titles and hashes come after.
    """
    owner = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("_user"))
    lines = t.lineitem.join(owner, "l_orderkey").drop("l_orderkey").withColumnRenamed("_user", "l_orderkey")
    rows = dedupe.with_hash(t.view_over("sightings", lineitem=lines))
    return packed(rows.select(F.col("order_key").alias("user_id"), F.col("dedupe_hash").alias("job_id")))


def numbered_pairs(t: Inputs):
    """The ordered pairs with the number of each record, a quarter of its hash."""
    numbers = first_lines(t).select(F.col("dedupe_hash").alias("job_id"), "job_no")
    return ordered_pairs(t).join(broadcast_if_small(numbers), "job_id").select("user_id", "job_no")


def packed_scores(t: Inputs):
    profiles = t.profiles.join(_vectors(t, "vec_id"), "vec_id", "left")
    jobs = t.stored("jobs", lambda: numbered_jobs(t)).join(_vectors(t, "part_key"), "part_key", "left")
    return scoring.score_given(
        numbered_pairs(t), packed(jobs), profiles, NOW, profile_skills=t.profile_skills, job_key="job_no"
    )


def given_scores(t: Inputs):
    return spelled(packed_scores(t))


def cohort_profiles(t: Inputs):
    return t.cohorts.join(_vectors(t, "vec_id"), "vec_id", "left")


def cohort_scores(t: Inputs):
    return scoring.score_all(
        scored_jobs(t), cohort_profiles(t), NOW, profile_skills=t.cohort_skills
    )


def job_actions(t: Inputs):
    """Log rows as actions on records: k names the part of the record."""
    parts = stored_jobs(t).select("job_id", F.col("part_key").alias("k"))
    return t.actions.where(F.col("event").isNotNull()).join(parts, "k").select(
        "user_id", "job_id", "event", "acted_at", "event_id"
    )


def view_of(t: Inputs):
    jobs = stored_jobs(t).drop("part_key")
    return feed.ranked_view(jobs, cohort_scores(t), feed.action_flags(job_actions(t)))


def feed_table(t: Inputs, *columns: str):
    """Feed rows reduced to the columns a query reads several times."""
    return t.stored(
        "feed", lambda: feed.feed_rows(view_of(t)).select("user_id", "job_id", "final_score", *columns)
    )


# --- the same in plain SQL --------------------------------------------------------------------------

_JOB_SIDE = """
select j.*, g.tags, e.embedding::double[] as vec, upper(j.country_code) as cc,
  (list_position(['intern','junior','mid','senior','lead','staff','principal','director','exec'],
    j.seniority) - 1) as jr,
  upper(j.salary_currency) as cur,
  case coalesce(j.salary_period, 'year') when 'year' then coalesce(j.salary_max, j.salary_min)
    when 'month' then coalesce(j.salary_max, j.salary_min) * 12 end as annual,
  list_filter([trim(regexp_replace(lower(j.company_name), '[^a-z0-9]+', '-', 'g'), '-'),
    j.company_domain, split_part(j.company_domain, '.', 1)], lambda c: c is not null) as cands
from {{{jobs}}} j join {{{tags}}} g on g.job_id = j.job_id
  left join {{embeddings}} e on e.vec_id = j.part_key
"""
CHECKS["job_side"] = _JOB_SIDE.format(jobs="jobs", tags="job_tags")


def _score_ctes(label: str, profiles: str, skills: str, pairs: str, side: str = "job_side") -> None:
    CHECKS[f"{label}_levels"] = f"""
select user_id, list(skill_id order by skill_id) as sk, list(factor order by skill_id) as fc
from (select user_id, skill_id, case coalesce(level, 'proficient') when 'familiar' then 0.6::double
  when 'proficient' then 0.85::double else 1.0::double end as factor from {{{skills}}})
group by user_id
"""
    CHECKS[f"{label}_side"] = f"""
select p.*, upper(p.country_code) as pc, upper(p.salary_currency) as pcur, v.sk, v.fc,
  e.embedding::double[] as vec,
  (list_position(['intern','junior','mid','senior','lead','staff','principal','director','exec'],
    p.seniority) - 1) as pr,
  case coalesce(p.salary_period, 'year') when 'year' then p.min_salary
    when 'month' then p.min_salary * 12 end as floor_annual,
  list_filter(list_transform(p.excluded_keywords, lambda k: lower(trim(k))), lambda k: k <> '')
    as kws
from {{{profiles}}} p left join {{{label}_levels}} v on v.user_id = p.user_id
  left join {{embeddings}} e on e.vec_id = p.vec_id
"""
    CHECKS[f"{label}_hits"] = f"""
select job_id, list(k) as hits
from {{{side}}}, (select distinct unnest(kws) as k from {{{label}_side}})
where regexp_matches(lower(title || ' ' || description_text),
  case when regexp_matches(k, '^\\w') then '\\b' else '' end
  || regexp_replace(k, '([.*+?^${{}}()|\\[\\]\\\\])', '\\\\\\1', 'g')
  || case when regexp_matches(k, '\\w$') then '\\b' else '' end)
group by job_id
"""
    CHECKS[f"{label}_parts"] = f"""
select p.user_id, j.job_id,
  list_has_any(j.cands, p.blocked_companies) as g1,
  coalesce(list_has_any(h.hits, p.kws), false) as g2,
  len(p.work_modes) > 0 and j.work_mode <> 'unknown'
    and not list_contains(p.work_modes, j.work_mode) as g3,
  coalesce(j.cur = p.pcur and j.annual < p.floor_annual, false) as g4,
  coalesce(j.jr > p.pr + 1, false) as g5,
  case when len(j.tags) > 0 and len(p.sk) > 0 then
    list_reduce(list_transform(j.tags, lambda s: coalesce(p.fc[list_position(p.sk, s)], 0.0)),
      lambda a, b: a + b) / len(j.tags) end as skills,
  1 - abs(j.jr - p.pr) / 4.0::double as level_raw,
  case when j.cur = p.pcur and p.floor_annual > 0 then j.annual / p.floor_annual end as pay,
  case when len(p.work_modes) = 0 then 0.5 when j.work_mode = 'unknown' then 0.6
    when list_contains(p.work_modes, j.work_mode) then 1.0 else 0.2 end::double as mode_raw,
  case when p.pc is null or j.cc is null then 0.5 when p.pc = j.cc then 1.0
    when j.work_mode in ('remote', 'hybrid') then case j.remote_scope when 'global' then 0.9
      when 'india' then case when p.pc = 'IN' then 1.0 else 0.5 end else 0.7 end
    else 0.2 end::double as place_raw,
  len(p.work_modes) > 0 and j.work_mode <> 'unknown' and p.pc is not null and j.cc is not null
    as place_known,
  case when epoch_us(timestamp '{NOW}') < epoch_us(j.posted_at) then 1.0 else 1
    - (epoch_us(timestamp '{NOW}') - epoch_us(j.posted_at)) / 86400000000.0::double / 28.0::double
    end::double as fresh,
  case when len(p.preferred_companies) > 0 and len(j.cands) > 0 then
    case when list_has_any(j.cands, p.preferred_companies) then 1.0 else 0.0 end end::double as pref,
  case when j.vec is not null and p.vec is not null then
    least(100, greatest(0, list_dot_product(j.vec, p.vec) / (sqrt(list_dot_product(j.vec, j.vec))
      * sqrt(list_dot_product(p.vec, p.vec))) * 100)) end as semantic
from {pairs} left join {{{label}_hits}} h on h.job_id = j.job_id
"""
    half = "case when {0} is null then 0.5::double else least(1.0, greatest(0.0, {0})) end"
    pts = "floor({} * {} * 100 + 0.5) / 100"
    CHECKS[f"{label}_scores"] = f"""
select *, not (g1 or g2 or g3 or g4 or g5) as passed,
  floor((p1 + p2 + p3 + p4 + p5 + p6) * 100 + 0.5) / 100 as rule_score,
  case when g1 or g2 or g3 or g4 or g5 then 0.0
    when semantic is null then floor((p1 + p2 + p3 + p4 + p5 + p6) * 100 + 0.5) / 100
    else floor((floor((p1 + p2 + p3 + p4 + p5 + p6) * 100 + 0.5) / 100 * 0.5::double
      + semantic * 0.5::double) * 100 + 0.5) / 100 end::double as final_score,
  concat_ws(',', case when g1 then 'blocked_company' end,
    case when g2 then 'excluded_keyword' end, case when g3 then 'work_mode_mismatch' end,
    case when g4 then 'salary_below_floor' end, case when g5 then 'seniority_over_band' end)
    as reasons
from (select *, {pts.format('r1', 35)} as p1, {pts.format('r2', 15)} as p2,
    {pts.format('r3', 15)} as p3, {pts.format('r4', 15)} as p4, {pts.format('r5', 10)} as p5,
    {pts.format('r6', 10)} as p6
  from (select *, {half.format('skills')} as r1, {half.format('level_raw')} as r2,
      {half.format('pay')} as r3,
      least(1.0, greatest(0.0, mode_raw * 0.7::double + place_raw * 0.3::double)) as r4,
      {half.format('fresh')} as r5, coalesce(pref, 0.5::double) as r6 from {{{label}_parts}}))
"""


CHECKS["ordered_jobs"] = """
select distinct o.o_custkey as user_id, h.dedupe_hash as job_id
from {hashed} h join {orders} o on o.o_orderkey = h.order_key
"""
_score_ctes(
    "given", "profiles", "profile_skills",
    "{ordered_jobs} x join {given_side} p on p.user_id = x.user_id "
    "join {job_side} j on j.job_id = x.job_id",
)
_score_ctes(
    "cohort", "cohorts", "cohort_skills",
    "{cohort_side} p join {job_side} j on (len(p.work_modes) = 0 or j.work_mode = 'unknown' "
    "or list_contains(p.work_modes, j.work_mode)) and coalesce(j.jr <= p.pr + 1, true)",
)
_OPEN = (
    "(len(p.work_modes) = 0 or j.work_mode = 'unknown' or list_contains(p.work_modes, j.work_mode)) "
    "and coalesce(j.jr <= p.pr + 1, true)"
)
_score_ctes("every", "profiles", "profile_skills", "{every_side} p join {job_side} j on " + _OPEN)
CHECKS["version_jobs"] = "select * replace (job_id || '/' || version as job_id) from {record_versions}"
CHECKS["version_tags"] = CHECKS["job_tags"].replace("{jobs}", "{version_jobs}")
CHECKS["version_side"] = _JOB_SIDE.format(jobs="version_jobs", tags="version_tags")
_score_ctes("vers", "profiles", "profile_skills", "{vers_side} p join {version_side} j on " + _OPEN, "version_side")
CHECKS["every_feed"] = "select * from {every_scores} where final_score >= 60"
CHECKS["job_actions"] = """
select a.user_id, j.job_id, a.event, a.acted_at, a.event_id from {actions} a
join {jobs} j on j.part_key = a.k where a.event is not null
"""
CHECKS["ranked"] = """
select j.*, s.user_id, s.final_score, s.rule_score, s.semantic,
  exists(select 1 from {job_actions} a where a.user_id = s.user_id and a.job_id = j.job_id
    and a.event = 'save') as saved,
  exists(select 1 from {job_actions} a where a.user_id = s.user_id and a.job_id = j.job_id
    and a.event = 'dismiss') as dismissed,
  exists(select 1 from {job_actions} a where a.user_id = s.user_id and a.job_id = j.job_id
    and a.event = 'apply') as applied
from {jobs} j join {cohort_scores} s on s.job_id = j.job_id
"""
CHECKS["feed_all"] = """
select * from {ranked} where final_score >= 60 and not dismissed and not applied
"""


def record_numbers(t: Inputs):
    """(job_id, number) of every record, numbers in the order of the ids."""
    ids = stored_jobs(t).select("job_id").withColumn("_all", F.lit(0))
    return t.stored("record_numbers", lambda: with_row_number(ids, ["_all"], ["job_id"], "number").drop("_all"))


def customer_feeds(t: Inputs, **handed_on):
    """Feed scores of all customers, counted where they are scored; records go by their numbers."""
    profiles = t.profiles.join(_vectors(t, "vec_id"), "vec_id", "left")
    jobs = scored_jobs(t).join(record_numbers(t), "job_id").drop("job_id").withColumnRenamed("number", "job_id")
    return t.stored("customer_feeds", lambda: reach.score_feed(
        jobs, profiles, NOW, profile_skills=t.profile_skills, **handed_on
    ))


@query("""
select user_id, job_id, final_score, rule_score, position, total from (select *,
    row_number() over (partition by user_id order by final_score desc, job_id desc) as position,
    count(*) over (partition by user_id) as total from {every_feed}) where position <= 20
""")
def customer_feed(t):
    """First page of every customer's feed with its exact total."""
    rows = customer_feeds(t, best=20 + 1)  # one more than the page, which tells whether there are more
    page = feed.with_total(feed.page(rows, 20), rows, "pairs").withColumnRenamed("job_id", "number")
    return page.join(record_numbers(t), "number").select(
        "user_id", "job_id", "final_score", "rule_score", F.col("position").cast("bigint").alias("position"), "total"
    )


@query("""
select case when final_score >= 85 then 'strong' when final_score >= 70 then 'good' else 'fair' end as band,
  count(*) as pairs, count(distinct user_id) as users, count(distinct job_id) as records
from {every_feed} group by 1
""")
def customer_bands(t):
    """Feed rows of all customers by band, with the customers and records they reach."""
    rows = customer_feeds(t, edges=[edge for edge, _ in SCORE_BANDS]).withColumn("band", labels.score_band(F.col("final_score")))
    return rows.groupBy("band").agg(
        F.sum("pairs").alias("pairs"), F.count_distinct("user_id").alias("users"),
        F.count_distinct("job_id").alias("records"),
    )


# --- gates and scores ------------------------------------------------------------------------------------


@query("select user_id, job_id, passed, reasons from {given_scores}")
def gate_reasons(t):
    """All gates of every ordered pair, with every reason that fires."""
    return given_scores(t).select(
        "user_id", "job_id", F.col("gate_passed").alias("passed"),
        F.array_join("gate_reasons", ",").alias("reasons"),
    )


@query("""
select s.reason, count(*) as pairs from (select unnest(string_split(reasons, ',')) as reason
  from {given_scores} where reasons <> '') s group by s.reason
union all select 'passed', count(*) from {given_scores} where passed
""")
def gate_counts(t):
    coded = F.when(F.col("gate_passed"), F.array(F.lit("passed"))).otherwise(F.col("gate_reasons"))
    return given_scores(t).select(F.explode(coded).alias("reason")).groupBy("reason").agg(
        F.count(F.lit(1)).alias("pairs")
    )


@query("""
select p.user_id, count(*) filter (where m and not r) as mode_only,
  count(*) filter (where r and not m) as seniority_only, count(*) filter (where m and r) as both,
  count(*) filter (where not m and not r) as eligible
from (select p.user_id, p.user_id, len(p.work_modes) > 0 and j.work_mode <> 'unknown'
    and not list_contains(p.work_modes, j.work_mode) as m, coalesce(j.jr > p.pr + 1, false) as r
  from {given_side} p, (select work_mode, jr from {job_side}) j) p
group by p.user_id
""")
def gate_totals(t):
    """Per customer: how many records work mode and seniority rule out, without pairing them."""
    return scoring.gate_totals(
        scoring.prepare_jobs(jobs_of(t)), scoring.prepare_profiles(t.profiles)
    )


@query("""
select user_id, job_id, r1 as skills_raw, p1 as skills_points, skills is not null as known
from (select *, floor(r1 * 100 + 0.5) / 100 as r from {given_scores})
""".replace("r1 as skills_raw", "r as skills_raw"))
def skill_score(t):
    part = F.get("breakdown", 0)
    return given_scores(t).select(
        "user_id", "job_id", part["raw"].alias("skills_raw"), part["points"].alias("skills_points"),
        part["known"].alias("known"),
    )


@query("select user_id, job_id, rule_score from {given_scores}")
def rule_score(t):
    return given_scores(t).select("user_id", "job_id", "rule_score")


@query("""
select user_id, job_id, u.key, u.label, u.points, u.points / u.weight * 100 as percent, u.known
from (select user_id, job_id, unnest([
  {'key': 'skills', 'label': 'Skills', 'weight': 35.0::double, 'points': p1::double,
    'known': skills is not null},
  {'key': 'seniority', 'label': 'Seniority', 'weight': 15.0::double, 'points': p2::double,
    'known': level_raw is not null},
  {'key': 'compensation', 'label': 'Compensation', 'weight': 15.0::double, 'points': p3::double,
    'known': pay is not null},
  {'key': 'work-mode', 'label': 'Work mode', 'weight': 15.0::double, 'points': p4::double,
    'known': place_known},
  {'key': 'recency', 'label': 'Recency', 'weight': 10.0::double, 'points': p5::double,
    'known': true},
  {'key': 'company-preference', 'label': 'Company pref', 'weight': 10.0::double,
    'points': p6::double, 'known': pref is not null}]) as u from {given_scores})
""")
def breakdown_long(t):
    return scoring.breakdown_rows(given_scores(t)).select(
        "user_id", "job_id", "key", "label", "points", "percent", "known"
    )


@query("""
select user_id, job_id, final_score, rule_score,
  floor(semantic * 1000000 + 0.5) / 1000000 as semantic_score, 'rule-v1' as model_version
from {given_scores}
""")
def final_score(t):
    return given_scores(t).select(
        "user_id", "job_id", "final_score", "rule_score",
        (F.floor(F.col("semantic_score") * 1000000 + 0.5) / F.lit(1000000.0)).alias("semantic_score"),
        "model_version",
    )


@query("""
select user_id, job_id, final_score, rule_score, reasons from {cohort_scores}
""")
def cohort_rescore(t):
    """Every cohort against every record that its work-mode and seniority gates let through."""
    return cohort_scores(t).select(
        "user_id", "job_id", "final_score", "rule_score",
        F.array_join("gate_reasons", ",").alias("reasons"),
    )


@query("""
select case when final_score >= 85 then 'strong' when final_score >= 70 then 'good'
  when final_score >= 55 then 'fair' when final_score > 0 then 'weak' else 'gated' end as band,
  count(*) as pairs from {cohort_scores} group by 1
""")
def score_bands(t):
    return scoring.band_counts(cohort_scores(t))


@query("""
select c.user_id, count(s.job_id) as scored, (select count(*) from {jobs}) as records,
  floor(count(s.job_id) / (select count(*) from {jobs}) * 100 + 0.5) / 100 as coverage
from {cohorts} c left join {cohort_scores} s on s.user_id = c.user_id group by c.user_id
""")
def score_coverage(t):
    """Scored share of the corpus per cohort."""
    counts = cohort_scores(t).groupBy("user_id").agg(F.count(F.lit(1)).alias("scored"))
    total = stored_jobs(t).groupBy().agg(F.count(F.lit(1))).scalar()
    rows = t.cohorts.select("user_id").join(counts, "user_id", "left").select(
        "user_id", F.coalesce("scored", F.lit(0)).alias("scored"), total.alias("records")
    )
    return rows.withColumn("coverage", scoring.coverage(F.col("scored"), F.col("records")))


# --- feed ----------------------------------------------------------------------------------------------------

_FEED = "user_id, job_id, title, company_name, final_score, saved"


@query(f"""
select {_FEED}, position, total > 20 as has_more, total from (
  select *, row_number() over (partition by user_id order by final_score desc, job_id desc)
    as position, count(*) over (partition by user_id) as total from {{feed_all}})
where position <= 20
""")
def ranked_feed(t):
    """First page of every cohort's feed with the exact total beside it."""
    rows = feed_table(t, "title", "company_name", "saved")
    page = feed.with_total(feed.page(rows, 20), rows)
    return page.select(
        "user_id", "job_id", "title", "company_name", "final_score", "saved",
        F.col("position").cast("bigint").alias("position"), "has_more", "total",
    )


@query("""
select user_id, job_id, work_mode, seniority, salary_max, final_score from {feed_all}
where work_mode in ('remote', 'hybrid') and seniority in ('mid', 'senior')
  and salary_max >= 50000 and country_code = 'IN' and remote_scope = 'global'
  and posted_at >= timestamp '1995-02-01' and final_score < 85
""")
def feed_filters(t):
    narrow = feed.FeedFilter(
        work_modes=("remote", "hybrid"), seniorities=("mid", "senior"), min_salary=50000,
        country="IN", remote_scope="global", posted_since="1995-02-01",
        bands=("good", "fair"),
    )
    return feed.feed_rows(view_of(t), narrow).select(
        "user_id", "job_id", "work_mode", "seniority", "salary_max", "final_score"
    )


@query("""
select 'salary' as sorted_by, user_id, job_id, position from (select *, row_number() over (
  partition by user_id order by salary_max desc nulls last, job_id desc) as position
  from {feed_all}) where position <= 5
union all
select 'band', user_id, job_id, position from (select *, row_number() over (
  partition by user_id order by case when final_score >= 85 then 0 when final_score >= 70 then 1
  else 2 end, posted_at desc nulls last, job_id desc) as position from {feed_all})
  where position <= 5
""")
def feed_sorted(t):
    """First five rows of each feed by salary, and by band with the newest first."""
    rows = feed_table(t, "salary_max", "posted_at")
    pages = [
        feed.page(rows, 5, by).select(
            F.lit(by).alias("sorted_by"), "user_id", "job_id",
            F.col("position").cast("bigint").alias("position"),
        )
        for by in ("salary", "band")
    ]
    return pages[0].unionByName(pages[1])


@query("""
select user_id, job_id, final_score from (select *, row_number() over (partition by user_id
  order by final_score desc, job_id desc) as position from {feed_all}
  where final_score < 70.5 or (final_score = 70.5 and job_id < '8')) where position <= 10
""")
def feed_page2(t):
    """The page after the cursor (70.5, '8') of every feed."""
    rows = feed.feed_rows(view_of(t), feed.FeedFilter(cursor=(70.5, "8")))
    return feed.page(rows, 10).select("user_id", "job_id", "final_score")


@query("select user_id, count(*) as total from {feed_all} group by user_id")
def feed_total(t):
    return feed.feed_rows(view_of(t)).groupBy("user_id").agg(F.count(F.lit(1)).alias("total"))


@query("""
select f.user_id, f.job_id from {feed_all} f join {cohorts} c on c.user_id = f.user_id
where c.seniority <> 'senior' or f.first_seen_at > timestamp '1995-03-01'
""")
def new_since(t):
    """Rows first seen after the last visit; cohorts without a known visit see all."""
    visits = t.cohorts.where(F.col("seniority") == "senior").select(
        "user_id", F.lit("1995-03-01").cast("timestamp").alias("last_seen_feed_at")
    )
    return feed.only_new(feed.feed_rows(view_of(t)), visits).select("user_id", "job_id")


@query("select user_id, job_id from {cohort_scores}")
def recent_scored(t):
    return feed.recently_scored(stored_jobs(t), cohort_scores(t), "1995-06-01").select(
        "user_id", "job_id"
    )


@query("""
select job_id, strftime(posted_at, '%Y-%m-%d %H:%M:%S') as posted_at from (select * from {jobs}
  where posted_at < timestamp '1996-01-01' or (posted_at = timestamp '1996-01-01' and job_id > '8'))
order by posted_at desc nulls last, job_id limit 100
""")
def score_order_page(t):
    """One hundred records after a (date, id) position in rescoring order."""
    return feed.rescore_page(jobs_of(t), 100, ("1996-01-01", "8")).select("job_id", stamp("posted_at"))


@query("""
select doc_id from (select doc_id, ' ' || trim(regexp_replace(lower(title || ' ' || source || ' '
  || text), '[^a-z0-9]+', ' ', 'g')) || ' ' as w from {postings})
where (contains(w, ' senior ') and contains(w, ' engineer london ') and not contains(w, ' src1 '))
  or contains(w, ' intern ')
""")
def feed_search(t):
    """Words, a phrase, an exclusion and an alternative over title, source and text."""
    return search.search_records(
        t.postings, 'the senior "engineer london" -src1 or intern', ["title", "source", "text"]
    ).select("doc_id")


@query("""
select doc_id from (select doc_id, ' ' || trim(regexp_replace(lower(title || ' ' || source || ' '
  || text), '[^a-z0-9]+', ' ', 'g')) || ' ' as w from {postings})
where (regexp_matches(w, ' senior engine(s|d|er|ers|ered|ering)? ')
    and not regexp_matches(w, ' src1 '))
  or regexp_matches(w, ' (chief|chiefs|chiefly) of staffs? ')
  or regexp_matches(w, ' intern(s|ed|ing)? ')
""")
def feed_search_stems(t):
    """Phrases of inflected words, an exclusion and alternatives over title, source and text, by stems."""
    columns = ["title", "source", "text"]
    index = t.stored("stems", lambda: search.stem_index(t.postings, "doc_id", columns))
    wanted = '"seniors engineering" -src1 or "chiefs of staffs" or interned'
    return search.search_stems(t.postings, index, wanted, "doc_id").select("doc_id")


@query("""
select job_id,
  case when salary_max is not null then regexp_replace(salary_min::varchar, '\\.0$', '') || '–'
      || regexp_replace(salary_max::varchar, '\\.0$', '')
    else 'from ' || regexp_replace(salary_min::varchar, '\\.0$', '') end as figures,
  coalesce(upper(salary_currency), '') || case salary_period when 'year' then '/yr'
    when 'month' then '/mo' when 'hour' then '/hr' else '' end as unit,
  month(posted_at)::varchar || '/' || day(posted_at)::varchar || '/' || year(posted_at)::varchar
    as posted
from {jobs}
""")
def display_labels(t):
    """Salary label split at its last blank, and date label."""
    label = labels.salary_label(
        F.col("salary_min"), F.col("salary_max"), F.upper("salary_currency"), F.col("salary_period")
    )
    return jobs_of(t).withColumn("label", label).select(
        "job_id",
        F.regexp_extract("label", r"^((?:from )?\S+)", 1).alias("figures"),
        F.regexp_extract("label", r"^(?:from )?\S+ ?(.*)$", 1).alias("unit"),
        labels.date_label(F.col("posted_at")).alias("posted"),
    )


@query("""
select reason, case reason when 'blocked_company' then 'You asked to avoid this company.'
  when 'excluded_keyword' then 'This posting contains a keyword you asked to skip.'
  when 'work_mode_mismatch' then 'The way of working does not match the options you chose.'
  when 'salary_below_floor' then 'The salary is below the minimum you set.'
  else 'The seniority is above the band you set.' end as sentence, count(*) as pairs
from (select unnest(string_split(reasons, ',')) as reason from {given_scores} where reasons <> '')
group by 1, 2
""")
def gate_sentences(t):
    both = F.arrays_zip(
        F.col("gate_reasons").alias("reason"),
        labels.gate_sentences(F.col("gate_reasons")).alias("sentence"),
    )
    return given_scores(t).select(F.inline(both)).groupBy("reason", "sentence").agg(
        F.count(F.lit(1)).alias("pairs")
    )


@query("""
select user_id, job_id, floor(rule_score * 100 + 0.5) / 100 as rounded,
  case when final_score >= 85 then 'strong' when final_score >= 70 then 'good'
  when final_score >= 55 then 'fair' when final_score > 0 then 'weak' else 'gated' end as band
from {given_scores}
""")
def band_labels(t):
    return given_scores(t).select(
        "user_id", "job_id", round2(F.col("rule_score")).alias("rounded"),
        labels.score_band(F.col("final_score")).alias("band"),
    )
