"""Records, profiles, pairs and logs derived from the test tables.

Each view is one SQL text in the common subset of Spark SQL and ANSI SQL, so the Spark queries
and the check queries start from the same rows. Names in braces are tables or other views.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

NOW = "1995-06-30 00:00:00"
LOG_END = "2024-01-31 00:00:00"

VIEWS = {
    # One sighting of a posting per line item.
    "sightings": """
select l.l_orderkey as order_key, l.l_linenumber as line_number, l.l_partkey as part_key,
  l.l_suppkey as source_id, l.l_extendedprice as price,
  p.p_name as title, p.p_brand as company_name,
  case when cast(substr(p.p_brand, 7) as int) % 5 = 0
    then lower(replace(p.p_brand, '#', '')) || '.example.com' end as company_domain,
  r.r_name as city,
  case n.n_nationkey % 6 when 0 then 'IN' when 1 then 'US' when 2 then 'GB' when 3 then 'CA'
    when 4 then 'DE' end as country_code,
  case p.p_type when 'ECONOMY' then 'remote' when 'PROMO' then 'hybrid' when 'LARGE' then 'onsite'
    when 'SMALL' then 'remote' when 'STANDARD' then 'onsite' else 'unknown' end as work_mode,
  case p.p_type when 'ECONOMY' then 'global' when 'PROMO' then 'india' else 'unknown' end
    as remote_scope,
  case when p.p_size <= 3 then 'intern' when p.p_size <= 9 then 'junior'
    when p.p_size <= 18 then 'mid' when p.p_size <= 27 then 'senior' when p.p_size <= 32 then 'lead'
    when p.p_size <= 36 then 'staff' when p.p_size <= 39 then 'principal'
    when p.p_size <= 42 then 'director' when p.p_size <= 45 then 'exec' else 'unknown' end
    as seniority,
  p.p_name || ' team uses ' || case p.p_size % 8 when 0 then 'Python and AWS'
    when 1 then 'React, TypeScript' when 2 then 'Postgres, Docker and k8s' when 3 then 'c++ and gql'
    when 4 then 'Next.js, Tailwind CSS' when 5 then 'py, ts, psql' else 'what comes next' end
    as description_text,
  l.l_extendedprice as salary_min,
  case when l.l_linenumber % 3 = 0 then cast(null as double) else l.l_extendedprice * 2 end
    as salary_max,
  case n.n_regionkey when 0 then 'usd' when 1 then 'USD' when 2 then 'INR' when 3 then 'EUR' end
    as salary_currency,
  case l.l_linenumber % 4 when 0 then cast(null as string) when 1 then 'year' when 2 then 'month'
    else 'hour' end as salary_period,
  'https://s' || cast(l.l_suppkey as string) || '.example.com/jobs/' || cast(l.l_partkey as string)
    as source_url,
  cast(l.l_shipdate as timestamp) as seen_at
from {lineitem} l join {part} p on l.l_partkey = p.p_partkey
  join {supplier} s on l.l_suppkey = s.s_suppkey
  join {nation} n on s.s_nationkey = n.n_nationkey
  join {region} r on n.n_regionkey = r.r_regionkey
""",
    # One profile per customer.
    "profiles": """
select c_custkey as user_id,
  case c_mktsegment when 'BUILDING' then 'senior' when 'MACHINERY' then 'mid'
    when 'FURNITURE' then 'lead' when 'AUTOMOBILE' then 'junior' else 'unknown' end as seniority,
  case c_nationkey % 6 when 0 then 'IN' when 1 then 'us' when 2 then 'GB' when 3 then 'CA'
    when 4 then 'DE' end as country_code,
  split(case c_custkey % 4 when 0 then 'remote' when 1 then 'remote,hybrid' when 2 then 'onsite'
    else 'remote,hybrid,onsite' end, ',') as work_modes,
  case when c_acctbal >= 0 then c_acctbal * 12 end as min_salary,
  case c_nationkey % 3 when 0 then 'USD' when 1 then 'inr' else 'EUR' end as salary_currency,
  case c_custkey % 3 when 0 then 'year' when 1 then 'month' end as salary_period,
  split('brand-' || cast(1 + c_custkey % 25 as string) || ',other', ',') as blocked_companies,
  split('brand' || cast(5 * (1 + c_custkey % 5) as string) || '.example.com,brand-'
    || cast(1 + (c_custkey + 7) % 25 as string), ',') as preferred_companies,
  split(case c_mktsegment when 'BUILDING' then 'ring' when 'MACHINERY' then 'C++,next'
    when 'FURNITURE' then 'blue bolt, ' when 'AUTOMOBILE' then 'uses py' else 'gadget' end, ',')
    as excluded_keywords,
  c_custkey as vec_id
from {customer}
""",
    # One profile per market segment and nation, from all customers.
    "cohorts": """
select c_nationkey * 5 + case c_mktsegment when 'BUILDING' then 0 when 'MACHINERY' then 1
    when 'FURNITURE' then 2 when 'AUTOMOBILE' then 3 else 4 end as user_id,
  case c_mktsegment when 'BUILDING' then 'senior' when 'MACHINERY' then 'mid'
    when 'FURNITURE' then 'lead' when 'AUTOMOBILE' then 'junior' else 'unknown' end as seniority,
  case c_nationkey % 6 when 0 then 'IN' when 1 then 'us' when 2 then 'GB' when 3 then 'CA'
    when 4 then 'DE' end as country_code,
  split(case c_nationkey % 4 when 0 then 'remote' when 1 then 'remote,hybrid' when 2 then 'onsite'
    else 'remote,hybrid,onsite' end, ',') as work_modes,
  cast(max(c_acctbal) as double) * 3 as min_salary,
  case c_nationkey % 3 when 0 then 'USD' when 1 then 'INR' else 'EUR' end as salary_currency,
  cast(null as string) as salary_period,
  split('brand-' || cast(1 + c_nationkey % 25 as string), ',') as blocked_companies,
  split('brand-' || cast(1 + (c_nationkey + 7) % 25 as string) || ',brand-'
    || cast(1 + (c_nationkey + 11) % 25 as string), ',') as preferred_companies,
  split(case c_mktsegment when 'BUILDING' then 'ring' when 'MACHINERY' then 'C++,next'
    when 'FURNITURE' then 'blue bolt, ' when 'AUTOMOBILE' then 'uses py' else 'gadget' end, ',')
    as excluded_keywords,
  min(c_custkey) as vec_id
from {customer}
group by c_nationkey, c_mktsegment
""",
    # Known skills of a profile.
    "profile_skills": """
select c_custkey as user_id, 'python' as skill_id, 'expert' as level from {customer}
  where c_mktsegment in ('BUILDING', 'MACHINERY')
union all select c_custkey, 'react', 'familiar' from {customer}
  where c_mktsegment in ('BUILDING', 'FURNITURE')
union all select c_custkey, 'postgresql', cast(null as string) from {customer}
  where c_mktsegment in ('MACHINERY', 'AUTOMOBILE')
union all select c_custkey, 'aws', 'proficient' from {customer} where c_acctbal > 0
""",
    "cohort_skills": """
select user_id, 'python' as skill_id, 'expert' as level from {cohorts}
  where seniority in ('senior', 'mid')
union all select user_id, 'react', 'familiar' from {cohorts} where seniority in ('senior', 'lead')
union all select user_id, 'postgresql', cast(null as string) from {cohorts}
  where seniority in ('mid', 'junior')
union all select user_id, 'aws', 'proficient' from {cohorts} where country_code = 'IN'
""",
    # What a customer ordered: the pairs to be scored.
    "ordered": """
select o.o_custkey as user_id, l.l_orderkey as order_key, l.l_partkey as part_key,
  l.l_suppkey as source_id
from {lineitem} l join {orders} o on l.l_orderkey = o.o_orderkey
""",
    # The action log; k is the number inside props.
    "actions": """
select event_id, user_id,
  cast(replace(replace(replace(props, '"k": ', ''), chr(123), ''), chr(125), '') as bigint) as k,
  case event_type when 'view' then 'view' when 'click' then 'save' when 'error' then 'dismiss'
    when 'purchase' then 'apply' end as event,
  event_type, value, cast(ts as timestamp) as acted_at
from {events}
""",
    # Requests to move an application to a stage.
    "stage_requests": """
select event_id, user_id * 1000 + k % 5 as application_id, user_id, k,
  case event_type when 'signup' then 'saved' when 'view' then 'screening'
    when 'click' then 'interview' when 'purchase' then 'offer'
    else case when value < 20 then 'rejected' when value < 40 then 'withdrawn'
      when value < 70 then 'discovered' else 'applied' end end as to_stage, acted_at
from {actions}
""",
    # One saved search per customer, in the feed of its cohort.
    "searches": """
select c_custkey as search_id, c_nationkey * 5 + case c_mktsegment when 'BUILDING' then 0
    when 'MACHINERY' then 1 when 'FURNITURE' then 2 when 'AUTOMOBILE' then 3 else 4 end as user_id,
  case c_custkey % 3 when 0 then 'remote' when 1 then 'hybrid' end as work_mode,
  case c_custkey % 4 when 0 then 'IN' when 1 then 'US' end as country_code,
  case when c_acctbal > 5000 then c_acctbal * 10 end as min_salary
from {customer}
""",
    # Local digest hour and time zone per customer.
    "slot_users": """
select c_custkey as user_id, cast(8 + c_custkey % 12 as int) as send_hour,
  case c_nationkey % 4 when 0 then 'Asia/Kolkata' when 1 then 'America/New_York'
    when 2 then 'Europe/Berlin' end as time_zone
from {customer}
""",
    # Ingest runs: one per source and day, errors are failed records.
    "run_log": """
select user_id as source_id, cast(ts as date) as run_day, event_id, event_type, value,
  cast(ts as timestamp) as acted_at
from {events}
""",
    # Records and how they change: at version 1 a third is older and pays less, at 2 a fifth is on site.
    "record_versions": """
select 'part-' || cast(p_partkey as string) as job_id, p_partkey as part_key, v.version, p_name as title,
  p_brand as company_name, cast(null as string) as company_domain,
  case p_partkey % 6 when 0 then 'IN' when 1 then 'US' when 2 then 'GB' when 3 then 'CA' when 4 then 'DE' end
    as country_code,
  case when v.version = 2 then 'onsite' when p_type in ('ECONOMY', 'SMALL') then 'remote'
    when p_type = 'PROMO' then 'hybrid' else 'unknown' end as work_mode,
  case p_type when 'ECONOMY' then 'global' when 'PROMO' then 'india' else 'unknown' end as remote_scope,
  case when p_size <= 9 then 'junior' when p_size <= 18 then 'mid' when p_size <= 27 then 'senior'
    when p_size <= 36 then 'staff' else 'unknown' end as seniority,
  p_name || ' team uses ' || case p_size % 4 when 0 then 'Python and AWS' when 1 then 'React, TypeScript'
    when 2 then 'Postgres, Docker and k8s' else 'py, psql' end as description_text,
  cast(p_retailprice as double) as salary_min,
  cast(p_retailprice as double) * case when v.version = 1 then 2 else 60 end as salary_max,
  case p_partkey % 3 when 0 then 'USD' when 1 then 'INR' else 'EUR' end as salary_currency,
  'year' as salary_period,
  cast(case when v.version = 1 then '1995-05-01' else '1995-06-20' end as timestamp) as posted_at
from {part} join (select 0 as version union all select 1 union all select 2) v
  on v.version = 0 or (v.version = 1 and p_partkey % 3 = 0) or (v.version = 2 and p_partkey % 5 = 0)
""",
    # Salary text in six notations with the figures it must give.
    "salary_text": """
select o_orderkey as id,
  case o_orderkey % 6
    when 0 then '$' || cast(cast(floor(o_totalprice) as bigint) as string) || ' per year'
    when 1 then cast(cast(floor(o_totalprice / 1000) as bigint) as string) || 'L - '
      || cast(cast(floor(o_totalprice / 500) as bigint) as string) || 'L'
    when 2 then cast(cast(floor(o_totalprice / 1000) as bigint) as string) || '.5 LPA'
    when 3 then '£' || cast(cast(floor(o_totalprice / 100) as bigint) as string) || ' - £'
      || cast(cast(floor(o_totalprice / 50) as bigint) as string) || ' /month'
    when 4 then 'EUR ' || cast(cast(floor(o_totalprice / 1000) as bigint) as string)
      || ',000 per hour'
    else case when o_orderpriority = '5-LOW' then ' ' else 'negotiable' end end as raw,
  o_totalprice, o_orderpriority
from {orders}
""",
    # Place text in several forms.
    "place_text": """
select c_custkey as id,
  case c_custkey % 7
    when 0 then 'Remote (India)' when 1 then n_name || ', Germany'
    when 2 then n_name || ', ' || r_name || ', USA' when 3 then n_name
    when 4 then 'Remote – Anywhere' when 5 then n_name || ', ' || r_name else ' , uk' end as raw,
  c_custkey % 7 as form, n_name, r_name
from {customer} join {nation} on c_nationkey = n_nationkey
  join {region} on n_regionkey = r_regionkey
""",
    # One résumé per customer; what it says follows from the customer's number.
    "resumes": """
select c_custkey as doc_id,
  case c_custkey % 3 when 0 then 'Maria Lopez' when 1 then ' John Van Smith ' else 'papers of nobody' end || chr(10)
  || case when c_custkey % 5 <> 0 then 'Mail' || cast(c_custkey as string) || '@Example.com' || chr(10) else '' end
  || case when c_custkey % 4 <> 0 then '(415) 555-' || lpad(cast(c_custkey % 10000 as string), 4, '0') || chr(10) else '' end
  || case when c_custkey % 7 = 0 then '' when c_custkey % 7 < 3 then 'Location: London, UK' || chr(10)
    when c_custkey % 7 < 5 then 'Location: Bangalore, India' || chr(10)
    else 'Location: San Francisco, CA, USA' || chr(10) end
  || case when c_custkey % 2 = 0 then 'Expected salary: $' || cast(50 + c_custkey % 100 as string) || ',000 per year'
    || chr(10) else '' end
  || case c_custkey % 5 when 1 then 'Prefers remote' || chr(10) when 2 then 'Hybrid or on-site' || chr(10) else '' end
  || chr(10) || 'Summary' || chr(10) || 'Builds things that last and helps people' || chr(10)
  || 'EXPERIENCE:' || chr(10) || case c_custkey % 3 when 0 then 'Senior Software Engineer - Acme' || chr(10)
    when 1 then 'Data Analyst | Beta' || chr(10) || 'Lead Product Manager – Gamma' || chr(10) else '' end
  || cast(c_custkey % 12 as string) || ' years of experience in teams' || chr(10)
  || 'Education' || chr(10) || case when c_custkey % 3 = 0 then 'B.Tech in Computing 2014' || chr(10)
    || 'Master of Arts, 1999' else 'School of life' end || chr(10)
  || 'Skills' || chr(10) || case c_custkey % 4 when 0 then 'Python, SQL and Docker' when 1 then 'C++, C#, Go'
    when 2 then 'Node.js; React; CI/CD' else 'Cooking' end as text
from {customer}
""",
    # Document parts seen as postings.
    "postings": """
select doc_id, source, lang, text, n_chars,
  case lang when 'en' then 'Senior Engineer, London, UK' when 'de' then 'Praktikant / intern'
    when 'fr' then 'Chief of staff' else 'Data analyst' end as title,
  case lang when 'en' then 'London, UK' when 'de' then 'Remote – India' when 'fr' then 'Paris'
    else 'Remote (Worldwide)' end as location_raw,
  case lang when 'en' then '£85,000 - £110,000 per year' when 'de' then '12 LPA'
    when 'fr' then '€4,500/month' else '' end as salary_raw
from {documents}
""",
}

_NAME = re.compile(r"\{([a-z_]\w*)\}")


# Tables whose rows take long to work on: long texts, or many expressions per row.
HEAVY = ("lineitem", "documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in HEAVY else df


def spread(df: DataFrame) -> DataFrame:
    """Uses all cores when the files give fewer splits than there are cores.

    A table with enough splits, as any large one has, is left as it is and is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or one of the views above as a DataFrame."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    return sql(spark, sf_dir, VIEWS[name])


def sql(
    spark: SparkSession, sf_dir: str, text: str, given: dict[str, DataFrame] | None = None
) -> DataFrame:
    """Run SQL whose braces name tables or views, or frames that are given in their place."""
    given = given or {}
    names = sorted(set(_NAME.findall(text)))
    inputs = {n: given[n] if n in given else view(spark, sf_dir, n) for n in names}
    return spark.sql(text, **inputs)


def check_sql(text: str) -> str:
    """The same kind of text as one statement for the check engine, views as CTEs."""
    needed: list[str] = []

    def visit(sql_text: str) -> None:
        for name in _NAME.findall(sql_text):
            if name in VIEWS and name not in needed:
                visit(VIEWS[name])
                needed.append(name)
            elif name in CHECKS and name not in needed:
                visit(CHECKS[name])
                needed.append(name)

    visit(text)
    body = _NAME.sub(r"\1", text)
    if not needed:
        return body
    ctes = ",\n".join(
        f"{n} as ({_NAME.sub(r'\1', VIEWS.get(n) or CHECKS[n])})" for n in needed
    )
    return f"with recursive {ctes}\n{body}"


# Views of the check engine only: the operators under test, written again in plain SQL.
CHECKS: dict[str, str] = {}
