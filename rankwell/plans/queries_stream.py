"""Queries: landed payloads, files, and streams over the event log."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwell.operators import dedupe
from rankwell.plans.adapters import CHECKS, NOW
from rankwell.plans.queries_ingest import stamp
from rankwell.plans.registry import Inputs, query
from rankwell.session import fresh_dir
from rankwell.sources import keyed
from rankwell.sources import payloads as pay
from rankwell.sources.tables import read_applications_csv
from rankwell.streaming import ingest

KINDS = list(pay.PROVIDERS)


# --- payloads ------------------------------------------------------------------------------------------


def _payload_text(t: Inputs) -> DataFrame:
    """Every document as a payload in the shape of one provider, chosen by its source."""
    n = F.substring("source", 4, 9).cast("int") % len(KINDS)
    ident, lang, text = F.col("doc_id").cast("string"), F.col("lang"), F.col("text")
    title = F.concat(lang, F.lit(" Engineer "), ident)
    url = F.concat(F.lit("https://jobs.example.com/"), ident)
    day = F.lit("2024-01-15T10:00:00Z")
    safe = F.when(lang != "es", url)

    def s(**fields):
        return F.struct(*[c.alias(name) for name, c in fields.items()])

    def one(item):
        return F.array(item)

    shapes = {
        "api_greenhouse": s(
            company=s(name=F.concat(F.lit("Firm "), "source")),
            jobs=one(s(id=F.col("doc_id"), title=title, absolute_url=url, content=text, updated_at=day)),
        ),
        "api_lever": one(
            s(id=ident, text=title, hostedUrl=url, createdAt=F.lit(1705312800000), descriptionPlain=text,
              categories=s(location=F.lit("London, UK")))
        ),
        "api_ashby": s(
            jobs=one(s(id=ident, title=title, jobUrl=url, publishedAt=day, descriptionPlain=text,
                       isRemote=lang == "en", location=s(location=F.lit("Remote (India)")),
                       compensation=s(compensationTierSummary=F.lit("$120,000 - $160,000"))))
        ),
        "api_remotive": s(
            jobs=one(s(id=F.col("doc_id"), url=url, title=title, company_name=F.col("source"),
                       candidate_required_location=F.lit("Worldwide"), publication_date=F.lit("2024-01-15"),
                       description=text, tags=F.array(lang)))
        ),
        "api_arbeitnow": s(
            data=one(s(slug=ident, company_name=F.col("source"), title=title, description=text,
                       remote=lang == "en", url=url, location=F.lit("Berlin, Germany"),
                       created_at=F.when(lang == "en", F.lit(1705312800)).otherwise(F.lit(1705312800000))))
        ),
        "api_usajobs": s(
            SearchResult=s(SearchResultItems=one(s(
                MatchedObjectId=ident,
                MatchedObjectDescriptor=s(
                    PositionTitle=title, PositionLocationDisplay=F.array(F.lit("Austin, TX"), F.lit("Remote")),
                    PositionRemuneration=one(s(Value=F.lit("$45.00 Per Hour"), RateIntervalCode=F.lit("Year"))),
                    DatePosted=day),
            )))
        ),
        "api_adzuna": s(
            results=one(s(id=ident, redirect_url=safe, title=title, description=text, created=day,
                          salary_min=F.lit(85000.0), salary_max=F.lit(110000.0), salary_currency=F.lit("gbp"),
                          company=s(display_name=F.col("source")), location=s(display_name=F.lit("London"))))
        ),
        "firecrawl_scrape": s(
            success=lang != "de",
            data=s(json=s(jobs=one(s(title=title, companyName=F.col("source"), sourceUrl=safe,
                                     workMode=F.lit("hybrid"), descriptionHtml=text)))),
        ),
        "firecrawl_search": s(
            success=F.lit(True),
            data=one(s(url=F.when(lang == "fr", F.regexp_replace(url, "https", "http")).otherwise(url),
                       title=title, description=text)),
        ),
    }
    value = reduce(
        lambda acc, k: F.when(n == k, F.to_json(shapes[KINDS[k]])).otherwise(acc),
        range(len(KINDS)), F.lit(None).cast("string"),
    )
    kind = F.get(F.array(*[F.lit(k) for k in KINDS]), n)
    return t.documents.select(value.alias("value"), kind.alias("kind"), F.col("source").alias("token"))


def landed(t: Inputs) -> str:
    path = fresh_dir(t.spark, "payloads")
    _payload_text(t).write.partitionBy("kind", "token").text(path)
    return path


CHECKS["payload_rows"] = """
select *, cast(substr(source, 4) as int) % 9 as n, doc_id::varchar as ident,
  case when cast(substr(source, 4) as int) % 9 = 5 then 'https://www.usajobs.gov/job/'
    else 'https://jobs.example.com/' end || doc_id::varchar as url, lang || ' Engineer ' || doc_id::varchar as title
from {documents}
"""
CHECKS["raw_rows"] = """
select case n when 0 then 'api_greenhouse' when 1 then 'api_lever' when 2 then 'api_ashby'
    when 3 then 'api_remotive' when 4 then 'api_arbeitnow' when 5 then 'api_usajobs'
    when 6 then 'api_adzuna' when 7 then 'firecrawl_scrape' else 'firecrawl_search' end as source_kind,
  case when n in (7, 8) then url else ident end as external_id, url as source_url, title,
  case n when 0 then 'Firm ' || source when 5 then 'USAJOBS' else source end as company_name,
  case when n in (1, 2, 8) then len(text) end::double as text_length,
  case when n in (0, 3, 4, 6, 7) then len(text) end::double as html_length,
  case n when 1 then 'London, UK' when 2 then 'Remote (India)' when 3 then 'Worldwide'
    when 4 then 'Berlin, Germany' when 5 then 'Austin, TX; Remote' when 6 then 'London' end as location_raw,
  case when n = 7 then 'hybrid' when n in (2, 4) and lang = 'en' then 'remote' end as work_mode,
  case n when 2 then '$120,000 - $160,000' when 5 then '$45.00 Per Hour' end as salary_raw,
  case n when 6 then 'GBP' end as salary_currency,
  case when n in (0, 1, 2, 4, 5, 6) then '2024-01-15 10:00:00' when n = 3 then '2024-01-15 00:00:00' end
    as posted_at, lang, n
from {payload_rows}
where not (n = 6 and lang = 'es') and not (n = 7 and lang in ('es', 'de')) and not (n = 8 and lang = 'fr')
"""


@query("select * exclude (lang, n) from {raw_rows}")
def payload_scan(t):
    """Documents landed in nine provider shapes and read back as one set of raw records."""
    raw = pay.scan(pay.read_payloads(t.spark, landed(t)))
    return raw.select(
        "source_kind", "external_id", "source_url", "title", "company_name",
        F.length("description_text").cast("double").alias("text_length"),
        F.length("description_html").cast("double").alias("html_length"),
        "location_raw", "work_mode", "salary_raw", "salary_currency", stamp("posted_at"),
    )


@query("select source_kind, count(*) as records, count(distinct company_name) as companies from {raw_rows} group by 1")
def union_sources(t):
    raw = pay.scan(pay.read_payloads(t.spark, landed(t)))
    return raw.groupBy("source_kind").agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct("company_name").alias("companies")
    )


@query("""
select 'firecrawl_scrape' as kind, case when lang = 'de' then 'upstream_failure' else 'bad_item' end
  as refused, count(*) as payloads
from {payload_rows} where n = 7 and lang in ('de', 'es') group by 1, 2
""")
def payload_quarantine(t):
    """Refused payloads and elements by reason."""
    bad = pay.quarantine(pay.read_payloads(t.spark, landed(t)))
    return bad.groupBy("kind", "refused").agg(F.count(F.lit(1)).alias("payloads"))


@query("""
select source_url, title_norm, city, region, country_code, remote_scope, work_mode, seniority,
  salary_min, salary_currency, salary_period,
  sha256(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) || '|'
    || trim(regexp_replace(lower(company_name), '[^a-z0-9]+', ' ', 'g')) || '|'
    || lower(coalesce(city, '')) || '|' || work_mode) as dedupe_hash
from (select source_url, title, company_name, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') as title_norm,
    case n when 1 then 'London' when 3 then 'Worldwide' when 4 then 'Berlin' when 5 then 'Austin'
      when 6 then 'London' end as city,
    case n when 5 then 'TX; Remote' end as region,
    case n when 1 then 'GB' when 2 then 'IN' when 4 then 'DE' end as country_code,
    case n when 2 then 'india' when 3 then 'global' else 'unknown' end as remote_scope,
    coalesce(work_mode, 'unknown') as work_mode, 'unknown' as seniority,
    case n when 2 then 120000.0 when 5 then 45.0 end::double as salary_min,
    case when n in (2, 5) then 'USD' end as salary_currency,
    case n when 2 then 'year' when 5 then 'hour' end as salary_period
  from {raw_rows})
""")
def normalise_records(t):
    """Raw records of all providers to canonical ones with their hash."""
    rows = pay.normalise(pay.scan(pay.read_payloads(t.spark, landed(t))))
    return rows.select(
        "source_url", "title_norm", "city", "region", "country_code", "remote_scope", "work_mode",
        "seniority", "salary_min", "salary_currency", "salary_period", "dedupe_hash",
    )


@query("""
select 'https://orders.example.com/' || o_orderkey::varchar as url,
  case when o_orderpriority = '1-URGENT' then 'company_missing' when o_orderstatus = 'P' then 'unknown_stage'
    else 'ok' end as outcome,
  case when o_orderpriority <> '1-URGENT' and o_orderstatus <> 'P' then case o_orderstatus when 'F'
    then 'applied' else 'screening' end end as stage
from {orders}
""")
def csv_import(t):
    """Orders written as an application spreadsheet and imported: good rows and reasons."""
    path = fresh_dir(t.spark, "csv")
    t.orders.select(
        F.when(F.col("o_orderpriority") != "1-URGENT", F.concat(F.lit('Firm, "'), "o_custkey", F.lit('"'))).alias("company"),
        F.col("o_orderpriority").alias("title"),
        F.concat(F.lit("https://orders.example.com/"), "o_orderkey").alias("url"),
        F.when(F.col("o_orderstatus") == "F", "Applied").when(F.col("o_orderstatus") == "O", "screening")
        .otherwise("bogus").alias("stage"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
    ).write.option("header", True).option("escape", '"').csv(path)
    good, bad = read_applications_csv(t.spark, path)
    return good.select(
        F.col("job_snapshot.source_url").alias("url"), F.lit("ok").alias("outcome"), "stage"
    ).unionByName(
        bad.select("url", F.col("reason").alias("outcome"), F.lit(None).cast("string").alias("stage"))
    )


# --- streams ----------------------------------------------------------------------------------------------


def event_stream(t: Inputs, files: int = 4) -> DataFrame:
    """The action log as a stream of a few files, one per batch."""
    path = fresh_dir(t.spark, "events")
    log = t.actions.withColumn("is_error", F.col("event_type") == "error")
    log.repartitionByRange(files, "event_id").write.parquet(path)
    return (
        t.spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(path)
    )


def feed_in_turn(t: Inputs, rows: DataFrame, part: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Lands the rows of each ``part`` (0, 1, ...) after the other and works each off as one batch."""
    out = fresh_dir(t.spark, "landed")
    kind = rows.drop(part).schema
    for k in range(rows.agg(F.max(part)).first()[0] + 1):
        rows.where(F.col(part) == k).drop(part).write.mode("append").parquet(f"{out}/rows")
        stream = t.spark.readStream.schema(kind).parquet(f"{out}/rows")
        ingest.start(stream, handle, f"{out}/checkpoint", "append").awaitTermination()


def late_log(t: Inputs) -> DataFrame:
    """The action log in four parts: three of ten days each, then every fiftieth row, up to a month late."""
    day = F.datediff("acted_at", F.lit("2024-01-01"))
    part = F.when(F.col("event_id") % 50 == 0, 3).otherwise(F.greatest(F.lit(0), F.least(F.lit(2), F.floor(day / 10))))
    return t.actions.withColumn("part", part.cast("int"))


def run_updates(t: Inputs, stream: DataFrame, keys: list[str]) -> DataFrame:
    out = fresh_dir(t.spark, "stream")
    done = ingest.start(stream, ingest.keep_updates(f"{out}/rows"), f"{out}/checkpoint")
    done.awaitTermination()
    return ingest.latest_updates(t.spark, f"{out}/rows", keys)


@query("""
select user_id * 1000 + k as k, count(*) as sighting_count, strftime(min(acted_at), '%Y-%m-%d %H:%M:%S') as first_seen_at,
  strftime(max(acted_at), '%Y-%m-%d %H:%M:%S') as last_seen_at from {actions} group by 1
""")
def stream_sightings(t):
    """Sighting state that ends after five days without a sighting; late rows are added all the same."""
    out = fresh_dir(t.spark, "sightings")
    opened, closed = f"{out}/open", f"{out}/closed"
    log = late_log(t).withColumn("k", F.col("user_id") * 1000 + F.col("k"))
    feed_in_turn(t, log, "part", ingest.merge_open_sightings(opened, closed, "k", "acted_at", "5 days"))
    return ingest.all_sightings(t.spark, opened, closed, "k").select(
        "k", "sighting_count", stamp("first_seen_at"), stamp("last_seen_at")
    )


@query("""
select k, count(*) as sighting_count, strftime(min(acted_at), '%Y-%m-%d %H:%M:%S') as first_seen_at,
  strftime(max(acted_at), '%Y-%m-%d %H:%M:%S') as last_seen_at from {actions} group by k
""")
def stream_first_seen(t):
    """Batches merged into the record table: the last holds only late rows, and each is sent twice."""
    out = fresh_dir(t.spark, "records")
    merge = ingest.merge_sightings(f"{out}/table", "dedupe_hash", "acted_at", [], ["event_id"])

    def twice(batch: DataFrame, batch_id: int) -> None:
        merge(batch, batch_id)
        merge(batch, batch_id)

    feed_in_turn(t, late_log(t).withColumn("dedupe_hash", F.col("k")), "part", twice)
    return keyed.read_keyed(t.spark, f"{out}/table").select(
        F.col("dedupe_hash").alias("k"), "sighting_count", stamp("first_seen_at"), stamp("last_seen_at")
    )


@query("""
select strftime(date_trunc('hour', acted_at), '%Y-%m-%d %H:%M:%S') as hour, user_id, count(*) as found,
  count(*) filter (where event_type = 'error') as failed from {actions} group by 1, 2
""")
def stream_window_counts(t):
    """Hourly counts per source; the delay covers the whole log, so no row is late."""
    windows = ingest.run_windows(event_stream(t), "acted_at", "user_id", "60 days")
    return run_updates(t, windows, ["hour", "user_id"]).select(
        stamp("hour"), "user_id", "found", "failed"
    )


@query("""
select user_id, count(*) as sessions, sum(n)::bigint as actions from (select user_id, s, count(*) as n
  from (select user_id, acted_at, sum(case when prev is null or epoch_us(acted_at) - epoch_us(prev) >= 1800000000
      then 1 else 0 end) over (partition by user_id order by acted_at, event_id) as s
    from (select *, lag(acted_at) over (partition by user_id order by acted_at, event_id) as prev
      from {actions})) group by 1, 2) group by 1
""")
def stream_sessions(t):
    """Sessions per user, kept by the stream."""
    out = fresh_dir(t.spark, "sessions")
    rows = ingest.user_sessions(event_stream(t), "acted_at", delay="60 days")

    def replace(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows")

    ingest.start(rows, replace, f"{out}/checkpoint", "complete").awaitTermination()
    return t.spark.read.parquet(f"{out}/rows").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("actions").alias("actions")
    )


@query("""
select k as event_k, count(*) as n from (select distinct k, event_type from {actions}) group by k
""")
def stream_dedupe(t):
    """Each (key, type) once, by the stream's own duplicate removal."""
    out = fresh_dir(t.spark, "unique")
    keyed = event_stream(t).withColumn("dedupe_hash", F.concat_ws("|", "k", "event_type"))
    once = ingest.first_sightings(keyed, "acted_at", "60 days")
    ingest.start(once, ingest.keep_updates(f"{out}/rows"), f"{out}/checkpoint", "append").awaitTermination()
    rows = t.spark.read.parquet(f"{out}/rows")
    return rows.groupBy(F.col("k").alias("event_k")).agg(F.count(F.lit(1)).alias("n"))


@query("select source_url, title, dedupe_copies from (select source_url, title, 1::bigint as dedupe_copies from {raw_rows})")
def stream_payloads(t):
    """Landed payloads through the streaming form of scan, normalise and hash."""
    out = fresh_dir(t.spark, "canonical")
    stream = ingest.payload_stream(t.spark, landed(t), 50)
    table = ingest.canonical_stream(stream).withColumn("seen_at", F.coalesce("posted_at", F.lit("2024-01-01").cast("timestamp")))
    ingest.start(table, ingest.keep_updates(f"{out}/rows"), f"{out}/checkpoint", "append").awaitTermination()
    rows = dedupe.collapse(
        t.spark.read.parquet(f"{out}/rows"), ["dedupe_hash"], ["source_url", "title"], "seen_at", ["source_url"]
    )
    return rows.select("source_url", "title", F.col("sighting_count").alias("dedupe_copies"))


@query("""
select 'firecrawl_scrape' as kind, case when lang = 'de' then 'upstream_failure' else 'bad_item' end
  as refused, count(*) as payloads
from {payload_rows} where n = 7 and lang in ('de', 'es') group by 1, 2
""")
def stream_quarantine(t):
    """Payloads and elements that the streaming scan leaves out, kept with their reason."""
    out = fresh_dir(t.spark, "refused")
    bad = ingest.refused_stream(ingest.payload_stream(t.spark, landed(t), 50))
    ingest.start(bad, ingest.keep_updates(f"{out}/rows"), f"{out}/checkpoint", "append").awaitTermination()
    rows = t.spark.read.parquet(f"{out}/rows")
    return rows.groupBy("kind", "refused").agg(F.count(F.lit(1)).alias("payloads"))


CHECKS["version_pairs"] = """
select user_id, split_part(job_id, '/', 1) as job_id, cast(split_part(job_id, '/', 2) as int) as version, final_score
from {vers_scores}
"""


@query("""
select r.job_id, r.user_id, coalesce(s.final_score, 0.0) as final_score
from (select distinct user_id, job_id from {version_pairs} where final_score >= 60) r
join (select job_id, max(version) as version from {record_versions} group by 1) l on l.job_id = r.job_id
left join {version_pairs} s on s.user_id = r.user_id and s.job_id = r.job_id and s.version = l.version
""")
def stream_rescore(t):
    """Records that change from batch to batch, scored against every customer.

    A pair enters the table when it reaches the floor; from then on it follows its record, so scores
    fall and gates close.
    """
    out = fresh_dir(t.spark, "scores")
    vectors = t.embeddings.select("vec_id", "embedding")
    profiles = t.profiles.join(vectors, "vec_id", "left")

    def jobs(batch: DataFrame) -> DataFrame:
        return batch.join(vectors.withColumnRenamed("vec_id", "part_key"), "part_key", "left")

    rescore = ingest.rescore_changes(f"{out}/table", jobs, profiles, NOW, profile_skills=t.profile_skills)
    feed_in_turn(t, t.record_versions, "version", rescore)
    return keyed.read_keyed(t.spark, f"{out}/table").select("job_id", "user_id", "final_score")
