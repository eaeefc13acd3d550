"""Provider payloads, landed as JSON text, to raw records.

A payload is one text value (a line, or a whole file) with the kind of its provider and the
token it was asked for (a board, an organisation). Each provider has a declared schema; unknown
keys drop, and a payload that breaks the contract goes to quarantine as a whole. Scraped pages
are the exception: their elements are checked one by one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwell.constants import EMPLOYMENT_TYPES, SALARY_PERIODS, SENIORITIES, WORK_MODES
from rankwell.functions.company import dedupe_hash, hash_parts
from rankwell.functions.html import sanitise_html
from rankwell.functions.parse import (
    currency_code,
    date_text,
    epoch_any,
    epoch_millis,
    parse_location,
    parse_salary,
    remote_flag,
    remote_scope,
    seniority_of,
)
from rankwell.functions.skills import skill_tags
from rankwell.functions.text import ascii_norm, one_of
from rankwell.functions.urls import is_safe_url, is_url
from rankwell.schemas import PAYLOAD_SCHEMA, RAW_TYPES


@dataclass(frozen=True)
class Provider:
    """How one kind of payload becomes records.

    ``schema`` parses the payload, ``items`` is the array of postings in it (``p`` is the parsed
    payload), ``needed`` lists what every posting must have, ``urls`` which of it must be a URL,
    ``fields`` maps a posting (``x``) to raw columns.
    """

    schema: str
    items: str
    needed: tuple[str, ...]
    urls: tuple[str, ...]
    fields: Callable[[Column, Column], dict[str, Column]]
    keep: Callable[[Column], Column] | None = None
    element: str | None = None
    optional: bool = False
    says_success: bool = False  # the payload must say that it succeeded


def _company(default: Column) -> Column:
    """Configured company name, else the provider's."""
    return F.coalesce("company_override", default)


def _greenhouse(x: Column, p: Column) -> dict[str, Column]:
    return {
        "external_id": x["id"],
        "source_url": x["absolute_url"],
        "apply_url": x["absolute_url"],
        "company_name": _company(F.coalesce(p["company"]["name"], "token")),
        "title": x["title"],
        "description_html": x["content"],
        "posted_at": date_text(x["updated_at"]),
    }


def _lever(x: Column, p: Column) -> dict[str, Column]:
    return {
        "external_id": x["id"],
        "source_url": x["hostedUrl"],
        "apply_url": F.coalesce(x["applyUrl"], x["hostedUrl"]),
        "company_name": _company(F.col("token")),
        "title": x["text"],
        "description_text": x["descriptionPlain"],
        "description_html": x["descriptionHtml"],
        "location_raw": x["categories"]["location"],
        "posted_at": epoch_millis(x["createdAt"]),
    }


def _ashby(x: Column, p: Column) -> dict[str, Column]:
    return {
        "external_id": x["id"],
        "source_url": x["jobUrl"],
        "apply_url": F.coalesce(x["applyUrl"], x["jobUrl"]),
        "company_name": _company(F.col("token")),
        "title": x["title"],
        "description_text": x["descriptionPlain"],
        "description_html": x["descriptionHtml"],
        "location_raw": x["location"]["location"],
        "work_mode": remote_flag(x["isRemote"]),
        "salary_raw": x["compensation"]["compensationTierSummary"],
        "posted_at": date_text(x["publishedAt"]),
    }


def _remotive(x: Column, p: Column) -> dict[str, Column]:
    return {
        "external_id": x["id"],
        "source_url": x["url"],
        "apply_url": x["url"],
        "company_name": x["company_name"],
        "title": x["title"],
        "description_html": x["description"],
        "location_raw": x["candidate_required_location"],
        "skills": x["tags"],
        "posted_at": date_text(x["publication_date"]),
    }


def _arbeitnow(x: Column, p: Column) -> dict[str, Column]:
    return {
        "external_id": x["slug"],
        "source_url": x["url"],
        "apply_url": x["url"],
        "company_name": x["company_name"],
        "title": x["title"],
        "description_html": x["description"],
        "location_raw": x["location"],
        "work_mode": remote_flag(F.coalesce(x["remote"], x["is_remote"])),
        "skills": x["tags"],
        "posted_at": epoch_any(x["created_at"]),
    }


def _usajobs(x: Column, p: Column) -> dict[str, Column]:
    told = x["MatchedObjectDescriptor"]
    pay = F.get(told["PositionRemuneration"], 0)
    url = F.concat(F.lit("https://www.usajobs.gov/job/"), x["MatchedObjectId"])
    return {
        "external_id": x["MatchedObjectId"],
        "source_url": url,
        "apply_url": url,
        "company_name": _company(F.coalesce(told["DepartmentName"], F.lit("USAJOBS"))),
        "title": F.coalesce(told["PositionTitle"], F.lit("")),
        "location_raw": F.array_join(told["PositionLocationDisplay"], "; "),
        "salary_raw": pay["Value"],
        "salary_period": F.when(pay["RateIntervalCode"] == "Year", "year"),
        "posted_at": date_text(told["DatePosted"]),
    }


def _adzuna(x: Column, p: Column) -> dict[str, Column]:
    return {
        "external_id": x["id"],
        "source_url": x["redirect_url"],
        "apply_url": x["redirect_url"],
        "company_name": F.coalesce(x["company"]["display_name"], F.lit("")),
        "title": x["title"],
        "description_html": x["description"],
        "location_raw": x["location"]["display_name"],
        "salary_raw": x["salary_label"],
        "salary_min": x["salary_min"],
        "salary_max": x["salary_max"],
        "salary_currency": currency_code(x["salary_currency"]),
        "posted_at": date_text(x["created"]),
    }


def _scrape(x: Column, p: Column) -> dict[str, Column]:
    return {
        "external_id": x["sourceUrl"],
        "source_url": x["sourceUrl"],
        "apply_url": F.coalesce(x["applyUrl"], x["sourceUrl"]),
        "company_name": x["companyName"],
        "title": x["title"],
        "description_html": x["descriptionHtml"],
        "location_raw": x["location"],
        "work_mode": x["workMode"],
        "salary_raw": x["salaryRaw"],
        "posted_at": date_text(x["postedAt"]),
    }


def _search(x: Column, p: Column) -> dict[str, Column]:
    return {
        "external_id": x["url"],
        "source_url": x["url"],
        "apply_url": x["url"],
        "company_name": _company(F.col("token")),
        "title": F.coalesce(x["title"], x["url"]),
        "description_text": x["description"],
    }


# Field names below are the providers' own.
PROVIDERS: dict[str, Provider] = {
    "api_greenhouse": Provider(
        "struct<company:struct<name:string>,jobs:array<struct<id:string,title:string,"
        "absolute_url:string,content:string,updated_at:string>>>",
        "p.jobs", ("id", "title", "absolute_url"), ("absolute_url",), _greenhouse,
    ),
    "api_lever": Provider(
        "array<struct<id:string,text:string,hostedUrl:string,applyUrl:string,createdAt:bigint,"
        "descriptionPlain:string,descriptionHtml:string,categories:struct<location:string,"
        "commitment:string,team:string>>>",
        "p", ("id", "text", "hostedUrl"), ("hostedUrl", "applyUrl"), _lever,
    ),
    "api_ashby": Provider(
        "struct<jobs:array<struct<id:string,title:string,jobUrl:string,applyUrl:string,"
        "publishedAt:string,descriptionPlain:string,descriptionHtml:string,isRemote:boolean,"
        "employmentType:string,location:struct<location:string>,"
        "compensation:struct<compensationTierSummary:string>>>>",
        "p.jobs", ("id", "title", "jobUrl"), ("jobUrl", "applyUrl"), _ashby,
    ),
    "api_remotive": Provider(
        "struct<jobs:array<struct<id:string,url:string,title:string,company_name:string,"
        "candidate_required_location:string,publication_date:string,description:string,"
        "category:string,tags:array<string>>>>",
        "p.jobs", ("id", "url", "title", "company_name"), ("url",), _remotive, optional=True,
    ),
    "api_arbeitnow": Provider(
        "struct<data:array<struct<slug:string,company_name:string,title:string,"
        "description:string,remote:boolean,is_remote:boolean,url:string,location:string,"
        "tags:array<string>,job_types:array<string>,created_at:bigint>>>",
        "p.data", ("slug", "company_name", "title", "url"), ("url",), _arbeitnow, optional=True,
    ),
    "api_usajobs": Provider(
        "struct<SearchResult:struct<SearchResultItems:array<struct<MatchedObjectId:string,"
        "MatchedObjectDescriptor:struct<PositionTitle:string,"
        "PositionLocationDisplay:array<string>,PositionRemuneration:array<struct<Value:string,"
        "RateIntervalCode:string>>,DatePosted:string,DepartmentName:string,"
        "PositionStartDate:string>>>>>",
        "p.SearchResult.SearchResultItems", ("MatchedObjectId", "MatchedObjectDescriptor"), (),
        _usajobs, optional=True,
    ),
    "api_adzuna": Provider(
        "struct<results:array<struct<id:string,redirect_url:string,title:string,"
        "display_title:string,description:string,created:string,salary_min:double,"
        "salary_max:double,salary_currency:string,salary_label:string,"
        "company:struct<display_name:string>,location:struct<display_name:string,"
        "country:string>>>>",
        "p.results", ("id", "title"), ("redirect_url",), _adzuna,
        keep=lambda x: x["redirect_url"].isNotNull() & (x["redirect_url"] != ""), optional=True,
    ),
    "firecrawl_scrape": Provider(
        "struct<success:boolean,data:struct<json:struct<jobs:array<string>>>>",
        "p.data.json.jobs", ("title", "companyName", "sourceUrl"), ("sourceUrl", "applyUrl"), _scrape,
        element="struct<title:string,companyName:string,location:string,workMode:string,"
        "salaryRaw:string,postedAt:string,sourceUrl:string,applyUrl:string,descriptionHtml:string>",
        optional=True, says_success=True,
    ),
    "firecrawl_search": Provider(
        "struct<success:boolean,data:array<struct<url:string,title:string,description:string>>>",
        "p.data", ("url",), ("url",), _search, keep=lambda x: is_safe_url(x["url"]), optional=True,
    ),
}
MAP_SCHEMA = "struct<success:boolean,links:array<string>>"


def read_payloads(spark: SparkSession, base: str, whole_files: bool = False) -> DataFrame:
    """Landed payload text below ``base/kind=…/token=…``; one payload per line or per file."""
    return (
        spark.read.schema(PAYLOAD_SCHEMA)
        .option("basePath", base)
        .text(base, wholetext=whole_files)
    )


def _is_valid(x: Column, spec: Provider) -> Column:
    ok = F.lit(True)
    for name in spec.needed:
        ok = ok & x[name].isNotNull()
    for name in spec.urls:
        ok = ok & (x[name].isNull() | is_url(x[name]))
    return ok


def _parsed(payloads: DataFrame, kind: str) -> DataFrame:
    """Payloads of one kind with their postings and the reason why they are refused, if any."""
    spec = PROVIDERS[kind]
    rows = payloads.where(F.col("kind") == kind)
    if "company_override" not in rows.columns:
        rows = rows.withColumn("company_override", F.lit(None).cast("string"))
    rows = rows.withColumn("p", F.from_json("value", spec.schema))
    items = F.col(spec.items)
    first = "[" if spec.schema.startswith("array") else "{"
    broken = F.try_parse_json("value").isNull() | ~F.ltrim("value").startswith(first)
    refused = F.when(F.coalesce(broken, F.lit(True)), "not_json")
    if not spec.optional:
        refused = refused.when(items.isNull(), "no_items")
    if "success" in spec.schema:
        refused = refused.when(~F.coalesce("p.success", F.lit(not spec.says_success)), "upstream_failure")
    if spec.element is None:
        refused = refused.when(~F.forall(items, lambda x: _is_valid(x, spec)), "bad_item")
    return rows.withColumn("items", items).withColumn("refused", refused)


def scan_kind(payloads: DataFrame, kind: str) -> DataFrame:
    """Raw records of one provider."""
    spec = PROVIDERS[kind]
    good = _parsed(payloads, kind).where(F.col("refused").isNull())
    rows = good.select("kind", "token", "company_override", "p", F.explode("items").alias("x"))
    if spec.element is not None:
        rows = rows.withColumn("raw", F.col("x")).withColumn("x", F.from_json("x", spec.element))
        rows = rows.where(_is_valid(F.col("x"), spec) & F.coalesce(
            F.col("x.workMode").isin(WORK_MODES) | F.col("x.workMode").isNull(), F.lit(False)
        ))
    else:
        rows = rows.withColumn("raw", F.to_json("x"))
    if spec.keep is not None:
        rows = rows.where(spec.keep(F.col("x")))
    mapped = {**spec.fields(F.col("x"), F.col("p")), "raw": F.col("raw")}
    columns = [
        mapped.get(name, F.lit(None)).cast(kind_).alias(name) for name, kind_ in RAW_TYPES.items()
    ]
    out = rows.select(F.col("kind").alias("source_kind"), *columns)
    empty = F.array().cast("array<string>")
    return out.withColumn("skills", F.coalesce("skills", empty))


def scan(payloads: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Raw records of all providers as one set."""
    return reduce(
        DataFrame.unionByName, [scan_kind(payloads, k) for k in (kinds or list(PROVIDERS))]
    )


def quarantine(payloads: DataFrame) -> DataFrame:
    """Refused payloads with their reason, and refused elements of scraped pages."""
    refused = [
        _parsed(payloads, k).where(F.col("refused").isNotNull()).select(
            "kind", "token", "refused", "value"
        )
        for k in PROVIDERS
    ]
    spec = PROVIDERS["firecrawl_scrape"]
    elements = (
        _parsed(payloads, "firecrawl_scrape")
        .where(F.col("refused").isNull())
        .select("kind", "token", F.explode("items").alias("value"))
        .withColumn("x", F.from_json("value", spec.element))
    )
    known = F.col("x.workMode").isNull() | F.col("x.workMode").isin(WORK_MODES)
    ok = F.coalesce(_is_valid(F.col("x"), spec) & known, F.lit(False))
    bad = elements.where(~ok).select("kind", "token", F.lit("bad_item").alias("refused"), "value")
    return reduce(DataFrame.unionByName, [*refused, bad])


def site_links(payloads: DataFrame) -> DataFrame:
    """Safe links of site-map payloads."""
    parsed = payloads.where(F.col("kind") == "firecrawl_map").withColumn(
        "p", F.from_json("value", MAP_SCHEMA)
    )
    links = parsed.select("token", F.explode("p.links").alias("link"))
    return links.where(is_safe_url(F.col("link")))


def normalise(raw: DataFrame, prefer_structured: bool = False) -> DataFrame:
    """Raw records to canonical ones: typed place, salary, level, tags, clean HTML, hash.

    Structured salary figures of a provider are ignored unless ``prefer_structured``; only the
    salary text counts.
    """
    text = F.concat_ws(
        " ", F.coalesce("location_raw", F.lit("")), "title", F.coalesce("description_text", F.lit(""))
    )
    rows = raw.withColumn("_place", parse_location(F.col("location_raw"))).withColumn(
        "_pay", parse_salary(F.col("salary_raw"))
    )
    pay = {
        "salary_min": F.col("_pay.min"),
        "salary_max": F.col("_pay.max"),
        "salary_currency": F.col("_pay.currency"),
        "salary_period": F.col("_pay.period"),
    }
    if prefer_structured:
        given = F.col("salary_min").isNotNull() | F.col("salary_max").isNotNull()
        pay = {name: F.when(given, F.col(name)).otherwise(col) for name, col in pay.items()}
    unknown = F.lit("unknown")
    level = F.coalesce(
        one_of(F.col("seniority"), [*SENIORITIES, "unknown"]),
        seniority_of(F.col("title"), F.col("description_text")),
    )
    carried = [c for c in ("source_kind", "seen_at", "source_id") if c in raw.columns]
    canonical = rows.select(
        *carried,
        "external_id", "source_url", "apply_url", "company_name", "company_domain", "title",
        ascii_norm(F.col("title")).alias("title_norm"),
        "description_text",
        sanitise_html(F.col("description_html")).alias("description_html"),
        F.coalesce("location_raw", F.lit("")).alias("location_raw"),
        F.col("_place.city").alias("city"),
        F.col("_place.region").alias("region"),
        F.col("_place.country_code").alias("country_code"),
        remote_scope(text).alias("remote_scope"),
        F.coalesce(one_of(F.col("work_mode"), WORK_MODES), unknown).alias("work_mode"),
        F.coalesce(one_of(F.col("employment_type"), EMPLOYMENT_TYPES), unknown).alias(
            "employment_type"
        ),
        level.alias("seniority"),
        *[col.alias(name) for name, col in pay.items()],
        "salary_raw",
        skill_tags(F.col("title"), F.col("description_text")).alias("skills"),
        "posted_at",
        F.lit("active").alias("status"),
        F.lit(1.0).alias("confidence"),
        "raw",
    ).withColumn("salary_period", one_of(F.col("salary_period"), SALARY_PERIODS))
    parts = hash_parts(
        *[F.col(c) for c in ("title", "company_name", "company_domain", "city", "work_mode")]
    )
    return canonical.withColumn("dedupe_hash", dedupe_hash(parts))
