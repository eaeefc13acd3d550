"""Profile fields from résumé text, as column expressions over whole documents."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankwell.constants import MAX_SEED_SKILLS, MAX_TITLES
from rankwell.functions.parse import parse_location, parse_salary
from rankwell.functions.text import first_match, has, has_word, holds_any, let, pattern, trimmed

# --- fixed values: patterns and word lists ------------------------------------------------------
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE = r"(\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"
HEADERS = [
    ("summary", r"^(summary|objective|profile|about|introduction)\s*:?\s*$"),
    ("experience", r"^(experience|employment|work history|professional experience|career)\s*:?\s*$"),
    ("education", r"^(education|academic|qualifications)\s*:?\s*$"),
    ("skills", r"^(skills|technologies|tech stack|competencies|expertise)\s*:?\s*$"),
    ("projects", r"^(projects|portfolio)\s*:?\s*$"),
    ("certifications", r"^(certifications|certificates|licenses)\s*:?\s*$"),
]
LEVELS = [
    ("exec", r"\b(cto|ceo|cio|chief)\b"),
    ("director", r"\b(director|head of|vp|vice president)\b"),
    ("principal", r"\bprincipal\b"),
    ("staff", r"\bstaff\b"),
    ("lead", r"\b(lead|tech lead|team lead|engineering lead)\b"),
    ("senior", r"\b(senior|sr\.?)\b"),
    ("mid", r"\b(mid[- ]level|intermediate)\b"),
    ("junior", r"\b(junior|jr\.?|entry[- ]level)\b"),
    ("intern", r"\b(intern|internship|trainee)\b"),
]
MODES = [
    ("remote", r"\b(remote|work from home|wfh|distributed|anywhere)\b"),
    ("hybrid", r"\b(hybrid|flexible|partial remote)\b"),
    ("onsite", r"\b(on[- ]site|in[- ]office|office[- ]based)\b"),
]
YEARS = [
    r"(\d+)\+?\s*years?\s*(?:of\s*)?experience",
    r"experience[:\s]*(\d+)\+?\s*years?",
    r"(\d+)\+?\s*years?\s*(?:in|of)",
]
PAY = [
    r"(?:expected|desired|target)?\s*(?:salary|compensation|ctc|ctc|pay|package)\s*[:\s-]*(?:₹|\$|€|£)?\s*[\d][\d,]*(?:\.\d{1,2})?\s*(?:l|lakh|cr|crore)?(?:\s*(?:per|\/)\s*(?:year|annum|yr|month|mo|hour|hr))?",
    r"(?:₹|\$|€|£)\s*[\d][\d,]*(?:\.\d{1,2})?\s*(?:l|lakh|cr|crore)?(?:\s*(?:per|\/)\s*(?:year|annum|yr|month|mo|hour|hr))?",
    r"\b[\d][\d,]*(?:\.\d{1,2})?\s*(?:l|lakh|cr|crore)\b(?:\s*(?:per|\/)\s*(?:year|annum|yr|month|mo))?",
]
PAY_WORDS = ["salary", "compensation", "ctc", "pay", "package"]
PAY_SIGNS = ["₹", "$", "€", "£"]
SKILLS = [
    "JavaScript", "TypeScript", "Python", "Java", "C++", "C#", "Go", "Rust", "Ruby", "PHP",
    "React", "Angular", "Vue", "Next.js", "Node.js", "Express", "Django", "Flask", "Spring",
    "AWS", "Azure", "GCP", "Docker", "Kubernetes", "Terraform", "CI/CD", "Git", "Agile", "Scrum",
    "SQL", "PostgreSQL", "MySQL", "MongoDB", "Redis", "Elasticsearch", "GraphQL", "REST",
    "Machine Learning", "Deep Learning", "NLP", "Computer Vision", "Data Science", "Analytics",
    "Product Management", "Project Management", "Leadership", "Communication", "Collaboration",
]
TITLES = [
    r"^(senior|junior|lead|principal|staff|director|vp|head of|chief)?\s*(software|frontend|backend|full[- ]stack|devops|data|product|project|engineering)?\s*(engineer|developer|manager|designer|analyst|consultant|architect)",
    r"^(software|frontend|backend|full[- ]stack|devops|data|product|project|engineering)\s*(engineer|developer|manager|designer|analyst|consultant|architect)",
]
DEGREE = r"(b\.?s\.?|m\.?s\.?|b\.?a\.?|m\.?a\.?|b\.?tech|m\.?tech|b\.?e\.?|m\.?e\.?|ph\.?d\.?|bachelor|master|doctorate)"
YEAR = r"(?:19|20)\d{2}"
PLACE_LABEL = r"location\s*:\s*(.+)"
PLACE_LINE = r"^[A-Z][A-Za-z .'-]+,\s*[A-Z]{2}(?:\s*,\s*[A-Za-z ]+)?\s*$"
NAME_LINE = r"^[A-Z][a-z]+(?:\s[A-Z][a-z]+){1,3}$"
CONFIDENCE = [
    ("email", 20), ("phone", 10), ("location", 15), ("titles", 20), ("skills", 20),
    ("seniority", 10), ("summary", 5),
]
REVIEW_BELOW = 0.6


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _found(text: Column, regex: str, ignore_case: bool = True) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern(regex, ignore_case)), F.lit(0))


def section(text: Column, name: str) -> Column:
    """Lines after the named header up to the next other header; null without any line."""
    rows = F.transform(
        _lines(text),
        lambda x: F.struct(x.alias("line"), first_match(trimmed(x), HEADERS).alias("head")),
    )

    def after(all_rows):
        start = F.array_position(F.transform(all_rows, lambda r: F.coalesce(r["head"], F.lit(""))), name)
        rest = F.slice(all_rows, start.cast("int") + 1, F.size(all_rows))

        def until(tail):
            stop = F.array_position(
                F.transform(tail, lambda r: F.coalesce(r["head"] != name, F.lit(False))), True
            ).cast("int")
            part = F.when(stop > 0, F.slice(tail, 1, F.greatest(stop - 1, F.lit(0)))).otherwise(tail)
            body = F.transform(F.filter(part, lambda r: r["head"].isNull()), lambda r: r["line"])
            return let(body, lambda b: F.when(F.size(b) > 0, trimmed(F.array_join(b, "\n"))))

        return F.when(start > 0, let(rest, until))

    return let(rows, after)


def emails(text: Column) -> Column:
    return F.array_distinct(F.transform(_found(text, EMAIL, False), F.lower))


def phones(text: Column) -> Column:
    return F.array_distinct(
        F.transform(
            _found(text, PHONE, False),
            lambda x: trimmed(F.regexp_replace(x, pattern(r"\s+"), " ")),
        )
    )


def skills(text: Column) -> Column:
    """Listed skills in list order; the end guard lets ``C++`` and ``C#`` match."""
    hay = F.lower(text)
    hits = []
    for name in SKILLS:
        literal = re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", name)
        # The plain search comes first: it rules out most skills at a fraction of the cost.
        found = hay.contains(name.lower()) & has(hay, rf"\b{literal}(?!\w)")
        hits.append(F.when(found, F.lit(name)))
    return F.array_compact(F.array(*hits))


def seniority(experience: Column) -> Column:
    """Highest named level first; years only when no level is named."""
    years = F.regexp_extract(experience, pattern(r"(\d+)\+?\s*years?"), 1).try_cast("double")
    by_years = F.when(years < 2, "junior").when(years < 5, "mid").when(years < 8, "senior").when(
        years.isNotNull(), "lead"
    )
    return F.coalesce(first_match(experience, LEVELS), F.when(experience.rlike(r"\d"), by_years))


def years_experience(text: Column) -> Column:
    return F.coalesce(
        *[F.regexp_extract(text, pattern(p), 1).try_cast("double") for p in YEARS]
    )


def work_modes(text: Column) -> Column:
    low = F.lower(text)
    return F.array_compact(
        F.array(*[F.when(has_word(text, low, p), F.lit(m)) for m, p in MODES])
    )


def salary(text: Column) -> Column:
    """The stated pay: the fragment is located by keyword, then parsed like any salary."""
    low = F.lower(text)
    may = [holds_any(low, PAY_WORDS), holds_any(text, PAY_SIGNS), text.rlike(r"\d")]
    fragment = F.coalesce(
        *[
            F.when(sign, F.nullif(F.regexp_extract(text, pattern(p), 0), F.lit("")))
            for sign, p in zip(may, PAY)
        ]
    )
    return let(fragment, parse_salary)


def location(text: Column) -> Column:
    """First labelled line, else first ``City, ST`` line, that resolves to a city."""
    lines = F.filter(_lines(text), lambda x: has(trimmed(x), PLACE_LINE, False))
    spots = F.concat(_found(text, PLACE_LABEL), lines)
    parsed = F.transform(
        spots,
        lambda x: parse_location(
            trimmed(F.regexp_replace(x, pattern(r"^location\s*:\s*"), ""))
        ),
    )
    return F.get(F.filter(parsed, lambda p: p["city"].isNotNull() & (p["city"] != "")), 0)


def titles(experience: Column) -> Column:
    rows = F.filter(
        F.transform(_lines(experience), trimmed),
        lambda x: (F.length(x) > 5) & (F.length(x) < 100) & (has(x, TITLES[0]) | has(x, TITLES[1])),
    )
    heads = F.transform(rows, lambda x: F.get(F.split(x, "[-–|]"), 0))
    kept = F.transform(F.filter(heads, lambda x: x != ""), trimmed)
    return F.slice(F.array_distinct(kept), 1, MAX_TITLES)


def education(text: Column) -> Column:
    rows = F.filter(
        F.transform(_lines(section(text, "education")), trimmed), lambda x: has(x, DEGREE)
    )
    entries = F.transform(
        rows,
        lambda x: F.struct(
            x.alias("degree"),
            F.lit("").alias("institution"),
            F.regexp_extract(x, YEAR, 0).try_cast("int").alias("year"),
        ),
    )
    return F.coalesce(
        entries, F.array().cast("array<struct<degree:string,institution:string,year:int>>")
    )


def summary(text: Column, named: Column) -> Column:
    long_lines = F.filter(_lines(text), lambda x: F.length(trimmed(x)) > 20)
    fallback = F.when(
        F.size(long_lines) > 0, F.left(F.array_join(F.slice(long_lines, 1, 3), " "), F.lit(500))
    )
    return F.when(F.length(named) > 20, F.left(named, F.lit(500))).otherwise(fallback)


def full_name(text: Column) -> Column:
    head = F.slice(F.filter(F.transform(_lines(text), trimmed), lambda x: x != ""), 1, 5)
    return F.get(F.filter(head, lambda x: has(x, NAME_LINE, False)), 0)


def extract_profiles(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of profile fields per document, with confidence and review flag."""
    t = F.col(text)
    base = docs.select(
        doc_id,
        t.alias("_text"),
        F.coalesce(section(t, "experience"), t).alias("_experience"),
        section(t, "summary").alias("_summary"),
    )
    t, pay = F.col("_text"), F.col("_pay")
    fields = base.select(
        doc_id,
        full_name(t).alias("full_name"),
        F.get(emails(t), 0).alias("email"),
        F.get(phones(t), 0).alias("phone"),
        location(t).alias("location"),
        titles(F.col("_experience")).alias("titles"),
        seniority(F.col("_experience")).alias("seniority"),
        years_experience(t).alias("years_experience"),
        skills(t).alias("skills"),
        work_modes(t).alias("work_modes"),
        salary(t).alias("_pay"),
        education(t).alias("education"),
        summary(t, F.col("_summary")).alias("summary"),
    )
    has_field = {
        "email": F.col("email").isNotNull(),
        "phone": F.col("phone").isNotNull(),
        "location": F.col("location").isNotNull(),
        "titles": F.size("titles") > 0,
        "skills": F.size("skills") > 0,
        "seniority": F.col("seniority").isNotNull(),
        "summary": F.coalesce(F.col("summary") != "", F.lit(False)),
    }
    points = sum(F.when(has_field[name], weight).otherwise(0) for name, weight in CONFIDENCE)
    return (
        fields.withColumn("min_salary", pay["min"])
        .withColumn("salary_currency", pay["currency"])
        .withColumn("salary_period", pay["period"])
        .withColumn("confidence", points / F.lit(float(sum(w for _, w in CONFIDENCE))))
        .withColumn(
            "needs_review",
            (F.col("confidence") < REVIEW_BELOW) | ~has_field["email"] | ~has_field["titles"],
        )
        .withColumn(
            "method", F.when(F.col("confidence") >= REVIEW_BELOW, "rules").otherwise("fallback")
        )
        .drop("_pay")
    )


def profile_seed(extracted: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The part of an extracted profile that seeds a new account."""
    place = F.col("location")
    return extracted.select(
        doc_id,
        F.slice("titles", 1, MAX_TITLES).alias("target_titles"),
        "seniority",
        "years_experience",
        F.slice("skills", 1, MAX_SEED_SKILLS).alias("skills"),
        "work_modes",
        place["country_code"].alias("country_code"),
        place["city"].alias("city"),
        "min_salary",
        "salary_currency",
        "salary_period",
    )


_LISTS = ["target_titles", "skills", "work_modes"]
_SINGLES = [
    "seniority", "years_experience", "country_code", "city", "min_salary", "salary_currency",
    "salary_period",
]


def merge_seed(existing: DataFrame, seed: DataFrame, key: str) -> DataFrame:
    """Seed values over existing ones: a non-empty list wins, a single value fills by coalesce."""
    old, new = existing.alias("old"), seed.alias("new")
    kind = dict(seed.dtypes)
    lists = [
        F.when(F.size(f"new.{c}") > 0, F.col(f"new.{c}"))
        .otherwise(F.coalesce(f"old.{c}", F.array().cast(kind[c])))
        .alias(c)
        for c in _LISTS
    ]
    singles = [F.coalesce(f"new.{c}", f"old.{c}").alias(c) for c in _SINGLES]
    return new.join(old, key, "left").select(key, *lists, *singles)


def seed_ready() -> Column:
    """Whether a seed holds enough to be worth applying."""
    return (
        (F.size("target_titles") > 0)
        | (F.size("skills") > 0)
        | F.col("country_code").isNotNull()
        | (F.size("work_modes") > 0)
    )
