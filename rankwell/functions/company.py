"""Company names and domains as comparable keys, and the exact-duplicate hash."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankwell.constants import HASH_SEPARATOR, LEGAL_WORDS
from rankwell.functions.text import fold_accents, hash_token, let, trimmed

# A slug never holds a dot, so the dotted forms of the list cannot occur in it.
_LEGAL_TAIL = "(?<=[a-z0-9])(?:-(?:{}))+$".format(
    "|".join(re.escape(w) for w in LEGAL_WORDS if "." not in w)
)
_LEGAL_ENDS = sorted({w.rsplit("-", 1)[-1] for w in LEGAL_WORDS if "." not in w})


def company_slug(name: Column, strip_legal: bool = False) -> Column:
    """``Café Ventures`` to ``cafe-ventures``; legal words go only on request, and never the
    first word."""
    plain = F.lower(fold_accents(F.coalesce(name, F.lit(""))))
    slug = F.btrim(F.regexp_replace(plain, "[^a-z0-9]+", "-"), F.lit("-"))
    if not strip_legal:
        return slug
    last = F.substring_index(slug, "-", -1)  # the pattern only runs where it can match
    return F.when(last.isin(_LEGAL_ENDS), F.regexp_replace(slug, _LEGAL_TAIL, "")).otherwise(slug)


def domain_slug(domain: Column) -> Column:
    """Host of a domain or URL, null unless it ends in a plausible top-level name."""
    host = F.lower(trimmed(domain))
    scheme = F.regexp_replace(host, r"^[a-z][a-z0-9+.-]*://", "")
    host = F.when(F.contains(host, F.lit("://")), scheme).otherwise(host)
    host = F.substring_index(host, "/", 1)
    host = F.substring_index(host, "@", -1)
    host = F.substring_index(host, ":", 1)
    host = F.regexp_replace(host, r"^www\.", "")
    return F.when(
        host.rlike(r"(?s)^.+\.[a-z]{2,}\z"), F.regexp_replace(host, "[^a-z0-9.-]", "")
    )


def company_candidates(name: Column, domain: Column) -> Column:
    """Name slug, domain and first domain label, distinct and in that order."""
    return let(
        F.struct(
            F.nullif(company_slug(name), F.lit("")).alias("slug"),
            domain_slug(domain).alias("host"),
        ),
        lambda k: F.array_distinct(
            F.array_compact(
                F.array(
                    k["slug"],
                    k["host"],
                    F.nullif(F.substring_index(k["host"], ".", 1), F.lit("")),
                )
            )
        ),
    )


def company_input(raw: Column) -> Column:
    """What a user typed: a domain when it is one, else a slug, else null."""
    return F.coalesce(domain_slug(raw), F.nullif(company_slug(raw), F.lit("")))


def clean_companies(items: Column) -> Column:
    return F.array_distinct(F.array_compact(F.transform(items, company_input)))


def hash_parts(title: Column, name: Column, domain: Column, city: Column, mode: Column) -> Column:
    """The four normalised parts that identify a record."""
    company = F.coalesce(domain_slug(domain), company_slug(name, strip_legal=True))
    return F.struct(
        hash_token(title).alias("title"),
        F.trim(F.regexp_replace(company, "[^a-z0-9]+", " ")).alias("company"),  # lower-case ASCII as it is
        hash_token(city).alias("city"),
        mode.alias("work_mode"),
    )


def dedupe_hash(parts: Column) -> Column:
    """SHA-256 of the joined parts; every part is a string, empty where the value is absent."""
    return F.sha2(
        F.concat_ws(
            HASH_SEPARATOR, *[parts[f] for f in ("title", "company", "city", "work_mode")]
        ),
        256,
    )
