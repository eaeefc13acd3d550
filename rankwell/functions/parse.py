"""Free text to typed values: salary, place, remote scope, seniority, dates, currencies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankwell.constants import COUNTRY_CODES, COUNTRY_NAMES, SENIORITIES
from rankwell.functions.text import first_match, has, is_blank, is_finite, let, lookup, pattern, trimmed

# --- fixed values: patterns, in order of precedence -----------------------------------------
INDIA_SCOPE = [
    r"\bpan\s*india\b",
    r"\banywhere\s+in\s+india\b",
    r"\bindia\s*remote\b",
    r"\bremote\s*[-–]\s*india\b",
    r"\bwork\s+from\s+home\s+india\b",
    r"\bwork\s+from\s+india\b",
    r"\bindia\s*wfh\b",
    r"\bwfh\s+india\b",
    r"\bremote\s*\(india\)",
    r"\bremote\s*-\s*india\b",
]
GLOBAL_SCOPE = [
    r"\bworldwide\b",
    r"\bglobal\b",
    r"\banywhere\b",
    r"\binternational\s+remote\b",
    r"\bremote\s*[-–]\s*anywhere\b",
    r"\bremote\s*[-–]\s*global\b",
    r"\bremote\s*[-–]\s*worldwide\b",
    r"\bwork\s+from\s+anywhere\b",
    r"\blocation\s+agnostic\b",
    r"\btime\s*zone\s+agnostic\b",
    r"\bremote\s*\(global\)",
    r"\bremote\s*\(worldwide\)",
    r"\bremote\s*\(anywhere\)",
]
SENIORITY_RULES = [
    ("intern", r"\b(intern|internship|trainee|fresher)\b"),
    ("junior", r"\b(junior|jr\.?|entry[- ]level|0[- ]2\s*years?|1[- ]2\s*years?)\b"),
    ("mid", r"\b(mid[- ]level|intermediate|2[- ]5\s*years?|3[- ]5\s*years?)\b"),
    ("senior", r"\b(senior|sr\.?|5\+\s*years?|8\+\s*years?|7\+\s*years?)\b"),
    ("lead", r"\b(lead|team lead|tech lead|engineering lead)\b"),
    ("staff", r"\b(staff engineer|staff developer|staff)\b"),
    ("principal", r"\b(principal engineer|principal developer|principal)\b"),
    ("director", r"\b(director|head of|vp|vice president)\b"),
    ("exec", r"\b(cto|ceo|cio|chief)\b"),
]
REMOTE_START = r"^(remote|work from home|wfh|anywhere|work from)"
LAKH = r"(\d+(?:\.\d+)?)\s*(?:l|lakh)s?\b"
CRORE = r"(\d+(?:\.\d+)?)\s*(?:cr|crore)s?\b"
LPA = r"(\d+(?:\.\d+)?)\s*lpa\b"
FIGURE = r"\d[\d,]*(?:\.\d{1,2})?"

LOCATION_TYPE = "struct<city:string,region:string,country_code:string,remote_scope:string>"
SALARY_TYPE = "struct<min:double,max:double,currency:string,period:string>"


def remote_scope(text: Column) -> Column:
    """``india`` before ``global`` before ``unknown``: the narrower phrase wins."""
    return (
        F.when(has(text, "|".join(INDIA_SCOPE)), "india")
        .when(has(text, "|".join(GLOBAL_SCOPE)), "global")
        .otherwise("unknown")
    )


def country_code(name: Column) -> Column:
    return lookup(F.lower(name), COUNTRY_CODES)


def parse_location(raw: Column) -> Column:
    """Struct of city, region, country code and remote scope."""
    raw = F.coalesce(raw, F.lit(""))
    nothing = F.lit(None).cast("string")

    def place(city, region, code, scope):
        return F.struct(
            city.alias("city"),
            region.alias("region"),
            code.alias("country_code"),
            scope.alias("remote_scope"),
        )

    def body(known):
        parts, scope = known["parts"], known["scope"]
        first, second, last = F.get(parts, 0), F.get(parts, 1), F.element_at(parts, -1)
        bracket = F.regexp_extract(raw, r"\(([^)]+)\)", 1)
        named = first_match(
            raw, [(COUNTRY_CODES[name.lower()], rf"\b{name}\b") for name in COUNTRY_NAMES]
        )
        in_bracket = F.when(bracket != "", country_code(trimmed(bracket))).otherwise(named)
        code = F.when(F.size(parts) > 0, country_code(last))
        return (
            F.when(
                (scope != "unknown") & has(trimmed(raw), REMOTE_START),
                place(nothing, nothing, in_bracket, scope),
            )
            .when(F.size(parts) == 0, place(nothing, nothing, nothing, scope))
            .when(
                F.size(parts) == 1,
                place(F.when(code.isNull(), first), nothing, code, scope),
            )
            .when(
                F.size(parts) == 2,
                place(first, F.when(code.isNull(), second), code, scope),
            )
            .otherwise(place(first, second, code, scope))
        )

    pieces = F.filter(F.transform(F.split(raw, ","), trimmed), lambda x: x != "")
    known = F.struct(pieces.alias("parts"), remote_scope(raw).alias("scope"))
    return let(known, body)


def _figures(raw: Column, regex: str, scale: float) -> Column:
    found = F.regexp_extract_all(raw, F.lit(pattern(regex)), F.lit(1))
    return F.transform(found, lambda x: x.cast("double") * F.lit(scale))


def parse_salary(raw: Column) -> Column:
    """Struct of min, max, currency and period.

    Order: blank, lakh per annum, lakh, crore, plain numbers. Lakh and crore are always INR,
    "10-15 LPA" gives its last figure before the suffix, and a bare "120k" reads as 120.
    """
    period = F.when(has(raw, r"hour|\/hr|per hr"), "hour").when(
        has(raw, r"month|\/mo|per mo"), "month"
    ).otherwise("year")
    currency = (
        F.when(has(raw, r"£|\bgbp\b"), "GBP")
        .when(has(raw, r"€|\beur\b"), "EUR")
        .when(has(raw, r"₹|\binr\b|\brs\.?\b"), "INR")
        .otherwise("USD")
    )

    def pay(values, code, per):
        return F.struct(
            F.get(values, 0).alias("min"),
            F.get(values, 1).alias("max"),
            code.alias("currency"),
            per.alias("period"),
        )

    lpa = F.regexp_extract(raw, pattern(LPA), 1)
    plain = F.transform(
        F.regexp_extract_all(raw, F.lit(FIGURE), F.lit(0)),
        lambda x: F.regexp_replace(x, ",", "").try_cast("double"),
    )
    inr = F.lit("INR")
    known = F.struct(
        lpa.try_cast("double").alias("lpa"),
        _figures(raw, LAKH, 100000.0).alias("lakh"),
        _figures(raw, CRORE, 10000000.0).alias("crore"),
    )
    return F.when(is_blank(raw), F.lit(None).cast(SALARY_TYPE)).otherwise(
        let(
            known,
            lambda k: F.when(
                k["lpa"].isNotNull(), pay(F.array(k["lpa"] * 100000.0), inr, F.lit("year"))
            )
            .when(F.size(k["lakh"]) > 0, pay(k["lakh"], inr, period))
            .when(F.size(k["crore"]) > 0, pay(k["crore"], inr, period))
            .otherwise(pay(plain, currency, period)),
        )
    )


def seniority_of(title: Column, description: Column) -> Column:
    text = F.concat(title, F.lit(" "), F.coalesce(description, F.lit("")))
    return F.coalesce(first_match(text, SENIORITY_RULES), F.lit("unknown"))


def seniority_rank(level: Column) -> Column:
    """0 for intern up to 8 for exec; null for unknown."""
    return lookup(level, {name: rank for rank, name in enumerate(SENIORITIES)})


def annual_amount(amount: Column, period: Column) -> Column:
    """Yearly figure; a missing period means a year, an hourly rate cannot be annualised."""
    effective = F.coalesce(period, F.lit("year"))
    return F.when(
        is_finite(amount),
        F.when(effective == "year", amount).when(effective == "month", amount * 12),
    )


# --- coercions of provider fields -----------------------------------------------------------


def epoch_millis(value: Column) -> Column:
    return F.when(value > 0, F.timestamp_millis(value.cast("bigint")))


def epoch_any(value: Column) -> Column:
    """Seconds or milliseconds since 1970, told apart by size."""
    return epoch_millis(F.when(value < 1_000_000_000_000, value * 1000).otherwise(value))


def date_text(value: Column) -> Column:
    return F.try_to_timestamp(value)


def currency_code(value: Column) -> Column:
    code = F.upper(trimmed(value))
    return F.when(code.rlike("^[A-Z]{3}$"), code)


def remote_flag(value: Column) -> Column:
    """True means remote; false says nothing about the office."""
    return F.when(value, F.lit("remote"))
