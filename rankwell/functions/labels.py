"""Display labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankwell.constants import COMPONENT_LABELS, GATE_SENTENCES, PERIOD_LABELS, SCORE_BANDS
from rankwell.functions.text import lookup


def number_text(value: Column) -> Column:
    """Shortest plain form of a number: no trailing zeros, no exponent below 1e15."""
    whole = value == F.floor(value)
    shown = value.cast("double").cast("string")
    fixed = F.rtrim(value.cast("double").cast("decimal(38,10)").cast("string"), F.lit("0"))
    large = shown.contains("E") & (F.abs(value) >= 1e7) & (F.abs(value) < 1e15)
    return F.when(whole, value.cast("bigint").cast("string")).otherwise(F.when(large, fixed).otherwise(shown))


def salary_label(low: Column, high: Column, currency: Column, period: Column) -> Column:
    """``160000–190000 USD/yr``, ``from …``, ``up to …``, or null without any figure."""
    unit = F.when(
        period.isNotNull(),
        F.coalesce(lookup(period, PERIOD_LABELS), F.concat(F.lit(" "), period)),
    ).otherwise("")
    tail = F.concat(F.lit(" "), F.coalesce(currency, F.lit("")), unit)
    figure = (
        F.when(
            low.isNotNull() & high.isNotNull(),
            F.concat(number_text(low), F.lit("–"), number_text(high)),
        )
        .when(low.isNotNull(), F.concat(F.lit("from "), number_text(low)))
        .when(high.isNotNull(), F.concat(F.lit("up to "), number_text(high)))
    )
    return F.trim(F.concat(figure, tail))


def date_label(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "M/d/yyyy"), F.lit("unknown"))


def score_band(score: Column) -> Column:
    band = F.when(score > 0, "weak").otherwise("gated")
    for floor, name in sorted(SCORE_BANDS):
        band = F.when(score >= floor, name).otherwise(band)
    return band


def gate_sentences(reasons: Column) -> Column:
    """One sentence per reason code; a code without a sentence is shown as it is."""
    return F.transform(reasons, lambda r: F.coalesce(lookup(r, GATE_SENTENCES), r))


def component_label(key: Column) -> Column:
    return F.coalesce(lookup(key, COMPONENT_LABELS), key)
