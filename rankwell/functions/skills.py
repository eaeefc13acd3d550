"""Skill tags from free text."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwell.constants import SKILL_FORMS
from rankwell.functions.text import has


def form_pattern(form: str) -> str:
    """Whole-word pattern of one literal text form; blanks match any run of white space."""
    return r"\b" + re.sub(r"\s+", r"\\s+", re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", form)) + r"\b"


def skill_tags(*texts: Column) -> Column:
    """Sorted distinct slugs found in the texts; absent texts are ignored."""
    hay = F.concat_ws("\n", *[F.when(t != "", t) for t in texts])
    low = F.lower(hay)
    tags = []
    for slug, forms in sorted(SKILL_FORMS):
        # A plain search for the first word is much cheaper than the pattern it allows.
        maybe = reduce(lambda a, b: a | b, [low.contains(f.split()[0]) for f in forms])
        found = maybe & has(hay, "|".join(form_pattern(f) for f in forms))
        tags.append(F.when(found, F.lit(slug)))
    return F.array_compact(F.array(*tags))


def known_slugs(spark: SparkSession) -> DataFrame:
    rows = [(slug,) for slug, _ in SKILL_FORMS]
    return spark.createDataFrame(rows, "slug string").distinct().orderBy("slug")
