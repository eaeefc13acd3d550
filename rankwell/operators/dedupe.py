"""Exact duplicates: hash, collapse to one record with sighting counts, merge into a state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankwell.functions.company import dedupe_hash, hash_parts

RECORD_STATE = ["sighting_count", "first_seen_at", "last_seen_at"]


def with_hash(
    records: DataFrame,
    title: str = "title",
    company_name: str = "company_name",
    company_domain: str = "company_domain",
    city: str = "city",
    work_mode: str = "work_mode",
) -> DataFrame:
    """Adds ``dedupe_hash``; an absent city is a value of its own."""
    parts = hash_parts(*[F.col(c) for c in (title, company_name, company_domain, city, work_mode)])
    return records.withColumn("dedupe_hash", dedupe_hash(parts))


def collapse(
    sightings: DataFrame,
    keys: list[str],
    payload: list[str],
    seen_at: str,
    order: list[str],
) -> DataFrame:
    """One row per key: sighting count, first and last time, payload of the first sighting.

    ``order`` breaks ties between sightings of the same instant. Counts, minima and ``min_by``
    are combined before the shuffle, so a key holding a third of all rows costs one row per
    task, not one task.
    """
    first = F.min_by(F.struct(*payload), F.struct(seen_at, *order)) if payload else None
    grouped = sightings.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sighting_count"),
        F.min(seen_at).alias("first_seen_at"),
        F.max(seen_at).alias("last_seen_at"),
        *([first.alias("_first")] if payload else []),
    )
    kept = [F.col("_first")[c].alias(c) for c in payload]
    return grouped.select(*keys, *RECORD_STATE, *kept)


def sources_per_record(sightings: DataFrame, key: str, source: str) -> DataFrame:
    """How many different sources show each record."""
    pairs = sightings.select(key, source).distinct()
    return pairs.groupBy(key).agg(F.count(F.lit(1)).alias("source_count"))


def merge_state(state: DataFrame, delta: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """Old state and collapsed new sightings to the next state.

    Counts add up, the earliest time stays first, the latest time stays last, and the payload
    of a known record is never replaced. The order in which batches arrive does not matter for
    counts and times. A side holds one row per key, so each group has at most two rows.
    """

    def side(df: DataFrame, age: int) -> DataFrame:
        return df.select(
            *keys, *RECORD_STATE, F.struct(F.lit(age).alias("age"), *payload).alias("_p")
        )

    merged = (
        side(state, 0)
        .unionByName(side(delta, 1))
        .groupBy(*keys)
        .agg(
            F.sum("sighting_count").alias("sighting_count"),
            F.min("first_seen_at").alias("first_seen_at"),
            F.max("last_seen_at").alias("last_seen_at"),
            F.min_by("_p", F.col("_p")["age"]).alias("_p"),
        )
    )
    return merged.select(*keys, *RECORD_STATE, *[F.col("_p")[c].alias(c) for c in payload])


def new_or_repeat(state: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """Marks the records of a run as new or as seen before."""
    known = state.select(key, F.lit(True).alias("_known"))
    return delta.join(known, key, "left").withColumn(
        "is_new", F.col("_known").isNull()
    ).drop("_known")


def longer_text_survives(
    incumbent_text: Column, newcomer_text: Column, incumbent_count: Column, newcomer_count: Column
) -> Column:
    """True when the incumbent is kept: longer text, then more sightings, then incumbent."""
    mine = F.coalesce(F.length(incumbent_text), F.lit(0))
    other = F.coalesce(F.length(newcomer_text), F.lit(0))
    return (mine > other) | ((mine == other) & (incumbent_count >= newcomer_count))
