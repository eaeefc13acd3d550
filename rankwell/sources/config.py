"""Source settings: seeds, enabled sources, and the targets each source asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwell.constants import DEFAULT_COUNTRIES, SKILL_SEED, SOURCE_SEED

CONFIG = (
    "struct<board:string,boards:array<string>,organizations:array<string>,urls:array<string>,"
    "query:string,queries:array<string>,countries:array<string>,companyName:string>"
)


def seed_sources(spark: SparkSession, existing: DataFrame | None = None) -> DataFrame:
    """Default sources; with ``existing`` only those whose name is not there yet are added."""
    seeds = spark.createDataFrame(
        SOURCE_SEED, "name string, kind string, config string, enabled boolean, cadence_minutes int"
    )
    if existing is None:
        return seeds
    missing = seeds.join(existing.select("name"), "name", "left_anti")
    return existing.unionByName(missing, allowMissingColumns=True)


def seed_skills(spark: SparkSession, existing: DataFrame | None = None) -> DataFrame:
    seeds = spark.createDataFrame(
        SKILL_SEED, "name string, slug string, aliases array<string>, category string"
    )
    if existing is None:
        return seeds
    missing = seeds.join(existing.select("slug"), "slug", "left_anti")
    return existing.unionByName(missing, allowMissingColumns=True)


def enabled_sources(sources: DataFrame) -> DataFrame:
    """Enabled sources with an id and a kind; the settings column is not read."""
    return sources.where(
        F.col("enabled") & F.col("id").isNotNull() & F.col("kind").isNotNull()
    ).select(
        "id",
        F.coalesce("name", F.lit("")).alias("name"),
        "kind",
        "enabled",
        F.coalesce("cadence_minutes", F.lit(0)).alias("cadence_minutes"),
        "next_run_at",
        F.coalesce("consecutive_failures", F.lit(0)).alias("consecutive_failures"),
    )


def targets(sources: DataFrame) -> DataFrame:
    """One row per board, organisation, page, search or country a source asks for.

    A single board wins over a list for the board providers; lists win for the others.
    """
    c = F.col("_c")
    board = F.when(c["board"].isNotNull() & (c["board"] != ""), F.array(c["board"]))
    some = lambda col: F.when(F.size(col) > 0, col)
    single = lambda col: F.when(col.isNotNull() & (col != ""), F.array(col))
    listed = (
        F.when(F.col("kind").isin("api_greenhouse", "api_lever"), F.coalesce(board, c["boards"]))
        .when(F.col("kind") == "api_ashby", F.coalesce(board, c["organizations"]))
        .when(F.col("kind") == "firecrawl_scrape", F.coalesce(some(c["urls"]), board))
        .when(F.col("kind") == "firecrawl_search", F.coalesce(some(c["queries"]), single(c["query"])))
        .when(
            F.col("kind") == "api_adzuna",
            F.coalesce(some(c["countries"]), F.array(*[F.lit(x) for x in DEFAULT_COUNTRIES])),
        )
        .otherwise(F.array(F.coalesce(c["query"], F.lit(""))))
    )
    return sources.withColumn("_c", F.from_json("config", CONFIG)).select(
        "name", "kind", c["companyName"].alias("company_override"), F.explode(listed).alias("token")
    )
