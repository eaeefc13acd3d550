"""Tables that users bring along."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def read_applications_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Imported applications as (good, bad) rows; a bad row carries its reason.

    A file without the expected columns fails as a whole. Apply the good rows only when there
    are no bad ones, or when the user has agreed to leave those out.
    """
    schema = "company string, title string, url string, stage string, date string, _bad string"
    rows = (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("columnNameOfCorruptRecord", "_bad")
        .option("escape", '"')
        .csv(path)
    )
    from rankwell.constants import STAGES

    when = F.try_to_timestamp("date")
    reason = (
        F.when(F.col("_bad").isNotNull(), "malformed_row")
        .when(F.coalesce(F.trim("company"), F.lit("")) == "", "company_missing")
        .when(F.coalesce(F.trim("title"), F.lit("")) == "", "title_missing")
        .when(~F.coalesce(F.lower("stage").isin(STAGES), F.lit(False)), "unknown_stage")
        .when(when.isNull(), "bad_date")
    )
    checked = rows.withColumn("reason", reason)
    good = checked.where(F.col("reason").isNull()).select(
        F.lower("stage").alias("stage"),
        when.alias("applied_at"),
        F.lit("csv_import").alias("source"),
        F.struct(
            "title", F.col("company").alias("company_name"), F.col("url").alias("source_url")
        ).alias("job_snapshot"),
    )
    bad = checked.where(F.col("reason").isNotNull()).select(
        "company", "title", "url", "stage", "date", "reason"
    )
    return good, bad
