"""The catalogue of registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rankwell.plans.adapters import VIEWS, check_sql, sql, view
from rankwell.session import cut_lineage, ship_package

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Inputs:
    """Tables and views of one data folder, read on first use: ``t.lineitem``, ``t.jobs``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        # Times in the tables carry no zone; every query reads them as UTC.
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        ship_package(spark)
        self._stored: dict[str, DataFrame] = {}

    def stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A table that several parts of one query read: written once, then read back."""
        if name not in self._stored:
            self._stored[name] = cut_lineage(build())
        return self._stored[name]

    def view_over(self, name: str, **tables: DataFrame) -> DataFrame:
        """A view whose named tables are replaced by others of the same columns."""
        return sql(self.spark, self.sf_dir, VIEWS[name], tables)

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)


def query(oracle: str | None = None):
    """Register ``fn(t: Inputs)`` under its own name, with the SQL that must agree with it."""

    def register(fn: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if oracle is not None:
            ORACLES[fn.__name__] = check_sql(oracle)
        return fn

    return register
