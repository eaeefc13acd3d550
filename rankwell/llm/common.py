"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import os

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwell.session import bit_of, cut_lineage, fresh_dir, may_hold, ship_package  # noqa: F401

BATCH_BYTES = 8 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Give the package to the Python workers, and rows in batches of at most ``BATCH_BYTES``.

    For queries whose workers hold much beside their rows. The setting stays with the session.
    """
    ship_package(spark)
    if int(spark.conf.get(_BATCH_CONF).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def tokenizer_path(name: str) -> str:
    return public_tokenizers.path(name)


@functools.cache
def tokenizer(path: str):
    """The tokenizers library's object for a file, once per Python worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


def give_back() -> None:
    """Return freed memory of a Python worker to the machine; idle workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_text(column: str = "text") -> Column:
    """The text as read, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def common_rows(counted: DataFrame, limit: int, count: str = "n") -> DataFrame:
    """The rows of ``counted`` with the highest counts, at most ``limit`` of them.

    The cut is a count, found from a histogram of at most 1,024 classes, so no task sorts or
    holds all rows, and rows of equal count are kept or left together.
    """
    step = 16  # classes per doubling
    grade = F.floor(F.log2(F.col(count)) * step).cast("int")
    sizes = counted.groupBy(grade.alias("grade")).agg(F.count("*").alias("rows")).collect()
    room, least = limit, 1 << 30
    for row in sorted(sizes, key=lambda r: -r["grade"]):
        if row["rows"] > room:
            break
        room, least = room - row["rows"], row["grade"]
    return counted.where(grade >= least)


def without(docs: DataFrame, dropped: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` less the rows that ``dropped`` (doc_id, print: hash of the text) names.

    Only rows that may be among them are shuffled.
    """
    names = docs.columns
    printed = docs.withColumn("_print", F.xxhash64(whole_text(text)))
    gone = dropped.select(F.col("doc_id").alias("_doc_id"), F.col("print").alias("_print")).distinct()
    same = printed[key].eqNullSafe(gone["_doc_id"]) & (printed["_print"] == gone["_print"])
    doubtful = may_hold(printed, gone, "_print").join(gone, same, "left_anti")
    return may_hold(printed, gone, "_print", keep=False).unionByName(doubtful).select(*[f"`{c}`" for c in names])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
