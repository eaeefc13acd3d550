"""Session set-up, the shared working folder, and lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"

# Upper bound, in rows, for a side that is sent whole to every executor. Callers count at most
# this many rows plus one before they broadcast; a larger side takes the shuffle path instead.
BROADCAST_ROWS = 200_000


def build_session(
    app: str = "rankwell", master: str | None = None, cpus: int | None = None
) -> SparkSession:
    """A session with the settings the operators expect (UTC, AQE, skew handling)."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Methods above this size are not compiled by the JVM; split code runs faster than those.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.ui.enabled", "false")
    )
    if master or "MASTER" not in os.environ:
        builder = (
            builder.master(master or f"local[{cpus}]")
            .config("spark.sql.shuffle.partitions", str(cpus))
            .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "16g"))
        )
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers, once per application.

    Tasks unpickle functions by name, and executors need not start with the driver's path.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="rankwell-")  # served to the executors until the driver ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, f"{os.path.basename(package)}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for top, _, names in sorted(os.walk(package)):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(top, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A local run or test that names none gets a temporary folder. On a cluster that would be one
    machine's disk, which the others cannot read, so there a missing name is refused.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if named:
        return named.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="rankwell-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so later steps see fixed rows.

    A written table rather than an executor-local block: it outlives lost executors.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, "step")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than one row beyond that."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only after a count proved the size; otherwise leave the choice to AQE."""
    return F.broadcast(df) if small_enough(df, rows) else df


FILTER_BITS = 1 << 26  # 8 MB for every task, whatever the corpus


def bit_of(bitmap: Column, place: Column) -> Column:
    """Whether a bit of a bitmap (lowest bit of a byte first) is set."""
    byte = F.conv(F.hex(F.substring(bitmap, (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, place % 8) == 1


def may_hold(rows: DataFrame, keys: DataFrame, column: str, keep: bool = True) -> DataFrame:
    """Rows whose ``column`` may be among those of ``keys``; with ``keep`` false, those that cannot be.

    The keys are hashed to a bitmap of fixed size that every task gets, so rows that are certainly
    not wanted stay out of a later shuffle. It lets other rows pass by chance, and never loses one.
    """
    place = F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))
    bits = (
        keys.select(place.alias("_place"))
        .groupBy(F.bitmap_bucket_number("_place").alias("_bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bits"))
    )  # at most FILTER_BITS / 32,768 rows of 4 KB
    joined = rows.join(F.broadcast(bits), F.bitmap_bucket_number(place) == F.col("_bucket"), "left")
    hit = F.coalesce(bit_of(F.col("_bits"), F.bitmap_bit_position(place).cast("int")), F.lit(False))
    return joined.where(hit if keep else ~hit).drop("_bucket", "_bits")
