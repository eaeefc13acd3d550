"""Work that needs rows in order within a key, safe for keys that hold a large share of rows.

A plain window puts all rows of a key into one task. Here rows are range-partitioned by key and
order together, so a hot key spans many partitions, and only one small row per partition has to
be looked at in sequence to carry values across the cuts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankwell.session import cut_lineage


def sorted_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows with ``_at`` (ascending over the whole sorted table) and ``_part`` (their partition).

    The result is written out once: later steps read ``_part`` as data, so the cuts cannot move
    between two uses.
    """
    columns = [*keys, *order]
    ranged = df.repartitionByRange(*columns).sortWithinPartitions(*columns)
    numbered = ranged.withColumn("_at", F.monotonically_increasing_id())
    return cut_lineage(numbered.withColumn("_part", F.shiftright("_at", 33)))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on columns of the same names where null equals null; the left side's are kept."""
    other = right.withColumnsRenamed({k: f"_other_{k}" for k in keys})
    match = reduce(lambda a, b: a & b, [_same(left[k], other[f"_other_{k}"]) for k in keys])
    return left.join(other, match, how).drop(*[f"_other_{k}" for k in keys])


def with_previous(
    df: DataFrame, keys: list[str], order: list[str], columns: list[str], prefix: str = "prev_"
) -> DataFrame:
    """Adds the value of ``columns`` in the previous row of the same key, null for the first."""
    rows = sorted_rows(df, keys, order)
    here = F.struct(F.struct(*keys).alias("key"), *columns)
    in_part = Window.partitionBy("_part").orderBy("_at")
    tails = rows.groupBy("_part").agg(F.max_by(here, "_at").alias("_tail"))
    # One row per partition; this sequence does not grow with the data of any key.
    carried = tails.select("_part", F.lag("_tail").over(Window.orderBy("_part")).alias("_carry"))
    linked = rows.withColumn("_lag", F.lag(here).over(in_part)).join(carried, "_part", "left")
    before = F.coalesce("_lag", "_carry")
    same_key = _same(before["key"], F.struct(*keys))
    return linked.select(
        *df.columns, *[F.when(same_key, before[c]).alias(prefix + c) for c in columns]
    )


def with_row_number(
    df: DataFrame, keys: list[str], order: list[str], name: str = "row_number"
) -> DataFrame:
    """Adds the position of each row within its key, from 1."""
    rows = sorted_rows(df, keys, order)
    local = F.row_number().over(Window.partitionBy("_part", *keys).orderBy("_at"))
    # Only the first key of a partition can have rows in earlier ones.
    firsts = rows.groupBy("_part").agg(F.min_by(F.struct(*keys), "_at").alias("_first"))
    cut_keys = firsts.select(*[F.col("_first")[k].alias(k) for k in keys]).distinct()
    sizes = (
        joined(rows, cut_keys, keys, "left_semi")
        .groupBy("_part", *keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", *keys, F.sum("_rows").over(earlier).alias("_offset"))
    return joined(rows.withColumn("_local", local), offsets, ["_part", *keys], "left").select(
        *df.columns, (F.col("_local") + F.coalesce("_offset", F.lit(0))).alias(name)
    )


# --- state machines -------------------------------------------------------------------------------


def _starts(steps: Column, start: Column) -> Column:
    """Position and state before each step of an ordered list of (pos, step) structs."""
    empty = F.array().cast("array<struct<pos:bigint,state:int>>")
    folded = F.aggregate(
        steps,
        F.struct(start.alias("state"), empty.alias("out")),
        lambda acc, x: F.struct(
            F.get(x["step"], acc["state"]).alias("state"),
            F.concat(
                acc["out"], F.array(F.struct(x["pos"].alias("pos"), acc["state"].alias("state")))
            ).alias("out"),
        ),
    )
    return folded["out"]


def _combined(steps: Column, states: int) -> Column:
    """One step equal to all steps of the list in turn."""
    return F.aggregate(
        steps,
        F.array(*[F.lit(i) for i in range(states)]),
        lambda acc, x: F.transform(acc, lambda s: F.get(x["step"], s)),
    )


def _listed(pos: str) -> Column:
    return F.array_sort(F.collect_list(F.struct(F.col(pos).cast("bigint").alias("pos"), "step")))


def replay(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    step: Column,
    states: int,
    start: int,
    slice_rows: int = 200,
) -> DataFrame:
    """Runs a small state machine over each key's rows; adds ``state``, the state before a row.

    ``step`` is an array giving the next state for each state. Steps combine like functions, so
    slices of at most ``slice_rows`` rows are combined first, then as many of these slices, and
    so on until a key is one step; the start states flow back down the same levels. No list at
    any level is longer than ``slice_rows``, whatever a key or a partition holds. A null key is a
    key like any other.
    """
    cut = sorted_rows(rows.withColumn("step", step), keys, order)
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    last = cut.agg(F.max(place).alias("row"), F.max("_part").alias("part")).first()
    width = slice_rows
    while width <= (last.row or 0):
        width *= slice_rows
    # A row's place in the whole table; partitions follow each other at a power of the slice.
    cut = cut.withColumn("_pos", F.col("_part") * width + place)
    levels, top = 1, slice_rows
    while top < ((last.part or 0) + 1) * width:
        levels, top = levels + 1, top * slice_rows

    slices, below = [], cut.select(*keys, "_pos", "step")
    for _ in range(levels):
        grouped = below.groupBy(*keys, F.floor(F.col("_pos") / slice_rows).alias("_slice")).agg(
            _listed("_pos").alias("_steps")
        )
        slices.append(grouped)
        below = grouped.select(
            *keys, F.col("_slice").alias("_pos"), _combined(F.col("_steps"), states).alias("step")
        )

    def started(df: DataFrame, begin: Column) -> DataFrame:
        return df.select(*keys, F.inline(_starts(F.col("_steps"), begin))).withColumnsRenamed(
            {"pos": "_slice", "state": "_state"}
        )

    begun = started(slices[-1], F.lit(start))
    for grouped in reversed(slices[:-1]):
        begun = started(joined(grouped, begun, [*keys, "_slice"]), F.col("_state"))
    # The last level's places are those of the rows, and no two rows share one.
    states_of = begun.select(F.col("_slice").alias("_pos"), F.col("_state").alias("state"))
    return cut.join(states_of, "_pos").select(*rows.columns, "state")
