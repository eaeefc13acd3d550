"""State in, change in, next state out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_scores(old: DataFrame, new: DataFrame) -> DataFrame:
    """New scores replace old ones of the same (user, record); the explanation is kept."""
    keys = ["user_id", "job_id"]
    values = [c for c in new.columns if c not in keys]
    fresh = new.select(*keys, F.struct(*values).alias("_new"))
    stale = old.select(*keys, F.struct(*values).alias("_old"), "explanation")
    picked = fresh.join(stale, keys, "full")
    chosen = F.coalesce("_new", "_old")
    return picked.select(*keys, *[chosen[c].alias(c) for c in values], "explanation")


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The earliest row of each key; combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    firsts = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return firsts.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def insert_absent(
    table: DataFrame, rows: DataFrame, keys: list[str], order: list[str], other: str | None = None
) -> DataFrame:
    """Rows of ``rows`` whose key is not in the table yet, one per key.

    With ``other`` a second unique column guards as well: a row whose value is already taken,
    in the table or by an earlier row, is left out. A row without such a value collides with none.
    """
    new = first_per_key(rows, keys, order).join(table.select(*keys), keys, "left_anti")
    if other is None:
        return new
    columns = new.columns
    free = new.join(table.select(other).where(F.col(other).isNotNull()), other, "left_anti")
    valued = first_per_key(free.where(F.col(other).isNotNull()), [other], [*keys]).select(*columns)
    return valued.unionByName(free.where(F.col(other).isNull()).select(*columns))


def replace_by_key(table: DataFrame, rows: DataFrame, key: str, touched: DataFrame) -> DataFrame:
    """All rows of the touched keys are replaced by the given ones; other keys stay."""
    kept = table.join(touched.select(key).distinct(), key, "left_anti")
    return kept.unionByName(rows.join(touched.select(key).distinct(), key, "left_semi"))


def clear_missing(rows: DataFrame, column: str, live: DataFrame, live_column: str) -> DataFrame:
    """Sets a reference to null where the referenced row no longer exists."""
    alive = live.select(F.col(live_column).alias(column), F.lit(True).alias("_alive")).distinct()
    return rows.join(alive, column, "left").select(
        *[
            F.when(F.col("_alive"), F.col(column)).alias(column) if c == column else F.col(c)
            for c in rows.columns
        ]
    )


def update_outcomes(profiles: DataFrame, updates: DataFrame) -> DataFrame:
    """Outcome of each update: applied, edit_conflict or not_found.

    An update that names the ``updated_at`` it has read only applies to that version; one that
    names none applies to whatever is there.
    """
    current = profiles.select(
        "user_id", F.col("updated_at").alias("_current"), F.lit(True).alias("_exists")
    )
    expected = F.col("expected_updated_at")
    hit = F.coalesce("_exists", F.lit(False)) & (
        expected.isNull() | F.coalesce(F.col("_current") == expected, F.lit(False))
    )
    outcome = (
        F.when(hit, "applied").when(expected.isNotNull(), "edit_conflict").otherwise("not_found")
    )
    joined = updates.join(current, "user_id", "left").withColumn("outcome", outcome)
    return joined.drop("_current", "_exists")


def apply_updates(
    profiles: DataFrame, updates: DataFrame, fields: list[str], at: Column
) -> DataFrame:
    """Writes only the fields an applied update names; null is a value like any other.

    ``updates`` holds the new values and ``given``, the array of the names that were sent.
    """
    applied = update_outcomes(profiles, updates).where(F.col("outcome") == "applied")
    change = applied.select(
        "user_id", F.struct("given", *fields).alias("_change")
    )
    joined = profiles.join(change, "user_id", "left")
    given = F.col("_change")["given"]

    def next_value(name: str) -> Column:
        if name in fields:
            named = F.coalesce(F.array_contains(given, name), F.lit(False))
            return F.when(named, F.col("_change")[name]).otherwise(F.col(name)).alias(name)
        if name == "updated_at":
            return F.when(given.isNotNull(), at).otherwise(F.col(name)).alias(name)
        return F.col(name)

    return joined.select(*[next_value(c) for c in profiles.columns])


def pending(queue: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """Queued rows whose work is not completed yet: new ones and those that failed before."""
    completed = state.where(F.col("status") == "completed").select(key)
    return queue.join(completed, key, "left_anti")


def after_processing(state: DataFrame, outcomes: DataFrame, key: str) -> DataFrame:
    """Status of every key after a batch: completed, or failed with its last error.

    ``outcomes`` holds one row per processed key with ``error``, null where it went well; the bad
    rows are those a caller puts into quarantine. A completed key stays so whatever is sent again.
    """
    fresh = outcomes.select(key, F.struct(F.col("error").cast("string").alias("error")).alias("_now"))
    rows = state.join(fresh, key, "full")
    ran = F.col("_now").isNotNull() & ~F.coalesce(F.col("status") == "completed", F.lit(False))
    error = F.col("_now")["error"]
    return rows.select(
        key,
        F.when(ran, F.when(error.isNull(), "completed").otherwise("failed"))
        .otherwise(F.col("status")).alias("status"),
        (F.coalesce("attempts", F.lit(0)) + ran.cast("int")).alias("attempts"),
        F.when(ran, error).otherwise(F.col("error")).alias("error"),
    )


def new_accounts(profiles: DataFrame, accounts: DataFrame) -> DataFrame:
    """A profile row for each new account; a clash on id or e-mail adds nothing."""
    rows = accounts.select(
        "user_id",
        F.coalesce(
            "email", F.concat(F.col("user_id").cast("string"), F.lit("@no-email.invalid"))
        ).alias("email"),
        F.nullif("full_name", F.lit("")).alias("full_name"),
    )
    return insert_absent(profiles, rows, ["user_id"], ["email"], other="email")


def orphans(rows: DataFrame, column: str, parents: DataFrame, parent_column: str) -> DataFrame:
    """Rows whose reference points to no parent."""
    return rows.join(
        parents.select(F.col(parent_column).alias(column)), column, "left_anti"
    )


def reference_check(
    lists: DataFrame, key: str, item: str, known: DataFrame, known_column: str, at_least: int = 3
) -> DataFrame:
    """Per key: unknown items, repeated items, item count, and whether the list is acceptable."""
    items = lists.select(key, item)
    known_items = known.select(F.col(known_column).alias(item), F.lit(1).alias("_known")).distinct()
    per_item = items.groupBy(key, item).agg(F.count(F.lit(1)).alias("_times"))
    checked = per_item.join(known_items, item, "left")
    totals = checked.groupBy(key).agg(
        F.sum(F.when(F.col("_known").isNull(), 1).otherwise(0)).alias("unknown_items"),
        F.sum(F.when(F.col("_times") > 1, 1).otherwise(0)).alias("repeated_items"),
        F.count(F.lit(1)).alias("item_count"),
    )
    return totals.withColumn(
        "acceptable",
        (F.col("unknown_items") == 0)
        & (F.col("repeated_items") == 0)
        & (F.col("item_count") >= at_least),
    )
