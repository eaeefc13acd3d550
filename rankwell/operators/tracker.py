"""Applications: created once with a snapshot, moved by legal steps, shown as cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwell.constants import BOARD_STAGES, STAGE_MOVES, STAGES, TERMINAL_STAGES
from rankwell.functions.labels import number_text
from rankwell.functions.text import lookup
from rankwell.operators.merges import first_per_key
from rankwell.operators.ordered import joined, replay, with_previous, with_row_number

# --- fixed values: the record fields a snapshot keeps --------------------------------------
SNAPSHOT = [
    "title", "company_name", "company_domain", "location_raw", "salary_min", "salary_max",
    "salary_currency", "salary_period", "posted_at", "seniority", "employment_type", "work_mode",
    "skills", "source_url",
]


def first_actions(actions: DataFrame) -> DataFrame:
    """Repeated actions on the same record count once, at their first time."""
    return first_per_key(
        actions.select("user_id", "job_id", "event", "acted_at", "event_id"),
        ["user_id", "job_id", "event"],
        ["acted_at", "event_id"],
    )


def new_actions(log: DataFrame, actions: DataFrame) -> DataFrame:
    """Actions that the log does not hold yet."""
    return first_actions(actions).join(log, ["user_id", "job_id", "event"], "left_anti")


def apply_once(applications: DataFrame, requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """New applications with a snapshot of the record; one per (user, record), first request.

    A request for an unknown record creates nothing. Further columns of the request, such as
    ``next_action_at``, ``notes`` or ``resume_version_id``, are kept.
    """
    keys = ["user_id", "job_id"]
    wanted = first_per_key(requests, keys, ["applied_at", "request_id"])
    fields = [c for c in SNAPSHOT if c in jobs.columns]
    snapshot = jobs.select("job_id", F.struct(*fields).alias("job_snapshot"))
    return (
        wanted.join(applications.select(*keys), keys, "left_anti")
        .join(snapshot, "job_id")
        .withColumn("stage", F.lit("applied"))
    )


def first_history(
    applications: DataFrame, history: DataFrame, keys: tuple[str, ...] = ("user_id", "job_id")
) -> DataFrame:
    """The first history row, from no stage to ``applied``, of applications that have none yet.

    A request that is sent again adds nothing, and one whose history was lost half way gets it.
    """
    begun = history.where(F.col("from_stage").isNull() & (F.col("to_stage") == "applied"))
    return applications.join(begun.select(*keys).distinct(), list(keys), "left_anti").select(
        *keys,
        F.lit(None).cast("string").alias("from_stage"),
        F.lit("applied").alias("to_stage"),
        F.col("notes").alias("note"),
        F.col("applied_at").alias("acted_at"),
    )


def move_table(spark: SparkSession) -> DataFrame:
    """Legal (from, to) moves."""
    rows = [(a, b) for a, targets in STAGE_MOVES.items() for b in targets]
    return spark.createDataFrame(rows, "from_stage string, to_stage string")


def _steps() -> dict[str, list[int]]:
    """For each requested stage, the stage that follows from every present one."""
    place = {stage: i for i, stage in enumerate(STAGES)}
    return {
        to: [place[to] if to in STAGE_MOVES[now] else place[now] for now in STAGES]
        for to in STAGES
    }


def replay_moves(
    requests: DataFrame,
    order: list[str],
    start: str = "discovered",
    key: str = "application_id",
    slice_rows: int = 200,
) -> DataFrame:
    """Applies stage requests in order; each gets its from-stage, and a reason when refused."""
    table = {to: F.array(*[F.lit(i) for i in steps]) for to, steps in _steps().items()}
    pairs = [part for to, steps in table.items() for part in (F.lit(to), steps)]
    step = F.try_element_at(F.create_map(*pairs), F.col("to_stage"))
    done = replay(requests, [key], order, step, len(STAGES), STAGES.index(start), slice_rows)
    now = F.get(F.array(*[F.lit(s) for s in STAGES]), F.col("state"))
    legal = lookup(now, {s: ",".join([*m, ""]) for s, m in STAGE_MOVES.items()})
    reason = (
        F.when(now == F.col("to_stage"), "already_in_stage")
        .when(now.isin(TERMINAL_STAGES), "terminal_stage")
        .when(~F.concat(F.lit(","), legal).contains(F.concat(F.lit(","), "to_stage", F.lit(","))),
              "illegal_move")
    )
    return (
        done.withColumn("from_stage", now)
        .withColumn("reason", reason)
        .withColumn("accepted", F.col("reason").isNull())
        .drop("state")
    )


def refuse_strangers(requests: DataFrame, owners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Splits requests into those of the owner, and the rest with one common reason."""
    owned = owners.select("application_id", F.col("user_id").alias("_owner"))
    checked = requests.join(owned, "application_id", "left").withColumn(
        "_mine", F.coalesce(F.col("_owner") == F.col("user_id"), F.lit(False))
    )
    mine = checked.where(F.col("_mine")).drop("_owner", "_mine")
    other = checked.where(~F.col("_mine")).drop("_owner", "_mine")
    return mine, other.withColumn("reason", F.lit("not_found"))


def current_stage(moves: DataFrame, key: str = "application_id") -> DataFrame:
    """Latest accepted stage of each application and the time of its last move."""
    return (
        moves.where(F.col("accepted"))
        .groupBy(key)
        .agg(
            F.max_by("to_stage", F.struct("acted_at", "event_id")).alias("stage"),
            F.max("acted_at").alias("updated_at"),
            F.count(F.lit(1)).alias("moves"),
        )
    )


def apply_moves(
    applications: DataFrame, moves: DataFrame, key: str = "application_id"
) -> DataFrame:
    """Applications after their moves; one that was moved to ``applied`` has no next action.

    Applications without an accepted move stay as they are.
    """
    latest = moves.where(F.col("accepted")).groupBy(key).agg(
        F.max_by("to_stage", F.struct("acted_at", "event_id")).alias("_stage"),
        F.max("acted_at").alias("_at"),
        F.max(F.col("to_stage") == "applied").alias("_applied"),
    )
    return (
        applications.join(latest, key, "left")
        .withColumn("stage", F.coalesce("_stage", "stage"))
        .withColumn("updated_at", F.coalesce("_at", "updated_at"))
        .withColumn(
            "next_action_at",
            F.when(~F.coalesce("_applied", F.lit(False)), F.col("next_action_at")),
        )
        .drop("_stage", "_at", "_applied")
    )


def newest_first(rows: DataFrame, keys: list[str], order: list[str], name: str = "position") -> DataFrame:
    """Rows from the latest to the earliest within each key, numbered from 1 in that order.

    Safe for a key of any length: numbers come from the ascending order and a count per key.
    """
    numbered = with_row_number(rows, keys, order, "_number")
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_count"))
    placed = joined(numbered, counts, keys).withColumn(name, F.col("_count") - F.col("_number") + 1)
    return placed.drop("_count", "_number").orderBy(*keys, name)


def version_list(users: DataFrame, versions: DataFrame) -> DataFrame:
    """Résumé versions of every user, newest first, shown by the last part of their path.

    A user without one has a single row with nulls.
    """
    listed = newest_first(versions, ["user_id"], ["created_at", "resume_version_id"]).select(
        "user_id", "resume_version_id", "created_at", "position",
        F.element_at(F.split("file_path", "/"), -1).alias("name"),
    )
    return users.select("user_id").distinct().join(listed, "user_id", "left")


def profile_catalogue(profiles: DataFrame, skills: DataFrame, selected: DataFrame) -> DataFrame:
    """Every profile with every skill of the catalogue, by name, and its own level of it.

    The catalogue is a short list shown whole to each profile; it travels inside the row, so the
    profiles are not shuffled for it. A selected skill without a known level counts as
    ``proficient``.
    """
    entry = F.struct("name", "slug", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))
    catalogue = skills.groupBy().agg(F.array_sort(F.collect_list(entry)).alias("all")).scalar()
    level = F.when(F.col("level").isin("familiar", "expert"), F.col("level")).otherwise("proficient")
    own = selected.groupBy("user_id", "skill_id").agg(F.max(level).alias("level"))
    levels = own.groupBy("user_id").agg(
        F.map_from_entries(F.collect_list(F.struct("skill_id", "level"))).alias("_levels")
    )
    rows = profiles.join(levels, "user_id", "left").withColumn("_all", catalogue)
    return (
        rows.select(*profiles.columns, "_levels", F.inline("_all"))
        .withColumn("level", F.try_element_at("_levels", F.col("slug")))
        .withColumn("selected", F.col("level").isNotNull())
        .drop("_levels")
    )


def timeline(history: DataFrame, key: str = "application_id") -> DataFrame:
    """Stage history with the stage before each entry, taken from the entry before it."""
    return with_previous(history, [key], ["acted_at", "event_id"], ["to_stage", "acted_at"])


def board_counts(spark: SparkSession, cards: DataFrame) -> DataFrame:
    """Cards in each board column, empty columns included."""
    columns = spark.createDataFrame(list(enumerate(BOARD_STAGES)), "position long, stage string")
    counts = cards.groupBy("stage").agg(F.count(F.lit(1)).alias("cards"))
    return columns.join(counts, "stage", "left").select(
        "position", "stage", F.coalesce("cards", F.lit(0)).alias("cards")
    )


def cards(applications: DataFrame, jobs: DataFrame) -> DataFrame:
    """Applications with the live record's fields, or the snapshot's when it is gone."""
    live = jobs.select(
        "job_id", F.struct("title", "company_name", "salary_min", "salary_currency").alias("_live")
    )
    shown = applications.join(live, "job_id", "left")
    pick = lambda name: F.coalesce(F.col("_live")[name], F.col("job_snapshot")[name])
    salary = F.concat(
        number_text(pick("salary_min")),
        F.coalesce(F.concat(F.lit(" "), pick("salary_currency")), F.lit("")),
    )
    return (
        shown.withColumn("job_live", F.col("_live").isNotNull())
        .withColumn("title", pick("title"))
        .withColumn("company", pick("company_name"))
        .withColumn("salary", salary)
        .drop("_live")
    )


def job_detail(
    jobs: DataFrame, scores: DataFrame, applications: DataFrame, viewers: DataFrame
) -> DataFrame:
    """Record, score and application for each (user, record) looked at.

    The sightings of a record are a list without bound, so they stay rows of their own
    (see :func:`sighting_list`).
    """
    keys = ["user_id", "job_id"]
    mine = scores.select(*keys, "final_score", "rule_score")
    own = applications.select(*keys, F.col("stage").alias("application_stage"))
    return (
        viewers.select(*keys)
        .distinct()
        .join(jobs, "job_id")
        .join(mine, keys, "left")
        .join(own, keys, "left")
    )


def sighting_list(sightings: DataFrame, viewers: DataFrame | None = None) -> DataFrame:
    """Sightings as rows, newest first within each record."""
    rows = sightings
    if viewers is not None:
        rows = rows.join(viewers.select("job_id").distinct(), "job_id", "left_semi")
    return rows.orderBy("job_id", F.desc("last_seen_at"), "source_url")
