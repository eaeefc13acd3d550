"""Gates, weighted rules and semantic blend for (profile, record) pairs.

Every score of a pair is computed inside its row from three small things: the columns of the
record, the columns of the profile, and arrays bounded by the record itself (its skills and the
excluded keywords found in it). After the pairs exist there is no further shuffle.

Pairs come from one of two equi-joins:

* :func:`given_pairs` scores the pairs of a table (a log, a request list);
* :func:`eligible_pairs` finds, for every profile, all records that pass the work-mode and
  seniority gates, by a join on the gate class. Records a profile rules out are not paired.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankwell.constants import (
    DEFAULT_LEVEL,
    GATE_CODES,
    GLOBAL_REMOTE_RAW,
    INDIA_REMOTE_ELSEWHERE_RAW,
    LEVEL_MULTIPLIER,
    LOCATION_SHARE,
    MODE_SHARE,
    MODEL_VERSION,
    NEUTRAL_RAW,
    OTHER_MODE_RAW,
    OTHER_PLACE_RAW,
    RECENCY_HORIZON_DAYS,
    REMOTE_ELSEWHERE_RAW,
    RULE_WEIGHTS,
    SEMANTIC_BLEND,
    SENIORITIES,
    SENIORITY_SPAN,
    UNKNOWN_MODE_RAW,
    WORK_MODES,
)
from rankwell.functions.company import company_candidates
from rankwell.functions.labels import component_label, score_band
from rankwell.functions.parse import annual_amount, seniority_rank
from rankwell.functions.skills import skill_tags
from rankwell.functions.text import clamp, let, lookup, round2, trimmed
from rankwell.functions.vectors import cosine_percent, norm
from rankwell.session import broadcast_if_small, small_enough

if sum(w for _, w in RULE_WEIGHTS) != 100:
    raise ValueError("rule weights must sum to 100")

# Upper bound, in rows, for prepared records or profiles that are sent whole to every executor:
# with a vector and their arrays they are about a kilobyte each.
BROADCAST_PREPARED = 100_000

SCORE_COLUMNS = [
    "user_id", "job_id", "final_score", "rule_score", "semantic_score", "gate_passed",
    "gate_reasons", "breakdown", "model_version", "scored_at",
]


# --- records and profiles, prepared once per run -----------------------------------------------


def derive_job_skills(jobs: DataFrame) -> DataFrame:
    """(job, skill, weight) rows from the text of each record; every weight is 1."""
    tags = skill_tags(F.col("title"), F.col("description_text"))
    return jobs.select("job_id", F.explode(tags).alias("skill_id")).withColumn(
        "weight", F.lit(1.0)
    )


def distinct_keywords(keywords: DataFrame, keyword: str = "keyword") -> DataFrame:
    """Clean distinct keywords with the word each must share with a record it occurs in.

    A phrase can only occur where its first run of word characters is a whole word (or, without
    any, where its first sign occurs).
    """
    return (
        keywords.select(F.lower(trimmed(F.col(keyword))).alias("keyword"))
        .where(F.col("keyword") != "")
        .distinct()
        .withColumn(
            "token",
            F.coalesce(
                F.nullif(F.regexp_extract("keyword", r"\w+", 0), F.lit("")),
                F.left("keyword", F.lit(1)),
            ),
        )
    )


def _tokens() -> Column:
    return F.array_distinct(F.regexp_extract_all(_haystack(), F.lit(r"\w+|[^\w\s]"), F.lit(0)))


def with_keyword_hits(jobs: DataFrame, keywords: DataFrame, few: int = 2_000) -> DataFrame:
    """Adds ``keyword_hits``: the excluded keywords that occur in the record.

    Each distinct keyword is matched once per record, whatever the number of profiles using it.
    Up to ``few`` keywords (counted first) travel inside each row, which needs no shuffle.
    Beyond that, words and keywords meet in an equi-join on the shared word.
    """
    wanted = distinct_keywords(keywords)
    if small_enough(wanted, few):
        listed = wanted.groupBy().agg(F.collect_list(F.struct("keyword", "token"))).scalar()

        def shared(k):
            words = F.array_intersect(_tokens(), F.transform(k, lambda x: x["token"]))
            return let(
                words,
                lambda w: F.transform(
                    F.filter(k, lambda x: F.array_contains(w, x["token"])), lambda x: x["keyword"]
                ),
            )

        found = jobs.withColumn("_listed", listed).withColumn(
            "keyword_hits", shared(F.col("_listed"))
        )
    else:
        hits = (
            jobs.select("job_id", F.explode(_tokens()).alias("token"))
            .join(broadcast_if_small(wanted), "token")
            .groupBy("job_id")
            .agg(F.collect_set("keyword").alias("keyword_hits"))
        )
        found = jobs.join(hits, "job_id", "left")
    kept = F.filter("keyword_hits", lambda k: _holds_phrase(_haystack(), k))
    return found.withColumn(
        "keyword_hits", F.coalesce(kept, F.array().cast("array<string>"))
    )


def _haystack() -> Column:
    return F.lower(
        F.concat(F.col("title"), F.lit(" "), F.coalesce("description_text", F.lit("")))
    )


def _holds_phrase(hay: Column, phrase: Column) -> Column:
    """Whole-phrase match; word boundaries only at ends that are word characters."""
    literal = F.regexp_replace(phrase, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    regex = F.concat(
        F.when(phrase.rlike(r"^\w"), r"(?<!\w)").otherwise(""),
        literal,
        F.when(phrase.rlike(r"\w$"), r"(?!\w)").otherwise(""),
    )
    return phrase.rlike(r"^\w+$") | F.regexp_like(hay, regex)


def prepare_jobs(
    jobs: DataFrame, job_skills: DataFrame | None = None, keywords: DataFrame | None = None,
    job_key: str = "job_id",
) -> DataFrame:
    """Columns the rules need from a record, text reduced to its keyword hits."""
    if job_skills is None:
        tags = skill_tags(F.col("title"), F.col("description_text"))
        one_each = F.transform(
            tags, lambda tag: F.struct(tag.alias("skill_id"), F.lit(1.0).alias("weight"))
        )
        ready = jobs.withColumn("_asked", F.when(F.size(tags) > 0, one_each))
    else:
        weight = F.coalesce("weight", F.lit(1.0)).cast("double").alias("weight")
        per_job = job_skills.groupBy("job_id").agg(
            F.array_sort(F.collect_list(F.struct("skill_id", weight))).alias("_asked")
        )
        ready = jobs.join(per_job, "job_id", "left")
    if keywords is None:
        ready = ready.withColumn("keyword_hits", F.array().cast("array<string>"))
    else:
        ready = with_keyword_hits(ready, keywords)
    top = F.array_max(F.transform("_asked", lambda s: s["weight"]))
    advertised = F.coalesce("salary_max", "salary_min").cast("double")
    vector = F.col("embedding") if "embedding" in jobs.columns else F.lit(None).cast("array<double>")
    asked = F.when(
        top > 0,
        F.transform(
            "_asked",
            lambda s: F.struct(
                s["skill_id"].alias("skill_id"), clamp(s["weight"] / top, 0, 1).alias("share")
            ),
        ),
    )
    return ready.withColumn("asked", asked).select(
        *dict.fromkeys(["job_id", job_key]),
        F.coalesce("work_mode", F.lit("unknown")).alias("work_mode"),
        F.coalesce("remote_scope", F.lit("unknown")).alias("remote_scope"),
        F.upper("country_code").alias("country_code"),
        "posted_at",
        seniority_rank(F.col("seniority")).alias("rank"),
        F.upper("salary_currency").alias("currency"),
        annual_amount(advertised, F.col("salary_period")).alias("annual"),
        company_candidates(F.col("company_name"), F.col("company_domain")).alias("companies"),
        "keyword_hits",
        "asked",
        F.aggregate("asked", F.lit(0.0), lambda acc, x: acc + x["share"]).alias("asked_total"),
        vector.alias("embedding"),  # as stored: single precision is half as wide for each pair
        norm(vector).alias("norm"),
    )


def prepare_profiles(profiles: DataFrame, profile_skills: DataFrame | None = None) -> DataFrame:
    """Columns the rules need from a profile, prefixed with ``p_``."""
    empty = F.array().cast("array<string>")
    if profile_skills is None:
        ready = profiles.withColumn("_levels", F.lit(None).cast("map<string,double>"))
    else:
        factor = F.coalesce(
            lookup(F.coalesce("level", F.lit(DEFAULT_LEVEL)), LEVEL_MULTIPLIER),
            F.lit(LEVEL_MULTIPLIER[DEFAULT_LEVEL]),
        )
        one_each = profile_skills.groupBy("user_id", "skill_id").agg(F.max(factor).alias("factor"))
        levels = one_each.groupBy("user_id").agg(
            F.map_from_entries(F.collect_list(F.struct("skill_id", "factor"))).alias("_levels")
        )
        ready = profiles.join(levels, "user_id", "left")
    vector = F.col("embedding") if "embedding" in profiles.columns else F.lit(None).cast("array<double>")
    floor = F.col("min_salary").cast("double")
    return ready.select(
        "user_id",
        seniority_rank(F.col("seniority")).alias("p_rank"),
        F.upper("country_code").alias("p_country"),
        F.coalesce("work_modes", empty).alias("p_modes"),
        F.upper("salary_currency").alias("p_currency"),
        annual_amount(floor, F.col("salary_period")).alias("p_floor"),
        F.coalesce("blocked_companies", empty).alias("p_blocked"),
        F.coalesce("preferred_companies", empty).alias("p_preferred"),
        F.transform(
            F.coalesce("excluded_keywords", empty), lambda k: F.lower(trimmed(k))
        ).alias("p_keywords"),
        F.col("_levels").alias("p_levels"),
        vector.alias("p_embedding"),
        norm(vector).alias("p_norm"),
    )


# --- pairs ------------------------------------------------------------------------------------------


def given_pairs(
    pairs: DataFrame, jobs: DataFrame, profiles: DataFrame, few: int = BROADCAST_PREPARED, job_key: str = "job_id"
) -> DataFrame:
    """Prepared columns of both sides for each pair of ``user_id`` and ``job_key``.

    A side that is counted and found small enough is broadcast, and joined last: the pairs then
    meet the other side as two keys, and no prepared columns of a pair are shuffled.
    """
    distinct = pairs.select("user_id", job_key).distinct()
    if small_enough(jobs.select(job_key), few):
        return distinct.join(profiles, "user_id").join(F.broadcast(jobs), job_key)
    if small_enough(profiles.select("user_id"), few):
        return distinct.join(jobs, job_key).join(F.broadcast(profiles), "user_id")
    return distinct.join(profiles, "user_id").join(jobs, job_key)


def eligible_pairs(jobs: DataFrame, profiles: DataFrame, spread: int = 16) -> DataFrame:
    """All pairs that pass the work-mode and seniority gates, by an equi-join on both.

    A profile is repeated for each (mode, rank) class it accepts, a record belongs to one class.
    When the profiles are few enough (counted first) they are broadcast. The records are then
    spread evenly by their id, because each one fans out to many pairs. Otherwise both sides
    shuffle on the class, and since there are only forty classes and one may hold a third of the
    records, each class is cut into ``spread`` parts by a hash of the record.
    """
    modes = F.array(*[F.lit(m) for m in WORK_MODES])
    ranks = F.sequence(F.lit(-1), F.lit(len(SENIORITIES) - 1))
    open_mode = F.filter(
        modes, lambda m: (F.size("p_modes") == 0) | (m == "unknown") | F.array_contains("p_modes", m)
    )
    open_rank = F.filter(ranks, lambda r: F.col("p_rank").isNull() | (r <= F.col("p_rank") + 1))
    wide = profiles.withColumn("_mode", F.explode(open_mode)).withColumn(
        "_rank", F.explode(open_rank)
    )
    keyed = jobs.withColumn("_mode", F.col("work_mode")).withColumn(
        "_rank", F.coalesce("rank", F.lit(-1))
    )
    if small_enough(wide):
        tasks = int(jobs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        pairs = keyed.repartition(tasks, "job_id").join(F.broadcast(wide), ["_mode", "_rank"])
    else:
        slots = F.sequence(F.lit(0), F.lit(spread - 1))
        pairs = keyed.withColumn(
            "_slot", F.pmod(F.xxhash64("job_id"), F.lit(spread)).cast("int")
        ).join(wide.withColumn("_slot", F.explode(slots)), ["_mode", "_rank", "_slot"])
    return pairs.drop("_mode", "_rank", "_slot")


# --- gates -----------------------------------------------------------------------------------------------


def _false(condition: Column) -> Column:
    """Missing data never fires a gate."""
    return F.coalesce(condition, F.lit(False))


def gate_columns() -> dict[str, Column]:
    same_money = F.col("currency") == F.col("p_currency")
    return {
        "blocked_company": F.arrays_overlap("companies", "p_blocked"),
        "excluded_keyword": F.arrays_overlap("keyword_hits", "p_keywords"),
        "work_mode_mismatch": (F.size("p_modes") > 0)
        & (F.col("work_mode") != "unknown")
        & ~F.array_contains("p_modes", F.col("work_mode")),
        "salary_below_floor": same_money & (F.col("annual") < F.col("p_floor")),
        "seniority_over_band": F.col("rank") > F.col("p_rank") + 1,
    }


def gate_reasons() -> Column:
    """Codes of all gates that fire, in fixed order; empty when the pair passes."""
    fired = gate_columns()
    return F.array_compact(
        F.array(*[F.when(_false(fired[code]), F.lit(code)) for code in GATE_CODES])
    )


# --- rule components ----------------------------------------------------------------------------------------


def _sub(raw: Column, known: Column) -> tuple[Column, Column]:
    """Raw value and known flag of a sub-score, neutral where it cannot be judged."""
    sure = _false(known & raw.isNotNull())
    return F.when(sure, clamp(raw, 0, 1)).otherwise(NEUTRAL_RAW), sure


def skills_part() -> tuple[Column, Column]:
    earned = F.aggregate(
        "asked",
        F.lit(0.0),
        lambda acc, s: acc
        + s["share"] * F.coalesce(F.try_element_at("p_levels", s["skill_id"]), F.lit(0.0)),
    )
    raw = F.when(F.col("asked_total") > 0, earned / F.col("asked_total"))
    return _sub(raw, F.size("p_levels") > 0)


def seniority_part() -> tuple[Column, Column]:
    gap = F.abs(F.col("rank") - F.col("p_rank"))
    return _sub(1 - gap / F.lit(float(SENIORITY_SPAN)), gap.isNotNull())


def compensation_part() -> tuple[Column, Column]:
    ratio = F.when(F.col("p_floor") > 0, F.col("annual") / F.col("p_floor"))
    return _sub(ratio, F.col("currency") == F.col("p_currency"))


def place_part() -> tuple[Column, Column]:
    """Work mode and country as one component; known only when both halves are."""
    job_mode, scope = F.col("work_mode"), F.col("remote_scope")
    no_choice = F.size("p_modes") == 0
    accepted = F.array_contains("p_modes", job_mode)
    mode = (
        F.when(no_choice, NEUTRAL_RAW)
        .when(job_mode == "unknown", UNKNOWN_MODE_RAW)
        .when(accepted, 1.0)
        .otherwise(OTHER_MODE_RAW)
    )
    no_place = F.col("p_country").isNull() | F.col("country_code").isNull()
    india = F.when(F.col("p_country") == "IN", 1.0).otherwise(INDIA_REMOTE_ELSEWHERE_RAW)
    place = (
        F.when(no_place, NEUTRAL_RAW)
        .when(F.col("country_code") == F.col("p_country"), 1.0)
        .when(
            job_mode.isin("remote", "hybrid"),
            F.when(scope == "global", GLOBAL_REMOTE_RAW)
            .when(scope == "india", india)
            .otherwise(REMOTE_ELSEWHERE_RAW),
        )
        .otherwise(OTHER_PLACE_RAW)
    )
    known = ~no_choice & (job_mode != "unknown") & ~no_place
    return clamp(mode * MODE_SHARE + place * LOCATION_SHARE, 0, 1), known


def recency_part(now: Column) -> tuple[Column, Column]:
    age = (F.unix_micros(now) - F.unix_micros("posted_at")) / F.lit(86_400_000_000.0)
    raw = F.when(age < 0, 1.0).otherwise(1 - age / F.lit(float(RECENCY_HORIZON_DAYS)))
    return _sub(raw, F.col("posted_at").isNotNull())


def company_part() -> tuple[Column, Column]:
    hit = F.when(F.arrays_overlap("companies", "p_preferred"), 1.0).otherwise(0.0)
    return _sub(hit, (F.size("p_preferred") > 0) & (F.size("companies") > 0))


# --- composition -----------------------------------------------------------------------------------------------


def breakdown_array() -> Column:
    """The parts as an array, from the raw value, the points and the known flag of each."""
    return F.array(
        *[
            F.struct(
                F.lit(key).alias("key"),
                F.lit(float(weight)).alias("weight"),
                round2(F.col(f"_raw {key}")).alias("raw"),
                F.col(f"_points {key}").alias("points"),
                F.col(f"_known {key}").alias("known"),
            )
            for key, weight in RULE_WEIGHTS
        ]
    )


def with_scores(pairs: DataFrame, now: str) -> DataFrame:
    """Adds gates, breakdown, rule score and final score to prepared pairs.

    ``now`` is an ISO timestamp. A gated pair keeps its rule and semantic score and gets the
    final score 0. Every sub-score is a plain column, so a query that does not read the
    breakdown does not build it.
    """
    clock = F.lit(now).cast("timestamp")
    parts = [
        skills_part(), seniority_part(), compensation_part(), place_part(),
        recency_part(clock), company_part(),
    ]
    judged, points = {}, {}
    for (key, weight), (raw, known) in zip(RULE_WEIGHTS, parts):
        judged[f"_raw {key}"], judged[f"_known {key}"] = raw, known
        points[f"_points {key}"] = round2(F.col(f"_raw {key}") * float(weight))
    total = sum((F.col(name) for name in points), F.lit(0.0))
    semantic = cosine_percent(*[F.col(c) for c in ("embedding", "p_embedding", "norm", "p_norm")])
    rule = F.col("rule_score")
    blend = F.when(F.col("semantic_score").isNull(), rule).otherwise(
        rule * (1 - SEMANTIC_BLEND) + clamp(F.col("semantic_score"), 0, 100) * SEMANTIC_BLEND
    )
    fired = gate_columns()
    passed = F.lit(True)
    for code in GATE_CODES:
        passed = passed & ~_false(fired[code])
    return (
        pairs.withColumns({**judged, "gate_passed": passed, "semantic_score": semantic})
        .withColumns(points)
        .withColumn("rule_score", round2(total))
        .withColumn(
            "final_score", F.when(F.col("gate_passed"), round2(clamp(blend, 0, 100))).otherwise(0.0)
        )
        .withColumns(
            {
                "gate_reasons": gate_reasons(),
                "breakdown": breakdown_array(),
                "model_version": F.lit(MODEL_VERSION),
                "scored_at": clock,
            }
        )
        .select(*SCORE_COLUMNS)
    )


def profile_keywords(profiles: DataFrame) -> DataFrame:
    return profiles.select(F.explode("excluded_keywords").alias("keyword"))


def score_given(
    pairs: DataFrame,
    jobs: DataFrame,
    profiles: DataFrame,
    now: str,
    job_skills: DataFrame | None = None,
    profile_skills: DataFrame | None = None,
    job_key: str = "job_id",
) -> DataFrame:
    """Scores for the pairs of a table, gated pairs included.

    Pairs may name a record by another column of ``jobs`` that tells records apart, such as a number.
    """
    ready_jobs = prepare_jobs(jobs, job_skills, profile_keywords(profiles), job_key)
    return with_scores(
        given_pairs(pairs, ready_jobs, prepare_profiles(profiles, profile_skills), job_key=job_key), now
    )


def checked(records: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Casts text columns to their kinds; adds ``faults``, the columns whose text does not fit.

    A value that does not fit becomes null, a missing value is no fault.
    """
    casts = {name: F.col(name).try_cast(kind) for name, kind in kinds.items()}
    faults = F.array_compact(
        F.array(
            *[F.when(F.col(n).isNotNull() & cast.isNull(), F.lit(n)) for n, cast in casts.items()]
        )
    )
    return records.withColumn("faults", faults).withColumns(casts)


def score_checked(
    pairs: DataFrame,
    records: DataFrame,
    kinds: dict[str, str],
    profiles: DataFrame,
    now: str,
    job_skills: DataFrame | None = None,
    profile_skills: DataFrame | None = None,
) -> DataFrame:
    """Scores of given pairs over records as they came in.

    One bad record costs only its own pairs: they stay as rows with ``faults`` and without a
    score, so a caller keeps them apart by ``faults is not null``. Pairs of unknown records or
    profiles give no row.
    """
    typed = checked(records, kinds)
    bad = F.size("faults") > 0
    scores = score_given(
        pairs, typed.where(~bad).drop("faults"), profiles, now, job_skills, profile_skills
    ).withColumn("faults", F.lit(None).cast("array<string>"))
    asked = pairs.select("user_id", "job_id").distinct()
    failed = (
        asked.join(typed.where(bad).select("job_id", "faults"), "job_id")
        .join(profiles.select("user_id"), "user_id", "left_semi")
        .withColumn("scored_at", F.lit(now).cast("timestamp"))
    )
    return scores.unionByName(failed, allowMissingColumns=True)


def run_counters() -> list[Column]:
    """Counters of a run over rows of :func:`score_checked`, for ``agg`` or ``observe``."""
    good = F.col("faults").isNull()
    return [
        F.count_if(good).alias("scored"),
        F.count_if(~good).alias("failed"),
        F.count_if(good & ~F.col("gate_passed")).alias("gated"),
    ]


def score_all(
    jobs: DataFrame,
    profiles: DataFrame,
    now: str,
    job_skills: DataFrame | None = None,
    profile_skills: DataFrame | None = None,
    active_only: bool = False,
) -> DataFrame:
    """Scores for every profile and every record its work-mode and seniority gates let through.

    Pairs stopped by the other three gates are kept with final score 0. Pairs stopped by these
    two are counted by :func:`gate_totals` and explained by :func:`score_given`; writing them
    all out would be the full product of both tables.
    """
    if active_only:
        jobs = jobs.where(F.col("status") == "active")
    ready_jobs = prepare_jobs(jobs, job_skills, profile_keywords(profiles))
    return with_scores(
        eligible_pairs(ready_jobs, prepare_profiles(profiles, profile_skills)), now
    )


def gate_totals(jobs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Per profile: records ruled out by work mode, by seniority, by both, and eligible ones.

    Records are counted per (mode, rank) class first, so forty rows meet the profiles.
    """
    counts = (
        jobs.groupBy(
            F.col("work_mode").alias("mode"),
            F.coalesce("rank", F.lit(-1)).alias("rank"),
        )
        .count()
        .groupBy()
        .agg(F.collect_list(F.struct("mode", "rank", "count")).alias("classes"))
    )
    classes = counts.select("classes").scalar()
    mode_out = lambda c: (
        (F.size("p_modes") > 0) & (c["mode"] != "unknown") & ~F.array_contains("p_modes", c["mode"])
    )
    rank_out = lambda c: (c["rank"] >= 0) & _false(c["rank"] > F.col("p_rank") + 1)

    def total(keep):
        return F.aggregate(
            F.filter("classes", keep), F.lit(0).cast("bigint"), lambda acc, c: acc + c["count"]
        )

    return profiles.withColumn("classes", classes).select(
        "user_id",
        total(lambda c: mode_out(c) & ~rank_out(c)).alias("mode_only"),
        total(lambda c: ~mode_out(c) & rank_out(c)).alias("seniority_only"),
        total(lambda c: mode_out(c) & rank_out(c)).alias("both"),
        total(lambda c: ~mode_out(c) & ~rank_out(c)).alias("eligible"),
    )


def breakdown_rows(scores: DataFrame) -> DataFrame:
    """One row per component with label, percent of the weight and points."""
    rows = scores.select("user_id", "job_id", F.inline("breakdown"))
    return rows.select(
        "user_id",
        "job_id",
        "key",
        component_label(F.col("key")).alias("label"),
        "weight",
        "raw",
        "points",
        F.when(F.col("weight") > 0, F.col("points") / F.col("weight") * 100)
        .otherwise(0.0)
        .alias("percent"),
        "known",
    )


def band_counts(scores: DataFrame) -> DataFrame:
    return scores.groupBy(score_band(F.col("final_score")).alias("band")).agg(
        F.count(F.lit(1)).alias("pairs")
    )


def coverage(scored: Column, total: Column) -> Column:
    """Share of attempted pairs with a score, 1 when nothing was attempted."""
    return F.when(total <= 0, 1.0).otherwise(round2(scored / total))

