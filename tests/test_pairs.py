"""What pairs and résumés weigh on their way through a large run."""

from pyspark.sql import functions as F

from rankwell.operators import dedupe, scoring
from rankwell.plans.adapters import VIEWS, sql
from rankwell.plans.queries_ingest import PAYLOAD, TIE, first_lines, hashed, jobs_of, numbered_jobs
from rankwell.plans.queries_match import numbered_pairs, ordered_pairs, spelled
from rankwell.plans.queries_state import resumes_of
from rankwell.plans.registry import Inputs

TABLES = {
    "region": ("r_regionkey int, r_name string", [(0, "EAST"), (1, None)]),
    "nation": ("n_nationkey int, n_regionkey int", [(1, 0), (2, 1)]),
    "supplier": ("s_suppkey long, s_nationkey int", [(1, 1), (2, 2)]),
    "part": (
        "p_partkey long, p_name string, p_brand string, p_type string, p_size int",
        [(1, "Blue bolt", "Brand#1", "PROMO", 4), (2, "Café ring", "Brand#5", "LARGE", 9)],
    ),
    "orders": ("o_orderkey long, o_custkey long", [(1, 7), (2, 8), (2, 9), (3, None), (None, 5)]),
    "lineitem": (
        "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_shipdate date",
        [(o, n, p, s, 1.0, None) for n, (o, p, s) in enumerate(
            [(1, 1, 1), (1, 1, 1), (1, 2, 2), (2, 1, 2), (3, 2, 1), (None, 1, 1), (4, 1, 1), (1, None, 1)]
        )],
    ),
    "customer": ("c_custkey long, c_mktsegment string", [(k, "BUILDING") for k in range(300)]),
}


def inputs(spark, folder):
    for name, (schema, rows) in TABLES.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return Inputs(spark, str(folder))


def test_ordered_pairs_are_packed_and_the_same(spark, tmp_path):
    t = inputs(spark, tmp_path)
    pairs = ordered_pairs(t)
    assert dict(pairs.dtypes)["job_id"] == "binary"
    plain = t.orders.join(hashed(t), F.col("o_orderkey") == F.col("order_key"))
    wanted = plain.select(F.col("o_custkey").alias("user_id"), F.col("dedupe_hash").alias("job_id")).collect()
    found = spelled(pairs).collect()
    assert len(found) == 6
    assert sorted(map(str, found)) == sorted(map(str, wanted))


def test_records_are_found_without_sorting_their_payload(spark, tmp_path):
    t = inputs(spark, tmp_path)
    assert not {"title", "description_text", "source_url"} & set(first_lines(t).select("_line.*", "*").columns)
    # Keys that repeat and a missing title: the records and counts of all sightings.
    part = t.part.unionByName(t.part).unionByName(t.part.where("p_partkey = 2").withColumn("p_name", F.lit(None).cast("string")))
    part.coalesce(1).write.parquet(f"{tmp_path}/twice/part.parquet")
    for name in TABLES:
        if name != "part":
            getattr(t, name).coalesce(1).write.parquet(f"{tmp_path}/twice/{name}.parquet")
    t = Inputs(spark, f"{tmp_path}/twice")
    plain = dedupe.collapse(hashed(t), ["dedupe_hash"], PAYLOAD, "seen_at", TIE)
    found = jobs_of(t).drop("job_id", "posted_at", "status")
    assert found.columns == plain.columns
    assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))
    assert found.count() > 2


def test_pairs_meet_profiles_as_numbers(spark, tmp_path):
    t = inputs(spark, tmp_path)
    pairs = numbered_pairs(t)
    assert dict(pairs.dtypes)["job_no"] == "bigint"
    named = pairs.join(numbered_jobs(t).select("job_no", "job_id"), "job_no").select("user_id", "job_id")
    assert sorted(map(str, named.collect())) == sorted(map(str, spelled(ordered_pairs(t)).collect()))


def test_vectors_of_pairs_stay_as_wide_as_stored(spark):
    profiles = spark.sql("""select 1 as user_id, 'mid' as seniority, 'IN' as country_code, array('remote') as work_modes,
        1.0d as min_salary, 'USD' as salary_currency, 'year' as salary_period, array('x') as blocked_companies,
        array('x') as preferred_companies, array('x') as excluded_keywords, array(1.0f, 2.0f) as embedding""")
    assert dict(scoring.prepare_profiles(profiles).dtypes)["p_embedding"] == "array<float>"


def test_resumes_use_all_cores_whatever_the_file(spark, tmp_path):
    t = inputs(spark, tmp_path)
    rows = resumes_of(t)
    held = rows.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(held) >= spark.sparkContext.defaultParallelism
    wanted = sql(spark, str(tmp_path), VIEWS["resumes"])
    assert sorted(rows.collect()) == sorted(wanted.collect())
