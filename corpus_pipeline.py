"""A corpus pipeline: language, exact copies, near copies, benchmark passages, then token ids.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept, and returns the rows
it keeps with their columns; the last returns the ids' digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwell.llm import bpe, decontam, exact, jaccard, langid
from rankwell.llm.common import bound_batches, cut_lineage, may_hold, read_table, tokenizer_path, whole_text, without


COMMON_WORDS = 1_000_000


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language could be inferred; null texts and texts without a letter go."""
    bound_batches(spark)
    found = langid.predict(docs, langid.fit(docs), prefix="_langid_")
    return found.where(F.col("_langid_lang_pred") != langid.UNKNOWN).select(*[f"`{c}`" for c in docs.columns])


def one_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id; a row repeated under one id stays once."""
    bound_batches(spark)
    groups = cut_lineage(exact.exact_groups(docs).select("doc_id", "print", "kept"))
    left = without(docs, groups.where("not kept"))
    repeated = groups.where("kept").groupBy("doc_id", "print").count().where("count > 1").select("doc_id", "print")
    if repeated.isEmpty():
        return left
    marked = left.withColumn("_print", F.xxhash64(whole_text()))
    keys = repeated.withColumnRenamed("print", "_print")
    once = may_hold(marked, keys, "_print").dropDuplicates(["doc_id", "text"])
    return may_hold(marked, keys, "_print", keep=False).unionByName(once).drop("_print")


def one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, the row with the smallest doc_id."""
    bound_batches(spark)
    classes = cut_lineage(jaccard.similar_classes(docs).where("not kept").select("doc_id", "print"))
    return without(docs, classes)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    bound_batches(spark)
    found = decontam.contaminated(docs, read_table(spark, sf_dir, "benchmark"))
    return without(docs, cut_lineage(found.select("doc_id", "print").distinct()))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: the number of ids, their hash, and the hash of the bytes they decode to."""
    bound_batches(spark)
    # A smaller table of words than alone: workers still hold what the stages before left them.
    return bpe.encode_decode(docs, tokenizer_path("byte_bpe_50k.tiktoken"), common=COMMON_WORDS)


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", one_of_equal),
    ("ngram_jaccard", one_of_similar),
    ("decontamination", without_benchmark),
    ("byte_bpe", token_ids),
]

# SQL expresses neither the inferred language nor the ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
