"""Registered queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwell.llm import (
    bpe, counts, decontam, divergence, exact, fim, html_crf, jaccard, langid, licences, simhash, tokens, weak_quality,
)
from rankwell.llm.common import bound_batches, read_table, tokenizer_path

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_files(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), limit=512)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract(read_table(spark, sf_dir, "pages"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak-label posterior, score and decision of every document."""
    return weak_quality.quality(read_table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document."""
    return jaccard.similar_classes(read_table(spark, sf_dir, "documents")).drop("print", "kept")


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and licence that it states."""
    return licences.licences_of(read_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and test item that it holds."""
    found = decontam.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.drop("print")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_of(read_table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(read_table(spark, sf_dir, "documents")).drop("print")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(read_table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fim.restored(fim.rearranged(read_table(spark, sf_dir, "documents")))
    digests = [F.sha2(name, 256).alias(f"{name}_sha256") for name in ("output", "restored")]
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return divergence.audit(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_token_files,
        op2_token_counts,
        op3_html_text,
        op4_quality,
        op5_byte_bpe,
        op6_ngram_jaccard,
        op7_licences,
        op8_decontamination,
        op9_language_id,
        op10_exact_dedup,
        op11_simhash,
        op12_fill_in_middle,
        op13_source_divergence,
    )
}

ORACLES: dict[str, str] = {
    "op10_exact_dedup": """
        select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
               doc_id = max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
        from documents
        window same as (partition by coalesce(text, ''))
    """,
    "op12_fill_in_middle": """
        with named as (
            select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n,
                   sha256('1:' || coalesce(doc_id::varchar, '')) as name
            from documents
        ), drawn as (
            select *, ('0x' || substr(name, 1, 8))::bigint % (n + 1) as a, ('0x' || substr(name, 9, 8))::bigint % (n + 1) as b,
                   ('0x' || substr(name, 17, 8))::bigint % 100 as kept, ('0x' || substr(name, 25, 8))::bigint % 100 as first
            from named
        ), formed as (
            select *, least(a, b) as x, greatest(a, b) as y,
                   case when n = 0 or kept >= 90 or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>')
                        then 'plain' when first < 20 then 'spm' else 'psm' end as form
            from drawn
        ), cut as (
            select *, substr(text, 1, x) as p, substr(text, x + 1, y - x) as m, substr(text, y + 1) as s from formed
        )
        select doc_id, n, form, case when form <> 'plain' then x end as prefix_chars,
               case when form <> 'plain' then y - x end as middle_chars,
               sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
                      else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
               sha256(text) as restored_sha256
        from cut
    """,
    "op13_source_divergence": r"""
        with docs as (
            select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source,
                   regexp_extract_all(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as words
            from documents
        ), words as (
            select row, lang, source, term, count(*) as n from (select row, lang, source, unnest(words) as term from docs)
            group by all
        ), kept as (
            select lang, term, sum(n) as n from words group by lang, term having count(*) >= 10
        ), used as (
            select lang, source, term, sum(w.n) as n from words w semi join kept k using (lang, term) group by all
        ), langs as (select lang, count(*) as v, sum(n) as total from kept group by lang),
        groups as (
            select g.lang, g.source, coalesce(u.total, 0) as total, coalesce(l.v, 0) as v, coalesce(l.total, 0) as lang_total
            from (select distinct lang, source from docs) g
            left join (select lang, source, sum(n) as total from used group by all) u using (lang, source)
            left join langs l using (lang)
        ), shares as (
            select g.lang, g.source, k.term, coalesce(u.n, 0) as n,
                   1 + (1000000000::hugeint * (coalesce(u.n, 0) + 2)) // (g.total + 2 * g.v) as p,
                   1 + (1000000000::hugeint * (k.n + 2)) // (g.lang_total + 2 * g.v) as q
            from groups g join kept k on k.lang = g.lang
            left join used u on u.lang = g.lang and u.source = g.source and u.term = k.term
        ), marks as (
            select lang, source, 'term' as part, term as item, ((p - q) * (p - q)) // (p + q) as value
            from shares where n > 0 and p > q
        ), pairs as (
            select a.lang, a.source, 'pair' as part, b.source as item, coalesce(max(f.value), 0) as value
            from groups a join groups b on a.lang = b.lang and a.source <> b.source
            left join (
                select x.lang, x.source, y.source as other, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) as value
                from shares x join shares y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all
            ) f on f.lang = a.lang and f.source = a.source and f.other = b.source
            group by all
        )
        select lang, source, part, item, value::bigint as value, rank::integer as rank
        from (
            select *, row_number() over (partition by lang, source, part order by value desc, item) as rank
            from (select * from marks union all select * from pairs)
        ) where part = 'pair' or rank <= 10
    """,
}
