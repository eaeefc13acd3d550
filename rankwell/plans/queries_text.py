"""Queries: pages, secrets, résumé fields, near duplicates, vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankwell.functions import html, redact as red, resume, urls
from rankwell.functions.text import ascii_norm
from rankwell.functions.vectors import cosine_percent, is_usable_vector
from rankwell.operators import fuzzy, neighbours
from rankwell.plans.adapters import CHECKS
from rankwell.plans.registry import Inputs, query

# --- pages ------------------------------------------------------------------------------------------------

_DROPS = "html"
for _tag in ("script", "style", "iframe", "object", "embed"):
    _DROPS = f"regexp_replace({_DROPS}, '(?is)<{_tag}\\b.*?</{_tag}>', '', 'g')"
_HREF = """trim(regexp_extract(a, '(?i)href\\s*=\\s*"([^"]*)"', 1)
  || case when regexp_matches(a, '(?i)href\\s*=\\s*"') then ''
    else regexp_extract(a, '(?i)href\\s*=\\s*([^\\s>]+)', 1) end)"""


@query(f"""
select page_id, regexp_replace(string_agg(case when p like '<%' and regexp_matches(p,
    '(?s)^</?[a-zA-Z0-9].*>$') then case
  when tag not in ('p', 'ul', 'li', 'strong', 'em', 'a', 'br', 'h3', 'h4') then ''
  when p like '</%' then '</' || tag || '>' when tag = 'br' then '<br />'
  when tag = 'a' then case when regexp_matches(href, '(?i)^(https?://|mailto:|/)')
    then '<a href="' || href || '" rel="noopener noreferrer" target="_blank">' else '<a>' end
  else '<' || tag || '>' end else p end, '' order by i), '^\\s+|\\s+$', '', 'g') as clean
from (select page_id, i, p, lower(regexp_extract(p, '^</?([a-zA-Z0-9]+)', 1)) as tag, {_HREF} as href
  from (select page_id, i, p, regexp_extract(p, '(?s)^</?[a-zA-Z0-9]+(.*)>$', 1) as a
    from (select page_id, unnest(pieces) as p, unnest(range(len(pieces))) as i
      from (select page_id, regexp_extract_all({_DROPS}, '</?[a-zA-Z0-9]+[^>]*>|<|[^<]+') as pieces
        from {{pages}}))))
group by page_id
""")
def html_sanitise(t):
    """Pages reduced to nine tags with safe links."""
    return t.pages.select("page_id", html.sanitise_html(F.col("html")).alias("clean"))


_FLAT = "regexp_replace(html, '(?s)<!--.*?-->|<![^>]*>', '', 'g')"
for _tag in ("script", "style", "iframe", "object", "embed", "template", "noscript", "svg", "math"):
    _FLAT = f"regexp_replace({_FLAT}, '(?is)<{_tag}\\b.*?</{_tag}>', '', 'g')"
_FLAT = f"regexp_replace({_FLAT}, '(?i)</?(p|ul|li|h3|h4)\\b[^>]*>|<br\\b[^>]*>', ' ', 'g')"
_FLAT = f"regexp_replace({_FLAT}, '</?[a-zA-Z][^>]*>', '', 'g')"
_FLAT = f"replace(replace(replace(replace({_FLAT}, '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"


@query(f"""
select page_id, trim(regexp_replace({_FLAT}, '\\s+', ' ', 'g')) as text from {{pages}}
""")
def html_text(t):
    """Visible text of every page, entities decoded."""
    return t.pages.select("page_id", html.visible_text(F.col("html")).alias("text"))


CHECKS["links"] = """
select page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as href from {pages}
"""


@query("""
select page_id, href, case when regexp_matches(lower(href), '^(https?://|mailto:)') then href end as safe
from (select distinct page_id, regexp_replace(href, '[\\x00-\\x20]', '', 'g') as href from {links})
""")
def href_check(t):
    """Every link of every page, null where its scheme is not allowed."""
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    links = t.pages.select("page_id", F.explode(found).alias("href")).withColumn(
        "href", F.regexp_replace("href", "[\\x00-\\x20]", "")
    )
    return links.distinct().select("page_id", "href", html.safe_href(F.col("href")).alias("safe"))


@query("""
select page_id, reason is null as ok, coalesce(reason, '') as reason, host as label from (select page_id,
  regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as host,
  case when not regexp_matches(url, '^[a-z]+://') then 'not-a-url'
    when url not like 'https:%' then 'scheme-not-https'
    when regexp_matches(url, '^https://[^/]*@') then 'credentials-in-url'
    when not contains(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '.') then 'private-address'
    end as reason from {pages})
""")
def url_guard(t):
    check = urls.check_url(F.col("url"))
    return t.pages.select(
        "page_id", check["ok"].alias("ok"), F.coalesce(check["reason"], F.lit("")).alias("reason"),
        urls.source_label(F.col("url")).alias("label"),
    )


_SECRETS = "text"
for _regex in (
    "sb_secret_[A-Za-z0-9_-]{20,}", "sb_publishable_[A-Za-z0-9_-]{20,}",
    "eyJ[A-Za-z0-9_-]{10,}\\.eyJ[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{20,}",
    "sk-or-v1-[A-Za-z0-9]{40,}", "whsec_[A-Za-z0-9]{20,}", "rk_live_[A-Za-z0-9]{20,}",
    "(?i)authorization:\\s*[^\\s]+", "(?i)cookie:\\s*[^\\s]+",
    "\\b[A-Za-z0-9_-]*[Kk][Ee][Yy][A-Za-z0-9_-]*\\s*[=:]\\s*[^\\s]+",
    "\\b[A-Za-z0-9_-]*[Ss][Ee][Cc][Rr][Ee][Tt][A-Za-z0-9_-]*\\s*[=:]\\s*[^\\s]+",
    "\\b[A-Za-z0-9_-]*[Tt][Oo][Kk][Ee][Nn][A-Za-z0-9_-]*\\s*[=:]\\s*[^\\s]+",
):
    _SECRETS = f"regexp_replace({_SECRETS}, '{_regex}', '***', 'g')"


@query(f"select doc_id, {_SECRETS} as text from {{documents}}")
def redact(t):
    return t.documents.select("doc_id", red.redact(F.col("text")).alias("text"))


# --- résumé fields ------------------------------------------------------------------------------------------

_MAIL = "[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}"
_PHONE = "(?:\\+?\\d{1,3}[-.\\s]?)?\\(?\\d{3}\\)?[-.\\s]?\\d{3}[-.\\s]?\\d{4}"


@query(f"""
select doc_id, lower(regexp_extract_all(text, '{_MAIL}')[1]) as email,
  regexp_replace(regexp_extract_all(text, '{_PHONE}')[1], '\\s+', ' ', 'g') as phone,
  len(list_distinct(list_transform(regexp_extract_all(text, '{_MAIL}'), lambda m: lower(m))))
    as emails
from {{documents}}
""")
def extract_contacts(t):
    mails = resume.emails(F.col("text"))
    return t.documents.select(
        "doc_id", F.get(mails, 0).alias("email"), F.get(resume.phones(F.col("text")), 0).alias("phone"),
        F.size(mails).cast("bigint").alias("emails"),
    )


@query("""
select doc_id, nullif(regexp_extract(text, '(?i)(\\d+)\\+?\\s*years?\\s*(?:of\\s*)?experience', 1), '')::double
    as years,
  array_to_string(list_filter([
    case when regexp_matches(text, '(?i)\\b(remote|work from home|wfh|distributed|anywhere)\\b') then 'remote' end,
    case when regexp_matches(text, '(?i)\\b(hybrid|flexible|partial remote)\\b') then 'hybrid' end,
    case when regexp_matches(text, '(?i)\\b(on[- ]site|in[- ]office|office[- ]based)\\b') then 'onsite' end],
    lambda m: m is not null), ',') as modes,
  array_to_string(list_filter([
    case when regexp_matches(text, '(?i)\\bgo\\b') then 'Go' end,
    case when regexp_matches(text, '(?i)\\brest\\b') then 'REST' end], lambda m: m is not null), ',') as two_skills
from {documents}
""")
def extract_words(t):
    """Years, work modes and two of the listed skills from whole documents."""
    text = F.col("text")
    return t.documents.select(
        "doc_id", resume.years_experience(text).alias("years"),
        F.array_join(resume.work_modes(text), ",").alias("modes"),
        F.array_join(
            F.filter(resume.skills(text), lambda s: s.isin("Go", "REST")), ","
        ).alias("two_skills"),
    )


@query()
def extract_sections(t):
    """Named sections of every document, where it has any."""
    names = [name for name, _ in resume.HEADERS]
    return t.documents.select("doc_id", *[resume.section(F.col("text"), n).alias(n) for n in names])


@query()
def extract_profile(t):
    """All profile fields of every document with confidence and method."""
    rows = resume.extract_profiles(t.documents)
    return rows.select(
        "doc_id", "full_name", "email", "phone", F.col("location")["city"].alias("city"),
        F.array_join("titles", "|").alias("titles"), "seniority", "years_experience",
        F.array_join("skills", "|").alias("skills"), F.array_join("work_modes", "|").alias("work_modes"),
        F.size("education").alias("degrees"), "summary", "min_salary", "salary_currency",
        "salary_period", "confidence", "needs_review", "method",
    )


def _seeds(t: Inputs):
    """Seeds of customers from the document with their number; existing values from profiles."""
    seed = resume.profile_seed(resume.extract_profiles(t.documents)).withColumnRenamed(
        "doc_id", "user_id"
    )
    existing = t.profiles.select(
        "user_id", F.array("seniority").alias("target_titles"), "seniority",
        F.lit(None).cast("double").alias("years_experience"), F.lit(None).cast("array<string>").alias("skills"),
        "work_modes", "country_code", F.lit(None).cast("string").alias("city"), "min_salary",
        "salary_currency", "salary_period",
    )
    return seed, existing


CHECKS["seed_words"] = """
select doc_id as user_id, list_filter([
    case when regexp_matches(text, '(?i)\\b(remote|work from home|wfh|distributed|anywhere)\\b') then 'remote' end,
    case when regexp_matches(text, '(?i)\\b(hybrid|flexible|partial remote)\\b') then 'hybrid' end,
    case when regexp_matches(text, '(?i)\\b(on[- ]site|in[- ]office|office[- ]based)\\b') then 'onsite' end],
    lambda m: m is not null) as modes from {documents}
"""


@query("""
select s.user_id, array_to_string(case when len(s.modes) > 0 then s.modes
  else coalesce(p.work_modes, []) end, ',') as work_modes, p.country_code
from {seed_words} s left join {profiles} p on p.user_id = s.user_id
""")
def merge_seed(t):
    """Work modes from the document win over the profile's when there are any."""
    seed, existing = _seeds(t)
    return resume.merge_seed(existing, seed, "user_id").select(
        "user_id", F.array_join("work_modes", ",").alias("work_modes"), "country_code"
    )


@query()
def seed_ready(t):
    seed, _ = _seeds(t)
    return seed.select("user_id", resume.seed_ready().alias("ready"))


# --- near duplicates -------------------------------------------------------------------------------------------

CHECKS["norm_docs"] = """
select doc_id, lang, source, text, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') as title,
  cast(substr(source, 4) as int) >= 10 as is_new from {documents}
"""
CHECKS["grams"] = """
select doc_id, lang, is_new, size, gram, count(*) as n from (select doc_id, lang, is_new,
    len(title) + 2 as size, substr('  ' || title || '  ', i, 3) as gram
  from (select *, unnest(range(1, len(title) + 3)) as i from {norm_docs})) group by all
"""
CHECKS["similar_docs"] = """
select new_id, old_id, shared / (na + nb - shared) as score
from (select a.doc_id as new_id, b.doc_id as old_id, any_value(a.size) as na, any_value(b.size) as nb,
    sum(least(a.n, b.n))::double as shared
  from {grams} a join {grams} b on a.lang = b.lang and a.gram = b.gram and a.is_new
    and not b.is_new and least(a.size, b.size) > 0.85 * greatest(a.size, b.size)
  group by a.doc_id, b.doc_id)
where shared / (na + nb - shared) > 0.85
"""
CHECKS["best"] = """
select new_id, old_id, score from (select *, row_number() over (partition by new_id
  order by score desc, old_id) as n from {similar_docs}) where n = 1
"""


def sides(t: Inputs):
    """Documents of sources 10 and up as newcomers, the others as incumbents; block is language."""
    rows = t.documents.select(
        F.col("doc_id").alias("id"), F.col("lang").alias("block"),
        ascii_norm(F.col("text")).alias("title"), "text",
        F.lit(1).alias("sighting_count"), F.concat(F.lit("doc:"), "doc_id").alias("source_url"),
        (F.substring("source", 4, 9).cast("int") >= 10).alias("is_new"),
    )
    return rows.where(F.col("is_new")), rows.where(~F.col("is_new"))


@query("""
select lang as block, new_title, old_title, score from (select distinct a.lang, a.title as new_title,
  b.title as old_title, s.score from {similar_docs} s join {norm_docs} a on a.doc_id = s.new_id
  join {norm_docs} b on b.doc_id = s.old_id)
""")
def fuzzy_titles(t):
    """All pairs of different normalised texts of one language above the threshold."""
    return fuzzy.similar_titles(*sides(t))


@query("select new_id as id, old_id as match_id, score from {best}")
def fuzzy_best(t):
    """The incumbent each newcomer merges into."""
    return fuzzy.best_matches(*sides(t))


@query("""
select b.new_id, b.old_id, case when len(o.text) >= len(n.text) then b.old_id else b.new_id end
    as survivor_id,
  case when len(o.text) >= len(n.text) then 'doc:' || b.new_id::varchar
    else 'doc:' || b.old_id::varchar end as alternative_url
from {best} b join {documents} n on n.doc_id = b.new_id join {documents} o on o.doc_id = b.old_id
""")
def fuzzy_survivor(t):
    new, old = sides(t)
    return fuzzy.survivors(fuzzy.best_matches(new, old), new, old)


@query("""
select p_partkey, case when len(a) + len(b) - s = 0 then 1.0 else s / (len(a) + len(b) - s) end as score
from (select p_partkey, a, b, (select sum(least(x.n, y.n)) from
    (select g, count(*) as n from (select unnest(a) as g) group by g) x join
    (select g, count(*) as n from (select unnest(b) as g) group by g) y on x.g = y.g)::double as s
  from (select p_partkey, list_transform(range(1, len(p_name) + 3),
      lambda i: substr('  ' || lower(p_name) || '  ', i, 3)) as a,
    list_transform(range(1, len(p_name || ' ' || p_type) + 3),
      lambda i: substr('  ' || lower(p_name || ' ' || p_type) || '  ', i, 3)) as b from {part}))
""")
def trigram_pairs(t):
    """Similarity of each part name with the name and type together."""
    both = F.concat("p_name", F.lit(" "), "p_type")
    return t.part.select(
        "p_partkey", fuzzy.trigram_similarity(F.col("p_name"), both).alias("score")
    )


# --- vectors ---------------------------------------------------------------------------------------------------

CHECKS["means"] = """
select label, list(x order by pos) as center from (select label, pos, avg(x::double) as x
  from (select label, unnest(embedding) as x, unnest(range(len(embedding))) as pos from {embeddings})
  group by label, pos) group by label
"""
CHECKS["to_center"] = """
select v.vec_id, c.label, v.label as own, least(100, greatest(0,
    list_dot_product(v.embedding::double[], c.center) / (sqrt(list_dot_product(v.embedding::double[],
      v.embedding::double[])) * sqrt(list_dot_product(c.center, c.center))) * 100)) as cosine
from {embeddings} v, {means} c
"""


@query("""
select vec_id, own as label, floor(cosine * 1000000 + 0.5) / 1000000 as cosine from {to_center}
where own = label
""")
def cosine_pairs(t):
    """Cosine of every vector with the mean vector of its label."""
    centers = neighbours.centroids(t.embeddings, "label").withColumnRenamed("embedding", "center")
    score = cosine_percent(F.col("embedding"), F.col("center"))
    return t.embeddings.join(centers, "label").select(
        "vec_id", "label", (F.floor(score * 1000000 + 0.5) / F.lit(1000000.0)).alias("cosine")
    )


@query("""
select label, vec_id, floor(cosine * 1000000 + 0.5) / 1000000 as cosine, rank from (select *,
  row_number() over (partition by label order by cosine desc, vec_id) as rank from {to_center})
where rank <= 10
""")
def vector_topk(t):
    """The ten vectors nearest to each label's mean vector, over all vectors."""
    centers = neighbours.centroids(t.embeddings, "label")
    top = neighbours.nearest(t.embeddings, centers, 10, "vec_id", "label")
    return top.select(
        "label", "vec_id", (F.floor(F.col("cosine") * 1000000 + 0.5) / F.lit(1000000.0)).alias("cosine"),
        F.col("rank").cast("bigint").alias("rank"),
    )


@query("""
select query_id, vec_id, floor(cosine * 1000000 + 0.5) / 1000000 as cosine, rank from (select *,
  row_number() over (partition by query_id order by cosine desc, vec_id) as rank from (
    select q.vec_id as query_id, v.vec_id, least(100, greatest(0, list_dot_product(q.embedding::double[],
      v.embedding::double[]) / (sqrt(list_dot_product(q.embedding::double[], q.embedding::double[]))
      * sqrt(list_dot_product(v.embedding::double[], v.embedding::double[]))) * 100)) as cosine
    from {embeddings} q join {embeddings} v on q.vec_id % 20 = 0)) where rank <= 10
""")
def vector_neighbours(t):
    """The ten vectors nearest to every twentieth vector, over all vectors."""
    queries = t.embeddings.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    top = neighbours.nearest(t.embeddings, queries, 10, "vec_id", "query_id")
    rounded = (F.floor(F.col("cosine") * 1000000 + 0.5) / F.lit(1000000.0)).alias("cosine")
    return top.select("query_id", "vec_id", rounded, F.col("rank").cast("bigint").alias("rank"))


@query()
def vector_neighbours_approximate(t):
    """The same from hashed buckets: most of the ten nearest, ranked by their exact cosine."""
    queries = t.embeddings.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    return neighbours.nearest_approximate(t.embeddings, queries, 10, "vec_id", "query_id")


@query("""
select label, vec_id from {embeddings} e where label not in (select label from (select label,
  vec_id - min(vec_id) over (partition by label) as d from {embeddings}) where d between 4 and 5)
""")
def vector_quality(t):
    """Replies of each label as a batch; one with a repeated index is void as a whole."""
    base = t.embeddings.groupBy("label").agg(
        F.min("vec_id").alias("_low"), F.count(F.lit(1)).alias("expected")
    )
    offset = F.col("vec_id") - F.col("_low")
    listed = neighbours.with_row_number(t.embeddings, ["label"], ["vec_id"], "_n").join(base, "label")
    replies = listed.withColumn(
        "index", F.when(offset.between(4, 5), F.lit(0)).otherwise(F.col("_n") - 1)
    )
    good = neighbours.accepted_vectors(replies, base.select("label", "expected"), ["label"], 64)
    return good.where(is_usable_vector(F.col("embedding"), 64)).select("label", "vec_id")


@query("""
select source, doc_id, (n - 1) // 100 as batch, (n - 1) % 100 as index from (select source, doc_id,
  row_number() over (partition by source order by doc_id) as n from {documents}
  where regexp_replace(text, '\\s', '', 'g') <> '')
""")
def embed_batches(t):
    """Non-blank documents of each source in batches of one hundred."""
    rows = neighbours.embed_batches(
        t.documents.select("source", "doc_id", "text"), ["source"], ["doc_id"], "text"
    )
    return rows.select(
        "source", "doc_id", F.col("batch").cast("bigint").alias("batch"),
        F.col("index").cast("bigint").alias("index"),
    )
