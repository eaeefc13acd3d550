from pyspark.sql import functions as F

from rankwell.functions import company, html, labels, parse, redact, resume, text, urls, vectors
from rankwell.functions.skills import known_slugs, skill_tags
from rankwell.operators.fuzzy import trigram_similarity


def test_salary(apply):
    cases = {
        "$120,000 per year": (120000, None, "USD", "year"),
        "₹15,00,000 per year": (1500000, None, "INR", "year"),
        "$100,000 - $150,000": (100000, 150000, "USD", "year"),
        "$5,000/month": (5000, None, "USD", "month"),
        "15L per year": (1500000, None, "INR", "year"),
        "15L - 20L": (1500000, 2000000, "INR", "year"),
        "12 LPA": (1200000, None, "INR", "year"),
        "1.2 Cr": (12000000, None, "INR", "year"),
        "$120k – $160k": (120, 160, "USD", "year"),
        "£45.50 per hour": (45.5, None, "GBP", "hour"),
        "negotiable": (None, None, "USD", "year"),
    }
    assert [tuple(r) for r in apply(list(cases), parse.parse_salary)] == list(cases.values())
    assert apply(["", "  ", None], parse.parse_salary) == [None] * 3


def test_place(apply):
    cases = {
        "San Francisco, CA, USA": ("San Francisco", "CA", "US", "unknown"),
        "London, UK": ("London", None, "GB", "unknown"),
        "Bangalore, India": ("Bangalore", None, "IN", "unknown"),
        "Remote – India": (None, None, "IN", "india"),
        "Remote – Anywhere": (None, None, None, "global"),
        "Remote (India)": (None, None, "IN", "india"),
        "India": (None, None, "IN", "unknown"),
        "Austin, TX": ("Austin", "TX", None, "unknown"),
        "": (None, None, None, "unknown"),
    }
    assert [tuple(r) for r in apply(list(cases), parse.parse_location)] == list(cases.values())


def test_scope(apply):
    texts = ["PAN India", "India WFH", "Remote – India (Worldwide)", "Worldwide", "London, UK"]
    assert apply(texts, parse.remote_scope) == ["india", "india", "india", "global", "unknown"]


def test_seniority(apply):
    of = lambda c: parse.seniority_of(c, F.lit(None).cast("string"))
    titles = ["Senior Software Engineer", "Tech Lead", "5+ years of experience", "Internals", "Jr. dev"]
    assert apply(titles, of) == ["senior", "lead", "senior", "unknown", "junior"]


def test_skills(apply, spark):
    tags = lambda c: skill_tags(c, F.lit(None).cast("string"))
    texts = ["what comes next", "PyTorch and k8s internals", "Tailwind\nCSS", "nextxjs", "caféreact, React.js"]
    assert apply(texts, tags) == [[], ["kubernetes"], ["tailwindcss"], [], ["react"]]
    assert known_slugs(spark).count() == 10


def test_company(apply):
    assert apply(["Acme Corp.", "Café Ventures", "!!!"], company.company_slug) == [
        "acme-corp", "cafe-ventures", "",
    ]
    strip = lambda c: company.company_slug(c, strip_legal=True)
    assert apply(["Acme Inc", "inc", "co ltd inc"], strip) == ["acme", "inc", "co"]
    domains = ["https://user:pw@acme.com:8443/x", "http://www.acme.com/jobs", "acme", "acme.", ".com"]
    assert apply(domains, company.domain_slug) == ["acme.com", "acme.com", None, None, None]
    assert apply(["Acme Corp.", "acme.com", " "], company.company_input) == ["acme-corp", "acme.com", None]
    both = lambda c: company.company_candidates(F.lit("Stripe Inc"), c)
    assert apply(["stripe.com", None], both) == [["stripe-inc", "stripe.com", "stripe"], ["stripe-inc"]]


def test_url_guard(apply):
    cases = {
        "http://a.com": "scheme-not-https", "https://u:p@a.com": "credentials-in-url",
        "https://localhost./x": "private-address", "https://intranet/": "private-address",
        "https://127.1": "private-address", "https://0x7f.0.0.1/": "private-address",
        "https://0177.0.0.1": "private-address", "https://2130706433": "private-address",
        "https://10.10.0.1": "private-address", "https://172.16.0.9": "private-address",
        "https://192.168.1.1": "private-address", "https://169.254.169.254/": "private-address",
        "https://255.255.255.255": "private-address", "https://[fe80::1]/": "private-address",
        "https://[::1]/": "private-address", "https://[0:0:0:0:0:0:0:1]/": "private-address",
        "https://[::ffff:127.0.0.1]/": "private-address", "https://[fd00::5]/": "private-address",
        "https://[2001:db8::1]/x": None, "https://8.8.8.8": None, "https://172.32.0.1": None,
        "https://careers.example.com/a?b=1": None, "nope": "not-a-url", "https://": "not-a-url",
        "https://256.1.1.1": "not-a-url", "https://a.internal": "private-address",
    }
    found = apply(list(cases), urls.check_url)
    assert {u: r.reason for u, r in zip(cases, found)} == cases
    assert all(r.ok == (r.reason is None) for r in found)


def test_html(apply):
    pages = [
        "<div><p>Hi</p></div>", '<a href="javascript:x">Bad Link</a>',
        "<p>Text</p><SCRIPT>alert('</p>')</SCRIPT>", "<A HREF='/x' onclick=1>y</A><BR>a < b",
    ]
    assert apply(pages, html.sanitise_html) == [
        "<p>Hi</p>", "<a>Bad Link</a>", "<p>Text</p>",
        '<a href="/x" rel="noopener noreferrer" target="_blank">y</a><br />a < b',
    ]
    texts = {
        "<p>a</p><p>b</p>": "a b", "with <em>care</em>.": "with care.", "a</p>b": "ab",
        "x<strong><p>y</p></strong>": "xy", "Use &lt;b&gt; &#65; &#x42; &nope;": "Use <b> A B &nope;",
        "<script>never closed": "", "a < b": "a < b", "<p unterminated": "<p unterminated",
        "<!-- c -->t<ul><li>1<li>2</ul>z": "t 1 2 z",
    }
    assert apply(list(texts), html.visible_text) == list(texts.values())
    links = ["javascript:x", "ht\ttp://a.b", " https://x ", "data:x"]
    assert apply(links, html.safe_href) == [None, "http://a.b", "https://x", None]


def test_redact(apply, spark):
    lines = ['api_key = "24be" rest', "x token: abc y", "Authorization: Bearer abc", "plain"]
    assert apply(lines, redact.redact) == ["*** rest", "x *** y", "*** abc", "plain"]
    df = spark.sql("select named_struct('a', array('k', 'secret=1'), 'n', 5) as s")
    row = df.select(redact.redact_value(F.col("s"), df.schema["s"].dataType).alias("s")).first()
    assert row.s.a == ["k", "***"] and row.s.n == 5


def test_labels_and_rounding(apply, spark):
    number = lambda c: text.round2(c.cast("double"))
    assert apply(["1.005", "2.675", "24.899999"], number) == [1.0, 2.68, 24.9]
    band = lambda c: labels.score_band(c.cast("double"))
    assert apply(["85", "84.9", "55", "1", "0"], band) == ["strong", "good", "fair", "weak", "gated"]
    sentences = lambda c: labels.gate_sentences(F.split(c, ","))
    assert apply(["blocked_company,odd"], sentences) == [["You asked to avoid this company.", "odd"]]
    row = spark.range(1).select(
        labels.salary_label(F.lit(160000.0), F.lit(None).cast("double"), F.lit("USD"), F.lit("year")).alias("a"),
        labels.salary_label(F.lit(1.0), F.lit(2.5), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("b"),
        labels.date_label(F.lit("2024-03-09").cast("timestamp")).alias("c"),
    ).first()
    assert tuple(row) == ("from 160000 USD/yr", "1–2.5", "3/9/2024")


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0]),
            ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]), ([], []), (None, [1.0])]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>")
    got = [r[0] for r in df.select(vectors.cosine_percent(F.col("a"), F.col("b"))).collect()]
    assert got == [100.0, 0.0, 0.0, None, None, None, None]


def test_similarity(spark):
    rows = [("backend engineer", "backend engineer "), ("engineer", "engineers"),
            ("backend engineer", "warehouse supervisor"), ("", ""), ("", "ab"), ("aaaa", "aa")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r[0] for r in df.select(trigram_similarity(F.col("a"), F.col("b"))).collect()]

    def grams(s):
        s = f"  {s}  "
        return [s[i:i + 3] for i in range(len(s) - 2)]

    def brute(a, b):
        a, b = grams(a), grams(b)
        shared = sum(min(a.count(g), b.count(g)) for g in set(a))
        return shared / (len(a) + len(b) - shared)

    assert got == [brute(a, b) for a, b in rows]
    assert got[3] == 1 and got[4] == 0 and got[2] == 1 / 39


RESUME = """John Smith
Location: San Francisco, CA, USA
j.s@X.com (415) 555-1234
Summary
I write software for a living, often.
Experience:
Senior Software Engineer - Acme
3+ years of experience
Education
B.Tech, IIT 2012
Expected CTC: ₹15,00,000 per year C++ and C#, remote
"""


def test_resume(spark):
    docs = spark.createDataFrame([(1, RESUME), (2, "nothing")], "doc_id int, text string")
    one, two = resume.extract_profiles(docs).orderBy("doc_id").collect()
    assert one.full_name == "John Smith" and one.email == "j.s@x.com"
    assert one.phone == "(415) 555-1234" and one.location.city == "San Francisco"
    assert one.titles == ["Senior Software Engineer"] and one.seniority == "senior"
    assert one.skills == ["C++", "C#"] and one.work_modes == ["remote"]
    assert (one.min_salary, one.salary_currency, one.years_experience) == (1500000.0, "INR", 3.0)
    assert one.education[0].year == 2012 and one.summary.startswith("I write")
    assert one.confidence == 1.0 and not one.needs_review and one.method == "rules"
    assert two.confidence == 0.0 and two.needs_review and two.method == "fallback"
    seed = resume.profile_seed(resume.extract_profiles(docs))
    ready = {r.doc_id: r.ok for r in seed.select("doc_id", resume.seed_ready().alias("ok")).collect()}
    assert ready == {1: True, 2: False}


def test_lists(spark):
    row = spark.range(1).select(
        text.clean_list(F.array(*[F.lit(x) for x in (" A", "a", "b ", "", "B", "c")]), 2).alias("a"),
        text.clean_keywords(F.array(*[F.lit(x) for x in (" Go", "go ", "", "C++")])).alias("b"),
        company.clean_companies(F.array(*[F.lit(x) for x in ("Acme Corp.", "acme corp", "!", "x.io")])).alias("c"),
    ).first()
    assert (row.a, row.b, row.c) == (["A", "b"], ["go", "c++"], ["acme-corp", "x.io"])


def test_ligatures_and_marks_fold(apply):
    from rankwell.functions.text import fold_accents

    given = ["ﬁrm Oﬃce", "Café № ½", "Straße", "plain", None, "ĳs Ⅳ"]
    assert apply(given, fold_accents) == ["firm Office", "Cafe No 1⁄2", "Straße", "plain", None, "ijs IV"]


def test_large_fractions_have_no_exponent(apply):
    from rankwell.functions.labels import number_text

    given = ["12345678.9", "120000", "0.5", "98765432.125", "1500.75"]
    assert apply(given, lambda c: number_text(c.cast("double"))) == given
