"""Fixed values shared by the operators.

These must equal the published behaviour exactly for results to agree, so they are stated
plainly and in their natural order.
"""

# --- fixed values: scoring ---------------------------------------------------------------
RULE_WEIGHTS = [
    ("skills", 35),
    ("seniority", 15),
    ("compensation", 15),
    ("work-mode", 15),
    ("recency", 10),
    ("company-preference", 10),
]
NEUTRAL_RAW = 0.5
MODEL_VERSION = "rule-v1"
SEMANTIC_BLEND = 0.5
LEVEL_MULTIPLIER = {"familiar": 0.6, "proficient": 0.85, "expert": 1.0}
DEFAULT_LEVEL = "proficient"
SENIORITY_SPAN = 4
MODE_SHARE = 0.7
LOCATION_SHARE = 0.3
UNKNOWN_MODE_RAW = 0.6
OTHER_MODE_RAW = 0.2
GLOBAL_REMOTE_RAW = 0.9
INDIA_REMOTE_ELSEWHERE_RAW = 0.5
REMOTE_ELSEWHERE_RAW = 0.7
OTHER_PLACE_RAW = 0.2
RECENCY_HORIZON_DAYS = 28
COMPONENT_LABELS = {
    "skills": "Skills",
    "seniority": "Seniority",
    "compensation": "Compensation",
    "work-mode": "Work mode",
    "recency": "Recency",
    "company-preference": "Company pref",
}

# --- fixed values: gates -----------------------------------------------------------------
GATE_CODES = [
    "blocked_company",
    "excluded_keyword",
    "work_mode_mismatch",
    "salary_below_floor",
    "seniority_over_band",
]
GATE_SENTENCES = {
    "blocked_company": "You asked to avoid this company.",
    "excluded_keyword": "This posting contains a keyword you asked to skip.",
    "work_mode_mismatch": "The way of working does not match the options you chose.",
    "salary_below_floor": "The salary is below the minimum you set.",
    "seniority_over_band": "The seniority is above the band you set.",
}

# --- fixed values: enums -----------------------------------------------------------------
SENIORITIES = [
    "intern", "junior", "mid", "senior", "lead", "staff", "principal", "director", "exec",
]
WORK_MODES = ["remote", "hybrid", "onsite", "unknown"]
EMPLOYMENT_TYPES = [
    "full_time", "part_time", "contract", "internship", "temporary", "unknown",
]
SALARY_PERIODS = ["year", "month", "hour"]

# --- fixed values: feed, embeddings, dedupe ------------------------------------------------
MIN_FEED_SCORE = 60
EMBED_BATCH = 100
EMBED_WIDTH = 2048
FUZZY_THRESHOLD = 0.85
HASH_SEPARATOR = "|"

# --- fixed values: application stages --------------------------------------------------------
STAGES = [
    "discovered", "saved", "applied", "screening", "interview", "offer", "rejected", "withdrawn",
]
TERMINAL_STAGES = ["rejected", "withdrawn"]
BOARD_STAGES = ["applied", "screening", "interview", "offer", "rejected", "withdrawn"]
STAGE_MOVES = {
    "discovered": ["saved"],
    "saved": ["applied", "discovered"],
    "applied": ["screening", "rejected", "withdrawn"],
    "screening": ["interview", "rejected", "withdrawn"],
    "interview": ["offer", "rejected", "withdrawn"],
    "offer": ["rejected", "withdrawn"],
    "rejected": [],
    "withdrawn": [],
}

# --- fixed values: lists and caps ------------------------------------------------------------
MAX_LIST_ENTRIES = 50
MAX_TITLES = 10
MAX_SEED_SKILLS = 30
MAX_RUN_ERRORS = 20

# --- fixed values: skill vocabulary (slug, text forms) and seed rows -------------------------
SKILL_FORMS = [
    ("typescript", ["typescript", "ts"]),
    ("react", ["react", "react.js", "reactjs"]),
    ("nextjs", ["next.js", "nextjs"]),
    ("postgresql", ["postgresql", "postgres", "psql"]),
    ("tailwindcss", ["tailwind css", "tailwindcss", "tailwind"]),
    ("python", ["python", "py"]),
    ("aws", ["aws", "amazon web services"]),
    ("docker", ["docker", "containerization"]),
    ("kubernetes", ["kubernetes", "k8s"]),
    ("graphql", ["graphql", "gql"]),
]
SKILL_SEED = [
    ("TypeScript", "typescript", ["ts"], "language"),
    ("React", "react", ["react.js", "reactjs"], "framework"),
    ("Next.js", "nextjs", ["next", "next.js"], "framework"),
    ("PostgreSQL", "postgresql", ["postgres", "psql"], "database"),
    ("Tailwind CSS", "tailwindcss", ["tailwind"], "css"),
    ("Python", "python", ["py"], "language"),
    ("AWS", "aws", ["amazon web services"], "cloud"),
    ("Docker", "docker", ["containerization"], "devops"),
    ("Kubernetes", "kubernetes", ["k8s"], "devops"),
    ("GraphQL", "graphql", ["gql"], "api"),
]
SOURCE_SEED = [
    ("Greenhouse", "api_greenhouse", '{"boards": []}', True, 60),
    ("Lever", "api_lever", '{"boards": []}', True, 60),
    ("Ashby", "api_ashby", '{"organizations": []}', True, 60),
    ("Remotive", "api_remotive", "{}", True, 120),
    ("Arbeitnow", "api_arbeitnow", "{}", True, 120),
    ("USAJOBS", "api_usajobs", "{}", True, 180),
    ("Adzuna", "api_adzuna", '{"countries": ["us", "gb", "ca", "au", "de"]}', True, 240),
    (
        "Firecrawl Search",
        "firecrawl_search",
        '{"queries": ["software engineer remote", "frontend developer"]}',
        True,
        360,
    ),
    ("Firecrawl Scrape", "firecrawl_scrape", '{"urls": []}', True, 360),
]
DEFAULT_COUNTRIES = ["us", "gb", "ca", "au", "de"]

# --- fixed values: places -----------------------------------------------------------------------
COUNTRY_CODES = {
    "india": "IN", "in": "IN",
    "united states": "US", "usa": "US", "us": "US",
    "united kingdom": "GB", "uk": "GB", "gb": "GB",
    "canada": "CA", "ca": "CA",
    "australia": "AU", "au": "AU",
    "germany": "DE", "de": "DE",
    "france": "FR", "fr": "FR",
    "netherlands": "NL", "nl": "NL",
    "singapore": "SG", "sg": "SG",
    "uae": "AE", "united arab emirates": "AE",
    "japan": "JP", "jp": "JP",
}
COUNTRY_NAMES = [
    "India", "United States", "USA", "United Kingdom", "Canada", "Australia", "Germany",
    "France", "Netherlands", "Singapore", "United Arab Emirates",
]

# --- fixed values: legal company words ------------------------------------------------------------
LEGAL_WORDS = [
    "inc", "inc.", "llc", "l.l.c.", "ltd", "ltd.", "limited", "corp", "corp.", "corporation",
    "co", "co.", "company", "gmbh", "ag", "plc", "llp", "lp", "sa", "sas", "bv", "nv", "pty",
    "pvt", "private",
]

# --- fixed values: unsafe addresses -----------------------------------------------------------------
PRIVATE_IPV4 = [
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16",
    "172.16.0.0/12", "192.0.0.0/24", "192.168.0.0/16", "198.18.0.0/15", "224.0.0.0/4",
    "240.0.0.0/4",
]
LOCAL_HOSTS = ["localhost", "localhost.localdomain", "ip6-localhost"]
LOCAL_SUFFIXES = [".localhost", ".local", ".localdomain", ".internal", ".intranet"]

# --- fixed values: HTML ---------------------------------------------------------------------------------
ALLOWED_TAGS = ["p", "ul", "li", "strong", "em", "a", "br", "h3", "h4"]
STRIP_WITH_CONTENT = ["script", "style", "iframe", "object", "embed"]
DROP_WITH_CONTENT = STRIP_WITH_CONTENT + ["template", "noscript", "svg", "math"]
NAMED_ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ",
    "ndash": "–", "mdash": "—", "hellip": "…", "rsquo": "’", "lsquo": "‘",
    "ldquo": "“", "rdquo": "”",
}
SAFE_SCHEMES = ["http://", "https://", "mailto:"]

# --- fixed values: display --------------------------------------------------------------------------------
PERIOD_LABELS = {"year": "/yr", "month": "/mo", "hour": "/hr"}
SCORE_BANDS = [(85, "strong"), (70, "good"), (55, "fair")]

# --- fixed values: lifecycle and health --------------------------------------------------------------------
STALE_DAYS = 14
EXPIRED_DAYS = 28
ALERT_FAILURES = 3
PAUSE_FAILURES = 5
DIGEST_ITEMS = 10
ALERT_SCORE = 90
