"""Parameter dictionaries.

Everything here is data, passed to operators as a default argument; callers can
substitute their own lists.
"""

from __future__ import annotations

# --- Fixed values: keyword lists used by the document score -----------------

HARD_SKILLS = (
    "aws", "azure", "gcp", "google cloud", "s3", "ec2", "lambda", "emr",
    "cloud formation", "terraform", "pulumi", "kubernetes", "k8s", "docker",
    "ecs", "eks", "databricks", "snowflake", "redshift", "bigquery", "synapse",
    "spark", "pyspark", "apache spark", "kafka", "flink", "airflow",
    "prefect", "dagster", "luigi", "dbt", "data build tool", "fivetran",
    "glue", "data lake", "data lakehouse", "data warehouse", "etl", "elt",
    "data pipeline", "streaming", "batch processing", "real-time",
    "delta lake", "iceberg", "hudi", "parquet", "avro", "orc",
    "sql", "mysql", "postgresql", "postgres", "oracle", "sql server",
    "mongodb", "cassandra", "dynamodb", "redis", "elasticsearch",
    "hive", "hbase", "clickhouse", "pinot",
    "python", "scala", "java", "go", "golang", "rust", "r", "bash", "shell",
    "pandas", "numpy", "sqlalchemy",
    "tableau", "power bi", "looker", "metabase", "superset", "grafana",
    "data visualization", "dashboards", "reporting",
    "machine learning", "deep learning", "tensorflow", "pytorch", "sklearn",
    "scikit-learn", "mlflow", "feature engineering", "model deployment",
    "git", "github", "gitlab", "ci/cd", "jenkins", "github actions",
    "devops", "infrastructure as code", "iac",
    "great expectations", "data quality", "data validation", "monitoring",
    "observability", "data catalog", "data governance", "lineage",
    "rest api", "restful", "graphql", "microservices", "grpc", "fastapi",
    "django", "flask", "spring boot", "node.js", "react", "typescript",
    "unit testing", "tdd", "pytest", "junit",
)

SOFT_SKILLS = (
    "leadership", "communication", "collaboration", "mentoring", "mentorship",
    "cross-functional", "stakeholder", "problem solving", "analytical",
    "ownership", "initiative", "agile", "scrum", "kanban",
)

STRONG_VERBS = (
    "architected", "designed", "built", "implemented", "developed", "led",
    "drove", "optimized", "reduced", "increased", "improved", "scaled",
    "deployed", "launched", "migrated", "automated", "streamlined",
    "collaborated", "partnered", "delivered", "owned", "managed",
)

EXPERIENCE_LEVELS = (
    ("junior", ("junior", "entry level", "entry-level", "associate", "0-2 years", "1 year")),
    ("mid", ("mid", "2-4 years", "3 years", "2+ years", "3+ years")),
    ("senior", ("senior", "5+ years", "4+ years", "sr.", "sr ")),
    ("staff", ("staff", "7+ years", "8+ years", "principal", "tech lead")),
    ("manager", ("manager", "director", "head of", "vp ", "lead")),
)

EDUCATION_LEVELS = (
    ("bachelor", ("bachelor", "bs", "b.s.", "b.e.", "undergraduate")),
    ("master", ("master", "ms", "m.s.", "msc", "m.sc.", "graduate")),
    ("phd", ("phd", "ph.d.", "doctorate")),
    ("relevant", ("computer science", "data science", "software engineering",
                  "information systems", "statistics", "mathematics", "engineering")),
)

TITLE_STOP_WORDS = ("at", "the", "a", "an", "and", "or", "for")

# Case-insensitive. ``(?![\p{L}\p{N}_])`` is a word boundary after a letter that
# does not depend on the JVM's changing definition of ``\b``.
QUANTITY_PATTERNS = (
    r"[0-9]+%",
    r"[0-9]+x(?![\p{L}\p{N}_])",
    r"\$[0-9]+",
    r"[0-9]+\s*(?:million|billion|thousand|k(?![\p{L}\p{N}_]))",
    r"[0-9]+\+",
    r"[0-9]{4,}",
)

GRADE_BANDS = ((85, "A"), (75, "B"), (65, "C"), (50, "D"))
GRADE_DEFAULT = "F"
ADVICE_BANDS = (
    (80, "Strong match — apply immediately."),
    (65, "Good match — minor gaps. Worth applying."),
    (50, "Moderate match — address gaps before applying."),
)
ADVICE_DEFAULT = "Weak match — significant skill gaps."

# --- Fixed values: ordered first-match classifiers ---------------------------

CONTACT_CLASSES = (
    ("hr", ("hr", "human resources", "talent acquisition", "recruiter", "people ops")),
    ("hiring_manager", ("engineering manager", "vp engineering", "director of engineering",
                        "head of engineering", "cto", "vp of data", "director of data")),
    ("team_lead", ("senior software engineer", "staff engineer", "principal engineer",
                   "tech lead", "senior data scientist")),
)
ACTIONABLE_CONTACT_TYPES = ("hr", "hiring_manager", "team_lead")

ROLE_VARIANTS = (
    ("data", ("data engineer",)),
    ("data", ("senior data engineer",)),
    ("data", ("data platform engineer",)),
    ("data", ("etl engineer",)),
    ("analyst", ("analytics engineer",)),
    ("data", ("ml engineer",)),
    ("analyst", ("data analyst",)),
    ("analyst", ("senior data analyst",)),
    ("analyst", ("business analyst",)),
    ("analyst", ("bi developer",)),
    ("analyst", ("bi analyst",)),
    ("analyst", ("business intelligence",)),
    ("sql", ("sql engineer",)),
    ("sql", ("database engineer",)),
    ("sql", ("database developer",)),
    ("sql", ("sql developer",)),
    ("sql", ("data warehouse engineer",)),
    ("sql", ("database administrator",)),
    ("sde", ("software engineer",)),
    ("sde", ("software developer",)),
    ("sde", ("sde",)),
    ("sde", ("backend engineer",)),
    ("sde", ("platform engineer",)),
    ("sde", ("python developer",)),
    ("sde", ("python engineer",)),
)
ROLE_DEFAULT = "data"

PLATFORMS = (
    ("greenhouse", ("greenhouse.io",)),
    ("lever", ("lever.co",)),
    ("workday", ("workday", "myworkdayjobs.com")),
    ("ashby", ("ashbyhq.com",)),
    ("smartrecruiters", ("smartrecruiters.com",)),
)
LINK_HOSTS = ("greenhouse.io", "lever.co", "myworkdayjobs.com", "ashbyhq.com",
              "smartrecruiters.com")
DIRECT_APPLY_PREFIX = "easy_apply::"

SERVICE_ERRORS = (
    ("credit", ("credit", "quota", "insufficient", "billing", "usage limit", "rate limit",
                "402", "payment", "overloaded", "capacity")),
    ("auth", ("authentication", "unauthorized", "invalid api key", "invalid x-api-key",
              "403", "401", "forbidden", "permission denied")),
)

# --- Fixed values: text that marks an unfinished draft -----------------------

DRAFT_MARKERS = (
    "PASTE YOUR FULL RESUME", "placeholder text", "[SPECIFIC ACHIEVEMENT", "[X]", "[your",
    "[company]", "[specific", "[relevant", "insert your", "I notice", "I'll need your",
    "Please paste", "Please provide", "I'd be happy to help", "I couldn't tailor",
    "don't have my resume details", "don't have your resume", "Paste your resume",
    "fill in the specifics", "e.g.,", "I don't have", "Acme Corp", "At [",
)
GOOD_SAMPLE_EXCLUDES = ("e.g.,",)          # case-sensitive
GOOD_SAMPLE_EXCLUDES_ANY_CASE = ("[company]",)

# --- Fixed values: name clean-up, statuses, schedule -------------------------

COMPANY_REMOVALS = (" inc", " llc", " ltd", " corp", " co.", " corporation", ".", ",")
SPONSOR_REMOVALS = (" inc", " llc", " ltd", " corp", ",", ".")
DOMAIN_REMOVALS = (" inc", " llc", " ltd", ",", ".", " ")

RESET_STATUSES = ("applied", "applying", "failed")
FOLLOWUP_DAYS = (3, 7, 14)
MID_LEVELS = (3, 4)
DEFAULT_THRESHOLD = 80
LOCKED_EMAIL = "email_not_unlocked@domain.com"
PLACEHOLDER_CONTACT = "Hiring Team"
DIGEST_MARKUP = "*📊📅"
EXPORT_HEADERS = ("ID", "Company", "Role", "JD URL", "Source", "Location",
                  "H1B Confirmed", "Status", "Applied At", "Created At")
STATS_LABELS = (
    ("total_jobs", "Total Jobs Found"),
    ("h1b_jobs", "H1B Confirmed"),
    ("applied", "Applied"),
    ("interviews", "Interviews"),
    ("emails_sent", "Emails Sent"),
)
