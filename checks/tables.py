"""Postings, profiles, pairs and requests derived from the given tables.

The tables hold invented prose and no job vocabulary, so short template lists add
it. A template is input data: the same constant is rendered as a Spark literal
and as a SQL literal. No logic is shared between a query and its check.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecast.schemas import PROFILE
from rolecast.session import stored_bytes

BOARDS = ["board_in", "board_global"]
LANGS = ["en", "fr", "de", "es"]
COMPANIES = ["Northwind Data", "Bluepeak Systems", "Quartz & Lime", "Harbor-Line Labs"]
SUFFIXES = [" Pvt. Ltd.", ", Inc", "", " Corporation", " Private Limited"]
TITLES = [
    "Senior Backend Engineer", "Data Analyst", "Lead Platform Architect", "Junior Developer", "Head of Engineering",
    "QA Intern", "Office Coordinator", "Sr. Consultant", "Staff Engineer, Payments", "Associate Designer",
]
# A vocabulary of our own choice: (name, other spellings, category).
SKILLS = [
    ("Python", [], "language"),
    ("Java", [], "language"),
    ("TypeScript", ["TS"], "language"),
    ("Kotlin", [], "language"),
    ("Swift", [], "language"),
    ("Go", ["Golang"], "language"),
    ("C++", [], "language"),
    ("C#", [], "language"),
    ("R", [], "language"),
    ("SQL", [], "language"),
    ("Spring Boot", ["SpringBoot"], "framework"),
    ("React", ["React.js"], "framework"),
    ("Angular", [], "framework"),
    (".NET", [], "framework"),
    ("ASP.NET Core", [], "framework"),
    ("Node.js", ["NodeJS"], "backend"),
    ("REST APIs", ["REST", "REST API"], "backend"),
    ("Kafka", ["Apache Kafka"], "backend"),
    ("Android", [], "mobile"),
    ("iOS", [], "mobile"),
    ("AWS Lambda", [], "cloud"),
    ("AWS", [], "cloud"),
    ("Docker", [], "devops"),
    ("Kubernetes", ["K8s"], "devops"),
    ("Terraform", [], "devops"),
    ("Spark", ["Apache Spark", "PySpark"], "data"),
    ("Airflow", [], "data"),
    ("Power BI", [], "data"),
    ("Machine Learning", ["ML"], "ai_ml"),
    ("PostgreSQL", ["Postgres"], "database"),
    ("SQL Server", [], "database"),
    ("MongoDB", [], "database"),
    ("Payments", [], "domain"),
    ("Banking", [], "domain"),
    ("Scrum", [], "methodology"),
]
LANG_TITLES = [
    "Senior Backend Engineer", "Data Platform Analyst", "Lead Mobile Developer", "Cloud Security Consultant",
]
LANG_TITLES_TURNED = [
    "Backend Engineer, Senior", "Analyst - Data Platform", "Mobile Developer (Lead)", "Consultant Cloud Security",
]
LOCATIONS = [
    "Bengaluru, India", "Remote, United States", None, "Pune - Hybrid", "Toronto, Canada", "Gurgaon (Haryana) / remote",
    "Anywhere", "Berlin, Germany", "Newnoida, Noida", "Singapore", "London, UK onsite", "Mysore / Hybrid, India", "",
]
EXPERIENCE = [
    "5-8 years", "5 - 10 Yrs", None, "3+ years", "minimum 4 years", "at least 3 yrs", "fresher", "2 years", "61 years",
    "10-5 years", "not stated", "",
]
PAY = [
    "₹ 12-18 Lacs P.A.", None, "12-18 LPA", "1.2 Cr", "₹30,000 - ₹45,000 a month", "$120,000 - $150,000 a year",
    "$25 an hour", "Not Disclosed", "12,34,56", "1 - 2 Crore", "INR 8,50,000", "Salary: 10 to 15 lakhs ctc", "negotiable",
    "€ 50.55 - 60.10 per hour", "", "9 - 4 LPA", "1,600,000",
]
DATES = [
    "2026-09-25", "25 Sep 2026", None, "25/09/2026", "2026-02-30", "3 days ago", "2026-03-04T05:06:07.250Z",
    "2026-03-04T23:30:00+05:30", "1 jan 2025", "",
]
TYPES = ["Full Time, Permanent", None, "contractual role", "part-time", "temporary", "internship", "flexible"]
ORIGINS = ["user_paste", "agent_relay", None]
RELAYS = ["desk relay", None]
URLS = [
    None, "https://jobs.board-in.example/view/", "https://other.example/jobs/", "https://BOARD-GLOBAL.example:443/j/",
]
RETENTION = ["session", "standard_180d", "standard_180d", "pinned", "standard_180d"]
HEADS = [
    "We are looking for an engineer. Requirements: 5+ years of Python required. Must know SQL and Docker.\n"
    "- Kubernetes is a plus\nNice to have: Terraform, AWS Lambda\nResponsibilities:\n* Own the billing service\n"
    "* Travel to client sites\nSalary: 12-18 LPA\nJob description:",
    "Key Skills: Java, Spring Boot; Microservices, Kafka\nNotice period of 30 days\nDesired candidate profile\n"
    "Bachelor degree in CS with Java\nonly male candidates\nGood to have - React.js or Angular\nOverview",
    "About the role: data platform work, e.g. pipelines. Night shift applies. Qualifications: Apache Spark, Airflow "
    "and dbt. Preferred: Snowflake or BigQuery.\nBenefits: gym. Job details\nFull-time\nSummary:",
    "What you will do: build mobile apps! Kotlin must. Swift required.\nAge limit below 30 years\nPerks: food\n"
    "Must have: Android, iOS\nNice-to-have: Flutter, Go, go-karts\nJob summary",
    "Remote work from home. 3-5 years with Node.js / TypeScript.\nRequirements\n1. REST APIs and GraphQL\n2) MongoDB\n"
    "3. Relocation possible, SQL Server mandatory\nBonus: C++ and C#\nAbout us:",
    "Hybrid office in Pune. ₹ 8,00,000 - ₹ 12,00,000 per annum\nMust-have: PostgreSQL; Redis. PMP certified\n"
    "Preferred: .NET, ASP.NET Core\nYoung candidates only. Religion: any\nRole summary:",
    "Responsibilities: write reports. Maintain dashboards in Power BI or Tableau. Requirements: R, ETL. Scrum\n"
    "Unmarried women only\nVisa sponsorship\nJob description -",
    "No cues in this one\nJob description",
]
LANG_HEADS = [
    "Requirements: Python and SQL\nJob description:",
    "Requirements: Java and Spring Boot\nJob description:",
    "Requirements: Kotlin and Android\nJob description:",
    "Requirements: AWS and Terraform\nJob description:",
]

PROFILES = [
    {"label": "Backend", "skills": ["Python", "sql ", "Docker"], "roles": [["Backend Engineer (Java)", ["Built Spring Boot services on Kubernetes", "Cut costs with Terraform"]]],
     "certifications": ["AWS Lambda Associate"], "education": ["B.Tech Computer Science"], "summary": "Python and Kafka engineer.",
     "locations": ["Bangalore"], "remote_modes": ["hybrid", "remote"], "employment_types": ["full_time"], "deal_breakers": ["night shift", "travel"]},
    {"label": "Data", "skills": ["Apache Spark", "SQL", "dbt", "Snowflake"], "roles": [["Data Engineer", ["Airflow pipelines in C++ and Python", "Migrated Oracle to PostgreSQL"]], ["Analyst", ["Power BI and Tableau reports"]]],
     "certifications": [], "education": ["MCA"], "summary": None,
     "locations": ["Pune", "Mumbai"], "remote_modes": [], "employment_types": ["full_time", "contract"], "deal_breakers": []},
    {"label": "Mobile", "skills": ["Kotlin", "Swift"], "roles": [["Android Developer", ["Shipped Flutter and React apps", "No iOS work; Go services"]]],
     "certifications": ["Scrum Master"], "education": [], "summary": "Mobile developer with REST experience and .NET background.",
     "locations": [], "remote_modes": ["remote"], "employment_types": [], "deal_breakers": ["relocation", " "]},
    {"label": "Fresher", "skills": [], "roles": [], "certifications": [], "education": ["B.E. Mechanical"], "summary": "Learning Java and HTML",
     "locations": ["Gurugram"], "remote_modes": ["onsite"], "employment_types": ["internship"], "deal_breakers": ["C++"]},
    {"label": "Cloud", "skills": ["AWS", "Terraform", "Kubernetes", "node.js"], "roles": [["Cloud Architect", ["Led SQL Server to AWS moves", "GraphQL gateways, " + "long platform story " * 20 + "with Redis inside " + "and more text " * 12]]],
     "certifications": ["Docker Certified", "ISO 27001 Auditor"], "education": ["MBA"], "summary": None,
     "locations": ["Mysuru, Karnataka"], "remote_modes": ["hybrid"], "employment_types": ["contract"], "deal_breakers": ["visa"]},
    {"label": "Quiet", "skills": ["Figma"], "roles": [["Designer", []]], "certifications": [], "education": [], "summary": None,
     "locations": [], "remote_modes": [], "employment_types": [], "deal_breakers": []},
    {"label": "Lead", "skills": ["Java", "Microservices", "Scrum", "Python"], "roles": [["Engineering Lead", ["Own payments in Java and Kafka", "Mentors on Test Driven Development"]]],
     "certifications": [], "education": ["Bachelor of Engineering"], "summary": "Leads teams; SQL, ETL.",
     "locations": ["Remote", "Toronto"], "remote_modes": ["remote", "onsite"], "employment_types": ["full_time", "part_time"], "deal_breakers": ["age limit"]},
]
PROFILE_HALF_YEARS = [0, 1, 4, 6, 10, 13, 20, 26, 34]


# ---------------------------------------------------------------- rendering


def pick(values: list, index: Column) -> Column:
    """Element of a template list, as a literal array lookup."""
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), index.cast("int") + 1)


def sql_text(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def sql_pick(values: list, index: str) -> str:
    return f"([{', '.join(sql_text(v) for v in values)}])[({index}) + 1]"


def profile_json(entry: dict) -> str:
    return json.dumps(
        {
            "label": entry["label"],
            "headline": f"{entry['label']} profile",
            "skills": [{"name": s} for s in entry["skills"]],
            "roles": [
                {"title": t, "company": "Acme", "start": "2020-01", "end": "present", "highlights": h} for t, h in entry["roles"]
            ],
            "education": [{"qualification": q, "institution": "State"} for q in entry["education"]],
            "certifications": [{"name": c} for c in entry["certifications"]],
            "preferences": {
                k: entry[k] for k in ("locations", "remote_modes", "employment_types", "deal_breakers")
            },
            "summary_text": entry["summary"],
        }
    )


# ---------------------------------------------------------------- Spark side


#: Stored bytes of wide rows that one task works on.
TASK_BYTES = 4 << 20
#: The same of a party table.
PARTY_BYTES = 256 << 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Wide rows are spread out: over all cores, and over more tasks as the table grows."""
    path = f"{sf_dir}/{name}.parquet"
    df = spark.read.parquet(path)
    if name not in ("documents", "pages"):
        return df
    return df.repartition(max(spark.sparkContext.defaultParallelism, -(-stored_bytes(spark, path) // TASK_BYTES)))


def posting_id(key: Column) -> Column:
    return F.format_string("job_%08x-0000-4000-8000-%012x", key, key)


def profile_id(key: Column) -> Column:
    return F.format_string("prof_%08x-0000-4000-8000-%012x", key, key)


def lang_index(lang: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LANGS]), lang) - 1


def raw_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw posting per document."""
    docs = table(spark, sf_dir, "documents")
    d = F.col("doc_id")
    return docs.select(
        "doc_id",
        posting_id(d).alias("job_id"),
        pick(BOARDS, d % len(BOARDS)).alias("provider"),
        pick(TITLES, d % len(TITLES)).alias("title"),
        F.concat(pick(HEADS, d % len(HEADS)), F.lit("\n"), F.col("text")).alias("description"),
        F.concat(pick(COMPANIES, lang_index(F.col("lang"))), pick(SUFFIXES, d % len(SUFFIXES))).alias("company"),
        pick(LOCATIONS, d % len(LOCATIONS)).alias("location"),
        F.concat(pick(URLS, d % len(URLS)), d.cast("string")).alias("source_url"),
        pick(TYPES, d % len(TYPES)).alias("employment_type_text"),
        pick(EXPERIENCE, d % len(EXPERIENCE)).alias("experience_text"),
        pick(PAY, d % len(PAY)).alias("compensation_text"),
        pick(DATES, d % len(DATES)).alias("posted_at_text"),
        F.concat(F.lit("P"), d.cast("string")).alias("provider_job_id"),
        pick(ORIGINS, d % len(ORIGINS)).alias("origin"),
        pick(RELAYS, d % len(RELAYS)).alias("relay_source"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=d.cast("int"))).alias("ingested_at"),
        pick(RETENTION, d % len(RETENTION)).alias("retention_class"),
    )


def copy_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings whose title, company and head depend on the language only, so copies stay copies."""
    docs = table(spark, sf_dir, "documents")
    d, at = F.col("doc_id"), lang_index(F.col("lang"))
    return docs.select(
        "doc_id",
        posting_id(d).alias("job_id"),
        F.when(d % 2 == 0, pick(LANG_TITLES, at)).otherwise(pick(LANG_TITLES_TURNED, at)).alias("title"),
        F.concat(pick(COMPANIES, at), pick(SUFFIXES, d % len(SUFFIXES))).alias("company"),
        F.lit(None).cast("string").alias("location"),
        F.concat(pick(LANG_HEADS, at), F.lit("\n"), F.col("text")).alias("description"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=d.cast("int"))).alias("ingested_at"),
    )


def page_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings cut from raw web pages: real markup, real addresses, some broken on purpose."""
    p = F.col("page_id")
    title = pick(["<b>Data</b> &amp; Platform Engineer", "Café&#x301; &#8211; Lead", "<p></p>", "Plain Title"], p % 4)
    return table(spark, sf_dir, "pages").select(
        "page_id",
        posting_id(p).alias("job_id"),
        pick(BOARDS, p % 2).alias("provider"),
        F.when(p % 17 == 5, F.repeat(F.lit("x"), 201)).otherwise(title).alias("title"),
        F.when(p % 19 == 3, F.repeat(F.lit("<i>long</i> "), 5000)).otherwise(F.col("html")).alias("description"),
        F.lit(None).cast("string").alias("company"),
        F.when(p % 23 == 7, F.repeat(F.lit("L"), 201)).alias("location"),
        F.col("url").alias("source_url"),
        F.lit(None).cast("string").alias("employment_type_text"),
        F.lit(None).cast("string").alias("experience_text"),
        F.lit(None).cast("string").alias("compensation_text"),
        F.lit(None).cast("string").alias("posted_at_text"),
        F.lit(None).cast("string").alias("provider_job_id"),
        F.when(p % 29 == 4, "robot").otherwise("user_paste").alias("origin"),
        F.lit(None).cast("string").alias("relay_source"),
    )


def profiles(spark: SparkSession, sf_dir: str, source: str = "supplier", key: str = "s_suppkey") -> DataFrame:
    """One profile per row of a party table."""
    k = F.col(key)
    entry = F.from_json(pick([profile_json(p) for p in PROFILES], k % len(PROFILES)), PROFILE)
    half = F.element_at(F.array(*[F.lit(h) for h in PROFILE_HALF_YEARS]), (k % len(PROFILE_HALF_YEARS)).cast("int") + 1)
    at = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=k.cast("int"))
    changed = {
        "profile_id": profile_id(k),
        "schema_version": F.lit("1"),
        "created_at": at,
        "updated_at": at,
        "total_experience_years": half / 2.0,
    }
    # A key of some bytes becomes a profile of a kilobyte, so that few stored bytes make a task.
    parts = max(spark.sparkContext.defaultParallelism, -(-stored_bytes(spark, f"{sf_dir}/{source}.parquet") // PARTY_BYTES))
    rows = table(spark, sf_dir, source).select(key).repartition(parts, key).select(key, entry.alias("p"))
    names = rows.select("p.*").columns
    return rows.select(*[changed.get(n, F.col(f"p.{n}")).alias(n) for n in names])


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested comparisons: the part of each order line names a posting, its supplier a profile."""
    count = table(spark, sf_dir, "documents").count()
    # Numbers are told apart before ids are written out: a fifth of the bytes to shuffle.
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % count).alias("posting"), F.col("l_suppkey").alias("profile")).distinct()
    return lines.select(posting_id(F.col("posting")).alias("job_id"), profile_id(F.col("profile")).alias("profile_id"))


CAPABILITIES = [
    # provider, snapshot_date, stale_after_days, capability_id, level, status, reason, approval_ref
    ("board_in", "2024-01-01", 30, "signup", "L0", "enabled", "Local analysis", None),
    ("board_in", "2024-01-01", 30, "view", "L1", "enabled", "Board search", "APPROVAL-BOARD_IN-001"),
    ("board_in", "2024-01-01", 30, "click", "L1", "blocked_by_provider_approval", "Needs approval", None),
    ("board_in", "2024-01-01", 30, "purchase", "L4", "enabled", "Submit for the user", "APPROVAL-BOARD_IN-002"),
    ("board_global", "2023-12-15", 3, "signup", "L0", "enabled", "Local analysis abroad", None),
    ("board_global", "2023-12-15", 3, "view", "L1", "enabled", "Global search", "APPROVAL-BOARD_GLOBAL-001"),
    ("board_global", "2023-12-15", 3, "click", "L1", "enabled", "No reference yet", None),
]


def policies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        CAPABILITIES,
        "provider string, snapshot_date string, stale_after_days int, capability_id string, level string, "
        "status string, reason string, approval_ref string",
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per event; its type names the capability, every fifth one a pending feature."""
    e, u = F.col("event_id"), F.col("user_id")
    return table(spark, sf_dir, "events").select(
        e.alias("id"),
        F.date_trunc("millisecond", "ts").alias("at"),
        F.concat(F.lit("tool_"), F.col("event_type")).alias("tool"),
        F.format_string("req-%d", e).alias("request_id"),
        pick(BOARDS, e % len(BOARDS)).alias("provider"),
        F.col("event_type").alias("capability_id"),
        F.when(e % 3 == 0, posting_id(u)).when(e % 3 == 1, profile_id(u)).otherwise(F.concat(F.lit("u"), u.cast("string"))).alias("subject_id"),
    )


# ---------------------------------------------------------------- SQL side

_ID = "format('{{}}_{{:08x}}-0000-4000-8000-{{:012x}}', '{prefix}', {key}, {key})"


def sql_id(prefix: str, key: str) -> str:
    return _ID.format(prefix=prefix, key=key)


_LANG = f"(list_position([{', '.join(sql_text(x) for x in LANGS)}], lang) - 1)"

RAW_SQL = f"""raw AS (
  SELECT doc_id, {sql_id('job', 'doc_id')} AS job_id,
    {sql_pick(BOARDS, f'doc_id % {len(BOARDS)}')} AS provider,
    {sql_pick(TITLES, f'doc_id % {len(TITLES)}')} AS title,
    {sql_pick(HEADS, f'doc_id % {len(HEADS)}')} || chr(10) || text AS description,
    {sql_pick(COMPANIES, _LANG)} || {sql_pick(SUFFIXES, f'doc_id % {len(SUFFIXES)}')} AS company,
    {sql_pick(LOCATIONS, f'doc_id % {len(LOCATIONS)}')} AS location,
    {sql_pick(URLS, f'doc_id % {len(URLS)}')} || doc_id AS source_url,
    {sql_pick(TYPES, f'doc_id % {len(TYPES)}')} AS employment_type_text,
    {sql_pick(EXPERIENCE, f'doc_id % {len(EXPERIENCE)}')} AS experience_text,
    {sql_pick(PAY, f'doc_id % {len(PAY)}')} AS compensation_text,
    {sql_pick(DATES, f'doc_id % {len(DATES)}')} AS posted_at_text,
    'P' || doc_id AS provider_job_id,
    {sql_pick(ORIGINS, f'doc_id % {len(ORIGINS)}')} AS origin,
    {sql_pick(RELAYS, f'doc_id % {len(RELAYS)}')} AS relay_source,
    TIMESTAMP '2024-01-01' + to_hours(doc_id) AS ingested_at,
    {sql_pick(RETENTION, f'doc_id % {len(RETENTION)}')} AS retention_class
  FROM documents)"""

COPY_SQL = f"""raw AS (
  SELECT doc_id, {sql_id('job', 'doc_id')} AS job_id,
    CASE WHEN doc_id % 2 = 0 THEN {sql_pick(LANG_TITLES, _LANG)} ELSE {sql_pick(LANG_TITLES_TURNED, _LANG)} END AS title,
    {sql_pick(COMPANIES, _LANG)} || {sql_pick(SUFFIXES, f'doc_id % {len(SUFFIXES)}')} AS company,
    {sql_pick(LANG_HEADS, _LANG)} || chr(10) || text AS description,
    TIMESTAMP '2024-01-01' + to_hours(doc_id) AS ingested_at
  FROM documents)"""

PAGE_SQL = f"""raw AS (
  SELECT page_id, {sql_id('job', 'page_id')} AS job_id, {sql_pick(BOARDS, 'page_id % 2')} AS provider,
    CASE WHEN page_id % 17 = 5 THEN repeat('x', 201) ELSE
      {sql_pick(["<b>Data</b> &amp; Platform Engineer", "Café&#x301; &#8211; Lead", "<p></p>", "Plain Title"], 'page_id % 4')} END AS title,
    CASE WHEN page_id % 19 = 3 THEN repeat('<i>long</i> ', 5000) ELSE html END AS description,
    CASE WHEN page_id % 23 = 7 THEN repeat('L', 201) END AS location, url AS source_url,
    CASE WHEN page_id % 29 = 4 THEN 'robot' ELSE 'user_paste' END AS origin
  FROM pages)"""


def profile_sql(source: str = "supplier", key: str = "s_suppkey") -> str:
    return f"""prof AS (
  SELECT {key} AS pkey, {sql_id('prof', key)} AS profile_id, {key} % {len(PROFILES)} AS tpl,
    ([{', '.join(str(h) for h in PROFILE_HALF_YEARS)}])[({key} % {len(PROFILE_HALF_YEARS)}) + 1] / 2.0::DOUBLE AS years,
    {sql_pick([p['label'] for p in PROFILES], f'{key} % {len(PROFILES)}')} AS label,
    TIMESTAMP '2024-01-01' + to_minutes({key}) AS updated_at
  FROM {source})"""


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    lines = ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else sql_text(v) for v in r) + ")" for r in rows)
    return f"{name}({columns}) AS (VALUES {lines})"


def profile_fields() -> list[tuple]:
    """(template, kind, section, i, j, path, text) of every searchable profile field."""
    rows = []
    for n, p in enumerate(PROFILES):
        rows += [(n, "skill", 1, i, 0, f"skills[{i}].name", s) for i, s in enumerate(p["skills"])]
        for i, (title, highlights) in enumerate(p["roles"]):
            rows.append((n, "role", 2, i, 0, f"roles[{i}].title", title))
            rows += [(n, "role", 2, i, j + 1, f"roles[{i}].highlights[{j}]", h) for j, h in enumerate(highlights)]
        rows += [(n, "other", 3, i, 0, f"certifications[{i}].name", c) for i, c in enumerate(p["certifications"])]
        rows += [(n, "other", 4, i, 0, f"education[{i}].qualification", q) for i, q in enumerate(p["education"])]
        if p["summary"]:
            rows.append((n, "other", 5, 0, 0, "summary_text", p["summary"]))
    return rows


FIELD_SQL = _values("field", "tpl, kind, section, i, j, field_path, text", profile_fields())
PREF_SQL = _values(
    "pref",
    "tpl, kind, pos, value",
    [
        (n, kind, pos, value)
        for n, p in enumerate(PROFILES)
        for kind in ("locations", "remote_modes", "employment_types", "deal_breakers")
        for pos, value in enumerate(p[kind])
    ],
)

PAIR_SQL = f"""pair AS (
  SELECT DISTINCT doc_id, pkey, {sql_id('job', 'doc_id')} AS job_id, {sql_id('prof', 'pkey')} AS profile_id
  FROM (SELECT l_partkey % (SELECT count(*) FROM documents) AS doc_id, l_suppkey AS pkey FROM lineitem))"""

POLICY_SQL = _values(
    "policy",
    "provider, snapshot_date, stale_after_days, capability_id, level, status, policy_reason, approval_ref",
    CAPABILITIES,
)

REQUEST_SQL = f"""request AS (
  SELECT event_id AS id, date_trunc('millisecond', ts) AS at, 'tool_' || event_type AS tool, 'req-' || event_id AS request_id,
    {sql_pick(BOARDS, f'event_id % {len(BOARDS)}')} AS provider, event_type AS capability_id,
    CASE WHEN event_id % 3 = 0 THEN {sql_id('job', 'user_id')} WHEN event_id % 3 = 1 THEN {sql_id('prof', 'user_id')}
      ELSE 'u' || user_id END AS subject_id
  FROM events)"""
