"""Fixed schemas (as DDL) and limits of the tables this package reads and writes."""

from __future__ import annotations

RAW_POSTING = (
    "job_id string, provider string, title string, description string, company string, location string, "
    "source_url string, employment_type_text string, experience_text string, compensation_text string, "
    "posted_at_text string, provider_job_id string, origin string, relay_source string"
)

#: Raw text limits in UTF-16 units, checked before any cleaning.
TEXT_LIMITS = {
    "title": 200,
    "description": 50_000,
    "company": 200,
    "location": 200,
    "source_url": 2_048,
    "employment_type_text": 100,
    "experience_text": 100,
    "compensation_text": 200,
    "posted_at_text": 100,
    "provider_job_id": 100,
    "relay_source": 100,
}
MAX_RECORD_BYTES = 256 * 1024

WARNING = "struct<code:string,message:string,field:string>"

POSTING = (
    "job_id string, provider string, provider_job_id string, source_url string, source_url_is_official boolean, "
    "title string, company string, location struct<raw:string,city:string,country:string>, remote_mode string, "
    "employment_type string, experience struct<min_years:int,max_years:int,raw:string>, "
    "compensation struct<raw:string,currency:string,min:bigint,max:bigint,period:string,disclosed:boolean>, "
    "description string, required_skills array<string>, preferred_skills array<string>, "
    "responsibilities array<string>, qualifications array<string>, posted_at timestamp, posted_at_raw string, "
    "ingested_at timestamp, source_provenance array<struct<kind:string,detail:string,captured_at:timestamp>>, "
    f"retention_class string, fingerprint string, flags array<{WARNING}>"
)

PROFILE = (
    "profile_id string, schema_version string, created_at timestamp, updated_at timestamp, label string, "
    "headline string, total_experience_years double, skills array<struct<name:string,years:double,level:string>>, "
    "roles array<struct<title:string,company:string,start:string,end:string,highlights:array<string>>>, "
    "education array<struct<qualification:string,institution:string,year:int>>, "
    "certifications array<struct<name:string,issuer:string,year:int>>, "
    "preferences struct<locations:array<string>,remote_modes:array<string>,employment_types:array<string>,"
    "deal_breakers:array<string>,min_compensation:struct<amount:double,currency:string,period:string>>, "
    "summary_text string"
)

TAXONOMY = ("version string, skills array<struct<name:string,aliases:array<string>,category:string>>")

AUDIT = (
    "id bigint, at timestamp, tool string, request_id string, outcome string, error_code string, subject_hash string"
)

POLICY = (
    "provider string, snapshot_date string, stale_after_days int, capability_id string, level string, "
    "status string, reason string, approval_ref string"
)

#: Enumerations.
REMOTE_MODES = ("onsite", "hybrid", "remote", "unknown")
EMPLOYMENT_TYPES = ("full_time", "part_time", "contract", "internship", "temporary", "unknown")
RETENTION_CLASSES = ("session", "standard_180d", "pinned")
ORIGINS = ("user_paste", "agent_relay")
JOB_ID_PATTERN = r"^job_[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\z"
PROFILE_ID_PATTERN = r"^prof_[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\z"
