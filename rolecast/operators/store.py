"""Queries and deletions over the stored tables."""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterable, Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecast.schemas import JOB_ID_PATTERN

#: Defaults of the feature; callers may ask for more.
MAX_RECENT = 500
MAX_PAGE = 50
#: Beyond these a request is refused, never shortened.
PAGE_LIMIT = 10_000
MAX_QUERY = 200
RETENTION_DAYS = 180
FILTER_COLUMNS = ("remote_mode", "employment_type", "retention_class")


def newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("ingested_at"), F.desc("job_id"))


def checked(value: int, low: int, high: int | None, name: str) -> int:
    """The value itself, or an error: a request is obeyed or refused."""
    if value < low or (high is not None and value > high):
        raise ValueError(f"{name} must be at least {low}" + (f" and at most {high}" if high else ""))
    return value


# ---------------------------------------------------------------- lookups


def get_postings(jobs: DataFrame, ids: DataFrame, include_description: bool = False) -> DataFrame:
    """Postings by id. The untrusted description is shown only when asked for."""
    found = jobs.join(ids.select("job_id").distinct(), "job_id", "left_semi")
    shown = F.col("description") if include_description else F.lit(None).cast("string")
    return found.withColumn("untrusted_description", shown).drop("description")


def find_by_fingerprint(jobs: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """One posting per requested fingerprint: the one with the lowest id."""
    wanted = jobs.join(fingerprints.select("fingerprint").distinct(), "fingerprint", "left_semi")
    first = wanted.groupBy("fingerprint").agg(F.min("job_id").alias("job_id"))
    return jobs.join(first.select("job_id"), "job_id", "left_semi")


def recent(jobs: DataFrame, n: int = 50) -> DataFrame:
    """The n newest postings, ties by id from the top."""
    return newest_first(latest_days(jobs, checked(n, 1, None, "n"))).limit(n)


# ---------------------------------------------------------------- paging


def encode_cursor(ingested_at: datetime, job_id: str) -> str:
    moment = ingested_at.astimezone(timezone.utc) if ingested_at.tzinfo else ingested_at
    stamp = moment.strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    payload = json.dumps({"ingested_at": stamp, "job_id": job_id}, separators=(",", ":"))
    return base64.urlsafe_b64encode(payload.encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> tuple[str, str]:
    """(ingested_at, job_id) of a cursor; anything malformed is an error."""
    try:
        payload = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    except (binascii.Error, ValueError) as error:
        raise ValueError("Malformed keyset cursor") from error
    valid = (
        isinstance(payload, dict)
        and set(payload) == {"ingested_at", "job_id"}
        and all(isinstance(v, str) for v in payload.values())
        and re.match(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z$", payload["ingested_at"])
        and re.match(JOB_ID_PATTERN.replace(r"\z", "$"), payload["job_id"])
    )
    if not valid:
        raise ValueError("Invalid cursor payload structure")
    return payload["ingested_at"], payload["job_id"]


def cursor_column(ingested_at: Column, job_id: Column) -> Column:
    """The cursor of every row, as ``encode_cursor`` builds it: exact, as rows of one batch share a stamp."""
    stamp = F.date_format(ingested_at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    plain = F.base64(F.encode(F.to_json(F.struct(stamp.alias("ingested_at"), job_id.alias("job_id"))), "UTF-8"))
    return F.regexp_replace(F.translate(plain, "+/", "-_"), r"[=\s]", "")


def keyset_page(jobs: DataFrame, cursor: str | None) -> DataFrame:
    """Rows strictly after the cursor in newest-first order. Both comparisons reach the scan."""
    if cursor is None:
        return jobs
    moment, job_id = decode_cursor(cursor)
    at = F.to_timestamp(F.lit(moment))
    after = (F.col("ingested_at") <= at) & ((F.col("ingested_at") < at) | (F.col("job_id") < F.lit(job_id)))
    # In a table by days the later ones need not be opened.
    return jobs.filter(after & (F.col("ingest_day") <= F.to_date(at))) if "ingest_day" in jobs.columns else jobs.filter(after)


def filter_postings(jobs: DataFrame, filters: Mapping[str, Sequence[str]] | None, empty_excludes: bool = False) -> DataFrame:
    """IN filters on mode, contract and retention. An empty list is no filter for listing and
    search, and excludes everything for a shortlist (``empty_excludes``)."""
    for column in FILTER_COLUMNS:
        values = (filters or {}).get(column)
        if values is None or (not values and not empty_excludes):
            continue
        jobs = jobs.filter(F.col(column).isin(list(values))) if values else jobs.filter(F.lit(False))
    return jobs


def latest_days(jobs: DataFrame, rows: int, cursor: str | None = None) -> DataFrame:
    """Of a table stored by days, the latest days up to the cursor that hold at least ``rows`` rows; other tables as they are.

    The window takes the last one, two, four, ... stored days until it holds enough or everything,
    so the files opened do not grow with the table. Which days there are is read off the folders.
    """
    folders = {m[1] for f in (jobs.inputFiles() if "ingest_day" in jobs.columns else []) if (m := re.search(r"/ingest_day=(\d{4}-\d\d-\d\d)/", f))}
    last = decode_cursor(cursor)[0][:10] if cursor else "9999"
    days = sorted((d for d in folders if d <= last), reverse=True)
    width = 1
    while width < len(days):
        window = jobs.filter(F.col("ingest_day") >= F.lit(days[width - 1]).cast("date"))
        if window.select("ingest_day").limit(rows).count() >= rows:
            return window
        width *= 2
    return jobs


def posting_summary(jobs: DataFrame) -> DataFrame:
    return jobs.select(
        "job_id", "provider", "title", "company", "remote_mode", "employment_type", "ingested_at", "retention_class",
        "source_url_is_official",
        F.col("location.raw").alias("location_raw"),
        F.col("experience.min_years").alias("experience_min_years"),
        F.col("experience.max_years").alias("experience_max_years"),
        F.col("compensation.disclosed").alias("compensation_disclosed"),
        F.size("flags").alias("flag_count"),
    )


def _page(jobs: DataFrame, page_size: int, cursor: str | None) -> DataFrame:
    """At most page_size summaries; the last row carries ``next_cursor`` when more follow."""
    size = checked(page_size, 1, PAGE_LIMIT, "page_size")
    ahead = newest_first(posting_summary(latest_days(jobs, size + 1, cursor))).limit(size + 1)
    # One page and a row are left, so one window over all of them is small by construction.
    rank = F.expr("row_number() OVER (ORDER BY ingested_at DESC, job_id DESC)")
    total = F.expr("count(*) OVER ()")
    ranked = ahead.withColumns({"_rank": rank, "_total": total})
    more = (F.col("_rank") == size) & (F.col("_total") > size)
    cursor = F.when(more, cursor_column(F.col("ingested_at"), F.col("job_id")))
    return ranked.filter(F.col("_rank") <= size).withColumn("next_cursor", cursor).drop("_rank", "_total")


def list_postings(
    jobs: DataFrame,
    filters: Mapping[str, Sequence[str]] | None = None,
    page_size: int = MAX_PAGE,
    cursor: str | None = None,
) -> DataFrame:
    return _page(keyset_page(filter_postings(jobs, filters), cursor), page_size, cursor)


def search_text(jobs: DataFrame) -> Column:
    parts = [
        "title", F.coalesce("company", F.lit("")), F.coalesce("location.raw", F.lit("")),
        F.coalesce("location.city", F.lit("")), F.coalesce("location.country", F.lit("")),
    ]
    skills = F.concat("required_skills", "preferred_skills")
    listed = F.when(F.size(skills) > 0, F.concat(F.lit(" "), F.array_join(skills, " "))).otherwise("")
    return F.lower(F.concat(F.concat_ws(" ", *parts), listed, F.lit(" "), "description"))


def search_postings(
    jobs: DataFrame,
    query: str,
    filters: Mapping[str, Sequence[str]] | None = None,
    page_size: int = MAX_PAGE,
    cursor: str | None = None,
) -> DataFrame:
    """Postings whose text contains the query literally, case folded; wildcards have no meaning."""
    if len(query) > MAX_QUERY:
        raise ValueError(f"a query has at most {MAX_QUERY} characters")
    needle = query.strip().lower()
    matching = filter_postings(keyset_page(jobs, cursor), filters).filter(F.contains(search_text(jobs), F.lit(needle)))
    return _page(matching, page_size, cursor)


# ---------------------------------------------------------------- deletion


def delete_keys(df: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept rows, one-row count of deleted rows)."""
    wanted = ids.select(key).distinct()
    kept = df.join(wanted, key, "left_anti")
    deleted = df.join(wanted, key, "left_semi").agg(F.count(F.lit(1)).alias("deleted"))
    return kept, deleted


def retention_action(now: Column) -> Column:
    """'session' or 'expired' for rows that retention drops, null for rows that stay."""
    cutoff = now - F.expr(f"INTERVAL {RETENTION_DAYS * 24} HOURS")
    return F.when(F.col("retention_class") == "session", "session").when(
        (F.col("retention_class") == "standard_180d") & (F.col("ingested_at") < cutoff), "expired"
    )


def apply_retention(df: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(kept rows, one-row counts session_deleted and expired_deleted)."""
    action = retention_action(now)
    counts = df.agg(
        F.count_if(action == "session").alias("session_deleted"), F.count_if(action == "expired").alias("expired_deleted")
    )
    return df.filter(action.isNull()), counts


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    counts: Iterable[DataFrame] = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    result = None
    for one in counts:
        result = one if result is None else result.unionByName(one)
    return result


def erase_all(tables: Mapping[str, DataFrame], now: Column) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(row counts, emptied tables). The audit table keeps one row that records the erasure."""
    counts = table_counts(tables).select(F.col("table_name"), F.col("row_count").alias("purged"))
    emptied = {name: df.limit(0) for name, df in tables.items()}
    if "audit" in tables:
        audit = tables["audit"]
        spark = audit.sparkSession
        entry = {
            "id": F.lit(1).cast("bigint"), "at": now, "tool": F.lit("data_purge"), "request_id": F.lit("purge"),
            "outcome": F.lit("ok"), "error_code": F.lit(None).cast("string"), "subject_hash": F.lit(None).cast("string"),
        }
        emptied["audit"] = spark.range(1).select(*[entry[c].alias(c) for c in audit.columns])
    return counts, emptied


def list_profiles(profiles: DataFrame) -> DataFrame:
    return profiles.select("profile_id", "label", "updated_at").orderBy(F.desc("updated_at"), "profile_id")
