"""Raw posting text to typed posting rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecast.functions.parsing import (
    employment_type,
    fingerprint,
    parse_location,
    parse_posted_at,
    pay_fragment,
    posting_remote_mode,
    with_compensation,
    with_experience,
)
from rolecast.functions.regex import js_trim
from rolecast.operators.ingest import warning_if
from rolecast.providers import DEFAULT_PROVIDERS, Provider


def normalize_postings(
    src: DataFrame, now: Column, providers: Sequence[Provider] = DEFAULT_PROVIDERS
) -> DataFrame:
    """Add all typed posting columns and ``parse_warnings`` to cleaned raw postings.

    A missing experience or pay text falls back to the description (an empty one does not),
    and only texts that were supplied can cause a warning. ``url_check`` is read where present.
    """
    provider = F.col("provider")
    df = with_experience(src, F.coalesce("experience_text", "description"), provider, providers)
    df = with_compensation(
        df, F.coalesce("compensation_text", pay_fragment(F.col("description"))), provider, providers
    )
    df = df.withColumn("posted_at", parse_posted_at(F.col("posted_at_text"), provider, providers))

    def supplied(name: str) -> Column:
        return F.coalesce(F.col(name) != "", F.lit(False))

    unread_experience = F.col("experience_unparsed") & ~supplied("experience_text")
    blank = F.struct(
        F.lit(None).cast("int").alias("min_years"),
        F.lit(None).cast("int").alias("max_years"),
        F.lit(None).cast("string").alias("raw"),
    )
    undated = F.coalesce(js_trim(F.col("posted_at_text")) != "", F.lit(False)) & F.col("posted_at").isNull()
    warnings = F.concat(
        warning_if(
            F.col("experience_unparsed") & supplied("experience_text"),
            "FIELD_UNPARSED", "Experience could not be parsed", "experience",
        ),
        warning_if(
            F.col("compensation_unparsed") & supplied("compensation_text"),
            "FIELD_UNPARSED", "Compensation could not be parsed", "compensation",
        ),
        warning_if(undated, "FIELD_UNPARSED", "Posted date is not an absolute date", "posted_at"),
    )
    checked = "url_check" in src.columns
    columns = {
        "experience": F.when(unread_experience, blank).otherwise(F.col("experience")),
        "parse_warnings": warnings,
        "source_url": F.col("url_check.url") if checked else F.lit(None).cast("string"),
        "source_url_is_official": F.coalesce(F.col("url_check.is_official"), F.lit(False)) if checked else F.lit(False),
        "remote_mode": posting_remote_mode(F.col("location"), F.col("description")),
        "employment_type": employment_type(F.col("employment_type_text"), F.col("description")),
        "posted_at_raw": F.col("posted_at_text"),
        "fingerprint": fingerprint(F.col("title"), F.col("company"), F.col("location"), F.col("description")),
        "location": parse_location(F.col("location")),
    }
    if "ingested_at" not in src.columns:
        columns["ingested_at"] = now.cast("timestamp")
    if "retention_class" not in src.columns:
        columns["retention_class"] = F.lit("standard_180d")
    return df.withColumns(columns).drop("experience_unparsed", "compensation_unparsed")
