"""Screening of raw postings: limits, cleaning, address checks, warnings, provenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecast.functions.injection import injection_signals
from rolecast.functions.regex import utf16_length
from rolecast.functions.text import sanitize_text, sanitize_warnings
from rolecast.functions.urls import check_urls
from rolecast.providers import DEFAULT_PROVIDERS, Provider, official_hosts
from rolecast.operators.store import checked
from rolecast.plans.stage import stage
from rolecast.schemas import MAX_RECORD_BYTES, ORIGINS, TEXT_LIMITS, WARNING
from rolecast.session import cut_lineage


def warning(code: str, message: Column | str, field: str | None = None) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.struct(
        F.lit(code).alias("code"), text.alias("message"), F.lit(field).cast("string").alias("field")
    ).cast(WARNING)


def warning_if(condition: Column, code: str, message: str, field: str | None = None) -> Column:
    none = F.array().cast(f"array<{WARNING}>")
    return F.when(condition, F.array(warning(code, message, field))).otherwise(none)


def screen_postings(src: DataFrame, providers: Sequence[Provider] = DEFAULT_PROVIDERS) -> DataFrame:
    """Clean every posting and say why it is rejected, if it is.

    Adds ``reject_code`` (null for good rows), ``raw`` (the input row), ``url_check``,
    ``signals`` and ``screen_warnings``; the text columns hold cleaned text.
    """
    fields = [c for c in TEXT_LIMITS if c in src.columns]
    origin = F.coalesce("origin", F.lit("user_paste"))
    too_long = F.lit(False)
    for name in fields:
        too_long = too_long | F.coalesce(utf16_length(F.col(name)) > TEXT_LIMITS[name], F.lit(False))
    record = F.to_json(F.struct(*[F.col(c) for c in [*fields, "origin"]]))
    early = F.when(too_long | (F.octet_length(record) > MAX_RECORD_BYTES), "INPUT_TOO_LARGE").when(
        F.coalesce(F.col("title") == "", F.lit(True))
        | F.coalesce(F.col("description") == "", F.lit(True))
        | ~origin.isin(*ORIGINS),
        "INVALID_INPUT",
    )
    df = src.withColumns({"raw": F.struct(*src.columns), "_early": early, "origin": origin})
    # Rejected text is not worth cleaning.
    df = df.withColumns({c: F.when(F.col("_early").isNull(), F.col(c)) for c in fields})
    df = sanitize_text(df, fields)
    empty = (F.col("title") == "") | (F.col("description") == "")
    overflow = F.lit(False)
    for name in fields:
        overflow = overflow | F.coalesce(utf16_length(F.col(name)) > TEXT_LIMITS[name], F.lit(False))
    df = df.withColumn("_url", F.nullif("source_url", F.lit("")))
    df = check_urls(df, "_url", official_hosts(F.col("provider"), providers))
    df = df.withColumn("signals", injection_signals(F.coalesce("description", F.lit(""))))
    code = F.coalesce(
        F.col("_early"),
        F.when(empty | overflow, "INVALID_INPUT"),
        F.when(~F.col("url_check.ok"), "UNSAFE_URL"),
    )
    warnings = F.concat(
        sanitize_warnings(F.col("sanitized_fields")).cast(f"array<{WARNING}>"),
        warning_if(F.size("signals") > 0, "PROMPT_INJECTION_SUSPECTED", "Job text may contain instructions"),
        warning_if(
            F.coalesce(~F.col("url_check.is_official"), F.lit(False)),
            "URL_NOT_OFFICIAL",
            "Source URL is not an official host",
        ),
    )
    return df.withColumns({"reject_code": code, "screen_warnings": warnings}).drop("_early", "_url")


def split_valid(
    src: DataFrame, providers: Sequence[Provider] = DEFAULT_PROVIDERS, once: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(good rows with cleaned text, rejected input rows with ``reject_code``).

    With ``once`` the cleaned rows are written to the shared folder, so that reading both outputs
    does not clean the texts twice.
    """
    screened = stage(screen_postings(src, providers))
    if once:
        screened = cut_lineage(screened)
    ok = screened.filter("reject_code IS NULL").drop("raw", "reject_code")
    rejects = screened.filter("reject_code IS NOT NULL").select("raw.*", "reject_code")
    return ok, rejects


def injection_report(screened: DataFrame) -> DataFrame:
    """Postings per provider and signal."""
    return (
        screened.select("provider", "job_id", F.explode("signals").alias("signal"))
        .groupBy("provider", "signal")
        .agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("job_id").alias("postings"))
    )


def attach_provenance(src: DataFrame, now: Column) -> DataFrame:
    relayed = F.col("origin") == "agent_relay"
    detail = F.when(relayed, F.coalesce("relay_source", F.lit("Agent relay"))).otherwise("User supplied")
    entry = F.struct(
        F.when(relayed, "agent_relay").otherwise("user_supplied").alias("kind"),
        detail.alias("detail"),
        now.cast("timestamp").alias("captured_at"),
    )
    return src.withColumn("source_provenance", F.array(entry))


def attach_warnings(src: DataFrame) -> DataFrame:
    """Put the warnings of all steps in order into ``flags``; the mark of untrusted text comes last.

    Reads screen_warnings, parse_warnings, discrimination_warnings and, where present,
    duplicate_warnings; every posting is marked as untrusted content.
    """
    none = F.array().cast(f"array<{WARNING}>")

    def of(name: str) -> Column:
        return F.coalesce(F.col(name), none) if name in src.columns else none

    untrusted = warning("UNTRUSTED_CONTENT", "Job description is untrusted third-party content")
    steps = ["screen_warnings", "parse_warnings", "discrimination_warnings", "duplicate_warnings"]
    return src.withColumn("flags", F.concat(*[of(name) for name in steps], F.array(untrusted)))


def shown(values: Column, limit: int | None) -> Column:
    """The first ``limit`` elements of a list, for display; the tables hold them all."""
    return values if limit is None else F.slice(values, 1, checked(limit, 1, None, "limit"))
