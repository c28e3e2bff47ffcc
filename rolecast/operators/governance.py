"""Gating and audit of request rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecast.operators.store import checked
from rolecast.providers import DEFAULT_PROVIDERS, Provider

SUBJECT_PATTERN = r"^(?:job|prof)_[0-9a-f-]{36}\z"


def approval_pattern(providers: Sequence[Provider]) -> str:
    names = "|".join(p.name.upper() for p in providers)
    return rf"^APPROVAL-(?:{names})-[0-9]{{3}}\z"


def gate_requests(
    requests: DataFrame, policies: DataFrame, as_of: Column, providers: Sequence[Provider] = DEFAULT_PROVIDERS
) -> DataFrame:
    """Decide every request row (provider, capability_id) against its board's policy; denial is the default.

    Boards share capability ids, so both columns are joined. A repeated policy row counts once;
    a request has one decision.
    """
    joined = requests.join(
        policies.dropDuplicates(["provider", "capability_id"]).select(
            "provider", "capability_id", "level", "status", "approval_ref", "snapshot_date", "stale_after_days",
            F.col("reason").alias("policy_reason"),
        ),
        ["provider", "capability_id"],
        "left",
    )
    snapshot = F.try_to_date(F.col("snapshot_date"), "yyyy-MM-dd")
    age = F.datediff(F.to_date(as_of), snapshot)
    joined = joined.withColumn("_age", F.when(age == -1, 0).otherwise(age))
    approved = F.coalesce(F.col("approval_ref").rlike(approval_pattern(providers)), F.lit(False))
    stale = F.coalesce((F.col("_age") < 0) | (F.col("_age") > F.col("stale_after_days")), F.lit(True))
    unknown = F.col("level").isNull()
    code = (
        F.when(unknown | (F.col("level") == "L4"), "CAPABILITY_DISABLED")
        .when(F.col("status") == "blocked_by_provider_approval", "BLOCKED_BY_PROVIDER_APPROVAL")
        .when(F.col("status") != "enabled", "CAPABILITY_DISABLED")
        .when(F.col("level") == "L0", None)
        .when(~approved, "BLOCKED_BY_PROVIDER_APPROVAL")
        .when(stale, "POLICY_STALE")
    )
    capability = F.col("capability_id")
    reason = (
        F.when(unknown, F.concat(F.lit("Unknown capability: "), F.coalesce(capability, F.lit("undefined"))))
        .when(
            F.col("level") == "L4",
            F.when(F.col("status") == "disabled", F.col("policy_reason")).otherwise(
                "L4 capabilities are strictly disabled in v1"
            ),
        )
        .when((F.col("status") != "enabled") | (F.col("level") == "L0"), F.col("policy_reason"))
        .when(
            ~approved,
            F.concat(F.lit("Capability '"), capability, F.lit("' requires a valid written provider approval reference")),
        )
        .when(
            stale,
            F.concat(
                F.lit("Policy snapshot is stale ("), F.col("_age").cast("string"), F.lit(" days old, max allowed is "),
                F.col("stale_after_days").cast("string"), F.lit(" days)"),
            ),
        )
        .otherwise(F.col("policy_reason"))
    )
    return joined.select(
        *requests.columns,
        code.isNull().alias("allowed"),
        F.coalesce("level", F.lit("unknown")).alias("level"),
        F.coalesce("status", F.lit("disabled")).alias("status"),
        reason.alias("reason"),
        code.alias("error_code"),
        "approval_ref",
    )


def subject_hash(subject: Column, salt: str) -> Column:
    hashed = F.substring(F.sha2(F.concat(F.lit(salt), subject), 256), 1, 16)
    return F.when(subject.rlike(SUBJECT_PATTERN), hashed)


def audit_rows(decided: DataFrame, salt: str) -> DataFrame:
    """Append-only audit rows of decided requests (id, at, tool, request_id, subject_id, error_code)."""
    return decided.select(
        F.col("id").cast("bigint").alias("id"),
        F.col("at").cast("timestamp").alias("at"),
        "tool",
        "request_id",
        F.when(F.col("error_code").isNull(), "ok").otherwise("error").alias("outcome"),
        "error_code",
        subject_hash(F.col("subject_id"), salt).alias("subject_hash"),
    )


def append_audit(rows: DataFrame, path: str) -> None:
    rows.withColumn("day", F.to_date("at")).write.mode("append").partitionBy("day").parquet(path)


def recent_audit(audit: DataFrame, n: int = 100) -> DataFrame:
    return audit.orderBy(F.desc("id")).limit(checked(n, 1, None, "n"))


def outcome_report(audit: DataFrame) -> DataFrame:
    return audit.groupBy("tool", "outcome", "error_code").agg(F.count(F.lit(1)).alias("calls"))
