"""Ranking of recent postings per profile."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolecast.functions.skills import Taxonomy
from rolecast.operators.matching import WEIGHTS, score_pairs, skill_labels, with_scores
from rolecast.operators.store import MAX_RECENT, checked, filter_postings, recent
from rolecast.session import cut_lineage

MAX_SHORTLIST = 50
MAX_REASONS = 3
#: Slots of two short columns that are sent to every task.
BROADCAST_SLOTS = 10_000

# Reason texts.
PLAIN_REASONS = {
    "experience": "Experience requirement matched",
    "seniority": "Seniority level aligned",
    "location_remote": "Location and remote preference aligned",
    "employment_type": "Employment type matched",
}
SKILL_REASONS = {
    "must_have_skills": "Must-have skills matched",
    "preferred_skills": "Preferred skills matched",
    "domain": "Domain expertise matched",
}


def _reason(dimension: Column) -> Column:
    named = F.array_join(F.slice(dimension.evidence, 1, 3), ", ")
    text = F.lit(None).cast("string")
    for name, plain in PLAIN_REASONS.items():
        text = F.when(dimension["name"] == name, plain).otherwise(text)
    for name, lead in SKILL_REASONS.items():
        listed = F.when(named != "", F.concat(F.lit(f"{lead}: "), named)).otherwise(F.lit(lead))
        text = F.when(dimension["name"] == name, listed).otherwise(text)
    return F.left(text, F.lit(500))


def match_reasons(dimensions: Column) -> Column:
    """Up to three reasons of a pair, by contribution; ties keep the order of the dimensions."""
    order = F.array(*[F.lit(name) for name in WEIGHTS])
    keyed = F.transform(
        F.filter(dimensions, lambda d: d.score > 0),
        lambda d: F.struct(
            (-(d.score * d.weight)).alias("rank"), F.array_position(order, d["name"]).alias("pos"), _reason(d).alias("reason")
        ),
    )
    return F.transform(F.slice(F.array_sort(keyed), 1, MAX_REASONS), lambda k: k.reason)


def pair_reasons(features: DataFrame) -> DataFrame:
    """(job_id, profile_id, reasons) for joined pair features: ``match_reasons`` where nothing else of the dimensions is read."""

    def keyed(name: str, pos: int) -> Column:
        score = F.col(f"_score_{name}")
        reason = F.lit(PLAIN_REASONS.get(name))
        if name in SKILL_REASONS:
            named = F.array_join(skill_labels(name, F.slice(f"_covered_{name}", 1, 3)), ", ")
            reason = F.when(named != "", F.concat(F.lit(f"{SKILL_REASONS[name]}: "), named)).otherwise(SKILL_REASONS[name])
        key = F.struct((-(score * WEIGHTS[name])).alias("rank"), F.lit(pos).alias("pos"), F.left(reason, F.lit(500)).alias("reason"))
        return F.when(score > 0, key)

    first = F.slice(F.sort_array(F.array_compact(F.array(*[keyed(name, k) for k, name in enumerate(WEIGHTS)]))), 1, MAX_REASONS)
    return with_scores(features).select("job_id", "profile_id", F.transform(first, lambda k: k.reason).alias("reasons"))


def shortlist(
    postings: DataFrame,
    profiles: DataFrame,
    taxonomy: Taxonomy,
    filters: Mapping[str, Sequence[str]] | None = None,
    limit: int = MAX_SHORTLIST,
    look_back: int = MAX_RECENT,
) -> DataFrame:
    """Best postings per profile among the latest ``look_back`` that pass the filters.

    Each profile reads its slots 1..n, an equi-join on the slot number, so work is ``look_back``
    per profile however large the posting table is.
    """
    pool = checked(look_back, 1, None, "look_back")
    # The ids are picked first; the rows are then read once for the four branches that need them.
    picked = recent(postings.select("job_id", "ingested_at"), pool).select("job_id")
    latest = cut_lineage(filter_postings(postings.join(picked, "job_id", "left_semi"), filters, empty_excludes=True))
    slots = latest.select("job_id", F.expr("row_number() OVER (ORDER BY ingested_at DESC, job_id DESC)").alias("slot"))
    pairs = (
        profiles.select("profile_id", F.explode(F.sequence(F.lit(1), F.lit(pool))).alias("slot"))
        .join(F.broadcast(slots) if pool <= BROADCAST_SLOTS else slots, "slot")
        .select("job_id", "profile_id")
    )
    scored = score_pairs(pairs, latest, profiles, taxonomy)
    order = Window.partitionBy("profile_id").orderBy(F.desc("fit_score"), F.asc("job_id"))
    return (
        scored.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= checked(limit, 1, None, "limit"))
        .select(
            "profile_id", "rank", "job_id", "fit_score", "band", match_reasons(F.col("dimensions")).alias("top_reasons"), "blockers"
        )
    )
