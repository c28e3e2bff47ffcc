"""The whole way from raw postings to stored rows, as one narrow plan."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecast.functions.skills import Taxonomy
from rolecast.operators.ingest import attach_provenance, attach_warnings, split_valid
from rolecast.operators.postings import normalize_postings
from rolecast.operators.requirements import discrimination_warnings, extract_requirements, posting_skills
from rolecast.operators.similarity_index import check_and_extend, check_batch_duplicates, duplicate_warnings
from rolecast.providers import DEFAULT_PROVIDERS, Provider
from rolecast.schemas import WARNING
from rolecast.session import cut_lineage


def enrich_postings(
    ok: DataFrame, taxonomy: Taxonomy, now: Column, providers: Sequence[Provider] = DEFAULT_PROVIDERS
) -> DataFrame:
    """Typed postings with requirements, skills, warnings and provenance. No shuffle."""
    df = normalize_postings(attach_provenance(ok, now), now, providers)
    return discrimination_warnings(posting_skills(extract_requirements(df, taxonomy)))


def ingest_postings(
    src: DataFrame,
    taxonomy: Taxonomy,
    now: Column,
    providers: Sequence[Provider] = DEFAULT_PROVIDERS,
    existing: DataFrame | None = None,
    look_back: int | None = None,
    index: tuple[str, int] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(stored-form postings with flags, rejected rows).

    Each posting is held against those that arrived before it, and marked where it repeats or
    resembles one: within the batch always, and before it against ``existing`` (all stored
    postings, or the ``look_back`` latest), or against the kept index ``(path, batch number)``,
    which the batch then joins.
    """
    ok, rejects = split_valid(src, providers, once=True)
    # Read by the comparison and by the result.
    full = cut_lineage(enrich_postings(ok, taxonomy, now, providers))
    if index is not None:
        found = check_and_extend(full, *index)
        arrived = None
    else:
        found = check_batch_duplicates(full, existing, look_back)
        stamps = [df.select("job_id", "ingested_at") for df in (full, existing) if df is not None]
        # A posting that comes again counts with its latest arrival.
        arrived = reduce(DataFrame.unionByName, stamps).groupBy("job_id").agg(F.max("ingested_at").alias("ingested_at"))
    marks = duplicate_warnings(cut_lineage(found), arrived).select(
        "job_id", F.array("warning").cast(f"array<{WARNING}>").alias("duplicate_warnings")
    )
    return attach_warnings(full.join(marks, "job_id", "left")), rejects
