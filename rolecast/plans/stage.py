"""Plan-size guard for long chains of column stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stage(df: DataFrame) -> DataFrame:
    """Fix the computed columns before rows are filtered on them.

    Catalyst pushes a filter through projections by substituting their expressions. Behind a
    dozen text stages that copies every stage many times over, and each copy is computed again.
    A one-element generator keeps row count and order, stays in the same task, and is a place
    where substitution stops.
    """
    return df.select(F.inline_outer(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
