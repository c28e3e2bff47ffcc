"""Places in a global order without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecast.session import cut_lineage

#: ``monotonically_increasing_id`` holds the task in the bits above these and the row of the task in these.
ROW_BITS = 33


def numbered(rows: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """The rows with their place from 1 upward in ``order``.

    Rows are dealt out by range and sorted within each task. They are written once, since a second
    run may draw other range borders. The driver holds one count per task. End ``order`` with a
    column that tells rows apart, so that equal rows can be dealt to several tasks.
    """
    at = F.col("_at")
    placed = cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright(at, ROW_BITS)
    counts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
    before, offsets = 0, []
    for row in sorted(counts, key=lambda r: r.part):
        offsets.append((row.part, before))
        before += row.n
    table = rows.sparkSession.createDataFrame(offsets, "_part long, _before long")
    inside = at - F.shiftleft(part, ROW_BITS) + 1
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(table), "_part")
        .withColumn(name, F.col("_before") + inside)
        .drop("_part", "_before", "_at")
    )
