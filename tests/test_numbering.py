"""Places in a global order."""

from pyspark.sql import functions as F

from rolecast.plans.numbering import numbered


def test_numbered(spark):
    rows = spark.range(5_000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.xxhash64("id") % 50).alias("value"))
    rows = rows.repartition(7)
    got = numbered(rows, [F.desc("value"), F.asc("id")]).collect()
    wanted = sorted(((r.value, r.id) for r in rows.collect()), key=lambda r: (-r[0], r[1]))
    assert [(r.value, r.id) for r in sorted(got, key=lambda r: r.position)] == wanted
    assert sorted(r.position for r in got) == list(range(1, 5_001))
    assert numbered(rows.limit(0), [F.asc("id")]).collect() == []
