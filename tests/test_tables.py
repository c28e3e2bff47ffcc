"""Derived tables: task counts follow the input, pairs are told apart by number."""

from checks import tables as t

SF = "/root/testdata/sf0.001"


def test_wide_tables_have_more_tasks_as_they_grow(spark, monkeypatch):
    few = t.table(spark, SF, "documents").rdd.getNumPartitions()
    monkeypatch.setattr(t, "TASK_BYTES", 10_000)
    assert t.table(spark, SF, "documents").rdd.getNumPartitions() > 2 * few


def test_pairs_are_distinct_before_ids_are_written(spark):
    plan = t.pairs(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Aggregate [posting#")
    assert t.pairs(spark, SF).count() == t.pairs(spark, SF).distinct().count()
