import pytest
from pyspark.sql import functions as F

from rolecast.operators import governance, store
from rolecast.sources.tables import upsert_postings


def test_pages_of_equal_stamps_lose_no_row(spark):
    stamp = F.lit("2024-01-01 00:00:00.123456").cast("timestamp")
    ids = [f"job_{n:08d}-0000-4000-8000-{n:012d}" for n in range(6)]
    jobs = spark.createDataFrame([(i,) for i in ids], "job_id string").withColumn("ingested_at", stamp)
    seen, cursor = [], None
    while True:
        rest = store.newest_first(store.keyset_page(jobs, cursor)).limit(2).collect()
        if not rest:
            break
        seen += [r.job_id for r in rest]
        cursor = store.encode_cursor(rest[-1].ingested_at, rest[-1].job_id)
        shown = jobs.filter(F.col("job_id") == rest[-1].job_id).select(store.cursor_column(F.col("ingested_at"), F.col("job_id")).alias("c"))
        assert shown.first().c == cursor
    assert seen == ids[::-1]


def test_limits_are_obeyed_or_refused(spark):
    jobs = spark.range(700).select(
        F.format_string("job_%04d", "id").alias("job_id"), F.timestamp_seconds("id").alias("ingested_at")
    )
    assert store.recent(jobs, 600).count() == 600
    for bad in (0, -1):
        with pytest.raises(ValueError):
            store.recent(jobs, bad)


def test_upsert_without_or_with_equal_numbers(spark):
    kind = "job_id string, title string, batch_seq long"
    stored = spark.createDataFrame([("a", "old", None), ("b", "old", 3), ("c", "old", 5)], kind)
    batch = spark.createDataFrame([("b", "new", 3), ("c", "new", 4), ("d", "x", 1), ("d", "y", 1), ("e", "z", None)], kind)
    got = {r.job_id: r.title for r in upsert_postings(stored, batch).collect()}
    assert got.pop("d") in ("x", "y") and got == {"a": "old", "b": "new", "c": "old", "e": "z"}
    bare = upsert_postings(stored.drop("batch_seq"), batch.drop("batch_seq").filter("job_id <> 'd'"))
    assert {r.job_id: r.title for r in bare.collect()} == {"a": "old", "b": "new", "c": "new", "e": "z"}


def test_boards_share_capability_ids(spark):
    kind = "provider string, capability_id string, level string, status string, approval_ref string, snapshot_date string, stale_after_days int, reason string"
    policies = spark.createDataFrame(
        [("one", "view", "L0", "enabled", None, "2024-01-01", 30, "here"), ("two", "view", "L4", "disabled", None, "2024-01-01", 30, "there")], kind
    )
    requests = spark.createDataFrame([(1, "one", "view"), (2, "two", "view"), (3, "three", "view")], "id int, provider string, capability_id string")
    decided = governance.gate_requests(requests, policies, F.lit("2024-01-02").cast("date")).collect()
    assert sorted((r.id, r.allowed) for r in decided) == [(1, True), (2, False), (3, False)]


def test_deletes_rewrite_their_days_only(spark, tmp_path):
    import glob

    from rolecast.sources import tables

    path = str(tmp_path / "postings")
    rows = [("a", "2024-01-01", "pinned"), ("b", "2024-01-01", "session"), ("c", "2024-01-02", "pinned"), ("d", "2024-01-03", "standard_180d")]
    jobs = spark.createDataFrame(rows, "job_id string, at string, retention_class string").withColumn("ingested_at", F.to_timestamp("at"))
    tables.write_postings(jobs, path)
    untouched = glob.glob(f"{path}/ingest_day=2024-01-01/*.parquet")
    ids = spark.createDataFrame([("c",), ("unknown",)], "job_id string")
    assert tables.delete_stored(spark, path, ids) == 1
    assert not glob.glob(f"{path}/ingest_day=2024-01-02") and glob.glob(f"{path}/ingest_day=2024-01-01/*.parquet") == untouched
    assert tables.retain_stored(spark, path, F.lit("2024-12-01").cast("timestamp")) == 2
    assert [r.job_id for r in spark.read.parquet(path).collect()] == ["a"]

    audit = str(tmp_path / "audit")
    entry = "1L id, timestamp'2024-01-01 00:00:00' at, 't' tool, 'r' request_id, 'ok' outcome, string(null) error_code, string(null) subject_hash"
    governance.append_audit(spark.range(1).selectExpr(*entry.split(", ")), audit)
    purged = tables.erase_stored(spark, {"jobs": path, "audit": audit}, F.lit("2024-12-01").cast("timestamp"))
    assert purged == {"jobs": 1, "audit": 1} and spark.read.parquet(path).count() == 0
    assert [r.tool for r in spark.read.parquet(audit).collect()] == ["data_purge"]
    # The tables stay: they can be erased again, and written to.
    assert tables.erase_stored(spark, {"jobs": path, "audit": audit}, F.lit("2024-12-02").cast("timestamp")) == {"jobs": 0, "audit": 1}
    assert [r.tool for r in spark.read.parquet(audit).collect()] == ["data_purge"]


def posting_rows(spark, rows):
    from rolecast.schemas import POSTING

    base = spark.createDataFrame(rows, "job_id string, title string, at string").withColumn("ingested_at", F.to_timestamp("at"))
    names = [f.split()[0] for f in ("job_id", "title", "ingested_at")]
    empty = spark.createDataFrame([], POSTING)
    return empty.unionByName(base.select(*names), allowMissingColumns=True)


def test_stored_upsert_moves_rows_and_survives_a_stop(spark, tmp_path, monkeypatch):
    import glob

    from rolecast.sources import tables

    path = str(tmp_path / "postings")
    tables.upsert_stored(spark, path, posting_rows(spark, [("a", "one", "2024-01-01"), ("b", "one", "2024-01-02"), ("c", "one", "2024-01-03"), ("n", "one", None)]))
    untouched = glob.glob(f"{path}/ingest_day=2024-01-03/*.parquet")
    change = posting_rows(spark, [("b", "two", "2024-01-05"), ("d", "two", "2024-01-01"), ("n", "two", "2024-01-05")])

    def stored():
        return sorted((r.job_id, r.title, str(r.ingested_at)[:10]) for r in spark.read.parquet(path).collect())

    wanted = [("a", "one", "2024-01-01"), ("b", "two", "2024-01-05"), ("c", "one", "2024-01-03"), ("d", "two", "2024-01-01"), ("n", "two", "2024-01-05")]
    # A stop before the new content is complete changes nothing; a stop after it loses nothing.
    before = stored()
    real = tables.finish_upsert
    calls = []
    monkeypatch.setattr(tables, "finish_upsert", lambda *a: calls.append(a) or (real(*a) if len(calls) == 1 else None))
    tables.upsert_stored(spark, path, change)
    assert stored() == before
    monkeypatch.undo()
    real(spark, path)
    assert stored() == wanted and not glob.glob(f"{path}/_pending") and not glob.glob(f"{path}/ingest_day=2024-01-02")
    tables.upsert_stored(spark, path, change)
    assert stored() == wanted and glob.glob(f"{path}/ingest_day=2024-01-03/*.parquet") == untouched
    posting_rows(spark, [("x", "half", "2024-01-01")]).write.parquet(f"{path}/_pending/rows")
    real(spark, path)
    assert stored() == wanted and not glob.glob(f"{path}/_pending")


def test_pages_open_the_days_they_need(spark, tmp_path):
    from rolecast.sources import tables

    path = str(tmp_path / "postings")
    ids = [f"job_{n:08d}-0000-4000-8000-{n:012d}" for n in range(200)]
    days = [(i, "t", f"2024-{1 + n // 28:02d}-{1 + n % 28:02d}") for n, i in enumerate(ids)]
    tables.write_postings(posting_rows(spark, days).withColumn("flags", F.array().cast("array<struct<code:string,message:string,field:string>>")), path)
    table = spark.read.parquet(path)
    seen, cursor = [], None
    for _ in range(3):
        window = store.latest_days(store.keyset_page(table, cursor), 8, cursor)
        # Of 200 stored days, at most 16 that hold a page and one row more are read.
        assert window.select("ingest_day").distinct().count() <= 16
        page = store.list_postings(table, page_size=7, cursor=cursor).collect()
        seen += [r.job_id for r in page]
        cursor = next(r.next_cursor for r in page if r.next_cursor)
    assert sorted(seen, reverse=True) == ids[::-1][:21]
    plan = store.keyset_page(table, cursor)._jdf.queryExecution().executedPlan().toString()
    assert "ingest_day" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_closed_schemas(spark, tmp_path):
    import json

    from rolecast.schemas import RAW_POSTING
    from rolecast.sources.tables import read_postings, read_profiles

    csv = tmp_path / "csv"
    csv.mkdir()
    (csv / "a.csv").write_text('title,job_id,description,extra\nT1,j1,"two\nlines, ""quoted""",\nT2,j2\nT3,j3,d,,,more\nT4,j4,d,value\nT5,j5,,\n')
    rows, rejects = read_postings(spark, str(csv), "csv")
    got = {r.job_id: (r.title, r.description, r.origin) for r in rows.collect()}
    assert got == {"j1": ("T1", 'two\nlines, "quoted"', "user_paste"), "j5": ("T5", None, "user_paste")}
    bad = [r.record for r in rejects.collect()]
    assert len(bad) == 3 and all(any(k in b for b in bad) for k in ("j2", "j3", "j4"))
    assert rows.columns == [c.split()[0] for c in RAW_POSTING.split(", ")]

    parquet = str(tmp_path / "parquet")
    spark.createDataFrame([("j1", "T1", None), ("j2", "T2", "x")], "job_id string, title string, secret string").write.parquet(parquet)
    rows, rejects = read_postings(spark, parquet, "parquet")
    assert [r.job_id for r in rows.collect()] == ["j1"] and rejects.count() == 1
    spark.createDataFrame([(1,)], "job_id int").write.parquet(str(tmp_path / "typed"))
    with pytest.raises(ValueError):
        read_postings(spark, str(tmp_path / "typed"), "parquet")

    good = {"profile_id": "p0", "label": "x", "roles": [{"title": "t", "highlights": ["h"]}], "preferences": {"locations": ["a"], "min_compensation": {"amount": 1.0}}}
    spoilt = [
        dict(good, profile_id="p1", roles=[{"title": "t"}, {"title": "t", "salary": 1}]), dict(good, profile_id="p2", preferences={"min_compensation": {"amount": 1, "per": "x"}}),
        dict(good, profile_id="p3", preferences={"colour": "red"}), dict(good, profile_id="p4", other=1), dict(good, profile_id="p5", roles="none"),
    ]
    lines = tmp_path / "profiles.json"
    lines.write_text("\n".join([json.dumps(r) for r in [good, *spoilt]] + ["[1]", "no json", '"text"']))
    rows, rejects = read_profiles(spark, str(lines))
    assert [r.profile_id for r in rows.collect()] == ["p0"] and rejects.count() == 8
