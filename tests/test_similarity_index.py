"""Duplicates in order of arrival: against brute force, however the postings are cut into batches."""

import datetime
from collections import Counter

from pyspark.sql import functions as F

from checks import queries as q
from checks import tables as t
from rolecast.operators import similarity_index as index
from rolecast.operators.duplicates import prepare_postings
from rolecast.plans.ingest_flow import ingest_postings
from rolecast.session import work_dir
from rolecast.streaming import flows
from tests.test_duplicates import corpus

SCHEMA = "job_id string, fingerprint string, company string, title string, description string"


def arriving(spark):
    rows = spark.createDataFrame(corpus(), SCHEMA)
    # Order of arrival other than the order of ids, with ties.
    minute = F.pmod(F.xxhash64("job_id"), F.lit(60)).cast("int")
    return rows.withColumn("ingested_at", F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=minute))


def by_force(rows):
    """(posting, earlier posting, exact?) in order of arrival."""

    def jac(a, b):
        return 1.0 if not a and not b else len(a & b) / len(a | b)

    prints, classes, out = {}, {}, []
    for r in rows:
        key = (r.company, tuple(r.title_set), tuple(r.shingle_set))
        if r.fingerprint in prints:
            out.append((r.job_id, prints[r.fingerprint], True))
        elif r.company and key in classes:
            out.append((r.job_id, classes[key], False))
        elif r.company:
            for (company, title, text), first in classes.items():
                if company == r.company and jac(set(title), set(r.title_set)) >= 0.8 and jac(set(text), set(r.shingle_set)) >= 0.85:
                    out.append((r.job_id, first, False))
        prints.setdefault(r.fingerprint, r.job_id)
        if r.company:
            classes.setdefault(key, r.job_id)
    return Counter(out)


def seen(found):
    return Counter((r.job_id, r.existing_job_id, r.reason.startswith("Identical")) for r in found.collect())


def test_one_batch_equals_many(spark):
    src = arriving(spark).cache()
    stamps = {r.job_id: r.ingested_at for r in src.collect()}
    prepared = sorted(prepare_postings(src).collect(), key=lambda r: (stamps[r.job_id], r.job_id))
    wanted = by_force(prepared)
    assert seen(index.check_batch_duplicates(src)) == wanted
    path = work_dir(spark, "index")
    edges = [datetime.datetime(2024, 1, 1, 0, m) for m in (0, 7, 8, 30)] + [datetime.datetime(2024, 1, 2)]
    got = Counter()
    for seq, (low, high) in enumerate(zip(edges, edges[1:])):
        batch = src.filter((F.col("ingested_at") >= F.lit(low)) & (F.col("ingested_at") < F.lit(high)))
        first = seen(index.check_and_extend(batch, path, seq))
        # A batch that runs again finds the same, and leaves nothing twice.
        assert seq != 1 or seen(index.check_and_extend(batch, path, seq)) == first
        got += first
    assert got == wanted
    kept = index.read_index(spark, path, 99)
    assert kept.classes.count() == kept.classes.select("class_key").distinct().count()
    assert kept.fingerprints.count() == len({r.fingerprint for r in prepared})
    # The stored postings as a table, instead of a kept index.
    early, late = src.filter(F.col("ingested_at") < F.lit(edges[2])), src.filter(F.col("ingested_at") >= F.lit(edges[2]))
    assert seen(index.check_batch_duplicates(early)) + seen(index.check_batch_duplicates(late, early)) == wanted


def test_copies_cost_one_row_each_and_nothing_matches_itself(spark):
    rows = [(f"job_{n:03d}", "sha256:same", "Acme", "Engineer", "one two three four five six seven") for n in range(60)]
    src = spark.createDataFrame(rows, SCHEMA)
    found = index.check_batch_duplicates(src).collect()
    assert len(found) == 59 and {r.existing_job_id for r in found} == {"job_000"}
    # Postings that are stored already: the first one is no duplicate of itself.
    assert index.check_batch_duplicates(src, src).count() == 59
    assert index.check_batch_duplicates(src.limit(0), src).count() == 0


def test_a_batch_reads_its_own_divisions(spark):
    src = arriving(spark)
    path = work_dir(spark, "index")
    index.check_and_extend(src, path, 0).collect()
    one = prepare_postings(src.filter("company = 'Gamma'"), carry=[F.col("ingested_at").alias("at")])
    plan = index.read_index(spark, path, 1, one).prefixes._jdf.queryExecution().executedPlan().toString()
    assert "part" in plan.split("PartitionFilters:")[1].split("]")[0]
    used = index.read_index(spark, path, 1, one).prefixes.inputFiles()
    assert index.read_index(spark, path, 1, one).prefixes.select("company").distinct().count() < index.read_index(spark, path, 1).prefixes.select("company").distinct().count()
    assert used


def test_copies_inside_the_first_batch_are_marked(spark):
    sf = "/root/testdata/sf0.001"
    first = t.raw_postings(spark, sf).filter("doc_id < 6").withColumn("source_url", F.lit(None).cast("string"))
    again = first.withColumn("job_id", F.regexp_replace("job_id", "^job_0", "job_f"))
    both = first.unionByName(again)
    good, _ = ingest_postings(both, q.taxonomy(), F.lit(q.NOW).cast("timestamp"))
    marked = good.filter(F.exists("flags", lambda f: f.code == "DUPLICATE_SUSPECTED"))
    assert {r.job_id for r in marked.collect()} == {r.job_id for r in again.collect()}
    source, path = work_dir(spark, "one-batch"), work_dir(spark, "streamed")
    both.write.parquet(source)
    stream = spark.readStream.schema(both.schema).parquet(source)
    flows.stream_ingest(stream, q.taxonomy(), path, work_dir(spark, "progress")).awaitTermination()
    stored = flows.latest_postings(spark, path).filter(F.exists("flags", lambda f: f.code == "DUPLICATE_SUSPECTED"))
    assert {r.job_id for r in stored.collect()} == {r.job_id for r in again.collect()}
