"""Duplicate checks in order of arrival, over an index that is kept and extended batch by batch.

A posting is held against everything that arrived before it, in earlier batches and in its own. It
is told once, by the later of the two, which text repeats or resembles which:

- a posting whose fingerprint has been seen names the first posting that had it;
- else, a posting whose content class has been seen names the first posting of the class;
- else, it is the first of a new class and names the first posting of every similar class before.

So copies cost one row each, and only different texts are linked. The answer does not depend on how
the postings are cut into batches.

The index has three tables: first postings by fingerprint, content classes with their sets, and
rare-first prefixes of the classes' sets. A stored set and a set close to it share one of the stored
prefix's elements under any order of elements, so prefixes stay as they were written, and a new
class is looked up by all its elements. Each batch owns a folder of each table and overwrites it,
so a batch that runs again leaves no second entry. Folders are divided by company (fingerprints: by
hash); a batch reads only the divisions that its own companies fall into.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecast.operators.duplicates import (
    class_prefixes, meeting_key, met_pairs, near_evidence, prepare_postings, title_hashes, two_places, verified_pairs,
)
from rolecast.operators.store import recent
from rolecast.plans.candidates import with_signature
from rolecast.plans.skew import salted_join
from rolecast.session import cut_lineage, path_exists

#: Divisions of each table of the index.
PARTS = 64
FINGERPRINTS = "fingerprint string, at timestamp, job_id string"
CLASSES = (
    "class_key string, company string, title_set array<string>, shingle_set array<bigint>, at timestamp, job_id string, signature array<bigint>"
)
PREFIXES = "company string, kind string, bucket bigint, class_key string, n int, pos int"
_PLACE = ", part int, batch_seq bigint"


@dataclass(frozen=True)
class SimilarityIndex:
    """What arrived before: see the module's text."""

    fingerprints: DataFrame
    classes: DataFrame
    prefixes: DataFrame


def empty_index(spark: SparkSession) -> SimilarityIndex:
    return SimilarityIndex(*[spark.createDataFrame([], ddl) for ddl in (FINGERPRINTS, CLASSES, PREFIXES)])


def division(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")


def _arrived(src: DataFrame, max_chars: int | None) -> DataFrame:
    """Comparison keys of each posting with its moment of arrival; of one moment, the smaller id is first."""
    at = F.col("ingested_at") if "ingested_at" in src.columns else F.lit(None)
    return prepare_postings(src, max_chars, [at.cast("timestamp").alias("at")])


def _first() -> Column:
    return F.min(F.struct("at", "job_id")).alias("first")


def entries(prepared: DataFrame, before: SimilarityIndex) -> SimilarityIndex:
    """What a batch adds to the index: fingerprints and classes not seen before, and the classes' prefixes."""
    fingerprints = (
        prepared.groupBy("fingerprint").agg(_first()).join(before.fingerprints, "fingerprint", "left_anti").select("fingerprint", "first.*")
    )
    fresh = (
        prepared.filter("company <> ''")
        .groupBy("class_key")
        .agg(F.first("company").alias("company"), F.first("title_set").alias("title_set"), F.first("shingle_set").alias("shingle_set"), _first())
        .join(before.classes.select("class_key"), "class_key", "left_anti")
        .select("class_key", "company", "title_set", "shingle_set", "first.*")
    )
    classes = cut_lineage(with_signature(fresh, "shingle_set", "signature"))
    prefixes = class_prefixes(classes, before.prefixes.filter("kind = 'text'"))
    return SimilarityIndex(fingerprints, classes, prefixes.select("company", "kind", "bucket", "class_key", "n", "pos"))


def _links(new: SimilarityIndex, before: SimilarityIndex) -> DataFrame:
    """(job_id, existing_job_id, company, similarities) of new classes and every similar class that began before."""
    elements = F.when(F.size("shingle_set") > 0, F.col("shingle_set")).otherwise(title_hashes())
    kind = F.when(F.size("shingle_set") > 0, "text").otherwise("title")
    probes = new.classes.select(
        F.col("class_key").alias("class_key_a"), "company", kind.alias("kind"), F.size(elements).alias("n_a"), F.explode(elements).alias("bucket")
    ).select(meeting_key().alias("key"), "class_key_a", "n_a")
    stored = before.prefixes.select(meeting_key().alias("key"), F.col("class_key").alias("class_key_b"), F.col("n").alias("n_b"))
    # Sets of four fifths in common, the lower of both thresholds, are no further apart in size than this.
    across = salted_join(probes, stored, ["key"], "class_key_a").filter("least(n_a, n_b) * 5 >= greatest(n_a, n_b) * 4").select("class_key_a", "class_key_b")
    # The batch's own prefixes have one order in common, so a prefix of each is enough.
    inside = met_pairs(new.prefixes)
    met = cut_lineage(across.unionByName(inside).distinct())
    old = before.classes.join(met.select(F.col("class_key_b").alias("class_key")).distinct(), "class_key", "left_semi")
    both = cut_lineage(new.classes.withColumn("late", F.lit(1)).unionByName(old.withColumn("late", F.lit(0))))
    counts = ["title_set_shared", "title_set_total", "shingle_set_shared", "shingle_set_total"]
    pairs = verified_pairs(met, both).select("class_key_a", "class_key_b", *counts)
    # Of two classes the one that began later names the other; what is stored began before the batch.
    order = F.struct("late", "at", "job_id")
    a = both.select(F.col("class_key").alias("class_key_a"), "company", order.alias("first_a"))
    b = both.select(F.col("class_key").alias("class_key_b"), order.alias("first_b"))
    named = salted_join(salted_join(pairs, a, ["class_key_a"], "class_key_b"), b, ["class_key_b"], "class_key_a")
    return named.select(
        F.greatest("first_a", "first_b")["job_id"].alias("job_id"),
        F.least("first_a", "first_b")["job_id"].alias("existing_job_id"),
        "company", *counts,
    ).filter("job_id <> existing_job_id")


def matches(prepared: DataFrame, new: SimilarityIndex, before: SimilarityIndex) -> DataFrame:
    """(job_id, existing_job_id, reason) of a batch; see the module's text for which rows there are."""
    # Of each key, what was there before the batch wins over what the batch brought.
    def known(old: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
        wanted = prepared.select(key).distinct()
        return old.join(wanted, key, "left_semi").select(key, "job_id").unionByName(fresh.select(key, "job_id")).withColumnRenamed("job_id", "first_id")

    by_print = salted_join(
        prepared.select("job_id", "fingerprint", "class_key", "company"), known(before.fingerprints, new.fingerprints, "fingerprint"), ["fingerprint"], "job_id"
    )
    same = by_print.filter("job_id <> first_id").select(
        "job_id", F.col("first_id").alias("existing_job_id"), F.concat(F.lit("Identical fingerprint: "), "fingerprint").alias("reason")
    )
    firsts = by_print.filter("job_id = first_id AND company <> ''").select("job_id", "class_key", "company")
    by_class = salted_join(firsts, known(before.classes, new.classes, "class_key"), ["class_key"], "job_id")
    alike = by_class.filter("job_id <> first_id").select(
        "job_id", F.col("first_id").alias("existing_job_id"), near_evidence(F.col("company"), F.lit("1.00"), F.lit("1.00")).alias("reason")
    )
    near = _links(new, before).select(
        "job_id",
        "existing_job_id",
        near_evidence(
            F.col("company"),
            two_places(F.col("title_set_shared"), F.col("title_set_total")),
            two_places(F.col("shingle_set_shared"), F.col("shingle_set_total")),
        ).alias("reason"),
    )
    return same.unionByName(alike).unionByName(near)


def check_batch_duplicates(
    new: DataFrame, existing: DataFrame | None = None, n: int | None = None, max_chars: int | None = None
) -> DataFrame:
    """(job_id, existing_job_id, reason) of a batch against stored postings, all or the n latest, and itself.

    An index of the stored postings is made for this one check; ``check_and_extend`` keeps it.
    """
    before = empty_index(new.sparkSession)
    if existing is not None:
        stored = cut_lineage(_arrived(existing if n is None else recent(existing, n), max_chars))
        made = entries(stored, before)
        before = SimilarityIndex(cut_lineage(made.fingerprints), made.classes, cut_lineage(made.prefixes))
    prepared = cut_lineage(_arrived(new, max_chars))
    return matches(prepared, entries(prepared, before), before)


# ---------------------------------------------------------------- kept index


def read_index(spark: SparkSession, path: str, before: int, prepared: DataFrame | None = None) -> SimilarityIndex:
    """The index as the batches before ``before`` left it; with ``prepared`` only the divisions that its rows need."""

    def needed(key: str) -> Column:
        if prepared is None:
            return F.lit(True)
        # At most PARTS numbers.
        parts = [r.part for r in prepared.select(division(F.col(key)).alias("part")).distinct().collect()]
        return F.col("part").isin(parts) if parts else F.lit(False)

    def table(name: str, ddl: str, wanted: Column) -> DataFrame:
        if not path_exists(spark, f"{path}/{name}"):
            return spark.createDataFrame([], ddl)
        stored = spark.read.schema(ddl + _PLACE).parquet(f"{path}/{name}")
        return stored.filter((F.col("batch_seq") < before) & wanted).drop("part", "batch_seq")

    by_company = needed("company")
    return SimilarityIndex(
        table("fingerprints", FINGERPRINTS, needed("fingerprint")), table("classes", CLASSES, by_company), table("prefixes", PREFIXES, by_company)
    )


def write_entries(new: SimilarityIndex, path: str, batch_seq: int) -> SimilarityIndex:
    """Store what a batch adds, in place of what an earlier run of the same batch stored; returns it as read back."""
    spark = new.classes.sparkSession
    out = []
    for name, frame, key, ddl in (
        ("fingerprints", new.fingerprints, "fingerprint", FINGERPRINTS),
        ("classes", new.classes, "company", CLASSES),
        ("prefixes", new.prefixes, "company", PREFIXES),
    ):
        folder = f"{path}/{name}/batch_seq={batch_seq}"
        # One company may hold a third of the rows: large divisions are split, small ones share a task.
        placed = frame.withColumn("part", division(F.col(key))).hint("rebalance", "part")
        placed.write.mode("overwrite").partitionBy("part").parquet(folder)
        out.append(spark.read.schema(ddl + ", part int").parquet(folder).drop("part"))
    return SimilarityIndex(*out)


def check_and_extend(batch: DataFrame, path: str, batch_seq: int, max_chars: int | None = None) -> DataFrame:
    """The duplicates of a batch, after its entries have joined the index below ``path``.

    Batches are numbered upward; a batch may run again under its number, with the same result.
    """
    prepared = cut_lineage(_arrived(batch, max_chars))
    before = read_index(batch.sparkSession, path, batch_seq, prepared)
    new = write_entries(entries(prepared, before), path, batch_seq)
    return matches(prepared, new, before)


def duplicate_warnings(matches: DataFrame, arrived: DataFrame | None = None) -> DataFrame:
    """(job_id, warning): one DUPLICATE_SUSPECTED message per posting.

    The message names the match of every other text, the latest first where ``arrived(job_id,
    ingested_at)`` tells the order, else the largest id first.
    """
    listed = matches.select("job_id", "existing_job_id").distinct()
    if arrived is None:
        listed = listed.withColumn("ingested_at", F.lit(None).cast("timestamp"))
    else:
        listed = listed.join(arrived.select(F.col("job_id").alias("existing_job_id"), "ingested_at"), "existing_job_id", "left")
    found = listed.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("ingested_at", "existing_job_id")), asc=False).alias("found"))
    ids = F.array_join(F.transform("found", lambda x: x.existing_job_id), ", ")
    return found.select(
        "job_id",
        F.struct(
            F.lit("DUPLICATE_SUSPECTED").alias("code"),
            F.concat(F.lit("Job appears to be a duplicate of existing job(s): "), ids).alias("message"),
            F.lit(None).cast("string").alias("field"),
        ).alias("warning"),
    )
