"""Reading, merging and writing the posting, profile and taxonomy tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, NullType, StringType, StructField, StructType

from rolecast.functions.skills import Taxonomy
from rolecast.operators.governance import append_audit
from rolecast.operators.store import erase_all, retention_action
from rolecast.schemas import ORIGINS, POSTING, PROFILE, RAW_POSTING, TAXONOMY
from rolecast.session import cut_lineage, drop_files, path_exists


def _foreign(text: Column, kind: DataType) -> Column:
    """Whether a JSON text holds, at any level, an object key that its type does not know."""
    if isinstance(kind, StructType):
        # Nothing here, or no object here: the parser judges that.
        found = F.coalesce(F.size(F.array_except(F.json_object_keys(text), F.array(*[F.lit(n) for n in kind.names]))) > 0, F.lit(False))
        for field in kind.fields:
            if isinstance(field.dataType, (StructType, ArrayType)):
                found = found | _foreign(F.get_json_object(text, f"$.{field.name}"), field.dataType)
        return found
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, (StructType, ArrayType)):
        items = F.from_json(text, "array<string>")
        return F.coalesce(F.exists(items, lambda item: _foreign(item, kind.elementType)), F.lit(False))
    return F.lit(False)


def _strict_json(spark: SparkSession, path: str, ddl: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines with a schema that is closed at every level: (rows, rejects)."""
    lines = spark.read.text(path)
    corrupt = f"{ddl}, _corrupt string"
    parsed = lines.withColumn(
        "row", F.from_json("value", corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    )
    no_object = F.json_object_keys("value").isNull()
    bad = F.col("row").isNull() | F.col("row._corrupt").isNotNull() | no_object | _foreign(F.col("value"), StructType.fromDDL(ddl))
    rows = parsed.filter(~bad).select("row.*").drop("_corrupt")
    rejects = parsed.filter(bad).select(F.col("value").alias("record"))
    return rows, rejects


def _closed(df: DataFrame, ddl: str, record: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with the columns of the schema, rejects): a value in any other column rejects its row.

    A column that the file lacks is null. ``record`` is the text of a row that could not be read.
    """
    known = StructType.fromDDL(ddl)
    other = [c for c in df.columns if c not in known.names and c != "_corrupt"]
    bad = F.lit(False) if record is None else record.isNotNull()
    for name in other:
        bad = bad | F.col(f"`{name}`").isNotNull()
    columns = [(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in known.fields]
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != "_corrupt"]))
    text = whole if record is None else F.coalesce(record, whole)
    return df.filter(~bad).select(*columns), df.filter(bad).select(text.alias("record"))


def _strict_csv(spark: SparkSession, path: str, ddl: str) -> tuple[DataFrame, DataFrame]:
    """CSV with a header: columns go by name, and a row with too many or too few fields is rejected.

    Files of one call have one header; another order of columns in a later file is an error.
    """
    options = dict(header=True, multiLine=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    # Only a field without quotes is missing; a quoted empty one is an empty text.
    options["nullValue"] = "\u0000"
    header = spark.read.options(**options).csv(path).columns
    schema = StructType([StructField(name, StringType()) for name in [*header, "_corrupt"]])
    # Every field is parsed, whichever columns are asked for; else a short row would pass unseen.
    strict = dict(options, enforceSchema=False, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt", columnPruning=False)
    return _closed(spark.read.schema(schema).options(**strict).csv(path), ddl, F.col("_corrupt"))


def _strict_parquet(spark: SparkSession, path: str, ddl: str) -> tuple[DataFrame, DataFrame]:
    """Parquet by column name; the files' own types must be those of the schema."""
    stored = spark.read.option("mergeSchema", True).parquet(path)
    wanted = {f.name: f.dataType for f in StructType.fromDDL(ddl).fields}
    wrong = [f.name for f in stored.schema.fields if f.name in wanted and f.dataType not in (wanted[f.name], NullType())]
    if wrong:
        raise ValueError(f"unexpected types of columns: {', '.join(wrong)}")
    return _closed(stored, ddl)


def read_postings(spark: SparkSession, path: str, fmt: str = "json") -> tuple[DataFrame, DataFrame]:
    """(raw postings, rejected records) of JSON lines, CSV or Parquet. ``origin`` defaults to a user's own paste."""
    readers = {"json": _strict_json, "csv": _strict_csv, "parquet": _strict_parquet}
    if fmt not in readers:
        raise ValueError(f"format must be one of {', '.join(readers)}")
    rows, rejects = readers[fmt](spark, path, RAW_POSTING)
    return rows.withColumn("origin", F.coalesce("origin", F.lit(ORIGINS[0]))), rejects


def complete_profiles(rows: DataFrame) -> DataFrame:
    """Fill the arrays a profile may leave out; optional scalars stay null."""

    def filled(name: str, element: str) -> Column:
        return F.coalesce(F.col(name), F.array().cast(f"array<{element}>"))

    preferences = F.col("preferences")
    for name in ("locations", "remote_modes", "employment_types", "deal_breakers"):
        preferences = preferences.withField(name, filled(f"preferences.{name}", "string"))
    return rows.withColumns(
        {
            "schema_version": F.coalesce("schema_version", F.lit("1")),
            "skills": filled("skills", "struct<name:string,years:double,level:string>"),
            "roles": filled(
                "roles", "struct<title:string,company:string,start:string,end:string,highlights:array<string>>"
            ),
            "education": filled("education", "struct<qualification:string,institution:string,year:int>"),
            "certifications": filled("certifications", "struct<name:string,issuer:string,year:int>"),
            "preferences": preferences,
        }
    )


def read_profiles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(profiles with defaults filled in, rejected records) from JSON lines."""
    rows, rejects = _strict_json(spark, path, PROFILE)
    return complete_profiles(rows), rejects


def load_taxonomy(spark: SparkSession, path: str) -> Taxonomy:
    """Skill vocabulary from a JSON document {version, skills[name, aliases, category]}.

    The vocabulary becomes part of every matching expression, so it is job configuration and
    lives on the driver; a file of more than 100,000 spellings is refused.
    """
    skills = spark.read.schema(TAXONOMY).json(path, multiLine=True).select(F.posexplode("skills").alias("pos", "s"))
    rows = skills.orderBy("pos").select("s.*").limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("taxonomy is too large to be matched as one vocabulary")
    return Taxonomy.of([(r["name"], r["aliases"] or [], r["category"]) for r in rows])


def upsert_postings(current: DataFrame, batch: DataFrame) -> DataFrame:
    """Insert or replace by ``job_id``; the highest ``batch_seq`` wins, a missing one counts as lowest.

    Of equal numbers the batch wins over the stored row, and within one side the row of the
    largest hash, so the result does not depend on the order of rows. The winner is found on a
    narrow key that pre-aggregates on the map side; whole rows meet it afterwards.
    """
    merged = current.withColumn("_side", F.lit(0)).unionByName(batch.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    columns = [c for c in merged.columns if c != "_side"]
    if "batch_seq" not in columns:
        merged = merged.withColumn("batch_seq", F.lit(None).cast("long"))
    order = F.struct(F.coalesce("batch_seq", F.lit(-1)).alias("seq"), F.col("_side").alias("side"), F.xxhash64(*columns).alias("hash"))
    ranked = merged.withColumn("_order", order)
    winner = ranked.groupBy("job_id").agg(F.max("_order").alias("_order"))
    # Rows that tie on all of this are equal.
    return ranked.join(winner, ["job_id", "_order"], "left_semi").dropDuplicates(["job_id"]).select(*columns)


def upsert_profiles(current: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """Replace by ``profile_id``; the first ``created_at`` is kept and ``updated_at`` becomes now."""
    fresh = complete_profiles(batch)
    fields = [c for c in current.columns if c not in ("profile_id", "created_at", "updated_at")]
    old = current.select("profile_id", F.col("created_at").alias("old_created"), F.struct(*current.columns).alias("old"))
    new = fresh.select("profile_id", F.struct(*fields).alias("new"))
    joined = old.join(new, "profile_id", "full_outer")
    replaced = F.col("new").isNotNull()
    stamp = now.cast("timestamp")
    columns = {c: F.when(replaced, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")) for c in fields}
    columns["created_at"] = F.coalesce("old_created", stamp)
    columns["updated_at"] = F.when(replaced, stamp).otherwise(F.col("old.updated_at"))
    return joined.select("profile_id", *[columns[c].alias(c) for c in current.columns if c != "profile_id"]).select(
        current.columns
    )


def export_all(jobs: DataFrame, profiles: DataFrame, path: str) -> None:
    """Write every posting, newest first, and every profile, latest first, as JSON. Audit rows stay."""
    jobs.orderBy(F.desc("ingested_at"), F.desc("job_id")).write.mode("overwrite").json(f"{path}/jobs")
    profiles.orderBy(F.desc("updated_at")).write.mode("overwrite").json(f"{path}/profiles")


def write_postings(jobs: DataFrame, path: str) -> None:
    """Store postings by ingest day. ``keyset_page`` and ``recent`` of such a table read the days they need."""
    jobs.withColumn("ingest_day", F.to_date("ingested_at")).write.mode("overwrite").partitionBy("ingest_day").parquet(path)


def _in_days(days: list) -> Column:
    within = F.col("ingest_day").isin([d for d in days if d is not None])
    return within | F.col("ingest_day").isNull() if None in days else within


def upsert_stored(spark: SparkSession, path: str, batch: DataFrame) -> None:
    """Insert or replace postings in the table of ``write_postings``; only days that gain or lose a row are rewritten.

    A posting whose day has changed leaves its old day. The new content of the days is written
    aside as a whole before any day is touched; after a stop, ``finish_upsert`` (or the next upsert)
    completes what was ready and drops what was not. Running a batch again changes nothing.
    """
    finish_upsert(spark, path)
    columns = StructType.fromDDL(POSTING).names
    rows = cut_lineage(batch.select(*columns))
    if not path_exists(spark, path):
        write_postings(upsert_postings(rows.limit(0), rows), path)
        return
    stored = spark.read.parquet(path)
    ids = rows.select("job_id").distinct()
    before = stored.join(ids, "job_id", "left_semi")
    winners = cut_lineage(upsert_postings(before.select(*columns), rows).withColumn("ingest_day", F.to_date("ingested_at")))
    # One value per day of the table.
    days = [r.ingest_day for r in before.select("ingest_day").unionByName(winners.select("ingest_day")).distinct().collect()]
    if not days:
        return
    stay = stored.filter(_in_days(days)).join(ids, "job_id", "left_anti")
    aside = f"{path}/_pending"
    stay.select(*columns, "ingest_day").unionByName(winners.select(*columns, "ingest_day")).write.parquet(f"{aside}/rows")
    # Written last: from here on the upsert is sure to come about.
    spark.createDataFrame([(d,) for d in days], "ingest_day date").write.parquet(f"{aside}/days")
    finish_upsert(spark, path)


def finish_upsert(spark: SparkSession, path: str) -> None:
    """Complete an upsert that was stopped, or undo what it had not finished to prepare."""
    aside = f"{path}/_pending"
    if not path_exists(spark, aside):
        return
    if path_exists(spark, f"{aside}/days/_SUCCESS"):
        rows = spark.read.parquet(f"{aside}/rows")
        rows.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("ingest_day").parquet(path)
        left = {r.ingest_day for r in rows.select("ingest_day").distinct().collect()}
        for day in {r.ingest_day for r in spark.read.parquet(f"{aside}/days").collect()} - left:
            drop_files(spark, f"{path}/{_day_folder(day)}")
    drop_files(spark, aside)


def _day_folder(day) -> str:
    return f"ingest_day={'__HIVE_DEFAULT_PARTITION__' if day is None else day}"


def delete_stored(spark: SparkSession, path: str, ids: DataFrame) -> int:
    """Delete postings by ``job_id`` from the table of ``write_postings``; only days that hold one are rewritten."""
    stored = spark.read.parquet(path)
    gone = cut_lineage(stored.join(ids.select("job_id").distinct(), "job_id", "left_semi").select("job_id", "ingest_day"))
    # One value per partition of the table.
    days = [r.ingest_day for r in gone.select("ingest_day").distinct().collect()]
    if not days:
        return 0
    touched = stored.filter(_in_days(days))
    kept = cut_lineage(touched.join(gone.select("job_id"), "job_id", "left_anti"))
    kept.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("ingest_day").parquet(path)
    left = {r.ingest_day for r in kept.select("ingest_day").distinct().collect()}
    for day in set(days) - left:
        drop_files(spark, f"{path}/{_day_folder(day)}")
    return gone.count()


def retain_stored(spark: SparkSession, path: str, now: Column) -> int:
    """Delete what retention drops from the stored postings."""
    stored = spark.read.parquet(path)
    return delete_stored(spark, path, cut_lineage(stored.filter(retention_action(now).isNotNull()).select("job_id")))


def erase_stored(spark: SparkSession, paths: dict[str, str], now: Column) -> dict[str, int]:
    """Empty the stored tables; the audit table keeps one row that records the erasure. Returns the rows purged.

    That row is appended first, so a stop on the way leaves its trace. The tables stay, without
    rows, and can be read, written and erased again.
    """
    tables = {name: spark.read.parquet(path) for name, path in paths.items()}
    counts, emptied = erase_all({name: df.drop("day") for name, df in tables.items()}, now)
    purged = {r.table_name: r.purged for r in counts.collect()}
    if "audit" in paths:
        append_audit(emptied["audit"], paths["audit"])
    for name, path in paths.items():
        if name == "audit":
            emptied[name].withColumn("day", F.to_date("at")).write.mode("overwrite").partitionBy("day").parquet(path)
            continue
        # An empty file keeps the schema; in a table by days it lies in the folder of no day.
        by_day = "ingest_day" in tables[name].columns
        folder = f"{path}/{_day_folder(None)}" if by_day else path
        empty = spark.createDataFrame([], tables[name].drop("ingest_day").schema)
        if by_day:
            drop_files(spark, path)
        empty.write.mode("overwrite").parquet(folder)
    return purged


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POSTING).parquet(path)
