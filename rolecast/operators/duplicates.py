"""Exact and near duplicates over a whole corpus.

Two postings are duplicates when they share a fingerprint, or when their
normalized companies are equal and not empty, their title tokens reach a Jaccard
similarity of 0.8 and their description shingles one of 0.85.

Copies are collapsed first: postings with the same company, title tokens and
shingles form one *content class* and are compared once. Groups of copies thus
cost one comparison per member, however large they are.

Shingles are kept as 64-bit hashes. Candidate pairs are sifted by the place of the
element they share, then by size, title and signature, none of which can lose a
pair; only the sets of pairs that are left meet.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolecast.functions.similarity import normalize_company, shingle_hashes, title_tokens
from rolecast.plans.candidates import differing_bits, element_order, fetched, may_reach, prefixes, with_signature
from rolecast.plans.components import connected_components
from rolecast.plans.skew import bucket_pairs, salted_join
from rolecast.plans.stage import stage
from rolecast.session import cut_lineage

TITLE_THRESHOLD = (4, 5)
DESCRIPTION_THRESHOLD = (17, 20)
#: Rounds that compare a bucket only with its leaders before the remaining pairs are listed.
LEADER_ROUNDS = 2

_TIES_ROUND_UP = [k for k in range(101) if Decimal((2 * k + 1) / 200) >= Decimal(2 * k + 1) / 200]


def two_places(shared: Column, total: Column) -> Column:
    """shared/total with two decimals, rounded as the exact value of the double is."""
    shared, total = shared.cast("bigint"), total.cast("bigint")
    tie = (shared * 200 + total) % (total * 2) == 0
    hundredths = F.floor((shared * 200 + total) / (total * 2)).cast("int")
    hundredths = F.when(tie & ~(hundredths - 1).isin(_TIES_ROUND_UP), hundredths - 1).otherwise(hundredths)
    return F.format_string("%d.%02d", F.floor(hundredths / 100).cast("int"), hundredths % 100)


def near_evidence(company: Column, title: Column, description: Column) -> Column:
    return F.concat(
        F.lit("Heuristic match: company '"), company, F.lit("', title similarity "), title,
        F.lit(", description similarity "), description,
    )


def prepare_postings(src: DataFrame, max_chars: int | None = None, carry: Sequence[Column] = ()) -> DataFrame:
    """Comparison keys of each posting, computed once: company, token set, shingle set, class; ``carry`` goes along."""
    keyed = src.select(
        "job_id",
        "fingerprint",
        normalize_company(F.col("company")).alias("company"),
        F.array_sort(title_tokens(F.col("title"))).alias("title_set"),
        shingle_hashes(F.col("description"), max_chars).alias("shingle_set"),
        *carry,
    )
    keyed = stage(keyed)
    content = F.concat_ws("\u0001", "company", F.array_join("title_set", " "), F.array_join(F.col("shingle_set").cast("array<string>"), " "))
    # Without a company only the fingerprint can make two postings equal.
    content = F.when(F.col("company") == "", F.concat(F.lit("fp "), "fingerprint")).otherwise(content)
    # 128 bits of the digest.
    return keyed.withColumn("class_key", F.base64(F.substring(F.unhex(F.sha2(content, 256)), 1, 16)))


def exact_duplicates(src: DataFrame) -> DataFrame:
    """(fingerprint, first_job_id, copies, job_id): one row per posting that shares its fingerprint."""
    groups = (
        src.groupBy("fingerprint")
        .agg(F.min("job_id").alias("first_job_id"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
    )
    return salted_join(src.select("fingerprint", "job_id"), groups, ["fingerprint"], "job_id").select(
        "fingerprint", "first_job_id", "copies", "job_id"
    )


class Corpus:
    """Postings made ready for comparison. Their sets are written once and never copied.

    A class goes by the number of its first posting. ``members`` has (job_id, fingerprint, company, node,
    class_key) of each posting, ``classes`` the classes with a company without their sets, ``sets`` the
    sets of all postings by their own number.
    """

    def __init__(self, src: DataFrame, max_chars: int | None = None, carry: Sequence[str] = ()):
        keyed = prepare_postings(src, max_chars, [F.col(c) for c in carry]).withColumn("node", F.monotonically_increasing_id())
        written = cut_lineage(with_signature(keyed, "shingle_set", "signature"))
        firsts = cut_lineage(
            written.groupBy("class_key")
            .agg(F.min(F.struct("job_id", "node")).alias("first"), F.min("fingerprint").alias("min_fp"), F.max("fingerprint").alias("max_fp"))
            .select("class_key", "first.*", "min_fp", "max_fp")
        )
        named = salted_join(
            written.select("job_id", "fingerprint", "company", "node", "class_key", *carry),
            firsts.select("class_key", F.col("node").alias("first_node")), ["class_key"], "job_id",
        )
        self.members = cut_lineage(named.drop("class_key").withColumnRenamed("first_node", "class_key"))
        companies = written.filter("company <> ''")
        short = companies.select("node", "company", "title_set", F.size("shingle_set").alias("n"), "signature")
        self.classes = cut_lineage(
            short.join(firsts.select("node", "job_id", "min_fp", "max_fp"), "node").withColumnRenamed("node", "class_key")
        )
        self.sets = companies.select(F.col("node").alias("class_key"), "company", "title_set", "shingle_set")

    @cached_property
    def buckets(self) -> DataFrame:
        """(key, class_key, kind, n, pos): prefix rows of classes that meet another one there."""
        copies = self.members.filter("node <> class_key").select(F.col("node").alias("class_key"))
        rows = class_prefixes(self.sets).select(meeting_key().alias("key"), "class_key", "kind", "n", "pos")
        rows = rows.join(copies, "class_key", "left_anti")
        # Counted and kept in one pass: most elements of a prefix are in one class only.
        met = rows.withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy("key")))
        return cut_lineage(met.filter("_rows > 1").drop("_rows"))

    @cached_property
    def similar(self) -> DataFrame:
        """(class_key_a, class_key_b) with counts: all pairs of different classes that reach both thresholds."""
        return cut_lineage(verified_pairs(met_pairs(self.buckets).distinct(), self.classes, self.sets))


def corpus(src: DataFrame | Corpus, max_chars: int | None = None) -> Corpus:
    return src if isinstance(src, Corpus) else Corpus(src, max_chars)


def class_prefixes(classes: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(class_key, company, bucket, n, pos, kind): elements at which any two near-duplicate classes are sure to meet."""
    order = element_order(classes, "shingle_set", known)
    by_text = prefixes(classes, "class_key", "company", "shingle_set", order, *DESCRIPTION_THRESHOLD)
    # Postings without any shingle are equal in description, so they meet by title.
    wordless = classes.filter(F.size("shingle_set") == 0).withColumn("titles", title_hashes())
    by_title = prefixes(wordless, "class_key", "company", "titles", np.zeros_like(order), *TITLE_THRESHOLD)
    return by_text.withColumn("kind", F.lit("text")).unionByName(by_title.withColumn("kind", F.lit("title")))


def title_hashes() -> Column:
    return F.array_sort(F.array_distinct(F.transform("title_set", lambda e: F.xxhash64(e))))


def meeting_key() -> Column:
    """One number for company, kind and element; what meets by it is verified, company included."""
    return F.xxhash64("company", "kind", "bucket")


def met_pairs(rows: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """(class_key_a, class_key_b) of classes that meet in a prefix and may reach their threshold, with ``extra`` of both."""
    key = F.col("key") if "key" in rows.columns else meeting_key()
    keyed = rows.select(key.alias("key"), "class_key", "kind", "n", "pos", *extra)
    pairs = bucket_pairs(keyed, ["key"], "class_key", ["kind", "n", "pos", *extra])
    text = F.col("kind_a") == "text"
    top, bottom = [F.when(text, x).otherwise(y) for x, y in zip(DESCRIPTION_THRESHOLD, TITLE_THRESHOLD)]
    return pairs.filter(may_reach(top, bottom)).drop("key", "kind_a", "kind_b", "n_a", "n_b", "pos_a", "pos_b")


def verified_pairs(pairs: DataFrame, classes: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """Keep the pairs (class_key_a, class_key_b) that reach both thresholds, with counts.

    Without ``sets`` the classes hold their shingles.
    """

    def shared(column: str) -> Column:
        return F.size(F.array_intersect(F.col(f"{column}_a"), F.col(f"{column}_b")))

    def reaches(column: str, threshold: tuple[int, int]) -> Column:
        both, total = F.col(f"{column}_shared"), F.col(f"{column}_total")
        return both * threshold[1] >= total * threshold[0]

    def counted(df: DataFrame, column: str) -> DataFrame:
        df = df.withColumn(f"{column}_shared", shared(column))
        total = F.size(f"{column}_a") + F.size(f"{column}_b") - F.col(f"{column}_shared")
        # Two empty sets are equal: count them as one shared element of one.
        return df.withColumns(
            {
                f"{column}_total": F.when(total == 0, 1).otherwise(total),
                f"{column}_shared": F.when(total == 0, 1).otherwise(F.col(f"{column}_shared")),
            }
        ).drop(f"{column}_a", f"{column}_b")

    def side(suffix: str, columns: list[str]) -> DataFrame:
        return classes.select(*[F.col(c).alias(f"{c}_{suffix}") for c in ["class_key", *columns]])

    # Titles, sizes and signatures are short and settle most pairs; shingles are fetched for the rest only.
    if sets is None:
        sets, classes = classes, classes.withColumn("n", F.size("shingle_set"))
    short = ["company", "title_set", "n", "signature"]
    titles = salted_join(pairs, side("a", short), ["class_key_a"], "class_key_b")
    titles = salted_join(titles, side("b", short), ["class_key_b"], "class_key_a")
    top, bottom = DESCRIPTION_THRESHOLD
    total = F.col("n_a") + F.col("n_b")
    # Of sets that reach top/bottom at most this share of the elements is in one of them only.
    close = differing_bits(F.col("signature_a"), F.col("signature_b")) * (top + bottom) <= total * (bottom - top)
    close = (F.least("n_a", "n_b") * bottom >= F.greatest("n_a", "n_b") * top) & close
    titles = titles.filter(close & (F.col("company_a") == F.col("company_b")))
    titles = counted(titles, "title_set").filter(reaches("title_set", TITLE_THRESHOLD))
    left = cut_lineage(titles.select("class_key_a", "class_key_b", "title_set_shared", "title_set_total"))
    ends = left.select(F.explode(F.array("class_key_a", "class_key_b")).alias("class_key"))
    wanted = cut_lineage(fetched(sets.select("class_key", "shingle_set"), "class_key", ends))
    texts = left.join(wanted.toDF("class_key_a", "shingle_set_a"), "class_key_a").join(wanted.toDF("class_key_b", "shingle_set_b"), "class_key_b")
    return counted(texts, "shingle_set").filter(reaches("shingle_set", DESCRIPTION_THRESHOLD))


def similarity_texts() -> tuple[Column, Column]:
    """Both similarities of a verified pair, with two decimals."""
    return (
        two_places(F.col("title_set_shared"), F.col("title_set_total")),
        two_places(F.col("shingle_set_shared"), F.col("shingle_set_total")),
    )


def near_duplicate_pairs(src: DataFrame | Corpus, max_chars: int | None = None, among: str | None = None) -> DataFrame:
    """Near-duplicate pairs (job_id_a < job_id_b) with similarities and evidence.

    Content classes are represented by their first posting; the other members of a class are
    paired with it, so a group of m copies yields m - 1 rows and no pair is lost: every member
    stands in the same relation to the rest as its representative. With ``among``, a carried
    column, only the postings for which it is true count.
    """
    found = corpus(src, max_chars)
    members = found.members.filter("company <> ''")
    if among is None:
        names = found.classes.select("class_key", "job_id", "company", "min_fp", "max_fp")
    else:
        members = members.filter(among)
        names = members.groupBy("class_key").agg(
            F.min("job_id").alias("job_id"), F.first("company").alias("company"),
            F.min("fingerprint").alias("min_fp"), F.max("fingerprint").alias("max_fp"),
        )
    a = names.toDF("class_key_a", "job_id_1", "company", "min_fp_a", "max_fp_a")
    b = names.drop("company").toDF("class_key_b", "job_id_2", "min_fp_b", "max_fp_b")
    title_text, description_text = similarity_texts()
    across = (
        found.similar
        .join(a, "class_key_a")
        .join(b, "class_key_b")
        .filter("NOT (min_fp_a = max_fp_a AND min_fp_b = max_fp_b AND min_fp_a = min_fp_b)")
        .select(
            F.least("job_id_1", "job_id_2").alias("job_id_a"),
            F.greatest("job_id_1", "job_id_2").alias("job_id_b"),
            "company",
            (F.col("title_set_shared") / F.col("title_set_total")).alias("title_similarity"),
            (F.col("shingle_set_shared") / F.col("shingle_set_total")).alias("description_similarity"),
            title_text.alias("title_text"),
            description_text.alias("description_text"),
        )
    )
    copies = (
        salted_join(
            members.select("class_key", "job_id"),
            names.filter("min_fp <> max_fp").select("class_key", F.col("job_id").alias("job_id_a"), "company"),
            ["class_key"],
            "job_id",
        )
        .filter("job_id > job_id_a")
        .select(
            "job_id_a",
            F.col("job_id").alias("job_id_b"),
            "company",
            F.lit(1.0).alias("title_similarity"),
            F.lit(1.0).alias("description_similarity"),
            F.lit("1.00").alias("title_text"),
            F.lit("1.00").alias("description_text"),
        )
    )
    evidence = near_evidence(F.col("company"), F.col("title_text"), F.col("description_text"))
    return across.unionByName(copies).withColumn("evidence", evidence).drop("title_text", "description_text")


def _leader_edges(buckets: DataFrame, labels: DataFrame | None, round_no: int, found: Corpus) -> DataFrame:
    """Compare each bucket member with one leader per component of its bucket."""
    keys = ["key"]
    seed = F.struct(F.xxhash64("class_key", F.lit(round_no)), F.col("class_key"))
    if labels is None:
        leaders = buckets.groupBy(*keys).agg(F.min_by("class_key", seed).alias("class_key_a"))
        met = salted_join(buckets, leaders, keys, "class_key")
    else:
        leaders = buckets.groupBy(*keys, "label").agg(F.min_by("class_key", seed).alias("class_key_a"))
        met = salted_join(buckets, leaders.withColumnRenamed("label", "leader_label"), keys, "class_key").filter(
            "label <> leader_label"
        )
    pairs = met.select("class_key_a", F.col("class_key").alias("class_key_b")).filter("class_key_a <> class_key_b")
    return verified_pairs(pairs.distinct(), found.classes, found.sets).select(F.col("class_key_a").alias("a"), F.col("class_key_b").alias("b"))


def _with_labels(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Bucket rows with component labels, without buckets that are one component already."""
    labelled = buckets.join(labels.withColumnRenamed("node", "class_key"), "class_key", "left").withColumn(
        "label", F.coalesce("label", "class_key")
    )
    keys = ["key"]
    open_buckets = (
        labelled.groupBy(*keys).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select(*keys)
    )
    return salted_join(labelled, open_buckets, keys, "class_key", "left_semi")


def _near_edges(found: Corpus, base: DataFrame) -> DataFrame:
    """Edges that connect all near-duplicate classes, without listing every pair of a cluster.

    Leaders settle dense clusters in linear work. Only buckets that still hold several
    components are then searched pair by pair, so the result is exact.
    """
    buckets = found.buckets
    edges = cut_lineage(base.unionByName(_leader_edges(buckets, None, 0, found)))
    for round_no in range(1, LEADER_ROUNDS):
        labelled = _with_labels(buckets, connected_components(edges))
        edges = cut_lineage(edges.unionByName(_leader_edges(labelled, labelled, round_no, found)))
    rest = _with_labels(buckets, connected_components(edges))
    pairs = met_pairs(rest, ["label"]).filter("label_a <> label_b")
    verified = verified_pairs(pairs.select("class_key_a", "class_key_b").distinct(), found.classes, found.sets)
    further = verified.select(F.col("class_key_a").alias("a"), F.col("class_key_b").alias("b"))
    # The components read the edges twice; the comparison behind them should run once.
    return cut_lineage(edges.unionByName(further))


def duplicate_groups(src: DataFrame | Corpus, max_chars: int | None = None) -> DataFrame:
    """(group_id, job_id, group_size) of all transitive groups of two or more.

    ``group_id`` is the first job id of the group. One row per member: a group of any size is
    never gathered into one row or task.
    """
    found = corpus(src, max_chars)
    members = found.members.select("job_id", "fingerprint", "class_key")
    # Equal fingerprints may still differ in class when spacing moved a text limit.
    spread = (
        members.groupBy("fingerprint")
        .agg(F.min("class_key").alias("b"), F.max("class_key").alias("hi"))
        .filter("b <> hi")
        .select("fingerprint", "b")
    )
    by_fingerprint = (
        salted_join(members, spread, ["fingerprint"], "job_id").select(F.col("class_key").alias("a"), "b").distinct()
    )
    labels = connected_components(_near_edges(found, by_fingerprint))
    labelled = salted_join(members, labels.withColumnRenamed("node", "class_key"), ["class_key"], "job_id", "left").select(
        "job_id", F.coalesce("label", "class_key").alias("label")
    )
    groups = (
        labelled.groupBy("label")
        .agg(F.min("job_id").alias("group_id"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
    )
    return salted_join(labelled, groups, ["label"], "job_id").select("group_id", "job_id", "group_size")


def group_evidence(src: DataFrame | Corpus, groups: DataFrame, max_chars: int | None = None) -> DataFrame:
    """(group_id, evidence): the distinct reasons of each group, one row per reason."""
    found = corpus(src, max_chars)
    by_fingerprint = (
        found.members.groupBy("fingerprint")
        .agg(F.min("job_id").alias("job_id"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("job_id", F.concat(F.lit("Identical fingerprint: "), "fingerprint").alias("evidence"))
    )
    by_similarity = near_duplicate_pairs(found).select(F.col("job_id_a").alias("job_id"), "evidence")
    reasons = by_fingerprint.unionByName(by_similarity).distinct()
    return groups.select("group_id", "job_id").join(reasons, "job_id").select("group_id", "evidence").distinct()


#: Columns that ``arrivals`` adds.
ARRIVED = ("in_batch", "in_store")


def arrivals(batch: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Postings of a batch and of a store as one table; ``in_batch`` and ``in_store`` tell where each is.

    A posting that is the same in both is one row. Without ``stored`` the batch is stored already.
    """
    columns = ["job_id", "fingerprint", "company", "title", "description"]
    if stored is None:
        return batch.select(*columns, F.lit(True).alias("in_batch"), F.lit(True).alias("in_store"))
    both = batch.select(*columns, F.lit(True).alias("in_batch"), F.lit(False).alias("in_store")).unionByName(
        stored.select(*columns, F.lit(False).alias("in_batch"), F.lit(True).alias("in_store"))
    )
    same = F.sha2(F.to_json(F.struct(*columns)), 256).alias("same")
    return (
        both.groupBy("job_id", same)
        .agg(*[F.first(c).alias(c) for c in columns[1:]], F.max("in_batch").alias("in_batch"), F.max("in_store").alias("in_store"))
        .drop("same")
    )


def batch_matches(found: Corpus) -> DataFrame:
    """(job_id, existing_job_id, reason): every stored posting that a posting of the batch duplicates.

    ``found`` is made of ``arrivals``. A posting that is in the batch and in the store finds itself there.
    Classes are compared once; their postings meet by class, so no posting is compared with another.
    """
    batch = found.members.filter("in_batch")
    stored = found.members.filter("in_store").withColumnsRenamed({"job_id": "existing_job_id", "fingerprint": "existing_fingerprint"})
    by_fingerprint = stored.select(F.col("existing_fingerprint").alias("fingerprint"), "existing_job_id")
    same = salted_join(batch.select("job_id", "fingerprint"), by_fingerprint, ["fingerprint"], "job_id").select(
        "job_id", "existing_job_id", F.concat(F.lit("Identical fingerprint: "), "fingerprint").alias("reason")
    )
    title_text, description_text = similarity_texts()
    companies = found.classes.select(F.col("class_key").alias("class_key_a"), "company")
    pairs = found.similar.join(companies, "class_key_a").select(
        "class_key_a", "class_key_b", near_evidence(F.col("company"), title_text, description_text).alias("reason")
    )
    # Of one class, only postings of different fingerprints are still to be matched.
    alike = found.classes.filter("min_fp <> max_fp").select(
        "class_key", F.col("class_key").alias("other"), near_evidence(F.col("company"), F.lit("1.00"), F.lit("1.00")).alias("reason")
    )
    links = cut_lineage(
        pairs.toDF("class_key", "other", "reason").unionByName(pairs.toDF("other", "class_key", "reason")).unionByName(alike)
    )
    told = salted_join(batch.select("job_id", "fingerprint", "class_key"), links, ["class_key"], "job_id").drop("class_key")
    members = stored.select(F.col("class_key").alias("other"), "existing_job_id", "existing_fingerprint")
    members = members.join(links.select("other").distinct(), "other", "left_semi")
    near = salted_join(told, members, ["other"], "job_id").filter("fingerprint <> existing_fingerprint")
    return same.unionByName(near.select("job_id", "existing_job_id", "reason"))
