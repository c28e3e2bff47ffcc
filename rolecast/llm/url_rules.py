"""URL filter lists: host-suffix and path-prefix expressions met by short hash prefixes.

Rules are stored as digests. Each URL is expanded into the expressions a rule could be written
as; expressions meet rules on the first bytes of their digests, then whole digests decide, and
the longest rule wins. Only column functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the query's contract: verdict, host, path prefix.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: Hex digits of a digest's short prefix: four bytes.
PREFIX_DIGITS = 8
#: A rule's path and host are no longer than this; a longer rule is an error.
MAX_RULE_CHARS = 2_048
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(host: Column, path: Column) -> Column:
    # A host holds no slash and a rule's path starts with one or is empty, so the parts stay apart.
    return F.sha2(F.concat(host, path), 256)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    parts = ("verdict", "host", "path")
    rows = [F.struct(*[F.lit(value).alias(name) for name, value in zip(parts, rule)]) for rule in rules]
    kind = "array<struct<verdict:string,host:string,path:string>>"
    return spark.range(1).select(F.inline(F.array(*rows).cast(kind)))


def prepared_rules(rules: DataFrame) -> DataFrame:
    """Rules with digests. Rules of the same expression count once; block wins over allow."""
    checked = rules.select(
        "verdict",
        F.translate("host", UPPER, LOWER).alias("host"),
        F.assert_true(F.length("host") + F.length("path") <= MAX_RULE_CHARS, "a rule is too long").alias("ok"),
        "path",
    ).filter("host is not null and path is not null and (verdict = 'allow' or verdict = 'block') and ok is null")
    full = digest(F.col("host"), F.col("path"))
    one = checked.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    return one.select(
        F.substring(full, 1, PREFIX_DIGITS).alias("short"),
        full.alias("digest"),
        F.concat("host", "path").alias("rule"),
        F.length("path").alias("path_chars"),
        F.size(F.split("host", r"\.")).alias("labels"),
        "verdict",
    )


def url_verdicts(
    pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """(id, host, path, rule, verdict), one row per page.

    ``rules(verdict, host, path)``: a rule fits its host and all subdomains of it, if the URL's path
    starts with the rule's. The longest fitting rule wins (among equals the one with the longer
    host); without one, ``rule`` is null and the verdict ``default``.

    A null URL, or one without ``://``, has an empty host and path. Rows with a null or repeated id
    are judged each on its own. Other columns are not read. Null or unknown parts drop a rule.

    Expressions are limited to the (host labels, path length) shapes that rules have. Path lengths
    are at most ``MAX_RULE_CHARS``, so the list of shapes is bounded however many rules there are.
    """
    known = prepared_rules(rules)
    shapes = known.groupBy("path_chars").agg(F.sort_array(F.collect_set("labels")).alias("label_counts"))
    widths = sorted((r.path_chars, list(r.label_counts)) for r in shapes.collect())
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    parsed = pages.select(
        F.col(id_col).alias("page_id"),
        F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER).alias("host"),
        F.regexp_extract(url, PARTS, 2).alias("path"),
    )
    # The same (host, path) is looked up once, however many pages have it.
    places = parsed.select("host", "path").filter("host <> '' or path <> ''").distinct()
    labels = F.split("host", r"\.")
    expressions = []
    for path_chars, label_counts in widths:
        expressions += [
            F.when(
                (F.size(labels) >= n) & (F.length("path") >= path_chars),
                F.struct(
                    F.array_join(F.slice(labels, -n, n), ".").alias("host"),
                    F.substring("path", 1, path_chars).alias("path"),
                ),
            )
            for n in label_counts
        ]
    best = places.select("host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("found"))
    if expressions:
        expanded = places.select("host", "path", F.explode(F.array_compact(F.array(*expressions))).alias("e"))
        full = digest(F.col("e.host"), F.col("e.path"))
        asked = expanded.select("host", "path", full.alias("asked"), F.substring(full, 1, PREFIX_DIGITS).alias("short"))
        met = asked.join(known, "short").filter(F.col("asked") == F.col("digest"))
        order = F.struct(F.length("rule"), -F.col("path_chars"))
        best = met.groupBy("host", "path").agg(
            F.max_by("rule", order).alias("rule"), F.max_by("verdict", order).alias("found")
        )
    return (
        parsed.join(best, ["host", "path"], "left")
        .select("page_id", "host", "path", "rule", F.coalesce("found", F.lit(default)).alias("verdict"))
    )
