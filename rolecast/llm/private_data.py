"""Personal data: four fixed kinds, and identifiers found by the contexts that known ones stand in.

The fixed kinds and tokens shaped like credentials are seeds. The words around a seed form lexical
patterns; patterns and the tokens they meet form a graph, which is scored in turns: a pattern by
the share of known tokens it meets, a token by its best pattern. Patterns of high confidence then
name tokens, and these are seeds for further patterns. A token of a credential's shape is named
by its context too, never by its shape alone. Only column functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolecast.session import cut_lineage

#: Fixed values of the query's contract, in order. Runs are taken whole (possessive) and a run is
#: entered only at its start or where the last match ended, which finds the same matches in linear time.
KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
IP_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
#: A token with a digit in it.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
#: Punctuation around a token, which is not part of it.
LEADING, TRAILING = r"""^[(\[{<"']++""", r"""(?<![)\]}>"'.,;:!?])[)\]}>"'.,;:!?]++$"""
MIN_TOKEN = 6
FOUND = "id"
#: Tokens of these shapes are seeds besides the fixed kinds: digests and keys in hex, keys with a
#: short prefix of letters, signed tokens of three parts, and account numbers of two letters and two digits.
SEED_SHAPES = (
    r"[0-9a-f]{32,}",
    r"[0-9A-F]{32,}",
    r"[A-Za-z]{2,8}[_-][A-Za-z0-9_-]{20,}",
    r"[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}",
    r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}",
)
#: Characters of the text on either side that patterns may see.
CONTEXT = 80
ROUNDS = 3
#: A pattern is trusted with at least so many different seeds and this confidence.
MIN_SEEDS = 3
MIN_CONFIDENCE = 0.7
#: Stands for a null id in comparisons.
NO_ID = -(1 << 63)


def _hits(source: DataFrame, kind: str, pattern: str, guard: Column) -> DataFrame:
    """(row, tie, kind, nth, gap, hit, before, after): matches in order with the length of text since the last one."""
    found = source.filter(guard).select(
        "row", "tie", F.split("text", pattern, -1).alias("gaps"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("hits")
    )
    # One small row per match: the pieces of a text are not repeated with each of them.
    matches = F.expr(
        "transform(hits, (h, i) -> named_struct('nth', i, 'hit', h, 'gap', char_length(gaps[i]),"
        f" 'before', right(gaps[i], {CONTEXT}), 'after', left(gaps[i + 1], {CONTEXT})))"
    )
    return found.select("row", "tie", F.lit(kind).alias("kind"), F.inline(matches))


def luhn(digits: Column) -> Column:
    def add(total: Column, place: Column) -> Column:
        digit = F.substring(digits, -place, F.lit(1)).cast("int")
        doubled = F.when(place % 2 == 0, digit * 2).otherwise(digit)
        return total + F.when(doubled > 9, doubled - 9).otherwise(doubled)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), add) % 10 == 0


def _valid() -> Column:
    plain = F.regexp_replace("hit", "[^0-9]", "")
    size = F.char_length(plain)
    return (
        F.when(F.col("kind") == "ip", F.col("hit").rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$"))
        .when(F.col("kind") == "card", F.when(size.between(14, 19), luhn(plain)).otherwise(False))
        .when(F.col("kind") == "phone", size.between(10, 15))
        .otherwise(True)
    )


def placed_spans(source: DataFrame) -> DataFrame:
    """(row, tie, kind, start, end, value, before, after): valid base matches, and tokens that overlap none."""
    digit = F.col("text").rlike("[0-9]")
    guards = {"email": F.contains("text", F.lit("@")), "ip": digit, "card": digit, "phone": F.contains("text", F.lit("+")) & digit}
    hits = None
    for kind, pattern in [*KINDS.items(), (FOUND, TOKEN)]:
        more = _hits(source, kind, pattern, guards.get(kind, digit))
        hits = more if hits is None else hits.unionByName(more)
    # Copies of a row have the same matches; one of each stands for them.
    hits = hits.dropDuplicates(["row", "tie", "kind", "nth"])
    in_order = Window.partitionBy("row", "tie", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    size = F.char_length("hit")
    ends = hits.withColumn("end", F.sum(F.col("gap") + size).over(in_order))
    lead = F.char_length(F.regexp_extract("hit", LEADING, 0))
    trail = F.char_length(F.regexp_extract("hit", TRAILING, 0))
    token = F.col("kind") == FOUND
    spans = ends.select(
        "row", "tie", "kind",
        (F.col("end") - size + F.when(token, lead).otherwise(0)).alias("start"),
        (F.col("end") - F.when(token, trail).otherwise(0)).alias("end"),
        F.when(token, F.regexp_replace(F.regexp_replace("hit", LEADING, ""), TRAILING, "")).otherwise(F.col("hit")).alias("value"),
        "before", "after", _valid().alias("valid"),
    ).filter("valid").drop("valid").filter((F.col("kind") != FOUND) | (F.char_length("value") >= MIN_TOKEN))
    # A token gives way to any base span that reaches into it.
    by_start = Window.partitionBy("row", "tie").orderBy("start")
    base_end = F.max(F.when(F.col("kind") != FOUND, F.col("end"))).over(by_start.rangeBetween(Window.unboundedPreceding, 0))
    base_start = F.min(F.when(F.col("kind") != FOUND, F.col("start"))).over(by_start.rangeBetween(0, Window.unboundedFollowing))
    covered = (F.coalesce(base_end, F.lit(0)) > F.col("start")) | (F.coalesce(base_start, F.col("end")) < F.col("end"))
    return spans.withColumn("covered", covered).filter((F.col("kind") != FOUND) | ~F.col("covered")).drop("covered")


def with_patterns(spans: DataFrame) -> DataFrame:
    """Spans with their lexical patterns: the two words before, and the words on both sides."""
    word = r"[^\x20\x09-\x0D]+"
    left = F.regexp_extract_all(F.lower("before"), F.lit(rf"{word}(?=[\x20\x09-\x0D]*(?:{word}[\x20\x09-\x0D]*)?$)"), F.lit(0))
    right = F.regexp_extract(F.lower("after"), word, 0)
    shaped = spans.withColumns({"left": left, "right": right})
    last = F.element_at("left", -1)
    patterns = F.array(
        F.when(F.size("left") >= 2, F.concat(F.element_at("left", -2), F.lit(" "), last, F.lit(" _"))),
        F.when((F.size("left") >= 1) & (F.col("right") != ""), F.concat(last, F.lit(" _ "), F.col("right"))),
    )
    return shaped.withColumn("patterns", F.array_compact(patterns)).drop("left", "right", "before", "after")


def trusted_patterns(spans: DataFrame, seed_shapes: Sequence[str] = SEED_SHAPES) -> DataFrame:
    """(pattern) of high confidence. Patterns and values are scored in turn, for some rounds at a time.

    Values of the fixed kinds and of the given shapes are seeds. The values of trusted patterns are seeds of the next rounds, until no further pattern is trusted.
    """
    seed = F.col("kind") != FOUND
    if seed_shapes:
        seed = seed | F.col("value").rlike(f"^(?:{'|'.join(seed_shapes)})$")
    edges = cut_lineage(
        spans.select(F.explode("patterns").alias("pattern"), "value", seed.cast("int").alias("seed"))
        .groupBy("pattern", "value")
        .agg(F.max("seed").alias("seed"))
    )
    # A pattern of fewer values can never have enough seeds, so it neither earns trust nor gives a score.
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_SEEDS)
    edges = cut_lineage(edges.join(sizes, "pattern"))
    base = edges.filter("seed = 1").select("value", F.lit(1).alias("known")).distinct()
    known, count = cut_lineage(base), 0
    while True:
        values = known.withColumn("score", F.lit(1.0))
        for _ in range(ROUNDS):
            # Values without a score add nothing; ``n`` counts them.
            patterns = cut_lineage(
                edges.join(values, "value").groupBy("pattern", "n").agg(F.sum("score").alias("score"), F.sum("known").alias("seeds"))
                .filter(F.col("seeds") >= MIN_SEEDS)
                .select("pattern", (F.col("score") / (F.col("n") + 1)).alias("confidence"))
            )
            reached = edges.join(patterns, "pattern").groupBy("value").agg(F.max("confidence").alias("confidence"))
            values = cut_lineage(
                reached.join(known, "value", "full_outer")
                .select("value", F.coalesce("known", F.lit(0)).alias("known"), F.when(F.col("known") == 1, 1.0).otherwise(F.col("confidence")).alias("score"))
            )
        trusted = cut_lineage(patterns.filter(F.col("confidence") >= MIN_CONFIDENCE).select("pattern"))
        # Trust only grows with the seeds: as many patterns as before are the same ones.
        before, count = count, trusted.count()
        if count == before:
            return trusted
        found = edges.join(trusted, "pattern", "left_semi").select("value", F.lit(1).alias("known"))
        known = cut_lineage(base.unionByName(found).distinct())


def personal_data(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed_shapes: Sequence[str] = SEED_SHAPES
) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found), one row per document.

    ``spans`` lists ``kind:start:end`` in code points by start, then kind; identifiers found by
    context have the kind ``id`` and come last. ``base_sha256`` is the digest of the list without them.
    ``seed_shapes`` are patterns of whole tokens that are seeds besides the fixed kinds.
    A null or empty text has no spans. A null id is passed on; equal rows are judged once and all
    listed. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("row"), F.xxhash64(text).alias("tie"), text.alias("text")
    )
    spans = cut_lineage(with_patterns(placed_spans(source)))
    trusted = trusted_patterns(spans, seed_shapes)
    named = (
        spans.filter(F.col("kind") == FOUND)
        .select("row", "tie", "kind", "start", "end", F.explode("patterns").alias("pattern"))
        .join(trusted, "pattern", "left_semi")
        .select("row", "tie", "kind", "start", "end")
        .distinct()
    )
    base = spans.filter(F.col("kind") != FOUND).select("row", "tie", "kind", "start", "end")
    order = F.lit(0)
    for n, kind in enumerate([*KINDS, FOUND]):
        order = F.when(F.col("kind") == kind, n).otherwise(order)
    # The spans of one document.
    listed = base.unionByName(named).groupBy("row", "tie").agg(
        F.sort_array(F.collect_list(F.struct("start", order.alias("order"), "end", "kind"))).alias("all"),
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in KINDS],
        F.count(F.when(F.col("kind") == FOUND, 1)).alias("n_found"),
    )

    def joined(array: Column) -> Column:
        return F.array_join(F.transform(array, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    found = listed.select(
        "row", "tie", *[f"n_{k}" for k in KINDS], "n_found",
        joined(F.filter("all", lambda s: s["kind"] != FOUND)).alias("base"), joined(F.col("all")).alias("spans"),
    )
    return (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"))
        .withColumn("row", F.coalesce("doc_id", F.lit(NO_ID)))
        .join(found, ["row", "tie"], "left")
        .select(
            "doc_id",
            *[F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in KINDS],
            F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
            F.coalesce("spans", F.lit("")).alias("spans"),
            F.coalesce("n_found", F.lit(0)).alias("n_found"),
        )
    )
