"""Token sets and set similarity for duplicate detection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolecast.functions.regex import SPACE, js_trim, rx

SHINGLE_WORDS = 5
# Fixed value: legal forms dropped from a company name.
LEGAL_FORMS = r"\b(?:private\s+limited|pvt\s+ltd|pvt|private|limited|ltd|incorporated|inc|llc|corporation|corp)\b"


def normalize_company(company: Column) -> Column:
    name = F.lower(F.coalesce(company, F.lit("")))
    name = F.regexp_replace(name, f"[^A-Za-z0-9_{SPACE}]", " ")
    name = F.regexp_replace(name, rx(LEGAL_FORMS), " ")
    name = F.regexp_replace(name, f"[^a-z0-9{SPACE}]", " ")
    return js_trim(F.regexp_replace(name, f"[{SPACE}]+", " "))


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def title_tokens(title: Column) -> Column:
    """Distinct ASCII tokens; a title without any has the empty set."""
    return F.array_distinct(_tokens(title))


def shingles(text: Column, max_chars: int | None = None) -> Column:
    """Distinct five-word shingles; a shorter text is one shingle, an empty one none.

    The whole text is used unless ``max_chars`` is given.
    """
    words = _tokens(text if max_chars is None else F.left(text, F.lit(max_chars)))

    def build(tokens: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(tokens) - (SHINGLE_WORDS - 1), F.lit(1)))
        joined = F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, SHINGLE_WORDS), " "))
        return F.when(F.size(tokens) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(joined))

    # A one-element transform names the token array, so the text is tokenized once.
    return F.transform(F.array(words), build)[0]


def shingle_hashes(text: Column, max_chars: int | None = None) -> Column:
    """The set of ``shingles`` as sorted 64-bit hashes: an eighth of the bytes, and the same sizes and overlaps."""
    words = _tokens(text if max_chars is None else F.left(text, F.lit(max_chars)))

    def build(tokens: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(tokens) - SHINGLE_WORDS, F.lit(0)))
        # Words beyond the end are null and leave the hash as it is.
        hashed = F.transform(starts, lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(SHINGLE_WORDS)]))
        return F.when(F.size(tokens) == 0, F.array().cast("array<bigint>")).otherwise(F.array_sort(F.array_distinct(hashed)))

    return F.transform(F.array(words), build)[0]


def jaccard(a: Column, b: Column) -> Column:
    """|A ∩ B| / |A ∪ B| of two arrays of distinct elements; two empty sets are equal."""
    shared = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - shared
    return F.when(total == 0, F.lit(1.0)).otherwise(shared / total)


def round2(value: Column) -> Column:
    """Half-up rounding to two places on the double scale used by the scores."""
    return F.floor((value + F.lit(2.220446049250313e-16)) * 100 + 0.5) / 100
