"""SimHash near-duplicates with anchor-point covering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from rolecast.llm.arrays import majority_bits
from rolecast.llm.hamming import ROWS, links
from rolecast.plans.components import connected_components
from rolecast.session import cut_lineage

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
#: Shingles whose hashes are held at once.
HASHES = 1 << 18


class AnchorCode:
    """Covering code on a field of bits: a direct sum of perfect one-error codes and free bits.

    Its anchors are the words of zero syndrome. Every value lies within ``radius`` of an anchor,
    its home. Two values at most ``reach`` apart meet at the home of either one, if the other is
    also sent to every anchor within ``radius + reach``.
    """

    def __init__(self, parts: list[int], free: int, reach: int) -> None:
        self.bits = sum(parts) + free
        self.radius = len(parts)
        self.reach = reach
        self.columns = np.zeros(self.bits, dtype=np.int64)
        at = shift = 0
        for size in parts:
            self.columns[at : at + size] = np.arange(1, size + 1) << shift
            at, shift = at + size, shift + size.bit_length()
        self.syndromes = 1 << shift
        found: list[list[int]] = [[] for _ in range(self.syndromes)]
        for weight in range(self.radius + reach + 1):
            for places in combinations(range(self.bits), weight):
                syndrome = 0
                for p in places:
                    syndrome ^= int(self.columns[p])
                found[syndrome].append(sum(1 << p for p in places))
        #: By syndrome, errors that lead to an anchor, lightest first: the first one leads home.
        self.count = np.array([len(x) for x in found])
        self.errors = np.array([x + [0] * (self.count.max() - len(x)) for x in found], dtype=np.int64)

    def syndrome(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values), dtype=np.int64)
        for p in range(self.bits):
            out ^= ((values >> p) & 1) * self.columns[p]
        return out

    def anchors(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of value, anchor, whether it is the value's home)."""
        syndrome = self.syndrome(values)
        count = self.count[syndrome]
        owner = np.repeat(np.arange(len(values)), count)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        return owner, values[owner] ^ self.errors[syndrome[owner], nth], nth == 0


#: Fields of the fingerprint with their codes. Four differing bits leave at most one in one of three
#: fields, or at most two in one of two. The finer code costs more copies for far smaller groups.
CODES = {
    "coarse": [(0, 22, [15, 7], 0, 1), (22, 21, [15], 6, 1), (43, 21, [15], 6, 1)],
    "fine": [(0, 32, [31], 1, 2), (32, 32, [31], 1, 2)],
}
#: Distinct fingerprints from which the finer code compares less. Both give the same links.
FINE_FROM = 1 << 28


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tie, fp): SimHash of four-word shingles, as a signed 64-bit value; ``tie`` is a hash of the text.

    Words are parted by space and tab to carriage return, A-Z lower-cased; fewer than four words
    form one shingle; no words, an empty or null text: 0.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[np.ndarray] = []
            hashes: list[np.ndarray] = []
            counts: list[int] = []
            held = 0

            def flush() -> None:
                joined = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
                out.append(majority_bits(joined, np.array(counts, dtype=np.int64)))

            # bytes.lower() and bytes.split() know ASCII only: A-Z, and just the six characters named.
            for text in batch.column(1).cast(pa.large_binary()):
                words = (text.as_py() or b"").lower().split()
                if len(words) < SHINGLE_WORDS:
                    shingles, n = ([b" ".join(words)], 1) if words else ([], 0)
                else:
                    shingles = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE_WORDS))))
                    n = len(words) - SHINGLE_WORDS + 1
                hashes.append(np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64, count=n))
                counts.append(n)
                held += n
                if held >= HASHES:
                    flush()
                    hashes, counts, held = [], [], 0
            flush()
            fp = pa.array(np.concatenate(out).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), fp], ["doc_id", "tie", "fp"])

    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    return source.mapInArrow(hashed, "doc_id long, tie long, fp long")


def anchor_rows(distinct: DataFrame, code: str) -> DataFrame:
    """Each fingerprint at every anchor within covering radius plus reach, per field of the code."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [(shift, AnchorCode(parts, free, reach)) for shift, _, parts, free, reach in CODES[code]]
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for start in range(0, len(fp), 4096):
                some = fp[start : start + 4096]
                for number, (shift, field) in enumerate(fields):
                    values = ((some >> np.uint64(shift)) & np.uint64((1 << field.bits) - 1)).astype(np.int64)
                    owner, anchor, home = field.anchors(values)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(anchor | (number << 32)),
                            pa.array(some[owner].view(np.int64)),
                            pa.array(home),
                        ],
                        ["bucket", "fp", "home"],
                    )

    return distinct.select("fp").mapInArrow(placed, ROWS)


def fingerprint_links(distinct: DataFrame, code: str) -> DataFrame:
    """Links (a, b) that connect all fingerprints at most four bits apart, directly or by steps."""
    return links(anchor_rows(distinct, code), MAX_BITS)


def components(docs: DataFrame, id_col: str, text_col: str, code: str | None) -> DataFrame:
    """(doc_id, tie, fp, label, component_id); ``label`` names the component, even where ids repeat."""
    prints = cut_lineage(fingerprints(docs, id_col, text_col))
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    code = code or ("fine" if distinct.count() >= FINE_FROM else "coarse")
    edges = cut_lineage(fingerprint_links(distinct, code).distinct())
    labels = connected_components(edges)
    joined = distinct.join(labels, distinct.fp == labels.node, "left").select(
        "fp", "first_id", F.coalesce("label", "fp").alias("label")
    )
    ids = joined.groupBy("label").agg(F.min("first_id").alias("component_id"))
    named = cut_lineage(joined.join(ids, "label").select("fp", "label", "component_id"))
    return prints.join(named, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", code: str | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document.

    Copies share a fingerprint and are compared as one. ``component_id`` is the smallest id that is
    reached over links of at most four differing bits. The number of distinct fingerprints within
    a few bits of each other is bounded, however many near copies there are.

    Null, empty and wordless texts share the zero fingerprint, which is linked like any other.
    Rows with a null id stay and count for their fingerprint, but never name a component unless
    no other row is reached. Repeated rows appear as often as they come. Other columns are not read.
    """
    found = components(docs, id_col, text_col, code)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", code: str | None = None) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row of the smallest id.

    A null id comes last. Of rows with that id, the one with the smallest hash of its text stays,
    and of equal rows one. All columns of ``docs`` are returned.
    """
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tie")
    first = components(docs, id_col, text_col, code).groupBy("label").agg(F.min(order).alias("first"))
    keys = cut_lineage(first.select(F.col("first.doc_id").alias("_first_id"), F.col("first.tie").alias("_first_tie")))
    whole = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("tie"))
    kept = whole.join(keys, F.col("id").eqNullSafe(F.col("_first_id")) & (F.col("tie") == F.col("_first_tie")), "left_semi")
    return kept.dropDuplicates(["id", "tie"]).select("row.*")
