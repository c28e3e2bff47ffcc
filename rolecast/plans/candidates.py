"""Exact candidate generation for a set-similarity threshold.

Two sets with Jaccard similarity of at least t share an element among the first
``n - ceil(t n) + 1`` of each, under any common order of elements. Taking common
elements last keeps the shared buckets small: text repeated across most postings
stays out of the prefixes. How common an element is need not be known exactly for
that, so elements are counted by cells of their hash; an element cannot be more
common than its cell. The order is by cells that stand out, then by hash, so a
set's prefix is found within its row: sets are neither exploded nor shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecast.session import cut_lineage

CELL_BITS = 20
#: Cells with more than this many times the mean are in the order of elements.
STANDS_OUT = 2
SIGNATURE_BITS = 2048
#: Bits of the table that sifts the sets to be fetched.
FETCH_BITS = 22


def element_order(sets: DataFrame, elements: str, known: DataFrame | None = None) -> np.ndarray:
    """How common the elements of each cell are, 0 unless the cell stands out: a table of fixed size.

    ``known(bucket)`` holds further elements, so that those common there come last as well.
    """
    values = sets.select(F.explode(elements).alias("bucket"))
    if known is not None:
        values = values.unionByName(known.select("bucket"))
    cell = F.shiftrightunsigned("bucket", 64 - CELL_BITS).cast("int").alias("cell")
    counts = values.groupBy(cell).agg(F.count(F.lit(1)).alias("n"))
    # At most 2^20 numbers, summed by Spark. Written first: the tasks' own sums are larger than many tables.
    rows = cut_lineage(counts).toArrow()
    order = np.zeros(1 << CELL_BITS, dtype=np.int64)
    order[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    order[order <= max(1.0, STANDS_OUT * order.sum() / len(order))] = 0
    return np.minimum(order, (1 << 31) - 1)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and sizes of lists of 64-bit numbers."""
    offsets = column.offsets.to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(offsets)


def prefixes(
    sets: DataFrame, node: str, block: str, elements: str, order: np.ndarray, numerator: int, denominator: int
) -> DataFrame:
    """(node, block, bucket, n, pos): the prefix of each set of sorted 64-bit ``elements``.

    ``n`` is the size of the set and ``pos`` the place of the element in it.
    """
    shared = sets.sparkSession.sparkContext.broadcast(order)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, n = _lists(batch.column(2))
            own = np.repeat(np.arange(len(n)), n)
            common = shared.value[(values.view(np.uint64) >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
            # Within a set the values are sorted already, and a stable sort leaves them so.
            placed = np.argsort((own << 31) | common, kind="stable")
            pos = np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)
            size = np.where(n > 0, n - -(-n * numerator // denominator) + 1, 0)
            first = pos < np.repeat(size, n)
            row = pa.array(own[first])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(row), batch.column(1).take(row), pa.array(values[placed[first]]),
                 pa.array(n[own[first]].astype(np.int32)), pa.array(pos[first].astype(np.int32))],
                names=["node", "block", "bucket", "n", "pos"],
            )

    found = sets.select(node, block, elements).mapInArrow(
        take, f"node {sets.schema[node].dataType.simpleString()}, block string, bucket bigint, n int, pos int"
    )
    return found.withColumnsRenamed({"node": node, "block": block})


def may_reach(numerator: Column, denominator: Column) -> Column:
    """Whether two sets that share an element, at ``pos_a`` of ``n_a`` and ``pos_b`` of ``n_b``, may reach the threshold."""
    before = F.least("pos_a", "pos_b")
    after = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
    return (before + after).cast("bigint") * (numerator + denominator) >= (F.col("n_a") + F.col("n_b")).cast("bigint") * numerator


def with_signature(sets: DataFrame, elements: str, name: str) -> DataFrame:
    """``sets`` with a column of 2048 bits: per cell, whether an odd number of the set's elements fall into it.

    Two signatures differ in no more bits than the sets differ in elements.
    """
    columns = sets.columns
    at = columns.index(elements)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, n = _lists(batch.column(at))
            bit = (values.view(np.uint64) % np.uint64(SIGNATURE_BITS)).astype(np.int64)
            out = []
            # Some rows at a time, so that the counters stay small.
            ends = np.concatenate(([0], np.cumsum(n)))
            for low in range(0, len(n), 1024):
                high = min(low + 1024, len(n))
                own = np.repeat(np.arange(high - low), n[low:high])
                odd = np.bincount(own * SIGNATURE_BITS + bit[ends[low] : ends[high]], minlength=(high - low) * SIGNATURE_BITS) & 1
                out.append(np.packbits(odd.astype(bool), bitorder="little").view(np.int64))
            words = np.concatenate(out) if out else np.zeros(0, dtype=np.int64)
            width = SIGNATURE_BITS // 64
            lists = pa.ListArray.from_arrays(np.arange(0, len(words) + 1, width, dtype=np.int32), pa.array(words))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*columns, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sets.schema.fields)
    return sets.mapInArrow(sign, f"{fields}, `{name}` array<bigint>")


def differing_bits(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, bits: total + bits)


def fetched(sets: DataFrame, node: str, wanted: DataFrame) -> DataFrame:
    """The rows of ``sets`` whose ``node`` is in ``wanted``; of the others hardly any is shuffled.

    A bit table of fixed size sifts the sets where they are read, and the join goes over what is left.
    """
    bit = F.shiftrightunsigned(F.xxhash64(node), 64 - FETCH_BITS).cast("int")
    # At most 2^22 numbers.
    found = wanted.select(bit.alias("bit")).distinct().toArrow()["bit"].to_numpy()
    table = np.zeros(1 << FETCH_BITS, dtype=bool)
    table[found] = True
    shared = sets.sparkSession.sparkContext.broadcast(np.packbits(table, bitorder="little"))
    columns = sets.columns

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(len(columns)).to_numpy()
            kept = (shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            yield batch.select(columns).filter(pa.array(kept.astype(bool)))

    left = sets.withColumn("_bit", bit).mapInArrow(sift, sets.schema)
    return left.join(wanted.select(node).distinct(), node, "left_semi")
