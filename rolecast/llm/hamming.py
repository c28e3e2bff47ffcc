"""Links between 64-bit fingerprints that differ in few bits, without listing all pairs of a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one bucket that one task compares with another such block.
BLOCK_ROWS = 8192
#: Cells of one comparison held at once.
CELLS = 1 << 21
ROWS = "bucket long, fp long, home boolean"


def spanning_links(home: np.ndarray, every: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): each linked fingerprint b with the smallest one, a, that links between ``home`` and ``every`` lead to.

    Both sides hold distinct unsigned fingerprints; a value may stand in both. Stars instead of the
    links themselves keep the graph of all buckets shallow.
    """
    step = max(1, CELLS // max(1, len(every)))
    nodes = np.unique(np.concatenate((home, every)))
    label = np.arange(len(nodes))
    at_every = np.searchsorted(nodes, every)
    for k in range(0, len(home), step):
        part = home[k : k + step]
        i, j = np.nonzero(np.bitwise_count(part[:, None] ^ every[None, :]) <= max_bits)
        a, b = label[np.searchsorted(nodes, part[i])], label[at_every[j]]
        while (a != b).any():
            # Hang each larger label below the smallest one it meets, then follow labels to the end.
            parent = np.arange(len(nodes))
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            while (parent[parent] != parent).any():
                parent = parent[parent]
            label, a, b = parent[label], parent[a], parent[b]
    linked = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[linked]], nodes[linked]


class Seen:
    """Sets joined so far in one task, so that a link found again in another bucket is not repeated."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def blocks_of(rows: DataFrame, block_rows: int) -> DataFrame:
    """``rows(bucket, fp, home)`` with large buckets cut into blocks.

    Home rows of a bucket lie in stripes, all rows in columns; each (stripe, column) is a key of
    its own, so that a bucket of any size is shared by many tasks and no pair is lost.
    """
    sizes = (
        rows.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > block_rows)
        .select("bucket", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"))
    )
    placed = rows.join(sizes, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    spread = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    homes = placed.filter("home").select("bucket", block.alias("stripe"), spread.alias("column"), "fp", "home")
    others = placed.select("bucket", spread.alias("stripe"), block.alias("column"), "fp", F.lit(False).alias("home"))
    return homes.unionByName(others)


def links(rows: DataFrame, max_bits: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b) fingerprints whose links connect all ``rows(bucket, fp, home)`` that are close within a bucket.

    Close: at most ``max_bits`` differing bits, at least one of the two being at home in the bucket.
    A task holds two blocks of at most about ``block_rows`` rows, and the linked fingerprints it has met.
    """
    keys = ["bucket", "stripe", "column"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        held: list[tuple] = []

        def settle(parts: list[tuple]) -> tuple[list, list]:
            fp = np.concatenate([p[0] for p in parts])
            home = np.concatenate([p[1] for p in parts])
            a, b = spanning_links(np.unique(fp[home]), np.unique(fp[~home]), max_bits)
            pairs = [(x, y) for x, y in zip(a.tolist(), b.tolist()) if seen.join(x, y)]
            return [p[0] for p in pairs], [p[1] for p in pairs]

        def emit(a: list, b: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (a, b)], ["a", "b"]
            )

        current = None
        for batch in batches:
            key = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)], axis=1)
            fp = batch.column(3).to_numpy().view(np.uint64)
            home = batch.column(4).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            out_a, out_b = [], []
            for start, stop in zip([0, *cut], [*cut, len(fp)]):
                if stop == start:
                    continue
                this = tuple(key[start])
                if held and this != current:
                    a, b = settle(held)
                    out_a += a
                    out_b += b
                    held = []
                current = this
                held.append((fp[start:stop], home[start:stop]))
            yield emit(out_a, out_b)
        if held:
            yield emit(*settle(held))

    blocks = blocks_of(rows, block_rows).select(*keys, "fp", "home")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(compare, "a long, b long")
