"""Importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Two bags of hashed words and word pairs are counted: one over a target sample of good documents,
one over all documents. A document's weight is the log ratio of the two models over its n-grams.
Adding Gumbel noise to the weights and taking the k largest draws k documents without
replacement, each step with probability proportional to the ratio.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecast.llm.arrays import SPACE, borders, mix, owners, span_hashes, text_chunks
from rolecast.session import cut_lineage

#: Buckets of the n-gram models.
BUCKETS = 1 << 14
#: Target documents from which the target model is counted at most: those with the smallest hash of their id.
MAX_TARGET = 50_000
#: Bits of the sort key that one pass of the selection settles.
DIGIT = 16


def ngram_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every word and of every pair of neighbouring words."""
    starts, ends = borders(~SPACE[data], offsets)
    doc = owners(starts, offsets)
    words = span_hashes(data, starts, ends)
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    pairs = mix(words[pair] * np.uint64(0x9E3779B97F4A7C15) + words[pair + 1])
    both = np.concatenate((words, pairs)) & np.uint64(BUCKETS - 1)
    return np.concatenate((doc, doc[pair])), both.astype(np.int64)


def target_sample(labels: DataFrame, good: Column, limit: int = MAX_TARGET) -> tuple[np.ndarray, float]:
    """Ids of at most ``limit`` good documents, evenly drawn, and the share of good ones among all labelled."""
    shown = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(good, F.lit(False)).alias("good")).filter("doc_id is not null")
    total = shown.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("good"), 1)).alias("good")).first()
    picked = shown.filter("good").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).toPandas()
    return np.sort(picked["doc_id"].to_numpy(dtype=np.int64)), (total.good / total.n if total.n else 1.0)


def model_counts(source: DataFrame, target: np.ndarray) -> np.ndarray:
    """Counts per bucket: row 0 of the target documents, row 1 of all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = np.zeros(BUCKETS, dtype=np.int64)
        wanted = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            ids = batch.column(0).fill_null(-(1 << 63)).to_numpy()
            chosen = np.isin(ids, target)
            for first, data, offsets in text_chunks(batch.column(1)):
                doc, bucket = ngram_buckets(data, offsets)
                raw += np.bincount(bucket, minlength=BUCKETS)
                wanted += np.bincount(bucket[chosen[first + doc]], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), pa.array(wanted[some]), pa.array(raw[some])], ["bucket", "wanted", "raw"]
        )

    total = (
        source.mapInArrow(count, "bucket long, wanted long, raw long")
        .groupBy("bucket")
        .agg(F.sum("wanted").alias("wanted"), F.sum("raw").alias("raw"))
        .toPandas()
    )
    table = np.zeros((2, BUCKETS))
    table[:, total["bucket"].to_numpy(dtype=np.int64)] = total[["wanted", "raw"]].to_numpy(dtype=np.float64).T
    return table


def log_ratio(counts: np.ndarray) -> np.ndarray:
    """Log of target over raw probability per bucket, each with one count added."""
    smooth = counts + 1.0
    smooth /= smooth.sum(axis=1, keepdims=True)
    return np.log(smooth[0]) - np.log(smooth[1])


def weights(source: DataFrame, ratio: np.ndarray, seed: int) -> DataFrame:
    """(doc_id, n_ngrams, log_weight, sort_key): the noise depends on id, text and seed only."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            noise_seed = mix(batch.column(2).to_numpy().astype(np.int64).view(np.uint64) + np.uint64(seed))
            for first, data, offsets in text_chunks(batch.column(1)):
                n = len(offsets) - 1
                doc, bucket = ngram_buckets(data, offsets)
                weight = np.bincount(doc, weights=ratio[bucket], minlength=n).astype(np.float64)
                uniform = ((noise_seed[first : first + n] >> np.uint64(12)).astype(np.float64) + 0.5) / (1 << 52)
                key = weight - np.log(-np.log(uniform))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, n), pa.array(np.bincount(doc, minlength=n)), pa.array(weight), pa.array(key),
                        pa.array(_ordered(key)), batch.column(2).slice(first, n),
                    ],
                    ["doc_id", "n_ngrams", "log_weight", "noisy_weight", "rank_bits", "tie"],
                )

    return source.mapInArrow(
        weigh, "doc_id long, n_ngrams long, log_weight double, noisy_weight double, rank_bits long, tie long"
    )


def _ordered(values: np.ndarray) -> np.ndarray:
    """Signed integers in the order of the floats."""
    bits = (values + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def kth_largest(rows: DataFrame, column: str, k: int) -> tuple[int, int]:
    """(value, rows above it) of the k-th largest of a long column, k from 1 to the number of rows.

    Each pass settles sixteen bits from a histogram of at most 65,536 bins.
    """
    low, high, above = -(1 << 63), (1 << 63) - 1, 0
    width = 64
    value = F.col(column)
    while width > 0:
        width -= DIGIT
        part = rows.filter(value.between(F.lit(low), F.lit(high)))
        bins = part.groupBy(F.shiftright(column, width).alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()
        for row in sorted(bins, key=lambda r: -r.bin):
            if above + row.n >= k:
                low, high = row.bin << width, ((row.bin + 1) << width) - 1
                break
            above += row.n
    return low, above


def importance_sample(
    docs: DataFrame, labels: DataFrame, good: Column, k: int | None = None, seed: int = 17, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_ngrams, log_weight, noisy_weight, kept): the k documents drawn; ``kept`` is true for each.

    ``good`` tells the target rows of ``labels(doc_id, ...)``; without ``k``, as many documents are
    drawn as that share of all rows. The target model is counted from at most ``MAX_TARGET``
    labelled documents, the raw model and all weights from every document and its whole text.
    With k at least the number of documents all are drawn, with k = 0 none.

    Null and empty texts have no n-grams and the weight 0. Rows with a null id take part. Equal
    rows have equal weights and noise; of rows that tie at the end, those with the smaller
    (id, hash) are drawn, and of equal rows all or, at the very end, as many as are missing.
    Without usable labels both models are flat apart from smoothing, and noise decides.
    """
    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
        F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string")).alias("tie"),
    )
    target, share = target_sample(labels, good)
    ratio = log_ratio(model_counts(source.select("doc_id", "text"), target))
    scored = cut_lineage(weights(source, ratio, seed))
    total = scored.count()
    k = round(share * total) if k is None else k
    shown = [*["doc_id", "n_ngrams", "log_weight", "noisy_weight"], F.lit(True).alias("kept")]
    if k >= total:
        return scored.select(*shown)
    if k <= 0:
        return scored.limit(0).select(*shown)
    edge, above = kth_largest(scored, "rank_bits", k)
    sure = scored.filter(F.col("rank_bits") > edge)
    # Rows equal in weight and noise are, but for chance, copies of one row.
    last = scored.filter(F.col("rank_bits") == edge).orderBy("doc_id", "tie").limit(k - above)
    return sure.unionByName(last).select(*shown)
