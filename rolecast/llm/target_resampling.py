"""Resampling towards a target distribution, with an exact cutoff found by a quantile sketch.

Words, or runs of words, are counted per bucket over the corpus and over the target texts. The log
ratio of the two is one array of gains; a document's weight is the mean gain of its features. Gumbel
noise makes the highest scores a draw without replacement. A sketch of the scores brackets the
cutoff, exact counts of the rows outside prove the bracket or widen it, and only the rows inside
are sorted.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecast.llm.arrays import borders, owners, running, text_chunks
from rolecast.plans.numbering import numbered
from rolecast.session import cut_lineage

#: Buckets of the feature counts.
BUCKETS = 10_000
#: Longest run of words that is one feature.
MAX_RUN = 1
#: Share of the documents that is drawn, in percent, and the words that a document needs to take part.
PERCENT = 10
MIN_WORDS = 20
SEED = 2024
#: Half width of the first bracket, as a share of the rows, and the resolution of the sketch.
BRACKET = 0.002
SKETCH = 10_000
#: Words of more bytes are hashed one by one, shorter ones position by position for all words at once.
LONG_WORD = 48

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: Bytes of words: digits, lower-cased letters and all bytes of characters beyond ASCII.
_WORD = np.zeros(256, dtype=bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


def _crc_table() -> np.ndarray:
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> 1) ^ np.uint32(0xEDB88320), value >> 1).astype(np.uint32)
    return value


_CRC = _crc_table()


def crc32_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of each byte span."""
    lengths = ends - starts
    out = np.empty(len(starts), dtype=np.uint32)
    for k in np.flatnonzero(lengths > LONG_WORD):
        out[k] = zlib.crc32(data[starts[k] : ends[k]])
    short = np.flatnonzero(lengths <= LONG_WORD)
    # Longest first: the spans that still have a byte at some position are a leading slice.
    short = short[np.argsort(-lengths[short], kind="stable")]
    at, left = starts[short], -lengths[short]
    value = np.full(len(short), 0xFFFFFFFF, dtype=np.uint32)
    for k in range(LONG_WORD):
        n = int(np.searchsorted(left, -k, side="left"))
        if not n:
            break
        value[:n] = _CRC[(value[:n] ^ data[at[:n] + k]) & 0xFF] ^ (value[:n] >> np.uint32(8))
    out[short] = ~value
    return out


def feature_buckets(data: np.ndarray, offsets: np.ndarray, max_run: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document of each feature, its bucket, words per document)."""
    data = _LOWER[data]
    starts, ends = borders(_WORD[data], offsets)
    doc = owners(starts, offsets)
    n_words = np.bincount(doc, minlength=len(offsets) - 1)
    if max_run == 1:
        return doc, (crc32_spans(data, starts, ends) % buckets).astype(np.int64), n_words
    # Words follow each other with one space between, so that each run is one span.
    kept = _WORD[data]
    after = ends[ends < len(data)]
    after = after[~_WORD[data[after]]]
    data[after] = 0x20
    kept[after] = True
    place = running(kept)
    joined, starts, ends = data[kept], place[starts], place[ends]
    docs, hashes = [], []
    for run in range(1, max_run + 1):
        first = np.flatnonzero(doc[run - 1 :] == doc[: len(doc) - run + 1])
        docs.append(doc[first])
        hashes.append(crc32_spans(joined, starts[first], ends[first + run - 1]))
    return np.concatenate(docs), (np.concatenate(hashes) % buckets).astype(np.int64), n_words


def bucket_counts(texts: DataFrame, max_run: int, buckets: int) -> np.ndarray:
    """Features per bucket over the only column of ``texts``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, data, offsets in text_chunks(batch.column(0)):
                total += np.bincount(feature_buckets(data, offsets, max_run, buckets)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    found = texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(buckets, dtype=np.int64)
    counts[found["bucket"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.int64)
    return counts


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket: thousandths of the log of target over own probability, each with one count added, rounded down."""
    n, all_own, all_target = len(own), int(own.sum()), int(target.sum())
    ratios = ((int(t) + 1) * (all_own + n) / ((int(s) + 1) * (all_target + n)) for s, t in zip(own, target))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], dtype=np.int64)


def weights(source: DataFrame, gain: np.ndarray, max_run: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of ``source(doc_id, text)``."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in text_chunks(batch.column(1)):
                n = len(offsets) - 1
                doc, bucket, n_words = feature_buckets(data, offsets, max_run, len(gain))
                n_features = np.bincount(doc, minlength=n)
                # Sums of whole numbers below 2^53 are exact in doubles.
                total = np.bincount(doc, weights=gain[bucket], minlength=n).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), pa.array(n_words), pa.array(n_features), pa.array(total // np.maximum(n_features, 1))],
                    ["doc_id", "n_words", "n_features", "weight"],
                )

    return source.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """Thousandths of standard Gumbel noise that depends on id and seed only, rounded down."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256), 1, 8)
    uniform = (F.conv(head, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000) * F.log(-F.log(uniform))).cast("long")


def cutoff(rows: DataFrame, order: list[Column], percent: int, bracket: float = BRACKET) -> tuple[int, int, int]:
    """(k, score of the k-th row of ``rows(score, ...)`` in ``order``, rows above that score); k is ``percent`` of the rows, rounded down.

    ``order`` begins with the score, falling. Without a k-th row: (0, 0, 0).
    """
    share = 1 - percent / 100
    seen = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx("score", F.array(*[F.lit(min(max(share + d, 0.0), 1.0)) for d in (-bracket, bracket)]), SKETCH).alias("edges"),
        F.min("score").alias("low"), F.max("score").alias("high"),
    ).first()
    k = percent * seen.n // 100
    if not k:
        return 0, 0, 0
    low, high = seen.edges
    value = F.col("score")
    while True:
        outside = rows.agg(F.count(F.when(value > high, 1)).alias("above"), F.count(F.when(value < low, 1)).alias("below")).first()
        if outside.above < k <= seen.n - outside.below:
            break
        # The sketch was off: widen on the side that has the row, in the end as far as the rows go.
        width = max(2 * (high - low), 1)
        low, high = (low, min(high + width, seen.high)) if outside.above >= k else (max(low - width, seen.low), high)
    place = k - outside.above
    inside = numbered(rows.filter(value.between(low, high)), order, "place")
    edge = inside.filter(F.col("place") == place).first().score
    above = outside.above + rows.filter((value > edge) & (value <= high)).count()
    return k, edge, above


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, max_run: int = MAX_RUN,
    buckets: int = BUCKETS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row; ``rank`` is null where it is not drawn.

    Of the documents with at least ``min_words`` words, ``percent`` of a hundred are drawn, rounded
    down: those with the highest scores, at equal scores those with the smaller id.

    Null and empty texts have no features and the weight 0. Rows with a null id take part, with the
    noise of the id ``null``, and come after all ids at equal scores. Repeated rows count one by one;
    of rows that agree in score and id at the very end, as many are drawn as are missing. Without
    target texts the target is flat. Other columns are not read.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    own = bucket_counts(source.select("text"), max_run, buckets)
    wanted = bucket_counts(target.select(F.col(target_col).cast("string").alias("text")), max_run, buckets)
    weighed = weights(source, gains(own, wanted), max_run)
    scored = cut_lineage(
        weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)).withColumn("row", F.monotonically_increasing_id())
    )
    able = scored.filter(F.col("n_words") >= min_words)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    k, edge, _ = cutoff(able.select("score", "doc_id", "row"), order, percent)
    shown = ["doc_id", "n_features", "weight", "score"]
    nobody = F.lit(None).cast("long")
    if not k:
        return scored.select(*shown, nobody.alias("rank"))
    near = (F.col("n_words") >= min_words) & (F.col("score") >= edge)
    placed = numbered(scored.filter(near), order, "place")
    drawn = placed.select(*shown, F.when(F.col("place") <= k, F.col("place")).cast("long").alias("rank"))
    return drawn.unionByName(scored.filter(~near).select(*shown, nobody.alias("rank")))
