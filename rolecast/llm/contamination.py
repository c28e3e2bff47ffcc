"""Benchmark contamination by spaced seeds.

A seed is a mask over neighbouring words; its hash takes in the words under the ones and ignores
those under the zeros, so a replaced word there does not hide a match. Test items and documents
are hashed at every place under every mask, joined on the hash, and each hit is extended along its
diagonal as long as enough words agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecast.llm.arrays import borders, mix, owners, span_hashes, text_chunks
from rolecast.session import cut_lineage

#: Words under a one count, words under a zero may differ. Wherever up to a fifth of 13 or more words
#: differ, one of these hits: 13 to 25 words by enumeration, and of more some part is such a stretch.
MASKS = ("11101011", "10011111", "11001000111", "101000100111")
#: An overlap has at least so many words, or the whole of a shorter item, ...
MIN_WORDS = 13
#: ... of which this share agrees in place.
#: Stands for a null id in comparisons.
NO_ID = -(1 << 63)
#: Hits of a document that one row holds, with the texts of their items.
HITS = 256
MIN_SHARE = 0.8
#: Shorter items are too common to be told from chance.
MIN_ITEM_WORDS = 5
#: Bits of the table that keeps most documents' hashes from the join: 8 MB, however large the benchmark.
FILTER_BITS = 26
#: Short items are taken in so many parts, of which as many as words may differ are left out.
PARTS = 5
#: Word characters: ASCII letters and digits, and all beyond ASCII.
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
SEEDS = "id long, seed long, place int, size int"


def words_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, word hashes, row of each word, words per row) of lower-cased texts."""
    column = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    for first, data, offsets in text_chunks(column):
        starts, ends = borders(_WORD[data], offsets)
        row = owners(starts, offsets)
        yield first, span_hashes(data, starts, ends), row, np.bincount(row, minlength=len(offsets) - 1)


def seed_hashes(words: np.ndarray, row: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the mask at every place where its whole span lies in one text."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    total = np.full(n, int(mask, 2), dtype=np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            total = total * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
    place = np.flatnonzero(row[:n] == row[len(mask) - 1 :])
    return place, mix(total[place])


def short_masks(size: int, replaced: bool) -> list[tuple[int, str]]:
    """(place, mask) of the seeds of an item of ``size`` words: one solid seed, or those that hit whichever fifth differs."""
    if not replaced:
        return [(0, "1" * size)]
    at = [round(size * k / PARTS) for k in range(PARTS + 1)]
    found = []
    for out in combinations(range(PARTS), size // PARTS):
        mask = "".join(("0" if k in out else "1") * (at[k + 1] - at[k]) for k in range(PARTS))
        found.append((mask.index("1"), mask.strip("0")))
    return found


def item_seeds(items: DataFrame, masks: tuple[str, ...], sizes: range, replaced: bool) -> DataFrame:
    """Seeds of the test items. Items of ``sizes`` words have seeds of their own too."""

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, words, row, counts in words_of(batch.column(1)):
                begin = np.cumsum(counts) - counts
                for mask in masks:
                    place, seed = seed_hashes(words, row, mask)
                    yield _seed_rows(ids, first + row[place], seed, place - begin[row[place]], 0)
                for size in sizes:
                    for at, mask in short_masks(size, replaced):
                        place, seed = seed_hashes(words, row, mask)
                        within = place - begin[row[place]]
                        short = (counts[row[place]] == size) & (within == at)
                        yield _seed_rows(ids, first + row[place[short]], seed[short], within[short], size)

    return items.mapInArrow(seeds, SEEDS)


def _seed_rows(ids: pa.Array, rows: np.ndarray, seed: np.ndarray, place: np.ndarray, size: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            ids.take(pa.array(rows)), pa.array(seed.view(np.int64)), pa.array(place.astype(np.int32)),
            pa.array(np.full(len(rows), size, dtype=np.int32)),
        ],
        ["id", "seed", "place", "size"],
    )


def seed_filter(seeds: DataFrame) -> np.ndarray:
    """A bit per hash slot; at most 2 ** (FILTER_BITS - 6) words reach the driver, whatever the benchmark's size."""
    words = (
        seeds.select(F.shiftrightunsigned("seed", 64 - FILTER_BITS).alias("slot"))
        .select(F.shiftright("slot", 6).alias("word"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .toPandas()
    )
    table = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    table[words["word"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64)
    return np.unpackbits(table.astype("<i8").view(np.uint8), bitorder="little").astype(bool)


def document_seeds(source: DataFrame, masks: tuple[str, ...], present: np.ndarray) -> DataFrame:
    """(row, tie, seed, place) of those seeds of ``source(row, tie, text)`` that may be a test item's."""
    packed = source.sparkSession.sparkContext.broadcast(np.packbits(present))

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(packed.value).view(bool)
        for batch in batches:
            for first, words, row, counts in words_of(batch.column(2)):
                begin = np.cumsum(counts) - counts
                for mask in masks:
                    place, seed = seed_hashes(words, row, mask)
                    hit = table[seed >> np.uint64(64 - FILTER_BITS)]
                    place, seed = place[hit], seed[hit]
                    if len(place):
                        of = pa.array(first + row[place])
                        yield pa.RecordBatch.from_arrays(
                            [
                                batch.column(0).take(of), batch.column(1).take(of), pa.array(seed.view(np.int64)),
                                pa.array((place - begin[row[place]]).astype(np.int32)),
                            ],
                            ["row", "tie", "seed", "place"],
                        )

    return source.mapInArrow(seeds, "row long, tie long, seed long, place int")


def best_overlap(same: np.ndarray, at: int, share: float) -> tuple[int, int]:
    """The longest stretch around ``at`` in which at least ``share`` of the words agree."""
    # In whole numbers, so that a share met exactly counts.
    gain = np.concatenate(([0], np.cumsum(np.where(same, 1000 - round(share * 1000), -round(share * 1000)))))
    low = gain[: at + 1]
    high = np.maximum.accumulate(gain[at + 1 :][::-1])[::-1]
    # high falls from left to right: for each start, the last end that is not below it.
    reach = np.searchsorted(-high, -low, side="right") - 1
    length = np.where(reach >= 0, reach + at + 1 - np.arange(at + 1), 0)
    start = int(np.argmax(length))
    return start, start + int(length[start])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, tie, text): a row is known by its id and the hash of its text, one without an id as well."""
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("row"),
        F.xxhash64(F.col(text_col).cast("string")).alias("tie"),
        F.col(text_col).cast("string").alias("text"),
    )


def _found(source: DataFrame, tests: DataFrame, masks: tuple[str, ...], min_words: int, min_share: float, replaced_in_short: bool) -> DataFrame:
    """(row, tie, item_id, doc_word, item_word, n_words, n_same) of ``source(row, tie, text)`` and ``tests(id, text)``."""
    sizes = range(MIN_ITEM_WORDS, min_words if replaced_in_short else min(map(len, masks)))
    seeds = cut_lineage(item_seeds(tests, masks, sizes, replaced_in_short))
    short = sorted(r.size for r in seeds.filter("size > 0").select("size").distinct().collect())
    # A mask that two sizes share is hashed once.
    used = dict.fromkeys([*masks, *(mask for n in short for _, mask in short_masks(n, replaced_in_short))])
    found = document_seeds(source, tuple(used), seed_filter(seeds))
    hits = cut_lineage(
        found.join(seeds.select("id", "seed", F.col("place").alias("item_place")), "seed")
        .groupBy("row", "tie", "id", (F.col("place") - F.col("item_place")).alias("diagonal"))
        .agg(F.sort_array(F.collect_set("item_place")).alias("places"))
    )
    # A phrase may stand in any number of items: a document with many hits is worked on in several parts.
    many = (
        hits.groupBy("row", "tie").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HITS)
        .select("row", "tie", F.ceil(F.col("n") / HITS).cast("int").alias("parts"))
    )
    part = F.pmod(F.xxhash64("id", "diagonal"), F.coalesce("parts", F.lit(1))).cast("int")
    listed = cut_lineage(
        hits.join(many, ["row", "tie"], "left")
        .join(tests.select("id", F.col("text").alias("item_text")), "id")
        .groupBy("row", "tie", part.alias("part"))
        .agg(F.collect_list(F.struct("id", "diagonal", "places", "item_text")).alias("hits"))
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, tie, text, hits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                (_, words, _, _), = words_of(pa.array([text.as_py()], pa.large_string()))
                known: dict[str, np.ndarray] = {}
                for hit in hits.as_py():
                    if hit["item_text"] not in known:
                        known[hit["item_text"]] = next(words_of(pa.array([hit["item_text"]], pa.large_string())))[1]
                    item = known[hit["item_text"]]
                    low = max(0, -hit["diagonal"])
                    high = min(len(item), len(words) - hit["diagonal"])
                    same = item[low:high] == words[low + hit["diagonal"] : high + hit["diagonal"]]
                    done = -1
                    for at in hit["places"]:
                        if not low <= at < high or at < done:
                            continue
                        start, stop = best_overlap(same, at - low, min_share)
                        if stop - start >= min(min_words, len(item)):
                            out.append((doc, tie, hit["id"], start + low + hit["diagonal"], start + low, stop - start, int(same[start:stop].sum())))
                            done = stop + low
            columns = zip(*out) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), pa.int64()) for c in columns], ["row", "tie", "item_id", "doc_word", "item_word", "n_words", "n_same"]
            )

    return (
        source.join(listed, ["row", "tie"])
        .select("row", "tie", "text", "hits")
        .mapInArrow(verify, "row long, tie long, item_id long, doc_word long, item_word long, n_words long, n_same long")
        .distinct()
    )


def _tests(items: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    """One row per different (id, text); those without an id have one number in common, with texts of their own."""
    named = items.select(F.coalesce(F.col(item_col).cast("long"), F.lit(NO_ID)).alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    return named.filter("text is not null").distinct().withColumn("id", F.xxhash64("item_id", "text"))


def overlaps(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", masks: tuple[str, ...] = MASKS, min_words: int = MIN_WORDS, min_share: float = MIN_SHARE,
    replaced_in_short: bool = True,
) -> DataFrame:
    """(doc_id, item_id, doc_word, item_word, n_words, n_same): overlaps of documents with test items.

    Words are lower-cased runs of letters and digits. Each row is a stretch on one diagonal, from
    word ``doc_word`` of the document and ``item_word`` of the item: at least ``min_words`` words
    (or all of a shorter item) of which ``min_share`` agree in place. Items of under five words,
    null and empty texts give nothing. Documents and items without an id are looked at like others;
    the id is null in their rows. Repeated rows give repeated overlaps once. Other columns are not
    read. Without ``replaced_in_short`` items under the shortest mask are found whole only.
    """
    tests = _tests(items, item_col, item_text_col)
    found = _found(_keyed(docs, id_col, text_col), tests.select("id", "text"), masks, min_words, min_share, replaced_in_short)
    named = found.withColumnRenamed("item_id", "id").join(tests.select("id", "item_id"), "id")

    def shown(column: str) -> Column:
        return F.nullif(F.col(column), F.lit(NO_ID))

    return named.select(shown("row").alias("doc_id"), shown("item_id").alias("item_id"), "doc_word", "item_word", "n_words", "n_same").distinct()


def without_overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text overlaps with no test item.

    A row goes by its own text: one that shares its id, or the lack of one, with it stays.
    """
    tests = _tests(items, "item_id", "text")
    found = _found(_keyed(docs, id_col, text_col), tests.select("id", "text"), MASKS, MIN_WORDS, MIN_SHARE, True)
    gone = cut_lineage(found.select(F.col("row").alias("_row"), F.col("tie").alias("_tie")).distinct())
    same = (F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)) == F.col("_row")) & (F.xxhash64(docs[text_col].cast("string")) == F.col("_tie"))
    return docs.join(gone, same, "left_anti")
