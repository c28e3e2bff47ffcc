"""Repeated passages by content-defined chunks.

A rolling gear hash over the last 32 bytes cuts texts where it is lower than at all places nearby,
so a passage is cut alike wherever it stands, whatever was inserted before it. Chunks are known by
their digests; of each digest the first occurrence stays. A passage goes where neighbouring
chunks, long enough together, have all been seen before. Shorter runs are extended byte by byte
along the first occurrence of each of their chunks, and go where the passage turns out long enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecast.llm.arrays import mix, running, text_chunks
from rolecast.session import cut_lineage

#: Bytes in the rolling hash.
WINDOW = 32
#: A cut has the lowest hash of so many places on either side: chunks have twice as many bytes on average.
NEAR = 24
#: A chunk ends here at the latest.
MAX_CHUNK = 256
#: Bytes of neighbouring repeated chunks that make a passage without a look at the bytes around them.
MIN_RUN = 100
#: Bytes of a passage around a shorter run. One of 50 words has more, and nearly always a whole chunk inside.
MIN_PASSAGE = 200
#: Stands for a null id in comparisons.
NO_ID = -(1 << 63)
_HIGHEST = np.uint32(0xFFFFFFFF)
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def cut_points(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Positions after which the texts of a chunk of rows are cut, by what stands close to them only."""
    rolled = _GEAR[data]
    width = 1
    while width < WINDOW:
        longer = rolled.copy()
        longer[width:] += rolled[:-width] << np.uint32(width)
        rolled, width = longer, width * 2
    # The first places of a text have no full window; as NEAR < WINDOW they also part it from the text before.
    edge = (offsets[:-1, None] + np.arange(WINDOW - 1)).ravel()
    rolled[edge[edge < len(rolled)]] = _HIGHEST
    ahead = rolled
    width = 1
    while width < NEAR:
        step = min(width, NEAR - width)
        longer = ahead.copy()
        np.minimum(longer[:-step], ahead[step:], out=longer[:-step])
        ahead, width = longer, width + step
    # ahead[i] is the lowest of NEAR places from i on. A cut is below all on its left, and no higher than any on its right.
    right, left = np.full_like(rolled, _HIGHEST), np.full_like(rolled, _HIGHEST)
    right[:-1] = ahead[1:]
    left[NEAR:] = ahead[:-NEAR]
    return np.flatnonzero((rolled < left) & (rolled <= right) & (rolled < _HIGHEST)) + 1


def chunk_ends(cuts: np.ndarray, start: int, stop: int) -> list[int]:
    """Ends of the chunks of one text; without a cut a chunk ends after MAX_CHUNK bytes."""
    ends = []
    at = start
    inside = cuts[np.searchsorted(cuts, start, side="right") : np.searchsorted(cuts, stop)].tolist()
    if stop > start:
        inside.append(stop)
    for cut in inside:
        while cut - at > MAX_CHUNK:
            at += MAX_CHUNK
            ends.append(at)
        ends.append(cut)
        at = cut
    return ends


def text_chunk_rows(source: DataFrame) -> DataFrame:
    """(digest, row, tie, place) of every chunk of ``source(row, tie, text)``.

    ``place`` holds the start (byte of UTF-8), the length, and whether the text has the chunk before.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for first, data, offsets in text_chunks(batch.column(2)):
                cuts = cut_points(data, offsets)
                raw = data.tobytes()
                count, digests, places = [], [], []
                for k in range(len(offsets) - 1):
                    at = begin = int(offsets[k])
                    found = chunk_ends(cuts, begin, int(offsets[k + 1]))
                    count.append(len(found))
                    before: set[bytes] = set()
                    for end in found:
                        known = digest(raw[at:end])
                        digests.append(known)
                        places.append((at - begin) << 11 | (end - at) << 1 | (known in before))
                        before.add(known)
                        at = end
                of = pa.array(np.repeat(np.arange(len(count)) + first, count))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digests, pa.binary()), batch.column(0).take(of), batch.column(1).take(of), pa.array(places, pa.int64())],
                    ["digest", "row", "tie", "place"],
                )

    return source.select("row", "tie", "text").mapInArrow(chunks, "digest binary, row long, tie long, place long")


def repeated_runs(met: DataFrame, min_run: int) -> DataFrame:
    """(row, tie, start, bytes, firsts, parts): neighbouring chunks of a text that were seen before.

    ``parts`` are the chunks of a run below ``min_run`` bytes, and empty for longer ones.
    """
    # The chunks of one text, however many copies of it there are. Equal rows have equal chunks.
    listed = met.filter("later").groupBy("row", "tie").agg(F.sort_array(F.collect_set(F.struct("place", "first_row", "digest"))).alias("chunks"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, starts, sizes, firsts, parts = [], [], [], [], []
            for k, chunks in enumerate(batch.column(2)):
                for c in chunks.as_py():
                    start, size = c["place"] >> 11, c["place"] >> 1 & 0x3FF
                    if of and of[-1] == k and start == starts[-1] + sizes[-1]:
                        sizes[-1] += size
                        firsts[-1].add(c["first_row"])
                        parts[-1].append(c)
                    else:
                        of.append(k)
                        starts.append(start)
                        sizes.append(size)
                        firsts.append({c["first_row"]})
                        parts.append([c])
            taken = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(taken),
                    batch.column(1).take(taken),
                    pa.array(starts, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array([sorted(f) for f in firsts], pa.list_(pa.int64())),
                    pa.array(
                        [run if size < min_run else [] for run, size in zip(parts, sizes)],
                        pa.list_(pa.struct([("place", pa.int64()), ("first_row", pa.int64()), ("digest", pa.binary())])),
                    ),
                ],
                ["row", "tie", "start", "bytes", "firsts", "parts"],
            )

    return listed.mapInArrow(
        merge,
        "row long, tie long, start long, bytes long, firsts array<bigint>,"
        " parts array<struct<place:bigint,first_row:bigint,digest:binary>>",
    )


def with_context(places: DataFrame, source: DataFrame, width: int) -> DataFrame:
    """``places(row, tie, place, digest, first)`` with at most ``width`` bytes before and after each."""
    wanted = places.groupBy("row", "tie").agg(F.collect_set(F.struct("place", "digest", "first")).alias("places"))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, found, before, after = [], [], [], []
            for k, (text, places) in enumerate(zip(batch.column(2), batch.column(3))):
                raw = text.as_py().encode()
                for p in places.as_py():
                    start = p["place"] >> 11
                    end = start + (p["place"] >> 1 & 0x3FF)
                    of.append(k)
                    found.append(p)
                    before.append(raw[max(0, start - width) : start])
                    after.append(raw[end : end + width])
            taken = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(taken),
                    batch.column(1).take(taken),
                    pa.array([p["place"] for p in found], pa.int64()),
                    pa.array([p["digest"] for p in found], pa.binary()),
                    pa.array([p["first"] for p in found], pa.bool_()),
                    pa.array(before, pa.binary()),
                    pa.array(after, pa.binary()),
                ],
                ["row", "tie", "place", "digest", "first", "before", "after"],
            )

    around = (
        source.select("row", "tie", "text")
        .join(wanted, ["row", "tie"])
        .mapInArrow(cut_out, "row long, tie long, place long, digest binary, first boolean, before binary, after binary")
    )
    # Equal rows cut out the same.
    return around.dropDuplicates(["row", "tie", "place"])


def common_start(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def extended(met: DataFrame, parts: DataFrame, source: DataFrame, min_bytes: int) -> DataFrame:
    """(row, tie, start, bytes, firsts): passages around ``parts(row, tie, place, digest, first_row)``, by the bytes they share
    with the first occurrence of the chunk."""
    asked = parts.select("digest").distinct()
    # Rows of one id may both be first; the least text stands for them.
    firsts = (
        met.filter("first")
        .join(asked, "digest", "left_semi")
        .groupBy("digest")
        .agg(F.min(F.struct("tie", "place", "row")).alias("least"))
        .select("least.row", "least.tie", "least.place", "digest", F.lit(True).alias("first"))
    )
    own = parts.select("row", "tie", "place", "digest", F.lit(False).alias("first"))
    around = cut_lineage(with_context(own.unionByName(firsts), source, min_bytes))
    model = around.filter("first").select("digest", F.col("row").alias("first_row"), F.col("before").alias("b"), F.col("after").alias("a"))
    pairs = around.filter("not first").select("digest", "row", "tie", "place", "before", "after").join(model, "digest")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, row, tie, place, before, after, first, b, a = batch.columns
            starts, sizes = [], []
            for at, *sides in zip(*[c.to_pylist() for c in (place, before, after, b, a)]):
                left = common_start(sides[0][::-1], sides[2][::-1])
                starts.append((at >> 11) - left)
                sizes.append(left + (at >> 1 & 0x3FF) + common_start(sides[1], sides[3]))
            yield pa.RecordBatch.from_arrays(
                [row, tie, pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), first], ["row", "tie", "start", "bytes", "first_row"]
            )

    long_enough = pairs.mapInArrow(measure, "row long, tie long, start long, bytes long, first_row long").filter(F.col("bytes") >= min_bytes)
    return long_enough.select("row", "tie", "start", "bytes", F.array("first_row").alias("firsts"))


def passages(chunks: DataFrame, source: DataFrame, min_run: int, min_bytes: int) -> DataFrame:
    """(row, tie, cut, first_docs): each text's repeated passages, by start."""
    # Sums per digest before the shuffle; no group of copies is gathered.
    seen = chunks.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first_row")).filter("n > 1")
    again = F.col("place").bitwiseAND(1) == 1
    later = (F.col("row") > F.col("first_row")) | again
    met = cut_lineage(chunks.join(seen.select("digest", "first_row"), "digest").withColumns({"later": later, "first": ~later}))
    runs = cut_lineage(repeated_runs(met, min_run))
    span = ["row", "tie", "start", "bytes", "firsts"]
    parts = runs.select("row", "tie", F.inline("parts"))
    found = runs.filter(F.size("parts") == 0).select(*span).unionByName(extended(met, parts, source, min_bytes))
    # The passages of one text.
    return found.groupBy("row", "tie").agg(
        F.sort_array(F.collect_set(F.struct("start", "bytes"))).alias("cut"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("firsts")))).alias("first_docs"),
    )


def without_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans as code points) from (doc_id, text, spans as bytes)."""
    for batch in batches:
        texts, spans = [], []
        for text, cut in zip(batch.column(1), batch.column(2)):
            raw = (text.as_py() or "").encode()
            letters = running((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)
            kept, at, found = [], 0, []
            joined: list[list[int]] = []
            for span in cut.as_py():
                # Passages that overlap or touch are cut as one.
                if joined and span["start"] <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], span["start"] + span["bytes"])
                else:
                    joined.append([span["start"], span["start"] + span["bytes"]])
            for start, stop in joined:
                # A cut inside a character moves to its border, so that all of it stays.
                while start < len(raw) and raw[start] & 0xC0 == 0x80:
                    start += 1
                while stop < len(raw) and raw[stop] & 0xC0 == 0x80:
                    stop -= 1
                kept.append(raw[at:start])
                at = stop
                found.append({"start": int(letters[start]), "end": int(letters[stop])})
            kept.append(raw[at:])
            texts.append(b"".join(kept).decode())
            spans.append(found)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(texts), pa.array(spans, kind), batch.column(3)], ["doc_id", "text", "spans", "first_docs"]
        )


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = MIN_RUN, min_bytes: int = MIN_PASSAGE
) -> DataFrame:
    """(doc_id, text, spans, first_docs) of each document that repeats a passage.

    ``spans`` are the repeated passages in code points, ``text`` is the document without them, and
    ``first_docs`` are the documents where they stand first. All other documents stay as they are
    and are not listed. First is the smallest (id, place), so one copy of every chunk is kept.
    Whole chunks of ``min_run`` bytes make a passage; so does any chunk that agrees with its first
    occurrence over ``min_bytes`` bytes, itself included.

    Null and empty texts have no chunks. A null id comes before all others and is listed as null.
    Rows of one id are one source: a passage that only they share is not removed from them, and
    equal rows are treated alike. Other columns are not read.
    """
    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("row"),
        F.xxhash64(F.col(text_col).cast("string")).alias("tie"),
        F.col(text_col).cast("string").alias("text"),
    )
    found = cut_lineage(passages(text_chunk_rows(source), source, min_run, min_bytes))
    named = F.transform("first_docs", lambda d: F.when(d != NO_ID, d))
    return (
        source.join(found, ["row", "tie"])
        .select("doc_id", "text", "cut", named.alias("first_docs"))
        .mapInArrow(
            without_spans,
            "doc_id long, text string, spans array<struct<start:bigint,end:bigint>>, first_docs array<bigint>",
        )
    )
