"""Packing of token pieces into sequences: shortest pack first over the histogram of lengths."""

from __future__ import annotations

import base64
import heapq
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolecast.session import cut_lineage

SEQUENCE = 2048
#: Id that ends every document.
END_ID = 1
VOCABULARY = "byte_bpe_50k"
SPECIAL = {"<|endoftext|>": 50256}
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long"


@cache
def encoder(vocabulary: str):
    """The byte-level tokenizer of ``vocabulary``; its ranks are the ids of the JSON form."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def shortest_pack_first(histogram: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, tuple[int, ...]]]:
    """(repeats, lengths in order) patterns that use up the histogram.

    Lengths are placed longest first, each into the emptiest pack that has room. Packs that look
    alike are one pattern with a count, so the work follows the number of lengths, not of pieces.
    """
    done: list[tuple[int, tuple[int, ...]]] = []
    free: list[tuple[int, int, int, tuple[int, ...]]] = []
    serial = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if free and -free[0][0] >= length:
                room, _, count, pattern = heapq.heappop(free)
                room = -room
                taken = min(count, left)
                if count > taken:
                    heapq.heappush(free, (-room, serial, count - taken, pattern))
                    serial += 1
            else:
                room, taken, pattern = size, left, ()
            left -= taken
            if room > length:
                heapq.heappush(free, (length - room, serial, taken, (*pattern, length)))
                serial += 1
            else:
                done.append((taken, (*pattern, length)))
    return done + [(count, pattern) for _, _, count, pattern in free]


class Places:
    """Where the pieces of each length go, by their rank within the length."""

    def __init__(self, patterns: list[tuple[int, tuple[int, ...]]]) -> None:
        used: dict[int, int] = {}
        rows = []
        sequence = 0
        for count, lengths in patterns:
            offset = 0
            for length in lengths:
                low = used.get(length, 0)
                rows.append((length, low, sequence, offset))
                used[length] = low + count
                offset += length
            sequence += count
        rows.sort()
        table = np.array(rows, dtype=np.int64).reshape(-1, 4)
        self.key = (table[:, 0] << 48) | table[:, 1]
        self.low, self.sequence, self.offset = table[:, 1], table[:, 2], table[:, 3]

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length << 48) | rank, side="right") - 1
        return self.sequence[at] + rank - self.low[at], self.offset[at]


def token_pieces(docs: DataFrame, size: int, vocabulary: str, id_col: str, text_col: str) -> DataFrame:
    """Pieces of at most ``size`` ids, with the task that made them and their number there among equal lengths."""

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        encode_plain = encoder(vocabulary).encode_ordinary
        marks = list(SPECIAL)
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                ids = encode(text, allowed_special="all") if any(m in text for m in marks) else encode_plain(text)
                ids.append(END_ID)
                raw = np.frombuffer(array("I", ids), dtype=np.uint32).astype("<u4", copy=False)
                for start in range(0, len(raw), size):
                    piece = raw[start : start + size]
                    n = len(piece)
                    nth = seen.get(n, 0)
                    seen[n] = nth + 1
                    rows.append((doc, start, n, zlib.crc32(piece.tobytes()), len(raw), part, nth))
            columns = zip(*rows) if rows else [[]] * 7
            kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64()]
            names = [x.split()[0] for x in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        tokenize, PIECES
    )


def pack(
    docs: DataFrame, size: int = SEQUENCE, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row per piece.

    A document is its ids and the end id. What goes beyond ``size`` ids is cut off in whole
    sequences; the rest goes into packs by length. The histogram has at most ``size`` lengths and
    the patterns follow from it, so what the driver holds does not grow with the documents.

    A null or empty text is the end id alone. Rows with a null or repeated id are documents of
    their own. An empty table gives no pieces. Other columns are not read.
    """
    pieces = cut_lineage(token_pieces(docs, size, vocabulary, id_col, text_col))
    counts = cut_lineage(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = Places(shortest_pack_first(histogram, size))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.find(batch.column(2).to_numpy(), batch.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(
        place,
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )
