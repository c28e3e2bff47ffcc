"""Quality rules from repeats inside a text, found with suffix arrays.

The suffixes of a text start at its words. Suffixes whose first eight words do not recur in the
text cannot open a long repeat, so only the others are sorted further, by doubling. Neighbours in
suffix order give the longest common prefixes; a suffix's largest one bounds the longest repeat
that starts there, and these spans together cover every maximal repeated substring.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecast.llm.arrays import SPACE, borders, mix, owners, running, runs_of, span_hashes, text_chunks

#: Words of the shortest repeat that counts.
WINDOW = 8
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, longest_repeat long, repeat_chars long"
)


def longest_repeats(words: np.ndarray, doc: np.ndarray, ends: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Per word: words of the longest repeat of its text that starts there, 0 if under ``window``.

    ``words`` are hashes, ``doc`` their texts, ``ends`` the position after each word's text.
    """
    n = len(words)
    longest = np.zeros(n, dtype=np.int64)
    if n < window:
        return longest
    position = np.arange(n)
    fits = position + window <= ends
    keys = np.zeros(n, dtype=np.uint64)
    keys[: n - window + 1] = runs_of(words, window)
    keys = mix(keys ^ mix(doc.astype(np.uint64) + np.uint64(1)))
    # A suffix too short for a window is unlike all others, and sorts behind them.
    whole = np.flatnonzero(fits)
    order = whole[np.argsort(keys[whole], kind="stable")]
    new = np.concatenate(([True], keys[order[1:]] != keys[order[:-1]])) if len(order) else np.zeros(0, dtype=bool)
    group_start = np.flatnonzero(new)
    size = np.diff(np.append(group_start, len(order)))
    tied = np.repeat(size > 1, size)
    rank = position + n
    rank[order] = np.repeat(group_start, size)
    levels, widths = [rank.copy()], [window]
    candidates = order[tied]
    slots = np.flatnonzero(tied)
    width = window
    while len(candidates):
        far = candidates + width
        inside = far < ends[candidates]
        second = candidates + np.int64(2 * n)
        second[inside] = rank[far[inside]]
        by = np.lexsort((second, rank[candidates]))
        candidates, second = candidates[by], second[by]
        order[slots] = candidates
        head = rank[candidates]
        new = np.concatenate(([True], (head[1:] != head[:-1]) | (second[1:] != second[:-1])))
        group_start = np.flatnonzero(new)
        size = np.diff(np.append(group_start, len(candidates)))
        rank[candidates] = np.repeat(slots[group_start], size)
        still = np.repeat(size > 1, size)
        width *= 2
        if still.any():
            levels.append(rank.copy())
            widths.append(width)
        candidates, slots = candidates[still], slots[still]
    a, b = order[:-1], order[1:]
    near = levels[0][a] == levels[0][b]
    a, b = a[near], b[near]
    common = np.zeros(len(a), dtype=np.int64)
    for level, wide in zip(reversed(levels), reversed(widths)):
        x, y = a + common, b + common
        live = (x + wide <= ends[a]) & (y + wide <= ends[b])
        same = np.zeros(len(a), dtype=bool)
        same[live] = level[x[live]] == level[y[live]]
        common += wide * same
    for _ in range(window - 1):
        x, y = a + common, b + common
        live = (x < ends[a]) & (y < ends[b])
        same = np.zeros(len(a), dtype=bool)
        same[live] = words[x[live]] == words[y[live]]
        if not same.any():
            break
        # A pair that stopped once stops for good: its next words differ at this very place.
        common += same
    np.maximum.at(longest, a, common)
    np.maximum.at(longest, b, common)
    return longest


def chunk_rules(data: np.ndarray, offsets: np.ndarray, max_repeat_share: float, max_repeat_words: int, min_words: int) -> dict:
    docs = len(offsets) - 1
    inside = ~SPACE[data]
    starts, ends = borders(inside, offsets)
    doc = owners(starts, offsets)
    n_words = np.bincount(doc, minlength=docs)
    word_end = np.cumsum(n_words)
    letters = running(inside & ((data & 0xC0) != 0x80))
    symbols = running(SYMBOLS[data])
    repeats = longest_repeats(span_hashes(data, starts, ends), doc, word_end[doc] if len(doc) else doc)
    depth = np.zeros(len(starts) + 1, dtype=np.int64)
    at = np.flatnonzero(repeats)
    np.add.at(depth, at, 1)
    np.add.at(depth, at + repeats[at], -1)
    covered = np.cumsum(depth)[:-1] > 0
    longest = np.zeros(docs, dtype=np.int64)
    np.maximum.at(longest, doc, repeats)
    n_repeat = np.bincount(doc, weights=covered, minlength=docs).astype(np.int64)
    repeat_chars = np.bincount(doc, weights=covered * (letters[ends] - letters[starts]), minlength=docs).astype(np.int64)
    # Lines: every text ends one, and each line feed ends one.
    feed = np.flatnonzero(data == 0x0A)
    line_start = np.sort(np.concatenate((offsets[:-1], feed + 1)))
    line_doc = np.sort(np.concatenate((np.arange(docs), owners(feed, offsets))))
    line_end = np.sort(np.concatenate((offsets[1:], feed)))
    wordy = running(inside)
    used = np.flatnonzero(wordy[line_end] > wordy[line_start])
    keys = mix(span_hashes(data, line_start[used], line_end[used]) ^ mix(line_doc[used].astype(np.uint64) + np.uint64(1)))
    first = np.unique(keys, return_index=True)[1]
    lines = np.bincount(line_doc[used], minlength=docs)
    n_dup = lines - np.bincount(line_doc[used][first], minlength=docs)
    word_chars = letters[offsets[1:]] - letters[offsets[:-1]]
    failed = (n_words < min_words) | (100 * n_repeat > 30 * n_words)
    drowned = repeat_chars > max_repeat_share * word_chars
    # Whatever the text's length: two copies apart that make up much of a text fail by what they cover.
    endless = longest > max_repeat_words
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": n_dup,
        "n_repeat_words": n_repeat,
        "base_failed": failed,
        "kept": ~(failed | drowned | endless),
        "longest_repeat": longest,
        "repeat_chars": repeat_chars,
    }


def repetition_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_repeat_share: float = 0.3,
    max_repeat_words: int = 100, min_words: int = 20, carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: word and line counts, what repeats cover, and the verdict.

    Rejected: under ``min_words`` words; over 30 of 100 words within repeats of eight words or
    more; over ``max_repeat_share`` of the word characters within such repeats; or one repeat of
    over ``max_repeat_words`` words, however long the text.
    A null or empty text has no words and is rejected. A null id is passed on; repeated rows
    are judged each on its own. ``carry`` names input columns that are passed on, in a struct
    ``carried`` of fields c0, c1, ...; others are not read, whatever their names.
    """
    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
        *([F.struct(*[F.col(c).alias(f"c{k}") for k, c in enumerate(carry)]).alias("carried")] if carry else []),
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in text_chunks(batch.column(1)):
                found = chunk_rules(data, offsets, max_repeat_share, max_repeat_words, min_words)
                ids, *carried = [batch.column(c).slice(row, len(offsets) - 1) for c in range(batch.num_columns) if c != 1]
                names = ["doc_id", *found, *["carried" for _ in carried]]
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, found.values()), *carried], names)

    kind = f", carried {source.schema['carried'].dataType.simpleString()}" if carry else ""
    return source.mapInArrow(judge, SCHEMA + kind)
