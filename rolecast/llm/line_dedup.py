"""Fuzzy duplicate lines: SimHash, pigeonhole blocks, edit similarity, one line kept per group.

Lines are compared in normal form: lower-cased runs of letters and digits, parted by one space. A
line is cut into blocks of a few words, from its start and from its end, and each block is named by
the SimHash of its words. Changed words spoil the blocks they lie in and leave the others whole, so
two lines with fewer changed words than blocks meet in one. Lines that meet and whose own SimHashes
differ in few bits are held against each other: linked are those of an edit similarity of at least
0.8. Of a block each line is held against two others first; what these links do not join is held
against all close lines of the block. Of each connected group the first line of the corpus stays.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from itertools import compress, groupby, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecast.llm.arrays import borders, majority_bits, mix, range_hashes, span_hashes, text_chunks
from rolecast.llm.contamination import _WORD as WORD
from rolecast.plans.components import connected_components
from rolecast.plans.skew import salted_join
from rolecast.session import cut_lineage, drop_files

#: Bits in which the SimHashes of two lines that meet may differ. Few words make few features, so that
#: one of them moves more bits.
MAX_BITS, MAX_BITS_SHORT = 14, 20
#: Words of a block, and of a line that is short enough to be looked up without each of its words in turn.
BLOCK_WORDS = 4
SHORT_LINE = 9
#: Rows of one block that one task compares with another such set.
BLOCK_ROWS = 8192
#: The same where the rows have their texts with them.
TEXT_ROWS = 1024
#: Kinds of characters that are counted to tell lines apart; those of a kind are taken for one.
KINDS = 32
#: One line in so many is looked at for large blocks.
SAMPLE = 64
#: Buckets of so many rows are compared many at a time.
FEW = 64
#: Texts that one text is held against at once.
LOT = 64
#: Cells of one comparison held at once.
CELLS = 1 << 21
#: Edits are at most one in so many characters of the longer line: similarity 0.8.
CHARS_PER_EDIT = 5
#: A line of fewer words says too little to be called a fuzzy copy.
MIN_WORDS = 3
LINES = "row long, tie long, line int, hash long, short boolean, fp long, blocks array<long>"
#: Stands for a null id in comparisons.
NO_ID = -(1 << 63)


def _features(words: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Hashes of (word, how often its line has had it before)."""
    keys = mix(words ^ mix(line.astype(np.uint64) + np.uint64(1)))
    # Equal words may count in any order.
    order = np.argsort(keys)
    new = np.flatnonzero(np.concatenate(([True], keys[order[1:]] != keys[order[:-1]])) if len(order) else [])
    before = np.arange(len(order)) - np.repeat(new, np.diff(np.append(new, len(order))))
    out = np.empty(len(words), dtype=np.uint64)
    out[order] = mix(words[order] + mix(before.astype(np.uint64) + np.uint64(1)))
    return out


def line_rows(source: DataFrame, min_words: int) -> DataFrame:
    """(row, tie, line, hash, short, fp, blocks) of every line of ``source(row, tie, text)`` that has a word.

    Lines of fewer than ``min_words`` words are ``short``.

    ``hash`` is that of the words in order and names the line, ``fp`` is the SimHash of the words and
    ``blocks`` are the keys under which lines meet (none for short lines).
    The SimHash takes the first, second, ... occurrence of a word as different features: otherwise
    a few common words would settle all bits of a long line, and unlike lines would look alike.
    """
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lowered = pc.utf8_lower(pc.fill_null(batch.column(2).cast(pa.large_string()), ""))
            for first, data, offsets in text_chunks(lowered):
                starts, ends = borders(WORD[data], offsets)
                feed = np.flatnonzero(data == 0x0A)
                begin = np.sort(np.concatenate((offsets[:-1], feed + 1)))
                doc = np.sort(np.concatenate((np.arange(len(offsets) - 1), np.searchsorted(offsets, feed, side="right") - 1)))
                number = np.arange(len(begin)) - np.searchsorted(doc, doc, side="left")
                # An empty text begins where the next one does; its only line owns no words.
                owner = np.searchsorted(begin, starts, side="right") - 1
                counts = np.bincount(owner, minlength=len(begin))
                words = span_hashes(data, starts, ends)
                stop = np.cumsum(counts)
                full = np.flatnonzero(counts)
                fp = majority_bits(_features(words, np.repeat(full, counts[full])), counts[full])
                of = pa.array(doc[full] + first)
                key, cuts = block_keys(words, stop[full] - counts[full], np.where(counts[full] < min_words, 0, counts[full]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(of), batch.column(1).take(of), pa.array(number[full].astype(np.int32)),
                        pa.array(range_hashes(words, stop[full] - counts[full], stop[full]).view(np.int64)),
                        pa.array(counts[full] < min_words), pa.array(fp.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(key.view(np.int64))),
                    ],
                    ["row", "tie", "line", "hash", "short", "fp", "blocks"],
                )

    return source.select("row", "tie", "text").mapInArrow(lines, LINES)


def block_keys(words: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, borders between lines) of the blocks of each line of ``counts`` words from ``starts`` on.

    The first half of a line is cut into blocks from its start, the second half from its end, so that
    an added or missing word moves the blocks of its own half only. A short line has, besides, the
    words but one, for each of its words, and all of them.
    """
    short = (counts > 0) & (counts <= SHORT_LINE)
    long = counts >= 2 * BLOCK_WORDS
    front = np.where(long, -(-counts // 2) // BLOCK_WORDS, 0)
    back = front
    middle = np.where(long & (counts >= (2 * front + 1) * BLOCK_WORDS), 1, 0)
    blocks = front + back + middle
    total = blocks + np.where(short, counts + 1, 0)
    cuts = np.concatenate(([0], np.cumsum(total)))
    owner = np.repeat(np.arange(len(counts)), total)
    nth = np.arange(len(owner)) - cuts[owner]
    keys = np.zeros(len(owner), dtype=np.uint64)

    at = np.flatnonzero(nth < blocks[owner])
    o, k = owner[at], nth[at]
    # Blocks from the start, then from the end, then one in the middle where there is room for it.
    from_end = (k >= front[o]) & (k < 2 * front[o])
    place = np.where(k < front[o], k * BLOCK_WORDS, np.where(from_end, counts[o] - (k - front[o] + 1) * BLOCK_WORDS, front[o] * BLOCK_WORDS))
    first = starts[o] + place
    a, b, c, d = (mix(words[first + j]) for j in range(BLOCK_WORDS))
    # Bits that are set in over half of the four.
    simhash = (a & b & (c | d)) | (c & d & (a | b))
    position = np.where(from_end, -(k - front[o]) - 1, np.where(k < front[o], k, front[o])).astype(np.int64)
    # Even keys for blocks, odd ones for short lines.
    keys[at] = mix(simhash ^ mix(position.view(np.uint64) + np.uint64(1))) & ~np.uint64(1)

    at = np.flatnonzero(nth >= blocks[owner])
    o = owner[at]
    k = nth[at] - blocks[o]
    # The words in order, but for the k-th; k beyond the last leaves all.
    value = np.zeros(len(at), dtype=np.uint64)
    for j in range(SHORT_LINE):
        there = (j < counts[o]) & (j != k)
        word = words[np.minimum(starts[o] + j, max(len(words) - 1, 0))] if len(words) else value
        value = np.where(there, mix(value * np.uint64(0x9E3779B97F4A7C15) + word), value)
    keys[at] = value | np.uint64(1)
    return keys, cuts


def _large(rows: DataFrame, block_rows: int) -> DataFrame | None:
    """(bucket, parts) of the buckets of ``rows(bucket, node, ...)`` with more than ``block_rows`` rows; None if there is none.

    Which buckets are large is told by one line in SAMPLE. This decides on the squares only, not on
    what is compared: a bucket that is overlooked is compared as one.
    """
    sizes = cut_lineage(
        rows.filter(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0)
        .groupBy("bucket").agg((F.count(F.lit(1)) * SAMPLE).alias("k")).filter(F.col("k") > block_rows)
        .select("bucket", F.ceil(F.col("k") / block_rows).cast("int").alias("parts"))
    )
    return None if sizes.isEmpty() else sizes


def _met(rows: DataFrame, large: DataFrame | None, compare: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``compare`` makes of ``rows(bucket, node, ...)``, with the rows of a bucket next to each other.

    ``compare`` reads (key, side, bucket, node, ...) by ``_whole``. Rows of one key are to be compared,
    those of side 0 with those of side 1, and those of side 2 with each other. A large bucket is cut into
    (stripe, column) squares with a key each, so that no task holds a whole one.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def placed(some: DataFrame, key: str) -> DataFrame:
        return some.repartition(parts, key).sortWithinPartitions(key).mapInArrow(compare, schema)

    if large is None:
        return placed(rows, "bucket")

    def square(stripe: Column, column: Column, side: int) -> Column:
        return F.struct(F.xxhash64("bucket", stripe.cast("int"), column.cast("int")).alias("key"), F.lit(side).alias("side"))

    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    asking = F.transform(every, lambda k: square(F.col("part"), k, 0))
    asked = F.transform(every, lambda k: square(k, F.col("part"), 1))
    cut = rows.join(large, "bucket").withColumn("part", part)
    squares = cut.select(*rows.columns, F.explode(F.concat(asking, asked)).alias("at")).select("at.key", "at.side", *rows.columns)
    small = rows.join(large, "bucket", "left_anti")
    return placed(small, "bucket").unionByName(placed(squares, "key"))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """(key, side, bucket, ...) of the batches, cut anew so that rows of one key stay together. Buckets that are not cut have no key yet."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(columns[0]):
            continue
        if batch.schema.names[0] == "bucket":
            columns = [columns[0], np.full(len(columns[0]), 2), *columns]
        other = np.flatnonzero(columns[0] != columns[0][-1])
        start = int(other[-1]) + 1 if len(other) else 0
        if held and (start or held[0][0][0] != columns[0][0]):
            yield [np.concatenate(c) for c in zip(*held, [c[:start] for c in columns])]
            held.clear()
        elif start:
            yield [c[:start] for c in columns]
        held.append([c[start:] for c in columns])
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def _limit(bucket: np.ndarray) -> np.ndarray:
    return np.where(bucket & 1, MAX_BITS_SHORT, MAX_BITS)


def _close(a: np.ndarray, fp_a: np.ndarray, b: np.ndarray, fp_b: np.ndarray, limit: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bits, which are close) of a few rows ``a`` at a time against all of ``b``; a node is not close to itself."""
    step = max(1, CELLS // max(1, len(b)))
    for k in range(0, len(a), step):
        bits = np.bitwise_count(fp_a[k : k + step, None] ^ fp_b[None, :])
        bits[a[k : k + step, None] == b[None, :]] = 65
        yield k, bits, bits <= limit


def _chosen(a: np.ndarray, fp_a: np.ndarray, b: np.ndarray, fp_b: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (a, b): each a with the closest node of b, and with the smallest one that is close enough; and which rows of a have others."""
    order = np.argsort(b, kind="stable")
    b, fp_b = b[order], fp_b[order]
    left, right, others = [], [], np.zeros(len(a), dtype=bool)
    for k, bits, near in _close(a, fp_a, b, fp_b, limit):
        some = np.flatnonzero(near.any(axis=1))
        closest, smallest = bits[some].argmin(axis=1), near[some].argmax(axis=1)
        left += [a[k + some]] * 2
        right += [b[closest], b[smallest]]
        others[k + some] = near[some].sum(axis=1) > 1 + (closest != smallest)
    x, y = (np.concatenate(s) if s else a[:0] for s in (left, right))
    return x, y, others


def _chosen_in_small(key: np.ndarray, node: np.ndarray, fp: np.ndarray, start: np.ndarray, size: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same as ``_chosen`` for all buckets of at most FEW rows at once, as positions (row, row, row with others)."""
    row = _positions(start, size)
    row = row[np.lexsort((node[row], key[row]))]
    many = np.repeat(size, size)
    # The bucket's rows from here on, in order of their nodes.
    first = np.repeat(np.cumsum(size) - size, size)
    left = np.repeat(np.arange(len(row)), many)
    edge = np.cumsum(many) - many
    place = np.arange(len(left)) - np.repeat(edge, many)
    right = np.repeat(first, many) + place
    bits = np.bitwise_count(fp[row[left]] ^ fp[row[right]]).astype(np.int32)
    near = (bits <= np.repeat(np.repeat(limit, size), many)) & (node[row[left]] != node[row[right]])
    far = np.int32(65 * FEW)
    closest = np.minimum.reduceat(np.where(near, bits * FEW + place, far), edge)
    smallest = np.minimum.reduceat(np.where(near, place, far), edge)
    count = np.add.reduceat(near.astype(np.int32), edge)
    some = np.flatnonzero(count)
    one, two = row[(first[some] + closest[some] % FEW)], row[first[some] + smallest[some]]
    others = row[some[count[some] > 1 + (one != two)]]
    return np.concatenate((row[some], row[some])), np.concatenate((one, two)), others


def _positions(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions of ranges, one after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _few(size: np.ndarray) -> Iterator[np.ndarray]:
    """Buckets of two to FEW rows, so many at a time that their cells can be held at once."""
    small = np.flatnonzero((size > 1) & (size <= FEW))
    lot = np.cumsum(size[small] ** 2) // CELLS
    for k in np.unique(lot):
        yield small[lot == k]


def candidates(rows: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of lines that meet in a block of ``rows(bucket, node, fp)`` and are close by SimHash.

    Of a block each line names two others, the smallest and the closest, so a block of k lines gives
    at most 2 k pairs; in these rows ``bucket`` and ``fp`` are null. A line that is close to others,
    too, is told by a row (a, null, bucket, fp). Of two close lines that do not name each other both are told.
    """

    def found(x: np.ndarray, y: np.ndarray, told: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        pair = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0) if len(x) else np.zeros((0, 2), np.int64)
        node, bucket, fp = (pa.array(t, pa.int64()) for t in told)
        none, nothing = pa.nulls(len(pair), pa.int64()), pa.nulls(len(node), pa.int64())
        columns = [[pa.array(pair[:, 0]), node], [pa.array(pair[:, 1]), nothing], [none, bucket], [none, fp]]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], ["a", "b", "bucket", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, side, bucket, node, fp in _whole(batches):
            bits = fp.view(np.uint64)
            start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(start, len(key)))
            limit = _limit(bucket[start])
            whole = side[start] == 2
            left, right, told = [node[:0]], [node[:0]], [start[:0]]
            # Most blocks hold one line and need no look; small ones are looked at together.
            for these in _few(np.where(whole, size, 0)):
                x, y, others = _chosen_in_small(key, node, bits, start[these], size[these], limit[these])
                left.append(node[x])
                right.append(node[y])
                told.append(others)
            for k in np.flatnonzero((size > 1) & (~whole | (size > FEW))):
                at = np.arange(start[k], start[k] + size[k])
                one, other = at[side[at] != 1], at[side[at] != 0]
                x, y, others = _chosen(node[one], bits[one], node[other], bits[other], int(limit[k]))
                left.append(x)
                right.append(y)
                told.append(one[others])
            at = np.concatenate(told)
            yield found(np.concatenate(left), np.concatenate(right), (node[at], bucket[at], fp[at]))

    return _met(rows, _large(rows, BLOCK_ROWS), compare, "a long, b long, bucket long, fp long").distinct()


def _node_texts(source: DataFrame, places: DataFrame) -> DataFrame:
    """(node, text, length, kinds) with the normal form of each line in ``places(node, first)``."""
    wanted = places.groupBy("first.row", "first.tie").agg(
        F.collect_list(F.struct(F.col("first.line").alias("line"), "node")).alias("lines")
    )

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, texts = [], []
            for text, lines in zip(pc.utf8_lower(batch.column(0).cast(pa.large_string())), batch.column(1)):
                split = (text.as_py() or "").split("\n")
                for m in lines.as_py():
                    plain = "".join(c if c >= "\x80" or c.isalnum() else " " for c in split[m["line"]])
                    nodes.append(m["node"])
                    texts.append(" ".join(w for w in plain.split(" ") if w))
            length, kinds = _kinds(texts)
            # Counts beyond a byte are held as 255; they then differ by less, so that no pair is lost.
            packed = pa.array([k.tobytes() for k in np.minimum(kinds, 255).astype(np.uint8)], pa.binary())
            columns = [pa.array(nodes, pa.int64()), pa.array(texts, pa.string()), pa.array(length.astype(np.int32)), packed]
            yield pa.RecordBatch.from_arrays(columns, ["node", "text", "length", "kinds"])

    # Copies of a row have the same key and the same text.
    once = source.join(wanted, ["row", "tie"]).groupBy("row", "tie").agg(F.first("text").alias("text"), F.first("lines").alias("lines"))
    return once.select("text", "lines").mapInArrow(normal, "node long, text string, length int, kinds binary")


def within_edits(a: str, b: str, limit: int) -> bool:
    """Whether at most ``limit`` insertions, deletions and replacements of characters turn a into b."""
    if abs(len(a) - len(b)) > limit:
        return False
    x, y = a.split(" "), b.split(" ")
    # Replacing the words that differ in place is one way; its cost is a bound from above.
    if len(x) == len(y) and sum(max(len(u), len(v)) for u, v in zip(x, y) if u != v) <= limit:
        return True
    start = 0
    while start < min(len(x), len(y)) and x[start] == y[start]:
        start += 1
    stop = 0
    while stop < min(len(x), len(y)) - start and x[-1 - stop] == y[-1 - stop]:
        stop += 1
    a, b = " ".join(x[start : len(x) - stop]), " ".join(y[start : len(y) - stop])
    if max(len(a), len(b)) + 1 <= limit:
        return True
    # The way over whole words is another bound from above.
    if _word_cost(x[start : len(x) - stop], y[start : len(y) - stop]) <= limit:
        return True
    # Each edit adds or takes one of a character at most, or trades it for another.
    one, other = Counter(a), Counter(b)
    if max(sum((one - other).values()), sum((other - one).values())) > limit:
        return False
    return _edit_distance(a, b) <= limit


def _edit_distance(a: Sequence[str], b: Sequence[str]) -> int:
    """Edit distance of characters, or of words, with a column of the table held as the bits of two whole numbers."""
    if not a or not b:
        return len(a) + len(b)
    # The bits hold the longer one, the loop runs over the shorter.
    if len(b) > len(a):
        a, b = b, a
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = full, 0, len(a)
    for c in b:
        same = places.get(c, 0)
        flat = (((same & up) + up) ^ up) | same | down
        grow, shrink = down | (full & ~(flat | up)), up & flat
        distance += bool(grow & last) - bool(shrink & last)
        grow, shrink = (grow << 1 | 1) & full, (shrink << 1) & full
        up, down = shrink | (full & ~((same | down) | grow)), grow & (same | down)
    return distance


def _word_cost(a: list[str], b: list[str]) -> int:
    """Characters that change where a becomes b by replacing, adding and dropping as few words as can be."""
    if not a or not b:
        return sum(len(w) + 1 for w in a + b)
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    up, down, columns = full, 0, []
    for c in b:
        same = places.get(c, 0)
        flat = (((same & up) + up) ^ up) | same | down
        grow, shrink = down | (full & ~(flat | up)), up & flat
        grow, shrink = (grow << 1 | 1) & full, (shrink << 1) & full
        up, down = shrink | (full & ~((same | down) | grow)), grow & (same | down)
        columns.append((up, down))
    # Back through the table by the signs of its vertical steps.
    cost, i, j = 0, len(a), len(b)
    while i and j:
        if columns[j - 1][0] >> (i - 1) & 1:
            i -= 1
            cost += len(a[i]) + 1
        else:
            j -= 1
            if j and columns[j - 1][1] >> (i - 1) & 1:
                cost += len(b[j]) + 1
            else:
                i -= 1
                if a[i] != b[j]:
                    cost += max(len(a[i]), len(b[j]))
    return cost + sum(len(w) + 1 for w in a[:i] + b[:j])


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _number(bits: np.ndarray) -> int:
    """The whole number that has these bits, the lowest first."""
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def _bits(number: int, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(number.to_bytes(-(-n // 8), "little"), np.uint8), bitorder="little")[:n]


def within_edits_each(text: str, others: list[str], limits: Sequence[int]) -> np.ndarray:
    """``within_edits`` of one text and each of several others, none of them empty.

    The tables of the others stand side by side in the bits of whole numbers, with a bit between them
    that keeps carries apart. Those that are out of reach are dropped on the way.
    """
    close = np.zeros(len(others), dtype=bool)
    alive, most = np.arange(len(others)), np.array(limits)
    codes, length = _codes("".join(o + "\0" for o in others)), np.fromiter(map(len, others), np.int64, len(others))
    up, down = np.ones(len(codes), dtype=bool), np.zeros(len(codes), dtype=bool)
    ends = np.cumsum(length + 1) - 1
    up[ends] = False
    step = max(32, -(-len(text) // 8))
    for begin in range(0, len(text), step):
        starts, inside = ends - length, np.ones(len(codes), dtype=bool)
        inside[ends] = False
        lowest = np.zeros(len(codes), dtype=bool)
        lowest[starts] = True
        part = text[begin : begin + step]
        places = {c: _number((codes == ord(c)) & inside) for c in set(part)}
        full, first, u, d = (_number(x) for x in (inside, lowest, up, down))
        for c in part:
            same = places[c]
            flat = (((same & u) + u) ^ u) | same | d
            grow, shrink = d | (full & ~(flat | u)), u & flat
            grow, shrink = (grow << 1 | first) & full, (shrink << 1) & full
            u, d = shrink | (full & ~((same | d) | grow)), grow & (same | d)
        up, down = _bits(u, len(codes)), _bits(d, len(codes))
        # Edits up to each place of the others, and what the rests differ in length at least.
        done = begin + len(part)
        rest = len(text) - done
        total = np.cumsum(up.astype(np.int64) - down)
        edits = done + total - np.repeat(np.concatenate(([0], total[ends[:-1]])), length + 1)
        if not rest:
            close[alive] = edits[ends] <= most
            break
        left = np.repeat(ends, length + 1) - 1 - np.arange(len(codes))
        least = np.minimum(np.minimum.reduceat(edits + np.abs(left - rest), starts), done + np.abs(length - rest))
        stay = least <= most
        if not stay.any():
            break
        if not stay.all():
            here = np.repeat(stay, length + 1)
            codes, up, down = codes[here], up[here], down[here]
            alive, most, length = alive[stay], most[stay], length[stay]
            ends = np.cumsum(length + 1) - 1
        up, down = up.astype(bool), down.astype(bool)
    return close


def _kinds(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each text its length and how many characters of each kind it has."""
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    kind = _codes("".join(texts)) % KINDS
    cell = np.repeat(np.arange(len(texts)) * KINDS, length) + kind
    return length, np.bincount(cell, minlength=len(texts) * KINDS).reshape(-1, KINDS).astype(np.int32)


def _in_reach(kinds_a: np.ndarray, kinds_b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Whether counts allow for ``limit`` edits: one edit changes a count up by one and another down by one at most."""
    change = kinds_a.astype(np.int32) - kinds_b
    both, more = np.abs(change).sum(axis=1), change.sum(axis=1)
    return (both + np.abs(more)) <= 2 * limit


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts have an edit similarity of at least 0.8."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            (long_a, kinds_a), (long_b, kinds_b) = _kinds(one), _kinds(two)
            limit = np.maximum(long_a, long_b) // CHARS_PER_EDIT
            close = _in_reach(kinds_a, kinds_b, limit)
            for k in np.flatnonzero(close).tolist():
                close[k] = within_edits(one[k], two[k], int(limit[k]))
            yield batch.select(["a", "b"]).filter(pa.array(close, pa.bool_()))

    sizes = "abs(length_a - length_b) * {0} <= greatest(length_a, length_b)"
    both = (
        pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"), F.col("length").alias("length_a")), "a")
        .join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"), F.col("length").alias("length_b")), "b")
        .filter(sizes.format(CHARS_PER_EDIT))
    )
    return both.select("a", "b", "text_a", "text_b").mapInArrow(verify, "a long, b long")


def _apart(
    key: np.ndarray, side: np.ndarray, bucket: np.ndarray, node: np.ndarray, fp: np.ndarray, label: np.ndarray, length: np.ndarray,
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, row, edits) of pairs of close lines of one key, of different labels, whose lengths allow for the edits; some at a time."""
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(start, len(key)))
    limit = _limit(bucket[start])
    bits = fp.view(np.uint64)
    whole = side[start] == 2

    def kept(x: np.ndarray, y: np.ndarray, near: np.ndarray | int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.flatnonzero((label[x] != label[y]) & (np.bitwise_count(bits[x] ^ bits[y]) <= near))
        x, y = x[at], y[at]
        edits = np.maximum(length[x], length[y]) // CHARS_PER_EDIT
        at = np.flatnonzero(np.abs(length[x] - length[y]) <= edits)
        return x[at], y[at], edits[at]

    for these in _few(np.where(whole, size, 0)):
        row, last = _positions(start[these], size[these]), np.repeat(start[these] + size[these], size[these])
        many = last - row - 1
        x = np.repeat(row, many)
        yield kept(x, _positions(row + 1, many), np.repeat(np.repeat(limit[these], size[these]), many))
    for k in np.flatnonzero((size > 1) & (~whole | (size > FEW))):
        at = np.arange(start[k], start[k] + size[k])
        one, other = at[side[at] != 1], at[side[at] != 0]
        step = max(1, CELLS // max(1, len(other)))
        for j in range(0, len(one), step):
            some = one[j : j + step]
            apart = label[some, None] != label[other][None, :]
            # Two squares have a pair of different stripes.
            order = np.arange(len(key)) if whole[k] else node
            apart &= order[some, None] < order[other][None, :]
            x, y = np.nonzero(apart)
            yield kept(some[x], other[y], int(limit[k]))


def further_links(told: DataFrame, groups: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between labels of ``groups(node, label)`` that close lines of ``told(bucket, node, fp)`` join; a lone node is its own label.

    Close lines of one label are joined already. Of the others, lengths and counts of characters tell
    which could be similar; only lines with such a partner fetch their texts, once for all of their
    blocks. Their pairs are held against each other where the block lies; links come out, fewer than rows.
    """
    named = told.join(groups, "node", "left").select("bucket", "node", "fp", F.coalesce("label", "node").alias("label"))
    several = named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("bucket")
    parted = cut_lineage(named.join(several, "bucket", "left_semi"))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, side, bucket, node, fp, label, length, kinds in _whole(batches):
            counts = np.frombuffer(b"".join(kinds), np.uint8).reshape(-1, KINDS)
            wanted = np.zeros(len(key), dtype=bool)
            for x, y, edits in _apart(key, side, bucket, node, fp, label, length):
                for k in range(0, len(x), CELLS // KINDS):
                    some = slice(k, k + CELLS // KINDS)
                    at = np.flatnonzero(~(wanted[x[some]] & wanted[y[some]])) + k
                    at = at[_in_reach(counts[x[at]], counts[y[at]], edits[at])]
                    wanted[x[at]] = wanted[y[at]] = True
            yield pa.RecordBatch.from_arrays([pa.array(c[wanted]) for c in (bucket, node, fp, label)], ["bucket", "node", "fp", "label"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, side, bucket, node, fp, label, text, shared in _whole(batches):
            length, kinds = _kinds(list(text))
            meets = [frozenset(s.tolist()) for s in shared]
            root: dict[int, int] = {}
            links: list[tuple[int, int]] = []

            def top(x: int) -> int:
                while x in root:
                    x = root[x]
                return x

            def here(i: int, j: int) -> bool:
                """Whether this block is the smallest one in which the two lines are close."""
                this, bits = int(bucket[i]), int(np.bitwise_count(fp[i : i + 1].view(np.uint64) ^ fp[j : j + 1].view(np.uint64))[0])
                return not any(b < this and (bits <= MAX_BITS or b & 1) for b in meets[i] & meets[j])

            for x, y, edits in _apart(key, side, bucket, node, fp, label, length):
                for k in range(0, len(x), CELLS // KINDS):
                    some = slice(k, k + CELLS // KINDS)
                    near = _in_reach(kinds[x[some]], kinds[y[some]], edits[some])
                    pairs = zip(*(c[some][near].tolist() for c in (x, y, edits)))
                    for i, group in groupby(pairs, key=lambda pair: pair[0]):
                        lot = 4
                        open_pairs = ((j, most) for _, j, most in group if top(int(label[j])) != top(int(label[i])) and here(i, j))
                        while some_pairs := list(islice(open_pairs, lot)):
                            others, limits = zip(*some_pairs)
                            if len(others) == 1:
                                found = [within_edits(text[i], text[others[0]], limits[0])]
                            else:
                                found = within_edits_each(text[i], [text[j] for j in others], limits)
                            for j in compress(others, found):
                                a, b = top(int(label[i])), top(int(label[j]))
                                if a != b:
                                    root[max(a, b)] = min(a, b)
                                    links.append((a, b))
                            lot = min(LOT, lot * 4)
            ends = [pa.array([pair[k] for pair in links], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(ends, ["a", "b"])

    def lines(rows: DataFrame, columns: list[str]) -> DataFrame:
        """``rows(bucket, node, fp, label)`` with columns of ``texts``, which each line fetches once for all of its blocks."""
        once = rows.groupBy("node").agg(F.first("fp").alias("fp"), F.first("label").alias("label"), F.collect_set("bucket").alias("shared"))
        found = once.join(texts.select("node", *columns), "node")
        return found.select(F.explode("shared").alias("bucket"), "node", "fp", "label", *columns, "shared")

    sized = lines(parted, ["length", "kinds"]).drop("shared")
    sifted = _met(sized, _large(parted, BLOCK_ROWS), sift, "bucket long, node long, fp long, label long").distinct()
    possible = cut_lineage(sifted)
    # A pair that meets in several blocks is looked at in one of them.
    return _met(lines(possible, ["text"]), _large(possible, TEXT_ROWS), link, "a long, b long").distinct()


def _relabelled(groups: DataFrame, joined: DataFrame) -> DataFrame:
    """``groups(node, label)`` with the labels that ``joined(node, label)`` gives to labels; a lone node was its own label."""
    last = joined.select(F.col("node").alias("label"), F.col("label").alias("last"))
    known = groups.join(last, "label", "left").select("node", F.coalesce("last", "label").alias("label"))
    return cut_lineage(known.unionByName(joined.join(groups.select("node"), "node", "left_anti")))


def removed_lines(source: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(row, tie, lines): the numbers of the lines that go, per document."""
    every = cut_lineage(line_rows(source, min_words))
    place = F.struct("row", "tie", "line")
    # One row per different line: how often there is one, where first, and how it meets others.
    keys = cut_lineage(
        every.groupBy("hash").agg(
            F.count(F.lit(1)).alias("n"), F.min(place).alias("first"), F.first("fp").alias("fp"), F.first("blocks").alias("blocks")
        )
    )
    every = cut_lineage(every.select("row", "tie", "line", "hash"), replaces=every)
    found = cut_lineage(candidates(keys.select(F.explode("blocks").alias("bucket"), F.col("hash").alias("node"), "fp")))
    keys = cut_lineage(keys.select("hash", "n", "first"), replaces=keys)
    pairs = found.filter("bucket IS NULL").select("a", "b")
    met = pairs.select(F.col("a").alias("hash")).unionByName(pairs.select(F.col("b").alias("hash"))).distinct()
    places = keys.join(met, "hash", "left_semi").select(F.col("hash").alias("node"), "first")
    texts = cut_lineage(_node_texts(source, places))
    groups = connected_components(verified(pairs, texts))
    told = found.filter("bucket IS NOT NULL").select("bucket", F.col("a").alias("node"), "fp")
    if not told.isEmpty():
        # A line that is close to any other is in ``texts``.
        further = cut_lineage(further_links(told, groups, texts))
        if not further.isEmpty():
            groups = _relabelled(groups, connected_components(further))
    for done in (found, texts):
        drop_files(done.sparkSession, done.cut_path)
    # The first place of a group comes from the first places of its lines, not from all of them.
    grouped = keys.join(groups.withColumnRenamed("node", "hash"), "hash", "left").filter("n > 1 OR label IS NOT NULL")
    grouped = cut_lineage(grouped.select("hash", "first", "label"))
    kept = grouped.filter("label IS NOT NULL").groupBy("label").agg(F.min("first").alias("kept"))
    stays = salted_join(grouped, kept, ["label"], "hash", "left").select("hash", F.coalesce("kept", "first").alias("kept"))
    repeated = salted_join(every.select("row", "tie", "line", "hash"), stays, ["hash"], "row")
    gone = repeated.filter(place != F.col("kept")).select("row", "tie", "line")
    # A document's own lines. Copies of a row repeat the same numbers.
    return cut_lineage(gone.groupBy("row", "tie").agg(F.collect_set("line").alias("lines")))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), min_words: int = MIN_WORDS,
) -> DataFrame:
    """(doc_id, text, n_lines, n_removed) and the ``carry`` columns of every document, without repeated lines.

    The line that stays is the first by (id, place). Lines end at line feeds only. Lines of fewer
    than ``min_words`` words are no fuzzy copies; they go as exact copies of a normal form only. Lines
    without words stay. A document may lose all its lines; it stays, with an
    empty text. A null text stays null and has no lines; an empty text has one. Null ids come
    first. Equal rows are treated alike, so that all copies of a row lose the same lines; rows of
    one id with different texts are ordered by the hash of their text. ``carry`` names columns of
    the input that are passed on under their names; others are not read.
    """
    source = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("row"),
        F.xxhash64(F.col(text_col).cast("string")).alias("tie"),
        F.col(text_col).cast("string").alias("text"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.struct(F.lit(0).alias("none"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(carry)]).alias("carried"),
    )
    gone = removed_lines(source.select("row", "tie", "text"), min_words)

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, total, removed = [], [], []
            for text, lines in zip(batch.column(1), batch.column(2)):
                text, drop = text.as_py(), set(lines.as_py() or ())
                split = [] if text is None else text.split("\n")
                texts.append("\n".join(x for k, x in enumerate(split) if k not in drop) if drop else text)
                total.append(len(split))
                removed.append(len(drop))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), batch.column(3)],
                ["doc_id", "text", "n_lines", "n_removed", "carried"],
            )

    joined = source.join(gone, ["row", "tie"], "left").select("doc_id", "text", "lines", "carried")
    kind = joined.schema["carried"].dataType.simpleString()
    out = joined.mapInArrow(without, f"doc_id long, text string, n_lines long, n_removed long, carried {kind}")
    return out.select("doc_id", "text", "n_lines", "n_removed", *[F.col(f"carried.c{k}").alias(c) for k, c in enumerate(carry)])
