"""Array forms of texts inside Arrow tasks: word borders, word hashes, sums per document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters that part words: space and tab to carriage return.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of text worked on at once. A longer document forms a chunk of its own.
CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, byte offsets) of consecutive rows; a null text is an empty one."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        stop = min(max(stop, row + 1), len(column))
        yield row, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the hash base, or of its inverse, modulo 2^64."""
    if inverse not in _powers or len(_powers[inverse]) < n:
        made = np.full(max(n, CHUNK_BYTES + 1), _INVERSE if inverse else _BASE, dtype=np.uint64)
        made[0] = 1
        _powers[inverse] = np.cumprod(made, dtype=np.uint64)
    return _powers[inverse][:n]


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each range of values, by the values and their order alone."""
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(len(values)), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(len(values) + 1, inverse=True)[starts])


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span."""
    return range_hashes(data.astype(np.uint64) + np.uint64(1), starts, ends)


def running(flags: np.ndarray) -> np.ndarray:
    """Counts before each position, with the total at the end."""
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total


def borders(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of runs of ``inside``; a run ends with its document."""
    first = np.zeros(len(inside) + 1, dtype=bool)
    first[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if len(inside) else inside
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.concatenate((inside[1:], [False])) if len(inside) else inside
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends


def owners(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The document of each byte position."""
    return np.searchsorted(offsets, starts, side="right") - 1


def runs_of(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of ``width`` consecutive values, by order and value."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        total = total * _BASE + hashes[k : k + n]
    return mix(total)


#: For each byte, its eight bits as eight one-byte counters.
_LANES = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.uint8).copy().view(np.uint64).ravel()


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per group of ``counts`` consecutive hashes: bits that are set in over half of them. No hashes: 0."""
    out = np.zeros(len(counts), dtype=np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    sizes = counts[full]
    starts = np.cumsum(sizes) - sizes
    # Sums of at most 255 fit into one byte each; those are then added up in full width.
    pieces = -(-sizes // 255)
    owner = np.repeat(np.arange(len(full)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    cuts = starts[owner] + nth * 255
    ones = np.empty((len(full), 64), dtype=bool)
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    first_piece = np.cumsum(pieces) - pieces
    for k in range(8):
        part = np.add.reduceat(_LANES[octets[:, k]], cuts).view(np.uint8).reshape(-1, 8).astype(np.int64)
        ones[:, 8 * k : 8 * k + 8] = np.add.reduceat(part, first_piece, axis=0) * 2 > sizes[:, None]
    out[full] = np.packbits(ones, axis=1, bitorder="little").view("<u8").ravel()
    return out
