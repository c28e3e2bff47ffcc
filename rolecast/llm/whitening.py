"""Whitening of embeddings, with covariances by polarisation.

The covariance of two dimensions is half of what the variance of their sum has over the two
variances. So only squares are added up: of every centred dimension, and of the sum of every two.
All sums are exact whole numbers; the first rounding is the one to double precision before the
eigenvectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Whole steps per unit, and the shift that makes usual entries positive.
STEPS = 64
SHIFT = 1_000_000
COMPONENTS = 32
#: Rows worked on at once.
ROWS = 2_048
#: Share of the largest eigenvalue below which a direction holds rounding errors only.
FLAT = 1e-12
_LIMB = 32
_LIMBS = ["l0", "l1", "l2", "l3"]
_LONG = 1 << 63


def whole_entries(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, entries as whole numbers) of the usable vectors of ``size`` entries."""
    column = column.cast(pa.large_list(pa.float64()))
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == size)
    if not len(rows) or not size:
        return rows[:0], np.zeros((0, size), dtype=np.int64)
    values = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    scaled = np.floor(STEPS * values) + SHIFT
    # A null is not a number here; what exceeds a long is as unusable as an infinite entry.
    good = (np.abs(scaled) < 2.0**62).all(axis=1)
    return rows[good], scaled[good].astype(np.int64)


def limbs(value: int) -> list[int]:
    """Four addends of a whole number that longs hold, and so do sums of many of them."""
    low = [(value >> _LIMB * k) & ((1 << _LIMB) - 1) for k in range(3)]
    return [*low, value >> _LIMB * 3]


def whole(row) -> int:
    return sum(int(row[name]) << _LIMB * k for k, name in enumerate(_LIMBS))


def _limb_rows(totals: dict[int, int]) -> pa.RecordBatch:
    keys = list(totals)
    parts = [limbs(totals[k]) for k in keys]
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int64()), *[pa.array([p[k] for p in parts], pa.int64()) for k in range(4)]], ["key", *_LIMBS]
    )


_LIMB_SCHEMA = "key long, " + ", ".join(f"{name} long" for name in _LIMBS)


def _exact_sums(rows: DataFrame) -> dict[int, int]:
    """Whole sums by key of (key, limbs) rows; there are few keys."""
    return {r["key"]: whole(r) for r in rows.groupBy("key").agg(*[F.sum(name).alias(name) for name in _LIMBS]).collect()}


def vector_size(vectors: DataFrame) -> int:
    """The most frequent number of entries among vectors, the larger one at a tie; 0 without any."""
    counts = vectors.filter("vector is not null").groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    most = counts.agg(F.max(F.struct("n", "size")).alias("most")).first().most
    return most["size"] if most else 0


def dimension_sums(vectors: DataFrame, size: int) -> tuple[int, list[int]]:
    """(usable vectors, exact sum per dimension)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * size
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                _, x = whole_entries(batch.column(0).slice(first, ROWS), size)
                n += len(x)
                # Entries below 2^62: high and low halves keep the sums of a block within longs.
                high, low = (x >> _LIMB).sum(axis=0), (x & ((1 << _LIMB) - 1)).sum(axis=0)
                sums = [s + (int(h) << _LIMB) + int(v) for s, h, v in zip(sums, high, low)]
        yield _limb_rows({-1: n, **dict(enumerate(sums))})

    total = _exact_sums(vectors.select("vector").mapInArrow(add, _LIMB_SCHEMA))
    return total.get(-1, 0), [total.get(d, 0) for d in range(size)]


def _squares(y: np.ndarray, others: np.ndarray) -> list[int]:
    """Exact sums of squares of a column plus each of the others."""
    both = others + y[:, None]
    if both.size and int(np.abs(both).max()) ** 2 * len(both) < _LONG:
        return [int(s) for s in (both * both).sum(axis=0)]
    # Large entries: the same with whole numbers of any length.
    return [sum(int(v) ** 2 for v in column) for column in both.T]


def centred_squares(vectors: DataFrame, size: int, centre: list[int]) -> np.ndarray:
    """[i, j]: exact sum of squares of the centred dimension i if i is j, else of the sum of the dimensions i < j."""
    middle = np.array(centre, dtype=np.int64)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [[0] * (size - i) for i in range(size)]
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                _, x = whole_entries(batch.column(0).slice(first, ROWS), size)
                y = x - middle
                for i in range(size):
                    own = _squares(np.zeros(len(y), dtype=np.int64), y[:, i : i + 1])
                    totals[i] = [t + s for t, s in zip(totals[i], own + _squares(y[:, i], y[:, i + 1 :]))]
        yield _limb_rows({i * size + i + k: t for i, row in enumerate(totals) for k, t in enumerate(row)})

    found = _exact_sums(vectors.select("vector").mapInArrow(add, _LIMB_SCHEMA))
    return np.array([[found.get(i * size + j, 0) for j in range(size)] for i in range(size)], dtype=object)


def covariance(n: int, sums: list[int], centre: list[int], squares: np.ndarray) -> np.ndarray:
    """Covariances, divisor n, each rounded once.

    The centre is a whole number next to the mean. What is left of the mean is taken out of each
    variance in whole numbers: n times a sum of squares less the square of the sum.
    """
    size = len(sums)
    rest = [s - n * c for s, c in zip(sums, centre)]
    scatter = [[n * int(squares[i, j]) - (rest[i] if i == j else rest[i] + rest[j]) ** 2 for j in range(size)] for i in range(size)]
    out = np.empty((size, size))
    for i in range(size):
        out[i, i] = scatter[i][i] / (n * n)
        for j in range(i + 1, size):
            out[i, j] = out[j, i] = (scatter[i][j] - scatter[i][i] - scatter[j][j]) / (2 * n * n)
    return out


@dataclass(frozen=True)
class Whitening:
    """What the fit leaves: the map of a centred vector to its components."""

    n: int
    sums: list[int]
    centre: list[int]
    eigenvalues: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def count(self) -> int:
        return len(self.eigenvalues)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Whitened components of each row."""
        rest = np.array([(s - self.n * c) / self.n for s, c in zip(self.sums, self.centre)])
        return ((x - np.array(self.centre, dtype=np.int64)) - rest) @ (self.vectors / np.sqrt(self.eigenvalues))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact squared distance from the mean, times n squared; null where a long cannot hold it."""
        y = x - np.array(self.centre, dtype=np.int64)
        rest = [s - self.n * c for s, c in zip(self.sums, self.centre)]
        largest = max(int(np.abs(y).max(initial=0)) * self.n + max(map(abs, rest), default=0), 1)
        if largest * largest * max(x.shape[1], 1) < _LONG:
            far = self.n * y - np.array(rest, dtype=np.int64)
            return [int(v) for v in (far * far).sum(axis=1)]
        exact = [sum((self.n * int(v) - r) ** 2 for v, r in zip(row, rest)) for row in y]
        return [v if v < _LONG else None for v in exact]


def fit(vectors: DataFrame, size: int, components: int = COMPONENTS) -> Whitening | None:
    """Eigenvectors of the covariance of all usable rows of ``vectors(vector)``; None without any spread."""
    n, sums = dimension_sums(vectors, size)
    if not n or not size:
        return None
    centre = [s // n for s in sums]
    cov = covariance(n, sums, centre, centred_squares(vectors, size, centre))
    values, columns = np.linalg.eigh(cov)
    values, columns = values[::-1], columns[:, ::-1]
    kept = int((values > max(FLAT * values[0], 0.0)).sum()) if values[0] > 0 else 0
    kept = min(kept, components)
    if not kept:
        return None
    values, columns = values[:kept].copy(), columns[:, :kept].copy()
    signs = np.sign(columns[np.abs(columns).argmax(axis=0), np.arange(kept)])
    return Whitening(n, sums, centre, values, columns * signs, float(np.trace(cov)))


def identity_error(vectors: DataFrame, size: int, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened rows minus the identity."""
    m = model.count

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((m + 1, m))
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                _, x = whole_entries(batch.column(0).slice(first, ROWS), size)
                w = model.scores(x)
                total[:m] += w.T @ w
                total[m] += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["key", "value"])

    rows = vectors.select("vector").mapInArrow(add, "key long, value double").groupBy("key").agg(F.sum("value").alias("value")).collect()
    total = np.zeros((m + 1) * m)
    for row in rows:
        total[row["key"]] = row["value"]
    second, mean = total[: m * m].reshape(m, m) / model.n, total[m * m :] / model.n
    return float(np.abs(second - np.outer(mean, mean) - np.eye(m)).max())


def whiten(embeddings: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row per usable vector and component.

    An entry c becomes floor(64 c) + 1,000,000. Vectors that are null, hold a null or non-finite
    entry, or one beyond 2^62 after that, are dropped; so are those of another length than most
    have. A null id stays null; repeated rows count one by one. Directions without spread have no
    component; where no direction has any (one vector, equal vectors, an empty table), no row is
    returned. ``deviation`` is null where a long cannot hold it. Other columns are not read.
    """
    source = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    size = vector_size(source)
    model = fit(source, size, components)
    if model is None:
        return source.sparkSession.createDataFrame([], schema)
    error = identity_error(source, size, model)
    m, explained = model.count, model.eigenvalues / model.trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                rows, x = whole_entries(part.column(1), size)
                each = pa.array(np.repeat(np.arange(len(rows)), m))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(rows)).take(each),
                        pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(rows))),
                        pa.array(np.full(len(rows) * m, model.n, dtype=np.int64)),
                        pa.array(model.deviations(x), pa.int64()).take(each),
                        pa.array(model.scores(x).ravel()),
                        pa.array(np.tile(explained, len(rows))),
                        pa.array(np.full(len(rows) * m, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return source.mapInArrow(project, schema)
