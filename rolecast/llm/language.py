"""Language of texts: sparse multinomial logistic regression on character n-grams.

Features are hashed character n-grams, weighted by term frequency times inverse document frequency
and scaled to length one. The weights are trained with follow-the-regularised-leader: elastic-net
penalties keep most of them at zero. Shards of the training sample are worked on in parallel, and
after each round their steps are averaged. At last one temperature is fitted on labelled documents
that the training has not seen, so that a score is a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecast.session import cut_lineage

#: Buckets of n-grams, and the widths in characters.
BUCKETS = 1 << 15
WIDTHS = (1, 2, 3)
#: Documents per language from which the weights are trained at most: those with the smallest hash.
MAX_PER_LANGUAGE = 2_000
#: Documents per language for the temperature at most.
MAX_CALIBRATION = 500
#: Learning rate, its offset, and the penalties on the sum of weights and of their squares.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.02, 0.02
SHARDS, ROUNDS = 8, 6
#: Characters worked on at once; a longer text is counted part by part.
BLOCK = 1 << 19
#: One document in FOLDS is held out; of the rest, one in CALIBRATION_FOLDS by hash fits the temperature.
FOLDS, CALIBRATION_FOLDS = 5, 10
UNKNOWN = "und"
#: Steps are added up as whole numbers of this size, so that their order does not matter.
_UNIT = float(1 << 40)
_TEMPERATURES = np.exp(np.linspace(np.log(0.02), np.log(5.0), 61))

_letters: list[np.ndarray] = []


def _is_letter(points: np.ndarray) -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0][points]


def _stream(text: str) -> np.ndarray:
    """Code points of the lower-cased text, each run of other characters than letters as one 0, none doubled."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    letter = _is_letter(points)
    points = np.where(letter, points, 0)
    first = np.ones(len(points), dtype=bool)
    first[1:] = letter[1:] | letter[:-1]
    return points[first]


def _grams(points: np.ndarray, fresh: int) -> np.ndarray:
    """Buckets of the n-grams that end at or after position ``fresh``; a lone gap is none."""
    wide = points.astype(np.uint32) + np.uint32(1)
    found, key = [], wide
    for width in range(1, max(WIDTHS) + 1):
        if width > 1:
            key = key[:-1] * np.uint32(0x0F4F3D55) + wide[width - 1 :]
        if width in WIDTHS:
            new = key[max(fresh - width + 1, 0) :]
            if width == 1:
                new = new[new != 1]
            found.append(((new + np.uint32(width)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - (BUCKETS.bit_length() - 1)))
    return np.concatenate(found)


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of the n-grams of a whole text; empty where it has no letter."""
    total, tail, few = None, np.zeros(1, dtype=np.uint32), None
    text = text or ""
    for start in range(0, len(text), BLOCK):
        points = _stream(text[start : start + BLOCK])
        if len(points) and points[0] == 0 and tail[-1] == 0:
            points = points[1:]
        if start + BLOCK >= len(text) and (len(points) == 0 or points[-1] != 0):
            points = np.append(points, np.uint32(0)) if len(points) or tail[-1] != 0 else points
        joined = np.concatenate((tail, points))
        buckets = _grams(joined, len(tail))
        tail = joined[-(max(WIDTHS) - 1) :]
        if len(text) <= BLOCK and len(buckets) < BUCKETS // 8:
            few = np.unique(buckets, return_counts=True)
        else:
            total = np.bincount(buckets, minlength=BUCKETS) + (0 if total is None else total)
    if few is not None:
        return few
    if total is None:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    some = np.flatnonzero(total)
    return some, total[some]


def tfidf(buckets: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Values of length one."""
    value = counts * idf[buckets]
    length = np.sqrt(value @ value)
    return value / length if length else value


def leader(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights that follow from the summed gradients z and squares n; zero where the first penalty outweighs z."""
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def follow(z: np.ndarray, n: np.ndarray, buckets: np.ndarray, values: np.ndarray, label: int) -> None:
    """One step with one document, in place. ``z`` and ``n`` have a row per bucket and one for the constant."""
    at = np.append(buckets, BUCKETS)
    x = np.append(values, 1.0)[:, None]
    zi, ni = z[at], n[at]
    w = leader(zi, ni)
    p = softmax((x * w).sum(axis=0))
    p[label] -= 1.0
    g = x * p
    square = g * g
    sigma = (np.sqrt(ni + square) - np.sqrt(ni)) / ALPHA
    z[at] = zi + g - sigma * w
    n[at] = ni + square


@dataclass(frozen=True)
class LanguageModel:
    """Languages, document frequencies as weights, and one column of weights per language."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def logits(self, buckets: np.ndarray, values: np.ndarray) -> np.ndarray:
        return values @ self.weights[buckets] + self.weights[BUCKETS]

    def predict(self, text: str | None) -> tuple[str, float]:
        buckets, counts = gram_counts(text)
        if not len(buckets) or not self.languages:
            return UNKNOWN, 0.0
        p = softmax(self.logits(buckets, tfidf(buckets, counts, self.idf)) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """Weight per bucket, from the number of texts of the only column that have it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS + 1, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                seen[gram_counts(text.as_py())[0]] += 1
                seen[BUCKETS] += 1
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], ["bucket", "n"])

    found = texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    seen = np.zeros(BUCKETS + 1)
    seen[found["bucket"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.float64)
    return np.log((1 + seen[BUCKETS]) / (1 + seen[:BUCKETS])) + 1


def training_sample(labelled: DataFrame, idf: np.ndarray, languages: list[str], per_language: dict[str, int]) -> DataFrame:
    """(role, shard, label, cut, bucket, value): one row of arrays per shard, of at most about MAX_PER_LANGUAGE documents a language.

    A document takes part by its own hash alone, so the draw needs no sort, and of equal rows one is
    taken. A shard is as large as its share of the bounded sample; being one row, it stays whole
    however files are split, and no round has to deal the sample out again.
    """
    hashed = labelled.withColumn("hash", F.xxhash64("doc_id", "text", "lang"))
    role = F.when(F.pmod(F.xxhash64("hash"), F.lit(CALIBRATION_FOLDS)) == 0, "calibrate").otherwise("train")
    # Uniform in 0 to 1.
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("draw"), "hash"), 11) / F.lit(float(1 << 53))
    enough = F.lit(False)
    for name in languages:
        share = min(1.0, MAX_PER_LANGUAGE / max(per_language[name] * (1 - 1 / CALIBRATION_FOLDS), 1))
        checked = min(1.0, MAX_CALIBRATION * CALIBRATION_FOLDS / max(per_language[name], 1))
        enough = F.when(F.col("lang") == name, draw < F.when(F.col("role") == "train", F.lit(share)).otherwise(F.lit(checked))).otherwise(enough)
    shard = F.pmod(F.xxhash64("hash", F.lit("shard")), F.lit(SHARDS)).cast("int")
    drawn = hashed.withColumn("role", role).filter(enough).select("role", shard.alias("shard"), "hash", "lang", "text")
    place = {name: k for k, name in enumerate(languages)}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            hashes = batch.column(2).to_pylist()
            rows = [k for k, h in enumerate(hashes) if not (h in seen or seen.add(h))]
            buckets, values = [], []
            for k in rows:
                b, c = gram_counts(batch.column(4)[k].as_py())
                buckets.append(b.astype(np.int32))
                values.append(tfidf(b, c, idf).astype(np.float32))
            labels = [place[batch.column(3)[k].as_py()] for k in rows]
            kept = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(kept) for c in range(3)), pa.array(labels, pa.int32()), pa.array(buckets, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))],
                ["role", "shard", "hash", "label", "bucket", "value"],
            )

    def pack(rows: pa.Table) -> pa.Table:
        _, first = np.unique(rows.column("hash").to_numpy(), return_index=True)
        rows = rows.take(pa.array(first))
        bucket, value = (rows.column(c).combine_chunks() for c in ("bucket", "value"))
        cut = np.concatenate(([0], np.cumsum(pc.list_value_length(bucket).to_numpy(zero_copy_only=False))))
        row = {"role": rows.column("role")[0].as_py(), "shard": rows.column("shard")[0].as_py(), "label": rows.column("label").to_numpy(),
               "cut": cut, "bucket": bucket.flatten().to_numpy(), "value": value.flatten().to_numpy()}
        return pa.table({name: [x] for name, x in row.items()}, pa.schema(
            [("role", pa.string()), ("shard", pa.int32()), ("label", pa.list_(pa.int32())), ("cut", pa.list_(pa.int64())),
             ("bucket", pa.list_(pa.int32())), ("value", pa.list_(pa.float32()))]))

    made = drawn.mapInArrow(features, "role string, shard int, hash long, label int, bucket array<int>, value array<float>")
    packed = made.filter(F.size("bucket") > 0).groupBy("role", "shard").applyInArrow(
        pack, "role string, shard int, label array<int>, cut array<long>, bucket array<int>, value array<float>"
    )
    return cut_lineage(packed)


def _documents(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]]:
    """(labels, buckets of each document, its values) of every shard in (label, cut, bucket, value) rows."""
    for k in range(batch.num_rows):
        labels, cut, bucket, value = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in range(4))
        yield labels, np.split(bucket.astype(np.int64), cut[1:-1]), np.split(value.astype(np.float64), cut[1:-1])


def train(sample: DataFrame, classes: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights per bucket and language, with one row for the constant."""
    context = sample.sparkSession.sparkContext
    z = np.zeros((BUCKETS + 1, classes))
    n = np.zeros((BUCKETS + 1, classes))
    shards = sample.filter("role = 'train'").select("label", "cut", "bucket", "value")
    total = shards.agg(F.sum(F.size("label")).alias("n")).first().n
    if not total:
        return z
    for number in range(rounds):
        state = context.broadcast((z, n))

        def shard_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            z0, n0 = state.value
            for batch in batches:
                for labels, buckets, values in _documents(batch):
                    zs, ns = z0.copy(), n0.copy()
                    # Each round has an order of its own, the same wherever it runs.
                    for k in np.random.default_rng(number).permutation(len(labels)):
                        follow(zs, ns, buckets[k], values[k], int(labels[k]))
                    share = len(labels) / total
                    dz, dn = np.rint((zs - z0) * share * _UNIT).ravel(), np.rint((ns - n0) * share * _UNIT).ravel()
                    moved = np.flatnonzero((dz != 0) | (dn != 0))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(moved), pa.array(dz[moved].astype(np.int64)), pa.array(dn[moved].astype(np.int64))], ["key", "z", "n"]
                    )

        steps = shards.mapInArrow(shard_steps, "key long, z long, n long")
        moved = steps.groupBy("key").agg(F.sum("z").alias("z"), F.sum("n").alias("n")).toPandas()
        z, n = z.copy(), n.copy()
        at = moved["key"].to_numpy(dtype=np.int64)
        z.ravel()[at] += moved["z"].to_numpy(dtype=np.float64) / _UNIT
        n.ravel()[at] += moved["n"].to_numpy(dtype=np.float64) / _UNIT
        state.destroy()
    return leader(z, n)


def calibrate(sample: DataFrame, model: LanguageModel) -> float:
    """The temperature with the least log loss over the labelled documents set aside; 1 without any."""

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(_TEMPERATURES))
        for batch in batches:
            for labels, buckets, values in _documents(batch):
                for label, b, v in zip(labels, buckets, values):
                    scaled = model.logits(b, v)[None, :] / _TEMPERATURES[:, None]
                    top = scaled.max(axis=1, keepdims=True)
                    total += top[:, 0] + np.log(np.exp(scaled - top).sum(axis=1)) - scaled[:, label]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(np.rint(total * _UNIT / (1 << 20)).astype(np.int64))], ["k", "loss"])

    rows = sample.filter("role = 'calibrate'").select("label", "cut", "bucket", "value")
    found = rows.mapInArrow(losses, "k long, loss long").groupBy("k").agg(F.sum("loss").alias("loss")).collect()
    if not any(r.loss for r in found):
        return 1.0
    return float(_TEMPERATURES[min(found, key=lambda r: (r.loss, r.k)).k])


def learn(labelled: DataFrame) -> LanguageModel:
    """The model of ``labelled(doc_id, text, lang)``; without usable rows one without languages.

    Document frequencies come from every row. Weights and temperature come from a bounded sample.
    """
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], np.ones(BUCKETS), np.zeros((BUCKETS + 1, 0)))
    idf = inverse_frequencies(labelled.select("text"))
    sample = training_sample(labelled, idf, languages, counts)
    model = LanguageModel(languages, idf, train(sample, len(languages)))
    return replace(model, temperature=calibrate(sample, model))


def held_out(doc_id: Column) -> Column:
    """Whether a document is never learned from: crc32 of its id as text is a multiple of FOLDS. A null id: false."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row.

    Learned from are rows with id, text and language that are not held out; the prediction reads the
    text only. ``lang_pred`` is ``und`` with the score 0 where the text is null or has no letter, or
    where no row can be learned from. Whole texts count, whatever their length. Of equal training
    rows one is enough. With one language every text with a letter has it, with the score 1. Other
    columns are not read.
    """
    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    out = held_out(F.col("doc_id"))
    model = learn(source.filter(~out & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull()))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [model.predict(text.as_py()) for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = source.select("doc_id", out.alias("held_out"), "text")
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")
