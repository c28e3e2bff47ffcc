"""Target resampling, languages and whitening against brute force."""

import collections
import hashlib
import math
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from rolecast.llm import language, target_resampling, whitening
from rolecast.llm.queries import LLM_QUERIES

SF = "/root/testdata/sf0.001"

# ------------------------------------------------------------------ 11


def features(text, run):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [" ".join(words[i : i + w]) for w in range(1, run + 1) for i in range(len(words) - w + 1)]


def drawn(rows, targets, run=1, buckets=10_000, percent=10, min_words=20):
    def bucket(feature):
        return zlib.crc32(feature.encode()) % buckets

    own = collections.Counter(bucket(f) for _, t in rows for f in features(t, run)[1])
    other = collections.Counter(bucket(f) for t in targets for f in features(t, run)[1])
    all_own, all_other = sum(own.values()), sum(other.values())
    gain = [math.floor(1000 * math.log((other[b] + 1) * (all_own + buckets) / ((own[b] + 1) * (all_other + buckets)))) for b in range(buckets)]
    out, able = [], []
    for doc_id, text in rows:
        n_words, found = features(text, run)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(found), weight, score, None])
        if n_words >= min_words:
            able.append(out[-1])
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, row in enumerate(able[: percent * len(able) // 100], 1):
        row[4] = place
    return collections.Counter(map(tuple, out))


TEXTS = [
    (-1, "ÀÉ wörd" * 40), (-2, None), (-3, ""), (-4, "x " * 19), (-5, "\x00a\x7fB`c@1 " * 30), (-6, "w" * 3000 + " " + "Ab-9 " * 30),
    (None, "one two " * 15), (None, "one two " * 15), (-7, "again and again " * 9), (-7, "again and again " * 9), (-8, "日本語 テキスト " * 25),
]


@pytest.mark.parametrize("run, percent", [(1, 10), (1, 100), (1, 0), (3, 35)])
def test_resampling(spark, run, percent):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + TEXTS
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("score", F.lit("x")).withColumn("row", F.lit(0))
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = target_resampling.resample(docs, target, percent=percent, max_run=run)
    wanted = drawn(rows, [r.text for r in target.collect()], run, percent=percent)
    assert collections.Counter(map(tuple, got.collect())) == wanted
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]


def test_resampling_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    targets = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = LLM_QUERIES["op11_target_resampling"](spark, SF)
    assert collections.Counter(map(tuple, got.collect())) == drawn(rows, targets)
    assert {t for _, t in got.dtypes} == {"bigint"}


@pytest.mark.parametrize("share, tied", [(0.0, False), (0.002, False), (0.3, False), (0.002, True)])
def test_cutoff_widens_its_bracket(spark, share, tied):
    # A third of the rows share one score; the sketch's bracket may miss the cutoff and must then grow.
    scores = [5 if tied or k % 3 == 0 else (k * 7919) % 1000 for k in range(3_000)]
    rows = spark.createDataFrame([(s, k, k) for k, s in enumerate(scores)], "score long, doc_id long, row long")
    for percent in (1, 34, 100):
        k, edge, above = target_resampling.cutoff(rows, [F.desc("score"), F.asc("doc_id"), F.asc("row")], percent, share)
        wanted = sorted(scores, reverse=True)
        assert (k, edge, above) == (percent * 30, wanted[percent * 30 - 1], sum(s > wanted[percent * 30 - 1] for s in scores))


def test_cutoff_recovers_from_a_wrong_sketch(spark, monkeypatch):
    # The bracket is set where the row is not, on either side.
    real = F.percentile_approx
    rows = spark.createDataFrame([(k, k, k) for k in range(1_000)], "score long, doc_id long, row long")
    for wrong in (0.1, 0.99):
        monkeypatch.setattr(target_resampling.F, "percentile_approx", lambda c, p, a, wrong=wrong: real(c, F.array(F.lit(wrong), F.lit(wrong)), a))
        assert target_resampling.cutoff(rows, [F.desc("score"), F.asc("doc_id"), F.asc("row")], 50) == (500, 500, 499)


# ------------------------------------------------------------------ 12


def grams(text):
    flat = re.sub(r"0+", "0", "".join(c if c.isalpha() else "0" for c in text.lower()))
    flat = "0" + flat.strip("0") + "0"
    return [flat[i : i + w] for w in language.WIDTHS for i in range(len(flat) - w + 1) if flat[i : i + w] != "0"]


@pytest.mark.parametrize("text", ["Ein Haus, zwei Häuser!", "a", "1 a 2", "日本 語", "  x  ", "The " * 3000, "ab" * 900 + " . " + "é" * 7])
def test_gram_counts(text, monkeypatch):
    buckets, counts = language.gram_counts(text)
    kinds = collections.Counter(grams(text))
    # Buckets are hashes: as many as there are kinds, but for rare collisions; the total is exact.
    assert counts.sum() == sum(kinds.values()) and len(buckets) <= len(kinds) <= len(buckets) + 3
    assert sorted(counts)[-1] >= max(kinds.values())
    monkeypatch.setattr(language, "BLOCK", 7)
    again = dict(zip(*map(list, language.gram_counts(text))))
    assert again == dict(zip(buckets.tolist(), counts.tolist()))


def test_texts_without_letters():
    for text in (None, "", " ", "12 !", "\n\n"):
        assert not len(language.gram_counts(text)[0])


def test_follow_the_leader_step():
    rng = np.random.default_rng(3)
    z, n = np.zeros((language.BUCKETS + 1, 3)), np.zeros((language.BUCKETS + 1, 3))
    plain_z, plain_n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(key):
        if abs(plain_z[key]) <= language.L1:
            return 0.0
        sign = 1 if plain_z[key] > 0 else -1
        return -(plain_z[key] - sign * language.L1) / ((language.BETA + math.sqrt(plain_n[key])) / language.ALPHA + language.L2)

    for _ in range(30):
        at = np.sort(rng.choice(40, 6, replace=False))
        x, label = rng.random(6), int(rng.integers(3))
        language.follow(z, n, at, x, label)
        full = [*zip(at.tolist(), x.tolist()), (language.BUCKETS, 1.0)]
        logits = [sum(v * weight((i, c)) for i, v in full) for c in range(3)]
        total = sum(math.exp(v) for v in logits)
        before = {(i, c): weight((i, c)) for i, _ in full for c in range(3)}
        for i, v in full:
            for c in range(3):
                g = v * (math.exp(logits[c]) / total - (c == label))
                sigma = (math.sqrt(plain_n[i, c] + g * g) - math.sqrt(plain_n[i, c])) / language.ALPHA
                plain_z[i, c] += g - sigma * before[i, c]
                plain_n[i, c] += g * g
    for (i, c), value in plain_z.items():
        assert z[i, c] == pytest.approx(value) and n[i, c] == pytest.approx(plain_n[i, c])


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    extra = spark.createDataFrame([(-1, None, "en"), (-2, "12 ?!", "de"), (None, "the one and the other", None)], "doc_id long, text string, lang string")
    both = docs.select("doc_id", "text", "lang").unionByName(extra)
    rows = {r.doc_id: r for r in language.identify_languages(both).collect()}
    assert len(rows) == docs.count() + 3
    known = {r.doc_id: r.lang for r in docs.collect()}
    for doc_id, lang in known.items():
        assert rows[doc_id].held_out == (zlib.crc32(str(doc_id).encode()) % 5 == 0)
    out = [d for d in known if rows[d].held_out]
    assert sum(rows[d].lang_pred == known[d] for d in out) >= 0.98 * len(out)
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert rows[-1].lang_pred == rows[-2].lang_pred == "und" and rows[None].held_out is False
    # A score is a probability: their mean is near the share of right ones.
    assert abs(sum(rows[d].score for d in out) / len(out) - 1) < 0.05


def test_held_out_labels_are_never_learned(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    spoilt = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), "wrong").otherwise(F.col("lang")))
    spoilt = spoilt.withColumn("text", F.col("text"))
    assert sorted(map(tuple, language.identify_languages(docs).collect())) == sorted(map(tuple, language.identify_languages(spoilt).collect()))


# ------------------------------------------------------------------ 13


def usable(rows, size):
    return [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v is not None and len(v) == size and all(c is not None and math.isfinite(c) for c in v)]


ODD = [(-1, None), (-2, [None] + [0.0] * 63), (-3, [math.nan] + [0.0] * 63), (-4, [math.inf] * 64), (-5, [1.0]), (-6, []), (None, [0.5] * 64), (7, [0.5] * 64), (7, [0.5] * 64)]


@pytest.mark.parametrize("far", [False, True])
def test_whitening(spark, far):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()] + ODD
    if far:  # squares beyond a long
        rows.append((8, [3e9, *[0.0] * 63]))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4).withColumn("component", F.lit("x"))
    got = whitening.whiten(frame).collect()
    fit = usable(rows, 64)
    n = len(fit)
    x = np.array([v for _, v in fit], dtype=object)
    sums = x.sum(axis=0)
    centred = n * x - sums
    assert len(got) == n * 32 or far
    wanted = collections.Counter((i, int(d) if d < 1 << 63 else None) for (i, _), d in zip(fit, (centred * centred).sum(axis=1)))
    assert collections.Counter((r.vec_id, r.deviation) for r in got if r.component == 1) == wanted
    assert {r.n for r in got} == {n}
    exact = centred.T.dot(centred)
    cov = np.array([[float(Fraction(int(v), n**3)) for v in row] for row in exact])
    values = np.linalg.eigvalsh(cov)[::-1]
    shares = {r.component: r.explained for r in got}
    for k, share in shares.items():
        assert share == pytest.approx(values[k - 1] / np.trace(cov), rel=1e-6)
    if far:
        return
    assert max(r.identity_error for r in got) < 1e-8 and len({r.identity_error for r in got}) == 1
    table = collections.defaultdict(dict)
    for r in got:
        table[r.vec_id, r.deviation][r.component] = r.whitened
    for (i, v), c in list(zip(fit, centred))[:40]:
        w = table[i, int((c * c).sum())]
        # The sum of squares in all 32 components is the distance under the leading eigenvectors.
        lead = np.linalg.eigh(cov)[1][:, ::-1][:, :32]
        y = (np.array(c, dtype=float) / n) @ lead / np.sqrt(values[:32])
        assert np.allclose(np.abs(y), [abs(w[k]) for k in range(1, 33)], atol=1e-6)


def test_polarisation_is_exact():
    rng = np.random.default_rng(5)
    x = rng.integers(-(10**6), 10**6, size=(50, 4))
    n, sums = len(x), [int(s) for s in x.sum(axis=0)]
    centre = [s // n for s in sums]
    y = x - np.array(centre)
    squares = np.array([[int(((y[:, i] if i == j else y[:, i] + y[:, j]) ** 2).sum()) for j in range(4)] for i in range(4)], dtype=object)
    got = whitening.covariance(n, sums, centre, squares)
    c = (n * x - np.array(sums)).astype(object)
    assert got.tolist() == [[float(Fraction(int(v), n**3)) for v in row] for row in c.T.dot(c)]


def test_limbs():
    for value in (0, -1, 1 << 100, -(1 << 100) - 5, (1 << 32) - 1, -(1 << 63)):
        assert whitening.whole(dict(zip(whitening._LIMBS, whitening.limbs(value)))) == value


def test_whitening_without_spread(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)], [(1, [])]):
        assert whitening.whiten(spark.createDataFrame(rows, schema)).collect() == []
    flat = whitening.whiten(spark.createDataFrame([(k, [float(k), 1.0, 2.0 * k]) for k in range(9)], schema)).collect()
    assert {r.component for r in flat} == {1} and flat[0].explained == pytest.approx(1.0)
