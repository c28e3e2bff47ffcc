import random
from itertools import combinations

import pytest

from rolecast.operators import duplicates
from rolecast.plans import skew

WORDS = [f"w{i}" for i in range(40)]


def corpus():
    """Copies, near copies in chains, a hot group, texts without words, several companies."""
    rng = random.Random(7)
    rows = []

    def put(company, title, body, fp=None):
        n = len(rows)
        rows.append((f"job_{n:04d}", fp or f"sha256:{n}", company, title, body))

    base = [rng.choice(WORDS) for _ in range(120)]
    for _ in range(40):  # a third of all rows are copies of one text
        put("Acme Pvt Ltd", "Data Engineer", " ".join(base))
    chain = [rng.choice(WORDS) for _ in range(150)]
    for step in range(64):  # each close to the next, the ends far apart
        chain = chain[:]
        chain[step * 2] = f"n{step}"
        chain[step * 2 + 1] = f"m{step}"
        put("Beta Inc", "Cloud Lead" if step % 2 else "Lead Cloud", " ".join(chain))
    for _ in range(20):
        put("Acme Ltd", "Data Engineer", " ".join(rng.choice(WORDS) for _ in range(60)))
    put(None, "Data Engineer", " ".join(base))
    put("Gamma", "Data Engineer", " ".join(base))
    put("Acme", "Office Cook", " ".join(base))
    put("Delta", "हिन्दी", "हिन्दी", "sha256:x")
    put("Delta", "தமிழ்", "தமிழ்", "sha256:y")
    put("Delta", "one two three four five", "हिन्दी")
    put("Delta", "one two three four five six", "தமிழ்")
    put("Omega", "A", "short text", "sha256:same")
    put(None, "B", "other text", "sha256:same")
    return rows


def by_force(prepared):
    def jac(a, b):
        return 1.0 if not a and not b else len(a & b) / len(a | b)

    edges = set()
    for x, y in combinations(prepared, 2):
        same = x.fingerprint == y.fingerprint
        close = (
            x.company and x.company == y.company and jac(set(x.title_set), set(y.title_set)) >= 0.8
            and jac(set(x.shingle_set), set(y.shingle_set)) >= 0.85
        )
        if same or close:
            edges.add((x.job_id, y.job_id))
    parent = {r.job_id: r.job_id for r in prepared}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    groups = {}
    for n in parent:
        groups.setdefault(root(n), set()).add(n)
    return edges, {min(g): g for g in groups.values() if len(g) > 1}


@pytest.mark.parametrize("block_rows", [2, 3, 2000])
def test_groups_and_pairs_equal_brute_force(spark, monkeypatch, block_rows):
    monkeypatch.setattr(skew, "BLOCK_ROWS", block_rows)
    src = spark.createDataFrame(corpus(), "job_id string, fingerprint string, company string, title string, description string")
    prepared = duplicates.prepare_postings(src).collect()
    edges, groups = by_force(prepared)
    got = {}
    for r in duplicates.duplicate_groups(src).collect():
        got.setdefault(r.group_id, set()).add(r.job_id)
    assert got == groups
    pairs = {(r.job_id_a, r.job_id_b) for r in duplicates.near_duplicate_pairs(src).collect()}
    assert pairs <= edges
    # Every brute-force pair is a pair of class representatives, or follows from one.
    rep = {}
    for r in sorted(prepared, key=lambda r: r.job_id):
        rep.setdefault(r.class_key, r.job_id)
    of = {r.job_id: rep[r.class_key] for r in prepared}
    fp = {r.job_id: r.fingerprint for r in prepared}
    for a, b in edges:
        if fp[a] != fp[b] and of[a] != of[b]:
            assert tuple(sorted((of[a], of[b]))) in pairs


def test_two_places_rounds_like_the_double(spark):
    from pyspark.sql import functions as F

    cases = [(7, 8, "0.88"), (169, 200, "0.84"), (1, 1, "1.00"), (2, 3, "0.67"), (173, 200, "0.86")]
    df = spark.createDataFrame(cases, "a int, b int, e string")
    for r in df.withColumn("g", duplicates.two_places(F.col("a"), F.col("b"))).collect():
        assert r.g == r.e, r


def test_exact_duplicates_keep_no_texts(spark):
    from checks import queries

    sf_dir = "/root/testdata/sf0.001"
    queries.QUERIES["exact_duplicates"](spark, sf_dir)
    kept = {name: path for (_, at, name), path in queries._stored.items() if at == sf_dir}
    assert spark.read.parquet(kept["fingerprints"]).columns == ["job_id", "fingerprint"]


def test_every_match_of_a_batch_is_named_in_both_scopes(spark):
    schema = "job_id string, fingerprint string, company string, title string, description string"
    rows = corpus()
    # Some postings of the batch are stored already; one of them with another text.
    again = [rows[0], rows[2], rows[50], (*rows[4][:2], "Beta Inc", *rows[4][3:])]
    batch, stored = spark.createDataFrame(rows[::2], schema), spark.createDataFrame(rows[1::2] + again, schema)

    def jac(a, b):
        return 1.0 if not a and not b else len(a & b) / len(a | b)

    def close(x, y):
        return (
            x.company and x.company == y.company and jac(set(x.title_set), set(y.title_set)) >= 0.8
            and jac(set(x.shingle_set), set(y.shingle_set)) >= 0.85
        )

    olds = duplicates.prepare_postings(stored).collect()
    for new, old in ((batch, stored), (stored, None)):
        left = duplicates.prepare_postings(new).collect()
        right = olds if old is not None else left
        wanted = sorted((x.job_id, y.job_id, x.fingerprint == y.fingerprint) for x in left for y in right if x.fingerprint == y.fingerprint or close(x, y))
        found = duplicates.Corpus(duplicates.arrivals(new, old), carry=duplicates.ARRIVED)
        got = duplicates.batch_matches(found).collect()
        assert sorted((r.job_id, r.existing_job_id, r.reason.startswith("Identical")) for r in got) == wanted


def test_a_repeated_side_is_not_broadcast_and_shuffles_go_with_their_write(spark):
    from rolecast.session import SHUFFLE_CLEANUP, cut_lineage

    few = spark.range(10).selectExpr("id AS k", "id * 2 AS v")
    joined = skew.salted_join(spark.range(1000).selectExpr("id % 10 AS k", "id"), few, ["k"], "id")
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()

    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(n).getName() for n in range(files.size()) if files.apply(n).getName().startswith("shuffle_")}

    before = shuffled()
    kept = cut_lineage(joined)
    assert not shuffled() - before
    assert kept.count() == 1000
    assert spark.conf.get(SHUFFLE_CLEANUP) == "false"
