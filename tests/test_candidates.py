"""Prefixes, places and signatures lose no pair of sets that reaches the threshold, and sets are not shuffled for them."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from rolecast.plans import candidates


def test_close_sets_meet_and_no_set_is_shuffled(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(63) - (1 << 62) for _ in range(300)]
    common = [rng.getrandbits(63) for _ in range(8)]
    sets = []
    for k in range(60):
        kept = rng.sample(base, 60 + rng.randrange(4)) if k % 3 else base[: 100 + k % 5] + [rng.getrandbits(62) for _ in range(k % 9)]
        sets.append((f"n{k}", "x", sorted(set(kept + common))))
    sets += [("none", "x", []), ("one", "x", [5]), ("same", "x", [5])]
    df = spark.createDataFrame(sets, "node string, block string, e array<bigint>")
    order = candidates.element_order(df, "e")
    found = candidates.prefixes(df, "node", "block", "e", order, 17, 20)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    met = {}
    for r in found.collect():
        met.setdefault(r.node, {})[r.bucket] = (r.n, r.pos)
    signed = {r.node: r.s for r in candidates.with_signature(df, "e", "s").collect()}
    of, close, places = {n: set(e) for n, _, e in sets}, 0, []
    for a, b in combinations([n for n, _, e in sets if e], 2):
        bits = sum(bin((x ^ y) & (1 << 64) - 1).count("1") for x, y in zip(signed[a], signed[b]))
        assert bits <= len(of[a] ^ of[b])
        if len(of[a] & of[b]) * 20 >= len(of[a] | of[b]) * 17:
            close += 1
            shared = met[a].keys() & met[b].keys()
            assert shared
            places += [(*met[a][e], *met[b][e]) for e in shared]
    assert close > 100
    pairs = spark.createDataFrame(places, "n_a int, pos_a int, n_b int, pos_b int")
    assert pairs.filter(~candidates.may_reach(F.lit(17), F.lit(20))).count() == 0
