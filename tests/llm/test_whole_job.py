"""Operators against the whole of what they promise, not against their own candidates."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from rolecast.llm import contamination, line_dedup, private_data
from rolecast.llm.repetition import repetition_rules

# ------------------------------------------------------------------ 3


def test_masks_hit_every_fifth_of_replaced_words():
    def missed(size, masks):
        spots = [(int(m, 2) << k) for at, m in masks for k in (range(size - len(m) + 1) if at is None else [size - len(m) - at])]
        return [c for c in combinations(range(size), size // 5) if all(s & sum(1 << b for b in c) for s in spots)]

    # Other sizes up to 25 hold one of these with as few differences; more words hold a stretch of 13 to 25.
    for size in (13, 15, 20, 25):
        assert not missed(size, [(None, m) for m in contamination.MASKS])
    for size in range(5, 13):
        assert not missed(size, contamination.short_masks(size, True))


def test_contamination_by_agreement_alone(spark):
    rng = random.Random(21)
    words = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rng.choices(words, k=size))) for k, size in enumerate([4, *range(5, 18), 25, 40] * 2)]
    docs = []
    for d in range(150):
        part = rng.choice(items)[1].split()
        at = rng.randrange(max(1, len(part) - 14))
        part = part[at : at + rng.choice([15, 16, 40])]
        for k in rng.sample(range(len(part)), rng.choice([len(part) // 5, len(part) // 5, len(part) // 5 + 1])):
            part[k] = "zz"
        docs.append((d, " ".join([*rng.choices(words, k=rng.randrange(4)), *part, *rng.choices(words, k=rng.randrange(9))])))
    wanted = set()
    for d, t in docs:
        a = t.split()
        for i, u in items:
            b = u.split()
            for diagonal in range(1 - len(b), len(a)) if len(b) >= 5 else []:
                low, high = max(0, -diagonal), min(len(b), len(a) - diagonal)
                same = [a[k + diagonal] == b[k] for k in range(low, high)]
                need = min(13, len(b))
                if any(5 * sum(same[s:e]) >= 4 * (e - s) for s in range(len(same)) for e in range(s + need, len(same) + 1)):
                    wanted.add((d, i, diagonal))
    frames = [spark.createDataFrame(x, f"{k} long, text string") for x, k in ((docs, "doc_id"), (items, "item_id"))]
    got = contamination.overlaps(*frames, replaced_in_short=True).collect()
    assert {(r.doc_id, r.item_id, r.doc_word - r.item_word) for r in got} == wanted
    assert len({d for d, _, _ in wanted}) > 60


# ------------------------------------------------------------------ 8


def test_a_long_repeat_alone_rejects(spark):
    def twice(size, block):
        words = [f"w{k}" for k in range(size - block)]
        return " ".join([*words, *words[:block]])

    docs = [(1, twice(7000, 1000)), (2, twice(20_000, 101)), (3, twice(20_000, 100)), (4, twice(20_000, 0))]
    got = {r.doc_id: r for r in repetition_rules(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {k: r.longest_repeat for k, r in got.items()} == {1: 1000, 2: 101, 3: 100, 4: 0}
    assert not any(r.base_failed or 10 * r.repeat_chars > 3 * r.word_chars for r in got.values())
    assert {k: r.kept for k, r in got.items()} == {1: False, 2: False, 3: True, 4: True}


# ------------------------------------------------------------------ 2


def test_identifiers_over_several_hops(spark):
    member = [f"MBR-{n * 977:06d}" for n in range(1, 7)]
    desk = [f"MBR-{n * 613 + 500_000:06d}" for n in range(6)]
    docs = [(n, f"foo bar my member number x{n}@y.org thanks a lot") for n in range(8)]
    docs += [(100 + n, f"foo bar my member number {v} thanks a lot") for n, v in enumerate(member)]
    # No fixed kind ever stands in the two other forms; they meet the first one through found values only.
    docs += [(200 + n, f"we took form sheet {v} from the desk") for n, v in enumerate([*member, *desk[:2]])]
    docs += [(300 + n, f"seen under old entry {v} since last year") for n, v in enumerate([*member, *desk])]
    docs += [(400 + n, f"the price was about {n * 7919 + 100_000} in all") for n in range(9)]
    got = {r.doc_id: r for r in private_data.personal_data(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for d, text in docs:
        value = next((w for w in text.split() if w.startswith("MBR-")), None)
        assert got[d].n_found == (value is not None), text
        if value:
            assert got[d].spans == f"id:{text.index(value)}:{text.index(value) + len(value)}"


def test_credentials_are_seeds_of_their_contexts(spark):
    keys = [f"{n * 0x9E3779B97F4A7C15 + 7:040x}" for n in range(1, 7)]
    docs = [(n, f'some words and token = "{k}" more words') for n, k in enumerate(keys)]
    # Found by the context alone, as no shape fits; a lone key in no known context is not named.
    docs += [(50, 'here token = "pass-77-word" follows'), (51, f"the commit {keys[0][::-1]} was late"), (52, "it cost 1234567 in all")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in private_data.personal_data(frame).collect()}
    for d, text in docs[: len(keys) + 1]:
        start = text.index('"') + 1
        assert got[d].spans == f"id:{start}:{text.index(chr(34), start)}"
    assert got[51].n_found == got[52].n_found == 0
    assert all(r.n_found == 0 for r in private_data.personal_data(frame, seed_shapes=()).collect())


# ------------------------------------------------------------------ 4


def test_exact_copies_of_short_lines_go(spark):
    docs = [(1, "Contents\nSee also\n---\n\nan own line of words"), (2, "contents!\nsee, also\n---\n\nsee alsos"), (3, "日本語の行\nSee\nSee"), (4, "日本語の行\nan own line of words")]
    got = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in got} == {1: docs[0][1], 2: "---\n\nsee alsos", 3: "日本語の行\nSee", 4: ""}


def gone_lines(spark, docs):
    source = spark.createDataFrame(docs, "row long, text string").selectExpr("row", "xxhash64(text) as tie", "text")
    return {r.row for r in line_dedup.removed_lines(source).collect()}


@pytest.mark.parametrize("block_rows", [1024, 8])
def test_lines_beyond_the_two_named_in_a_block_are_held_too(spark, monkeypatch, block_rows):
    # All lines of a block are close by SimHash. Long words part them by edit similarity but for twins, which need not name each other.
    monkeypatch.setattr(line_dedup, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(line_dedup, "TEXT_ROWS", block_rows)
    monkeypatch.setattr(line_dedup, "SAMPLE", 1)
    rng = random.Random(4)
    shared = "a b c d e f g h"
    names = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30)) for _ in range(60)]
    docs = [(k, f"{shared} {name}") for k, name in enumerate(names)] + [(100 + k, f"{shared} {name}x") for k, name in enumerate(names)]
    assert gone_lines(spark, docs) == {d for d, _ in docs if d >= 100}


def test_long_lines_meet_in_any_block(spark):
    rng = random.Random(8)
    lines = {k: ["".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(200)] for k in range(20)}
    docs = [(k, " ".join(line)) for k, line in lines.items()]
    source = spark.createDataFrame(docs, "row long, text string").withColumn("tie", F.lit(0).cast("long"))
    for r in line_dedup.line_rows(source, 3).collect():
        keys = [k % 2**64 for k in r.blocks]
        assert len(keys) == 50
        other = list(lines[r.row])
        # Spoilt are the blocks of the five smallest keys of each half, counted from the start and from the end.
        for half in (0, 25):
            for j in sorted(range(25), key=lambda k: keys[half + k])[:5]:
                other[j * 4 if half == 0 else 196 - j * 4] = "of"
        docs.append((1000 + r.row, " ".join(other)))
    assert gone_lines(spark, docs) == {d for d, _ in docs if d >= 1000}


def test_one_text_against_many(spark):
    rng = random.Random(3)
    for _ in range(300):
        text, *others = (" ".join("".join(rng.choice("abé ") for _ in range(rng.randrange(1, 120))).split()) or "a" for _ in range(5))
        distances = [line_dedup._edit_distance(text, other) for other in others]
        for limit in (0, 7, 20, 45):
            assert line_dedup.within_edits_each(text, others, [limit] * 4).tolist() == [d <= limit for d in distances]


def test_lines_meet_their_texts_once_whatever_the_size_of_a_block(spark, monkeypatch):
    # The texts of a large block's lines were fetched for each pair of stripes, which grew with the square of the block.
    joined = []
    met = line_dedup._met

    def counted(rows, large, compare, schema):
        if "text" in rows.columns:
            joined.append((rows.count(), rows.select("bucket", "node").distinct().count()))
        return met(rows, large, compare, schema)

    monkeypatch.setattr(line_dedup, "_met", counted)
    test_lines_beyond_the_two_named_in_a_block_are_held_too(spark, monkeypatch, 8)
    assert joined and all(rows == different for rows, different in joined)


def test_overlaps_without_ids_and_with_shared_ids(spark, monkeypatch):
    monkeypatch.setattr(contamination, "HITS", 3)
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
    docs = spark.createDataFrame(
        [(None, f"before {item} after"), (None, "nothing of that kind"), (7, f"{item} again"), (7, "a clean text"), (8, None)],
        "doc_id long, text string",
    ).withColumn("row", F.lit("kept"))
    # The phrase stands in many items, some without an id.
    items = spark.createDataFrame([(k if k < 20 else None, f"{item} number {k}") for k in range(25)], "item_id long, text string")
    got = contamination.overlaps(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(d, i) for d in (None, 7) for i in (*range(20), None)}
    left = contamination.without_overlaps(docs, items)
    assert left.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in left.collect()) == [("7", "a clean text"), ("8", "None"), ("None", "nothing of that kind")]
