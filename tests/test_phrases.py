import random

from pyspark.sql import functions as F

from rolecast.functions.regex import phrase_pattern, skill_name_pattern, word_tokens
from rolecast.plans.phrases import may_hold

COMMON = ["no", "the", "of", "a"]
RARE = [f"rare{k}" for k in range(40)]


def held(texts, phrases, pattern):
    """Every text against every phrase."""
    pairs = texts.join(phrases.select("phrase", pattern(F.col("phrase")).alias("pattern")))
    return {(r.id, r.phrase) for r in pairs.filter(F.expr("text rlike pattern")).select("id", "phrase").collect()}


def test_nothing_is_lost_and_common_words_are_no_keys(spark):
    rng = random.Random(4)
    rows = [(n, " ".join([*rng.choices(COMMON, k=30), *rng.choices(RARE, k=2), *rng.choices(COMMON, k=5)])) for n in range(400)]
    phrases = [f"no {r}" for r in RARE] + [f"the {r} of" for r in RARE[:10]] + ["the unseen", "no of the"]
    texts = spark.createDataFrame(rows, "id long, text string")
    wanted = spark.createDataFrame([(p,) for p in phrases], "phrase string")
    met = may_hold(texts.select("id", word_tokens(F.col("text")).alias("tokens")), ["id"], wanted, "phrase")
    found = {(r.id, r.phrase) for r in met.collect()}
    assert found >= held(texts, wanted, phrase_pattern)
    # A phrase with a rare word meets the texts of that word only, although all texts hold "no" and "the".
    words = {n: set(text.split()) for n, text in rows}
    assert {(n, p) for n, p in found if p != "no of the"} == {
        (n, p) for n in words for p in phrases if p != "no of the" and set(p.split()) - set(COMMON) <= words[n]
    }


def test_letters_that_patterns_take_for_others(spark):
    rows = [
        (1, "\u0130stanbul office"), (2, "STANBUL"), (3, "\u0131n house"), (4, "bo\u017fs"), (5, "\u212aelvin"),
        (6, "ABC \u03a3\u039f\u03a3 x"), (7, "\u03c3\u03bf\u03c2"), (8, "C++ and C#, .NET"), (9, "\u65e5\u672c\u8a9e only"),
        (10, "\u00dfcat"), (11, None), (12, ""),
    ]
    phrases = ["istanbul", "in house", "boss", "kelvin", "\u03c3\u03bf\u03c3", "\u03a3\u039f\u03a3", "c++", ".net", "C#", "\u65e5\u672c\u8a9e", "cat", "+", "stanbul"]
    texts = spark.createDataFrame(rows, "id long, text string")
    wanted = spark.createDataFrame([(p,) for p in phrases], "phrase string")
    met = may_hold(texts.select("id", word_tokens(F.col("text")).alias("tokens")), ["id"], wanted, "phrase")
    found = {(r.id, r.phrase) for r in met.collect()}
    for pattern in (phrase_pattern, skill_name_pattern):
        right = held(texts, wanted, pattern)
        assert right <= found, right - found
    assert (1, "istanbul") in right and (4, "boss") in right and (10, "cat") in found


def test_no_phrases_or_no_texts(spark):
    texts = spark.createDataFrame([(1, "a b")], "id long, text string").select("id", word_tokens(F.col("text")).alias("tokens"))
    none = spark.createDataFrame([], "phrase string")
    assert may_hold(texts, ["id"], none, "phrase").count() == 0
    assert may_hold(texts.filter("id > 1"), ["id"], none.union(spark.createDataFrame([("a",)], "phrase string")), "phrase").count() == 0
