"""Nulls, empty texts and tables, repeated rows and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rolecast.llm.chunk_dedup import repeated_passages
from rolecast.llm.contamination import overlaps
from rolecast.llm.language import identify_languages
from rolecast.llm.line_dedup import dedup_lines
from rolecast.llm.near_dup import first_documents, near_duplicates
from rolecast.llm.packing import pack
from rolecast.llm.page_text import page_texts
from rolecast.llm.private_data import personal_data
from rolecast.llm.quality_sampling import importance_sample
from rolecast.llm.repetition import repetition_rules
from rolecast.llm.target_resampling import resample
from rolecast.llm.url_rules import RULES, rule_table, url_verdicts

LONG = " ".join(f"w{n}" for n in range(20_000))
ROWS = [(1, "one two three four five"), (2, None), (3, ""), (4, " \n\t"), (None, "x y z"), (None, None), (5, "again"), (5, "again"), (5, "other"), (6, LONG)]
#: Names that the operators use inside; they must not meet.
CLASHES = ["row", "tie", "kind", "fp", "lines", "length", "label", "node", "hash", "carried", "kept", "id", "cut", "key", "rank"]
LABELS = [(1, 1), (5, 0), (None, 1)]


def documents(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("c").alias(c) for c in CLASHES])


def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int")


def benchmark(spark):
    return spark.createDataFrame([(1, "one two three four five"), (2, None), (3, ""), (None, "x y z")], "item_id long, text string")


OPERATORS = {
    "op1": (lambda s, d: importance_sample(d, labels(s), F.col("quality") == 1, k=100), 10),
    "op2": (lambda s, d: personal_data(d), 10),
    "op3": (lambda s, d: overlaps(d, benchmark(s)), 1),
    "op4": (lambda s, d: dedup_lines(d, carry=("kind",)), 10),
    "op6": (lambda s, d: pack(d), None),
    "op7": (lambda s, d: repeated_passages(d), 0),
    "op8": (lambda s, d: repetition_rules(d, carry=("kept",)), 10),
    "op9": (lambda s, d: near_duplicates(d), 10),
    "op11": (lambda s, d: resample(d, benchmark(s)), 10),
    "op12": (lambda s, d: identify_languages(d.withColumn("lang", F.when(F.col("doc_id") < 4, "en").when(F.col("doc_id") < 6, "de"))), 10),
    "first_documents": (lambda s, d: first_documents(d), 6),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    operator, rows = OPERATORS[name]
    got = operator(spark, documents(spark)).collect()
    assert rows is None or len(got) == rows
    assert operator(spark, documents(spark, [])).collect() == []


def test_near_duplicates_of_wordless_texts(spark):
    got = near_duplicates(documents(spark)).collect()
    zero = [r for r in got if r.fingerprint == "0" * 16]
    assert len(zero) == 4 and {r.component_id for r in zero} == {2}


def test_pages(spark):
    rows = [(1, None, None), (2, "http://a.example/x", ""), (2, "http://a.example/x", ""), (None, "no url", "<p>a<p>b"), (3, "http://a.example/y", "<div>" * 3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *[F.lit("c").alias(c) for c in ["key", "host", "path", "lines", "text"]])
    got = page_texts(pages).collect()
    assert sorted(r.text for r in got) == ["", "", "", "", "a\nb"] and all(r.n_chars == len(r.text) for r in got)
    assert page_texts(pages.limit(0)).collect() == []
    rules = rule_table(spark, RULES)
    assert url_verdicts(pages, rules).count() == 5 and url_verdicts(pages.limit(0), rules).count() == 0
    assert url_verdicts(pages, rules.limit(0)).filter("rule is not null").count() == 0


def test_stages_of_the_pipeline(spark, tmp_path):
    benchmark(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(n, t, None, "s", 1) for n, t in [*ROWS, (7, "a clean text " * 3 + " ".join(f"v{k}" for k in range(40)))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("kept", F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == corpus_pipeline.COLUMNS
    assert sorted(r.doc_id for r in docs.collect()) == [6, 7]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {r.doc_id for r in pieces.collect()} == {6, 7}
