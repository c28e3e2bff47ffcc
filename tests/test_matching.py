from datetime import datetime

import pytest
from pyspark.sql import functions as F

from checks import queries as q
from checks import tables as t
from rolecast.functions.skills import Taxonomy, match_skills
from rolecast.operators import matching, preparation, store
from rolecast.operators.shortlist import shortlist

SF = "/root/testdata/sf0.001"


def test_skill_names(spark):
    text = "C++, C# and C; Node.js, .NET and ASP.NET Core. go Golang react.js JavaScript Java SQL Server oracle sql k8s. Google R"
    names = ["C++", "C#", "C", ".NET", "ASP.NET Core", "JavaScript", "Java", "SQL", "SQL Server", "R"]
    spellings = [("Node.js", ["NodeJS"]), ("Go", ["Golang"]), ("React", ["React.js"]), ("Oracle", ["Oracle SQL"]), ("Kubernetes", ["K8s"])]
    taxonomy = Taxonomy.of([(n, [], "any") for n in names] + [(n, other, "any") for n, other in spellings])
    df = spark.createDataFrame([(text,)], "t string")
    found = df.select(match_skills(F.col("t"), taxonomy).alias("s")).first().s
    assert found == ["C++", "C#", "C", "Node.js", ".NET", "ASP.NET Core", "Go", "React", "JavaScript", "Java", "SQL Server", "Oracle", "Kubernetes", "R"]


def test_repeated_alias_is_refused():
    with pytest.raises(ValueError):
        Taxonomy.of([("Go", ["Golang"], "language"), ("GOLANG", [], "language")])


def test_title_levels(spark):
    cases = {"Junior Developer": 2, "Head of Data": 5, "Sr. Consultant": 3, "Cook": None, "Associate": 1, "Internal": None, "Intern": 0}
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    for r in df.select("t", matching.title_level(F.col("t")).alias("l")).collect():
        assert r.l == cases[r.t]


def test_flags_and_pay_never_change_a_score(spark):
    jobs, people, pairs = q.postings(spark, SF), t.profiles(spark, SF), t.pairs(spark, SF)
    plain = matching.score_pairs(pairs, jobs, people, q.taxonomy())
    bare = jobs.withColumns({"discriminatory_flags": F.slice("discriminatory_flags", 1, 0), "flags": F.slice("flags", 1, 0)})
    again = matching.score_pairs(pairs, bare, people, q.taxonomy())
    columns = ["job_id", "profile_id", "fit_score", "confidence"]
    assert plain.select(columns).exceptAll(again.select(columns)).count() == 0


def test_blocked_pairs_are_capped(spark):
    rows = q.q_fit_scores(spark, SF)
    assert rows.filter("blockers > 0").count() > 0
    assert rows.filter("blockers > 0 AND fit_score > 0.3").count() == 0


def test_evidence_is_part_of_its_field(spark):
    people = t.profiles(spark, SF)
    wanted = matching.wanted_skills(matching.job_features(q.postings(spark, SF), q.taxonomy()))
    evidence = preparation.skill_evidence(people, wanted)
    assert evidence.count() > 0 and preparation.verify_evidence(evidence, people).count() == 0
    assert evidence.filter(F.length("text") > 300).count() == 0


def test_pages_walk_the_table_once(spark):
    jobs = q.postings(spark, SF)
    seen, cursor = [], None
    while True:
        page = store.list_postings(jobs, page_size=45, cursor=cursor).orderBy(F.desc("ingested_at"), F.desc("job_id")).collect()
        seen += [r.job_id for r in page]
        cursor = page[-1].next_cursor
        if cursor is None:
            break
    wanted = [r.job_id for r in store.newest_first(jobs).select("job_id").collect()]
    assert seen == wanted


def test_cursor(spark):
    job = "job_00000001-0000-4000-8000-000000000001"
    cursor = store.encode_cursor(datetime(2024, 1, 2, 3, 4, 5, 678000), job)
    assert store.decode_cursor(cursor) == ("2024-01-02T03:04:05.678000Z", job)
    for bad in ("%%%", "bm90IGpzb24", "eyJqb2JfaWQiOiJ4In0"):
        with pytest.raises(ValueError):
            store.decode_cursor(bad)


def test_empty_filter_lists(spark):
    jobs = q.postings(spark, SF)
    empty = {"remote_mode": []}
    assert store.filter_postings(jobs, empty).count() == jobs.count()
    assert store.filter_postings(jobs, empty, empty_excludes=True).count() == 0
    assert shortlist(jobs, t.profiles(spark, SF), q.taxonomy(), empty).count() == 0


def test_retention_edges(spark):
    rows = [("a", "standard_180d", "2024-01-01 00:00:00"), ("b", "standard_180d", "2023-12-31 23:59:59"), ("c", "session", "2024-06-01 00:00:00"),
            ("d", "pinned", "2000-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "job_id string, retention_class string, at string").withColumn("ingested_at", F.to_timestamp("at"))
    kept, counts = store.apply_retention(df, F.lit("2024-06-29 00:00:00").cast("timestamp"))
    assert {r.job_id for r in kept.collect()} == {"a", "d"}
    assert tuple(counts.first()) == (1, 1)


def test_no_pairing_of_postings_without_a_key(spark):
    for query in (q.q_near_duplicate_pairs, q.q_fit_scores, q.q_shortlist):
        plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_long_postings_are_not_cut(spark):
    from pyspark.sql import functions as F

    from checks import queries as q
    from rolecast.operators import requirements
    from rolecast.operators.ingest import shown

    lines = "\n".join(f"- Must know tool {n} with Python" for n in range(150))
    tail = "word " * 120 + "Kubernetes required"
    flags = "\n".join("only male candidates" for _ in range(60))
    body = f"Requirements:\n{lines}\n- {tail}\n{flags}\n" + "\n".join("- notice period 30 days" for _ in range(70))
    posting = spark.createDataFrame([("j", body)], "job_id string, description string")
    row = requirements.posting_skills(requirements.extract_requirements(posting, q.taxonomy())).select(
        F.size("must_have").alias("must"), F.size("discriminatory_flags").alias("flags"), F.size("constraints").alias("constraints"),
        "required_skills", shown(F.col("must_have"), 100).alias("few"),
    ).first()
    assert (row.must, row.flags, row.constraints) == (151, 60, 70)
    assert "Kubernetes" in row.required_skills and len(row.few) == 100


def test_no_join_takes_place_once_dimensions_are_made(spark):
    scored = matching.score_pairs(t.pairs(spark, SF), q.postings(spark, SF), t.profiles(spark, SF), q.taxonomy())
    lines = scored._jdf.queryExecution().optimizedPlan().toString().splitlines()
    made = max(n for n, line in enumerate(lines) if "must_have_skills" in line)
    assert not [line for line in lines[:made] if "Join" in line]


@pytest.mark.parametrize("name", list(matching.DIMENSIONS))
def test_skills_are_looked_up_for_dimensions_that_read_them(spark, monkeypatch, name):
    asked = []
    look_up = matching.profile_skill_hits
    monkeypatch.setattr(matching, "profile_skill_hits", lambda *a: asked.append(name) or look_up(*a))
    q._features(spark, SF, (name,))
    assert bool(asked) == (name in ("must_have_skills", "preferred_skills", "domain"))


def test_reasons_of_pairs_are_those_of_their_dimensions(spark):
    from checks import queries
    from rolecast.operators.shortlist import match_reasons, pair_reasons

    features = queries._features(spark, "/root/testdata/sf0.001")
    whole = matching.match_dimensions(features).select("job_id", "profile_id", match_reasons(F.col("dimensions")).alias("reasons"))
    short = pair_reasons(features)
    assert short.count() > 100 and short.exceptAll(whole).isEmpty() and whole.exceptAll(short).isEmpty()


def test_pairs_are_not_dealt_out_by_phrase(spark):
    from checks import tables
    from checks.queries import postings

    sf_dir = "/root/testdata/sf0.001"
    found = matching.deal_breakers(tables.pairs(spark, sf_dir), postings(spark, sf_dir), tables.profiles(spark, sf_dir))
    # The lists of both sides and the pairs themselves are grouped, not the pairs by phrase.
    assert not any("collect_list" in line and "job_id" in line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert found.filter("size(blockers) = 0").isEmpty()


def test_readers_of_scores_build_no_texts(spark):
    for query in (q.q_fit_scores, q.q_match_violations):
        assert "corresponds to profile" not in query(spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_scores_added_up_from_columns_are_those_of_the_dimensions(spark):
    jobs, people, pairs = q.postings(spark, SF), t.profiles(spark, SF), t.pairs(spark, SF)
    made = matching.fit_scores(matching.match_dimensions(q._features(spark, SF)), matching.deal_breakers(pairs, jobs, people))
    summed = matching.score_pairs(pairs, jobs, people, q.taxonomy())
    columns = ["job_id", "profile_id", "fit_score", "band", "confidence", "warning_codes", "dimensions"]
    assert made.select(columns).exceptAll(summed.select(columns)).isEmpty() and summed.count() == made.count() > 100
