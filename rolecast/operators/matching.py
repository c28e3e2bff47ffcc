"""Seven explainable dimensions and the fit score of (posting, profile) pairs.

Pairs are a table. Posting and profile features are computed once per posting and
once per profile and joined by id; every dimension is then an expression over one
row, so nothing is exploded or regrouped per pair.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecast.functions.regex import (
    js_trim,
    phrase_pattern,
    rx,
    skill_name_pattern,
    word_tokens,
    words,
)
from rolecast.functions.similarity import round2
from rolecast.functions.skills import Taxonomy, skill_category
from rolecast.plans.phrases import may_hold
from rolecast.session import cut_lineage

SCORING_VERSION = "fit-v1"
DISCLAIMER = "Decision support only; not a prediction of hiring outcome."

# Weight of each dimension, in reporting order.
WEIGHTS: Mapping[str, float] = {
    "must_have_skills": 0.35,
    "experience": 0.20,
    "preferred_skills": 0.10,
    "seniority": 0.10,
    "location_remote": 0.10,
    "employment_type": 0.05,
    "domain": 0.10,
}
# Title levels, first match wins ("Junior Developer" is a developer).
TITLE_LEVELS = (
    (5, "head|director|vp"),
    (4, "lead|principal|staff|architect|manager"),
    (3, "senior|sr"),
    (2, "engineer|developer|analyst|consultant"),
    (1, "junior|associate"),
    (0, "intern|trainee"),
)
PROFILE_LEVEL_YEARS = (1, 3, 6, 10, 15)
CITY_SYNONYMS = {
    "bangalore": "bengaluru",
    "gurgaon": "gurugram",
    "calcutta": "kolkata",
    "bombay": "mumbai",
    "madras": "chennai",
    "mysore": "mysuru",
    "cochin": "kochi",
    "trivandrum": "thiruvananthapuram",
    "baroda": "vadodara",
}
BLOCKED_SCORE = 0.3
STRONG, MODERATE = 0.75, 0.5
LOW_CONFIDENCE = 0.6
LISTED_TEXT = 500

DIMENSION = "struct<name:string,weight:double,score:double,status:string,evidence:array<string>,gaps:array<string>>"


# ---------------------------------------------------------------- features


def canonical_city(raw: Column) -> Column:
    city = F.lower(js_trim(F.coalesce(raw, F.lit(""))))
    city = F.regexp_replace(city, rx(r"\s*\([^)]*\)"), "")
    city = F.regexp_replace(city, rx(r"\s*[-/|–—].*\z"), "")
    city = js_trim(F.regexp_replace(city, "[.,]", ""))
    synonyms = F.create_map(*[F.lit(x) for pair in CITY_SYNONYMS.items() for x in pair])
    return F.coalesce(F.try_element_at(synonyms, city), city)


def title_level(title: Column) -> Column:
    level = F.lit(None).cast("int")
    for value, pattern in reversed(TITLE_LEVELS):
        level = F.when(title.rlike(words(pattern)), value).otherwise(level)
    return level


def profile_level(years: Column) -> Column:
    level = F.lit(len(PROFILE_LEVEL_YEARS))
    for value, below in reversed(list(enumerate(PROFILE_LEVEL_YEARS))):
        level = F.when(years < below, value).otherwise(level)
    return level


def job_features(postings: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """What the dimensions read of a posting with extracted requirements."""

    def asked(requirements: str, fallback: str) -> Column:
        listed = F.flatten(F.transform(requirements, lambda r: r.skills))
        return F.array_distinct(F.when(F.size(listed) > 0, listed).otherwise(F.col(fallback)))

    every = F.concat(
        F.flatten(F.transform("must_have", lambda r: r.skills)),
        F.flatten(F.transform("preferred", lambda r: r.skills)),
        F.col("required_skills"),
        F.col("preferred_skills"),
    )
    known = F.transform(
        F.array_distinct(every),
        lambda s: F.struct(s.alias("skill"), skill_category(s, taxonomy).alias("category")),
    )
    return postings.select(
        "job_id",
        asked("must_have", "required_skills").alias("must_skills"),
        asked("preferred", "preferred_skills").alias("preferred_asked"),
        F.filter(known, lambda k: js_trim(k.category) != "").alias("domain_skills"),
        F.col("experience.min_years").alias("min_years"),
        F.col("experience.max_years").alias("max_years"),
        title_level(F.col("title")).alias("title_level"),
        F.col("location.city").alias("city"),
        canonical_city(F.col("location.city")).alias("city_key"),
        "remote_mode",
        "employment_type",
    )


def wanted_skills(features: DataFrame) -> DataFrame:
    """Distinct skills any posting asks for; never more than the taxonomy holds plus free names."""
    named = F.concat(
        "must_skills", "preferred_asked", F.transform("domain_skills", lambda d: d.skill)
    )
    return features.select(F.explode(named).alias("skill")).distinct()


def profile_skill_hits(profiles: DataFrame, skills: DataFrame) -> DataFrame:
    """(profile_id, skill) where the profile lists the skill or names it in a role.

    A skill name can only occur in a text that holds each of its words whole, so skills and texts
    meet on the rarest of them and only those few are matched by pattern.
    """
    wanted = cut_lineage(skills.select("skill")).select(
        "skill",
        F.lower(js_trim(F.col("skill"))).alias("folded"),
        skill_name_pattern(F.col("skill")).alias("pattern"),
    ).filter("folded <> ''")
    listed = profiles.select("profile_id", F.explode("skills.name").alias("name")).select(
        "profile_id", F.lower(js_trim(F.col("name"))).alias("folded")
    )
    by_name = listed.join(wanted, "folded").select("profile_id", "skill")
    texts = profiles.select("profile_id", F.posexplode("roles").alias("role_no", "role")).select(
        "profile_id",
        "role_no",
        F.posexplode(F.concat(F.array("role.title"), F.coalesce("role.highlights", F.array().cast("array<string>")))).alias("no", "text"),
    )
    place = ["profile_id", "role_no", "no"]
    # Words meet skills without the texts; a text is fetched once per skill it may name.
    worded = texts.select(*place, word_tokens(F.col("text")).alias("tokens"))
    met = may_hold(worded, place, wanted.select("skill", "pattern"), "skill")
    by_text = met.join(texts, place).filter(F.expr("text rlike pattern")).select("profile_id", "skill")
    return by_name.unionByName(by_text).distinct()


def profile_features(profiles: DataFrame, hits: DataFrame | None) -> DataFrame:
    """What the dimensions read of a profile; ``has`` is bounded by the skill vocabulary.

    Without ``hits``, for dimensions that read no skills, there is no ``has``.
    """
    none = F.array().cast("array<string>")

    def listed(name: str) -> Column:
        return F.coalesce(F.col(f"preferences.{name}"), none)

    features = profiles.select(
        "profile_id",
        F.col("total_experience_years").alias("years"),
        profile_level(F.col("total_experience_years")).alias("profile_level"),
        listed("locations").alias("locations"),
        F.transform(listed("locations"), canonical_city).alias("location_keys"),
        listed("remote_modes").alias("remote_modes"),
        listed("employment_types").alias("employment_types"),
    )
    if hits is None:
        return features
    owned = hits.groupBy("profile_id").agg(F.collect_set("skill").alias("has"))
    return features.join(owned, "profile_id", "left").withColumn("has", F.coalesce("has", none))


def pair_features(pairs: DataFrame, jobs: DataFrame, profiles: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Join the features to the requested (job_id, profile_id) pairs. Profiles are the smaller
    side; the optimizer broadcasts them when their measured size allows. Postings, the wide side, come last."""
    return pairs.select("job_id", "profile_id", *carry).join(profiles, "profile_id").join(jobs, "job_id")


# ---------------------------------------------------------------- dimensions


def _listed(*texts: Column) -> Column:
    return F.transform(F.array(*texts), lambda t: F.left(t, F.lit(LISTED_TEXT)))


_NOTHING = "array<string>"
#: The score of a dimension, and its evidence and gaps by the column that holds the score.
Parts = tuple[Column, Callable[[Column], tuple[Column, Column]]]


def _dimension(name: str, score: Column, evidence: Column, gaps: Column) -> Column:
    """Assemble a dimension. A null score is unknown and lists nothing."""
    none = F.array().cast(_NOTHING)
    status = (
        F.when(score.isNull(), "unknown").when(score == 1, "matched").when(score > 0, "partial").otherwise("missing")
    )
    return F.struct(
        F.lit(name).alias("name"),
        F.lit(WEIGHTS[name]).alias("weight"),
        score.cast("double").alias("score"),
        status.alias("status"),
        F.coalesce(F.when(score.isNotNull(), evidence), none).alias("evidence"),
        F.coalesce(F.when(score.isNotNull(), gaps), none).alias("gaps"),
    ).cast(DIMENSION)


def _split(name: str) -> dict[str, Column]:
    """The skills asked for, each once, that the profile has, and the others; columns of their own, as several expressions read them."""
    skills, has = F.col(ASKED[name]), F.col("has")
    if name == "domain":
        found = F.filter(skills, lambda s: F.array_contains(has, s.skill))
        lacking = F.filter(skills, lambda s: ~F.array_contains(has, s.skill))
    else:
        found, lacking = F.array_intersect(skills, has), F.array_except(skills, has)
    return {f"_covered_{name}": found, f"_missing_{name}": lacking}


def skill_labels(name: str, items: Column) -> Column:
    def label(s: Column) -> Column:
        return F.concat(s.skill, F.lit(" ("), s.category, F.lit(")")) if name == "domain" else s

    return F.transform(items, lambda s: F.left(label(s), F.lit(LISTED_TEXT)))


def _coverage(name: str) -> Parts:
    skills, covered, missing = F.col(ASKED[name]), F.col(f"_covered_{name}"), F.col(f"_missing_{name}")
    score = F.when(F.size(skills) > 0, round2(F.size(covered) / F.size(skills)))
    return score, lambda score: (skill_labels(name, covered), skill_labels(name, missing))


def _plain_number(value: Column) -> Column:
    return F.when(value == F.floor(value), value.cast("bigint").cast("string")).otherwise(value.cast("string"))


def dim_experience() -> Parts:
    low, high, years = F.col("min_years"), F.col("max_years"), F.col("years")
    below = F.coalesce(years < low, F.lit(False))
    above = F.coalesce(years > high, F.lit(False))
    short = round2(F.greatest(F.lit(0.0), 1 - (low - years) / F.greatest(low, F.lit(1))))
    over = F.when(years - high <= 2, F.lit(1.0)).otherwise(
        round2(F.greatest(F.lit(0.5), 1 - (years - high - 2) * 0.1))
    )
    score = F.when(
        low.isNotNull() | high.isNotNull(), F.when(below, short).when(above, over).otherwise(F.lit(1.0))
    )
    owned = _plain_number(years)
    top = F.coalesce(high.cast("string"), F.lit("any"))
    wanted = F.concat(F.coalesce(low.cast("string"), F.lit("0")), F.lit("-"), top)
    fits = _listed(F.concat(F.lit("Profile experience ("), owned, F.lit("y) vs JD requirements ("), wanted, F.lit("y)")))
    gap = F.when(
        below,
        F.concat(
            F.lit("Profile experience ("), owned, F.lit("y) is below minimum requirement ("), low.cast("string"), F.lit("y)")
        ),
    ).otherwise(
        F.concat(F.lit("Profile experience ("), owned, F.lit("y) exceeds maximum requirement ("), top, F.lit("y)"))
    )
    return score, lambda score: (F.when(score > 0, fits), F.when(score < 1, _listed(gap)))


def dim_seniority() -> Parts:
    diff = F.abs(F.col("profile_level") - F.col("title_level"))
    score = F.when(
        F.col("title_level").isNotNull(), round2(F.greatest(F.lit(0.0), 1 - F.lit(0.34) * diff))
    )
    evidence = F.format_string(
        "Title level %d corresponds to profile experience level %d", F.col("title_level"), F.col("profile_level")
    )
    gap = F.format_string("Seniority difference of %d level(s)", diff)
    return score, lambda score: (F.when(score > 0, _listed(evidence)), F.when(score < 1, _listed(gap)))


def dim_location() -> Parts:
    mode, city = F.col("remote_mode"), F.col("city")
    mode_known = mode != "unknown"
    city_known = F.coalesce(js_trim(city) != "", F.lit(False))
    stated = (F.size("locations") > 0) | (F.size("remote_modes") > 0)
    mode_wanted = F.array_contains("remote_modes", mode)
    same_city = (F.col("city_key") != "") & F.array_contains("location_keys", F.col("city_key"))
    score = F.when(
        stated & (city_known | mode_known),
        F.when((mode == "remote") & mode_wanted, 1.0).when(same_city, 1.0).when(mode_known & mode_wanted, 0.5).otherwise(0.0),
    )
    subject = F.concat(
        F.lit("Job remote mode '"), mode, F.lit("' and location '"), F.coalesce(city, F.lit("unspecified")), F.lit("' ")
    )
    good = _listed(F.concat(subject, F.lit("match preferences")))
    bad = _listed(F.concat(subject, F.lit("do not match preferences")))
    return score, lambda score: (F.when(score > 0, good), F.when(score == 0, bad))


def dim_employment() -> Parts:
    kind = F.col("employment_type")
    wanted = F.array_contains("employment_types", kind)
    score = F.when((kind != "unknown") & (F.size("employment_types") > 0), F.when(wanted, 1.0).otherwise(0.0))
    good = F.array(F.concat(F.lit("Employment type '"), kind, F.lit("' matches preference")))
    bad = F.array(F.concat(F.lit("Job employment type '"), kind, F.lit("' not in preferred types")))
    return score, lambda score: (F.when(score == 1, good), F.when(score == 0, bad))


#: The column of skills that a dimension asks for; these dimensions read which skills a profile has.
ASKED = {"must_have_skills": "must_skills", "preferred_skills": "preferred_asked", "domain": "domain_skills"}
SKILL_DIMENSIONS = tuple(ASKED)
DIMENSIONS: dict[str, Callable[[], Parts]] = {
    "must_have_skills": lambda: _coverage("must_have_skills"),
    "experience": dim_experience,
    "preferred_skills": lambda: _coverage("preferred_skills"),
    "seniority": dim_seniority,
    "location_remote": dim_location,
    "employment_type": dim_employment,
    "domain": lambda: _coverage("domain"),
}


def with_scores(features: DataFrame, names: Sequence[str] = tuple(WEIGHTS)) -> DataFrame:
    """Joined pair features with the skills that are covered and missing, and a score, of each dimension.

    These are columns, not parts of longer expressions: list functions are not compiled, and within one
    expression each mention of a score would work out its lists again.
    """
    split = {c: e for name in names if name in ASKED for c, e in _split(name).items()}
    rows = features.withColumns(split) if split else features
    return rows.withColumns({f"_score_{name}": DIMENSIONS[name]()[0].cast("double") for name in names})


def built_dimensions(names: Sequence[str] = tuple(WEIGHTS), texts: bool = True) -> Column:
    """The dimensions of a row of ``with_scores``; without ``texts`` evidence and gaps are left empty."""
    def built(name: str) -> Column:
        score = F.col(f"_score_{name}")
        listed = DIMENSIONS[name]()[1](score) if texts else (F.lit(None), F.lit(None))
        return _dimension(name, score, *listed)

    return F.array(*map(built, names))


def match_dimensions(features: DataFrame, names: tuple[str, ...] = tuple(WEIGHTS), carry: Sequence[str] = ()) -> DataFrame:
    """(job_id, profile_id, dimensions) for joined pair features; ``carry`` goes along."""
    return with_scores(features, names).select("job_id", "profile_id", *carry, built_dimensions(names).alias("dimensions"))


def dimension_rows(matches: DataFrame) -> DataFrame:
    """Long table of dimensions, one row per pair and dimension."""
    return matches.select("job_id", "profile_id", F.inline("dimensions"))


# ---------------------------------------------------------------- deal-breakers


def deal_breaker_phrases(profiles: DataFrame) -> DataFrame:
    """(profile_id, pos, phrase) of non-blank phrases."""
    return (
        profiles.select("profile_id", F.posexplode("preferences.deal_breakers").alias("pos", "phrase"))
        .withColumn("phrase", js_trim(F.col("phrase")))
        .filter("phrase <> ''")
    )


def phrase_hits(postings: DataFrame, phrases: DataFrame) -> DataFrame:
    """(job_id, phrase) where a posting text holds the phrase as whole words.

    Phrases meet postings on their rarest word; the phrase list is distinct and normally small
    enough for the optimizer to broadcast by measured size.
    """
    wanted = phrases.select("phrase").distinct().select("phrase", phrase_pattern(F.col("phrase")).alias("pattern"))
    texts = F.concat(
        F.array("title", "description"),
        F.transform("must_have", lambda r: r.text),
        F.transform("preferred", lambda r: r.text),
        F.col("responsibilities"),
        F.transform("constraints", lambda c: c.text),
    )
    # A phrase must not reach from one text into the next, so each is searched by itself.
    searched = postings.select("job_id", texts.alias("_texts"))
    tokens = word_tokens(F.array_join("_texts", "\n"))
    # Words meet phrases without the texts; a posting's texts are fetched once per phrase it may hold.
    met = may_hold(searched.select("job_id", tokens.alias("tokens")), ["job_id"], wanted, "phrase")
    found = met.join(searched, "job_id").filter(F.exists("_texts", lambda t: F.rlike(t, F.col("pattern"))))
    return found.select("job_id", "phrase")


def deal_breakers(pairs: DataFrame, postings: DataFrame, profiles: DataFrame) -> DataFrame:
    """(job_id, profile_id, blockers) for pairs with at least one deal-breaker; ``pairs`` are distinct.

    What a profile bars and what a posting holds meet as lists within the row of a pair: no pair is dealt
    out by phrase and grouped again.
    """
    phrases = deal_breaker_phrases(profiles)
    hits = phrase_hits(postings, phrases)
    # A profile has at most a score of phrases; a posting holds no more than its texts have parts.
    barred = phrases.groupBy("profile_id").agg(F.sort_array(F.collect_list(F.struct("pos", "phrase"))).alias("barred"))
    held = hits.groupBy("job_id").agg(F.collect_set("phrase").alias("held"))
    met = pairs.select("job_id", "profile_id").join(barred, "profile_id").join(held, "job_id")

    def message(b: Column) -> Column:
        return F.left(F.concat(F.lit("Deal breaker '"), b.phrase, F.lit("' matched in job listing")), F.lit(LISTED_TEXT))

    found = F.filter("barred", lambda b: F.array_contains("held", b.phrase))
    return met.select("job_id", "profile_id", F.transform(found, message).alias("blockers")).filter("size(blockers) > 0")


# ---------------------------------------------------------------- score


def fit_scores(matches: DataFrame, blockers: DataFrame | None = None) -> DataFrame:
    """Weighted score over the known dimensions, capped where a deal-breaker was found.

    Without ``blockers`` they are a column of ``matches``.
    """
    known = F.filter("dimensions", lambda d: d.score.isNotNull())
    df = matches if blockers is None else matches.join(blockers, ["job_id", "profile_id"], "left")
    return _results(
        df.withColumns(
            {
                "confidence": round2(F.aggregate(known, F.lit(0.0), lambda acc, d: acc + d.weight)),
                "_sum": F.aggregate(known, F.lit(0.0), lambda acc, d: acc + d.score * d.weight),
            }
        )
    )


def _results(df: DataFrame) -> DataFrame:
    """Match results of rows with dimensions, confidence, the weighted ``_sum`` and blockers."""
    none = F.array().cast("array<string>")
    df = df.withColumn("blockers", F.coalesce("blockers", none))
    # The divisor is the rounded confidence.
    score = F.when(F.col("confidence") > 0, round2(F.col("_sum") / F.col("confidence"))).otherwise(F.lit(0.0))
    df = df.withColumn(
        "fit_score", F.when(F.size("blockers") > 0, F.least(score, F.lit(BLOCKED_SCORE))).otherwise(score)
    )
    band = F.when(F.col("fit_score") >= STRONG, "strong").when(F.col("fit_score") >= MODERATE, "moderate").otherwise("weak")
    low = F.when(F.col("confidence") < LOW_CONFIDENCE, F.array(F.lit("LOW_CONFIDENCE"))).otherwise(none)
    return df.select(
        "job_id",
        "profile_id",
        F.lit(SCORING_VERSION).alias("scoring_version"),
        "fit_score",
        band.alias("band"),
        "confidence",
        "dimensions",
        "blockers",
        low.alias("warning_codes"),
        F.lit(DISCLAIMER).alias("disclaimer"),
    )


def score_pairs(pairs: DataFrame, postings: DataFrame, profiles: DataFrame, taxonomy: Taxonomy, texts: bool = True) -> DataFrame:
    """Match results for the requested pairs; without ``texts`` for readers of scores and states alone.

    Scores are added up from their columns: where no dimensions are read, none are built.
    """
    jobs = job_features(postings, taxonomy)
    owners = profile_features(profiles, profile_skill_hits(profiles, wanted_skills(jobs)))
    # Blockers are joined while a pair is two ids; dimensions are many times wider and are never shuffled.
    blocked = pairs.select("job_id", "profile_id").join(deal_breakers(pairs, postings, profiles), ["job_id", "profile_id"], "left")
    rows = with_scores(pair_features(blocked, jobs, owners, ("blockers",)))
    confidence, total = F.lit(0.0), F.lit(0.0)
    for name, weight in WEIGHTS.items():
        score = F.col(f"_score_{name}")
        confidence = confidence + F.when(score.isNotNull(), weight).otherwise(0.0)
        total = total + F.coalesce(score * weight, F.lit(0.0))
    return _results(rows.withColumns({"confidence": round2(confidence), "_sum": total, "dimensions": built_dimensions(texts=texts)}))


def explain_matches(results: DataFrame) -> DataFrame:
    """(job_id, profile_id, summary_facts, dimensions, disclaimer)."""

    def percent(column: str) -> Column:
        return F.floor(F.col(column) * 100 + 0.5).cast("string")

    def count(status: str) -> Column:
        return F.size(F.filter("dimensions", lambda d: d.status == status)).cast("string")

    facts = F.array(
        F.concat(F.lit("Overall fit score: "), percent("fit_score"), F.lit("% ("), F.col("band"), F.lit(" match)")),
        F.concat(F.lit("Confidence level: "), percent("confidence"), F.lit("% based on known job dimensions")),
        F.concat(
            F.lit("Dimension summary: "), count("matched"), F.lit(" matched, "), count("partial"), F.lit(" partial, "),
            count("missing"), F.lit(" missing, "), count("unknown"), F.lit(" unknown"),
        ),
        F.when(
            F.size("blockers") > 0,
            F.concat(
                F.lit("Score capped at 0.30 due to "), F.size("blockers").cast("string"), F.lit(" deal-breaker blocker(s)")
            ),
        ),
    )
    return results.select(
        "job_id",
        "profile_id",
        F.filter(facts, lambda f: f.isNotNull()).alias("summary_facts"),
        F.transform(
            "dimensions", lambda d: F.struct(d["name"].alias("name"), d.evidence.alias("evidence"), d.gaps.alias("gaps"))
        ).alias("dimensions"),
        "disclaimer",
    )
