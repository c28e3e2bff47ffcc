"""Requirements, constraints and flags mined from descriptions.

One posting stays one row throughout; the long tables are exploded from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecast.functions.regex import mentions
from rolecast.functions.sections import classify_item, with_section_items
from rolecast.functions.skills import Taxonomy, match_skills, skill_category
from rolecast.operators.ingest import warning
from rolecast.schemas import WARNING

# First constraint kind that fits an item. The last entry of a row lists text that
# a match is sure to contain.
CONSTRAINTS = (
    ("notice_period", r"\b(?:notice period|immediate joiner|join immediately)\b", "notice period|immediate joiner|join immediately"),
    ("shift", r"\b(?:night shift|rotational shift|shifts?)\b", "shift"),
    ("travel", r"\btravel\b", "travel"),
    ("relocation", r"\b(?:relocat(?:e|ion|ing))\b", "relocat"),
    ("work_authorization", r"\b(?:work authorization|authorized to work|visa|work permit)\b", "authoriz|visa|permit"),
    ("certification", r"\b(?:certification|certified|certificate|pmp)\b", "certif|pmp"),
    ("education", r"\b(?:b\.e\.|b\.tech\b|mca\b|mba\b|bachelor\b|degree\b)", "b.e.|b.tech|mca|mba|bachelor|degree"),
)

# Wording per category; an item is flagged for every category that fits.
DISCRIMINATION = (
    ("age", r"\b(?:age\s*(?:limit|criteria|range|bracket)?\s*[:=]?\s*(?:below|under|above|over|less than|greater than|not exceeding|max|maximum|min|minimum)?\s*\d{1,2}(?:\s*(?:-|–|to|and)\s*\d{1,2})?(?:\s*years?(?:\s*old)?)?|aged?\s*(?:between\s*)?\d{1,2}(?:\s*(?:-|–|to|and)\s*\d{1,2})?(?:\s*years?(?:\s*old)?)?|(?:max|maximum|min|minimum)\s+age\s*[:=]?\s*\d{1,2}|age\s+limit\b|(?:under|below|over|above|not more than|no more than|less than|greater than)\s+\d{1,2}\s+years?\s+old|(?:under|below|over|above)\s+\d{1,2}\s+years?\s+of\s+age|born\s+(?:on\s+or\s+)?(?:after|before|in)\s+(?:19\d{2}|20\d{2})|young\s+(?:\w+\s+)?candidates?\s+only)\b", "age|old|born|young"),
    ("gender", r"\b(?:(?:male|female|men|women)\s+(?:only|candidates? only|applicants? only)|only\s+(?:male|female|men|women)|gender\s*:\s*(?:male|female)|(?:male|female)\s+preferred)\b", "male|men"),
    ("religion", r"\b(?:(?:hindu|muslim|christian|sikh)\s+(?:only|candidates? only)|only\s+(?:hindu|muslim|christian|sikh)|religion\s*:\s*\w+)\b", "hindu|muslim|christian|sikh|religion"),
    ("caste", r"\b(?:upper\s+caste|lower\s+caste|brahmin\s+only|caste\s*:\s*\w+|specific\s+caste)\b", "caste|brahmin"),
    ("marital_status", r"\b(?:unmarried\s+(?:(?:male|female|men|women|candidates?|applicants?)\s+)?only|only\s+unmarried|must\s+be\s+single|married\s+(?:women|men)\s+need\s+not\s+apply|single\s+(?:(?:women|men|candidates?|applicants?)\s+)?only)\b", "single|married"),
    ("nationality_origin", r"\b(?:locals?\s+only|only\s+locals?|indians?\s+only|only\s+indians?|native[ -]born\s+only|citizens?\s+only|only\s+citizens?)\b", "only"),
    ("disability", r"\b(?:no\s+disabled\s+(?:applicants?|candidates?)|able[ -]bodied\s+only|persons?\s+with\s+disabilities\s+need\s+not\s+apply|no\s+wheelchair\s+users?)\b", "disab|able|wheelchair"),
    ("appearance", r"\b(?:fair\s+complexion|minimum\s+height|height\s+at\s+least|good[ -]looking|attractive\s+(?:female|male)|light[ -]skinned)\b", "complexion|height|looking|attractive|skinned"),
)


def discrimination_categories(text: Column, lower: Column) -> Column:
    hits = [F.when(mentions(text, lower, needles, pattern), F.lit(name)) for name, pattern, needles in DISCRIMINATION]
    return F.filter(F.array(*hits), lambda c: c.isNotNull())


def constraint_kind(text: Column, lower: Column) -> Column:
    kind = F.lit(None).cast("string")
    for name, pattern, needles in reversed(CONSTRAINTS):
        kind = F.when(mentions(text, lower, needles, pattern), name).otherwise(kind)
    return kind


def with_classified_items(df: DataFrame, taxonomy: Taxonomy, description: str = "description") -> DataFrame:
    """Add ``items``: array of {pos, section, text, categories, kind, skills, target}.

    ``target`` says where an item goes: flagged, constraint, metadata, responsibility, must or
    preferred.
    """
    df = with_section_items(df, description, "items")
    df = df.withColumn(
        "items",
        F.transform(
            "items",
            lambda item, pos: F.struct(
                pos.alias("pos"),
                item.section.alias("section"),
                item.text.alias("text"),
                F.lower(item.text).alias("lower"),
            ),
        ),
    )
    df = df.withColumn(
        "items",
        F.transform(
            "items",
            lambda i: F.struct(
                i.pos.alias("pos"),
                i.section.alias("section"),
                i.text.alias("text"),
                i.lower.alias("lower"),
                discrimination_categories(i.text, i.lower).alias("categories"),
                constraint_kind(i.text, i.lower).alias("kind"),
                match_skills(i.text, taxonomy).alias("skills"),
            ),
        ),
    )

    def target(i: Column) -> Column:
        has_skills = F.size(i.skills) > 0
        return (
            F.when(F.size(i.categories) > 0, "flagged")
            .when(i.kind.isNotNull() & ~has_skills, "constraint")
            .otherwise(classify_item(i.section, i.text, i.lower, has_skills))
        )

    return df.withColumn("items", F.transform("items", lambda i: i.withField("target", target(i)).dropFields("lower")))


def requirement_items(df: DataFrame) -> DataFrame:
    """Long table (job_id, pos, section, text, kind, skills, target) of classified items."""
    return df.select("job_id", F.inline("items"))


def extract_requirements(df: DataFrame, taxonomy: Taxonomy, description: str = "description") -> DataFrame:
    """Add must_have, preferred, responsibilities, constraints and discriminatory_flags, each in full.

    ``ingest.shown`` cuts a list for display.
    """
    df = with_classified_items(df, taxonomy, description)
    items = F.col("items")

    def requirement(target: str) -> Column:
        chosen = F.filter(items, lambda i: i.target == target)
        return F.transform(chosen, lambda i: F.struct(i.text.alias("text"), i.skills.alias("skills")))

    duties = F.transform(F.filter(items, lambda i: i.target == "responsibility"), lambda i: i.text)
    constraints = F.transform(
        F.filter(items, lambda i: (F.size(i.categories) == 0) & i.kind.isNotNull()),
        lambda i: F.struct(i.kind.alias("kind"), i.text.alias("text")),
    )
    flags = F.flatten(
        F.transform(
            items,
            lambda i: F.transform(i.categories, lambda c: F.struct(i.text.alias("text"), c.alias("category"))),
        )
    )
    return df.withColumns(
        {
            "must_have": requirement("must"),
            "preferred": requirement("preferred"),
            "responsibilities": duties,
            "constraints": constraints,
            "discriminatory_flags": flags,
        }
    ).drop("items")


def posting_skills(reqs: DataFrame) -> DataFrame:
    """Add required_skills, preferred_skills and qualifications of a posting."""

    def distinct_skills(column: str) -> Column:
        return F.array_distinct(F.flatten(F.transform(column, lambda r: r.skills)))

    reqs = reqs.withColumn("required_skills", distinct_skills("must_have"))
    return reqs.withColumns(
        {
            "preferred_skills": F.array_except(distinct_skills("preferred"), F.col("required_skills")),
            "qualifications": F.transform("must_have", lambda r: r.text),
        }
    )


def discrimination_warnings(reqs: DataFrame) -> DataFrame:
    """Add one warning per flag as ``discrimination_warnings``."""
    messages = F.transform(
        "discriminatory_flags",
        lambda f: warning(
            "POTENTIALLY_DISCRIMINATORY_REQUIREMENT",
            F.concat(F.lit("Potentially discriminatory "), f.category, F.lit(" requirement")),
        ),
    )
    return reqs.withColumn("discrimination_warnings", messages.cast(f"array<{WARNING}>"))


def discrimination_report(reqs: DataFrame) -> DataFrame:
    return (
        reqs.select("job_id", F.explode("discriminatory_flags").alias("flag"))
        .groupBy(F.col("flag.category").alias("category"))
        .agg(F.count(F.lit(1)).alias("flags"), F.countDistinct("job_id").alias("postings"))
    )


def skill_demand(postings: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """Postings that require or prefer each skill, with its category."""
    wanted = postings.select(
        "job_id",
        F.explode(
            F.concat(
                F.transform("required_skills", lambda s: F.struct(s.alias("skill"), F.lit(1).alias("required"))),
                F.transform("preferred_skills", lambda s: F.struct(s.alias("skill"), F.lit(0).alias("required"))),
            )
        ).alias("w"),
    )
    # Skills are distinct within a posting, so plain counts pre-aggregate fully on the map side.
    return wanted.groupBy(F.col("w.skill").alias("skill")).agg(
        F.sum("w.required").alias("required_in"), F.sum(1 - F.col("w.required")).alias("preferred_in")
    ).withColumn("category", skill_category(F.col("skill"), taxonomy))
