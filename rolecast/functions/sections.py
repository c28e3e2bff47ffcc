"""Splitting a description into sectioned items.

A posting stays one row: lines, headings and sentences are array expressions, so
no shuffle and no ordering across rows is needed. Headings open blocks; cutting
the text at them carries each heading to the lines below it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecast.functions.regex import js_trim, mentions, rx

# Heading patterns; the first that fits a line names its section.
HEADINGS = (
    ("must", r"^(?:requirements|qualifications|must[- ]have|must have|mandatory|desired candidate profile|key skills)\s*[:\-–—]?\s*(.*)\z"),
    ("preferred", r"^(?:nice[- ]to[- ]have|nice to have|preferred|good[- ]to[- ]have|good to have|bonus)\s*[:\-–—]?\s*(.*)\z"),
    ("responsibility", r"^(?:responsibilities|roles and responsibilities|what you(?:'ll| will) do)\s*[:\-–—]?\s*(.*)\z"),
    ("general", r"^(?:job description|about (?:the |our )?(?:job|role|team|company|us)|job summary|role summary|overview|summary)\s*[:\-–—]?\s*(.*)\z"),
    ("metadata", r"^(?:salary|compensation|pay|benefits|perks|job details)\s*(?:[:\-–—]\s*(.*)|\s+(\d.*)|\z)"),
)
TAG_LINE = r"^key skills\s*:?\s*(.*)\z"
DETAIL_LINE = r"^job details\s*:?\s*(.*)\z"
INLINE_HEADING = (
    r"(?<=[.!?;\s])(?=(?:requirements|qualifications|must[- ]have|mandatory|desired candidate profile|key skills|"
    r"nice[- ]to[- ]have|good[- ]to[- ]have|preferred|bonus|responsibilities|roles and responsibilities|"
    r"what you(?:'ll| will) do|job description|about (?:the |our )?(?:job|role|team|company|us)|job summary|"
    r"role summary|overview|summary|benefits|perks|job details)[^\S\n]*[:\-–—]|"
    r"(?:salary|compensation|pay)[^\S\n]*(?:[:\-–—]|\d|[₹$]))"
)
BULLET = r"^(?:#+\s*|[-*•]|\d+[.)])\s*"
SENTENCE_GAP = r"(?<=[.!?])(?<!(?<![A-Za-z0-9_])(?:e\.g|i\.e|etc|vs)\.)[^\S\n]+(?=[A-Z0-9#*-])"

# Item cues; with a pattern, text that a match is sure to contain.
PURE_METADATA = (
    (r"^(?:full[ -]?time|part[ -]?time|contract(?:ual)?|internship|temporary|permanent)\.?\z", "time|contract|internship|temporary|permanent"),
    (r"^(?:salary|compensation|pay|ctc|remuneration)\b", "salary|compensation|pay|ctc|remuneration"),
    (r"\b\d+\s*[-–]\s*\d+\s*(?:lpa|ctc|per annum)\b", "lpa|ctc|per annum"),
)
PREFERRED_CUE = "nice to have|preferred|good to have|plus"
MUST_CUE = "must|mandatory|required"
INTRO_CUE = (
    r"^(?:we are (?:hiring|looking for|seeking)|about (?:the |our )?(?:company|role|team|us)|who we are|join our team|our company is)\b"
)

# Control characters never survive cleaning, so they can mark places in a text.
_OPEN, _CLOSE, _GAP = "\u0001", "\u0002", "\u0003"


def _sentences(line: Column) -> Column:
    return F.filter(F.transform(F.split(line, _GAP), js_trim), lambda s: s != "")


def _mark_heading(line: Column) -> Column:
    """A heading line becomes OPEN section CLOSE content."""
    marked = line
    for section, pattern in reversed(HEADINGS):
        content = F.regexp_extract(line, rx(pattern), 1)
        if section == "metadata":
            content = F.concat(content, F.regexp_extract(line, rx(pattern), 2))
        marked = F.when(
            line.rlike(rx(pattern)), F.concat(F.lit(f"{_OPEN}{section}{_CLOSE}"), js_trim(content))
        ).otherwise(marked)
    detail = F.concat(F.lit(f"{_OPEN}metadata{_CLOSE}"), js_trim(F.regexp_extract(line, rx(DETAIL_LINE), 1)))
    tags = F.concat(F.lit(f"{_OPEN}tags{_CLOSE}"), F.regexp_extract(line, rx(TAG_LINE), 1))
    return F.when(line.rlike(rx(TAG_LINE)), tags).when(line.rlike(rx(DETAIL_LINE)), detail).otherwise(marked)


def _block_items(block: Column) -> Column:
    label = F.substring_index(block, _CLOSE, 1)
    section = F.when(label == "tags", "must").otherwise(label)
    lines = F.split(F.regexp_replace(block, f"^[^{_CLOSE}]*{_CLOSE}", ""), "\n")
    head = lines[0]
    listed = F.split(F.translate(F.replace(head, F.lit(_GAP), F.lit("")), ";", ","), ",")
    tags = F.filter(F.transform(listed, js_trim), lambda t: t != "")
    first = F.when(label == "tags", tags).otherwise(_sentences(head))
    rest = F.flatten(F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), _sentences))
    return F.transform(F.concat(first, rest), lambda t: F.struct(section.alias("section"), t.alias("text")))


def with_section_items(df: DataFrame, description: str = "description", into: str = "items") -> DataFrame:
    """Add ``items``: array<struct<section,text>> in reading order."""
    # The patterns run over the whole text at once; they never look past a line break.
    broken = F.regexp_replace(F.replace(F.col(description), F.lit("\r\n"), F.lit("\n")), rx(INLINE_HEADING), "\n")

    def strip(line: Column) -> Column:
        bare = F.regexp_replace(js_trim(line), rx(BULLET, ""), "")
        return js_trim(F.regexp_replace(bare, r"^\*\*|\*\*\z", ""))

    df = df.withColumn("_lines", F.filter(F.transform(F.split(broken, "\n"), strip), lambda line: line != ""))
    marked = F.array_join(F.transform(F.col("_lines"), _mark_heading), "\n")
    cut = F.regexp_replace(F.concat(F.lit(f"general{_CLOSE}"), marked), rx(SENTENCE_GAP), f"$0{_GAP}")
    df = df.withColumn("_blocks", F.split(F.replace(cut, F.lit(f"\n{_OPEN}"), F.lit(_OPEN)), _OPEN))
    return df.withColumn(into, F.flatten(F.transform(F.col("_blocks"), _block_items))).drop("_lines", "_blocks")


def _whole(alternatives: str) -> str:
    return rf"\b(?:{alternatives})\b"


def classify_item(section: Column, text: Column, lower: Column, has_skills: Column) -> Column:
    """must, preferred, responsibility or metadata for one item."""
    pure = F.lit(False)
    for pattern, needles in PURE_METADATA:
        pure = pure | mentions(text, lower, needles, pattern)
    return (
        F.when(section == "metadata", "metadata")
        .when(~has_skills & pure, "metadata")
        .when(mentions(text, lower, PREFERRED_CUE, _whole(PREFERRED_CUE)), "preferred")
        .when(mentions(text, lower, MUST_CUE, _whole(MUST_CUE)), "must")
        .when(text.rlike(rx(INTRO_CUE)) & ~has_skills, "responsibility")
        .when(section != "general", section)
        .otherwise(F.when(has_skills, "must").otherwise("responsibility"))
    )
