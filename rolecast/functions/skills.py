"""Skill names: taxonomy table and text matcher.

The taxonomy is a parameter; jobs load their own file (see ``sources``).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names that are also words or letters count only in this exact case.
CASE_BOUND_NAMES = ("Go", "R", "C")

_NAME_CHAR = r"\p{L}\p{N}+#"


@dataclass(frozen=True)
class Taxonomy:
    """Skill vocabulary held by the driver as job configuration, in file order."""

    aliases: tuple[tuple[str, str], ...]  # (spelling, skill)
    categories: tuple[tuple[str, str], ...]  # (skill, category)

    @classmethod
    def of(cls, skills: Sequence[tuple[str, Sequence[str], str]]) -> Taxonomy:
        pairs = [(spelling, name) for name, other, _ in skills for spelling in (name, *other)]
        folded = Counter(spelling.lower() for spelling, _ in pairs)
        repeated = sorted(f for f, n in folded.items() if n > 1)
        if repeated:
            raise ValueError(f"duplicate skill alias: {', '.join(repeated)}")
        return cls(tuple(pairs), tuple((name, category) for name, _, category in skills))

    def alias_frame(self, spark: SparkSession) -> DataFrame:
        category = dict(self.categories)
        rows = [(alias, name, category[name]) for alias, name in self.aliases]
        return spark.createDataFrame(rows, "alias string, name string, category string")

    def category_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.categories), "skill string, category string")

    def pattern(self) -> str:
        """One alternation over all spellings, longest first.

        Spellings are grouped by first letter: two spellings that start differently can never
        match at the same place, so the order across groups is free and most of the
        alternation is skipped after one character.
        """
        ordered = sorted((a for a, _ in self.aliases), key=len, reverse=True)
        groups: dict[str, list[str]] = {}
        for alias in ordered:
            groups.setdefault(alias[0].lower(), []).append(alias)
        branches = (
            f"{_quote(first)}(?:{'|'.join(_quote(alias[1:]) for alias in members)})" for first, members in groups.items()
        )
        return f"(?iu)(?<![{_NAME_CHAR}.])(?:{'|'.join(branches)})(?![{_NAME_CHAR}]|\\.[\\p{{L}}\\p{{N}}])"


def _quote(text: str) -> str:
    return "".join(f"\\{c}" if c in r".*+?^${}()|[]\-/# " else c for c in text)


def match_skills(text: Column, taxonomy: Taxonomy) -> Column:
    """Canonical names of the skills a text mentions, in order of first mention."""
    names = F.create_map(*[F.lit(x) for alias, name in taxonomy.aliases for x in (alias.lower(), name)])
    found = F.regexp_extract_all(text, F.lit(taxonomy.pattern()), F.lit(0))

    def resolve(word: Column) -> Column:
        name = F.try_element_at(names, F.lower(word))
        miscased = name.isin(*CASE_BOUND_NAMES) & (F.length(word) == F.length(name)) & (word != name)
        return F.when(~miscased, name)

    return F.array_distinct(F.filter(F.transform(found, resolve), lambda n: n.isNotNull()))


def skill_category(skill: Column, taxonomy: Taxonomy) -> Column:
    """Category of a skill name, any case; null when the taxonomy does not know it."""
    categories = F.create_map(*[F.lit(x) for name, category in taxonomy.categories for x in (name.lower(), category)])
    return F.try_element_at(categories, F.lower(skill))
