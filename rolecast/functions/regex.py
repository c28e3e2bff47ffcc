"""Regular-expression helpers.

Patterns in this package are written with an ASCII ``\\b`` and a Unicode ``\\s``.
Java reads both the other way round (and differently per JVM version), so
``rx`` spells the two classes out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII; as one class of Java's own it is tested at once, and letter case does not matter to it.
WORD = r"\w"
# Java asks the members of a class one after the other. Here ASCII is settled by the first two.
SPACE = r"\s[\x{80}-\x{FFFF}&&[\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]]"
NOT_AFTER_WORD = f"(?<![{WORD}])"
NOT_BEFORE_WORD = f"(?![{WORD}])"
# For patterns that ignore the case of all letters: two letters beyond ASCII fold to ASCII ones.
FOLDED_WORD = "A-Za-z0-9_"
BOUNDARY = f"(?:(?<=[{WORD}]){NOT_BEFORE_WORD}|{NOT_AFTER_WORD}(?=[{WORD}]))"


def rx(pattern: str, flags: str = "i") -> str:
    """Java form of ``pattern``. A leading ``\\b`` must be followed by word characters."""
    out: list[str] = []
    in_class = False
    i = 0
    while i < len(pattern):
        pair = pattern[i : i + 2]
        if pair == r"\s":
            out.append(SPACE if in_class else f"[{SPACE}]")
            i += 2
        elif pair == r"\b" and not in_class:
            out.append(NOT_AFTER_WORD if i == 0 else BOUNDARY)
            i += 2
        elif pair[0] == "\\":
            out.append(pair)
            i += 2
        else:
            if pair[0] == "[":
                in_class = True
            elif pair[0] == "]":
                in_class = False
            out.append(pair[0])
            i += 1
    return (f"(?{flags})" if flags else "") + "".join(out)


def words(alternatives: str, flags: str = "i") -> str:
    """Whole-word match of alternatives that start and end with word characters."""
    return rx(f"{NOT_AFTER_WORD}(?:{alternatives}){NOT_BEFORE_WORD}", flags)


#: The characters ``SPACE`` stands for.
SPACE_CHARACTERS = "\t\n\u000b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def js_trim(col: Column) -> Column:
    return F.btrim(col, F.lit(SPACE_CHARACTERS))


def mentions(text: Column, lower: Column, needles: str, pattern: str, flags: str = "i") -> Column:
    """``text`` matches ``pattern``, which needs one of the lower-case ``needles`` ('|' between them).

    ``lower`` is the lower-case text, or a longer one that contains it. A substring test costs a
    fraction of a pattern search, and most texts hold no needle.
    """
    found = F.lit(False)
    for needle in needles.split("|"):
        found = found | F.contains(lower, F.lit(needle))
    return found & text.rlike(rx(pattern, flags))


def utf16_length(col: Column) -> Column:
    return (F.octet_length(F.encode(col, "UTF-16BE")) / 2).cast("int")


def escape_regex(col: Column) -> Column:
    return F.regexp_replace(col, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def phrase_pattern(phrase: Column) -> Column:
    """Pattern matching a trimmed phrase that is not glued to other word characters."""
    return F.concat(
        F.lit(f"(?iu)(?<![{FOLDED_WORD}])"), escape_regex(js_trim(phrase)), F.lit(f"(?![{FOLDED_WORD}])")
    )


def skill_name_pattern(skill: Column) -> Column:
    """Like ``phrase_pattern``, but a skill that ends in a symbol may be followed by a digit
    and may not be followed by another ``+`` or ``#`` (so C does not swallow C++)."""
    trimmed = js_trim(skill)
    tail = F.when(trimmed.rlike(f"[{WORD}]\\z"), F.lit(f"(?![{FOLDED_WORD}])")).otherwise(F.lit("(?![A-Za-z_+#])"))
    return F.concat(F.lit(f"(?iu)(?<![{FOLDED_WORD}])"), escape_regex(trimmed), tail)


#: Letters that patterns take for an ASCII one when they ignore case, but that lower case keeps apart.
_KIN = ("\u0130\u0131\u017f", "iis")


def word_tokens(col: Column) -> Column:
    """Distinct lower-case ASCII words, and every other character that is no space by itself."""
    # Lower case makes a sigma at the end of a word another letter.
    # Each letter is searched for: translate looks up every character of a text.
    for kin, letter in zip(*_KIN):
        col = F.replace(col, F.lit(kin), F.lit(letter))
    lower = F.replace(F.lower(col), F.lit("\u03c2"), F.lit("\u03c3"))
    return F.array_distinct(F.regexp_extract_all(lower, F.lit(r"[a-z0-9_]+|[^a-z0-9_\s]"), F.lit(0)))


def needed_tokens(phrase: Column) -> Column:
    """ASCII words of a phrase, or its characters where it has none. A delimited phrase can only occur
    in a text that holds each of these tokens, so any of them is an exact equi-join key."""

    def chosen(tokens: Column) -> Column:
        named = F.filter(tokens, lambda t: t.rlike("^[a-z0-9_]"))
        return F.when(F.size(named) > 0, named).otherwise(tokens)

    return F.transform(F.array(word_tokens(phrase)), chosen)[0]
