"""Cleaning of untrusted text as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from rolecast.functions.regex import SPACE, js_trim, rx

# Characters that compatibility composition leaves alone in any company of each other: ASCII,
# Latin-1 letters and signs, common dashes and quotes, the euro and rupee signs.
# ASCII is settled by the first member of the class.
NFKC_STABLE = r"\x00-\x7F[\xC0-\xFF\x{2013}\x{2014}\x{2018}-\x{201D}\x{2022}\x{20AC}\x{20B9}]"

# Controls except tab/LF/CR, zero-width, bidirectional and tag characters. Printable ASCII is
# settled before the members are asked one after the other.
FORBIDDEN = (
    r"[[^\x{20}-\x{7E}]&&[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}-\x{9F}"
    r"\x{200B}-\x{200D}\x{2060}\x{FEFF}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{E0000}-\x{E007F}]]"
)

# Named entities, replaced in this order.
NAMED_ENTITIES = {
    "&amp;": "&",
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&apos;": "'",
    "&#39;": "'",
    "&nbsp;": " ",
    "&copy;": "©",
    "&reg;": "®",
    "&trade;": "™",
    "&pound;": "£",
    "&euro;": "€",
    "&yen;": "¥",
    "&cent;": "¢",
    "&hellip;": "…",
    "&ndash;": "–",
    "&mdash;": "—",
    "&bull;": "•",
}

# Text without a match of this has no entity.
ENTITY_START = "&(?:#|[a-z]+;)"

# Parts that are no text, removed in this order; text without a match of the first has none of them.
HIDDEN_START = r"(?i)<(?:script|style|noscript|!--)"
HIDDEN = (
    (r"(?is)<script(?![A-Za-z0-9_])[^>]*>.*?</script>", ""),
    (r"(?is)<script(?![A-Za-z0-9_]).*\z", ""),
    (r"(?is)<style(?![A-Za-z0-9_])[^>]*>.*?</style>", ""),
    (r"(?is)<style(?![A-Za-z0-9_]).*\z", ""),
    (r"(?is)<noscript(?![A-Za-z0-9_])[^>]*>.*?</noscript>", ""),
    (r"(?is)<noscript(?![A-Za-z0-9_]).*\z", ""),
    (r"(?s)<!--.*?-->", ""),
    (r"(?s)<!--.*\z", ""),
)
# Then markup removed or turned into line breaks, in this order.
MARKUP = (
    (rx(r"<br\s*/?>"), "\n"),
    (r"(?i)</(?:p|div|tr|h[1-6])>", "\n\n"),
    (r"(?i)<li(?![A-Za-z0-9_])[^>]*>", "\n"),
    (r"</?[a-zA-Z!?][^>]*>", ""),
    (r"</?[a-zA-Z!?][^>]*\z", ""),
)


@F.pandas_udf(ArrayType(StringType()))
def _nfkc(values: pd.Series) -> pd.Series:
    def compose(texts):
        return None if texts is None else [None if v is None else unicodedata.normalize("NFKC", v) for v in texts]

    return values.map(compose)


def nfkc(texts: Column) -> Column:
    """Compatibility composition of an array of texts. Spark has no built-in, so this is one Arrow
    batch function; rows whose texts are all in normal form never leave the JVM."""
    unstable = F.exists(texts, lambda t: F.coalesce(t.rlike(f"[^{NFKC_STABLE}]"), F.lit(False)))
    return F.coalesce(_nfkc(F.when(unstable, texts)), texts)


def strip_forbidden_unicode(col: Column) -> Column:
    return F.regexp_replace(col, FORBIDDEN, "")


def _replaced(col: Column, patterns: Sequence[tuple[str, str]]) -> Column:
    for pattern, replacement in patterns:
        col = F.regexp_replace(col, pattern, replacement)
    return col


def html_to_text(col: Column) -> Column:
    return _replaced(col, HIDDEN + MARKUP)


def _code_point(value: Column) -> Column:
    text = F.decode(F.unhex(F.lpad(F.hex(value), 8, "0")), "UTF-32")
    text = F.regexp_replace(text, FORBIDDEN, "")
    return (
        F.when(value > 0x10FFFF, "").when(value.between(0xD800, 0xDFFF), "�").otherwise(text)
    )


def _numeric_entities(col: Column, marker: str, digits: str, base: int) -> Column:
    # Each piece after the split starts with at most one entity, so the text is read once.
    entity = f"^{marker}({digits});?"

    def decode(piece: Column) -> Column:
        number = F.conv(F.regexp_extract(piece, entity, 1), base, 10).cast("bigint")
        rest = F.regexp_replace(piece, entity, "")
        return F.when(piece.rlike(entity), F.concat(_code_point(number), rest)).otherwise(piece)

    return F.array_join(F.transform(F.split(col, f"(?={marker}{digits})"), decode), "")


def decode_entities(col: Column) -> Column:
    col = _numeric_entities(col, "&#", "[0-9]{1,7}", 10)
    col = _numeric_entities(col, "&#x", "[0-9a-fA-F]{1,6}", 16)
    for entity, char in NAMED_ENTITIES.items():
        col = F.replace(col, F.lit(entity), F.lit(char))
    return col


def _markup_free(texts: Column) -> Column:
    """Markup and entities removed from an array of texts.

    Three passes reach doubly encoded markup; a stable text is a fixed point of a pass. Each step is a
    transform of its own, so that its test reads the text before it without computing it again. Only
    decoding can bring forbidden characters back.
    """

    def step(where: str, change) -> None:
        nonlocal texts
        texts = F.transform(texts, lambda t: F.when(t.rlike(where), change(t)).otherwise(t))

    def remove_markup() -> None:
        step(HIDDEN_START, lambda t: _replaced(t, HIDDEN))
        step("<", lambda t: _replaced(t, MARKUP))

    for _ in range(3):
        remove_markup()
        step(ENTITY_START, lambda t: strip_forbidden_unicode(decode_entities(t)))
    remove_markup()
    return texts


def _tidy_lines(col: Column) -> Column:
    col = F.regexp_replace(col, r"\r\n?", "\n")
    blank = f"[{SPACE}&&[^\\n]]"
    col = F.regexp_replace(col, f"{blank}+(?=\\n|\\z)", "")
    return js_trim(F.regexp_replace(col, r"\n{4,}", "\n\n\n"))


def sanitize_text(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace ``cols`` by their cleaned text and list the changed ones in ``sanitized_fields``.

    The fields are cleaned as one array, so the plan holds the cleaning steps once.
    """
    staged = df.withColumn("_texts", F.transform(nfkc(F.array(*cols)), strip_forbidden_unicode))
    staged = staged.withColumn("_texts", F.transform(_markup_free(F.col("_texts")), _tidy_lines))
    changed = F.array(*[F.when(F.col("_texts")[i] != F.col(c), F.lit(c)) for i, c in enumerate(cols)])
    staged = staged.withColumn("sanitized_fields", F.filter(changed, lambda f: f.isNotNull()))
    return staged.withColumns({c: F.col("_texts")[i] for i, c in enumerate(cols)}).drop("_texts")


def sanitize_warnings(fields: Column) -> Column:
    return F.transform(
        fields,
        lambda f: F.struct(
            F.lit("CONTENT_SANITIZED").alias("code"),
            F.concat(F.lit("Content in '"), f, F.lit("' was sanitized")).alias("message"),
            f.alias("field"),
        ),
    )
