"""Phrases and texts meet on the rarest word of each phrase."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecast.functions.regex import needed_tokens
from rolecast.session import cut_lineage


def may_hold(texts: DataFrame, ids: Sequence[str], phrases: DataFrame, phrase: str) -> DataFrame:
    """``ids`` of a text with the columns of each phrase it may hold: it has the phrase's rarest word.

    ``texts`` has a column ``tokens`` (``word_tokens``, distinct per row); ``phrases`` has one row per
    phrase. How many texts hold a word is counted over all texts. A phrase with a word that stands in
    no text meets none, and one that begins with a common word is looked up by a rarer one. Texts
    are split into words once, and only words that some phrase needs are written.
    """
    needed = phrases.select(*phrases.columns, F.explode(needed_tokens(F.col(phrase))).alias("token"))
    words = cut_lineage(
        texts.select(*ids, F.explode("tokens").alias("token")).join(needed.select("token").distinct(), "token", "left_semi")
    )
    counts = words.groupBy("token").agg(F.count(F.lit(1)).alias("texts"))
    rarity = F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), F.col("token"))
    keyed = needed.join(counts, "token", "left").groupBy(*phrases.columns).agg(F.min(rarity).alias("rarest"))
    # Written first: phrases are few and their size is known, so that a word of many texts is not dealt to one task.
    return words.join(cut_lineage(keyed.withColumn("token", F.col("rarest.token")).drop("rarest")), "token").drop("token")
