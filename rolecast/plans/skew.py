"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ways a hot key is spread over tasks; ``spark.rolecast.salts`` overrides it.
DEFAULT_SALTS = 8
#: Rows of one bucket that one task may pair up before the bucket is split into blocks.
BLOCK_ROWS = 2_000


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], spread_by: str, how: str = "inner") -> DataFrame:
    """Join many rows per key (left) with few narrow rows per key (right).

    Left rows of one key are spread by ``spread_by``; the right side is repeated per salt. The planner
    takes it for as small as it was before, so it is kept from being broadcast through the driver.
    """
    salts = int(left.sparkSession.conf.get("spark.rolecast.salts", str(DEFAULT_SALTS)))
    salted_left = left.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    salted_right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted_left.join(salted_right.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def bucket_pairs(rows: DataFrame, bucket: Sequence[str], node: str, extra: Sequence[str] = ()) -> DataFrame:
    """Ordered pairs (a < b) of nodes that share a bucket, with ``extra`` columns of both sides.

    A bucket larger than ``BLOCK_ROWS`` is cut into blocks, and every pair of blocks is a join
    key of its own, so a hot bucket is worked on by many tasks and no pair is lost.
    """
    sizes = (
        rows.groupBy(*bucket)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1")
        .withColumn("_blocks", F.ceil(F.col("_n") / BLOCK_ROWS).cast("int"))
        .drop("_n")
    )
    placed = salted_join(rows.select(*bucket, node, *extra), sizes, bucket, node).withColumn(
        "_block", F.pmod(F.xxhash64(node, F.lit("block")), F.col("_blocks")).cast("int")
    )
    last = F.col("_blocks") - 1
    left = placed.withColumns({"_i": F.col("_block"), "_j": F.explode(F.sequence(F.col("_block"), last))})
    right = placed.withColumns({"_j": F.col("_block"), "_i": F.explode(F.sequence(F.lit(0), F.col("_block")))})

    def side(df: DataFrame, suffix: str) -> DataFrame:
        return df.select(
            *bucket, "_i", "_j", F.col(node).alias(f"{node}_{suffix}"), *[F.col(c).alias(f"{c}_{suffix}") for c in extra]
        )

    joined = side(left, "x").join(side(right, "y"), [*bucket, "_i", "_j"])
    x, y = F.col(f"{node}_x"), F.col(f"{node}_y")
    # Inside one block both orders meet; across blocks each pair meets once, in either order.
    pairs = joined.filter((x < y) | ((x > y) & (F.col("_i") != F.col("_j"))))

    def ordered(column: str, first: str, second: str):
        return F.when(x < y, F.col(f"{column}_{first}")).otherwise(F.col(f"{column}_{second}"))

    columns = [node, *extra]
    return pairs.select(
        *bucket,
        *[ordered(c, "x", "y").alias(f"{c}_a") for c in columns],
        *[ordered(c, "y", "x").alias(f"{c}_b") for c in columns],
    )
