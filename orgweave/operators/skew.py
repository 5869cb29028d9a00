"""Joins that keep a hot key from landing in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than 1/SHARE of the rows, so there are fewer than SHARE hot keys:
#: the list of them is the one thing broadcast here, and this bounds it.
SHARE = 1000
SALTS = 32


def hot_keys(df: DataFrame, keys: list[str], share: int = SHARE) -> DataFrame:
    """Keys with more than 1/share of df's rows (fewer than share rows). Nulls never count."""
    counts = df.dropna(subset=keys).groupBy(*keys).count()
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts.filter((F.col("count") > total / share) & (F.col("count") > 1000)).select(*keys)


def salted_join(
    left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", salts: int = SALTS
) -> DataFrame:
    """left join right on keys, right having at most one row a key.

    Rows of a hot left key are spread over ``salts`` partitions and that key's single right row is
    repeated as often; all other rows are untouched. The result is that of the plain join.
    """
    hot = F.broadcast(hot_keys(left, keys).withColumn("_hot", F.lit(True)))
    spread = F.when(F.col("_hot"), F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    lft = left.join(hot, keys, "left").withColumn("_salt", F.coalesce(spread, F.lit(0))).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    rgt = right.join(hot, keys, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return lft.join(rgt, [*keys, "_salt"], how).drop("_salt")


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", salts: int = 8) -> DataFrame:
    """left join right on keys, right being small beside left with at most one row a key: right is repeated ``salts``
    times and every left key spread over as many partitions. No count is needed first; AQE splits what is still hot.
    Left rows with a NULL key match nothing and are spread too."""
    lft = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    rgt = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return lft.join(rgt, [*keys, "_salt"], how).drop("_salt")
