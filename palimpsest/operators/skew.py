"""Equi-joins that stay balanced when one key holds a large share of the rows.

A bounded frequent-items sketch (``approx_top_k``: fixed memory, merged map-side) finds the keys that
may dominate the big side.  Rows of those keys get a salt, the few matching rows of the other side are
repeated once per salt, and everything else has salt 0.  The sketch only decides *where* rows go; which
rows match never depends on it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRACKED = 2048
SALTS = 32


def key_hash(cols: Sequence[Column]) -> Column:
    return F.xxhash64(*cols)


def hot_keys(df: DataFrame, keys: Sequence[str], share: float = 0.01) -> list[int]:
    """Hashes of keys holding at least ``share`` of the rows; at most ``1/share`` of them exist, and all are found."""
    most = math.ceil(1 / share) + 1
    seen = df.select(key_hash([F.col(k) for k in keys]).alias("k")).agg(
        F.expr(f"approx_top_k(k, {most}, {max(TRACKED, 16 * most)})").alias("top"), F.count(F.lit(1)).alias("n")
    ).first()
    if not seen or not seen["n"]:
        return []
    return [r["item"] for r in seen["top"] if r["item"] is not None and r["count"] >= share * seen["n"]]


def is_hot(hot: Sequence[int], cols: Sequence[Column]) -> Column:
    return key_hash(cols).isin(list(hot)) if hot else F.lit(False)


def salt_big(df: DataFrame, keys: Sequence[str], hot: Sequence[int], spread: Sequence[str], salts: int = SALTS) -> DataFrame:
    """The big side with ``_salt``; ``spread`` names columns whose values scatter a hot key's rows."""
    own = F.pmod(F.xxhash64(F.lit("salt"), *[F.col(c) for c in spread]), F.lit(salts)).cast("int")
    return df.withColumn("_salt", F.when(is_hot(hot, [F.col(k) for k in keys]), own).otherwise(F.lit(0)))


def salt_small(df: DataFrame, keys: Sequence[str], hot: Sequence[int], salts: int = SALTS) -> DataFrame:
    """The other side: rows of hot keys repeated for every salt, before any aggregation by key."""
    if not hot:
        return df.withColumn("_salt", F.lit(0))
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    return df.withColumn("_salt", F.explode(F.when(is_hot(hot, [F.col(k) for k in keys]), every).otherwise(F.array(F.lit(0)))))


def skew_join(big: DataFrame, small: DataFrame, keys: Sequence[str], spread: Sequence[str], how: str = "inner", share: float = 0.01) -> DataFrame:
    """Sort-merge join on ``keys`` (same names on both sides), hot keys of ``big`` salted.

    ``how`` must keep rows of ``big`` only (inner, left, left_semi, left_anti).
    """
    hot = hot_keys(big, keys, share)
    left, right = salt_big(big, keys, hot, spread), salt_small(small, keys, hot)
    return left.hint("merge").join(right, [*keys, "_salt"], how).drop("_salt")
