"""Global positions without a window over all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

_SHIFT = 33  # monotonically_increasing_id keeps the partition above this bit


def positions(df: DataFrame, order: Sequence[Column | str], name: str = "pos", start: int = 0) -> DataFrame:
    """``df`` with its row number in ``order`` (a total order), from ``start``.

    Range-partitioned and sorted, then an offset for every partition: the driver sees one count a partition.
    """
    ordered = written(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.call_function("shiftright", F.col("_at"), F.lit(_SHIFT))
    sizes = {r["p"]: r["n"] for r in ordered.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, at = [], start
    for p in sorted(sizes):
        offsets += [F.lit(p), F.lit(at).cast("bigint")]
        at += sizes[p]
    base = F.create_map(*offsets)[part] if offsets else F.lit(start).cast("bigint")
    return ordered.withColumn(name, base + F.col("_at").bitwiseAND(F.lit((1 << _SHIFT) - 1))).drop("_at")
