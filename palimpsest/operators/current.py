"""The row of a key that counts: the one with the greatest version column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType


def current_rows(df: DataFrame, keys: Sequence[str], version: str, keep: Sequence[str]) -> DataFrame:
    """One row per key, from the row with the greatest ``version``.

    Copies and older rows collapse map-side, so a key that holds a third of all rows costs one row per
    map task in the shuffle.  Rows that tie on ``version`` are ordered by a hash of the kept columns, so
    the choice is repeatable.  A null version is older than any other; rows with a null key are dropped
    (no reference can name them).
    """
    kept = [c for c in keep if c not in keys]
    kinds = {f.name: f.dataType for f in df.schema.fields}
    plain = [F.array_sort(F.map_entries(c)) if isinstance(kinds[c], MapType) else F.col(c) for c in kept]
    order = F.struct(F.col(version), F.xxhash64(*plain) if kept else F.lit(0))
    best = F.max_by(F.struct(*[F.col(c) for c in kept]) if kept else F.lit(0), order).alias("_row")
    out = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).groupBy(*keys).agg(best)
    return out.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in kept])
