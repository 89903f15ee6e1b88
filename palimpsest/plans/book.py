"""A book of queries: each a function of (spark, sf_dir) with the SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.current import current_rows

# The current row of every entry, as SQL.
ENTRIES = "entries AS (SELECT DISTINCT ON (namespace, id) * FROM memories ORDER BY namespace, id, updated_at DESC)"


class Book:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable:
        """Registers the function under its name; ``{E}`` in the SQL becomes WITH and the entries."""

        def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql.replace("{E}", "WITH " + ENTRIES)
            return f

        return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """Current rows with the named columns (namespace and id always)."""
    return current_rows(table(spark, sf_dir, "memories"), ["namespace", "id"], "updated_at", list(dict.fromkeys(cols)))
