"""Problem 1: references to records that do not exist.

References and parent keys are hash-partitioned alike, sorted and merged linearly (a sort-merge left
join); the parent's validity separates the outcomes:

* ``missing``  no parent has the key,
* ``deleted``  the parent's current row is marked as deleted,
* ``late``     the parent was stored more than ``grace_hours`` after the reference's own time.

A parent may be several of these at once; the first in this order is reported.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import iso_instant, utc_month
from .skew import hot_keys, salt_big, salt_small

REFERENCE_COLUMNS = ["ref_table", "ref_field", "record_id", "ref_at", "namespace", "entry_id"]


def references(df: DataFrame, table: str, fields: list[str], record: str, at) -> DataFrame:
    """One row per (record, field) with a non-empty reference.  ``at`` is the record's own time (Column)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in fields])).alias("_ref")
    return (
        df.select(F.col(record).cast("bigint").alias("record_id"), at.alias("ref_at"), "namespace", pairs)
        .select(F.lit(table).alias("ref_table"), F.col("_ref.f").alias("ref_field"), "record_id", "ref_at", "namespace", F.col("_ref.v").alias("entry_id"))
        .where("entry_id IS NOT NULL AND entry_id <> ''")
    )


def orphan_references(refs: DataFrame, parents: DataFrame, grace_hours: int = 24) -> DataFrame:
    """References without a parent in force, with ``outcome`` and ``ref_period`` (UTC month or ``unknown``).

    ``refs``: columns REFERENCE_COLUMNS.  ``parents``: every stored row with namespace, id, updated_at,
    created_at, pending_delete; copies and older rows are allowed.  Null pending_delete means not deleted.
    A null reference time is never late; neither is a parent without created_at.  A null namespace
    matches nothing, so such a reference is missing.  Repeated records give one row.  Empty tables work:
    without parents every reference is missing.

    One popular parent may hold most references: such keys are salted on both sides before the merge.
    """
    keys = ["namespace", "entry_id"]
    hot = hot_keys(refs, keys)
    left = salt_big(refs, keys, hot, ["ref_table", "ref_field", "record_id"])
    right = salt_small(parents.select("namespace", F.col("id").alias("entry_id"), "updated_at", "created_at", F.coalesce("pending_delete", F.lit(False)).alias("gone")).where("namespace IS NOT NULL AND entry_id IS NOT NULL"), keys, hot)
    right = right.groupBy(*keys, "_salt").agg(F.max(F.struct("updated_at", "created_at", "gone")).alias("p"))
    merged = left.hint("merge").join(right, [*keys, "_salt"], "left")
    late = F.col("p.created_at") > F.col("ref_at") + F.expr(f"INTERVAL {int(grace_hours)} HOURS")
    outcome = F.when(F.col("p").isNull(), "missing").when(F.col("p.gone"), "deleted").when(late, "late")
    return (
        merged.withColumn("outcome", outcome).where("outcome IS NOT NULL")
        .withColumn("ref_period", F.coalesce(utc_month(F.col("ref_at")), F.lit("unknown")))
        .groupBy("ref_table", "ref_field", "record_id", "ref_period", "namespace", "entry_id").agg(F.min("outcome").alias("outcome"))
    )


def entry_references(edges: DataFrame, postings: DataFrame) -> DataFrame:
    """The references of this project's side tables: edge ends and anchor postings."""
    return references(edges, "memory_graph_edges", ["source_id", "target_id"], "id", iso_instant(F.col("created_at"))).unionByName(
        references(postings, "anchor_postings", ["entry_id"], "posting_id", F.col("indexed_at"))
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table, field, period and outcome."""
    return orphans.groupBy("ref_table", "ref_field", "ref_period", "outcome").agg(F.count(F.lit(1)).alias("n_refs"), F.countDistinct("namespace", "entry_id").alias("n_entries"))
