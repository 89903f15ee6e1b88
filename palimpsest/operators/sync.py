"""Replication: clocks, conflicts, acknowledgements, retries, admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .changefeed import CLOCK, clock_order

MAX_DETAIL = 2000
MAX_RETRIES = 5


def clock_relation(a: Column, b: Column) -> Column:
    """``after``, ``before``, ``equal`` or ``concurrent``."""
    empty = F.create_map().cast(CLOCK)
    differs = F.exists(F.map_values(F.map_zip_with(F.coalesce(a, empty), F.coalesce(b, empty), lambda _, x, y: F.coalesce(x, F.lit(0)) != F.coalesce(y, F.lit(0)))), lambda x: x)
    order = clock_order(a, b)
    return F.when(order == 1, "after").when(order == -1, "before").when(differs, "concurrent").otherwise("equal")


def merged_clock(a: Column, b: Column) -> Column:
    empty = F.create_map().cast(CLOCK)
    return F.map_zip_with(F.coalesce(a, empty), F.coalesce(b, empty), lambda _, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))


def incremented(clock: Column, node: str) -> Column:
    c = F.coalesce(clock, F.create_map().cast(CLOCK))
    one = F.create_map(F.lit(node), F.coalesce(F.try_element_at(c, F.lit(node)), F.lit(0)).cast("bigint") + 1)
    return F.map_concat(F.map_filter(c, lambda k, _: k != node), one)


def resolve_conflicts(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Both sides of each (namespace, id): the dominated side loses; concurrent sides merge.

    A merge unites tags (sorted), joins differing details (at most MAX_DETAIL characters), takes the greater
    importance and the greatest clock of every node.
    """
    r = remote.select("namespace", "id", *[F.col(c).alias(f"r_{c}") for c in ("content", "detail", "tags", "importance", "vector_clock")])
    j = local.join(r, ["namespace", "id"])
    rel = clock_relation(F.col("vector_clock"), F.col("r_vector_clock"))
    none = F.array().cast("array<string>")
    pick = lambda c, merged: F.when(F.col("relation").isin("after", "equal"), F.col(c)).when(F.col("relation") == "before", F.col(f"r_{c}")).otherwise(merged)
    own, other = F.coalesce("detail", F.lit("")), F.coalesce("r_detail", F.lit(""))
    joined = F.when((other == "") | (own == other), own).when(own == "", other).otherwise(F.concat_ws("\n", own, other))
    j = j.withColumn("relation", rel)
    return j.select(
        "namespace", "id", "relation", pick("content", F.col("content")).alias("content"), pick("detail", F.substring(joined, 1, MAX_DETAIL)).alias("detail"),
        pick("tags", F.array_sort(F.array_union(F.coalesce("tags", none), F.coalesce("r_tags", none)))).alias("tags"), pick("importance", F.greatest("importance", "r_importance")).alias("importance"),
        merged_clock(F.col("vector_clock"), F.col("r_vector_clock")).alias("vector_clock"),
    )


def acknowledge(entries: DataFrame, acks: DataFrame, at: Column) -> DataFrame:
    """last_synced_at set where the acknowledged sync_seq is still the row's."""
    a = acks.groupBy("namespace", "id").agg(F.max("expected_seq").alias("_seq"))
    j = entries.join(a, ["namespace", "id"], "left")
    ok = F.coalesce(F.col("_seq") == F.col("sync_seq"), F.lit(False))
    return j.withColumn("acked", ok).withColumn("last_synced_at", F.when(ok, at).otherwise(F.col("last_synced_at"))).drop("_seq")


def retry_plan(queue: DataFrame, depth: int | None = None) -> DataFrame:
    """State of each record: ``dead`` after MAX_RETRIES, else ``due`` with its back-off of 2^(n-1) s, 30 at most."""
    n = F.col("retry_count")
    wait = F.when(n > 0, F.least(F.pow(F.lit(2.0), n - 1), F.lit(30.0))).otherwise(F.lit(0.0))
    out = queue.withColumn("state", F.when(n >= MAX_RETRIES, "dead").otherwise("due")).withColumn("wait_s", F.when(F.col("state") == "due", wait))
    return out.orderBy("queue_id").limit(depth) if depth else out


def admit_remote(rows: DataFrame, namespaces: DataFrame) -> DataFrame:
    """Rows with ``admitted`` and ``reason``; what cannot be judged is refused."""
    known = namespaces.select(F.col("namespace_id").alias("namespace"), F.lit(True).alias("_known")).distinct()
    reason = (
        F.when(F.col("_known").isNull(), "unknown_namespace").when(F.col("content").isNull() | (F.trim("content") == ""), "no_content")
        .when(F.col("importance").isNull() | F.isnan("importance") | (F.col("importance") < 0) | (F.col("importance") > 1), "bad_importance").when(F.col("status") != "active", "not_active")
    )
    return rows.join(known, "namespace", "left").withColumn("reason", reason).withColumn("admitted", F.col("reason").isNull()).drop("_known")


def change_token(entries: DataFrame, deletes: DataFrame | None = None, by: str = "namespace") -> DataFrame:
    """(namespace, n, last_us, last_seq, delete_epoch): a token that moves with every change; ``deletes`` (namespace)
    has a row for every deletion so far, as rows that are gone leave no other trace."""
    token = entries.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.max(F.unix_micros("updated_at")).alias("last_us"), F.max("sync_seq").alias("last_seq"))
    if deletes is None:
        return token.withColumn("delete_epoch", F.lit(0).cast("bigint"))
    epochs = deletes.groupBy(by).agg(F.count(F.lit(1)).alias("delete_epoch"))
    return token.join(epochs, by, "left").withColumn("delete_epoch", F.coalesce("delete_epoch", F.lit(0)))


def publishable(entries: DataFrame, least: float = 0.7) -> DataFrame:
    """Rows for publishing: importance enough, identities hashed, texts and tags within limits."""
    out = entries.where(F.col("importance") >= least)
    return out.select(
        "namespace", "id", F.substring("content", 1, 1000).alias("content"), F.substring(F.coalesce("detail", F.lit("")), 1, 10_000).alias("detail"), F.slice("tags", 1, 20).alias("tags"),
        F.left(F.sha2(F.sha2(F.coalesce("source_identity", F.lit("")), 256), 256), F.lit(16)).alias("installation"),
    )


def canonical_hash(*cols: Column) -> Column:
    """sha256 of the columns as JSON in the given order (our own canonical form)."""
    return F.sha2(F.to_json(F.struct(*cols)), 256)
