"""Problem 3: attributes as known at event time.

A validity interval ``[start, stop)`` is cut into dyadic time nodes: node ``(level, n)`` covers the cells
``[n << level, (n + 1) << level)`` of ``leaf`` seconds each.  An interval needs at most two nodes a level;
an event lies in exactly one node of each level.  Events and versions meet by an equi-join on
(key, node); the exact half-open test then removes what the border cells let through, and precedence
picks one version per event with a max that combines map-side.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .current import current_rows
from .skew import skew_join

LEAF_SECONDS = 7 * 86_400
_LEVEL_SHIFT = 48


def event_nodes(cell: Column, levels: int) -> Column:
    """Every dyadic node that encloses ``cell``, one a level."""
    return F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda k: F.shiftleft(k.cast("bigint"), _LEVEL_SHIFT).bitwiseOR(F.call_function("shiftright", cell, k)))


def interval_nodes(lo: Column, hi: Column, levels: int) -> Column:
    """The fewest dyadic nodes that together cover cells ``lo..hi`` (inclusive) and nothing else.

    At level k the open range is ``[a_k, b_k)`` with a_k = ceil(lo / 2^k), b_k = floor((hi+1) / 2^k);
    the node a_k is taken if it is odd, b_k - 1 if b_k is odd, while the range is not empty.
    """
    def at(k: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("bigint"), k)
        a = F.floor((lo + size - 1) / size).cast("bigint")
        b = F.floor((hi + 1) / size).cast("bigint")
        tag = F.shiftleft(k.cast("bigint"), _LEVEL_SHIFT)
        none = F.array().cast("array<bigint>")
        left = F.when((a < b) & (a % 2 == 1), F.array(tag.bitwiseOR(a))).otherwise(none)
        # the right node, unless it is the one just taken on the left
        right = F.when((a < b) & (b % 2 == 1) & ((a % 2 == 0) | (b - 1 > a)), F.array(tag.bitwiseOR(b - 1))).otherwise(none)
        top = F.when((a < b) & (k == F.lit(levels)), F.transform(F.sequence(a, b - 1), lambda n: tag.bitwiseOR(n))).otherwise(none)
        return F.when(k == F.lit(levels), top).otherwise(F.concat(left, right))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at))


def cell_of(instant: Column, leaf: int, origin: int) -> Column:
    return (F.floor((F.unix_micros(instant) - F.lit(origin)) / F.lit(leaf * 1_000_000))).cast("bigint")


def as_of_join(events: DataFrame, versions: DataFrame, event: str, at: str, keys: list[str], start: str, stop: str, precedence: list[str], leaf: int = LEAF_SECONDS) -> DataFrame:
    """``event`` and ``_v`` (a struct of ``precedence``) of the version in force at ``at``.

    ``versions`` has ``keys``, ``start``, ``stop`` (null: open) and the precedence columns, greatest first
    in order; null precedence values are lowest.  Events or versions with a null key, time or start match
    nothing; an interval with stop <= start is empty.  An event outside all intervals gives no row, a
    repeated event one row.  Empty tables give an empty result.
    """
    span = events.agg(F.min(F.unix_micros(at)).alias("lo"), F.max(F.unix_micros(at)).alias("hi")).first()
    lo, hi = (span["lo"], span["hi"]) if span and span["lo"] is not None else (0, 0)
    cells = (hi - lo) // (leaf * 1_000_000) + 1
    levels = max(0, math.ceil(math.log2(cells)))
    last = cells - 1
    ev = events.where(F.col(at).isNotNull()).select(*keys, event, at, F.explode(event_nodes(cell_of(F.col(at), leaf, lo), levels)).alias("_node"))
    first = F.greatest(cell_of(F.col(start), leaf, lo), F.lit(0).cast("bigint"))
    final = F.least(F.coalesce(cell_of(F.col(stop) - F.expr("INTERVAL 1 MICROSECOND"), leaf, lo), F.lit(last)), F.lit(last).cast("bigint"))
    vs = versions.where(F.col(start).isNotNull() & (F.col(stop).isNull() | (F.col(stop) > F.col(start)))).withColumn("_lo", first).withColumn("_hi", final).where("_lo <= _hi")
    vs = vs.select(*keys, F.col(start).alias("_start"), F.col(stop).alias("_stop"), F.struct(*precedence).alias("_v"), F.explode(interval_nodes(F.col("_lo"), F.col("_hi"), levels)).alias("_node"))
    met = skew_join(ev, vs, [*keys, "_node"], [event]).where(F.col("_start") <= F.col(at)).where(F.col("_stop").isNull() | (F.col(at) < F.col("_stop")))
    return met.groupBy(event).agg(F.max("_v").alias("_v"))


def learning_versions(memories: DataFrame) -> DataFrame:
    """Current rows as intervals: namespace, id, learning, start, stop, shown_from, created_at.

    An entry is known from created_at and valid from valid_from (null: created_at).  invalid_from closes
    it, but not before the entry named in invalidated_by was stored, if that entry exists here.
    Written to the shared folder, as several joins read it.
    """
    rows = written(current_rows(memories, ["namespace", "id"], "updated_at", ["created_at", "valid_from", "invalid_from", "invalidated_by", "remote_id"]), "versions")
    closer = rows.select("namespace", F.col("id").alias("invalidated_by"), F.col("created_at").alias("closer_at"))
    closed = skew_join(rows.where("invalid_from IS NOT NULL AND invalidated_by IS NOT NULL"), closer, ["namespace", "invalidated_by"], ["id"], "left")
    never = rows.where("invalid_from IS NULL OR invalidated_by IS NULL").withColumn("closer_at", F.lit(None).cast("timestamp"))
    both = closed.unionByName(never)
    shown = F.coalesce("valid_from", "created_at")
    return both.select(
        "namespace", "id", F.coalesce(F.concat(F.lit("r:"), "remote_id"), F.concat(F.lit("i:"), "id")).alias("learning"),
        F.when(F.col("created_at").isNotNull(), F.greatest("created_at", shown)).alias("start"),
        F.when(F.col("invalid_from").isNotNull(), F.greatest("invalid_from", "closer_at")).alias("stop"),
        shown.alias("shown_from"), "created_at",
    )


def learnings_at_events(events: DataFrame, memories: DataFrame, leaf: int = LEAF_SECONDS) -> DataFrame:
    """(event_id, entry_id): the version of the event's learning in force and known at event_at."""
    versions = written(learning_versions(memories), "intervals")
    named = events.where("learning_id IS NOT NULL AND namespace IS NOT NULL AND event_at IS NOT NULL").select("event_id", "event_at", "namespace", F.col("learning_id").alias("id"))
    keyed = written(skew_join(named, versions.select("namespace", "id", "learning"), ["namespace", "id"], ["event_id"]).select("event_id", "event_at", "namespace", "learning"), "events")
    wanted = versions.join(keyed.select("namespace", "learning").distinct(), ["namespace", "learning"], "left_semi")
    out = as_of_join(keyed, wanted, "event_id", "event_at", ["namespace", "learning"], "start", "stop", ["shown_from", "created_at", "id"], leaf)
    return out.select("event_id", F.col("_v.id").alias("entry_id"))
