"""Consolidation, deduplication, decay and promotion of entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import decayed_importance
from ..functions.text import collapsed

KEY = ["namespace", "id"]
# Confidence and protection levels, weakest first.
CONFIDENCE = ["unverified", "low", "medium", "high", "verified"]
COUNTER_CAP = 1_000_000_000
TAG_LIMIT = 20


def strength(level: Column, levels: list[str]) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(x) for x in levels]), level), F.lit(0))


def capped_tags(df: DataFrame, group: list[str], tags: str = "tags", most: int = TAG_LIMIT) -> DataFrame:
    """The ``most`` tags of each group by (count descending, name)."""
    n = df.select(*group, F.explode(F.array_distinct(tags)).alias("tag")).groupBy(*group, "tag").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*group).orderBy(F.desc("n"), "tag")
    top = n.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)
    return top.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "tag"))), lambda x: x["tag"]).alias("tags"))


def consolidated_fields(members: DataFrame, group: list[str]) -> DataFrame:
    """Merged fields of each group: greatest importance, top tags, summed counters, strongest confidence, longest text."""
    best = F.max_by(F.struct("id", "content"), F.struct(F.length("content") + F.length(F.coalesce("detail", F.lit(""))), F.lit(0) - F.col("position"))).alias("rep")
    merged = members.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.max("importance").alias("importance"), F.least(F.sum("access_count"), F.lit(COUNTER_CAP)).alias("access_count"),
        F.max(strength(F.col("confidence"), CONFIDENCE)).alias("conf"), best,
    )
    tags = capped_tags(members, group)
    level = F.try_element_at(F.array(*[F.lit(x) for x in CONFIDENCE]), F.col("conf").cast("int"))
    return merged.join(tags, group, "left").select(*group, "n", "importance", "access_count", level.alias("confidence"), F.col("rep.id").alias("representative"), "tags")


def exact_duplicates(df: DataFrame) -> DataFrame:
    """(namespace, id, kept_id): every active row with the smallest id of its collapsed content and detail."""
    t = df.withColumn("c", collapsed(F.col("content"))).withColumn("x", collapsed(F.col("detail")))
    kept = t.groupBy("namespace", "c", "x").agg(F.min("id").alias("kept_id"))
    return t.join(kept, ["namespace", "c", "x"]).select(*KEY, "kept_id")


def duplicate_verdict(best: Column, skip: float = 0.95, merge: float = 0.85) -> Column:
    """``skip`` or ``merge`` by the best cosine; thresholds in the wrong order fall back to .95 and .85."""
    if merge >= skip:
        skip, merge = 0.95, 0.85
    return F.when(best >= skip, "skip").when(best >= merge, "merge").otherwise("store")


def merge_entries(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows folded into old rows of the same key: tags and lineage united in order, greatest importance,
    recurrence + 1, counters summed, the stronger confidence, differing detail appended."""
    n = new.select(*KEY, *[F.col(c).alias(f"n_{c}") for c in ("detail", "tags", "importance", "access_count", "confidence", "source_id")])
    j = old.join(n, KEY)
    none = F.array().cast("array<string>")
    detail = F.when((F.coalesce("n_detail", F.lit("")) == "") | F.coalesce("detail", F.lit("")).contains(F.coalesce("n_detail", F.lit(""))), F.coalesce("detail", F.lit(""))).otherwise(F.concat_ws("\n", F.nullif("detail", F.lit("")), "n_detail"))
    conf = F.when(strength(F.col("n_confidence"), CONFIDENCE) > strength(F.col("confidence"), CONFIDENCE), F.col("n_confidence")).otherwise(F.col("confidence"))
    return j.select(
        *KEY, F.array_distinct(F.concat(F.coalesce("tags", none), F.coalesce("n_tags", none))).alias("tags"), F.greatest("importance", "n_importance").alias("importance"),
        (F.coalesce("recurrence", F.lit(1)) + 1).alias("recurrence"), F.least(F.coalesce("access_count", F.lit(0)) + F.coalesce("n_access_count", F.lit(0)), F.lit(COUNTER_CAP)).alias("access_count"),
        conf.alias("confidence"), detail.alias("detail"), F.array_distinct(F.concat(F.coalesce("merged_from", none), F.array("n_source_id"))).alias("merged_from"),
    )


def greedy_dedup(pairs: DataFrame, group: str = "namespace") -> DataFrame:
    """(group, id, into): ordered greedy over similar pairs (group, a, b, a < b in arrival order): b joins the
    first kept a.

    A row is dropped iff an earlier kept row pairs with it.  Resolved in rounds: rows whose earlier partners
    are all decided get their verdict; the number of rounds is the longest chain of undecided partners.
    """
    from ..sources.scratch import written

    live = written(pairs.select(group, "a", "b"), "greedy")
    kept = written(live.select(group, F.col("a").alias("id")).distinct().join(live.select(group, F.col("b").alias("id")).distinct(), [group, "id"], "left_anti"), "kept")
    out = None
    while not live.isEmpty():
        hit = live.join(kept.withColumnRenamed("id", "a"), [group, "a"], "left_semi").groupBy(group, "b").agg(F.min("a").alias("into"))
        hit = written(hit, "dropped")
        done = hit.select(group, F.col("b").alias("id"), "into")
        out = done if out is None else out.unionByName(done)
        gone = hit.select(group, "b")
        rest = live.join(gone, [group, "b"], "left_anti").join(gone.withColumnRenamed("b", "a"), [group, "a"], "left_anti")
        rest = rest.join(kept.withColumnRenamed("id", "a"), [group, "a"], "left_anti")
        rest = written(rest, "greedy")
        undecided = live.join(gone, [group, "b"], "left_anti").select(group, F.col("b").alias("id")).distinct()
        kept = written(undecided.join(rest.select(group, F.col("b").alias("id")).distinct(), [group, "id"], "left_anti"), "kept")
        live = rest
    return out if out is not None else pairs.select(group, F.col("b").alias("id"), F.col("a").alias("into")).limit(0)


def complete_linkage(pairs: DataFrame, group: str, least_size: int = 3) -> DataFrame:
    """(group, cluster, id): clusters whose members are all similar, merged in the order of the pairs (a, b).

    ``pairs`` (group, a, b; a < b) are the similar ones.  Two clusters merge at a pair of theirs if every pair
    across is similar.  Each merge depends on those before, so one task walks the similar pairs of one group (not
    its rows squared).
    """
    import pandas as pd

    def run(pdf):
        near: dict[int, set[int]] = {}
        order = sorted(set(zip(pdf["a"].tolist(), pdf["b"].tolist())))
        for a, b in order:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        of = {x: x for x in near}
        members = {x: [x] for x in near}
        for a, b in order:
            p, q = of[a], of[b]
            if p != q and all(near[x].issuperset(members[q]) for x in members[p]):
                for x in members.pop(q):
                    members[p].append(x)
                    of[x] = p
        rows = [(pdf[group].iloc[0], n, x) for n, c in enumerate(sorted(sorted(c) for c in members.values() if len(c) >= least_size)) for x in c]
        return pd.DataFrame(rows, columns=[group, "cluster", "id"]).astype({"cluster": "int64", "id": "int64"})

    kind = dict(pairs.dtypes)[group]
    return pairs.select(group, "a", "b").groupBy(group).applyInPandas(run, f"`{group}` {kind}, cluster bigint, id bigint")


def decay_pass(df: DataFrame, now: Column, cutoff_days: int = 90) -> DataFrame:
    """Importance lowered by .1 where nothing touched the row for ``cutoff_days``; ``decayed`` marks those rows."""
    old = F.coalesce("last_accessed_at", "created_at") < now - F.expr(f"INTERVAL {int(cutoff_days)} DAYS")
    hit = F.coalesce(old & F.col("importance").isNotNull(), F.lit(False))
    return df.withColumn("decayed", hit).withColumn("importance", F.when(hit, decayed_importance(F.col("importance"))).otherwise(F.col("importance")))


def promotions(df: DataFrame, existing: DataFrame, least: float = 0.7) -> DataFrame:
    """Rows important enough for the team, with the id of their copy; copies that exist are skipped."""
    out = df.where(F.col("importance") >= least).withColumn("promoted_id", F.concat(F.lit("promoted-"), "id"))
    return out.join(existing.select(F.col("id").alias("promoted_id")).distinct(), "promoted_id", "left_anti")


def count_accesses(df: DataFrame, recalled: DataFrame, at: Column) -> DataFrame:
    """access_count raised by the distinct recalls of each key, capped, and last_accessed_at set."""
    n = recalled.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"))
    j = df.join(n, KEY, "left")
    hit = F.col("_n").isNotNull()
    return j.withColumn("access_count", F.least(F.coalesce("access_count", F.lit(0)) + F.coalesce("_n", F.lit(0)), F.lit(COUNTER_CAP))).withColumn("last_accessed_at", F.when(hit, at).otherwise(F.col("last_accessed_at"))).drop("_n")


def verdict(failing: Column, passing: Column, total: Column, all_failing_days: Column, anchors: Column, anchor_floor: int = 1) -> Column:
    """``stale`` if all checks have failed for over 30 days, ``verified`` if none fails and anchors suffice, else null."""
    return F.when((total > 0) & (failing == total) & (all_failing_days > 30), "stale").when((total > 0) & (failing == 0) & (passing > 0) & (anchors >= anchor_floor), "verified")


def check_penalty(failing: Column, total: Column) -> Column:
    return F.when(total > 0, F.lit(0.15) * failing / total).otherwise(F.lit(0.0))
