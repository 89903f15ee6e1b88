"""Scans, predicates, paging and row changes over entries.  A key is (namespace, id)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["namespace", "id"]


def has_tags(required: Sequence[str], tags: str = "tags") -> Column:
    """The row has every required tag, exactly."""
    want = F.array(*[F.lit(t) for t in required]).cast("array<string>")
    return F.size(F.array_except(want, F.coalesce(tags, F.array().cast("array<string>")))) == 0


def list_entries(df: DataFrame, namespace: str | None = None, status: str | None = None, min_importance: float | None = None, tags: Sequence[str] = (), exclude_superseded: bool = False, after: tuple | None = None, limit: int | None = None) -> DataFrame:
    """Newest first (updated_at, id descending); every predicate applies before the limit.

    ``after`` is the (updated_at, id) of the last row of the page before.
    """
    if namespace is not None:
        df = df.where(F.col("namespace") == namespace)
    if status is not None:
        df = df.where(F.col("status") == status)
    if min_importance is not None:
        df = df.where(F.col("importance") >= min_importance)
    if tags:
        df = df.where(has_tags(tags))
    if exclude_superseded:
        df = df.where("invalid_from IS NULL")
    if after is not None:
        at, id_ = F.lit(after[0]), F.lit(after[1])
        df = df.where((F.col("updated_at") < at) | ((F.col("updated_at") == at) & (F.col("id") < id_)))
    df = df.orderBy(F.desc("updated_at"), F.desc("id"))
    return df.limit(limit) if limit else df


def sweep_page(df: DataFrame, after: str, through: str) -> DataFrame:
    return df.where((F.col("id") > after) & (F.col("id") <= through)).orderBy("id", "namespace")


def get_many(df: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows named by ``keys`` (namespace, id)."""
    return df.join(keys.select(*KEY).distinct(), KEY, "left_semi")


def changed_since(df: DataFrame, token: Column) -> DataFrame:
    """At-least-once change feed: rows at or after the token."""
    return df.where(F.col("updated_at") >= token)


def dirty_rows(df: DataFrame, since: int, after_id: str | None = None, changed: bool = False) -> DataFrame:
    """Rows above the sync cursor that were never synced (``changed``: or not since their last update), by (sync_seq, id)."""
    cursor = F.col("sync_seq") > since
    if after_id is not None:
        cursor = cursor | ((F.col("sync_seq") == since) & (F.col("id") > after_id))
    dirty = F.col("last_synced_at").isNull()
    if changed:
        dirty = dirty | (F.col("last_synced_at") < F.col("updated_at"))
    return df.where(cursor & dirty).orderBy("sync_seq", "id")


def contains_text(needle: str, tags: str = "tags") -> Column:
    """Case-insensitive substring of id, content, detail or a tag (no wildcards)."""
    n = needle.lower()
    return F.lower("id").contains(n) | F.lower("content").contains(n) | F.coalesce(F.lower("detail").contains(n), F.lit(False)) | F.coalesce(F.exists(tags, lambda t: F.lower(t).contains(n)), F.lit(False))


def keyword_rank(df: DataFrame, tokens: Sequence[str]) -> DataFrame:
    """Rows that contain any token, by the sum of the idf of those they contain (idf within the matching rows).

    idf = ln((N + 1) / (df + 1)) + 1; order by score, importance, id, all descending.
    """
    hit = df
    for i, t in enumerate(tokens):
        hit = hit.withColumn(f"_h{i}", contains_text(t).cast("int"))
    any_hit = F.greatest(*[F.col(f"_h{i}") for i in range(len(tokens))], F.lit(0)) == 1
    hit = hit.where(any_hit)
    stats = hit.agg(F.count(F.lit(1)).alias("_n"), *[F.sum(f"_h{i}").alias(f"_d{i}") for i in range(len(tokens))])
    score = sum(((F.log((F.col("_n") + 1) / (F.col(f"_d{i}") + 1)) + 1) * F.col(f"_h{i}") for i in range(len(tokens))), F.lit(0.0))
    out = hit.join(F.broadcast(stats)).withColumn("score", score)
    return out.drop(*[f"_h{i}" for i in range(len(tokens))], *[f"_d{i}" for i in range(len(tokens))], "_n").orderBy(F.desc("score"), F.desc_nulls_last("importance"), F.desc("id"))


def page(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """Rows offset .. offset + limit of the order, with the total number of rows."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    top = df.orderBy(*order).offset(offset).limit(limit)
    return top.join(F.broadcast(total))


# -- row changes ------------------------------------------------------------------------------------------
def upsert(base: DataFrame, batch: DataFrame, position: str) -> DataFrame:
    """Base rows replaced by batch rows of their key; of several in the batch the last wins."""
    w = Window.partitionBy(*KEY).orderBy(F.desc(position))
    last = batch.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*base.columns)
    return base.join(last.select(*KEY), KEY, "left_anti").unionByName(last)


def update_fields(base: DataFrame, patch: DataFrame, fields: Sequence[str], bookkeeping: Sequence[str], now: Column) -> DataFrame:
    """Fields of ``patch`` that are not null replace those of the row.

    updated_at moves to ``now`` unless only bookkeeping fields change; sync_seq grows by 1 for any change.
    """
    p = patch.select(*KEY, *[F.col(f).alias(f"_p_{f}") for f in fields])
    j = base.join(p, KEY, "left")
    changed = lambda names: F.coalesce(F.greatest(*[F.col(f"_p_{f}").isNotNull().cast("int") for f in names], F.lit(0)) == 1, F.lit(False)) if names else F.lit(False)
    real = changed([f for f in fields if f not in bookkeeping])
    cols: Mapping[str, Column] = {f: F.coalesce(f"_p_{f}", f) for f in fields} | {"updated_at": F.when(real, now).otherwise(F.col("updated_at")), "sync_seq": F.col("sync_seq") + changed(list(fields)).cast("bigint")}
    return j.withColumns(dict(cols)).select(*base.columns)


def delete_cascade(deleted: DataFrame, entries: DataFrame, tags: DataFrame, anchors: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """Every table without the deleted entries and what hangs on them."""
    keys = deleted.select(*KEY).distinct()
    of = lambda c: keys.withColumnRenamed("id", c)
    return {
        "entries": entries.join(keys, KEY, "left_anti"),
        "tags": tags.join(of("entry_id"), ["namespace", "entry_id"], "left_anti"),
        "anchors": anchors.join(of("entry_id"), ["namespace", "entry_id"], "left_anti"),
        "edges": edges.join(of("source_id"), ["namespace", "source_id"], "left_anti").join(of("target_id"), ["namespace", "target_id"], "left_anti"),
    }


def move_namespace(entries: DataFrame, source: str, destination: str, merge: bool) -> DataFrame:
    """Rows of ``source`` renamed to ``destination``.

    A rename needs an empty destination; a merge keeps the destination's row of a shared id and leaves the
    source's where it is.
    """
    there = entries.where(F.col("namespace") == destination)
    if not merge:
        if not there.isEmpty():
            raise ValueError(f"{destination} is not empty")
        return entries.withColumn("namespace", F.when(F.col("namespace") == source, F.lit(destination)).otherwise(F.col("namespace")))
    mine, rest = entries.where(F.col("namespace") == source), entries.where(~F.coalesce(F.col("namespace") == source, F.lit(False)))
    taken = there.select("id").withColumn("_taken", F.lit(True))  # only the source's rows meet the destination's
    moved = mine.join(taken, "id", "left").withColumn("namespace", F.when(F.col("_taken").isNull(), F.lit(destination)).otherwise(F.col("namespace")))
    return rest.unionByName(moved.select(*entries.columns))
