"""Upkeep of a store: corrections, forgetting, consolidation, verification against files, tiers, integrity, census."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import slug_of
from ..sources.scratch import written
from .lifecycle import consolidated_fields
from .listing import contains_text

KEY = ["namespace", "id"]
ROWS_MAX, CLUSTER_MAX = 50, 10  # a cycle's newest rows of a namespace, and the largest cluster it merges
FORGET_MAX = 10_000
ASSERTIONS_AT_ONCE = 100
SEARCHED_BYTES = 1_000_000  # larger files are not searched


# -- corrections and forgetting ---------------------------------------------------------------------------
def corrected(entries: DataFrame, patches: DataFrame, fields: Sequence[str], now: Column, revision: str = "sync_seq") -> tuple[DataFrame, DataFrame]:
    """(entries, results): one patch a key applied; results (namespace, id, result).

    A patch has the key, ``fields`` (null: unchanged), tags_add (added behind the row's tags) and if_revision
    (null: any).  ``missing``: no such row; ``conflict``: the row has another revision; ``invalid``: importance
    outside [0, 1] or an unknown status; else ``applied``, or ``unchanged`` if it names nothing.  A change moves
    updated_at and the revision; a retired row (obsolete) is closed.
    """
    p = patches.select(*KEY, *[F.col(f).alias(f"_p_{f}") for f in fields], F.col("tags_add").alias("_add"), F.col("if_revision").alias("_if"))
    j = entries.withColumn("_there", F.lit(True)).join(p.withColumn("_asked", F.lit(True)), KEY, "full")
    bad = F.lit(False)
    if "importance" in fields:
        bad = bad | (F.col("_p_importance").isNotNull() & ~F.col("_p_importance").between(0.0, 1.0))
    if "status" in fields:
        bad = bad | (F.col("_p_status").isNotNull() & ~F.col("_p_status").isin("active", "resolved", "obsolete", "obsolete_poisoned"))
    new_tags = F.array_except(F.coalesce("_add", F.array().cast("array<string>")), F.coalesce("tags", F.array().cast("array<string>")))
    names = F.greatest(*[F.col(f"_p_{f}").isNotNull() for f in fields], F.size(new_tags) > 0)
    result = (
        F.when(F.col("_asked").isNull(), None).when(F.col("_there").isNull(), "missing").when(F.col("_if").isNotNull() & ~F.col("_if").eqNullSafe(F.col(revision)), "conflict")
        .when(bad, "invalid").when(~names, "unchanged").otherwise("applied")
    )
    j = written(j.withColumn("_result", result), "corrected")
    hit = F.coalesce(F.col("_result") == "applied", F.lit(False))
    put = {f: F.when(hit, F.coalesce(f"_p_{f}", f)).otherwise(F.col(f)) for f in fields}
    put |= {"tags": F.when(hit & (F.size(new_tags) > 0), F.concat(F.coalesce("tags", F.array().cast("array<string>")), new_tags)).otherwise(F.col("tags"))}
    put |= {"updated_at": F.when(hit, now).otherwise(F.col("updated_at")), revision: F.when(hit, F.coalesce(revision, F.lit(0)) + 1).otherwise(F.col(revision))}
    if "status" in fields and "invalid_from" in entries.columns:
        put |= {"invalid_from": F.when(hit & (F.col("_p_status") == "obsolete"), F.coalesce("invalid_from", now)).otherwise(F.col("invalid_from"))}
    return j.where("_there").withColumns(put).select(*entries.columns), j.where("_asked").select(*KEY, F.col("_result").alias("result"))


def forgotten(entries: DataFrame, ids: DataFrame | None = None, query: str | None = None, actor: str | None = None, canaries: DataFrame | None = None, most: int = FORGET_MAX) -> tuple[DataFrame, bool]:
    """(keys, truncated): the keys to delete, by ``ids`` (namespace, id), a text or an actor.

    Rows of any status go.  By text and by actor the newest ``most`` go and ``truncated`` tells whether there are
    more; by id all named rows that exist go, except canaries, which only this way protects.
    """
    if ids is not None:
        found = entries.join(ids.select(*KEY).distinct(), KEY, "left_semi")
        return (found if canaries is None else found.join(canaries.select(*KEY).distinct(), KEY, "left_anti")).select(*KEY), False
    found = entries.where(contains_text(query) if query is not None else F.col("source_identity") == actor)
    top = written(found.orderBy(F.desc("updated_at"), F.desc("id"), "namespace").limit(most + 1).select(*KEY, "updated_at"), "forgotten")
    truncated = top.count() > most
    return (top.orderBy(F.desc("updated_at"), F.desc("id"), "namespace").limit(most) if truncated else top).select(*KEY), truncated


# -- consolidation ----------------------------------------------------------------------------------------
def consolidation_rows(entries: DataFrame, most: int = ROWS_MAX) -> DataFrame:
    """The newest ``most`` active rows of a namespace (the limit of one cycle) without those already merged or made by
    a merge, exempt from removal (``protected``) or canaries (``canary``); ``position`` by age, newest first."""
    w = Window.partitionBy("namespace").orderBy(F.desc("updated_at"), F.desc("id"))
    newest = entries.where("status = 'active'").withColumn("position", F.row_number().over(w).cast("bigint")).where(F.col("position") <= most)
    return newest.where("consolidated_into IS NULL AND coalesce(source, '') <> 'consolidated' AND NOT coalesce(protected, false) AND NOT coalesce(canary, false)")


def mean_similarity(vectors: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, n, mean_similarity): mean cosine of all pairs of a group, 0 for fewer than two vectors.

    The sum over pairs is (|sum of unit vectors|^2 - sum of squares) / 2, so the work is one sum a dimension.
    ``vectors`` has the group columns and vector; zero vectors have cosine 0, null ones do not count.
    """
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = F.when(norm > 0, F.transform("vector", lambda x: x.cast("double") / norm)).otherwise(F.transform("vector", lambda x: F.lit(0.0)))
    u = vectors.where("vector IS NOT NULL").select(*group, F.posexplode(unit).alias("at", "x"))
    per = u.groupBy(*group, "at").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    sums = per.groupBy(*group).agg(F.sum(F.col("s") * F.col("s")).alias("all"), F.sum("q").alias("own"))
    n = vectors.where("vector IS NOT NULL").groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    mean = F.when(F.col("n") > 1, (F.col("all") - F.col("own")) / (F.col("n") * (F.col("n") - 1))).otherwise(F.lit(0.0))
    return n.join(sums, list(group), "left").select(*group, "n", F.coalesce(mean, F.lit(0.0)).alias("mean_similarity"))


def consolidated(entries: DataFrame, clusters: DataFrame, now: Column, least: int = 3, most: int = CLUSTER_MAX) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(merged, originals, skipped) of clusters (namespace, cluster, id, position).

    merged: one row a cluster of ``least`` to ``most`` members with the merged fields, an id made of its members'
    ids, merged_from and valid_from ``now``.  originals: its members, archived, closed at ``now`` and naming the
    merged row.  skipped: (namespace, cluster, n) of clusters out of bounds.
    """
    size = clusters.groupBy("namespace", "cluster").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("id")).alias("merged_from"))
    size = written(size, "sizes")
    fit = size.where(F.col("n").between(least, most)).withColumn("new_id", F.concat(F.lit("M-"), F.left(F.sha2(F.array_join("merged_from", ","), 256), F.lit(16))))
    members = clusters.join(fit.select("namespace", "cluster", "new_id"), ["namespace", "cluster"]).join(entries, KEY)
    fields = consolidated_fields(members, ["namespace", "cluster"]).drop("n")
    text = members.select("namespace", "cluster", F.col("id").alias("representative"), "content", "detail")
    merged = fit.join(fields, ["namespace", "cluster"]).join(text, ["namespace", "cluster", "representative"]).select(
        "namespace", F.col("new_id").alias("id"), "content", "detail", "tags", "importance", "access_count", "confidence", "merged_from", F.lit("consolidated").alias("source"), F.lit("active").alias("status"), now.alias("valid_from"))
    originals = members.withColumns({"status": F.lit("archived"), "invalid_from": now, "consolidated_into": F.col("new_id")}).select(*entries.columns)
    return merged, originals, size.where(~F.col("n").between(least, most)).select("namespace", "cluster", "n")


# -- verification against files ---------------------------------------------------------------------------
def glob_pattern(glob: str) -> str:
    """A glob as a regular expression: ``**`` passes slashes, ``*`` and ``?`` do not."""
    import re

    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i])), i + 1
    return "^" + out + "$"


def _sound(pattern: str | None) -> bool:
    import re

    try:
        return pattern is not None and bool(re.compile(pattern))
    except re.error:
        return False


def verify_assertions(assertions: DataFrame, files: DataFrame, at_once: int = ASSERTIONS_AT_ONCE) -> DataFrame:
    """(assertion_id, n_files, n_hits, result) of assertions (assertion_id, type, pattern, target) over files (path, text).

    ``target`` is a path or a glob.  grep_present holds if a file matches and fails only if every candidate could be
    searched; grep_absent holds only if all could be and none matches; glob_exists and glob_absent look at paths
    (pattern is the glob if target is empty).  A file without text, with a NUL among its first 512 characters
    (binary: left out) or larger than a megabyte cannot be searched.  result is null where nothing can be said or
    the pattern is no regular expression.  Targets that are paths meet their file by a join; globs are tried on
    every path, ``at_once`` of them in a pass.
    """
    greps = F.col("type").startswith("grep")
    sound = F.pandas_udf(lambda p: p.map(_sound), "boolean")
    target = F.coalesce(F.nullif("target", F.lit("")), F.when(greps, F.lit("**")).otherwise(F.col("pattern")), F.lit(""))
    asked = written(assertions.select("assertion_id", "type", "pattern", target.alias("target"), (~greps | sound("pattern")).alias("sound")), "assertions")
    kind = dict(assertions.dtypes)["assertion_id"]
    binary = F.coalesce(F.instr(F.left("text", F.lit(512)), "\x00") > 0, F.lit(False))
    dark = F.col("text").isNull() | (F.octet_length("text") > SEARCHED_BYTES)
    plain = ~F.col("target").rlike(r"[*?]")
    counts = lambda df: df.groupBy("assertion_id").agg(F.count(F.lit(1)).alias("n_files"), F.count_if("hit").alias("n_hits"), F.max("dark").alias("dark"))
    met = asked.where(plain & F.col("sound")).join(files.select(F.col("path").alias("target"), "text"), "target").where(~(greps & binary))
    hit = F.when(~greps, True).otherwise(F.coalesce(F.when(~dark, F.regexp_like("text", F.col("pattern"))), F.lit(False)))
    rows = counts(met.select("assertion_id", hit.alias("hit"), (greps & dark).alias("dark")))
    batch: list = []

    def a_pass(batch: list) -> DataFrame:
        cells = []
        for r in batch:
            grep = r["type"].startswith("grep")
            found = F.coalesce(F.when(~dark, F.col("text").rlike(r["pattern"])), F.lit(False)) if grep else F.lit(True)
            inside = F.col("path").rlike(glob_pattern(r["target"])) & (~binary if grep else F.lit(True))
            cells.append(F.when(inside, F.struct(F.lit(r["assertion_id"]).cast(kind).alias("assertion_id"), found.alias("hit"), (dark if grep else F.lit(False)).alias("dark"))))
        return counts(files.select(F.explode(F.filter(F.array(*cells), lambda c: c.isNotNull())).alias("c")).select("c.*"))

    for r in asked.where(~plain & F.col("sound")).toLocalIterator():
        batch.append(r)
        if len(batch) == at_once:
            rows, batch = rows.unionByName(written(a_pass(batch), "verified")), []
    if batch:
        rows = rows.unionByName(a_pass(batch))
    j = asked.join(rows, "assertion_id", "left").withColumns({"n_files": F.coalesce("n_files", F.lit(0)), "n_hits": F.coalesce("n_hits", F.lit(0)), "dark": F.coalesce("dark", F.lit(False))})
    found, clear = F.col("n_hits") > 0, ~F.col("dark")
    result = (
        F.when(~F.col("sound"), None)
        .when(F.col("type") == "grep_present", F.when(found, True).when(clear, False)).when(F.col("type") == "grep_absent", F.when(found, False).when(clear, True))
        .when(F.col("type") == "glob_exists", found).when(F.col("type") == "glob_absent", ~found)
    )
    return j.select("assertion_id", "n_files", "n_hits", result.alias("result"))


def anchor_validity(anchors: DataFrame, files: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, validity): share of anchors (keys, file, symbol) whose file (path, text) holds the symbol as a whole
    name, two digits.  Anchors without file or symbol count as not valid."""
    text = files.groupBy(F.col("path").alias("file")).agg(F.max("text").alias("text"))
    whole = F.concat(F.lit(r"(?<!\w)\Q"), F.col("symbol"), F.lit(r"\E(?!\w)"))
    j = anchors.join(text, "file", "left")
    ok = F.coalesce((F.col("symbol") != "") & F.regexp_like("text", whole), F.lit(False))
    return j.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(ok.cast("double")).alias("v")).select(*keys, "n", F.bround("v", 2).alias("validity"))


def assertion_health(assertions: DataFrame, now: Column, stale_days: int) -> DataFrame:
    """(namespace, total, passing, failing, stale, unverifiable) of assertions (namespace, id, last_verified_at, last_result);
    total counts entries.  Stale: never verified, or more than ``stale_days`` ago."""
    stale = F.col("last_verified_at").isNull() | (F.col("last_verified_at") < now - F.expr(f"INTERVAL {int(stale_days)} DAYS"))
    return assertions.groupBy("namespace").agg(
        F.countDistinct("id").alias("total"), F.count_if(~stale & F.col("last_result")).alias("passing"), F.count_if(~stale & ~F.col("last_result")).alias("failing"),
        F.count_if(stale).alias("stale"), F.count_if(~stale & F.col("last_result").isNull()).alias("unverifiable"),
    )


def united_assertions(existing: Column, incoming: Column) -> Column:
    """Existing assertions and those incoming whose (type, pattern, target) is new, each once, in order; null is empty."""
    fresh = F.filter(F.coalesce(incoming, F.array()), lambda a: ~F.exists(F.coalesce(existing, F.array()), lambda b: (a["type"] == b["type"]) & (a["pattern"] == b["pattern"]) & (a["target"] == b["target"])))
    once = F.filter(F.transform(fresh, lambda a, i: F.struct(a.alias("a"), i.alias("i"))), lambda x: ~F.exists(F.slice(fresh, F.lit(1), x["i"]), lambda b: (x["a"]["type"] == b["type"]) & (x["a"]["pattern"] == b["pattern"]) & (x["a"]["target"] == b["target"])))
    return F.concat(F.coalesce(existing, F.array()), F.transform(once, lambda x: x["a"]))


# -- tiers ------------------------------------------------------------------------------------------------
def hot_rows(entries: DataFrame, score: Column, group: Sequence[str], most: int = 50) -> DataFrame:
    """The ``most`` rows of each group that the hot tier holds: best score, then key."""
    w = Window.partitionBy(*group).orderBy(F.desc("tier_score"), *KEY)
    return entries.withColumn("tier_score", score).withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= most)


def tier_search(rows: DataFrame, tokens: Sequence[str], top_k: int, near: DataFrame | None = None) -> DataFrame:
    """(namespace, id, score): rows of a tier by the share of the distinct ``tokens`` found in content, detail or tags.

    ``near`` (namespace, id, distance): vector hits; where there are any they replace the keyword search, with
    score 1 - distance^2 / 2.
    """
    if near is not None and not near.isEmpty():
        hits = near.select(*KEY, (F.lit(1.0) - F.col("distance") * F.col("distance") / 2).alias("score"))
    else:
        wanted = sorted({t.lower() for t in tokens})
        text = F.lower(F.concat_ws(" ", "content", F.coalesce("detail", F.lit("")), F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " ")))
        n = sum((text.contains(t).cast("int") for t in wanted), F.lit(0))
        hits = rows.select(*KEY, (n / F.lit(float(max(1, len(wanted))))).alias("score")).where("score > 0")
    return hits.orderBy(F.desc("score"), *KEY).limit(top_k)


# -- integrity, scope, census -----------------------------------------------------------------------------
def integrity_filtered(entries: DataFrame, pins: DataFrame, mode: str) -> DataFrame:
    """Entries with ``intact`` (null without a pin): the content hash is the pinned one (namespace, id, content_hash).
    ``strict`` drops drifted rows, ``observe`` only marks them."""
    if mode not in ("strict", "observe"):
        raise ValueError(mode)
    digest = F.sha2(F.concat(F.coalesce("content", F.lit("")), F.coalesce("detail", F.lit(""))), 256)
    out = entries.join(pins.select(*KEY, "content_hash"), KEY, "left").withColumn("intact", F.col("content_hash") == digest).drop("content_hash")
    return out if mode == "observe" else out.where(F.coalesce("intact", F.lit(True)))


class ScopeError(ValueError):
    """A row outside the namespaces that the caller may see."""


def in_scope(df: DataFrame, scope: DataFrame) -> DataFrame:
    """``df`` if all its namespaces are in ``scope`` (namespace); raises ScopeError otherwise, and for a null namespace."""
    outside = df.select("namespace").distinct().join(scope.select("namespace").distinct(), "namespace", "left_anti").limit(3).collect()
    if outside:
        raise ScopeError(", ".join(str(r["namespace"]) for r in outside))
    return df


def org_shared(entries: DataFrame, own: str, least: float = 0.8, limit: int = 50) -> DataFrame:
    """The ``limit`` best rows that other projects share: cross_validated, important enough; by importance, then newest."""
    rows = entries.where(F.col("namespace").startswith("project:") & (F.col("namespace") != own) & F.coalesce("cross_validated", F.lit(False)) & (F.col("importance") >= least))
    return rows.orderBy(F.desc("importance"), F.desc("updated_at"), *KEY).limit(limit)


def moved_checkouts(registered: DataFrame, counts: DataFrame) -> DataFrame:
    """(namespace, candidate, rows): registered project namespaces without rows and the fullest other namespace of their slug.

    ``counts`` (namespace, rows) is the census.
    """
    mine = registered.select("namespace").distinct().join(counts.where("rows > 0"), "namespace", "left_anti").withColumn("slug", slug_of(F.col("namespace"))).where("slug IS NOT NULL")
    other = counts.where("rows > 0").select(F.col("namespace").alias("candidate"), "rows", slug_of(F.col("namespace")).alias("slug")).where("slug IS NOT NULL")
    best = other.groupBy("slug").agg(F.min_by(F.struct("candidate", "rows"), F.struct(-F.col("rows"), "candidate")).alias("b"))
    return mine.join(best, "slug").select("namespace", "b.candidate", "b.rows")


def promotion_summary(entries: DataFrame, existing: DataFrame, least: float = 0.7) -> DataFrame:
    """(namespace, promoted, discarded, already) of active team rows: copied, not important enough, copied before."""
    rows = entries.where("status = 'active'").withColumn("promoted_id", F.concat(F.lit("promoted-"), "id"))
    j = rows.join(existing.select(F.col("id").alias("promoted_id"), F.lit(True).alias("_old")).distinct(), "promoted_id", "left")
    old, enough = F.col("_old").isNotNull(), F.coalesce(F.col("importance") >= least, F.lit(False))
    return j.groupBy("namespace").agg(F.count_if(~old & enough).alias("promoted"), F.count_if(~old & ~enough).alias("discarded"), F.count_if(old).alias("already"))
