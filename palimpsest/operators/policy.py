"""Predicates and policies of retrieval: validity, expiry, source families, admission, quarantine, labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weight of a source family; families of weight 0 or less are not admitted.
SOURCE_WEIGHTS = {"git_distilled": 0.75, "instruction_rule": 0.95, "semantic_memory": 0.9, "lifecycle": 0.55, "episodic": 0.45, "unknown": 1.0}
KNOWN_FAMILIES = ["instruction_rule", "semantic_memory", "lifecycle", "episodic"]

# Label levels, least confidential first.
LEVELS = ["public", "internal", "team", "personal", "sensitive"]


def expired(expires: Column, at: Column) -> Column:
    """ISO text has passed at an instant: strictly before it, or for a bare date, its day before the instant's.

    Null, empty or unreadable text never expires.
    """
    text = F.trim(expires)
    exact = F.when(text.rlike("([zZ]|[+-][0-9]{2}:?[0-9]{2})$"), text).otherwise(F.concat(text, F.lit("Z"))).try_cast("timestamp")
    by_instant = F.coalesce(exact < at, F.lit(False))
    today = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_micros(at) / 86_400_000_000).cast("int"))
    by_day = F.coalesce(today > text.try_cast("date"), F.lit(False))
    return F.when(text.isNull() | (text == ""), F.lit(False)).when(F.length(text) > 10, by_instant).otherwise(by_day)


def in_force(as_of: Column | None) -> Column:
    """Half-open window: valid_from <= as_of < invalid_from; without as_of, not closed at all.  Null valid_from is created_at."""
    if as_of is None:
        return F.col("invalid_from").isNull()
    return (F.coalesce("valid_from", "created_at") <= as_of) & (F.col("invalid_from").isNull() | (as_of < F.col("invalid_from")))


def validity_prior(ranking: DataFrame, as_of: Column | None, drop: bool, valid_from_min: Column | None = None) -> DataFrame:
    """Closed rows dropped, or kept behind all open ones in their own order."""
    open_ = F.coalesce(in_force(as_of), F.lit(False))
    if valid_from_min is not None:
        ranking = ranking.where(F.coalesce("valid_from", "created_at") >= valid_from_min)
    if drop:
        return ranking.where(open_)
    w = Window.partitionBy("query_id").orderBy((~open_).cast("int"), "rk")
    return ranking.withColumn("_rk", F.row_number().over(w)).drop("rk").withColumnRenamed("_rk", "rk")


def source_family(tags: Column, source_kind: Column | None = None, source: Column | None = None) -> Column:
    """Explicit kind, else the source's prefix, else the first tag that names a family, else ``unknown``."""
    named = lambda k: F.when(k == "git", "git_distilled").when(k.isin(KNOWN_FAMILIES), k)
    of_tag = lambda t: (
        F.coalesce(F.when(t.startswith("source_kind:"), named(F.substring(t, 13, 100))), F.when(t.startswith("distill:") | t.startswith("distilled:"), F.lit("git_distilled")), F.when(t == "change_bulletin", F.lit("lifecycle")))
    )
    by_tag = F.try_element_at(F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), of_tag), lambda f: f.isNotNull()), F.lit(1))
    explicit = named(F.trim(source_kind)) if source_kind is not None else F.lit(None).cast("string")
    prefix = F.when(source.startswith("distilled:git:"), "git_distilled").when(source.startswith("distilled:bulletin:"), "lifecycle") if source is not None else F.lit(None).cast("string")
    return F.coalesce(explicit, prefix, by_tag, F.lit("unknown"))


def family_weight(family: Column, weights: Mapping[str, float] = SOURCE_WEIGHTS) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))]), family), F.lit(1.0))


def admitted(family: Column, include: Sequence[str] = (), exclude: Sequence[str] = (), weights: Mapping[str, float] = SOURCE_WEIGHTS) -> Column:
    ok = family_weight(family, weights) > 0
    if include:
        ok = ok & family.isin(list(include))
    return ok & ~family.isin(list(exclude)) if exclude else ok


def confident(floor: float, stated: Column, importance: Column) -> Column:
    """The stated confidence (unreadable: 0), else the importance, reaches the floor."""
    return F.coalesce(F.when(stated.isNotNull(), F.coalesce(stated.try_cast("double"), F.lit(0.0))).otherwise(importance), F.lit(0.0)) >= floor


def latest_decisions(ledger: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """The newest row of every identity key, of equal ``seq`` the stricter decision; a max that combines map-side."""
    rest = [c for c in ledger.columns if c not in keys]
    return ledger.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(seq, "decision")).alias("_l")).select(*keys, "_l.*")


def identity_keys(df: DataFrame) -> DataFrame:
    """(namespace, id, kind, scope, value): an entry's identities; the content hash is not bound to a namespace."""
    kinds = F.array(
        F.struct(F.lit("id").alias("kind"), F.col("namespace").alias("scope"), F.col("id").alias("value")),
        F.struct(F.lit("src").alias("kind"), F.lit("").alias("scope"), F.col("remote_id").alias("value")),
        F.struct(F.lit("hash").alias("kind"), F.lit("").alias("scope"), F.sha2(F.concat(F.coalesce("content", F.lit("")), F.coalesce("detail", F.lit(""))), 256).alias("value")),
    )
    return df.select("namespace", "id", F.explode(kinds).alias("k")).select("namespace", "id", "k.*").where("value IS NOT NULL")


def without_quarantined(df: DataFrame, ledger: DataFrame) -> DataFrame:
    """Entries none of whose identities has a latest decision of quarantined or rejected."""
    blocked = latest_decisions(ledger, ["kind", "scope", "value"]).where("decision IN ('quarantined', 'rejected')")
    bad = identity_keys(df).join(blocked.select("kind", "scope", "value"), ["kind", "scope", "value"], "left_semi").select("namespace", "id").distinct()
    return df.join(bad, ["namespace", "id"], "left_anti")


def label_level(namespace: Column, tags: Column, stamp: Column, namespace_rules: Mapping[str, str], tag_rules: Mapping[str, str]) -> Column:
    """Confidentiality of a row as an index of LEVELS: the highest of every rule that applies.

    Every row is at least team, ``user:*`` personal; an unknown stamp is sensitive.
    """
    n = {x: i for i, x in enumerate(LEVELS)}
    floors = [F.when(namespace.startswith("user:"), n["personal"]).otherwise(n["team"])]
    floors += [F.when(namespace.like(glob.replace("*", "%")), n.get(level, n["sensitive"])).otherwise(0) for glob, level in namespace_rules.items()]
    floors += [F.when(F.coalesce(F.array_contains(tags, t), F.lit(False)), n.get(level, n["sensitive"])).otherwise(0) for t, level in tag_rules.items()]
    stamped = F.when(stamp.isNull() | (stamp == ""), 0)
    for x, i in n.items():
        stamped = stamped.when(stamp == x, i)
    return F.greatest(*floors, stamped.otherwise(n["sensitive"]))


def admitted_to(level: Column, clearance: str) -> Column:
    """A row of this level may go to a surface or sink of that clearance; a null level is sensitive."""
    return F.coalesce(level, F.lit(LEVELS.index("sensitive"))) <= LEVELS.index(clearance)


def team_expired(expires_at: Column, status: Column, now: Column) -> Column:
    """Inclusive; without an expiry the status decides."""
    return F.when(expires_at.isNotNull(), expires_at <= now).otherwise(F.coalesce(F.lower(status) == "expired", F.lit(False)))
