"""Scans, filters, set operations, joins and counts over entries and their side tables."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import anchor_file, collapsed
from ..functions.times import iso_instant
from ..operators import graph, listing, policy
from .book import Book, entries, table

book = Book()
KEY = ["namespace", "id"]
AT = "TIMESTAMP '2025-06-01 00:00:00+00:00'"
SQL_AT = "TIMESTAMPTZ '2025-06-01 00:00:00+00:00'"


@book.add("{E} SELECT namespace, id, epoch_us(updated_at) AS updated_us FROM entries WHERE status = 'active' AND importance >= 0.5 AND list_contains(tags, 'learning') AND invalid_from IS NULL ORDER BY updated_at DESC, id DESC LIMIT 500")
def s1_list_entries(spark: SparkSession, d: str) -> DataFrame:
    e = entries(spark, d, "status", "importance", "tags", "invalid_from", "updated_at")
    return listing.list_entries(e, status="active", min_importance=0.5, tags=["learning"], exclude_superseded=True, limit=500).select(*KEY, F.unix_micros("updated_at").alias("updated_us"))


@book.add("{E} SELECT namespace, id FROM entries WHERE (updated_at < TIMESTAMPTZ '2025-03-01 00:00:00+00:00' OR (updated_at = TIMESTAMPTZ '2025-03-01 00:00:00+00:00' AND id < 'M-80000000')) ORDER BY updated_at DESC, id DESC LIMIT 500")
def s2_keyset_page(spark, d):
    after = (datetime.datetime(2025, 3, 1, tzinfo=datetime.timezone.utc), "M-80000000")
    return listing.list_entries(entries(spark, d, "updated_at"), after=after, limit=500).select(*KEY)


@book.add("{E} SELECT namespace, id FROM entries WHERE id > 'M-40000000' AND id <= 'M-c0000000'")
def s3_id_sweep(spark, d):
    return listing.sweep_page(entries(spark, d), "M-40000000", "M-c0000000").select(*KEY)


@book.add("{E} SELECT namespace, id, status FROM entries e WHERE EXISTS (SELECT 1 FROM replay_events r WHERE r.namespace = e.namespace AND r.learning_id = e.id)")
def s4_get_many(spark, d):
    keys = table(spark, d, "replay_events").select("namespace", F.col("learning_id").alias("id"))
    return listing.get_many(entries(spark, d, "status"), keys)


@book.add("SELECT DISTINCT namespace FROM memories")
def s5_namespaces(spark, d):
    return table(spark, d, "memories").select("namespace").distinct()


@book.add("{E} SELECT namespace, count(*) AS n FROM entries GROUP BY 1")
def s6_count(spark, d):
    return entries(spark, d).groupBy("namespace").agg(F.count(F.lit(1)).alias("n"))


@book.add("{E} SELECT namespace, id FROM entries e WHERE EXISTS (SELECT 1 FROM anchor_postings a WHERE a.namespace = e.namespace AND a.entry_id = e.id)")
def s7_anchored(spark, d):
    a = table(spark, d, "anchor_postings").select("namespace", F.col("entry_id").alias("id"))
    return listing.get_many(entries(spark, d), a)


@book.add("""{E}, a AS (SELECT DISTINCT namespace, file, entry_id FROM anchor_postings WHERE entry_id IS NOT NULL)
SELECT file, namespace, entry_id, rn FROM (SELECT a.file, a.namespace, a.entry_id, row_number() OVER (PARTITION BY a.file, a.namespace ORDER BY e.importance DESC NULLS LAST, e.updated_at DESC, e.id) AS rn
FROM a JOIN entries e ON e.namespace = a.namespace AND e.id = a.entry_id WHERE e.status = 'active') WHERE rn <= 5""")
def s8_anchored_entries(spark, d):
    a = table(spark, d, "anchor_postings").where("entry_id IS NOT NULL").select("namespace", anchor_file(F.col("file")).alias("file"), F.col("entry_id").alias("id")).where("file IS NOT NULL").distinct()
    e = entries(spark, d, "status", "importance", "updated_at").where("status = 'active'")
    w = Window.partitionBy("file", "namespace").orderBy(F.desc_nulls_last("importance"), F.desc("updated_at"), "id")
    return a.join(e, KEY).withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("file", "namespace", F.col("id").alias("entry_id"), F.col("rn").cast("bigint").alias("rn"))


@book.add("{E} SELECT source_identity, namespace, id FROM entries WHERE source_identity LIKE '%@agents'")
def s9_ids_by_source(spark, d):
    return entries(spark, d, "source_identity").where(F.col("source_identity").endswith("@agents")).select("source_identity", *KEY)


@book.add("{E} SELECT namespace, id, epoch_us(updated_at) AS updated_us FROM entries WHERE updated_at >= " + SQL_AT)
def s10_change_feed(spark, d):
    return listing.changed_since(entries(spark, d, "updated_at"), F.expr(AT)).select(*KEY, F.unix_micros("updated_at").alias("updated_us"))


@book.add("{E} SELECT namespace, id, sync_seq FROM entries e WHERE sync_seq > 1000000 AND (last_synced_at IS NULL OR last_synced_at < updated_at OR EXISTS (SELECT 1 FROM queue_records q WHERE q.namespace = e.namespace AND q.entry_id = e.id))")
def s11_dirty_rows(spark, d):
    """Rows that wait for their queue record count as never synced."""
    waiting = table(spark, d, "queue_records").select("namespace", F.col("entry_id").alias("id")).distinct().withColumn("waits", F.lit(True))
    e = entries(spark, d, "sync_seq", "last_synced_at", "updated_at").join(waiting, KEY, "left").withColumn("last_synced_at", F.when(F.col("waits").isNull(), F.col("last_synced_at")))
    return listing.dirty_rows(e, 1_000_000, changed=True).select(*KEY, "sync_seq")


@book.add("""{E}, q AS (SELECT namespace, entry_id AS id, arg_max(payload, queue_id) AS payload FROM queue_records WHERE lower(op) IN ('insert', 'update') GROUP BY 1, 2)
SELECT namespace, id, status, round(importance, 6) AS importance FROM entries e WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.namespace = e.namespace AND q.id = e.id)
UNION ALL SELECT namespace, id, payload->>'$.status', round(CAST(payload->>'$.importance' AS double), 6) FROM q""")
def s18_upsert(spark, d):
    p = F.from_json("payload", "status string, importance double")
    batch = table(spark, d, "queue_records").where("lower(op) IN ('insert', 'update')").select("namespace", F.col("entry_id").alias("id"), p["status"].alias("status"), p["importance"].alias("importance"), "queue_id")
    out = listing.upsert(entries(spark, d, "status", "importance"), batch, "queue_id")
    return out.select(*KEY, "status", F.round("importance", 6).alias("importance"))


@book.add("""{E}, p AS (SELECT namespace, entry_id AS id, count(*) AS n FROM (SELECT DISTINCT * FROM anchor_postings) GROUP BY 1, 2)
SELECT e.namespace, e.id, e.access_count + coalesce(p.n, 0) AS access_count, CASE WHEN p.n >= 3 THEN 'verified' ELSE e.confidence END AS confidence,
epoch_us(CASE WHEN p.n >= 3 THEN TIMESTAMPTZ '2026-09-01 00:00:00+00:00' ELSE e.updated_at END) AS updated_us, e.sync_seq + CASE WHEN p.n IS NULL THEN 0 ELSE 1 END AS sync_seq
FROM entries e LEFT JOIN p ON p.namespace = e.namespace AND p.id = e.id""")
def s19_update(spark, d):
    n = table(spark, d, "anchor_postings").distinct().groupBy("namespace", F.col("entry_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    e = entries(spark, d, "access_count", "confidence", "updated_at", "sync_seq")
    patch = n.join(e.select(*KEY, "access_count"), KEY).select(*KEY, (F.col("access_count") + F.col("n")).alias("access_count"), F.when(F.col("n") >= 3, "verified").alias("confidence"))
    out = listing.update_fields(e, patch, ["access_count", "confidence"], ["access_count"], F.expr("TIMESTAMP '2026-09-01 00:00:00+00:00'"))
    return out.select(*KEY, "access_count", "confidence", F.unix_micros("updated_at").alias("updated_us"), "sync_seq")


@book.add("""{E}, gone AS (SELECT namespace, id FROM entries WHERE status = 'obsolete')
SELECT 'entries' AS part, count(*) AS n FROM entries e WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.namespace = e.namespace AND g.id = e.id)
UNION ALL SELECT 'tags', count(*) FROM memory_tags t WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.namespace = t.namespace AND g.id = t.entry_id)
UNION ALL SELECT 'anchors', count(*) FROM anchor_postings t WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.namespace = t.namespace AND g.id = t.entry_id)
UNION ALL SELECT 'edges', count(*) FROM memory_graph_edges t WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.namespace = t.namespace AND (g.id = t.source_id OR g.id = t.target_id))""")
def s20_delete_cascade(spark, d):
    e = entries(spark, d, "status")
    left = listing.delete_cascade(e.where("status = 'obsolete'"), e, table(spark, d, "memory_tags"), table(spark, d, "anchor_postings"), table(spark, d, "memory_graph_edges"))
    parts = [f.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("part"), "n") for k, f in left.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


# -- predicates -------------------------------------------------------------------------------------------
@book.add("{E} SELECT namespace, id FROM entries WHERE list_has_all(tags, ['learning']) AND len(tags) >= 2 UNION ALL SELECT 'planted', 'P-1' UNION ALL SELECT 'planted', 'P-2'")
def f1_tag_superset(spark, d):
    """Rows with ``learning`` and another tag of theirs; of four planted rows two have both tags asked for."""
    planted = spark.createDataFrame([("planted", "P-1", ["learning", "x"]), ("planted", "P-2", ["y", "x", "learning"]), ("planted", "P-3", ["learning"]), ("planted", "P-4", None)], "namespace string, id string, tags array<string>")
    e = entries(spark, d, "tags").select(*KEY, "tags")
    return e.where(listing.has_tags(["learning"]) & (F.size("tags") >= 2)).select(*KEY).unionByName(planted.where(listing.has_tags(["learning", "x"])).select(*KEY))


@book.add("""{E} SELECT namespace, id FROM entries WHERE contains(lower(id), 'ledger') OR contains(lower(content), 'ledger') OR contains(lower(coalesce(detail, '')), 'ledger')
OR len(list_filter(coalesce(tags, []), lambda t: contains(lower(t), 'ledger'))) > 0""")
def f2_contains(spark, d):
    return entries(spark, d, "content", "detail", "tags").where(listing.contains_text("ledger")).select(*KEY)


@book.add("""{E}, h AS (SELECT namespace, id, importance,
 CAST(contains(lower(concat_ws(chr(1), id, content, detail, array_to_string(tags, chr(1)))), 'ledger') AS int) AS a,
 CAST(contains(lower(concat_ws(chr(1), id, content, detail, array_to_string(tags, chr(1)))), 'vector') AS int) AS b,
 CAST(contains(lower(concat_ws(chr(1), id, content, detail, array_to_string(tags, chr(1)))), 'midnight') AS int) AS c FROM entries),
m AS (SELECT * FROM h WHERE a + b + c > 0), s AS (SELECT count(*) AS n, sum(a) AS da, sum(b) AS db, sum(c) AS dc FROM m)
SELECT namespace, id, round(a * (ln((n + 1) / (da + 1)) + 1) + b * (ln((n + 1) / (db + 1)) + 1) + c * (ln((n + 1) / (dc + 1)) + 1), 6) AS score FROM m, s""")
def f3_keyword_rank(spark, d):
    out = listing.keyword_rank(entries(spark, d, "content", "detail", "tags", "importance"), ["ledger", "vector", "midnight"])
    return out.select(*KEY, F.round("score", 6).alias("score"))


@book.add("{E} SELECT namespace, id FROM entries WHERE coalesce(valid_from, created_at) <= " + SQL_AT + " AND (invalid_from IS NULL OR " + SQL_AT + " < invalid_from)")
def f4_in_force(spark, d):
    return entries(spark, d, "valid_from", "created_at", "invalid_from").where(policy.in_force(F.expr(AT))).select(*KEY)


@book.add("""{E}, r AS (SELECT *, coalesce(coalesce(valid_from, created_at) <= """ + SQL_AT + " AND (invalid_from IS NULL OR " + SQL_AT + """ < invalid_from), false) AS open_ FROM entries)
SELECT namespace, id, row_number() OVER (PARTITION BY namespace ORDER BY CASE WHEN open_ THEN 0 ELSE 1 END, importance DESC NULLS LAST, id) AS rk FROM r""")
def f5_validity_prior(spark, d):
    w = Window.partitionBy("namespace").orderBy(F.desc_nulls_last("importance"), "id")
    r = entries(spark, d, "importance", "valid_from", "created_at", "invalid_from").withColumn("rk", F.row_number().over(w)).withColumn("query_id", F.col("namespace"))
    return policy.validity_prior(r, F.expr(AT), drop=False).select(*KEY, F.col("rk").cast("bigint").alias("rk"))


@book.add("""SELECT namespace_id, bool_or(CASE WHEN expires_at IS NOT NULL THEN expires_at <= """ + SQL_AT + """ ELSE coalesce(lower(status) = 'expired', false) END) AS expired FROM memory_namespaces GROUP BY 1""")
def l13_team_expiry(spark, d):
    n = table(spark, d, "memory_namespaces").withColumn("x", policy.team_expired(F.col("expires_at"), F.col("status"), F.expr(AT)))
    return n.groupBy("namespace_id").agg(F.max("x").alias("expired"))


@book.add("""SELECT queue_id, CASE WHEN length(trim(queued_at)) > 10 THEN coalesce(CASE WHEN regexp_matches(queued_at, '([zZ]|[+-]\\d\\d:?\\d\\d)$') THEN try_cast(queued_at AS timestamptz) ELSE try_cast(queued_at || '+00' AS timestamptz) END < """ + SQL_AT + """, false) ELSE false END AS passed
FROM (SELECT DISTINCT queue_id, queued_at FROM queue_records)""".replace("\\\\", "\\"))
def f6_expiry(spark, d):
    q = table(spark, d, "queue_records").select("queue_id", "queued_at").distinct()
    return q.select("queue_id", policy.expired(F.col("queued_at"), F.expr(AT)).alias("passed"))


_FAMILY = """CASE source WHEN 'import' THEN 'semantic_memory' WHEN 'consolidation' THEN 'lifecycle' ELSE coalesce(list_filter(list_transform(coalesce(tags, []), lambda t:
 CASE WHEN t = 'source_kind:git' OR t LIKE 'distill:%' OR t LIKE 'distilled:%' THEN 'git_distilled' WHEN t = 'change_bulletin' THEN 'lifecycle' END), lambda f: f IS NOT NULL)[1], 'unknown') END"""


def _kind():
    return F.create_map(F.lit("import"), F.lit("semantic_memory"), F.lit("consolidation"), F.lit("lifecycle"))[F.col("source")]


@book.add("{E} SELECT family, count(*) AS n FROM (SELECT " + _FAMILY + " AS family FROM entries) GROUP BY 1")
def f7_source_family(spark, d):
    e = entries(spark, d, "source", "tags")
    return e.groupBy(policy.source_family(F.col("tags"), _kind()).alias("family")).agg(F.count(F.lit(1)).alias("n"))


@book.add("{E} SELECT namespace, id, family FROM (SELECT namespace, id, " + _FAMILY + " AS family FROM entries) WHERE family NOT IN ('lifecycle')")
def f8_source_policy(spark, d):
    e = entries(spark, d, "source", "tags").withColumn("family", policy.source_family(F.col("tags"), _kind()))
    return e.where(policy.admitted(F.col("family"), exclude=["lifecycle"])).select(*KEY, "family")


@book.add("{E} SELECT namespace, id FROM entries WHERE coalesce(CASE confidence WHEN 'verified' THEN 0.95 WHEN 'high' THEN 0.8 WHEN 'medium' THEN 0.6 WHEN 'low' THEN 0.3 END, importance, 0.0) >= 0.6")
def f9_admission(spark, d):
    e = entries(spark, d, "confidence", "importance")
    stated = F.try_element_at(F.create_map(F.lit("verified"), F.lit("0.95"), F.lit("high"), F.lit("0.8"), F.lit("medium"), F.lit("0.6"), F.lit("low"), F.lit("0.3")), F.coalesce("confidence", F.lit("")))
    return e.where(policy.confident(0.6, stated, F.col("importance"))).select(*KEY)


@book.add("{E} SELECT namespace, id FROM (SELECT *, " + _FAMILY + " AS family FROM entries) WHERE status = 'active' AND list_contains(tags, 'learning') AND memory_type IN ('pattern', 'incident') AND family <> 'lifecycle' AND coalesce(importance, 0) >= 0.3")
def f10_recall_gate(spark, d):
    e = entries(spark, d, "status", "tags", "memory_type", "source", "importance")
    fam = policy.source_family(F.col("tags"), _kind())
    gate = (F.col("status") == "active") & listing.has_tags(["learning"]) & F.col("memory_type").isin("pattern", "incident") & policy.admitted(fam, exclude=["lifecycle"]) & policy.confident(0.3, F.lit(None).cast("string"), F.col("importance"))
    return e.where(gate).select(*KEY)


@book.add("""{E}, r AS (SELECT *, CASE WHEN invalid_from IS NOT NULL THEN 2 WHEN source = 'human' THEN 0 ELSE 1 END AS bucket FROM entries WHERE status = 'active')
SELECT namespace, id, bucket FROM (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY bucket, updated_at DESC, id DESC) AS rn FROM r) WHERE rn <= 20""")
def f11_priority_fill(spark, d):
    e = entries(spark, d, "status", "source", "invalid_from", "updated_at").where("status = 'active'")
    bucket = F.when(F.col("invalid_from").isNotNull(), 2).when(F.col("source") == "human", 0).otherwise(1)
    w = Window.partitionBy("namespace").orderBy("bucket", F.desc("updated_at"), F.desc("id"))
    return e.withColumn("bucket", bucket).withColumn("rn", F.row_number().over(w)).where("rn <= 20").select(*KEY, "bucket")


@book.add("{E} SELECT namespace, id, round(importance, 6) AS score FROM entries WHERE status = 'active' AND importance >= 0.7 AND source_identity LIKE 'lintel%' AND created_at >= TIMESTAMPTZ '2024-06-01 00:00:00+00:00'")
def f13_search(spark, d):
    e = entries(spark, d, "status", "importance", "source_identity", "created_at")
    since = F.expr("TIMESTAMP '2024-06-01 00:00:00+00:00'")
    return e.where((F.col("status") == "active") & (F.col("importance") >= 0.7) & F.col("source_identity").startswith("lintel") & (F.col("created_at") >= since)).select(*KEY, F.round("importance", 6).alias("score"))


@book.add("{E}, m AS (SELECT * FROM entries WHERE status = 'active') SELECT namespace, id, (SELECT count(*) FROM m) AS total FROM m ORDER BY updated_at DESC, id DESC LIMIT 100 OFFSET 200")
def f14_page(spark, d):
    e = entries(spark, d, "status", "updated_at").where("status = 'active'")
    return listing.page(e, [F.desc("updated_at"), F.desc("id")], 200, 100).select(*KEY, "total")


# decisions on ids from the feed, on remote ids of rows waiting for deletion, on the hashes of contents that the feed calls obsolete
_LEDGER = """led AS (SELECT DISTINCT queue_id AS seq, 'id' AS kind, namespace AS scope, entry_id AS value, CASE WHEN last_error IS NOT NULL THEN 'quarantined' WHEN lower(op) = 'delete' THEN 'rejected' ELSE 'approved' END AS decision FROM queue_records
UNION ALL SELECT DISTINCT sync_seq, 'src', '', remote_id, CASE WHEN pending_delete THEN 'quarantined' ELSE 'approved' END FROM memories WHERE remote_id IS NOT NULL
UNION ALL SELECT DISTINCT queue_id, 'hash', '', sha256(coalesce(payload->>'$.content', '')), CASE WHEN payload->>'$.status' = 'obsolete' THEN 'rejected' ELSE 'approved' END FROM queue_records),
lat AS (SELECT kind, scope, value, arg_max(decision, (seq, decision)) AS decision FROM led GROUP BY 1, 2, 3)"""


def _ledger(spark, d):
    dec = F.when(F.col("last_error").isNotNull(), "quarantined").when(F.lower("op") == "delete", "rejected").otherwise("approved")
    q, m = table(spark, d, "queue_records"), table(spark, d, "memories")
    p = F.from_json("payload", "content string, status string")
    by_id = q.select(F.col("queue_id").alias("seq"), F.lit("id").alias("kind"), F.col("namespace").alias("scope"), F.col("entry_id").alias("value"), dec.alias("decision"))
    by_source = m.where("remote_id IS NOT NULL").select(F.col("sync_seq").alias("seq"), F.lit("src").alias("kind"), F.lit("").alias("scope"), F.col("remote_id").alias("value"), F.when(F.col("pending_delete"), "quarantined").otherwise("approved").alias("decision"))
    by_hash = q.select(F.col("queue_id").alias("seq"), F.lit("hash").alias("kind"), F.lit("").alias("scope"), F.sha2(F.coalesce(p["content"], F.lit("")), 256).alias("value"), F.when(p["status"] == "obsolete", "rejected").otherwise("approved").alias("decision"))
    return by_id.unionByName(by_source).unionByName(by_hash).distinct()


@book.add("{E}, " + _LEDGER + " SELECT namespace, id FROM entries e WHERE NOT EXISTS (SELECT 1 FROM lat l WHERE l.decision IN ('quarantined', 'rejected') AND l.kind = 'id' AND l.scope = e.namespace AND l.value = e.id) AND NOT EXISTS (SELECT 1 FROM lat l WHERE l.decision IN ('quarantined', 'rejected') AND l.kind = 'src' AND l.value = e.remote_id) AND NOT EXISTS (SELECT 1 FROM lat l WHERE l.decision IN ('quarantined', 'rejected') AND l.kind = 'hash' AND l.value = sha256(concat(coalesce(e.content, ''), coalesce(e.detail, ''))))")
def f15_quarantine(spark, d):
    return policy.without_quarantined(entries(spark, d, "content", "detail", "remote_id"), _ledger(spark, d)).select(*KEY)


@book.add("WITH " + _LEDGER + ", n AS (SELECT scope, value, sum(CASE WHEN decision <> coalesce(before, '') THEN 1 ELSE 0 END) AS episodes FROM (SELECT DISTINCT scope, value, seq, decision, lag(decision) OVER (PARTITION BY scope, value ORDER BY seq, decision) AS before FROM led WHERE kind = 'id') GROUP BY 1, 2) SELECT l.scope AS namespace, l.value AS entry_id, l.decision, n.episodes FROM lat l JOIN n ON n.scope = l.scope AND n.value = l.value WHERE l.kind = 'id'")
def w2_ledger(spark, d):
    led = _ledger(spark, d).where("kind = 'id'")
    before = F.lag("decision").over(Window.partitionBy("kind", "scope", "value").orderBy("seq", "decision"))
    runs = led.withColumn("new", (F.col("decision") != F.coalesce(before, F.lit(""))).cast("bigint"))
    out = runs.groupBy("scope", "value").agg(F.max_by("decision", F.struct("seq", "decision")).alias("decision"), F.sum("new").alias("episodes"))
    return out.select(F.col("scope").alias("namespace"), F.col("value").alias("entry_id"), "decision", "episodes")


@book.add("""{E} SELECT level, level <= 2 AS shared, count(*) AS n FROM (SELECT greatest(CASE WHEN namespace LIKE 'user:%' THEN 3 ELSE 2 END, CASE WHEN namespace LIKE 'org:%' THEN 3 ELSE 0 END,
CASE WHEN list_contains(tags, 'learning') THEN 4 ELSE 0 END) AS level FROM entries) GROUP BY 1""")
def f18_labels(spark, d):
    """Levels by rule, and whether a sink of clearance team admits them."""
    e = entries(spark, d, "tags")
    level = policy.label_level(F.col("namespace"), F.col("tags"), F.lit(None).cast("string"), {"org:*": "personal"}, {"learning": "sensitive"})
    return e.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).withColumn("shared", policy.admitted_to(F.col("level"), "team"))


# -- joins and set operations -----------------------------------------------------------------------------
@book.add("""WITH t AS (SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS c FROM documents WHERE text IS NOT NULL) SELECT doc_id, n FROM (SELECT doc_id, count(*) OVER (PARTITION BY c) AS n FROM t) WHERE n > 1""")
def j7_exact_duplicates(spark, d):
    """Equal texts meet by their digest: texts themselves are not shuffled."""
    t = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha2(collapsed(F.col("text")), 256).alias("c"))
    n = t.groupBy("c").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return t.join(n, "c").select("doc_id", "n")


@book.add("""{E} SELECT DISTINCT m.id FROM memory_graph_edges m WHERE NOT EXISTS (SELECT 1 FROM entries e WHERE e.namespace = m.namespace AND e.id = m.source_id) OR NOT EXISTS (SELECT 1 FROM entries e WHERE e.namespace = m.namespace AND e.id = m.target_id)""")
def j8_orphan_edges(spark, d):
    k = table(spark, d, "memories").select("namespace", "id").distinct()
    e = table(spark, d, "memory_graph_edges").select("id", "namespace", "source_id", "target_id")
    ok = e.join(k.withColumnRenamed("id", "source_id"), ["namespace", "source_id"], "left_semi").join(k.withColumnRenamed("id", "target_id"), ["namespace", "target_id"], "left_semi")
    return e.select("id").distinct().join(ok.select("id").distinct(), "id", "left_anti")


@book.add("{E} SELECT count(*) AS n_ghosts FROM (SELECT DISTINCT namespace, entry_id FROM memory_tags) t WHERE NOT EXISTS (SELECT 1 FROM entries e WHERE e.namespace = t.namespace AND e.id = t.entry_id)")
def j9_ghost_rows(spark, d):
    t = table(spark, d, "memory_tags").select("namespace", F.col("entry_id").alias("id")).distinct()
    return t.join(table(spark, d, "memories").select(*KEY).distinct(), KEY, "left_anti").agg(F.count(F.lit(1)).alias("n_ghosts"))


@book.add("{E} SELECT DISTINCT q.namespace, q.entry_id AS id FROM queue_records q JOIN entries e ON e.namespace = q.namespace AND e.id = q.entry_id")
def j10_existing_ids(spark, d):
    q = table(spark, d, "queue_records").select("namespace", F.col("entry_id").alias("id")).distinct()
    return q.join(table(spark, d, "memories").select(*KEY).distinct(), KEY, "left_semi")


@book.add("{E} SELECT DISTINCT m.namespace, m.target_id FROM memory_graph_edges m JOIN entries e ON e.namespace = m.namespace AND e.id = m.target_id WHERE e.status = 'active'")
def j11_valid_targets(spark, d):
    t = table(spark, d, "memory_graph_edges").select("namespace", F.col("target_id").alias("id")).distinct()
    return t.join(entries(spark, d, "status").where("status = 'active'"), KEY, "left_semi").select("namespace", F.col("id").alias("target_id"))


@book.add("""{E}, w AS (SELECT DISTINCT namespace, learning_id AS id FROM replay_events WHERE learning_id IS NOT NULL),
r AS (SELECT DISTINCT e.namespace, e.remote_id FROM entries e JOIN w ON w.namespace = e.namespace AND w.id = e.id WHERE e.remote_id IS NOT NULL)
SELECT e.namespace, e.id FROM entries e WHERE EXISTS (SELECT 1 FROM w WHERE w.namespace = e.namespace AND w.id = e.id) OR EXISTS (SELECT 1 FROM r WHERE r.namespace = e.namespace AND r.remote_id = e.remote_id)""")
def j12_synced_match(spark, d):
    e = entries(spark, d, "remote_id")
    w = table(spark, d, "replay_events").select("namespace", F.col("learning_id").alias("id")).where("id IS NOT NULL").distinct()
    by_id = e.join(w, KEY, "left_semi")
    by_remote = e.join(by_id.where("remote_id IS NOT NULL").select("namespace", "remote_id").distinct(), ["namespace", "remote_id"], "left_semi")
    return by_id.select(*KEY).union(by_remote.select(*KEY)).distinct()


@book.add("""{E}, q AS (SELECT namespace, entry_id, list_sort(list(DISTINCT tag)) AS more FROM memory_tags WHERE tag IS NOT NULL GROUP BY 1, 2), j AS (SELECT e.namespace, e.id, list_concat(coalesce(e.tags, []), q.more) AS x FROM entries e JOIN q ON q.namespace = e.namespace AND q.entry_id = e.id)
SELECT namespace, id, array_to_string(list_filter(x, lambda t, i: list_position(x, t) = i), '|') AS tags FROM j""")
def u3_tag_union(spark, d):
    """The row's own tags in their order, then the new ones (by name, as the postings have no order)."""
    t = table(spark, d, "memory_tags").where("tag IS NOT NULL").groupBy("namespace", F.col("entry_id").alias("id")).agg(F.array_sort(F.collect_set("tag")).alias("more"))
    both = F.array_distinct(F.concat(F.coalesce("tags", F.array().cast("array<string>")), "more"))
    return entries(spark, d, "tags").join(t, KEY).select(*KEY, F.array_join(both, "|").alias("tags"))


@book.add("{E} SELECT namespace, count(*) AS n FROM (SELECT CASE WHEN namespace = 'default' AND NOT EXISTS (SELECT 1 FROM entries x WHERE x.namespace = 'project:harborlight' AND x.id = e.id) THEN 'project:harborlight' ELSE namespace END AS namespace, id FROM entries e) GROUP BY 1")
def u6_namespace_merge(spark, d):
    return listing.move_namespace(entries(spark, d), "default", "project:harborlight", merge=True).groupBy("namespace").agg(F.count(F.lit(1)).alias("n"))


@book.add("SELECT namespace, id FROM memories INTERSECT SELECT namespace, entry_id FROM queue_records EXCEPT SELECT namespace, learning_id FROM replay_events")
def u7_set_ops(spark, d):
    m = table(spark, d, "memories").select(*KEY)
    q = table(spark, d, "queue_records").select("namespace", F.col("entry_id").alias("id"))
    r = table(spark, d, "replay_events").select("namespace", F.col("learning_id").alias("id"))
    return m.intersect(q).exceptAll(r.distinct()).distinct()


# -- aggregates -------------------------------------------------------------------------------------------
@book.add("{E} SELECT namespace, status, count(*) AS n, grouping(status) AS g FROM entries GROUP BY ROLLUP (namespace, status) HAVING namespace IS NOT NULL")
def a1_status_rollup(spark, d):
    e = entries(spark, d, "status").rollup("namespace", "status").agg(F.count(F.lit(1)).alias("n"), F.grouping("status").cast("bigint").alias("g"))
    return e.where("namespace IS NOT NULL")


@book.add("""{E}, g AS (SELECT namespace, count(*) AS edges FROM (SELECT DISTINCT id, namespace FROM memory_graph_edges) GROUP BY 1)
SELECT e.namespace, count(*) AS n, count(*) FILTER (WHERE source = 'import') AS imported, max(access_count) AS most, count(*) FILTER (WHERE coalesce(nullif(memory_type, ''), 'pattern') = 'pattern') AS patterns,
count(*) FILTER (WHERE memory_type = 'incident') AS incidents, coalesce(max(g.edges), 0) AS edges FROM entries e LEFT JOIN g ON g.namespace = e.namespace GROUP BY 1""")
def a2_health(spark, d):
    g = table(spark, d, "memory_graph_edges").select("id", "namespace").distinct().groupBy("namespace").agg(F.count(F.lit(1)).alias("edges"))
    kind = F.coalesce(F.nullif("memory_type", F.lit("")), F.lit("pattern"))
    h = entries(spark, d, "source", "access_count", "memory_type").groupBy("namespace").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("source") == "import").alias("imported"), F.max("access_count").alias("most"), F.count_if(kind == "pattern").alias("patterns"), F.count_if(F.col("memory_type") == "incident").alias("incidents"))
    return h.join(g, "namespace", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))


@book.add("SELECT label, len(embedding) AS dim, count(*) AS n FROM embeddings GROUP BY 1, 2")
def a3_vector_census(spark, d):
    return table(spark, d, "embeddings").groupBy("label", F.size("embedding").cast("bigint").alias("dim")).agg(F.count(F.lit(1)).alias("n"))


@book.add("SELECT namespace, tag, count(*) AS df, count(*) > 500 AS hub FROM (SELECT DISTINCT namespace, entry_id, lower(trim(tag)) AS tag FROM memory_tags WHERE trim(tag) <> '' AND namespace IS NOT NULL AND entry_id IS NOT NULL) GROUP BY 1, 2")
def a4_tag_df(spark, d):
    """Posting counts a namespace; a tag of more than 500 is a hub that gives no neighbours."""
    t = table(spark, d, "memory_tags").select("namespace", "entry_id", F.lower(F.trim("tag")).alias("tag")).where("tag <> '' AND namespace IS NOT NULL AND entry_id IS NOT NULL")
    return graph.tag_frequencies(t)


@book.add("""SELECT date_trunc('day', t) AS day, count(*) AS n FROM (SELECT DISTINCT id, timezone('UTC', CASE WHEN regexp_matches(trim(created_at), '^\\d{4}-\\d\\d-\\d\\d[T ].*([zZ]|[+-]\\d\\d(:?\\d\\d)?)$') THEN try_cast(trim(created_at) AS timestamptz) ELSE try_cast(trim(created_at) || '+00' AS timestamptz) END) AS t FROM memory_graph_edges) WHERE t IS NOT NULL GROUP BY 1""".replace("\\\\", "\\").replace("SELECT date_trunc('day', t) AS day", "SELECT strftime(t, '%Y-%m-%d') AS day"))
def a18_edges_per_day(spark, d):
    t = iso_instant(F.col("created_at"))
    day = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_micros("t") / 86_400_000_000).cast("int")), "yyyy-MM-dd")
    return table(spark, d, "memory_graph_edges").select("id", t.alias("t")).distinct().where("t IS NOT NULL").groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"))


def queries() -> dict:
    return book.queries


def oracle_sql() -> dict[str, str]:
    return book.sql
