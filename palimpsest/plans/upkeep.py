"""Corrections, forgetting, consolidation, verification, tiers, integrity, census and files, over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scoring
from ..operators import recall, upkeep
from ..sources import formats
from ..sources.scratch import new_path
from .book import Book, entries, table
from .lifecycle import _vectors
from .listing import AT, SQL_AT
from .ranking import NOW, SQL_NOW

book = Book()
KEY = ["namespace", "id"]


# -- corrections, forgetting ------------------------------------------------------------------------------
_PATCH = """pt AS (SELECT namespace, entry_id AS id, arg_max({'i': round(CAST(payload->>'$.importance' AS double) * 1.3, 4), 's': payload->>'$.status', 'r': CASE WHEN retry_count > 0 THEN revision.sync_seq END}, queue_id) AS x FROM queue_records WHERE lower(op) = 'update' GROUP BY 1, 2),
co AS (SELECT coalesce(e.namespace, p.namespace) AS namespace, coalesce(e.id, p.id) AS id, e.importance, e.status, e.sync_seq, e.tags, e.invalid_from, p.x, CASE WHEN p.id IS NULL THEN NULL WHEN e.id IS NULL THEN 'missing' WHEN p.x.r IS NOT NULL AND p.x.r IS DISTINCT FROM e.sync_seq THEN 'conflict'
 WHEN p.x.i NOT BETWEEN 0 AND 1 OR p.x.s NOT IN ('active', 'resolved', 'obsolete', 'obsolete_poisoned') THEN 'invalid' ELSE 'applied' END AS result, e.id IS NOT NULL AS there FROM entries e FULL JOIN pt p ON p.namespace = e.namespace AND p.id = e.id)"""


def _corrected(spark, d):
    p = F.from_json("payload", "importance double, status string")
    x = F.struct(F.round(p["importance"] * 1.3, 4).alias("importance"), p["status"].alias("status"), F.when(F.col("retry_count") > 0, F.col("revision.sync_seq")).alias("if_revision"))
    q = table(spark, d, "queue_records").where("lower(op) = 'update'").groupBy("namespace", F.col("entry_id").alias("id")).agg(F.max_by(x, "queue_id").alias("x"))
    patches = q.select(*KEY, "x.*", F.array(F.lit("corrected")).alias("tags_add"))
    return upkeep.corrected(entries(spark, d, "importance", "status", "tags", "updated_at", "sync_seq", "invalid_from"), patches, ["importance", "status"], F.expr(NOW))


@book.add("{E}, " + _PATCH + " SELECT namespace, id, result FROM co WHERE result IS NOT NULL")
def l14_correction_results(spark, d):
    return _corrected(spark, d)[1]


@book.add("{E}, " + _PATCH + """ SELECT namespace, id, round(CASE WHEN result = 'applied' THEN coalesce(x.i, importance) ELSE importance END, 6) AS importance, CASE WHEN result = 'applied' THEN coalesce(x.s, status) ELSE status END AS status,
CASE WHEN result = 'applied' THEN coalesce(sync_seq, 0) + 1 ELSE sync_seq END AS sync_seq, len(coalesce(tags, [])) + CASE WHEN result = 'applied' THEN 1 ELSE 0 END AS n_tags, coalesce(epoch_us(CASE WHEN result = 'applied' AND x.s = 'obsolete' THEN coalesce(invalid_from, """ + SQL_NOW + ") ELSE invalid_from END), 0) AS closed_us FROM co WHERE there")
def l14_corrected(spark, d):
    e = _corrected(spark, d)[0]
    return e.select(*KEY, F.round("importance", 6).alias("importance"), "status", "sync_seq", F.coalesce(F.size("tags"), F.lit(0)).cast("bigint").alias("n_tags"), F.coalesce(F.unix_micros("invalid_from"), F.lit(0)).alias("closed_us"))


@book.add("""{E}, t AS (SELECT namespace, id FROM entries WHERE contains(lower(id), 'midnight') OR contains(lower(content), 'midnight') OR contains(lower(coalesce(detail, '')), 'midnight') OR len(list_filter(coalesce(tags, []), lambda t: contains(lower(t), 'midnight'))) > 0 ORDER BY updated_at DESC, id DESC, namespace LIMIT 10000),
a AS (SELECT namespace, id FROM entries WHERE source_identity = 'harrow@agents' ORDER BY updated_at DESC, id DESC, namespace LIMIT 10000),
i AS (SELECT DISTINCT e.namespace, e.id FROM entries e JOIN queue_records q ON q.namespace = e.namespace AND q.entry_id = e.id WHERE lower(q.op) = 'delete' AND NOT coalesce(list_contains(e.tags, 'canary-index'), false))
SELECT 'text' AS how, namespace, id FROM t UNION ALL SELECT 'actor', namespace, id FROM a UNION ALL SELECT 'id', namespace, id FROM i""")
def l15_forgotten(spark, d):
    e = entries(spark, d, "content", "detail", "tags", "source_identity", "updated_at")
    ids = table(spark, d, "queue_records").where("lower(op) = 'delete'").select("namespace", F.col("entry_id").alias("id"))
    parts = [upkeep.forgotten(e, query="midnight")[0].withColumn("how", F.lit("text")), upkeep.forgotten(e, actor="harrow@agents")[0].withColumn("how", F.lit("actor"))]
    parts.append(upkeep.forgotten(e, ids=ids, canaries=e.where(F.array_contains("tags", "canary-index")))[0].withColumn("how", F.lit("id")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# -- consolidation ----------------------------------------------------------------------------------------
@book.add("""{E}, r AS (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY updated_at DESC, id DESC) AS position FROM entries WHERE status = 'active')
SELECT namespace, id, position FROM r WHERE position <= 50 AND consolidated_into IS NULL AND coalesce(source, '') <> 'consolidated' AND coalesce(confidence, '') <> 'verified' AND NOT coalesce(list_contains(tags, 'canary-index'), false)""")
def l6_cycle_rows(spark, d):
    """The newest fifty of a namespace are the rule of a cycle."""
    e = entries(spark, d, "status", "updated_at", "consolidated_into", "source", "confidence", "tags")
    e = e.withColumn("protected", F.col("confidence") == "verified").withColumn("canary", F.array_contains("tags", "canary-index"))
    return upkeep.consolidation_rows(e).select(*KEY, "position")


@book.add("SELECT a.label, CAST(sqrt(2 * count(*) + 0.25) + 0.5 AS bigint) AS n, round(avg(list_cosine_similarity(a.embedding::double[], b.embedding::double[])), 6) AS mean_similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1")
def a8_mean_similarity(spark, d):
    return upkeep.mean_similarity(_vectors(spark, d), ["label"]).withColumn("mean_similarity", F.round("mean_similarity", 6))


_CYCLE = """g AS (SELECT namespace, remote_id AS cluster, id, content, detail, importance, access_count FROM entries WHERE remote_id IS NOT NULL AND status = 'active'),
n AS (SELECT namespace, cluster, count(*) AS n, concat('M-', left(sha256(string_agg(id, ',' ORDER BY id)), 16)) AS new_id, max(importance) AS importance, least(sum(access_count), 1000000000) AS access_count FROM g GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND 10),
p AS (SELECT namespace, cluster, content FROM (SELECT *, row_number() OVER (PARTITION BY namespace, cluster ORDER BY length(content) + length(coalesce(detail, '')) DESC, id) AS rn FROM g) WHERE rn = 1)"""


def _cycle(spark, d):
    e = entries(spark, d, "remote_id", "status", "content", "detail", "tags", "importance", "access_count", "confidence", "invalid_from", "consolidated_into")
    live = e.where("remote_id IS NOT NULL AND status = 'active'")
    from pyspark.sql import Window

    clusters = live.select("namespace", F.col("remote_id").alias("cluster"), "id", F.row_number().over(Window.partitionBy("namespace", "remote_id").orderBy("id")).alias("position"))
    return upkeep.consolidated(live, clusters, F.expr(NOW), 2)


@book.add("{E}, " + _CYCLE + " SELECT n.namespace, n.new_id AS id, n.n AS n_merged, round(n.importance, 6) AS importance, CAST(n.access_count AS bigint) AS access_count, p.content FROM n JOIN p USING (namespace, cluster)")
def l8_merged(spark, d):
    return _cycle(spark, d)[0].select(*KEY, F.size("merged_from").cast("bigint").alias("n_merged"), F.round("importance", 6).alias("importance"), "access_count", "content")


@book.add("{E}, " + _CYCLE + " SELECT g.namespace, g.id, 'archived' AS status, n.new_id AS consolidated_into, epoch_us(" + SQL_NOW + ") AS closed_us FROM g JOIN n USING (namespace, cluster)")
def l8_archived(spark, d):
    return _cycle(spark, d)[1].select(*KEY, "status", "consolidated_into", F.unix_micros("invalid_from").alias("closed_us"))


# -- verification -----------------------------------------------------------------------------------------
_ASSERTIONS = [
    (1, "grep_present", "retry worker", "kb/**"), (2, "grep_absent", "retry worker", "kb/**"), (3, "grep_present", "no such words here", "kb/1/*.md"), (4, "grep_absent", "no such words here", "kb/1/*.md"),
    (5, "glob_exists", "kb/3/*.md", ""), (6, "glob_absent", "kb/x/**", ""), (7, "grep_present", "(", "kb/**"), (8, "grep_present", "(?i)LEDGER", "kb/2/?2.md"), (9, "glob_absent", "", "**/7.md"), (10, "grep_present", "ledger", "kb/*.md"),
]


@book.add(r"""WITH f AS (SELECT concat('kb/', doc_id % 10, '/', doc_id, '.md') AS path, text, text IS NULL OR strlen(text) > 1000000 AS dark FROM documents),
c AS (SELECT 1 AS a, regexp_matches(text, 'retry worker') AS hit, dark FROM f UNION ALL SELECT 2, regexp_matches(text, 'retry worker'), dark FROM f
UNION ALL SELECT 3, contains(text, 'no such words here'), dark FROM f WHERE path LIKE 'kb/1/%' UNION ALL SELECT 4, contains(text, 'no such words here'), dark FROM f WHERE path LIKE 'kb/1/%'
UNION ALL SELECT 5, true, false FROM f WHERE path LIKE 'kb/3/%' UNION ALL SELECT 8, contains(lower(text), 'ledger'), dark FROM f WHERE regexp_full_match(path, 'kb/2/.2\.md') UNION ALL SELECT 9, true, false FROM f WHERE path LIKE '%/7.md'),
s AS (SELECT a, count(*) AS n_files, count(*) FILTER (WHERE hit AND NOT dark) AS n_hits, bool_or(dark) AS dark FROM c GROUP BY 1),
k AS (SELECT range AS assertion_id FROM range(1, 11))
SELECT assertion_id, coalesce(n_files, 0) AS n_files, coalesce(n_hits, 0) AS n_hits, CASE WHEN assertion_id IN (1, 3, 8, 10) THEN CASE WHEN n_hits > 0 THEN true WHEN NOT coalesce(dark, false) THEN false END
WHEN assertion_id IN (2, 4) THEN CASE WHEN n_hits > 0 THEN false WHEN NOT coalesce(dark, false) THEN true END WHEN assertion_id = 5 THEN coalesce(n_hits, 0) > 0 WHEN assertion_id IN (6, 9) THEN coalesce(n_hits, 0) = 0 END AS result FROM k LEFT JOIN s ON s.a = assertion_id""")
def l17_assertions(spark, d):
    doc = table(spark, d, "documents")
    files = doc.select(F.concat(F.lit("kb/"), F.col("doc_id") % 10, F.lit("/"), "doc_id", F.lit(".md")).alias("path"), "text")
    return upkeep.verify_assertions(spark.createDataFrame(_ASSERTIONS, "assertion_id bigint, type string, pattern string, target string"), files)


@book.add(r"""WITH f AS (SELECT path, max(subject) AS text FROM (SELECT unnest(paths) AS path, subject FROM replay_events) GROUP BY 1), a AS (SELECT DISTINCT namespace, entry_id, file, regexp_extract(file, '([a-z]+)[_.][^/]*$', 1) AS symbol FROM anchor_postings WHERE entry_id <> '')
SELECT namespace, entry_id, count(*) AS n, round_even(avg(CASE WHEN symbol <> '' AND regexp_matches(text, concat('(^|[^A-Za-z0-9_])', symbol, '($|[^A-Za-z0-9_])')) THEN 1.0 ELSE 0.0 END), 2) AS validity FROM a LEFT JOIN f ON f.path = a.file GROUP BY 1, 2""")
def l19_anchor_validity(spark, d):
    """Subjects of events stand for the contents of the files they touch."""
    files = table(spark, d, "replay_events").select(F.explode("paths").alias("path"), "subject").groupBy("path").agg(F.max("subject").alias("text"))
    a = table(spark, d, "anchor_postings").where("entry_id <> ''").select("namespace", "entry_id", "file", F.regexp_extract("file", "([a-z]+)[_.][^/]*$", 1).alias("symbol")).distinct()
    return upkeep.anchor_validity(a, files, ["namespace", "entry_id"])


@book.add("WITH a AS (SELECT DISTINCT posting_id, namespace, entry_id, indexed_at FROM anchor_postings WHERE entry_id <> ''), s AS (SELECT *, indexed_at IS NULL OR indexed_at < " + SQL_AT + """ - INTERVAL 200 DAY AS stale FROM a)
SELECT namespace, count(DISTINCT entry_id) AS total, count(*) FILTER (WHERE NOT stale AND posting_id % 3 = 0) AS passing, count(*) FILTER (WHERE NOT stale AND posting_id % 3 = 1) AS failing, count(*) FILTER (WHERE stale) AS stale, count(*) FILTER (WHERE NOT stale AND posting_id % 3 = 2) AS unverifiable FROM s GROUP BY 1""")
def a5_assertion_health(spark, d):
    a = table(spark, d, "anchor_postings").where("entry_id <> ''").select("posting_id", "namespace", F.col("entry_id").alias("id"), F.col("indexed_at").alias("last_verified_at")).distinct()
    return upkeep.assertion_health(a.withColumn("last_result", F.when(F.col("posting_id") % 3 == 0, True).when(F.col("posting_id") % 3 == 1, False)), F.expr(AT), 200)


@book.add("""WITH r AS (SELECT DISTINCT event_id, namespace, learning_id, paths FROM replay_events WHERE learning_id IS NOT NULL AND namespace IS NOT NULL), g AS (SELECT namespace, learning_id, coalesce(arg_min(paths, event_id), []) AS a, coalesce(arg_max(paths, event_id), []) AS b FROM r WHERE paths IS NOT NULL GROUP BY 1, 2)
SELECT namespace, learning_id, array_to_string(list_concat(a, list_filter(b, lambda p, i: NOT list_contains(a, p) AND list_position(b, p) = i)), ',') AS paths FROM g""")
def u5_assertion_union(spark, d):
    r = table(spark, d, "replay_events").where("learning_id IS NOT NULL AND namespace IS NOT NULL AND paths IS NOT NULL").select("event_id", "namespace", "learning_id", "paths").distinct()
    made = lambda c: F.transform(c, lambda p: F.struct(F.lit("grep_present").alias("type"), p.alias("pattern"), F.lit("**").alias("target")))
    g = r.groupBy("namespace", "learning_id").agg(F.min_by("paths", "event_id").alias("a"), F.max_by("paths", "event_id").alias("b"))
    return g.select("namespace", "learning_id", F.array_join(F.transform(upkeep.united_assertions(made("a"), made("b")), lambda x: x["pattern"]), ",").alias("paths"))


# -- tiers ------------------------------------------------------------------------------------------------
_TIER = "round(0.4 * CAST(contains(lower(content), 'ledger') AS int) + 0.3 * exp(-ln(2) / 14.0 * greatest((epoch_us(" + SQL_NOW + ") - epoch_us(coalesce(last_accessed_at, created_at))) / 86400000000.0, 0)) + 0.3 * coalesce(importance, 0.5), 9)"


@book.add("{E} SELECT namespace, id, rk FROM (SELECT namespace, id, row_number() OVER (PARTITION BY namespace ORDER BY " + _TIER + " DESC, id) AS rk FROM entries WHERE status = 'active') WHERE rk <= 50")
def l20_hot_rows(spark, d):
    e = entries(spark, d, "status", "content", "importance", "last_accessed_at", "created_at").where("status = 'active'")
    days = scoring.fractional_days(F.expr(NOW), F.coalesce("last_accessed_at", "created_at"))
    score = F.round(scoring.tier_composite(F.lower("content").contains("ledger").cast("int"), days, F.coalesce("importance", F.lit(0.5))), 9)
    return upkeep.hot_rows(e, score, ["namespace"]).select(*KEY, F.col("rk").cast("bigint").alias("rk"))


@book.add("""{E}, t AS (SELECT namespace, id, lower(concat_ws(' ', content, coalesce(detail, ''), array_to_string(coalesce(tags, []), ' '))) AS x FROM entries WHERE status = 'archived'),
s AS (SELECT namespace, id, (CAST(contains(x, 'ledger') AS int) + CAST(contains(x, 'vector') AS int) + CAST(contains(x, 'clock') AS int)) / 3.0 AS score FROM t)
SELECT namespace, id, round(score, 6) AS score FROM s WHERE score > 0 ORDER BY s.score DESC, namespace, id LIMIT 100""")
def l21_tier_search(spark, d):
    rows = entries(spark, d, "status", "content", "detail", "tags").where("status = 'archived'")
    return upkeep.tier_search(rows, ["Ledger", "vector", "clock", "ledger"], 100).withColumn("score", F.round("score", 6))


@book.add("{E}, h AS (SELECT namespace, id, 'hot' AS tier FROM entries WHERE access_count > 30), w AS (SELECT namespace, id, 'warm' AS tier FROM entries WHERE status = 'active'), c AS (SELECT namespace, id, 'cold' AS tier FROM entries WHERE importance < 0.9) SELECT * FROM h UNION ALL SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.namespace = w.namespace AND h.id = w.id) UNION ALL SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.namespace = c.namespace AND h.id = c.id) AND NOT EXISTS (SELECT 1 FROM w WHERE w.namespace = c.namespace AND w.id = c.id)")
def u2_tier_merge(spark, d):
    e = entries(spark, d, "access_count", "status", "importance")
    tier = lambda rows, name: rows.select(*KEY, F.lit(name).alias("tier"))
    return recall.first_wins([tier(e.where("access_count > 30"), "hot"), tier(e.where("status = 'active'"), "warm"), tier(e.where("importance < 0.9"), "cold")], KEY).select(*KEY, "tier")


# -- integrity, scope, census -----------------------------------------------------------------------------
_PINS = "pin AS (SELECT namespace, id, arg_min(sha256(concat(coalesce(content, ''), coalesce(detail, ''))), updated_at) AS h FROM memories WHERE access_count % 2 = 0 GROUP BY 1, 2), j AS (SELECT e.namespace, e.id, p.h = sha256(concat(coalesce(content, ''), coalesce(detail, ''))) AS intact FROM entries e LEFT JOIN pin p USING (namespace, id))"


def _pinned(spark, d, mode):
    h = F.sha2(F.concat(F.coalesce("content", F.lit("")), F.coalesce("detail", F.lit(""))), 256)
    pins = table(spark, d, "memories").where("access_count % 2 = 0").select(*KEY, "updated_at", h.alias("h")).groupBy(*KEY).agg(F.min_by("h", "updated_at").alias("content_hash"))
    return upkeep.integrity_filtered(entries(spark, d, "content", "detail"), pins, mode)


@book.add("{E}, " + _PINS + " SELECT namespace, id, intact FROM j")
def f16_integrity(spark, d):
    """Hashes pinned when a row was first seen (rows of an even access count were)."""
    return _pinned(spark, d, "observe").select(*KEY, "intact")


@book.add("{E}, " + _PINS + " SELECT namespace, id FROM j WHERE coalesce(intact, true)")
def f16_strict(spark, d):
    return _pinned(spark, d, "strict").select(*KEY)


@book.add("""WITH s AS (SELECT 'registered' AS scope, count(*) AS n FROM memories m WHERE NOT EXISTS (SELECT 1 FROM memory_namespaces r WHERE r.namespace_id = m.namespace) UNION ALL SELECT 'active', count(*) FROM memories m WHERE NOT EXISTS (SELECT 1 FROM memory_namespaces r WHERE r.namespace_id = m.namespace AND r.status = 'active') UNION ALL SELECT 'none', count(*) FROM memories)
SELECT scope, n > 0 AS refused FROM s""")
def f12_scope(spark, d):
    """A row outside the scope refuses the whole call."""
    rows, n = table(spark, d, "memories"), table(spark, d, "memory_namespaces").select(F.col("namespace_id").alias("namespace"), "status")
    out = []
    for name, scope in (("registered", n), ("active", n.where("status = 'active'")), ("none", n.limit(0))):
        try:
            upkeep.in_scope(rows, scope)
            out.append((name, False))
        except upkeep.ScopeError:
            out.append((name, True))
    return spark.createDataFrame(out, "scope string, refused boolean")


@book.add("{E} SELECT namespace, id FROM entries WHERE namespace LIKE 'project:%' AND namespace <> 'project:harborlight' AND importance >= 0.8 AND confidence IN ('high', 'verified') ORDER BY importance DESC, updated_at DESC, namespace, id LIMIT 50")
def f19_shared_selection(spark, d):
    """Confident rows stand for cross-validated ones."""
    e = entries(spark, d, "importance", "confidence", "updated_at").withColumn("cross_validated", F.col("confidence").isin("high", "verified"))
    return upkeep.org_shared(e, "project:harborlight").select(*KEY)


_MOVED = ["project:wicket-0a1b2c3d", "project:lintel-0a1b2c3d", "project:nowhere-0a1b2c3d", "project:plain"]


@book.add("WITH r AS (SELECT DISTINCT namespace_id AS namespace FROM memory_namespaces UNION SELECT unnest(" + str(_MOVED) + r""")), c AS (SELECT namespace, count(*) AS n FROM memories GROUP BY 1),
s AS (SELECT namespace, n, regexp_extract(namespace, '^project:(.+)-[^-]*$', 1) AS slug FROM c), m AS (SELECT namespace, regexp_extract(namespace, '^project:(.+)-[^-]*$', 1) AS slug FROM r WHERE namespace NOT IN (SELECT namespace FROM c WHERE namespace IS NOT NULL))
SELECT namespace, candidate, rows FROM (SELECT m.namespace, s.namespace AS candidate, s.n AS rows, row_number() OVER (PARTITION BY m.namespace ORDER BY s.n DESC, s.namespace) AS rn FROM m JOIN s ON s.slug = m.slug WHERE m.slug <> '') WHERE rn = 1""")
def a16_moved_checkouts(spark, d):
    """Four checkouts of today beside the registered ones, two of them moved."""
    registered = table(spark, d, "memory_namespaces").select(F.col("namespace_id").alias("namespace")).unionByName(spark.createDataFrame([(x,) for x in _MOVED], "namespace string"))
    counts = table(spark, d, "memories").groupBy("namespace").agg(F.count(F.lit(1)).alias("rows"))
    return upkeep.moved_checkouts(registered, counts)


@book.add("""{E}, x AS (SELECT id FROM entries UNION SELECT 'promoted-' || id FROM entries WHERE recurrence > 1 AND namespace LIKE 'team:%'),
j AS (SELECT e.namespace, x.id IS NOT NULL AS old, coalesce(e.importance >= 0.7, false) AS enough FROM entries e LEFT JOIN x ON x.id = 'promoted-' || e.id WHERE e.status = 'active' AND e.namespace LIKE 'team:%')
SELECT namespace, count(*) FILTER (WHERE NOT old AND enough) AS promoted, count(*) FILTER (WHERE NOT old AND NOT enough) AS discarded, count(*) FILTER (WHERE old) AS already FROM j GROUP BY 1""")
def a17_promotion_summary(spark, d):
    """Rows that recurred were promoted before."""
    e = entries(spark, d, "status", "importance", "recurrence")
    team = e.where(F.col("namespace").startswith("team:"))
    before = team.where("recurrence > 1").select(F.concat(F.lit("promoted-"), "id").alias("id"))
    return upkeep.promotion_summary(team, e.select("id").unionByName(before))


# -- files ------------------------------------------------------------------------------------------------
_BROKEN = [(-1, '{"by": "node-elm"'), (-2, "shared"), (-3, '{"by": "node-elm", "shared": 1}'), (-4, None)]


@book.add("WITH e AS (SELECT id, edge_metadata AS m FROM memory_graph_edges UNION ALL SELECT * FROM (VALUES (-1, '{\"by\": \"node-elm\"'), (-2, 'shared'), (-3, '{\"by\": \"node-elm\", \"shared\": 1}'), (-4, NULL)) v(id, m)) SELECT 'quarantined' AS part, coalesce(m, '') AS what, count(*) AS n FROM e WHERE m IS NOT NULL AND NOT json_valid(m) GROUP BY 2 UNION ALL SELECT 'good', coalesce(m->>'$.by', ''), count(*) FROM e WHERE m IS NULL OR json_valid(m) GROUP BY 2")
def s12_bad_rows(spark, d):
    """Edge metadata with two broken rows planted: those are set apart, the rest is read."""
    rows = table(spark, d, "memory_graph_edges").select("id", "edge_metadata").unionByName(spark.createDataFrame(_BROKEN, "id bigint, edge_metadata string"))
    good, bad = formats.split_readable(rows, "edge_metadata", "by string, shared bigint")
    part = lambda df, name, what: df.groupBy(F.coalesce(what, F.lit("")).alias("what")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "what", "n")
    return part(bad, "quarantined", F.col("edge_metadata")).unionByName(part(good, "good", F.col("parsed.by")))


_COLD = ("status", "content", "created_at", "importance")


@book.add("{E} SELECT namespace, id, year(timezone('UTC', created_at)) AS year, month(timezone('UTC', created_at)) AS month FROM entries WHERE status <> 'active' AND created_at >= TIMESTAMPTZ '2024-05-01 00:00:00+00:00' AND created_at < TIMESTAMPTZ '2024-07-01 00:00:00+00:00'")
def s14_cold_partitions(spark, d):
    """Written by month, then two months read back."""
    at = new_path(spark, "cold")
    cold = entries(spark, d, *_COLD).where("status <> 'active'")
    formats.write_cold(cold, at)
    return formats.read_cold(spark, at, (2024, 5), (2024, 6), cold.schema).select(*KEY, F.col("year").cast("bigint").alias("year"), F.col("month").cast("bigint").alias("month"))


@book.add("SELECT namespace, entry_id, max(queue_id) AS queue_id, arg_max(retry_count, queue_id) AS retry_count FROM queue_records WHERE namespace IS NOT NULL AND entry_id IS NOT NULL GROUP BY 1, 2")
def s15_sidecar_latest(spark, d):
    """An append log with broken lines, compacted, then read again."""
    log, out = new_path(spark, "log"), new_path(spark, "compacted")
    table(spark, d, "queue_records").select("namespace", "entry_id", "queue_id", "retry_count").write.json(log)
    spark.createDataFrame([('{"namespace": "broken', ), ("no json",), ("",)], "value string").write.mode("append").text(log)
    schema = T.StructType.fromDDL("namespace string, entry_id string, queue_id bigint, retry_count int")
    formats.compact_sidecar(spark, log, out, schema, ["namespace", "entry_id"], "queue_id")
    return formats.read_sidecar(spark, out, schema, ["namespace", "entry_id"], "queue_id")


_LINES = ['{"id": "x1", "content": "fine"}', '{"id": " ", "content": "no id"}', '{"id": "x2", "content": ""}', '{"id": "x3", "content": "c", "importance": 1.5}', '{"id": "x4", "content": "c", "status": "odd"}', "broken"]


@book.add("""{E}, j AS (SELECT CASE WHEN id IS NULL OR trim(id) = '' THEN 'no_id' WHEN content IS NULL OR trim(content) = '' THEN 'no_content' WHEN importance < 0 OR importance > 1 THEN 'bad_importance' WHEN status NOT IN ('active', 'resolved', 'obsolete', 'obsolete_poisoned', 'archived') THEN 'bad_status' ELSE 'accepted' END AS outcome FROM entries
UNION ALL SELECT unnest(['accepted', 'no_id', 'no_content', 'bad_importance', 'bad_status', 'unreadable'])) SELECT outcome, count(*) AS n FROM j GROUP BY 1""")
def s16_import_report(spark, d):
    """All entries exported, six foreign lines added, everything imported again."""
    at = new_path(spark, "export")
    formats.export_json(entries(spark, d, *[f.name for f in formats.ENTRY.fields if f.name != "metadata"]), at)
    spark.createDataFrame([(x,) for x in _LINES], "value string").write.mode("append").text(at)
    good, bad = formats.import_json(spark, at)
    return good.select(F.lit("accepted").alias("outcome")).unionByName(bad.select(F.col("reason").alias("outcome"))).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@book.add("{E} SELECT namespace, id, coalesce(round(importance, 6), 0.5) AS importance, coalesce(status, 'active') AS status, recurrence, epoch_us(created_at) AS created_us, array_to_string(coalesce(tags, []), ',') AS tags FROM entries WHERE content IS NOT NULL AND trim(content) <> '' AND (importance IS NULL OR importance BETWEEN 0 AND 1)")
def s17_round_trip(spark, d):
    at = new_path(spark, "export")
    formats.export_json(entries(spark, d, *[f.name for f in formats.ENTRY.fields if f.name != "metadata"]), at)
    good, _ = formats.import_json(spark, at)
    return good.select("namespace", "id", F.round("importance", 6).alias("importance"), "status", "recurrence", F.unix_micros("created_at").alias("created_us"), F.array_join(F.coalesce("tags", F.array().cast("array<string>")), ",").alias("tags"))


@book.add("{E} SELECT namespace, id, round(importance, 6) AS importance, access_count, epoch_us(created_at) AS created_us, len(coalesce(tags, [])) AS n_tags FROM entries")
def s21_rebuilt(spark, d):
    """All stored rows as text, typed and brought to one row a key again."""
    m = table(spark, d, "memories")
    cols = ["namespace", "id", "importance", "access_count", "created_at", "updated_at", "tags"]
    cold = m.select(*[F.to_json("tags").alias("tags") if c == "tags" else F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias(c) if c.endswith("_at") else F.col(c).cast("string").alias(c) for c in cols])
    at = new_path(spark, "text")
    cold.write.parquet(at)
    schema = T.StructType([m.schema[c] for c in cols])
    out = formats.rebuild(spark.read.parquet(at), schema, KEY, "updated_at")
    return out.select(*KEY, F.round("importance", 6).alias("importance"), "access_count", F.unix_micros("created_at").alias("created_us"), F.coalesce(F.size("tags"), F.lit(0)).cast("bigint").alias("n_tags"))


@book.add("SELECT namespace, namespace IN ('global', 'default') OR regexp_matches(namespace, '^(project|team|org|user):[A-Za-z0-9_-]+$') AS valid, replace(namespace, ':', '/') AS path FROM (SELECT DISTINCT namespace FROM memories)")
def c1_namespaces(spark, d):
    from ..functions.text import namespace_path, valid_namespace

    n = table(spark, d, "memories").select("namespace").distinct()
    return n.select("namespace", valid_namespace(F.col("namespace")).alias("valid"), namespace_path(F.col("namespace")).alias("path"))


@book.add("""{E}, a AS (SELECT * FROM (VALUES (-1.0, -1.0, 0.0, 0.495), (0.0, 0.495, 0.5, 0.745), (0.5, 0.745, 0.75, 0.89), (0.75, 0.89, 0.85, 0.89), (0.85, 0.89, 0.9, 0.945), (0.9, 0.945, 0.92, 0.955), (0.92, 0.955, 0.95, 0.98), (0.95, 0.98, 1.0, 1.0)) v(x0, y0, x1, y1))
SELECT namespace, id, round(y0 + (importance - x0) * ((y1 - y0) / (x1 - x0)), 4) AS threshold FROM entries JOIN a ON importance >= x0 AND (importance < x1 OR (x1 = 1.0 AND importance = 1.0)) WHERE importance BETWEEN 0 AND 1""")
def m6_calibrated(spark, d):
    e = entries(spark, d, "importance").where("importance BETWEEN 0 AND 1")
    return e.select(*KEY, scoring.calibrated_threshold(F.col("importance")).alias("threshold"))


def queries() -> dict:
    return book.queries


def oracle_sql() -> dict[str, str]:
    return book.sql
