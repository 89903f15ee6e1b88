"""Scoring, decay, consolidation, duplicates and graph operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import graph, lifecycle, vectors
from ..sources.scratch import written
from .book import ENTRIES, Book, entries, table
from .ranking import NOW, SQL_NOW, UTILITY, with_utility

book = Book()
KEY = ["namespace", "id"]
_UCOLS = ("importance", "recurrence", "memory_type", "confidence", "access_count", "source", "last_accessed_at", "created_at", "status")


# -- scores -----------------------------------------------------------------------------------------------
@book.add("WITH " + ENTRIES + ", " + UTILITY + " SELECT namespace, id, round(utility, 6) AS utility FROM ut")
def m1_utility(spark, d):
    return with_utility(entries(spark, d, *_UCOLS)).select(*KEY, F.round("utility", 6).alias("utility"))


@book.add("{E} SELECT namespace, id, round(least(greatest(importance * greatest(0.5, pow(0.95, access_count)), 0), 1) + 1e-12, 6) AS decayed FROM entries WHERE importance IS NOT NULL")
def m2_recall_decay(spark, d):
    e = entries(spark, d, "importance", "access_count").where("importance IS NOT NULL")
    return e.select(*KEY, F.round(scoring.recall_decay(F.col("importance"), F.col("access_count")) + F.lit(1e-12), 6).alias("decayed"))


_DAYS = f"greatest(floor(epoch_us({SQL_NOW}) / 86400000000) - floor(epoch_us(created_at) / 86400000000), 0)"


@book.add("{E} SELECT namespace, id, round(least(greatest(importance * greatest(0.3, 1.0 - " + _DAYS + " / 365.0 * 0.3), 0), 1), 6) AS decayed FROM entries WHERE importance IS NOT NULL")
def m3_linear_decay(spark, d):
    e = entries(spark, d, "importance", "created_at").where("importance IS NOT NULL")
    return e.select(*KEY, F.round(scoring.linear_decay(F.col("importance"), scoring.days_between(F.expr(NOW), F.col("created_at"))), 6).alias("decayed"))


@book.add("{E} SELECT namespace, id, round(0.4 * CAST(contains(lower(content), 'ledger') AS int) + 0.3 * exp(-ln(2) / 14.0 * greatest((epoch_us(" + SQL_NOW + ") - epoch_us(coalesce(last_accessed_at, created_at))) / 86400000000.0, 0)) + 0.3 * coalesce(importance, 0.5), 6) AS score FROM entries")
def m4_tier_composite(spark, d):
    e = entries(spark, d, "content", "importance", "last_accessed_at", "created_at")
    rel = F.lower("content").contains("ledger").cast("int")
    days = scoring.fractional_days(F.expr(NOW), F.coalesce("last_accessed_at", "created_at"))
    return e.select(*KEY, F.round(scoring.tier_composite(rel, days, F.coalesce("importance", F.lit(0.5))), 6).alias("score"))


@book.add("{E} SELECT namespace, id, round(list_sum(list_transform(list_distinct(string_split(source_identity, '')), lambda c: -(len(list_filter(string_split(source_identity, ''), lambda x: x = c)) / length(source_identity)) * log2(len(list_filter(string_split(source_identity, ''), lambda x: x = c)) / length(source_identity)))), 6) AS bits FROM entries WHERE source_identity <> ''")
def m5_entropy(spark, d):
    from ..functions.text import shannon_entropy

    return entries(spark, d, "source_identity").where("source_identity <> ''").select(*KEY, F.round(shannon_entropy(F.col("source_identity")), 6).alias("bits"))


# -- lifecycle --------------------------------------------------------------------------------------------
@book.add("WITH " + ENTRIES + ", " + UTILITY + f""" SELECT namespace, id, action FROM (SELECT namespace, id, CASE WHEN tier IN ('protected', 'permanent') THEN NULL WHEN status IN ('resolved', 'obsolete') THEN 'cleanup' WHEN utility < 0.05 * m THEN 'delete' WHEN utility < 0.15 * m AND {_DAYS} > 14 THEN 'prune' END AS action
FROM (SELECT *, CASE tier WHEN 'critical' THEN 0.25 WHEN 'high' THEN 0.5 WHEN 'low' THEN 1.5 ELSE 1.0 END AS m FROM (SELECT *, CASE confidence WHEN 'verified' THEN 'critical' WHEN 'high' THEN 'high' WHEN 'unverified' THEN 'low' ELSE 'normal' END AS tier FROM ut))) WHERE action IS NOT NULL""")
def l9_prune(spark, d):
    e = with_utility(entries(spark, d, *_UCOLS))
    tier = F.when(F.col("confidence") == "verified", "critical").when(F.col("confidence") == "high", "high").when(F.col("confidence") == "unverified", "low").otherwise("normal")
    action = scoring.prune_action(tier, F.col("status"), F.col("utility"), scoring.days_between(F.expr(NOW), F.col("created_at")))
    return e.select(*KEY, action.alias("action")).where("action IS NOT NULL")


@book.add("{E} SELECT namespace, id, round(CASE WHEN coalesce(last_accessed_at, created_at) < " + SQL_NOW + " - INTERVAL 90 DAY THEN greatest(round_even(importance - 0.1, 4), 0) ELSE importance END, 6) AS importance FROM entries WHERE importance IS NOT NULL")
def l10_decay_pass(spark, d):
    e = entries(spark, d, "importance", "last_accessed_at", "created_at").where("importance IS NOT NULL")
    return lifecycle.decay_pass(e, F.expr(NOW)).select(*KEY, F.round("importance", 6).alias("importance"))


@book.add("{E} SELECT namespace, id, round(least(importance + 0.05, 1.0), 6) AS importance FROM entries WHERE importance IS NOT NULL AND memory_type = 'pattern'")
def l11_boost(spark, d):
    e = entries(spark, d, "importance", "memory_type").where("importance IS NOT NULL AND memory_type = 'pattern'")
    return e.select(*KEY, F.round(scoring.boosted_importance(F.col("importance")), 6).alias("importance"))


@book.add("{E} SELECT namespace, id, 'promoted-' || id AS promoted_id FROM entries WHERE importance >= 0.7 AND status = 'active' AND NOT EXISTS (SELECT 1 FROM entries x WHERE x.id = 'promoted-' || entries.id)")
def l12_promote(spark, d):
    e = entries(spark, d, "importance", "status")
    return lifecycle.promotions(e.where("status = 'active'"), e).select(*KEY, "promoted_id")


@book.add("{E}, n AS (SELECT namespace, learning_id AS id, count(*) AS n FROM (SELECT DISTINCT event_id, namespace, learning_id FROM replay_events) GROUP BY 1, 2) SELECT e.namespace, e.id, least(coalesce(e.access_count, 0) + coalesce(n.n, 0), 1000000000) AS access_count, n.n IS NOT NULL AS touched FROM entries e LEFT JOIN n ON n.namespace = e.namespace AND n.id = e.id")
def l16_access(spark, d):
    r = table(spark, d, "replay_events").select("event_id", "namespace", F.col("learning_id").alias("id")).distinct()
    out = lifecycle.count_accesses(entries(spark, d, "access_count", "last_accessed_at"), r, F.expr(NOW))
    return out.select(*KEY, "access_count", F.coalesce(F.col("last_accessed_at") == F.expr(NOW), F.lit(False)).alias("touched"))


@book.add("""{E}, a AS (SELECT namespace, entry_id, count(*) AS n, count(*) FILTER (WHERE indexed_at IS NULL) AS failing FROM (SELECT DISTINCT * FROM anchor_postings) GROUP BY 1, 2)
SELECT namespace, entry_id AS id, CASE WHEN failing = n THEN 'stale' WHEN failing = 0 AND n >= 2 THEN 'verified' END AS verdict, round(0.15 * failing / n, 6) AS penalty FROM a WHERE entry_id IS NOT NULL""")
def l18_verdict(spark, d):
    a = table(spark, d, "anchor_postings").distinct().where("entry_id IS NOT NULL").groupBy("namespace", F.col("entry_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("indexed_at").isNull()).alias("failing"))
    v = lifecycle.verdict(F.col("failing"), F.col("n") - F.col("failing"), F.col("n"), F.lit(31), F.col("n"), 2)
    return a.select("namespace", "id", v.alias("verdict"), F.round(lifecycle.check_penalty(F.col("failing"), F.col("n")), 6).alias("penalty"))


_GROUP = "g AS (SELECT namespace, remote_id, id, content, detail, importance, access_count, confidence, tags FROM entries WHERE remote_id IS NOT NULL)"


@book.add("{E}, " + _GROUP + """, t AS (SELECT namespace, remote_id, tag, count(*) AS n FROM (SELECT namespace, remote_id, unnest(list_distinct(tags)) AS tag FROM g) GROUP BY 1, 2, 3),
tt AS (SELECT namespace, remote_id, string_agg(tag, ',' ORDER BY rn) AS tags FROM (SELECT *, row_number() OVER (PARTITION BY namespace, remote_id ORDER BY n DESC, tag) AS rn FROM t) WHERE rn <= 20 GROUP BY 1, 2),
m AS (SELECT namespace, remote_id, count(*) AS n, max(importance) AS importance, least(sum(access_count), 1000000000) AS access_count, max(CASE confidence WHEN 'unverified' THEN 1 WHEN 'low' THEN 2 WHEN 'medium' THEN 3 WHEN 'high' THEN 4 WHEN 'verified' THEN 5 ELSE 0 END) AS c FROM g GROUP BY 1, 2),
r AS (SELECT namespace, remote_id, id FROM (SELECT *, row_number() OVER (PARTITION BY namespace, remote_id ORDER BY length(content) + length(coalesce(detail, '')) DESC, id) AS rn FROM g) WHERE rn = 1)
SELECT m.namespace, m.remote_id, m.n, round(m.importance, 6) AS importance, CAST(m.access_count AS bigint) AS access_count, CASE c WHEN 1 THEN 'unverified' WHEN 2 THEN 'low' WHEN 3 THEN 'medium' WHEN 4 THEN 'high' WHEN 5 THEN 'verified' END AS confidence, r.id AS representative, coalesce(tt.tags, '') AS tags
FROM m JOIN r USING (namespace, remote_id) LEFT JOIN tt USING (namespace, remote_id)""")
def a7_consolidated_fields(spark, d):
    e = entries(spark, d, "remote_id", "content", "detail", "importance", "access_count", "confidence", "tags").where("remote_id IS NOT NULL")
    pos = F.row_number().over(Window.partitionBy("namespace", "remote_id").orderBy("id"))
    out = lifecycle.consolidated_fields(e.withColumn("position", pos), ["namespace", "remote_id"])
    return out.select("namespace", "remote_id", "n", F.round("importance", 6).alias("importance"), "access_count", "confidence", "representative", F.coalesce(F.array_join("tags", ","), F.lit("")).alias("tags"))


@book.add("""{E}, t AS (SELECT namespace, id, lower(trim(regexp_replace(content, '\\s+', ' ', 'g'))) AS c, lower(trim(regexp_replace(coalesce(detail, ''), '\\s+', ' ', 'g'))) AS x FROM entries WHERE status = 'active')
SELECT namespace, id, min(id) OVER (PARTITION BY namespace, c, x) AS kept_id FROM t""".replace("\\\\", "\\"))
def l1_exact_duplicate(spark, d):
    return lifecycle.exact_duplicates(entries(spark, d, "status", "content", "detail").where("status = 'active'"))


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vector"), "label")


_PAIRS = "p AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 9) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 9) > 0.35)"


@book.add("WITH " + _PAIRS + " SELECT a, b, round(score, 6) AS score FROM p")
def j5_similarity_join(spark, d):
    return vectors.similarity_join(_vectors(spark, d), 0.35).select("a", "b", F.round("score", 6).alias("score"))


@book.add("WITH " + _PAIRS + " SELECT p.a, p.b FROM p JOIN embeddings x ON x.vec_id = p.a JOIN embeddings y ON y.vec_id = p.b WHERE x.label <> y.label")
def j6_cross_label_join(spark, d):
    v = _vectors(spark, d)
    p = vectors.similarity_join(v, 0.35)
    la, lb = v.select(F.col("row_id").alias("a"), F.col("label").alias("la")), v.select(F.col("row_id").alias("b"), F.col("label").alias("lb"))
    return p.join(la, "a").join(lb, "b").where("la <> lb").select("a", "b")


@book.add("WITH " + _PAIRS + " SELECT a AS source_id, b AS target_id, round(score, 4) AS weight FROM p UNION ALL SELECT b, a, round(score, 4) FROM p")
def g3_similarity_edges(spark, d):
    p = vectors.similarity_join(_vectors(spark, d), 0.35)
    one = p.select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), F.round("score", 4).alias("weight"))
    return one.unionByName(p.select(F.col("b").alias("source_id"), F.col("a").alias("target_id"), F.round("score", 4).alias("weight")))


@book.add("""WITH s AS (SELECT a.vec_id AS id, max(round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 9)) AS best FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 GROUP BY 1)
SELECT id, CASE WHEN best >= 0.40 THEN 'skip' WHEN best >= 0.30 THEN 'merge' ELSE 'store' END AS verdict FROM s""")
def l2_duplicate_verdict(spark, d):
    v = _vectors(spark, d)
    near = vectors.nearest(v.where("row_id % 100 = 0").withColumnRenamed("row_id", "query_id"), v, 2).where("query_id <> row_id")
    return near.groupBy("query_id").agg(F.max("score").alias("best")).select(F.col("query_id").alias("id"), lifecycle.duplicate_verdict(F.col("best"), 0.40, 0.30).alias("verdict"))


@book.add()
def l4_greedy_dedup(spark, d):
    pairs = vectors.similarity_join(_vectors(spark, d), 0.30).withColumn("namespace", F.lit("all"))
    return lifecycle.greedy_dedup(pairs)


@book.add()
def l5_complete_linkage(spark, d):
    v = _vectors(spark, d)
    label = lambda c: v.select(F.col("row_id").alias(c), F.col("label").alias(f"l{c}"))
    pairs = vectors.similarity_join(v, 0.2).join(label("a"), "a").join(label("b"), "b").where("la = lb")
    return lifecycle.complete_linkage(pairs.select(F.col("la").alias("label"), "a", "b"), "label")


@book.add("""{E}, n AS (SELECT namespace, entry_id AS id, arg_max(payload, queue_id) AS p, arg_max(queue_id, queue_id) AS q FROM queue_records WHERE lower(op) = 'update' GROUP BY 1, 2)
SELECT e.namespace, e.id, round(greatest(e.importance, CAST(p->>'$.importance' AS double)), 6) AS importance, coalesce(e.recurrence, 1) + 1 AS recurrence,
CASE WHEN coalesce(p->>'$.content', '') = '' OR contains(coalesce(e.detail, ''), p->>'$.content') THEN coalesce(e.detail, '') ELSE concat_ws(chr(10), nullif(e.detail, ''), p->>'$.content') END AS detail,
array_to_string(list_distinct(list_concat(coalesce(e.merged_from, []), [concat('q', n.q)])), ',') = array_to_string(list_concat(coalesce(e.merged_from, []), [concat('q', n.q)]), ',') AS fresh FROM entries e JOIN n ON n.namespace = e.namespace AND n.id = e.id""".replace(
    "array_to_string(list_distinct(list_concat(coalesce(e.merged_from, []), [concat('q', n.q)])), ',') = array_to_string(list_concat(coalesce(e.merged_from, []), [concat('q', n.q)]), ',') AS fresh", "len(list_distinct(list_concat(coalesce(e.merged_from, []), [concat('q', n.q)]))) AS n_merged"))
def l3_merge_entries(spark, d):
    p = F.from_json("payload", "content string, importance double")
    q = table(spark, d, "queue_records").where("lower(op) = 'update'").groupBy("namespace", F.col("entry_id").alias("id")).agg(F.max_by("payload", "queue_id").alias("payload"), F.max("queue_id").alias("q"))
    new = q.select(*KEY, p["content"].alias("detail"), F.array().cast("array<string>").alias("tags"), p["importance"].alias("importance"), F.lit(0).alias("access_count"), F.lit(None).cast("string").alias("confidence"), F.concat(F.lit("q"), "q").alias("source_id"))
    out = lifecycle.merge_entries(entries(spark, d, "tags", "importance", "recurrence", "access_count", "confidence", "detail", "merged_from"), new)
    return out.select(*KEY, F.round("importance", 6).alias("importance"), "recurrence", "detail", F.size("merged_from").cast("bigint").alias("n_merged"))


# -- graph ------------------------------------------------------------------------------------------------
_TAGS = """t AS (SELECT DISTINCT namespace, entry_id, lower(trim(tag)) AS tag FROM memory_tags WHERE trim(tag) <> '' AND entry_id IS NOT NULL AND namespace IS NOT NULL),
thin AS (SELECT t.* FROM t JOIN (SELECT namespace, tag FROM t GROUP BY 1, 2 HAVING count(*) <= 500) k USING (namespace, tag)),
sz AS (SELECT namespace, entry_id, count(*) AS s FROM t GROUP BY 1, 2),
sh AS (SELECT a.namespace, a.entry_id AS a, b.entry_id AS b, count(*) AS shared FROM thin a JOIN thin b ON a.namespace = b.namespace AND a.tag = b.tag AND a.entry_id < b.entry_id GROUP BY 1, 2, 3 HAVING count(*) >= 2),
pr AS (SELECT sh.*, round(shared / (x.s + y.s - shared), 4) AS weight FROM sh JOIN sz x ON x.namespace = sh.namespace AND x.entry_id = a JOIN sz y ON y.namespace = sh.namespace AND y.entry_id = b)"""


def _tag_pairs(spark, d):
    t = table(spark, d, "memory_tags").select("namespace", "entry_id", F.lower(F.trim("tag")).alias("tag")).where("tag <> '' AND entry_id IS NOT NULL AND namespace IS NOT NULL")
    return graph.tag_pairs(t)


@book.add("WITH " + _TAGS + " SELECT namespace, a, b, shared, weight FROM pr")
def j3_tag_pairs(spark, d):
    return _tag_pairs(spark, d)


@book.add("WITH " + _TAGS + ", bo AS (SELECT namespace, a AS root, b AS other, shared, weight FROM pr UNION ALL SELECT namespace, b, a, shared, weight FROM pr) SELECT namespace, root, other, weight FROM (SELECT *, row_number() OVER (PARTITION BY namespace, root ORDER BY shared DESC, other) AS rn FROM bo) WHERE rn <= 25")
def g2_tag_neighbours(spark, d):
    return graph.tag_neighbours(_tag_pairs(spark, d)).select("namespace", "root", "other", "weight")


# two learnings of one service, planted, as no two entries of the table share three files
_PLANTED = [("planted", f, e) for e, fs in {"P-1": "abcd", "P-2": "bcde", "P-3": "cdef", "P-4": "ab"}.items() for f in fs]
_PLANTED_SQL = "SELECT * FROM (VALUES " + ", ".join(str(x) for x in _PLANTED) + ") v(namespace, file, entry_id)"


def _postings(spark, d):
    return table(spark, d, "anchor_postings").where("entry_id <> ''").select("namespace", "file", "entry_id")


@book.add("""WITH t AS (SELECT DISTINCT namespace, file, entry_id FROM anchor_postings WHERE entry_id <> '')
SELECT a.namespace, a.entry_id AS a, b.entry_id AS b, count(*) AS shared FROM t a JOIN t b ON a.namespace = b.namespace AND a.file = b.file AND a.entry_id < b.entry_id GROUP BY 1, 2, 3 HAVING count(*) >= 2""")
def j4_shared_files(spark, d):
    return graph.shared_files(_postings(spark, d), 2)


@book.add("WITH t AS (SELECT DISTINCT namespace, file, entry_id FROM anchor_postings WHERE entry_id <> '' UNION ALL " + _PLANTED_SQL + """)
SELECT a.namespace, a.entry_id AS a, b.entry_id AS b, count(*) AS shared FROM t a JOIN t b ON a.namespace = b.namespace AND a.file = b.file AND a.entry_id < b.entry_id GROUP BY 1, 2, 3 HAVING count(*) >= 3""")
def j4_three_files(spark, d):
    planted = spark.createDataFrame(_PLANTED, "namespace string, file string, entry_id string")
    return graph.shared_files(_postings(spark, d).unionByName(planted))


@book.add("""WITH t AS (SELECT DISTINCT namespace, file, entry_id FROM anchor_postings WHERE entry_id <> ''), r AS (SELECT *, row_number() OVER (PARTITION BY namespace, file ORDER BY entry_id) AS at FROM t)
SELECT DISTINCT s.namespace, s.entry_id AS source_id, t.entry_id AS target_id, CAST(0.8 AS double) AS weight FROM r s JOIN r t ON s.namespace = t.namespace AND s.file = t.file AND s.entry_id <> t.entry_id AND t.at <= 50 + CASE WHEN s.at <= 50 THEN 1 ELSE 0 END""")
def g5_co_anchored(spark, d):
    return graph.co_anchored(_postings(spark, d))[0]


@book.add("""WITH t AS (SELECT namespace, file, count(DISTINCT entry_id) AS entries FROM anchor_postings WHERE entry_id <> '' GROUP BY 1, 2) SELECT *, entries * (entries - 51) AS left_out FROM t WHERE entries > 51""")
def g5_left_out(spark, d):
    return graph.co_anchored(_postings(spark, d))[1]


@book.add("{E}, x AS (SELECT DISTINCT namespace, id AS source_id, unnest(merged_from) AS target_id FROM entries) SELECT x.* FROM x JOIN entries e ON e.namespace = x.namespace AND e.id = x.target_id WHERE source_id <> target_id")
def g4_lineage(spark, d):
    return graph.lineage_edges(entries(spark, d, "merged_from")).select("namespace", "source_id", "target_id")


@book.add("SELECT namespace, source_id, target_id, edge_type, round(arg_max(weight, id), 6) AS weight, max(id) AS id FROM memory_graph_edges WHERE weight IS NOT NULL GROUP BY 1, 2, 3, 4")
def g9_upserted_edges(spark, d):
    return graph.upserted(table(spark, d, "memory_graph_edges").where("weight IS NOT NULL")).withColumn("weight", F.round("weight", 6))


_EDGES = "ed AS (SELECT DISTINCT id, namespace, source_id, target_id, edge_type, weight FROM memory_graph_edges WHERE source_id <> '' AND target_id <> '')"
_ROOTS = "ro AS (SELECT DISTINCT namespace, learning_id AS root FROM replay_events WHERE kind = 'merged' AND learning_id IS NOT NULL)"


def _edges(spark, d):
    return table(spark, d, "memory_graph_edges").select("id", "namespace", "source_id", "target_id", "edge_type", "weight").where("source_id <> '' AND target_id <> ''").distinct()


def _roots(spark, d):
    return table(spark, d, "replay_events").where("kind = 'merged' AND learning_id IS NOT NULL").select("namespace", F.col("learning_id").alias("root")).distinct()


@book.add("{E}, " + _EDGES + ", " + _ROOTS + """, ac AS (SELECT namespace, id FROM entries WHERE status = 'active'), ok AS (SELECT ed.* FROM ed JOIN ac ON ac.namespace = ed.namespace AND ac.id = ed.target_id WHERE edge_type IN ('similarity', 'related_to', 'supersedes')),
l1 AS (SELECT r.namespace, r.root, o.target_id AS node, 1 AS depth, arg_min(o.edge_type, (o.edge_type, o.id)) AS edge_type FROM ro r JOIN ok o ON o.namespace = r.namespace AND o.source_id = r.root WHERE o.target_id <> r.root GROUP BY 1, 2, 3),
l2 AS (SELECT f.namespace, f.root, o.target_id AS node, 2 AS depth, arg_min(o.edge_type, (o.edge_type, o.id)) AS edge_type FROM l1 f JOIN ok o ON o.namespace = f.namespace AND o.source_id = f.node
 WHERE o.target_id <> f.root AND NOT EXISTS (SELECT 1 FROM l1 s WHERE s.namespace = f.namespace AND s.root = f.root AND s.node = o.target_id) GROUP BY 1, 2, 3)
SELECT * FROM l1 UNION ALL SELECT * FROM l2""")
def g1_bfs(spark, d):
    active = entries(spark, d, "status").where("status = 'active'").select(*KEY)
    return graph.bfs(_edges(spark, d), _roots(spark, d), 2, ["similarity", "related_to", "supersedes"], active).select("namespace", "root", "node", "depth", "edge_type")


@book.add("WITH " + _EDGES + ", " + _ROOTS + """, e2 AS (SELECT *, weight * CASE edge_type WHEN 'evidence_for' THEN 0.3 WHEN 'co_anchored' THEN 0.2 WHEN 'same_root_cause' THEN 0.15 WHEN 'related_to' THEN 0.1 WHEN 'depends_on' THEN 0.1 ELSE 0 END AS rate FROM ed),
ok AS (SELECT * FROM e2 WHERE rate > 0),
l1 AS (SELECT r.namespace, r.root, o.target_id AS node, arg_min(0.2 * o.rate, (o.edge_type, o.id)) AS delta FROM ro r JOIN ok o ON o.namespace = r.namespace AND o.source_id = r.root WHERE o.target_id <> r.root GROUP BY 1, 2, 3),
l2 AS (SELECT f.namespace, f.root, o.target_id AS node, arg_min(f.delta * o.rate, (o.edge_type, o.id)) AS delta FROM l1 f JOIN ok o ON o.namespace = f.namespace AND o.source_id = f.node
 WHERE o.target_id <> f.root AND NOT EXISTS (SELECT 1 FROM l1 s WHERE s.namespace = f.namespace AND s.root = f.root AND s.node = o.target_id) GROUP BY 1, 2, 3)
SELECT namespace, node AS id, round(sum(delta), 6) AS delta FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2) GROUP BY 1, 2""")
def g7_propagate(spark, d):
    changes = _roots(spark, d).select("namespace", F.col("root").alias("id"), F.lit(0.2).alias("delta"))
    return graph.propagate(_edges(spark, d), changes).select("namespace", "id", F.round("delta", 6).alias("delta"))


@book.add()
def g8_dense_clusters(spark, d):
    found = written(graph.dense_clusters(table(spark, d, "memory_graph_edges")), "clusters")
    named = graph.cluster_domains(found, entries(spark, d, "tags")).select("namespace", "cluster", "domain")
    return found.join(named, ["namespace", "cluster"])


@book.add("""{E}, c AS (SELECT namespace, id FROM entries WHERE list_contains(tags, 'canary-index')),
l AS (SELECT DISTINCT e.namespace, e.id AS source_id, m.id AS target_id, 'consolidation' AS edge_type, CAST(1.0 AS double) AS weight FROM (SELECT namespace, id, unnest(merged_from) AS o FROM entries) e JOIN entries m ON m.namespace = e.namespace AND m.id = e.o WHERE e.id <> m.id),
t AS (SELECT DISTINCT namespace, file, entry_id FROM anchor_postings WHERE entry_id <> ''), r AS (SELECT *, row_number() OVER (PARTITION BY namespace, file ORDER BY entry_id) AS at FROM t),
co AS (SELECT DISTINCT s.namespace, s.entry_id AS source_id, t.entry_id AS target_id, 'co_anchored' AS edge_type, CAST(0.8 AS double) AS weight FROM r s JOIN r t ON s.namespace = t.namespace AND s.file = t.file AND s.entry_id <> t.entry_id AND t.at <= 50 + CASE WHEN s.at <= 50 THEN 1 ELSE 0 END),
u AS (SELECT * FROM l UNION ALL SELECT * FROM co)
SELECT * FROM u WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.namespace = u.namespace AND (c.id = u.source_id OR c.id = u.target_id))""")
def g10_enriched(spark, d):
    e = entries(spark, d, "merged_from", "tags")
    return graph.enriched(e, _postings(spark, d), e.where(F.array_contains("tags", "canary-index")))


_VALIDATED = """v AS (SELECT vec_id AS row_id, 'p' || label AS project, (vec_id % 100) / 100.0 AS importance, embedding::double[] AS v FROM embeddings),
m AS (SELECT a.row_id, b.project, max(round(list_cosine_similarity(a.v, b.v), 9)) AS similarity FROM v a JOIN v b ON a.project <> b.project AND round(list_cosine_similarity(a.v, b.v), 9) > 0.4 GROUP BY 1, 2)"""


@book.add("WITH " + _VALIDATED + ", n AS (SELECT row_id, count(*) AS n FROM m GROUP BY 1) SELECT v.row_id, round(least(importance + 0.05 * n, 1.0), 6) AS importance, n AS n_events FROM v JOIN n ON n.row_id = v.row_id")
def g6_cross_validation(spark, d):
    v = _vectors(spark, d)
    rows = v.select("row_id", F.concat(F.lit("p"), "label").alias("project"), (F.col("row_id") % 100 / 100.0).alias("importance"), F.array().cast("array<string>").alias("history"))
    boosted = graph.cross_validations(vectors.similarity_join(v, 0.4), rows)[1]
    return boosted.select("row_id", F.round("importance", 6).alias("importance"), F.size("history").cast("bigint").alias("n_events"))


def queries() -> dict:
    return book.queries


def oracle_sql() -> dict[str, str]:
    return book.sql
