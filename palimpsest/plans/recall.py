"""What stands around the ranking, over the subjects of every hundredth event as queries of their namespaces."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import graph, policy, ranking, recall, vectors
from ..sources.scratch import written
from .book import Book, entries, table
from .lifecycle import _EDGES, _ROOTS, _edges, _roots, _vectors
from .listing import _FAMILY, AT, SQL_AT, _kind
from .ranking import _IMPORTANT, BM25, HYBRID, KEY, _bm25, _docs, _queries, hybrid

book = Book()

_ASKED = "asked AS (SELECT DISTINCT event_id AS query_id, namespace, subject AS text FROM replay_events WHERE event_id % 100 = 0 AND subject IS NOT NULL AND namespace IS NOT NULL)"
_WORDS = r"regexp_extract_all({x}, '[\p{L}\p{N}]+')"
_FTS = (
    _ASKED + r", phr AS (SELECT query_id, namespace, list_filter(list_distinct(list_transform(list_filter(regexp_split_to_array(lower(text), '[\s\p{Z}]+'), lambda c: regexp_matches(c, '[\p{L}\p{N}]')), lambda c: array_to_string("
    + _WORDS.replace("{x}", "c") + ", ' '))), lambda p: p <> '') AS phrases FROM asked), txt AS (SELECT *, concat(' ', array_to_string(" + _WORDS.replace("{x}", "lower(concat_ws(' ', content, detail, array_to_string(tags, ' ')))")
    + ", ' '), ' ') AS indexed FROM entries), fts AS (SELECT * FROM (SELECT p.query_id, t.namespace, t.id, t.status, t.importance, t.updated_at, len(list_filter(phrases, lambda p: contains(indexed, concat(' ', p, ' ')))) AS matched FROM phr p JOIN txt t ON t.namespace = p.namespace) WHERE matched > 0)"
)


def _asked(spark, d):
    r = table(spark, d, "replay_events").where("event_id % 100 = 0 AND subject IS NOT NULL AND namespace IS NOT NULL")
    return r.select(F.col("event_id").alias("query_id"), "namespace", F.col("subject").alias("text")).distinct()


@book.add("{E}, " + _FTS + " SELECT query_id, namespace, id, matched FROM fts")
def r19_candidates(spark, d):
    return recall.text_candidates(_asked(spark, d), entries(spark, d, "content", "detail", "tags"))


@book.add("{E}, " + _FTS + " SELECT query_id, namespace, id, matched, round(importance, 6) AS importance FROM fts WHERE status = 'active' AND importance >= 0.3")
def j1_text_join(spark, d):
    found = recall.text_candidates(_asked(spark, d), entries(spark, d, "content", "detail", "tags"))
    rows = entries(spark, d, "status", "importance").where("status = 'active' AND importance >= 0.3")
    return found.join(rows, KEY).select("query_id", *KEY, "matched", F.round("importance", 6).alias("importance"))


@book.add("""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT q.vec_id AS query_id, e.vec_id AS row_id, round(list_cosine_similarity(q.embedding::double[], e.embedding::double[]), 9) AS score FROM q, embeddings e),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rk FROM s) SELECT query_id, doc_id, source, round(score, 6) AS score FROM r JOIN documents ON doc_id = row_id WHERE rk <= 20 AND lang IS NOT NULL""")
def j2_vector_join(spark, d):
    """Vector hits with the rows they stand for."""
    e = _vectors(spark, d).select("row_id", "vector")
    hits = vectors.nearest(e.where("row_id % 100 = 0").withColumnRenamed("row_id", "query_id"), e, 20)
    docs = table(spark, d, "documents").where("lang IS NOT NULL").select(F.col("doc_id").alias("row_id"), "source")
    return hits.join(docs, "row_id").select("query_id", F.col("row_id").alias("doc_id"), "source", F.round("score", 6).alias("score"))


@book.add("WITH " + _EDGES + ", " + _ROOTS + ", entries AS (SELECT DISTINCT ON (namespace, id) * FROM memories ORDER BY namespace, id, updated_at DESC), l AS (SELECT DISTINCT r.namespace, r.root, e.target_id AS node FROM ro r JOIN ed e ON e.namespace = r.namespace AND e.source_id = r.root WHERE e.target_id <> r.root AND e.edge_type = 'related_to') SELECT l.namespace, l.root, l.node, round(m.importance, 6) AS importance, m.memory_type FROM l JOIN entries m ON m.namespace = l.namespace AND m.id = l.node WHERE m.status = 'active'")
def j13_hydrated(spark, d):
    nodes = graph.bfs(_edges(spark, d), _roots(spark, d), 1, ["related_to"]).select("namespace", "root", F.col("node").alias("id"))
    rows = entries(spark, d, "status", "importance", "memory_type").where("status = 'active'")
    return nodes.join(rows, KEY).select("namespace", "root", F.col("id").alias("node"), F.round("importance", 6).alias("importance"), "memory_type")


@book.add("""{E}, a AS (SELECT DISTINCT namespace, entry_id AS id, 'anchored' AS why FROM anchor_postings WHERE entry_id <> ''), t AS (SELECT DISTINCT namespace, entry_id AS id, 'tagged' AS why FROM memory_tags WHERE entry_id IS NOT NULL AND namespace IS NOT NULL)
SELECT namespace, id, why FROM a UNION ALL SELECT namespace, id, why FROM t WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.namespace = t.namespace AND a.id = t.id)""")
def u1_first_wins(spark, d):
    a = table(spark, d, "anchor_postings").where("entry_id <> ''").select("namespace", F.col("entry_id").alias("id"), F.lit("anchored").alias("why"))
    t = table(spark, d, "memory_tags").where("entry_id IS NOT NULL AND namespace IS NOT NULL").select("namespace", F.col("entry_id").alias("id"), F.lit("tagged").alias("why"))
    return recall.first_wins([a, t], KEY).select(*KEY, "why")


@book.add("{E}, " + _FTS + """, rec AS (SELECT namespace, id FROM (SELECT namespace, id, row_number() OVER (PARTITION BY namespace ORDER BY updated_at DESC, id DESC) AS pos FROM entries) WHERE pos <= 100),
one AS (SELECT query_id, r.namespace, r.id FROM asked a JOIN rec r ON r.namespace = a.namespace),
two AS (SELECT query_id, namespace, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, updated_at DESC, id DESC) AS pos FROM fts WHERE status = 'active') WHERE pos <= 100)
SELECT query_id, namespace, id, 0 AS list_no FROM one UNION ALL SELECT query_id, namespace, id, 1 FROM two t WHERE NOT EXISTS (SELECT 1 FROM one o WHERE o.query_id = t.query_id AND o.namespace = t.namespace AND o.id = t.id)""")
def r20_candidate_pool(spark, d):
    return recall.candidate_pool(_asked(spark, d), entries(spark, d, "content", "detail", "tags", "status", "updated_at"), 5, 100)


@book.add("{E}, r AS (SELECT namespace, id, coalesce(coalesce(valid_from, created_at) <= " + SQL_AT + " AND (invalid_from IS NULL OR " + SQL_AT + " < invalid_from), false) AS eligible, updated_at FROM entries) SELECT namespace, id, eligible, rk FROM (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY eligible DESC, updated_at DESC, id DESC) AS rk FROM r) WHERE rk <= 20")
def r29_temporal_selection(spark, d):
    e = entries(spark, d, "valid_from", "created_at", "invalid_from", "updated_at")
    out = recall.temporal_selection(e, ["namespace"], [F.desc("updated_at"), F.desc("id")], F.expr(AT), 20, True)
    return out.select(*KEY, "eligible", F.col("rk").cast("bigint").alias("rk"))


_WEIGHT = "CASE {f} WHEN 'git_distilled' THEN 0.75 WHEN 'semantic_memory' THEN 0.9 WHEN 'lifecycle' THEN 0.55 ELSE 1.0 END"


@book.add("{E}, c AS (SELECT *, " + _WEIGHT.replace("{f}", "family") + " AS weight, CASE WHEN family IN ('lifecycle', 'episodic') THEN 2 ELSE 0 END AS bucket FROM (SELECT *, " + _FAMILY + " AS family, coalesce(coalesce(valid_from, created_at) <= " + SQL_AT + " AND (invalid_from IS NULL OR " + SQL_AT + """ < invalid_from), false) AS eligible FROM entries WHERE status = 'active')),
r AS (SELECT namespace, id, importance * weight AS score, row_number() OVER (PARTITION BY namespace ORDER BY CASE WHEN eligible THEN 0 ELSE 1 END, bucket, CASE WHEN access_count <= 5 THEN 1 ELSE 0 END, importance * weight DESC, id) AS rk FROM c WHERE importance >= 0.3 AND importance * weight >= 0.3)
SELECT namespace, id, round(score, 6) AS score, rk FROM r WHERE rk <= 10""")
def r30_final_merge(spark, d):
    e = entries(spark, d, "status", "importance", "access_count", "valid_from", "created_at", "invalid_from", "source", "tags").where("status = 'active'")
    family = policy.source_family(F.col("tags"), _kind())
    c = e.select(F.col("namespace").alias("query_id"), *KEY, F.col("importance").alias("score"), policy.family_weight(family).alias("weight"), F.when(family.isin("lifecycle", "episodic"), 2).otherwise(0).alias("bucket"), (F.col("access_count") <= 5).alias("fallback"), F.coalesce(policy.in_force(F.expr(AT)), F.lit(False)).alias("eligible"))
    return recall.final_merge(c, KEY, 0.3, 10).select(*KEY, F.round("score", 6).alias("score"), F.col("rk").cast("bigint").alias("rk"))


@book.add("""{E}, l AS (SELECT * FROM entries WHERE status = 'active' AND importance >= 0.8), t AS (SELECT * FROM entries WHERE status <> 'active' OR access_count > 20)
SELECT namespace, id, false AS fallback FROM l UNION ALL SELECT namespace, id, true FROM t WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.namespace = t.namespace AND (l.id = t.id OR l.content = t.content))""")
def r31_tier_merge(spark, d):
    e = entries(spark, d, "status", "importance", "access_count", "content")
    out = recall.merge_tiers(e.where("status = 'active' AND importance >= 0.8"), e.where("status <> 'active' OR access_count > 20"))
    return out.select(*KEY, "fallback")


@book.add("""{E}, q AS (SELECT namespace, entry_id, arg_max(payload->>'$.content', queue_id) AS content, max(queue_id) AS queue_id FROM queue_records GROUP BY 1, 2), l AS (SELECT * FROM entries WHERE status = 'active' AND importance >= 0.5)
SELECT queue_id FROM q WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.id = q.entry_id) AND NOT EXISTS (SELECT 1 FROM l WHERE lower(trim(coalesce(l.content, ''))) = lower(trim(coalesce(q.content, ''))))""")
def r32_shared_text(spark, d):
    p = F.from_json("payload", "content string")["content"]
    q = table(spark, d, "queue_records").groupBy("namespace", F.col("entry_id").alias("source_id")).agg(F.max_by(p, "queue_id").alias("content"), F.max("queue_id").alias("queue_id"))
    local = entries(spark, d, "status", "importance", "content").where("status = 'active' AND importance >= 0.5")
    return recall.without_known_shared(q, local).select("queue_id")


@book.add("SELECT vec_id FROM embeddings r WHERE vec_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM embeddings l WHERE l.vec_id % 2 = 0 AND round(list_cosine_similarity(l.embedding::double[], r.embedding::double[]), 9) > 0.4)")
def r32_shared_vectors(spark, d):
    v = _vectors(spark, d).select("row_id", "vector")
    remote, local = v.where("row_id % 2 = 1"), v.where("row_id % 2 = 0")
    return remote.join(recall.near_any(remote, local, 0.4).withColumnRenamed("remote_id", "row_id"), "row_id", "left_anti").select(F.col("row_id").alias("vec_id"))


@book.add(HYBRID + "SELECT query_id, namespace, id, round(score, 6) AS score FROM rr WHERE score >= 0.2")
def f20_min_score(spark, d):
    return hybrid(spark, d).where("score >= 0.2").select("query_id", *KEY, F.round("score", 6).alias("score"))


@book.add("{E} SELECT id AS memory_id, namespace, round(importance, 6) AS score, len(coalesce(tags, [])) AS n_tags, strftime(timezone('UTC', created_at), '%Y-%m-%dT%H:%M:%S+00:00') AS created_at, coalesce(strftime(timezone('UTC', last_accessed_at), '%Y-%m-%dT%H:%M:%S+00:00'), '') AS last_accessed_at, 'local' AS source, recurrence, access_count FROM entries")
def f21_projection(spark, d):
    iso = lambda c: F.date_format(F.to_utc_timestamp(F.col(c), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    e = entries(spark, d, "importance", "tags", "created_at", "last_accessed_at", "recurrence", "access_count")
    return e.select(F.col("id").alias("memory_id"), "namespace", F.round("importance", 6).alias("score"), F.coalesce(F.size("tags"), F.lit(0)).cast("bigint").alias("n_tags"), iso("created_at").alias("created_at"), F.coalesce(iso("last_accessed_at"), F.lit("")).alias("last_accessed_at"), F.lit("local").alias("source"), "recurrence", "access_count")


# -- behind the keyword ranking -----------------------------------------------------------------------------
@book.add(BM25 + ", x AS (SELECT b.query_id, b.namespace, b.id, round(b.score, 12) AS s, coalesce(e.valid_from, e.created_at) AS vf FROM bm b JOIN entries e USING (namespace, id) WHERE rk <= 50) SELECT query_id, namespace, id, rk FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vf DESC, namespace, id) AS rk FROM x) WHERE rk <= 10")
def r11_age_tiebreak(spark, d):
    e = entries(spark, d, "valid_from", "created_at").withColumn("valid_from", F.coalesce("valid_from", "created_at"))
    return ranking.age_tiebreak(_bm25(spark, d).join(e, KEY), KEY).where("rk <= 10").select("query_id", *KEY, F.col("rk").cast("bigint").alias("rk"))


_LEX = r"regexp_extract_all(lower(regexp_replace(coalesce({x}, ''), '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[a-z0-9]+')"
_LEXQ = "list_distinct(" + _LEX.replace("{x}", r"CASE WHEN length(text) <= 1000 AND len(list_filter(regexp_split_to_array(left(text, 1000), '[\s\p{Z}]+'), lambda z: z <> '')) <= 64 THEN text ELSE array_to_string(list_filter(regexp_split_to_array(left(text, 1000), '[\s\p{Z}]+'), lambda z: z <> '')[1:64], ' ') END") + ")"
_LEXSTOP = "[" + ", ".join(f"'{w}'" for w in tx.LEXICAL_STOPWORDS) + "]"


@book.add(BM25 + ", lq AS (SELECT item_id AS query_id, CASE WHEN len(list_filter(w, lambda k: NOT list_contains(" + _LEXSTOP + ", k))) > 0 THEN list_filter(w, lambda k: NOT list_contains(" + _LEXSTOP + ", k)) ELSE w END AS w FROM (SELECT item_id, " + _LEXQ + """ AS w FROM eval_items)),
x AS (SELECT b.query_id, b.namespace, b.id, b.rk AS old, len(list_filter(q.w, lambda k: list_contains(""" + _LEX.replace("{x}", "left(concat_ws(' ', e.content, nullif(e.detail, ''), nullif(array_to_string(coalesce(e.tags, []), ' '), '')), 2048)") + """, k))) AS s FROM bm b JOIN entries e USING (namespace, id) JOIN lq q USING (query_id) WHERE b.rk <= 50)
SELECT query_id, namespace, id, rk FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, old) AS rk FROM x) WHERE rk <= 10""")
def r12_rerank(spark, d):
    """The scorer counts the query's words in the passage; a cross-encoder would stand in its place."""
    first = _bm25(spark, d).join(table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), "text"), "query_id")
    passages = entries(spark, d, "content", "detail", "tags").select(*KEY, tx.passage(F.col("content"), F.col("detail"), F.col("tags")).alias("passage"))
    words = lambda q, p: F.size(F.array_intersect(tx.lexical_query(q), tx.lexical_tokens(p))).cast("double")
    return recall.reranked(first, passages, KEY, words).where("rk <= 10").select("query_id", *KEY, F.col("rk").cast("bigint").alias("rk"))


@book.add()
def r14_bridge_hop(spark, d):
    docs = written(_docs(spark, d).join(entries(spark, d, "content"), KEY), "docs")
    first = written(_bm25(spark, d, 20), "first")
    asked = table(spark, d, "eval_items").where("text IS NOT NULL").select(F.col("item_id").alias("query_id"), "text")
    return recall.bridge_hop(asked, first, docs, _queries(spark, d)).select("query_id", *KEY, "at")


@book.add(HYBRID + """, f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vf DESC, namespace, id) AS rk2, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, vf DESC, namespace, id) AS before,
 CASE WHEN e.source = 'import' THEN 'semantic_memory' WHEN e.source = 'tool' THEN 'lifecycle' ELSE fam END AS family FROM op JOIN (SELECT namespace, id, source FROM entries) e USING (namespace, id)),
o AS (SELECT *, round(1.0 / before, 4) AS own, CASE family WHEN 'semantic_memory' THEN 0.9 WHEN 'lifecycle' THEN 0.55 WHEN 'git_distilled' THEN 0.75 ELSE 1.0 END AS weight, CASE WHEN family = 'lifecycle' THEN 2 ELSE 0 END AS bucket FROM f),
a AS (SELECT *, CASE WHEN family = 'git_distilled' THEN greatest(coalesce(max(CASE WHEN family <> 'git_distilled' THEN own * weight END) OVER (PARTITION BY query_id, bucket ORDER BY rk2 ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0), own) ELSE own * weight END AS asks FROM o)
SELECT query_id, namespace, id, round(CASE WHEN family = 'git_distilled' THEN least(asks, coalesce(min(asks) OVER (PARTITION BY query_id, bucket ORDER BY rk2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), asks)) ELSE own END, 6) AS score FROM a""")
def r17_positional_scores(spark, d):
    r = hybrid(spark, d)
    order = Window.partitionBy("query_id").orderBy(F.desc("fused"), F.desc("valid_from"), *KEY)
    family = F.when(F.col("source") == "import", "semantic_memory").when(F.col("source") == "tool", "lifecycle").otherwise(F.col("family"))
    r = r.withColumn("before", F.row_number().over(order)).withColumn("family", family).withColumn("weight", policy.family_weight(F.col("family"))).withColumn("bucket", F.when(F.col("family") == "lifecycle", 2).otherwise(0))
    return recall.positional_scores(r.drop("score")).select("query_id", *KEY, F.round("score", 6).alias("score"))


@book.add("{E}, s AS (SELECT namespace, id, row_number() OVER (PARTITION BY namespace ORDER BY importance DESC NULLS LAST, id) AS rk, count(*) OVER (PARTITION BY namespace) AS n FROM entries WHERE status = 'archived') SELECT namespace, id, round(0.2 * (1 - rk / (n + 1)), 6) AS score FROM s")
def r22_squeezed(spark, d):
    s = entries(spark, d, "status", "importance").where("status = 'archived'").withColumn("query_id", F.col("namespace"))
    s = s.withColumn("rk", F.row_number().over(Window.partitionBy("namespace").orderBy(F.desc_nulls_last("importance"), "id")))
    return ranking.squeeze_below(s, F.lit(0.2)).select(*KEY, F.round("score", 6).alias("score"))


@book.add(BM25 + ", " + _EDGES + """, t AS (SELECT query_id, namespace, id, score FROM bm WHERE rk <= 10), m AS (SELECT query_id, max(score) AS top FROM t GROUP BY 1),
n AS (SELECT t.query_id, t.namespace, ed.target_id AS id, max(ed.weight) AS weight FROM t JOIN ed ON ed.namespace = t.namespace AND ed.source_id = t.id WHERE ed.weight IS NOT NULL GROUP BY 1, 2, 3)
SELECT n.query_id, n.namespace, n.id, round(top * 0.5 * weight, 6) AS score FROM n JOIN m USING (query_id) WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.query_id = n.query_id AND t.namespace = n.namespace AND t.id = n.id)""")
def r23_graph_expansion(spark, d):
    return graph.expand_by_graph(_bm25(spark, d, 10), _edges(spark, d).where("weight IS NOT NULL")).select("query_id", "namespace", "id", F.round("score", 6).alias("score"))


@book.add("{E}, " + _EDGES + """, c AS (SELECT DISTINCT namespace, source_id AS a, target_id AS b FROM ed WHERE edge_type = 'conflicts_with' UNION SELECT DISTINCT namespace, target_id, source_id FROM ed WHERE edge_type = 'conflicts_with')
SELECT DISTINCT x.namespace, x.id FROM c JOIN entries x ON x.namespace = c.namespace AND x.id = c.a JOIN entries y ON y.namespace = c.namespace AND y.id = c.b WHERE x.status = 'active' AND y.status = 'active' AND x.importance < y.importance""")
def r24_conflict_losers(spark, d):
    r = entries(spark, d, "status", "importance").where("status = 'active'").withColumn("query_id", F.lit(0))
    return graph.conflict_losers(_edges(spark, d), r).select("namespace", "id")


@book.add("{E} SELECT namespace, id, greatest(1, length(CAST(to_json({'namespace': namespace, 'id': id, 'content': content, 'detail': coalesce(detail, '')}) AS varchar)) // 4) AS cost FROM entries")
def r26_serialized_cost(spark, d):
    row = F.struct("namespace", "id", "content", F.coalesce("detail", F.lit("")).alias("detail"))
    return entries(spark, d, "content", "detail").select(*KEY, tx.serialized_tokens(row).alias("cost"))


def queries() -> dict:
    return book.queries


def oracle_sql() -> dict[str, str]:
    return book.sql
