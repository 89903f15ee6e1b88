"""Retrieval: every query of eval_items against all entries, and vectors against all vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.scoring import fractional_days, half_life, recency, utility
from ..operators import policy, ranking, vectors
from ..sources.scratch import written
from .book import ENTRIES, Book, entries, table

book = Book()
KEY = ["namespace", "id"]
NOW = "TIMESTAMP '2026-08-01 00:00:00+00:00'"
SQL_NOW = "TIMESTAMPTZ '2026-08-01 00:00:00+00:00'"


# -- SQL of the tokeniser ---------------------------------------------------------------------------------
def _norm(x: str) -> str:
    return rf"regexp_replace(lower(regexp_replace(coalesce({x}, ''), '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^\p{{L}}\p{{N}}_\s-]', ' ', 'g')"


def _blanks(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '[\s\p{{Z}}]+'), lambda z: z <> '')"


def _parts(tokens: str, sep: str) -> str:
    return f"flatten(list_transform({tokens}, lambda y: CASE WHEN contains(y, '{sep}') THEN list_concat([y], list_filter(regexp_split_to_array(y, '{sep}+'), lambda z: z <> '')) ELSE [y] END))"


def _stem(t: str) -> str:
    cut = lambda k: f"left({t}, length({t}) - {k})"

    def undo(k: int) -> str:
        b = cut(k)
        return f"CASE WHEN length({b}) > 3 AND {b}[-1] = {b}[-2] AND NOT contains('aeiou', {b}[-1]) THEN left({t}, length({t}) - {k + 1}) ELSE {b} END"

    return (
        rf"CASE WHEN NOT regexp_matches({t}, '^\p{{L}}{{5,}}$') THEN {t} WHEN {t} LIKE '%ies' THEN {cut(3)} || 'y' WHEN {t} LIKE '%ss' THEN {t} "
        rf"WHEN regexp_matches({t}, '(x|z|ss|ch|sh)es$') THEN {cut(2)} WHEN {t} LIKE '%s' THEN {cut(1)} WHEN {t} LIKE '%edly' AND length({t}) > 7 THEN {undo(4)} "
        rf"WHEN {t} LIKE '%ing' AND length({t}) > 6 THEN {undo(3)} WHEN {t} LIKE '%ed' AND length({t}) > 5 THEN {undo(2)} WHEN {t} LIKE '%ly' AND length({t}) > 5 THEN {undo(2)} ELSE {t} END"
    )


_TAGS = f"array_to_string(flatten(list_transform(list_transform(coalesce(tags, []), lambda g: {_norm('g')}), lambda y: CASE WHEN contains(y, '-') THEN list_concat([y], string_split(y, '-')) ELSE [y] END)), ' ')"
_DOC = f"list_transform({_parts(_blanks(f'concat_ws(chr(32), {_norm("content")}, {_norm("detail")}, {_TAGS})'), '_')}, lambda w: {_stem('w')})"
_STOP = "[" + ", ".join(f"'{w}'" for w in tx.QUERY_STOPWORDS) + "]"
_SHORT = _blanks("left(text, 1000)")
_BOUNDED = f"CASE WHEN length(text) <= 1000 AND len({_SHORT}) <= 64 THEN text ELSE array_to_string({_SHORT}[1:64], ' ') END"
_QPARTS = _parts(f"list_filter(flatten(list_transform({_blanks(_norm(_BOUNDED))}, lambda y: CASE WHEN contains(y, '-') THEN list_concat([y], string_split(y, '-')) ELSE [y] END)), lambda z: z <> '')", "_")

BM25 = f"""WITH {ENTRIES},
docs AS (SELECT namespace, id, importance, valid_from, created_at, invalid_from, {_DOC} AS toks FROM entries),
dl AS (SELECT *, len(toks) AS dl, len(list_distinct(toks)) AS ds FROM docs),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
post AS (SELECT namespace, id, dl, ds, term, count(*) AS tf FROM (SELECT namespace, id, dl, ds, unnest(toks) AS term FROM dl) GROUP BY ALL),
dfr AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, st GROUP BY term, n),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM dfr) ELSE raw END AS idf FROM dfr),
qp AS (SELECT item_id AS query_id, {_QPARTS} AS words FROM eval_items),
qt AS (SELECT query_id, list_transform(CASE WHEN len(list_filter(words, lambda z: NOT list_contains({_STOP}, z))) > 0 THEN list_filter(words, lambda z: NOT list_contains({_STOP}, z)) ELSE words END, lambda w: {_stem('w')}) AS terms FROM qp),
qs AS (SELECT query_id, len(list_distinct(terms)) AS ql, unnest(terms) AS term FROM qt),
qc AS (SELECT query_id, ql, term, count(*) AS qtf FROM qs GROUP BY ALL),
met AS (SELECT query_id, namespace, id, dl, ds, ql, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS bm, count(*) AS common FROM qc JOIN idf USING (term) JOIN post USING (term), st GROUP BY ALL),
sc AS (SELECT *, round(CASE WHEN max(bm) OVER (PARTITION BY query_id) > 0 THEN bm ELSE common / (ql + ds - common) END, 9) AS score FROM met),
bm AS (SELECT query_id, namespace, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, namespace, id) AS rk FROM sc WHERE score > 0)
"""


def _docs(spark, d):
    e = entries(spark, d, "content", "detail", "tags")
    return e.select(*KEY, tx.entry_tokens(F.col("content"), F.col("detail"), F.col("tags")).alias("tokens"))


def _queries(spark, d):
    return table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), tx.query_tokens(F.col("text")).alias("terms"))


def _bm25(spark, d, k=50):
    return ranking.bm25(_queries(spark, d), _docs(spark, d), KEY, k)


@book.add(BM25 + "SELECT query_id, namespace, id, round(score, 6) AS score FROM bm WHERE rk <= 10")
def r1_bm25(spark, d):
    return _bm25(spark, d, 10).select("query_id", *KEY, F.round("score", 6).alias("score"))


@book.add("""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id AS row_id, round(list_cosine_similarity(q.embedding::double[], e.embedding::double[]), 9) AS score FROM q, embeddings e),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rk FROM s) SELECT query_id, row_id, round(score, 6) AS score FROM r WHERE rk <= 10""")
def r3_dense(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vector"))
    q = e.where("row_id % 100 = 0").withColumnRenamed("row_id", "query_id")
    return vectors.nearest(q, e, 10).select("query_id", "row_id", F.round("score", 6).alias("score"))


@book.add("""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id AS row_id, round(list_distance(q.embedding::double[], e.embedding::double[]), 9) AS dist FROM q, embeddings e),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, row_id) AS rk FROM s) SELECT query_id, row_id, round(dist, 6) AS dist FROM r WHERE rk <= 10""")
def r4_knn_l2(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vector"))
    q = e.where("row_id % 100 = 0").withColumnRenamed("row_id", "query_id")
    return vectors.nearest(q, e, 10, "l2").select("query_id", "row_id", F.round(F.abs("score"), 6).alias("dist"))


_WORDS = r"regexp_extract_all(lower(regexp_replace(coalesce({x}, ''), '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[a-z0-9]+')"


@book.add("{E}, t AS (SELECT namespace, id, " + _WORDS.replace("{x}", "content") + " AS c, " + _WORDS.replace("{x}", "detail") + " AS x, " + _WORDS.replace("{x}", "array_to_string(tags, ' ')") + """ AS g FROM entries),
q AS (SELECT ['ledger', 'vector', 'clock', 'midnight'] AS w)
SELECT namespace, id, round(least(1.0, list_sum(list_transform(w, lambda k: 3 * CAST(list_contains(c, k) AS int) + 2 * CAST(list_contains(g, k) AS int) + CAST(list_contains(x, k) AS int))) / 12.0), 6) AS score FROM t, q
WHERE len(list_filter(w, lambda k: list_contains(c, k) OR list_contains(g, k) OR list_contains(x, k))) > 0""")
def r5_lexical(spark, d):
    e = entries(spark, d, "content", "detail", "tags")
    words = tx.lexical_query(F.lit("what ledger of the vector clock at midnight"))
    c, x, g = tx.lexical_tokens(F.col("content")), tx.lexical_tokens(F.col("detail")), tx.lexical_tokens(F.array_join("tags", " "))
    e = e.select(*KEY, c.alias("c"), x.alias("x"), g.alias("g"), words.alias("w"))
    has = lambda col, k: F.array_contains(F.col(col), k).cast("int")
    total = F.aggregate("w", F.lit(0), lambda s, k: s + 3 * has("c", k) + 2 * has("g", k) + has("x", k))
    return e.withColumn("total", total).where("total > 0").select(*KEY, F.round(F.least(F.lit(1.0), F.col("total") / (3.0 * F.size("w"))), 6).alias("score"))


_IMPORTANT = ", im AS (SELECT b.query_id, b.namespace, b.id, coalesce(e.importance, 0.5) AS score, row_number() OVER (PARTITION BY b.query_id ORDER BY coalesce(e.importance, 0.5) DESC, b.namespace, b.id) AS rk FROM bm b JOIN entries e USING (namespace, id) WHERE b.rk <= 50)"


def _two_lists(spark, d):
    b = written(_bm25(spark, d), "keyword")  # read by both lists: scored once
    imp = b.join(entries(spark, d, "importance"), KEY).select("query_id", *KEY, F.coalesce("importance", F.lit(0.5)).alias("score"))
    return b.withColumn("list_no", F.lit(0)).unionByName(ranking.ranked(imp, KEY).withColumn("list_no", F.lit(1)))


@book.add(BM25 + _IMPORTANT + ", u AS (SELECT query_id, namespace, id, rk FROM bm WHERE rk <= 50 UNION ALL SELECT query_id, namespace, id, rk FROM im) SELECT query_id, namespace, id, round(sum(1.0 / (5 + rk)), 6) AS score FROM u GROUP BY 1, 2, 3")
def r6_rrf(spark, d):
    return ranking.rrf(_two_lists(spark, d), KEY).select("query_id", *KEY, F.round("score", 6).alias("score"))


@book.add(BM25 + _IMPORTANT + ", u AS (SELECT query_id, namespace, id, rk FROM bm WHERE rk <= 50 UNION ALL SELECT query_id, namespace, id, rk FROM im) SELECT query_id, namespace, id, round(max(1.0 / (60 + rk)), 6) AS score FROM u GROUP BY 1, 2, 3")
def r7_combmax(spark, d):
    return ranking.combmax(_two_lists(spark, d), KEY).select("query_id", *KEY, F.round("score", 6).alias("score"))


_DAYS = f"greatest((epoch_us({SQL_NOW}) - epoch_us(coalesce(valid_from, created_at))) / 86400000000.0, 0.0)"
_RECENCY = f"greatest(1e-6, exp(-ln(2) * {_DAYS} / 14.0))"


@book.add("{E} SELECT namespace, id, round(" + _RECENCY + ", 6) AS score FROM entries")
def r8_recency(spark, d):
    e = entries(spark, d, "valid_from", "created_at")
    return e.select(*KEY, F.round(recency(fractional_days(F.expr(NOW), F.coalesce("valid_from", "created_at"))), 6).alias("score"))


@book.add(BM25 + f""", rc AS (SELECT namespace, id, {_RECENCY} AS rec FROM entries),
f AS (SELECT query_id, namespace, id, score / max(score) OVER (PARTITION BY query_id) AS rel, rk FROM bm WHERE rk <= 50),
j AS (SELECT q.query_id, rc.namespace, rc.id, round(0.7 * coalesce(f.rel, 0) + 0.3 * rc.rec, 6) AS score, f.rk FROM (SELECT DISTINCT query_id FROM bm) q CROSS JOIN rc LEFT JOIN f ON f.query_id = q.query_id AND f.namespace = rc.namespace AND f.id = rc.id)
SELECT query_id, namespace, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rk NULLS LAST, namespace, id) AS rn FROM j) WHERE rn <= 10""")
def r9_recency_blend(spark, d):
    rec = ranking.recency_scores(entries(spark, d, "valid_from", "created_at"), KEY, F.expr(NOW))
    j = ranking.blend_recency(_bm25(spark, d), rec, KEY, 0.3, 10)
    return j.select("query_id", *KEY, F.round("score", 6).alias("score"))


HYBRID = BM25 + _IMPORTANT + f""", u AS (SELECT query_id, namespace, id, rk FROM bm WHERE rk <= 50 UNION ALL SELECT query_id, namespace, id, rk FROM im),
fu AS (SELECT query_id, namespace, id, round(sum(1.0 / (5 + rk)), 9) AS fused FROM u GROUP BY 1, 2, 3),
hy AS (SELECT f.*, coalesce(e.valid_from, e.created_at) AS vf, coalesce(coalesce(e.valid_from, e.created_at) <= {SQL_NOW} AND (e.invalid_from IS NULL OR {SQL_NOW} < e.invalid_from), false) AS open_, e.content, e.detail,
 CASE e.source WHEN 'consolidation' THEN 'git_distilled' ELSE 'unknown' END AS fam FROM fu f JOIN entries e USING (namespace, id) WHERE e.status = 'active'),
op AS (SELECT *, round(fused * CASE WHEN fam = 'git_distilled' THEN 0.75 ELSE 1 END, 9) AS score FROM hy WHERE open_),
rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vf DESC, namespace, id) AS rk FROM op)
"""


def hybrid(spark, d):
    """Keyword and importance lists fused, closed and inactive rows dropped, distilled rows weighed, newer first among equals."""
    fused = ranking.rrf(_two_lists(spark, d), KEY).withColumn("score", F.round("score", 9))
    e = entries(spark, d, "status", "valid_from", "created_at", "invalid_from", "source", "content", "detail").where("status = 'active'")
    j = policy.validity_prior(fused.join(e, KEY), F.expr(NOW), drop=True).withColumn("fused", F.col("score"))
    j = j.withColumn("family", F.when(F.col("source") == "consolidation", "git_distilled").otherwise("unknown")).withColumn("valid_from", F.coalesce("valid_from", "created_at"))
    return ranking.weight_distilled(j, KEY, F.col("family"), ties=[F.desc("valid_from")])


@book.add(HYBRID + "SELECT query_id, namespace, id, round(score, 6) AS score, rk FROM rr WHERE rk <= 10")
def r10_hybrid(spark, d):
    return hybrid(spark, d).where("rk <= 10").select("query_id", *KEY, F.round("score", 6).alias("score"), F.col("rk").cast("bigint").alias("rk"))


@book.add(HYBRID + ", t AS (SELECT query_id, count(*) AS n FROM rr WHERE rk <= greatest(5, 10) OR score >= 0.2 GROUP BY 1) SELECT * FROM t")
def r13_rerank_floor(spark, d):
    return ranking.rerank_floor(hybrid(spark, d), 20, 0.2).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))


@book.add(HYBRID + """, c AS (SELECT *, CAST(round_even(len(list_filter(regexp_split_to_array(concat_ws(' ', content, detail), '[\\s\\p{Z}]+'), lambda z: z <> '')) * 1.3, 0) AS bigint) + 20 AS cost FROM rr),
w AS (SELECT *, sum(cost) OVER (PARTITION BY query_id ORDER BY rk) AS spent FROM c)
SELECT query_id, namespace, id, CAST(spent AS bigint) AS spent FROM w x WHERE rk = 1 OR spent <= 400""".replace("\\\\", "\\"))
def r25_token_budget(spark, d):
    r = hybrid(spark, d).withColumn("cost", tx.token_cost(F.concat_ws(" ", "content", "detail")) + 20)
    return ranking.token_budget(r, 400).select("query_id", *KEY, "spent")


@book.add(HYBRID + "SELECT query_id, namespace, id, round(1.0 / rk, 6) AS score FROM rr WHERE rk <= 20")
def r16_position_scores(spark, d):
    return ranking.position_scores(hybrid(spark, d).where("rk <= 20")).select("query_id", *KEY, F.round("score", 6).alias("score"))


_UTIL = f"""least(greatest(coalesce(importance, 0.5) * exp(-(ln(2) / greatest(hl, 0.1) / pow(greatest(coalesce(recurrence, 1), 1), 0.6)) * dd) + least(0.15, 0.05 * ln(1 + greatest(coalesce(access_count, 0), 0))) + CASE WHEN source = 'human' THEN 0.1 ELSE 0 END, 0), 1)"""
UTILITY = f"""ut AS (SELECT *, {_UTIL} AS utility FROM (SELECT *, CASE WHEN memory_type = 'incident' AND confidence = 'unverified' THEN 9999 ELSE CASE memory_type WHEN 'incident' THEN 90 WHEN 'pattern' THEN 180 WHEN 'convention' THEN 9999 WHEN 'hypothesis' THEN 7 WHEN 'workaround' THEN 14 ELSE 14 END END AS hl,
 greatest(floor(epoch_us({SQL_NOW}) / 86400000000) - floor(epoch_us(coalesce(last_accessed_at, created_at)) / 86400000000), 0) AS dd FROM entries))"""


def with_utility(e):
    from ..functions.scoring import days_between

    days = days_between(F.expr(NOW), F.coalesce("last_accessed_at", "created_at"))
    return e.withColumn("utility", utility(days, F.coalesce("recurrence", F.lit(1)), F.coalesce("importance", F.lit(0.5)), half_life(F.coalesce("memory_type", F.lit("")), F.coalesce("confidence", F.lit(""))), F.coalesce("access_count", F.lit(0)), F.coalesce("source", F.lit(""))))


@book.add(BM25 + ", " + UTILITY + """, x AS (SELECT b.query_id, b.namespace, b.id, round(b.score / max(b.score) OVER (PARTITION BY b.query_id), 2) AS rel, round(u.utility, 9) AS utility FROM bm b JOIN ut u USING (namespace, id) WHERE b.rk <= 50)
SELECT query_id, namespace, id, rk FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, utility DESC, namespace, id) AS rk FROM x) WHERE rk <= 10""")
def r21_utility_tiebreak(spark, d):
    u = with_utility(entries(spark, d, "importance", "recurrence", "memory_type", "confidence", "access_count", "source", "last_accessed_at", "created_at")).select(*KEY, F.round("utility", 9).alias("utility"))
    best = F.max("score").over(Window.partitionBy("query_id"))
    b = _bm25(spark, d).withColumn("score", F.round(F.col("score") / best, 2))
    return ranking.utility_tiebreak(b.join(u, KEY), KEY).where("rk <= 10").select("query_id", *KEY, F.col("rk").cast("bigint").alias("rk"))


@book.add("{E}, t AS (SELECT namespace, id, importance, " + _WORDS.replace("{x}", "concat_ws(' ', content, detail)") + """ AS w FROM entries)
SELECT namespace, id, round(least(1.0, len(list_filter(w, lambda k: k IN ('ledger', 'vector', 'clock'))) / len(w) * 10) * 0.7 + coalesce(importance, 0) * 0.3, 6) AS score FROM t WHERE len(list_filter(w, lambda k: k IN ('ledger', 'vector', 'clock'))) > 0""")
def r18_fallback(spark, d):
    e = entries(spark, d, "content", "detail", "importance").withColumn("w", tx.lexical_tokens(F.concat_ws(" ", "content", "detail")))
    hits = F.size(F.filter("w", lambda k: k.isin("ledger", "vector", "clock")))
    e = e.withColumn("hits", hits).where("hits > 0")
    return e.select(*KEY, F.round(F.least(F.lit(1.0), F.col("hits") / F.size("w") * 10) * 0.7 + F.coalesce("importance", F.lit(0.0)) * 0.3, 6).alias("score"))


def queries() -> dict:
    return book.queries


def oracle_sql() -> dict[str, str]:
    return book.sql
