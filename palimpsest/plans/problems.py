"""Queries of the general data problems (orphans, change feed, as-of) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.asof import learnings_at_events
from ..operators.changefeed import SET_BY, apply_feed, bootstrap, live_rows
from ..operators.references import entry_references, orphan_references, orphan_report


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = entry_references(table(spark, sf_dir, "memory_graph_edges"), table(spark, sf_dir, "anchor_postings"))
    return orphan_references(refs, table(spark, sf_dir, "memories"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("ref_table", "ref_field", "record_id", "ref_period")


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(_orphans(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = apply_feed(bootstrap(table(spark, sf_dir, "memories")), table(spark, sf_dir, "queue_records"))
    return live_rows(after).where(f"{SET_BY} IS NOT NULL").select("namespace", "id", SET_BY).toDF("namespace", "entry_id", "queue_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learnings_at_events(table(spark, sf_dir, "replay_events"), table(spark, sf_dir, "memories"))


_ORPHANS = r"""
WITH e AS (SELECT DISTINCT id, namespace, source_id, target_id, trim(created_at) AS t FROM memory_graph_edges),
et AS (SELECT *, timezone('UTC', CASE WHEN regexp_matches(t, '^\d{4}-\d\d-\d\d[T ].*([zZ]|[+-]\d\d(:?\d\d)?)$') THEN try_cast(t AS timestamptz)
                      ELSE try_cast(t || '+00' AS timestamptz) END) AS ref_at FROM e),
refs AS (
  SELECT 'memory_graph_edges' AS ref_table, 'source_id' AS ref_field, id AS record_id, ref_at, namespace, source_id AS entry_id FROM et
  UNION ALL SELECT 'memory_graph_edges', 'target_id', id, ref_at, namespace, target_id FROM et
  UNION ALL SELECT DISTINCT 'anchor_postings', 'entry_id', posting_id, timezone('UTC', indexed_at), namespace, entry_id FROM anchor_postings),
cur AS (SELECT namespace, id, arg_max(timezone('UTC', created_at), updated_at) AS born, arg_max(coalesce(pending_delete, false), updated_at) AS gone FROM memories GROUP BY 1, 2),
orphans AS (
  SELECT r.*, coalesce(strftime(r.ref_at, '%Y-%m'), 'unknown') AS ref_period,
         CASE WHEN c.id IS NULL THEN 'missing' WHEN c.gone THEN 'deleted' WHEN c.born > r.ref_at + INTERVAL 24 HOUR THEN 'late' END AS outcome
  FROM refs r LEFT JOIN cur c ON r.namespace = c.namespace AND r.entry_id = c.id WHERE r.entry_id <> '')
"""

P1_FOUND = _ORPHANS + "SELECT DISTINCT ref_table, ref_field, record_id, ref_period FROM orphans WHERE outcome IS NOT NULL"

P1_REPORT = _ORPHANS + """SELECT ref_table, ref_field, ref_period, outcome, count(*) AS n_refs, count(DISTINCT (namespace, entry_id)) AS n_entries
FROM orphans WHERE outcome IS NOT NULL GROUP BY 1, 2, 3, 4"""

P2_FOUND = """
WITH rec AS (SELECT DISTINCT queue_id, namespace, entry_id, revision.sync_seq AS seq, CASE WHEN revision.sync_seq IS NOT NULL THEN revision.sync_hash END AS hash,
               CASE WHEN lower(op) = 'delete' OR CAST(payload->>'$.pending_delete' AS boolean) THEN 'delete' ELSE lower(op) END AS op,
               CAST(CAST(payload->'$.vector_clock' AS json) AS map(varchar, bigint)) AS clock FROM queue_records),
keyed AS (SELECT *, CASE WHEN seq IS NULL THEN CAST(list_sort(map_entries(clock)) AS varchar) ELSE concat(seq, '/', hash) END AS k FROM rec),
chg AS (SELECT namespace, entry_id, seq, hash, k, min(queue_id) AS queue_id, arg_min(op, queue_id) AS op, arg_min(clock, queue_id) AS clock FROM keyed GROUP BY 1, 2, 3, 4, 5),
cur AS (SELECT namespace, id, arg_max({'s': sync_seq, 'h': sync_hash, 'c': vector_clock, 'p': coalesce(pending_delete, false)}, updated_at) AS x FROM memories GROUP BY 1, 2),
named AS (SELECT DISTINCT namespace, entry_id FROM chg),
alls AS (
  SELECT c.namespace, c.entry_id, c.seq, c.hash, c.queue_id, c.op, c.clock FROM chg c LEFT JOIN cur m ON m.namespace = c.namespace AND m.id = c.entry_id
  WHERE m.id IS NULL OR NOT coalesce(CASE WHEN c.seq IS NOT NULL THEN c.seq = m.x.s AND c.hash = m.x.h ELSE list_sort(map_entries(c.clock)) = list_sort(map_entries(m.x.c)) END, false)
  UNION ALL SELECT m.namespace, m.id, m.x.s, m.x.h, 0, CASE WHEN m.x.p THEN 'delete' ELSE 'insert' END, CAST(m.x.c AS map(varchar, bigint)) FROM cur m JOIN named n ON n.namespace = m.namespace AND n.entry_id = m.id),
live AS (SELECT * FROM alls WHERE op IN ('insert', 'update', 'delete')),
pairs AS (
  SELECT a.namespace, a.entry_id, a.queue_id AS qa, a.op AS oa, b.queue_id AS qb, b.op AS ob, a.seq AS sa, b.seq AS sb, coalesce(a.hash, '') AS ha, coalesce(b.hash, '') AS hb,
    list_transform(list_distinct(list_concat(map_keys(a.clock), map_keys(b.clock))), lambda n: coalesce(map_extract(a.clock, n)[1], 0) - coalesce(map_extract(b.clock, n)[1], 0)) AS gap
  FROM live a JOIN live b ON a.namespace = b.namespace AND a.entry_id = b.entry_id AND a.queue_id <> b.queue_id),
judged AS (
  SELECT *, CASE WHEN sa <> sb THEN sa > sb
    WHEN len(list_filter(gap, lambda g: g > 0)) > 0 AND len(list_filter(gap, lambda g: g < 0)) = 0 THEN true
    WHEN len(list_filter(gap, lambda g: g < 0)) > 0 AND len(list_filter(gap, lambda g: g > 0)) = 0 THEN false
    ELSE ha > hb END AS a_later FROM pairs),
last AS (SELECT namespace, entry_id, queue_id FROM live l WHERE NOT EXISTS (SELECT 1 FROM judged j WHERE j.a_later AND j.namespace = l.namespace AND j.entry_id = l.entry_id AND j.qb = l.queue_id)),
dead AS (SELECT namespace, entry_id FROM live WHERE op = 'delete'),
ins_after AS (
  -- an insert later than every delete
  SELECT l.namespace, l.entry_id FROM live l WHERE l.op = 'insert' AND NOT EXISTS (
    SELECT 1 FROM judged j WHERE j.namespace = l.namespace AND j.entry_id = l.entry_id AND j.qa = l.queue_id AND j.ob = 'delete' AND NOT j.a_later))
SELECT namespace, entry_id, queue_id FROM last l
WHERE NOT EXISTS (SELECT 1 FROM dead d WHERE d.namespace = l.namespace AND d.entry_id = l.entry_id)
   OR EXISTS (SELECT 1 FROM ins_after i WHERE i.namespace = l.namespace AND i.entry_id = l.entry_id)"""

P3_FOUND = """
WITH cur AS (SELECT namespace, id, arg_max({'c': created_at, 'v': coalesce(valid_from, created_at), 'i': invalid_from, 'b': invalidated_by, 'r': remote_id}, updated_at) AS x
             FROM memories GROUP BY 1, 2),
rows_ AS (SELECT m.namespace, m.id, m.x.c AS created_at, m.x.v AS valid_from, m.x.r AS remote_id,
                 CASE WHEN m.x.i IS NULL THEN NULL WHEN k.id IS NULL THEN m.x.i ELSE greatest(m.x.i, k.x.c) END AS closed_at
          FROM cur m LEFT JOIN cur k ON k.namespace = m.namespace AND k.id = m.x.b),
ev AS (SELECT DISTINCT event_id, event_at, namespace, learning_id FROM replay_events)
SELECT event_id, entry_id FROM (
  SELECT e.event_id, v.id AS entry_id, row_number() OVER (PARTITION BY e.event_id ORDER BY v.valid_from DESC, v.created_at DESC, v.id DESC) AS rn
  FROM ev e JOIN rows_ l ON l.namespace = e.namespace AND l.id = e.learning_id
  JOIN rows_ v ON v.namespace = l.namespace AND (v.id = l.id OR v.remote_id = l.remote_id)
  WHERE v.created_at <= e.event_at AND v.valid_from <= e.event_at AND (v.closed_at IS NULL OR e.event_at < v.closed_at))
WHERE rn = 1"""


def queries() -> dict:
    return {"p1_found": p1_found, "p1_report": p1_report, "p2_found": p2_found, "p3_found": p3_found}


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p1_report": P1_REPORT, "p2_found": P2_FOUND, "p3_found": P3_FOUND}
