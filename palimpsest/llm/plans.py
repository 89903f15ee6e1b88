"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from . import components, cooccur, langid, leakage, packing

TOKENIZER_VARIABLE = "PALIMPSEST_TOKENIZER"
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_lift(spark, sf_dir).select("tag_a", "tag_b")


def p4_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cooccur.cooccurrence(table(spark, sf_dir, "memory_tags"), ["namespace", "entry_id"], "tag")
    return out.withColumnsRenamed({"item_a": "tag_a", "item_b": "tag_b"})


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.entry_groups(table(spark, sf_dir, "memories"))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), os.environ.get(TOKENIZER_VARIABLE, TOKENIZER))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.without_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.language_cases(docs, langid.train(docs))


def p8_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.segments(docs, langid.train(docs))


_LIFT = """
WITH t AS (SELECT DISTINCT namespace, entry_id, lower(trim(tag)) AS tag FROM memory_tags WHERE trim(tag) <> '' AND namespace IS NOT NULL AND entry_id IS NOT NULL),
n AS (SELECT tag, count(*) AS n FROM t GROUP BY 1),
total AS (SELECT count(*) AS n_baskets FROM (SELECT DISTINCT namespace, entry_id FROM t)),
p AS (SELECT a.tag AS tag_a, b.tag AS tag_b, count(*) AS n_both FROM t a JOIN t b ON a.namespace = b.namespace AND a.entry_id = b.entry_id AND a.tag < b.tag GROUP BY 1, 2)
SELECT tag_a, tag_b, n_both, x.n AS n_a, y.n AS n_b, n_baskets, CAST(n_both AS double) * n_baskets / x.n / y.n AS lift
FROM p JOIN n x ON x.tag = tag_a JOIN n y ON y.tag = tag_b CROSS JOIN total WHERE n_both >= 8 AND n_both * n_baskets >= 5 * x.n * y.n"""

_GROUPS = """
WITH RECURSIVE cur AS (SELECT namespace, id, arg_max({'m': merged_from, 'c': consolidated_into}, updated_at) AS x FROM memories GROUP BY 1, 2),
link AS (SELECT namespace, id AS a, unnest(list_append(coalesce(x.m, []), x.c)) AS b FROM cur),
edge AS (SELECT DISTINCT namespace, a, b FROM link WHERE regexp_matches(b, '^[ML]-[0-9a-f]{8}$') AND a <> b),
both_ AS (SELECT namespace, a, b FROM edge UNION SELECT namespace, b, a FROM edge),
reach AS (SELECT namespace, a, a AS b FROM both_ UNION SELECT r.namespace, r.a, e.b FROM reach r JOIN both_ e ON e.namespace = r.namespace AND e.a = r.b)
SELECT namespace, a AS entry_id, min(b) AS group_id FROM reach GROUP BY 1, 2"""

_LEAKS = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
dg AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i+11], ' '))) AS g FROM dw WHERE len(w) >= 12),
iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
ig AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i+11], ' '))) AS g FROM iw WHERE len(w) >= 12)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)"""


def queries() -> dict:
    return {f.__name__: f for f in (p4_found, p4_lift, p5_found, p6_containers, p7_found, p7_clean, p8_found, p8_segments)}


def oracle_sql() -> dict[str, str]:
    return {"p4_found": f"SELECT tag_a, tag_b FROM ({_LIFT})", "p4_lift": _LIFT, "p5_found": _GROUPS, "p7_found": _LEAKS}
