import datetime as dt
import random

from pyspark.sql import functions as F

from palimpsest.functions.times import iso_instant, utc_month
from palimpsest.operators.references import entry_references, orphan_references, orphan_report, references

UTC = dt.timezone.utc
EDGES = "id bigint, namespace string, source_id string, target_id string, edge_type string, weight double, created_at string, ref_at string"
POSTS = "posting_id bigint, namespace string, file string, entry_id string, indexed_at timestamp"
MEM = "id string, namespace string, updated_at timestamp, created_at timestamp, pending_delete boolean, content string"


def at(day, hour=0):
    return dt.datetime(2024, 5, day, hour, tzinfo=UTC)


def test_iso_instants(spark):
    texts = ["2024-05-01T10:00:00+02:00", "2024-05-01T08:00:00Z", "2024-05-01 08:00:00", "2024-05-01T03:00:00.000000-05:00", " 2024-05-01T08:00:00+00:00 ", "2024-05-01", "n/a", "", None, "2024-13-01T00:00:00", "5"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(F.unix_micros(iso_instant(F.col("t"))).alias("us"), utc_month(iso_instant(F.col("t"))).alias("m")).collect()
    eight = int(at(1, 8).timestamp() * 1e6)
    assert [r["us"] for r in rows[:5]] == [eight] * 5 and rows[5]["us"] == eight - 8 * 3_600_000_000
    assert [r["us"] for r in rows[6:]] == [None] * 5 and rows[0]["m"] == "2024-05"


def test_outcomes_and_edges_of_the_grace(spark):
    mem = [
        ("a", "n", at(2), at(1), False, "now"), ("a", "n", at(1), at(1), True, "old"), ("gone", "n", at(2), at(1), True, "x"), ("late", "n", at(9), at(9), None, "x"), ("edge", "n", at(9), at(6), False, "x"), ("a", "m", at(9), at(1), True, "other"),
    ]
    edges = [(1, "n", "a", "nowhere", None, None, "2024-05-05T00:00:00Z", "clash")] * 2 + [(2, "n", "gone", "late", None, None, "2024-05-05T00:00:00Z", None), (3, "n", "", None, None, None, None, None), (4, "n", "late", "edge", None, None, "bad", None), (5, None, "a", "a", None, None, None, None), (6, "n", "edge", "edge", None, None, "2024-05-05 00:00:00", None), (7, "n", "edge", "a", None, None, "2024-05-04T23:59:59Z", None)]
    posts = [(1, "m", "f", "a", None), (2, "n", "f", "a", at(3)), (3, "n", "f", "late", at(5)), (3, "n", "f", "late", at(5)), (4, "n", "f", "", at(5))]
    refs = entry_references(spark.createDataFrame(edges, EDGES), spark.createDataFrame(posts, POSTS))
    got = {(r["ref_table"][:6], r["ref_field"], r["record_id"], r["ref_period"], r["outcome"]) for r in orphan_references(refs, spark.createDataFrame(mem, MEM)).collect()}
    e = "memory"
    assert got == {
        (e, "target_id", 1, "2024-05", "missing"), (e, "source_id", 2, "2024-05", "deleted"), (e, "target_id", 2, "2024-05", "late"), (e, "source_id", 5, "unknown", "missing"), (e, "target_id", 5, "unknown", "missing"),
        (e, "source_id", 7, "2024-05", "late"), ("anchor", "entry_id", 1, "unknown", "deleted"), ("anchor", "entry_id", 3, "2024-05", "late"),
    }


def test_hot_parent_is_salted_and_nothing_is_lost(spark):
    rnd = random.Random(1)
    rows = [(i, "n", "hub" if i % 2 else f"k{rnd.randrange(40)}", None, None, None, "2024-05-05T00:00:00Z", None) for i in range(3000)]
    refs = references(spark.createDataFrame(rows, EDGES), "t", ["source_id"], "id", F.lit(None).cast("timestamp"))
    mem = [("hub", "n", at(2), at(1), True, "x")] * 3 + [(f"k{i}", "n", at(2), at(1), False, "x") for i in range(20)]
    out = orphan_references(refs, spark.createDataFrame(mem, MEM)).collect()
    assert len(out) == sum(1 for r in rows if r[2] == "hub" or int(r[2][1:]) >= 20) == len({r["record_id"] for r in out})


def test_empty_tables(spark):
    refs = entry_references(spark.createDataFrame([], EDGES), spark.createDataFrame([(1, "n", "f", "a", at(1))], POSTS))
    out = orphan_references(refs, spark.createDataFrame([], MEM))
    assert [(r["record_id"], r["outcome"]) for r in out.collect()] == [(1, "missing")]
    assert orphan_report(out).count() == 1
    none = entry_references(spark.createDataFrame([], EDGES), spark.createDataFrame([], POSTS))
    assert orphan_references(none, spark.createDataFrame([], MEM)).collect() == []
