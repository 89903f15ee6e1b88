import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.operators.changefeed import apply_feed, bootstrap
from palimpsest.sources import formats
from palimpsest.sources.buckets import BucketedTable
from palimpsest.sources.scratch import new_path
from palimpsest.streaming import feeds


def test_json_import(spark, tmp_path):
    good = {"id": "a", "content": "x", "tags": ["t"], "created_at": "2024-01-01T00:00:00Z"}
    lines = [json.dumps(good), json.dumps(good | {"importance": 3}), json.dumps(good | {"status": "odd"}), json.dumps({"content": "x"}), "{broken", ""]
    (tmp_path / "in.json").write_text("\n".join(lines))
    ok, bad = formats.import_json(spark, str(tmp_path / "in.json"))
    row = ok.collect()
    assert len(row) == 1 and row[0]["namespace"] == "default" and row[0]["importance"] == 0.5
    assert sorted(r["reason"] for r in bad.collect()) == ["bad_importance", "bad_status", "no_id", "unreadable"]
    formats.export_json(ok, str(tmp_path / "out"))
    again, _ = formats.import_json(spark, str(tmp_path / "out"))
    assert again.collect() == row


def test_cold_archive_is_pruned(spark, tmp_path):
    df = spark.createDataFrame([("a", "2024-01-31 23:59:59"), ("b", "2024-02-01 00:00:00"), ("c", "2025-01-01 00:00:00")], "id string, t string").select("id", F.col("t").cast("timestamp").alias("created_at"))
    formats.write_cold(df, str(tmp_path / "cold"))
    assert {r["id"] for r in formats.read_cold(spark, str(tmp_path / "cold"), (2024, 2), (2024, 12)).collect()} == {"b"}
    formats.write_cold(df.limit(0), str(tmp_path / "none"))
    assert formats.read_cold(spark, str(tmp_path / "none"), (2024, 2), None, df.schema).collect() == []


def test_sidecar_and_entry_files(spark, tmp_path):
    (tmp_path / "log").write_text('{"id": "a", "pos": 1, "v": "x"}\n{"id": "a", "pos": 3, "v": "z"}\nnot json\n{"id": "b", "pos": 2, "v": "y"}\n')
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("pos", T.LongType()), T.StructField("v", T.StringType())])
    assert {(r["id"], r["v"]) for r in formats.read_sidecar(spark, str(tmp_path / "log"), schema, ["id"], "pos").where("id IS NOT NULL").collect()} == {("a", "z"), ("b", "y")}
    df = spark.createDataFrame([("a", 1, "line one\nline: two"), ("b", None, None)], schema)
    formats.write_entry_files(df, str(tmp_path / "store"))
    rows, bad = formats.read_entry_files(spark, str(tmp_path / "store"), schema)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, df.collect())) and bad.count() == 0


def test_streams(spark, tmp_path):
    rows = [(i % 20, f"u{i % 2}", i) for i in range(40)]
    df = spark.createDataFrame(rows, "event_id bigint, who string, n bigint").withColumn("at", F.timestamp_seconds(F.col("n") * 30))
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    source = lambda: feeds.read_feed(spark, str(tmp_path / "in"), df.schema, 2)
    assert feeds.to_files(source().dropDuplicates(["event_id"])).count() == 20
    counts = feeds.to_files(feeds.windowed_counts(source(), "at", "1 hour", "5 minutes", None, "who"), "complete")
    assert counts.agg(F.sum("n")).first()[0] == 40 and counts.count() == 8
    limited = feeds.to_files(feeds.write_limiter(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")).withColumn("us", F.unix_micros("at")), "who", "us", "n", 1, 90))
    assert limited.where("admitted").count() == 20 and limited.count() == 40  # every other row of a minute's rhythm
    cached = feeds.to_files(feeds.event_cache(source(), "who", "event_id", "n", 3), "update")
    assert cached.where("who = 'u0'").agg(F.max(F.col("keys"))).first()[0] == [14, 16, 18]


def test_change_feed_as_a_stream(spark, tmp_path):
    mem = "namespace string, id string, content string, detail string, importance double, status string, updated_at timestamp, vector_clock map<string,bigint>, pending_delete boolean, sync_seq bigint, sync_hash string"
    queue = "queue_id bigint, namespace string, entry_id string, op string, payload string, revision struct<sync_seq: bigint, sync_hash: string>"
    root = new_path(spark, "streamed")
    bootstrap(spark.createDataFrame([], mem), root)
    recs = [(i, "n", f"e{i % 3}", "insert", json.dumps({"content": f"c{i}", "vector_clock": {"x": i}}), (i, "h")) for i in range(9)]
    spark.createDataFrame(recs, queue).repartition(3, "queue_id").write.parquet(str(tmp_path / "q"))
    feed = feeds.read_feed(spark, str(tmp_path / "q"), spark.createDataFrame([], queue).schema, 1)
    feeds.apply_stream(feed, lambda b: apply_feed(BucketedTable.open(spark, root), b), str(tmp_path / "cp"))
    got = {r["id"]: r["content"] for r in BucketedTable.open(spark, root).read().collect()}
    assert set(got) == {"e0", "e1", "e2"}
