import os

import pytest
from pyspark.sql import functions as F

from palimpsest.operators.skew import hot_keys, skew_join
from palimpsest.sources import scratch


def test_all_hundred_hot_keys_are_found(spark):
    df = spark.range(200_000).select((F.col("id") % 100).alias("k"), "id")
    assert len(hot_keys(df, ["k"])) == 100


def test_skew_join_is_a_join(spark):
    big = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    small = spark.range(0, 5000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    want = {(r["k"], r["id"], r["v"]) for r in big.join(small, "k").collect()}
    assert {(r["k"], r["id"], r["v"]) for r in skew_join(big, small, ["k"], ["id"]).collect()} == want


def test_a_cluster_without_a_shared_folder_is_refused():
    class Conf:
        def get(self, *_):
            return None

    class Cluster:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(RuntimeError):
        scratch.shared_folder(Cluster())


def test_written_tables_can_be_discarded(spark):
    t = scratch.written(spark.range(5), "five")
    path = t._written_at
    assert t.count() == 5 and os.path.isdir(path)
    scratch.discard(t)
    assert not os.path.exists(path) and path not in scratch._MADE
