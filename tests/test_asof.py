import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators.asof import as_of_join, event_nodes, interval_nodes, learnings_at_events

UTC = dt.timezone.utc
BASE = dt.datetime(2024, 1, 1, tzinfo=UTC)


def hours(n):
    return None if n is None else BASE + dt.timedelta(hours=n)


def test_nodes_cover_exactly(spark):
    spans = [(a, b) for a in range(0, 16) for b in range(a, 16)]
    df = spark.createDataFrame(spans, "lo bigint, hi bigint").select("lo", "hi", interval_nodes(F.col("lo"), F.col("hi"), 4).alias("nodes")).collect()
    inside = {r["c"]: set(r["n"]) for r in spark.range(16).select(F.col("id").alias("c"), event_nodes(F.col("id"), 4).alias("n")).collect()}
    for r in df:
        assert len(set(r["nodes"])) == len(r["nodes"]) <= 8
        for c in range(16):
            assert len(inside[c] & set(r["nodes"])) == (r["lo"] <= c <= r["hi"])


@pytest.mark.parametrize("seed,leaf", [(1, 3600), (2, 7200), (3, 86_400 * 30)])
def test_matches_brute_force(spark, seed, leaf):
    rnd = random.Random(seed)
    versions = []
    for i in range(120):
        a = rnd.choice([None, *range(0, 300)])
        b = rnd.choice([None, *range(0, 400)])
        versions.append((f"k{rnd.randrange(6)}", f"v{i % 50}", hours(a), hours(b), rnd.randrange(3)))
    events = [(i, "k0" if i % 2 else f"k{rnd.randrange(8)}", hours(rnd.randrange(-5, 420)), "extra") for i in range(400)] + [(900, None, hours(3), ""), (901, "k1", None, ""), (3, "k1", hours(7), "")]
    events[3] = events[-1]
    e = spark.createDataFrame(events + events[:20], "event bigint, k string, at timestamp, start string")
    v = spark.createDataFrame(versions, "k string, id string, start timestamp, stop timestamp, rank int")
    got = {r["event"]: tuple(r["_v"]) for r in as_of_join(e, v, "event", "at", ["k"], "start", "stop", ["rank", "id"], leaf).collect()}
    want = {}
    for i, k, at, _ in events:
        hit = [(x[4], x[1]) for x in versions if at and k == x[0] and x[2] and x[2] <= at and (x[3] is None or at < x[3])]
        if hit:
            want[i] = max(hit)
    assert got == want


def test_learning_rules(spark):
    mem = "namespace string, id string, updated_at timestamp, created_at timestamp, valid_from timestamp, invalid_from timestamp, invalidated_by string, remote_id string, event_at string"
    rows = [
        ("n", "a", hours(1), hours(0), hours(0), hours(10), "b", "r", ""), ("n", "b", hours(20), hours(15), hours(10), None, None, "r", ""),  # a stays in force until b is stored
        ("n", "c", hours(1), hours(0), None, hours(10), "nobody", None, ""), ("n", "d", hours(1), hours(5), hours(2), None, None, None, ""),
        ("m", "a", hours(1), hours(0), hours(0), None, None, "r", ""), ("n", "b", hours(2), hours(0), hours(0), hours(1), None, "q", ""),  # an older row
        ("n", "x", hours(1), hours(0), hours(3), None, None, "t", ""), ("n", "y", hours(1), hours(1), hours(3), None, None, "t", ""), ("n", "z", hours(1), hours(1), hours(3), None, None, "t", ""),
    ]
    ask = [(1, 12, "a"), (2, 15, "a"), (3, 14, "b"), (4, 9, "c"), (5, 10, "c"), (6, 3, "d"), (7, 5, "d"), (8, 4, "x"), (9, 2, "x"), (10, 5, "nobody"), (11, 5, None)]
    ev = spark.createDataFrame([(i, hours(h), 1, "k", "n", k, "s", None) for i, h, k in ask] * 2, "event_id bigint, event_at timestamp, seq bigint, kind string, namespace string, learning_id string, subject string, paths array<string>")
    got = {r["event_id"]: r["entry_id"] for r in learnings_at_events(ev, spark.createDataFrame(rows, mem)).collect()}
    assert got == {1: "a", 2: "b", 3: "a", 4: "c", 7: "d", 8: "z"}
    assert learnings_at_events(ev.limit(0), spark.createDataFrame(rows, mem)).collect() == []
    assert learnings_at_events(ev, spark.createDataFrame([], mem)).collect() == []
