import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import upkeep
from palimpsest.sources import formats

def now():
    return F.expr("TIMESTAMP '2024-06-01 00:00:00'")


def test_corrections(spark):
    e = spark.createDataFrame([("n", k, 0.5, "active", ["a"], dt.datetime(2024, 1, 1), 3, None) for k in "abcdefg"], "namespace string, id string, importance double, status string, tags array<string>, updated_at timestamp, sync_seq bigint, invalid_from timestamp")
    p = [("n", "a", 0.9, None, ["a", "b", "b"], 3), ("n", "b", 0.9, None, None, 2), ("n", "c", 1.5, None, None, None), ("n", "d", None, "archived", None, None), ("n", "e", None, None, ["a"], None), ("n", "f", None, "obsolete", None, None), ("n", "zz", 0.1, None, None, None)]
    rows, results = upkeep.corrected(e, spark.createDataFrame(p, "namespace string, id string, importance double, status string, tags_add array<string>, if_revision bigint"), ["importance", "status"], now())
    assert {r["id"]: r["result"] for r in results.collect()} == {"a": "applied", "b": "conflict", "c": "invalid", "d": "invalid", "e": "unchanged", "f": "applied", "zz": "missing"}
    got = {r["id"]: (r["importance"], r["status"], r["tags"], r["sync_seq"], r["invalid_from"] is None) for r in rows.collect()}
    same = (0.5, "active", ["a"], 3, True)
    assert got == {"a": (0.9, "active", ["a", "b"], 4, True), "f": (0.5, "obsolete", ["a"], 4, False)} | {k: same for k in "bcdeg"}


def test_forgetting(spark):
    e = spark.createDataFrame([("n", f"e{i}", "some text" if i < 5 else "else", None, None, "me" if i % 2 else "you", dt.datetime(2024, 1, 1 + i)) for i in range(8)], "namespace string, id string, content string, detail string, tags array<string>, source_identity string, updated_at timestamp")
    keys = lambda got: (sorted(r["id"] for r in got[0].collect()), got[1])
    assert keys(upkeep.forgotten(e, query="SOME")) == (["e0", "e1", "e2", "e3", "e4"], False)
    assert keys(upkeep.forgotten(e, query="some", most=2)) == (["e3", "e4"], True) and keys(upkeep.forgotten(e, actor="me", most=4)) == (["e1", "e3", "e5", "e7"], False)
    named = spark.createDataFrame([("n", "e1"), ("n", "e2"), ("n", "gone"), ("n", "e1")], "namespace string, id string")
    assert keys(upkeep.forgotten(e, ids=named, canaries=named.where("id = 'e2'"))) == (["e1"], False)


def test_consolidation(spark):
    e = spark.createDataFrame([("n", k, k * n, "", ["t"], i / 10, 1, "high", "active", None, None) for i, (k, n) in enumerate([("a", 1), ("b", 3), ("c", 2), ("d", 1), ("e", 1)])], "namespace string, id string, content string, detail string, tags array<string>, importance double, access_count bigint, confidence string, status string, invalid_from timestamp, consolidated_into string")
    c = spark.createDataFrame([("n", 0, "a", 1), ("n", 0, "b", 2), ("n", 0, "c", 3), ("n", 1, "d", 1), ("n", 1, "e", 2)], "namespace string, cluster int, id string, position int")
    merged, originals, skipped = upkeep.consolidated(e, c, now())
    m = merged.collect()
    assert len(m) == 1 and m[0]["content"] == "bbb" and m[0]["merged_from"] == ["a", "b", "c"] and m[0]["importance"] == 0.2 and m[0]["access_count"] == 3 and m[0]["id"].startswith("M-")
    assert {(r["id"], r["status"], r["consolidated_into"]) for r in originals.collect()} == {(k, "archived", m[0]["id"]) for k in "abc"}
    assert [(r["cluster"], r["n"]) for r in skipped.collect()] == [(1, 2)]


def test_cycle_rows(spark):
    rows = [("n", f"e{i:02}", "active" if i % 10 else "archived", dt.datetime(2024, 1, 1) + dt.timedelta(i), "M-1" if i == 7 else None, "consolidated" if i == 8 else None, i == 9, None) for i in range(12)]
    e = spark.createDataFrame(rows, "namespace string, id string, status string, updated_at timestamp, consolidated_into string, source string, protected boolean, canary boolean")
    assert {(r["id"], r["position"]) for r in upkeep.consolidation_rows(e, 6).collect()} == {("e11", 1), ("e06", 5), ("e05", 6)}


def test_mean_similarity(spark):
    m = np.random.default_rng(5).normal(size=(20, 6))
    m[3] = 0
    rows = [("g", [float(x) for x in v]) for v in m] + [("one", [1.0]), ("g", None)]
    got = {r["g"]: (r["n"], r["mean_similarity"]) for r in upkeep.mean_similarity(spark.createDataFrame(rows, "g string, vector array<double>"), ["g"]).collect()}
    norm = np.linalg.norm(m, axis=1)
    cos = [m[i] @ m[j] / (norm[i] * norm[j]) if norm[i] * norm[j] else 0.0 for i in range(20) for j in range(i + 1, 20)]
    assert got["g"] == (20, pytest.approx(np.mean(cos))) and got["one"] == (1, 0.0)


def test_assertions_have_three_values(spark):
    files = spark.createDataFrame([("src/a.py", "def run(): pass"), ("src/b.py", None), ("src/deep/c.py", "other"), ("bin/x", "\x00run"), ("big/y", "run" * 400_000), ("doc/z.md", "text")], "path string, text string")
    want = {
        1: ("grep_present", "run", "src/*.py", True), 2: ("grep_present", "walk", "src/*.py", None), 3: ("grep_present", "walk", "src/deep/*", False), 4: ("grep_absent", "walk", "src/*.py", None), 5: ("grep_absent", "walk", "src/deep/**", True),
        6: ("grep_absent", "run", "src/**", False), 7: ("glob_exists", "src/*/c.py", "", True), 8: ("glob_exists", "src/*.c", "", False), 9: ("glob_absent", "", "nowhere/**", True), 10: ("grep_present", "(", "**", None),
        11: ("grep_present", "run", "bin/*", False), 12: ("grep_present", "run", "big/*", None), 13: ("odd", "run", "**", None), 14: ("grep_present", "text", "**/z.md", True),
        15: ("grep_present", "run", "src/a.py", True), 16: ("grep_absent", "run", "src/b.py", None), 17: ("glob_exists", "src/a.py", "", True), 18: ("glob_absent", "src/none.py", "", True), 19: ("grep_present", "run", "bin/x", False), 20: ("grep_present", "(", "src/a.py", None),
    }
    a = spark.createDataFrame([(k, *v[:3]) for k, v in want.items()], "assertion_id int, type string, pattern string, target string")
    for n in (3, 100):
        assert {r["assertion_id"]: r["result"] for r in upkeep.verify_assertions(a, files, n).collect()} == {k: v[3] for k, v in want.items()}
    assert upkeep.verify_assertions(a.limit(0), files).collect() == []


def test_anchor_validity(spark):
    files = spark.createDataFrame([("a.py", "def runner(): $ref __call__"), ("b.py", "x.run()")], "path string, text string")
    a = spark.createDataFrame([("e", "a.py", "run"), ("e", "b.py", "run"), ("e", "none.py", "run"), ("f", "a.py", "$ref"), ("f", "a.py", "__call__"), ("f", None, "x"), ("g", "b.py", "")], "id string, file string, symbol string")
    assert {r["id"]: r["validity"] for r in upkeep.anchor_validity(a, files, ["id"]).collect()} == {"e": 0.33, "f": 0.67, "g": 0.0}


def test_assertion_union_and_health(spark):
    kind = "array<struct<type:string,pattern:string,target:string,n:int>>"
    df = spark.createDataFrame([([("g", "a", "t", 1), ("g", "a", "t", 2)], [("g", "b", "t", 3), ("g", "a", "t", 4), ("g", "b", "t", 5), ("h", "a", "t", 6)]), (None, [("g", "b", "t", 1)]), ([], None)], f"x {kind}, y {kind}")
    assert [[a["n"] for a in r["u"]] for r in df.select(upkeep.united_assertions(F.col("x"), F.col("y")).alias("u")).collect()] == [[1, 2, 3, 6], [1], []]
    h = spark.createDataFrame([("n", "a", dt.datetime(2024, 5, 30), True), ("n", "a", dt.datetime(2024, 5, 30), False), ("n", "b", dt.datetime(2024, 5, 30), None), ("n", "b", dt.datetime(2023, 1, 1), True), ("n", "b", None, None)], "namespace string, id string, last_verified_at timestamp, last_result boolean")
    r = upkeep.assertion_health(h, now(), 30).first()
    assert (r["total"], r["passing"], r["failing"], r["stale"], r["unverifiable"]) == (2, 1, 1, 2, 1)


def test_tier_search_prefers_vectors(spark):
    rows = spark.createDataFrame([("n", "a", "one two", None, None), ("n", "b", "two", None, ["One"]), ("n", "c", "three", None, None)], "namespace string, id string, content string, detail string, tags array<string>")
    near = spark.createDataFrame([("n", "c", 1.0)], "namespace string, id string, distance double")
    assert [(r["id"], r["score"]) for r in upkeep.tier_search(rows, ["ONE", "two", "one"], 5).collect()] == [("a", 1.0), ("b", 1.0)]
    assert [(r["id"], r["score"]) for r in upkeep.tier_search(rows, ["one"], 5, near).collect()] == [("c", 0.5)] and upkeep.tier_search(rows, ["one"], 1, near.limit(0)).count() == 1


def test_scope_refuses_whole_calls(spark):
    df, scope = spark.createDataFrame([("a",), ("b",)], "namespace string"), spark.createDataFrame([("a",), ("b",), ("c",)], "namespace string")
    assert upkeep.in_scope(df, scope) is df
    for bad in (scope.where("namespace <> 'b'"), scope.limit(0)):
        with pytest.raises(upkeep.ScopeError):
            upkeep.in_scope(df, bad)
    with pytest.raises(upkeep.ScopeError):
        upkeep.in_scope(spark.createDataFrame([(None,)], "namespace string"), scope)


def test_census(spark):
    counts = spark.createDataFrame([("project:a-1", 5), ("project:a-2", 7), ("project:a-3", 7), ("project:b-1", 1), ("team:a-9", 99), ("project:a-4", 0)], "namespace string, rows bigint")
    registered = spark.createDataFrame([("project:a-4",), ("project:a-0",), ("project:b-1",), ("project:c-1",), ("team:z-1",)], "namespace string")
    assert {tuple(r) for r in upkeep.moved_checkouts(registered, counts).collect()} == {("project:a-4", "project:a-2", 7), ("project:a-0", "project:a-2", 7)}
    e = spark.createDataFrame([("t", "a", "active", 0.9), ("t", "b", "active", 0.1), ("t", "c", "active", 0.9), ("t", "d", "archived", 0.9), ("t", "e", "active", None)], "namespace string, id string, status string, importance double")
    assert tuple(upkeep.promotion_summary(e, spark.createDataFrame([("promoted-c",)], "id string")).first()) == ("t", 1, 2, 1)


def test_rebuild_types_and_latest(spark):
    from pyspark.sql import types as T

    schema = T.StructType.fromDDL("id string, n bigint, at timestamp, tags array<string>, more double")
    cold = spark.createDataFrame([("a", "1", "2024-01-01T00:00:00Z", '["x"]'), ("a", "2", "2024-01-02T00:00:00Z", "broken"), ("b", "many", None, None), (None, "1", None, None)], "id string, n string, at string, tags string")
    got = {r["id"]: (r["n"], r["tags"], r["more"]) for r in formats.rebuild(cold, schema, ["id"], "at").collect()}
    assert got == {"a": (2, None, None), "b": (None, None, None)}
