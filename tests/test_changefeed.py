import datetime as dt
import functools
import itertools
import json
import os
import random

import pytest

from palimpsest.operators import changefeed
from palimpsest.operators.changefeed import SET_BY, apply_feed, bootstrap, live_rows
from palimpsest.sources.buckets import BucketedTable
from palimpsest.sources.scratch import new_path

UTC = dt.timezone.utc
MEM = "namespace string, id string, content string, detail string, importance double, status string, updated_at timestamp, vector_clock map<string,bigint>, pending_delete boolean, sync_seq bigint, sync_hash string, tags array<string>, queue_id string, bucket int, _bucket string"
QUEUE = "queue_id bigint, namespace string, entry_id string, op string, payload string, queued_at string, retry_count int, last_error string, revision struct<sync_seq: bigint, sync_hash: string>, id string"


def memory(id_, seq, clock, gone=False, ns="n", at=1, hash_="h"):
    return (ns, id_, f"base {id_}", None, 0.5, "active", dt.datetime(2024, 1, at, tzinfo=UTC), clock, gone, seq, hash_, ["t"], "clash", 7, "clash")


def record(q, id_, op, clock, rev=None, ns="n", gone=None):
    p = {"namespace": ns, "content": f"by {q}", "importance": 0.9, "status": "active", "updated_at": "2024-03-01T00:00:00+00:00", "vector_clock": clock}
    return (q, ns, id_, op, json.dumps(p | ({} if gone is None else {"pending_delete": gone})), "2024", 0, None, rev, "clash")


def state(table):
    return {(r["namespace"], r["id"]): (r["content"], r[SET_BY]) for r in live_rows(table).collect()}


def brute(mem, recs):
    """The rules word by word: one sorted history an entry."""
    base = {}
    for m in mem:
        if (m[0], m[1]) not in base or m[6] > base[m[0], m[1]][6]:
            base[m[0], m[1]] = m
    per = {}
    for r in recs:
        p = json.loads(r[4])
        op = "delete" if (r[3] or "").lower() == "delete" or p.get("pending_delete") else (r[3] or "").lower()
        key = ("r", r[8]) if r[8] else ("c", tuple(sorted(p["vector_clock"].items())))
        own = per.setdefault((r[1], r[2]), {})
        if key not in own or own[key]["q"] > r[0]:
            own[key] = {"q": r[0], "op": op, "clock": p["vector_clock"], "rev": r[8]}
    out = {k: (m[2], None) for k, m in base.items() if not m[8]}
    for k, own in per.items():
        changes = list(own.values())
        if k in base:
            m = base[k]
            changes = [c for c in changes if not (c["rev"] == (m[9], m[10]) if c["rev"] else c["clock"] == m[7])]
            changes.append({"q": 0, "op": "delete" if m[8] else "insert", "clock": m[7], "rev": (m[9], m[10])})

        def cmp(a, b):
            if a["rev"] and b["rev"] and a["rev"][0] != b["rev"][0]:
                return a["rev"][0] - b["rev"][0]
            nodes = {*a["clock"], *b["clock"]}
            gap = [a["clock"].get(n, 0) - b["clock"].get(n, 0) for n in nodes]
            up, down = any(g > 0 for g in gap), any(g < 0 for g in gap)
            if up != down:
                return 1 if up else -1
            x, y = (a["rev"] or (0, ""))[1], (b["rev"] or (0, ""))[1]
            return (x > y) - (x < y)

        live, dead, by = False, False, None
        for c in sorted(changes, key=functools.cmp_to_key(cmp)):
            if c["op"] == "delete":
                live, dead = False, True
            elif c["op"] == "insert" or (c["op"] == "update" and not dead):
                live, dead, by = True, False, c["q"]
        out.pop(k, None)
        if live:
            out[k] = (base[k][2] if by == 0 else f"by {by}", by)
    return out


def run(spark, mem, recs, rows_per_bucket=2):
    return apply_feed(bootstrap(spark.createDataFrame(mem, MEM), rows_per_bucket=rows_per_bucket), spark.createDataFrame(recs, QUEUE))


def test_rules(spark):
    mem = [memory("a", 10, {"x": 1}), memory("a", 5, {}, at=1, hash_="old"), memory("b", 10, {"x": 2}), memory("dead", 10, {"x": 1}, gone=True), memory("kept", 1, {}), memory("a", 3, {}, ns="m")]
    recs = [
        record(9, "a", "Update", {"x": 2}, (11, "k")), record(4, "a", "update", {"x": 2}, (11, "k")), record(4, "a", "update", {"x": 2}, (11, "k")),  # repeated
        record(5, "b", "DELETE", {"x": 1}, (9, "k")),  # older than the row
        record(6, "dead", "update", {"x": 2}, (12, "k")),  # stands deleted
        record(7, "new", "update", {"y": 1}), record(8, "new", None, {"y": 0}, None, gone=True), record(3, "odd", None, {"x": 1}),
        record(10, "again", "insert", {"y": 3}), record(11, "again", "delete", {"y": 2}), record(12, "again", "insert", {"y": 1}),
    ]
    got = state(run(spark, mem, recs))
    assert got[("n", "a")] == ("by 4", 4) and got[("n", "b")] == ("base b", 0) and ("n", "dead") not in got and got[("n", "kept")] == ("base kept", None) and got[("m", "a")] == ("base a", None)
    assert ("n", "new") not in got and ("n", "odd") not in got and got[("n", "again")] == ("by 10", 10)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_sorted_histories(spark, seed):
    rnd = random.Random(seed)
    mem, recs, q = [], [], 0
    for e in range(40):
        clock, seq = {"x": 1}, 100 * e
        history = []
        for _ in range(rnd.randint(0, 9) if e else 150):  # entry 0 is hot
            clock = clock | {rnd.choice("xyz"): clock.get("x", 0) + 1 + rnd.randint(0, 2)}
            clock = {k: v + 1 for k, v in clock.items()}
            seq += rnd.randint(1, 3)
            history.append((rnd.choice(["insert", "update", "update", "delete"]), dict(clock), None if rnd.random() < 0.2 else (seq, f"h{seq}")))
        if rnd.random() < 0.7:
            where = rnd.randint(0, len(history))
            if where < len(history) and history[where][2]:
                mem.append(memory(f"e{e}", history[where][2][0], history[where][1], history[where][0] == "delete", hash_=history[where][2][1]))
            else:
                mem.append(memory(f"e{e}", 100 * e, {"x": 1}, rnd.random() < 0.3))
        for h in history:
            for _ in range(rnd.choice([1, 1, 2])):
                recs.append([h, f"e{e}"])
    rnd.shuffle(recs)
    rows = []
    for h, e in recs:
        q += 1
        rows += [record(q, e, rnd.choice([h[0], h[0].upper()]), h[1], h[2])] * rnd.choice([1, 1, 2])
    assert state(run(spark, mem, rows, 4)) == brute(mem, rows)


@pytest.mark.parametrize("seed", [4, 5])
def test_parts_in_any_order_give_what_the_whole_gives(spark, seed):
    rnd = random.Random(seed)
    mem, rows, q = [], [], 0
    for e in range(12):
        clock = {"x": 1}
        if rnd.random() < 0.6:
            mem.append(memory(f"e{e}", 50, clock, rnd.random() < 0.3))
        for k in range(rnd.randint(1, 7)):
            q += 1
            clock = {n: v + 1 for n, v in clock.items()} | {"y": k + 1}
            rows.append(record(q, f"e{e}", rnd.choice(["insert", "update", "delete"]), dict(clock), (51 + k, f"h{k}")))
    rnd.shuffle(rows)
    table = bootstrap(spark.createDataFrame(mem, MEM), rows_per_bucket=5)
    for part in (rows[::3], rows[1::3], rows[2::3], rows[::2]):
        table = apply_feed(table, spark.createDataFrame(part, QUEUE))
    assert {k: v[0] for k, v in state(table).items()} == {k: v[0] for k, v in brute(mem, rows).items()}


def test_untouched_buckets_keep_their_files_and_versions_stay(spark):
    mem = [memory(f"e{i}", 1, {}) for i in range(60)]
    base = bootstrap(spark.createDataFrame(mem, MEM), rows_per_bucket=3)
    after = apply_feed(base, spark.createDataFrame([record(1, "e7", "update", {"x": 1}, (2, "z"))], QUEUE))
    old, new = base.files(), after.files()
    assert sum(old[k] != new[k] for k in old) == 1 and after.manifest["version"] == 1
    assert state(base)[("n", "e7")] == ("base e7", None) and state(after)[("n", "e7")] == ("by 1", 1)
    assert BucketedTable.open(spark, base.root).manifest == after.manifest
    with pytest.raises(RuntimeError):
        apply_feed(base, spark.createDataFrame([], QUEUE))  # that version exists
    again = apply_feed(after, spark.createDataFrame([record(1, "e7", "update", {"x": 1}, (2, "z"))], QUEUE))
    assert {k: v[0] for k, v in state(again).items()} == {k: v[0] for k, v in state(after).items()}
    row = after.read().where("id = 'e7'").first()
    assert row["bucket"] == 7 and row["_bucket"] == "clash" and row["tags"] == ["t"] and row["vector_clock"] == {"x": 1} and row["importance"] == 0.9 and row["updated_at"] == dt.datetime(2024, 3, 1)


def test_only_touched_buckets_are_read(spark):
    mem = [memory(f"e{i}", 1, {}) for i in range(60)]
    base = bootstrap(spark.createDataFrame(mem, MEM), rows_per_bucket=3)
    feed = spark.createDataFrame([record(1, "e7", "update", {"x": 1}, (2, "z"))], QUEUE)
    spare = bootstrap(spark.createDataFrame(mem, MEM), rows_per_bucket=3)
    touched = next(k for k, f in apply_feed(spare, feed).files().items() if f != spare.files()[k])
    gone = [f for k, fs in base.files().items() if k != touched for f in fs]
    assert len(gone) >= 8
    for f in gone:
        os.remove(f.removeprefix("file:"))
    after = apply_feed(base, feed)  # would fail on any other bucket
    rows = spark.read.schema(after.schema).parquet(*after.files()[touched]).where("id = 'e7'").collect()
    assert [(r["content"], r[SET_BY]) for r in rows] == [("by 1", 1)]


def test_tasks_can_read_the_files_by_themselves(spark):
    table = bootstrap(spark.createDataFrame([memory(f"e{i}", i, {"x": i}) for i in range(40)], MEM), rows_per_bucket=3)
    cols = ["namespace", "id", "vector_clock", "updated_at", "tags"]
    as_sets = lambda df: {(r["namespace"], r["id"], str(r["vector_clock"]), r["updated_at"], str(r["tags"])) for r in df.collect()}
    assert as_sets(table.read(cols, many=1)) == as_sets(table.read().select(*cols)) and table.read(cols, many=1).count() == 40


def test_ring_free_ties_of_one_sync_seq(spark):
    """A dominates B, B has the greatest hash, C has the greatest total and is concurrent with A, whose hash is greater: A is latest."""
    a, b, c = ({"x": 2, "y": 1}, (5, "k2")), ({"x": 1, "y": 1}, (5, "k3")), ({"z": 9}, (5, "k1"))
    for order in itertools.permutations((a, b, c)):
        recs = [record(q, "e", "insert", clock, rev) for q, (clock, rev) in enumerate(order, 1)]
        table = run(spark, [], recs)
        assert state(table) == {("n", "e"): (f"by {1 + order.index(a)}", 1 + order.index(a))}


def test_queue_ids_of_zero_and_below(spark):
    got = state(run(spark, [memory("a", 1, {"x": 1})], [record(0, "a", "update", {"x": 2}, (2, "k")), record(-3, "b", "insert", {"x": 2}, (2, "k"))]))
    assert got == {("n", "a"): ("by 0", 0), ("n", "b"): ("by -3", -3)}


def test_a_task_reduces_hot_entries(monkeypatch):
    import pyarrow as pa

    kind = {"seq": pa.int64(), "hash": pa.string(), "clock": pa.map_(pa.string(), pa.int64()), "queue_id": pa.int64(), "op": pa.int32(), "importance": pa.float64(), "updated_at": pa.timestamp("us", "UTC")}
    rows = [{"namespace": "n", "id": "hot" if i % 3 else f"e{i}", "op": i % 4, "seq": i, "hash": f"h{i}", "clock": [("x", i)], "queue_id": 10_000 - i, "content": None, "importance": None, "status": None, "updated_at": None} for i in range(3000)]
    schema = pa.schema([(c, kind.get(c, pa.string())) for c in rows[0]])
    monkeypatch.setattr(changefeed, "HELD_ROWS", 500)
    out = pa.Table.from_batches(list(changefeed._reduced(iter(pa.Table.from_pylist(rows, schema).to_batches(100)))), schema=schema).to_pylist()
    assert {(r["id"], r["op"]) for r in out} == {(r["id"], r["op"]) for r in rows} and len(out) < 1100
    assert max(r["seq"] for r in out if r["id"] == "hot") == 2999


def test_empty(spark):
    t = bootstrap(spark.createDataFrame([], MEM), new_path(spark, "empty"))
    assert t.read().collect() == []
    t = apply_feed(t, spark.createDataFrame([], QUEUE))
    assert t.read().collect() == []
    t = apply_feed(t, spark.createDataFrame([record(2, "a", "insert", {"x": 1}), (3, None, None, None, None, None, None, None, None, None), (4, "n", "b", "insert", "not json", None, None, None, None, None)], QUEUE))
    assert set(state(t)) == {("n", "a"), ("n", "b")}
