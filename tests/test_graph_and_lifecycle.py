import itertools
import random

from palimpsest.operators import graph, lifecycle, listing, vectors
from palimpsest.plans import lifecycle as plans


def edges(spark, rows):
    return spark.createDataFrame([(i, "n", a, b, t, w) for i, (a, b, t, w) in enumerate(rows)], "id bigint, namespace string, source_id string, target_id string, edge_type string, weight double")


def test_bfs_keeps_first_visit(spark):
    e = edges(spark, [("a", "b", "z", 1.0), ("a", "c", "y", 1.0), ("b", "d", "x", 1.0), ("c", "d", "w", 1.0), ("d", "a", "x", 1.0), ("d", "e", "x", 1.0), ("e", "f", "x", 1.0), ("a", "b", "k", 0.5)])
    roots = spark.createDataFrame([("n", "a")], "namespace string, root string")
    got = {r["node"]: (r["depth"], r["edge_type"]) for r in graph.bfs(e, roots, 3).collect()}
    assert got == {"b": (1, "k"), "c": (1, "y"), "d": (2, "w"), "e": (3, "x")}
    alive = spark.createDataFrame([("n", "b"), ("n", "d")], "namespace string, id string")
    assert {r["node"] for r in graph.bfs(e, roots, 2, ["z", "x"], alive).collect()} == {"b", "d"}


def test_propagation(spark):
    e = edges(spark, [("a", "b", "evidence_for", 1.0), ("b", "c", "co_anchored", 0.5), ("a", "d", "similarity", 1.0)])
    up = {r["id"]: round(r["delta"], 9) for r in graph.propagate(e, spark.createDataFrame([("n", "a", 1.0)], "namespace string, id string, delta double")).collect()}
    down = {r["id"]: round(r["delta"], 9) for r in graph.propagate(e, spark.createDataFrame([("n", "a", -1.0)], "namespace string, id string, delta double")).collect()}
    assert up == {"b": 0.3, "c": 0.03} and down == {"b": -0.15, "c": -0.0075}


def test_conflicts(spark):
    e = edges(spark, [("a", "b", "conflicts_with", 1.0), ("c", "a", "conflicts_with", 1.0)])
    r = spark.createDataFrame([(0, "n", "a", 0.5), (0, "n", "b", 0.4), (0, "n", "c", 0.5)], "query_id int, namespace string, id string, importance double")
    assert {x["id"] for x in graph.conflict_losers(e, r).collect()} == {"b"}


def dense(spark, pairs, **kw):
    rows = graph.dense_clusters(edges(spark, [(a, b, "related_to", 0.7) for a, b in pairs]), **kw).collect()
    out = {}
    for r in rows:
        out.setdefault((r["cluster"], r["connectivity"]), set()).add(r["id"])
    return out


def test_dense_clusters_by_hand(spark):
    n = [f"n{i}" for i in range(6)]
    every = [(a, b) for a in n for b in n if a < b]
    # the first twelve pairs of six: n0..n2 reach all, n3-n4, n3-n5 and n4-n5 are missing; all six at 12 of 15 edges
    assert dense(spark, every[:12] + [(b, a) for a, b in every[:12]]) == {(0, 0.8): set(n)}
    assert dense(spark, [("s0", "s1"), ("s1", "s0"), ("s2", "s3"), ("s3", "s2")]) == {}
    five = [(a, b) for a in n[:5] for b in n[:5] if a < b]
    assert dense(spark, five) == {(0, 1.0): set(n[:5])}
    # only the seed's neighbours are candidates: x has two edges into the clique but none to the seed n0
    assert dense(spark, [*five, ("n1", "x"), ("n2", "x"), ("n0", "y"), ("n0", "z")]) == {(0, 0.7333): {*n[:5], "y"}}
    # density of the whole group decides: with the clique first, y (one edge of six) leaves 11 / 15 >= .6, z then 12 / 21 < .6
    assert dense(spark, [*five, ("n0", "y"), ("n0", "z")]) == {(0, 0.7333): {*n[:5], "y"}}
    # members of a group are taken, those of too small ones stay free
    star = [("h", f"l{i}") for i in range(9)]
    assert dense(spark, star) == {} and dense(spark, [*star, *five]) == {(0, 1.0): set(n[:5])}
    # ends in no order, repeated, null, empty, loops
    odd = spark.createDataFrame([("n", "a", None), ("n", "", "b"), (None, "a", "b")] + [("n", b, a) for a, b in five * 2], "namespace string, source_id string, target_id string")
    assert {r["id"] for r in graph.dense_clusters(odd).collect()} == set(n[:5])


def test_cluster_domains(spark):
    c = spark.createDataFrame([("n", 0, x, 1.0) for x in "abc"] + [("n", 1, "d", 0.7)], "namespace string, cluster bigint, id string, connectivity double")
    e = spark.createDataFrame([("n", "a", ["x", "y"]), ("n", "b", ["y", "x"]), ("n", "c", ["z"]), ("n", "d", None)], "namespace string, id string, tags array<string>")
    assert {(r["cluster"], r["size"], r["domain"]) for r in graph.cluster_domains(c, e).collect()} == {(0, 3, "x"), (1, 1, "cluster-1")}


def test_dense_clusters_of_all_edge_types(spark, tmp_path):
    types = ["similarity", "related_to", "tag_cooccurrence", "supersedes", "co_anchored"]
    pairs = [(x, y) for x in "abcde" for y in "abcde" if x < y]
    rows = [(*p, types[i % 5], 1.0 if i % 2 else None) for i, p in enumerate(pairs)] + [("s", "t", "similarity", 1.0)]
    edges(spark, rows).write.parquet(str(tmp_path / "memory_graph_edges.parquet"))
    spark.createDataFrame([("n", "a", 1, ["tag"])], "namespace string, id string, updated_at bigint, tags array<string>").write.parquet(str(tmp_path / "memories.parquet"))
    assert {(r["cluster"], r["id"], r["domain"]) for r in plans.g8_dense_clusters(spark, str(tmp_path)).collect()} == {(0, x, "tag") for x in "abcde"}


def test_canaries_get_no_edges(spark):
    e = edges(spark, [("a", "b", "x", 1.0), ("c", "a", "x", 1.0), ("b", "c", "x", 1.0)])
    assert [(r["source_id"], r["target_id"]) for r in graph.without_canaries(e, spark.createDataFrame([("n", "a"), ("m", "b")], "namespace string, id string")).collect()] == [("b", "c")]


def test_cross_validation_once_a_project(spark):
    rows = spark.createDataFrame([(1, "p", 0.5, None), (2, "q", 0.98, ["cross_validated:project_id=p:similarity=0.9300"]), (3, "q", 0.5, []), (4, "p", 0.5, [])], "row_id bigint, project string, importance double, history array<string>")
    pairs = spark.createDataFrame([(1, 2, 0.95), (1, 3, 0.97), (2, 3, 0.99), (2, 4, 0.96)], "a bigint, b bigint, score double")
    events, boosted = graph.cross_validations(pairs, rows)
    assert {(r["row_id"], r["event"]) for r in events.collect()} == {(1, "cross_validated:project_id=q:similarity=0.9700"), (3, "cross_validated:project_id=p:similarity=0.9700"), (4, "cross_validated:project_id=q:similarity=0.9600")}
    assert {(r["row_id"], round(r["importance"], 6), len(r["history"])) for r in boosted.collect()} == {(1, 0.55, 1), (3, 0.55, 1), (4, 0.55, 1)}


def test_tag_pairs_skip_hubs(spark):
    rows = [("n", t, e) for e, ts in {"a": "xyh", "b": "xyh", "c": "xh", "d": "yh"}.items() for t in ts]
    t = spark.createDataFrame(rows + rows[:2], "namespace string, tag string, entry_id string")
    got = [(r["a"], r["b"], r["shared"], r["weight"]) for r in graph.tag_pairs(t, 2, 3).collect()]
    assert got == [("a", "b", 2, 0.5)]  # all tags of both count below, hubs too


def test_shared_files_keep_popular_files(spark):
    rows = [("n", "popular", f"e{i:03}") for i in range(501)] + [("n", "few", "e003"), ("n", "few", "e007"), ("m", "popular", "e003"), ("n", "popular", "e003"), ("n", None, "e003"), (None, "few", "e003")]
    p = spark.createDataFrame(rows, "namespace string, file string, entry_id string")
    assert graph.shared_files(p, 1).count() == 501 * 500 // 2
    assert [tuple(r) for r in graph.shared_files(p, 2).collect()] == [("n", "e003", "e007", 2)]


def test_shared_files_match_brute_force(spark):
    rnd = random.Random(6)
    held = {f"e{i:02}": {rnd.choice(["hot", "hot", *map(str, range(12))]) for _ in range(rnd.randint(1, 9))} for i in range(60)}
    p = spark.createDataFrame([("n", f, e) for e, fs in held.items() for f in fs], "namespace string, file string, entry_id string")
    for least in (1, 2, 3, 4):
        want = {("n", a, b, len(held[a] & held[b])) for a in held for b in held if a < b and len(held[a] & held[b]) >= least}
        for side in (3, 500):
            got = [tuple(r) for r in graph.shared_files(p, least, side).collect()]
            assert len(got) == len(want) and set(got) == want


def test_co_anchored_limits_every_entry(spark):
    rows = [("n", "big", f"e{i:03}") for i in range(40)] + [("n", "small", f"e{i:03}") for i in (1, 39)] + [("n", "exact", f"x{i}") for i in range(6)]
    edges_, left = graph.co_anchored(spark.createDataFrame(rows, "namespace string, file string, entry_id string"), 5)
    got = {}
    for r in edges_.collect():
        got.setdefault(r["source_id"], []).append(r["target_id"])
    first = [f"e{i:03}" for i in range(6)]
    want = {f"e{i:03}": [x for x in first if x != f"e{i:03}"][:5] for i in range(40)}
    want["e001"], want["e039"] = [*want["e001"], "e039"], want["e039"]  # e001 is among the five already
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()} | {f"x{i}": [f"x{j}" for j in range(6) if j != i] for i in range(6)}
    assert [(r["file"], r["entries"], r["left_out"]) for r in left.collect()] == [("big", 40, 40 * 34)]


def test_greedy_dedup_is_ordered(spark):
    pairs = spark.createDataFrame([("g", 1, 2), ("g", 2, 3), ("g", 3, 4), ("g", 1, 5), ("g", 4, 6), ("h", 7, 8)], "namespace string, a bigint, b bigint")
    assert {(r["id"], r["into"]) for r in lifecycle.greedy_dedup(pairs).collect()} == {(2, 1), (4, 3), (5, 1), (8, 7)}
    assert lifecycle.greedy_dedup(pairs.limit(0)).collect() == []


def test_complete_linkage(spark):
    link = lambda text, n=3: {(r["cluster"], r["id"]) for r in lifecycle.complete_linkage(spark.createDataFrame([("g", ord(a), ord(b)) for a, b in text.split()], "g string, a bigint, b bigint"), "g", n).collect()}
    c = lambda *groups: {(i, ord(x)) for i, g in enumerate(groups) for x in g}
    assert link("ab bc ac cd de ce", 2) == c("abc", "de") and link("ab bc ac cd de ce") == c("abc")
    # the first pair decides: b goes to a, so b, c, d never meet whole
    assert link("ab bc bd cd", 2) == c("ab", "cd") and link("ab ab ba") == set()
    rnd = random.Random(1)
    names = "abcdefghij"
    for _ in range(3):
        near = {(x, y) for x in names for y in names if x < y and rnd.random() < 0.6}
        of = {x: {x} for x in names}
        for x, y in sorted(near):
            if of[x] is not of[y] and all(tuple(sorted(p)) in near for p in itertools.product(of[x], of[y])):
                both = of[x] | of[y]
                for z in both:
                    of[z] = both
        want = sorted({tuple(sorted(v)) for v in of.values() if len(v) >= 3})
        assert link(" ".join(x + y for x, y in near)) == c(*want)
    assert vectors.unit_rows([[3.0, 4.0], [0.0, 0.0]]).tolist() == [[0.6, 0.8], [0.0, 0.0]]


def test_upsert_update_delete(spark):
    base = spark.createDataFrame([("n", "a", 1, "x"), ("n", "b", 1, "y")], "namespace string, id string, v int, w string")
    batch = spark.createDataFrame([("n", "a", 2, "p", 1), ("n", "a", 3, "q", 2), ("n", "c", 9, "r", 3)], "namespace string, id string, v int, w string, pos int")
    assert {(r["id"], r["v"]) for r in listing.upsert(base, batch, "pos").collect()} == {("a", 3), ("b", 1), ("c", 9)}
    side = spark.createDataFrame([("n", "t", "a"), ("n", "t", "b")], "namespace string, tag string, entry_id string")
    e = edges(spark, [("a", "b", "x", 1.0), ("b", "c", "x", 1.0)])
    left = listing.delete_cascade(base.where("id = 'a'"), base, side, side, e)
    assert {k: v.count() for k, v in left.items()} == {"entries": 1, "tags": 1, "anchors": 1, "edges": 1}


def test_namespace_moves(spark):
    df = spark.createDataFrame([("s", "1"), ("s", "2"), ("d", "2")], "namespace string, id string")
    assert {tuple(r) for r in listing.move_namespace(df, "s", "d", True).collect()} == {("d", "1"), ("s", "2"), ("d", "2")}
    try:
        listing.move_namespace(df, "s", "d", False)
        raise AssertionError
    except ValueError:
        pass
