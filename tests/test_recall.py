from pyspark.sql import functions as F

from palimpsest.functions import scoring
from palimpsest.functions import text as tx
from palimpsest.operators import recall


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def asked(spark, *rows):
    return spark.createDataFrame(list(rows), "query_id int, namespace string, text string")


ENTRY = "namespace string, id string, content string, detail string, tags array<string>, status string, updated_at timestamp"


def entries(spark, *rows):
    return spark.createDataFrame([(*r, None) for r in rows], ENTRY).withColumn("updated_at", F.timestamp_seconds(F.substring("id", 2, 9).cast("int")))


def test_phrases(spark):
    assert one(spark, recall.query_phrases(F.lit("Fix src/auth/session.py, FIX -- the"))) == ["fix", "src auth session py", "the"]
    assert one(spark, recall.query_phrases(F.lit('"two words"'))) == ["two words"] and one(spark, recall.query_phrases(F.lit(""))) == []


def test_text_candidates_and_pool(spark):
    e = entries(spark, ("n", "e1", "the auth session py file", None, None, "active"), ("n", "e2", "session of auth", "", [], "active"), ("n", "e3", "nothing", None, ["auth-x"], "archived"), ("m", "e4", "auth", None, None, "active"), ("n", "e5", "new", None, None, "active"))
    q = asked(spark, (1, "n", "auth/session.py auth"), (2, "m", "none"), (3, "n", None))
    got = {(r["query_id"], r["id"], r["matched"]) for r in recall.text_candidates(q, e).collect()}
    assert got == {(1, "e1", 2), (1, "e2", 1), (1, "e3", 1)}
    pool = {(r["query_id"], r["id"], r["list_no"]) for r in recall.candidate_pool(q, e, 0, 2, 50).collect()}
    assert pool == {(1, "e5", 0), (1, "e3", 0), (1, "e1", 1), (1, "e2", 1), (2, "e4", 0), (3, "e5", 0), (3, "e3", 0)}


def test_first_wins(spark):
    a, b = (spark.createDataFrame(x, "k int, v string") for x in ([(1, "a"), (2, "a")], [(2, "b"), (3, "b"), (3, "b")]))
    assert {tuple(r) for r in recall.first_wins([a, b], ["k"]).select("k", "v").collect()} == {(1, "a"), (2, "a"), (3, "b")}


def test_bridge(spark):
    """A name of the best row leads to a row without any word of the query."""
    texts = {"s": "the outage was handled when Brambletwig called", "t": "Brambletwig owns the harvester module", "u": "outage notes", "v": "common filler text"} | {f"f{i}": f"common filler number{i}" for i in range(30)}
    docs = spark.createDataFrame([("n", k, v) for k, v in texts.items()], "namespace string, id string, content string")
    docs = docs.withColumn("tokens", tx.entry_tokens(F.col("content"), F.lit(None).cast("string"), F.array().cast("array<string>")))
    q = spark.createDataFrame([(0, "outage handled")], "query_id int, text string")
    from palimpsest.operators import ranking

    terms = q.select("query_id", tx.query_tokens(F.col("text")).alias("terms"))
    first = ranking.bm25(terms, docs, recall.KEY, 1)
    found = {r["term"]: r["weight"] for r in recall.bridge_terms(q, first, docs).collect()}
    assert set(found) == {"brambletwig", "cal"} and found["brambletwig"] > 0 and "outage" not in found
    assert [r["id"] for r in recall.bridge_hop(q, first, docs, terms).collect()] == ["t"]


def test_positional_scores_by_hand(spark):
    rows = [(0, "a", 1, 1, "unknown", 1.0, 0), (0, "g", 2, 4, "git_distilled", 0.75, 0), (0, "b", 3, 2, "semantic_memory", 0.9, 0), (0, "c", 4, 3, "unknown", 1.0, 0), (0, "h", 5, 5, "git_distilled", 0.75, 0), (0, "x", 6, 6, "lifecycle", 0.55, 2)]
    df = spark.createDataFrame(rows, "query_id int, id string, rk int, before int, family string, weight double, bucket int")
    got = {r["id"]: round(r["score"], 6) for r in recall.positional_scores(df).collect()}
    # g: own .25, raised to the best behind it (b .5 * .9), below a's 1; h: own .2, held under c's .3333
    assert got == {"a": 1.0, "g": 0.45, "b": 0.5, "c": 0.3333, "h": 0.2, "x": 0.1667}
    low = df.where("id <> 'g'").unionByName(spark.createDataFrame([(0, "g", 6, 1, "git_distilled", 0.75, 0)], df.schema))
    assert {r["id"]: round(r["score"], 4) for r in recall.positional_scores(low).collect()}["g"] == 0.2  # ranked behind h: h is the cap


def test_merges(spark):
    e = lambda *rows: spark.createDataFrame(list(rows), "namespace string, id string, content string")
    got = {(r["id"], r["fallback"]) for r in recall.merge_tiers(e(("n", "a", "x")), e(("n", "a", "y"), ("n", "b", "x"), ("n", "c", "z"), ("m", "d", "x"), ("n", "f", None))).collect()}
    assert got == {("a", False), ("c", True), ("d", True), ("f", True)}
    remote = spark.createDataFrame([("a", "q", 1), ("r1", " X ", 2), ("r2", "new", 3), (None, "other", 4)], "source_id string, content string, n int")
    assert {r["n"] for r in recall.without_known_shared(remote, e(("n", "a", "x"))).collect()} == {3, 4}
    near = spark.createDataFrame([("r2",)], "remote_id string")
    assert {r["n"] for r in recall.without_known_shared(remote.withColumn("remote_id", F.col("source_id")), e(("n", "a", "x")), near=near).collect()} == {4}


def test_final_merge_and_floor(spark):
    rows = [("q", "a", 0.9, 1.0, 0, False, False), ("q", "b", 0.5, 1.0, 0, False, True), ("q", "c", 0.9, 0.5, 2, False, True), ("q", "d", 0.6, 1.0, 0, True, True), ("q", "e", 0.25, 1.0, 0, False, True), ("q", "f", 0.4, 0.5, 0, False, True)]
    df = spark.createDataFrame(rows, "query_id string, id string, score double, weight double, bucket int, fallback boolean, eligible boolean")
    assert [r["id"] for r in recall.final_merge(df, ["id"], 0.3, 4).orderBy("rk").collect()] == ["b", "d", "c", "a"]


def test_rerank_keeps_the_order_without_a_scorer(spark):
    first = spark.createDataFrame([(0, "a", 3.0, 1, "t"), (0, "b", 2.0, 2, "t"), (0, "c", 1.0, 3, "t")], "query_id int, id string, score double, rk int, text string")
    passages = spark.createDataFrame([("a", "x"), ("b", "xx"), ("c", "xxx")], "id string, passage string")
    assert recall.reranked(first, passages, ["id"], None) is first
    out = recall.reranked(first, passages, ["id"], lambda q, p: F.length(p).cast("double"), 2)
    assert [r["id"] for r in out.orderBy("rk").collect()] == ["b", "a", "c"]


def test_small_texts(spark):
    assert [one(spark, tx.valid_namespace(F.lit(x))) for x in ("global", "project:a-b_1", "project:a b", " global", "team:", "x:y", "global\n", "user:" + "u" * 200)] == [True, True, False, False, False, False, False, False]
    assert one(spark, tx.namespace_path(F.lit("project:repo-a"))) == "project/repo-a" and one(spark, tx.namespace_path(F.lit("no way"))) is None
    assert [one(spark, tx.project_slug(F.lit(x))) for x in ("/home/me/My Repo!", "/", "/x/--A--b--/", "/a/" + "z" * 40)] == ["my-repo", "root", "a-b", "z" * 32]
    assert one(spark, tx.slug_of(F.lit("project:my-repo-12ab"))) == "my-repo" and one(spark, tx.slug_of(F.lit("team:a-b"))) is None
    assert one(spark, tx.passage(F.lit("c"), F.lit(""), F.array(F.lit("t"), F.lit("u")), 4)) == "c t "
    assert [one(spark, scoring.calibrated_threshold(F.lit(x))) for x in (0.60, 0.75, 0.80, 0.92, 0.95, 1.5)] == [0.803, 0.89, 0.89, 0.955, 0.98, 1.5]
