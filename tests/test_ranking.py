import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import policy, ranking, vectors


def docs(spark, texts):
    return spark.createDataFrame([(k, v.split()) for k, v in texts.items()], "id string, tokens array<string>")


def queries(spark, *texts):
    return spark.createDataFrame([(i, t.split()) for i, t in enumerate(texts)], "query_id int, terms array<string>")


CORPUS = {"a": "cat sat mat", "b": "cat cat dog", "c": "dog log fog bog", "d": "bird"}


def test_bm25_by_hand(spark):
    out = ranking.bm25(queries(spark, "mat", "bird fog", "cat", "nothing"), docs(spark, CORPUS), ["id"]).collect()
    got = {(r["query_id"], r["id"]): r["score"] for r in out}
    assert got == {(0, "a"): pytest.approx(0.813998, abs=1e-6), (1, "d"): pytest.approx(1.187296, abs=1e-6), (1, "c"): pytest.approx(0.703417, abs=1e-6), (2, "b"): 0.5, (2, "a"): pytest.approx(1 / 3)}
    top = ranking.bm25(queries(spark, "dog cat"), docs(spark, CORPUS), ["id"], 1).collect()
    assert len(top) == 1


def test_negative_idf_falls_back_to_overlap(spark):
    out = ranking.bm25(queries(spark, "x", "y"), docs(spark, {"1": "x y", "2": "x z", "3": "x w"}), ["id"]).collect()
    assert {(r["query_id"], r["id"], round(r["score"], 3)) for r in out if r["query_id"] == 0} == {(0, "1", 0.5), (0, "2", 0.5), (0, "3", 0.5)}
    assert [r["rk"] for r in out if r["query_id"] == 0] == [1, 2, 3]


def lists(spark, rows):
    return spark.createDataFrame(rows, "query_id int, list_no int, id string, score double, rk int")


def test_fusion_by_hand(spark):
    rows = [(0, 0, "a", 9.0, 1), (0, 0, "b", 8.0, 2), (0, 1, "c", 1.0, 1), (0, 1, "a", 0.5, 2), (0, 1, "d", 0.5, 3)]
    got = {r["id"]: (r["score"], r["rk"]) for r in ranking.rrf(lists(spark, rows), ["id"]).collect()}
    assert got["a"] == (pytest.approx(0.309523810), 1) and got["c"][0] == pytest.approx(1 / 6) and got["b"][0] == pytest.approx(1 / 7) and [got[x][1] for x in "acbd"] == [1, 2, 3, 4]
    tied = {r["id"]: r["score"] for r in ranking.rrf(lists(spark, rows), ["id"], 0, True).collect()}
    assert tied["d"] == pytest.approx(1 / 7)
    best = {r["id"]: r["score"] for r in ranking.combmax(lists(spark, rows), ["id"], 5).collect()}
    assert best["a"] == pytest.approx(1 / 6)


def test_recency_blend_keeps_all(spark):
    fused = spark.createDataFrame([(0, "a", 2.0, 1), (0, "b", 1.0, 2)], "query_id int, id string, score double, rk int")
    recent = spark.createDataFrame([("c", 1.0), ("b", 0.5), ("a", 0.0), ("d", 0.75), ("e", 0.75)], "id string, score double")
    got = lambda k: [(r["id"], round(r["score"], 6)) for r in ranking.blend_recency(fused, recent, ["id"], 0.4, k).orderBy("rk").collect()]
    assert got(5) == [("a", 0.6), ("b", 0.5), ("c", 0.4), ("d", 0.3), ("e", 0.3)] and got(3) == got(5)[:3]
    alone = spark.createDataFrame([(0,), (7,)], "query_id int")
    more = ranking.blend_recency(fused, recent, ["id"], 0.4, 2, alone).where("query_id = 7").orderBy("rk").collect()
    assert [(r["id"], round(r["score"], 6)) for r in more] == [("c", 0.4), ("d", 0.3)]
    assert ranking.blend_recency(fused.limit(0), recent, ["id"], 0.4, 2).collect() == []


def test_blocks_and_slices_change_nothing(spark):
    rnd = np.random.default_rng(7)
    words = [f"w{i}" for i in range(30)]
    texts = {f"d{i:03}": " ".join(rnd.choice(words, rnd.integers(0, 12))) for i in range(300)}
    d = docs(spark, texts).unionByName(spark.createDataFrame([("none", None)], "id string, tokens array<string>")).repartition(5)
    q = queries(spark, *[" ".join(rnd.choice([*words, "absent"], 5)) for _ in range(20)], "", "absent")
    rows = lambda **kw: {(r["query_id"], r["id"], round(r["score"], 6), r["rk"]) for r in ranking.bm25(q, d, ["id"], **kw).collect()}
    whole = rows(top_k=None)
    n, avgdl = 301, sum(len(t.split()) for t in texts.values()) / 301
    df = {w: sum(w in t.split() for t in texts.values()) for w in words}
    idf = {w: np.log(n - x + 0.5) - np.log(x + 0.5) for w, x in df.items()}
    for r in q.collect():
        want = {}
        for k, t in texts.items():
            own = t.split()
            s = sum(idf[w] * own.count(w) * 2.5 / (own.count(w) + 1.5 * (0.25 + 0.75 * len(own) / avgdl)) for w in r["terms"] if w in own)
            if s > 0:
                want[k] = s
        assert {k: s for i, k, s, _ in whole if i == r["query_id"]} == pytest.approx(want, abs=2e-6)
    top = {x for x in whole if x[3] <= 7}
    assert rows(top_k=7) == top == rows(top_k=7, query_terms=9, block_cells=64)


def test_budget_floor_and_ties(spark):
    r = spark.createDataFrame([(0, f"d{i}", 1.0 - i / 10, i + 1, c) for i, c in enumerate([50, 30, 40, 10])], "query_id int, id string, score double, rk int, cost int")
    assert [x["id"] for x in ranking.token_budget(r, 90).orderBy("rk").collect()] == ["d0", "d1"]
    assert [x["id"] for x in ranking.token_budget(r, 10).collect()] == ["d0"]
    assert ranking.rerank_floor(r.withColumn("score", F.lit(-9.0)).withColumn("rk", F.col("rk") + 3), 4).count() == 2
    u = r.withColumn("utility", F.col("rk") / 10.0).withColumn("score", F.lit(2.0))
    assert [x["id"] for x in ranking.utility_tiebreak(u, ["id"]).orderBy("rk").collect()] == ["d3", "d2", "d1", "d0"]


def test_half_open_windows(spark):
    e = spark.sql("SELECT TIMESTAMP '2024-01-01' valid_from, TIMESTAMP '2024-01-01' created_at, TIMESTAMP '2024-02-01' invalid_from")
    inside = lambda t: e.where(policy.in_force(F.expr(f"TIMESTAMP '{t}'"))).count()
    assert [inside(t) for t in ("2023-12-31", "2024-01-01", "2024-01-31", "2024-02-01")] == [0, 1, 1, 0] and e.where(policy.in_force(None)).count() == 0


def test_expiry(spark):
    now = F.expr("TIMESTAMP '2024-02-12 00:00:00'")
    out = lambda x: spark.range(1).select(policy.expired(F.lit(x).cast("string"), now).alias("x")).first()["x"]
    assert [out(x) for x in ("2024-02-12", "2024-02-11", "2024-02-11T23:59:59Z", "2024-02-12T00:00:00Z", "", None, "soon", "not a date at all")] == [False, True, True, False, False, False, False, False]


def test_vectors(spark, monkeypatch):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(300, 8))
    m[1] = m[0] * 2
    m[5] = 0
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(900, None), (901, [1.0])], "row_id bigint, vector array<double>").repartition(3)
    unit = vectors.unit_rows(list(m))
    cos = np.round(unit @ unit.T, 9)
    q = rows.where("row_id % 100 = 0 AND row_id < 900").withColumnRenamed("row_id", "query_id")
    got = {(r["query_id"], r["rk"]): r["row_id"] for r in vectors.nearest(q, rows, 5).collect()}
    for i in (0, 100, 200):
        order = sorted(range(300), key=lambda j: (-cos[i, j], j))[:5]
        assert [got[i, k + 1] for k in range(5)] == order
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if cos[i, j] > 0.6}
    for cells in (8 * 70, 1_000_000):
        pairs = vectors.similarity_join(rows, 0.6, slice_cells=cells, block_rows=20, pivots=7)
        found = [(r["a"], r["b"]) for r in pairs.collect()]
        assert set(found) == want and len(found) == len(want)
    sliced = {tuple(r) for r in vectors.nearest(q, rows, 5).collect()}
    monkeypatch.setattr(vectors, "MAX_QUERY_CELLS", 8)
    assert {tuple(r) for r in vectors.nearest(q, rows, 5).collect()} == sliced
    assert vectors.similarity_join(rows.limit(0), 0.5).collect() == [] and vectors.nearest(q.limit(0), rows, 3).collect() == []
