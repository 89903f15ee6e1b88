import pytest
from pyspark.sql import functions as F

from palimpsest.functions import scoring, temporal
from palimpsest.functions import text as tx


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_stems(spark):
    pairs = dict(zip("agencies process boxes churches houses researched stopped running quickly string using v2 bus buses movies falling supposedly".split(), "agency process box church house research stop run quick string using v2 bus buse movy fal suppos".split()))
    rows = spark.createDataFrame([(k,) for k in pairs], "w string").select("w", tx.stem(F.col("w")).alias("s")).collect()
    assert {r["w"]: r["s"] for r in rows} == pairs


def test_entry_tokens(spark):
    got = one(spark, tx.entry_tokens(F.lit("hybridSearch test."), F.lit("favourite_language na\u00efve"), F.array(F.lit("pydantic-v2"))))
    assert got == ["hybrid", "search", "test", "favourite_language", "favourite", "language", "na\u00efve", "pydantic-v2", "pydantic", "v2"]
    assert one(spark, tx.entry_tokens(F.lit(None).cast("string"), F.lit(""), F.lit(None).cast("array<string>"))) == []


def test_query_tokens(spark):
    assert one(spark, tx.query_tokens(F.lit("What did we research about retry-policy?"))) == ["research", "retry-policy", "retry", "policy"]
    assert one(spark, tx.query_tokens(F.lit("what did we do"))) == ["what", "did", "we", "do"]
    assert len(one(spark, tx.query_tokens(F.lit(" ".join(f"w{i}" for i in range(100)))))) == 64
    assert one(spark, tx.lexical_query(F.lit("How does hybridSearch do it"))) == ["hybrid", "search"]


def test_small_text_functions(spark):
    assert one(spark, tx.anchor_file(F.lit("./src\\a/./b.py"))) == "src/a/b.py"
    for bad in ("/abs", "", ".", "a/../b", "C:\\x"):
        assert one(spark, tx.anchor_file(F.lit(bad))) is None
    assert one(spark, tx.derived_parent(F.lit("M-1#hype12"))) == "M-1" and one(spark, tx.derived_parent(F.lit("M-1#hype"))) is None
    assert one(spark, tx.shannon_entropy(F.lit("aabb"))) == pytest.approx(1) and one(spark, tx.shannon_entropy(F.lit("abcdefgh"))) == pytest.approx(3)
    assert [one(spark, tx.token_cost(F.lit("w " * n))) for n in (1, 2, 5, 15, 25, 35)] == [1, 3, 6, 20, 32, 46]
    line = one(spark, tx.short_line(F.lit("word " * 30)))
    assert len(line) <= 80 and line.endswith("\u2026") and one(spark, tx.short_line(F.lit("short"))) == "short"


def test_scores(spark):
    u = lambda d, r, i, hl=14.0, a=0, s="agent": one(spark, scoring.utility(F.lit(d), F.lit(r), F.lit(i), F.lit(hl), F.lit(a), F.lit(s)))
    assert u(14, 1, 0.8) == pytest.approx(0.4) and u(14, 3, 0.8) == pytest.approx(0.558949577) and u(30, 2, 0.5, 90.0, 5, "human") == pytest.approx(0.618895096)
    assert one(spark, scoring.recall_decay(F.lit(0.8), F.lit(3))) == pytest.approx(0.6859) and one(spark, scoring.recall_decay(F.lit(0.8), F.lit(40))) == pytest.approx(0.4)
    assert [one(spark, scoring.recency(F.lit(float(d)))) for d in (0, 14, 90)] == pytest.approx([1, 0.5, 0.011609330])
    assert one(spark, scoring.tier_composite(F.lit(0.5), F.lit(7.0), F.lit(0.9))) == pytest.approx(0.682132034)
    assert one(spark, scoring.decayed_importance(F.lit(0.05))) == 0 and one(spark, scoring.boosted_importance(F.lit(0.98))) == 1
    assert one(spark, scoring.half_life(F.lit("incident"), F.lit("unverified"))) == 9999 and one(spark, scoring.half_life(F.lit("decision"), F.lit("low"))) == 14
    lo, hi = scoring.wilson(F.lit(8.0), F.lit(16.0))
    assert one(spark, lo) == pytest.approx(0.28, abs=1e-3) and one(spark, hi) == pytest.approx(0.72, abs=1e-3)
    assert one(spark, scoring.piecewise_linear(F.lit(0.75), [(0.5, 0.0), (1.0, 1.0)])) == 0.5


def test_temporal(spark):
    sure = lambda q: one(spark, temporal.confidence(F.lit(q)))
    assert sure("latest news") == 0.9 and sure("what we did last week recently") == 0.95 and sure("how to bake") == 0
    assert [one(spark, temporal.recency_weight(F.lit(c))) for c in (0.5, 0.6, 0.75, 0.9, 0.95)] == [0, 0.133, 0.333, 0.533, 0.6]
    rewrite = lambda q: one(spark, temporal.rewrite(F.lit(q)))
    assert rewrite("latest guidance on retry policy") == "retry policy" and rewrite("what broke two weeks ago in ci") == "what broke in ci" and rewrite("plain query") == "plain query"
    assert rewrite("latest") == "latest" and one(spark, temporal.signals(F.lit("last tuesday"))) == ["temporal_arithmetic"]
