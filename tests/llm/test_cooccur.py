import itertools
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

cooccur = pytest.importorskip("palimpsest.llm.cooccur")


def brute(rows, least, lift):
    baskets = {}
    for b, t in rows:
        if b is not None and t and t.strip(" "):
            baskets.setdefault(b, set()).add(t.strip(" ").lower())
    one = Counter(t for s in baskets.values() for t in s)
    two = Counter(p for s in baskets.values() for p in itertools.combinations(sorted(s), 2))
    n = len(baskets)
    return {(a, b, k, one[a], one[b]) for (a, b), k in two.items() if k >= least and k * n >= lift * one[a] * one[b]}


@pytest.mark.parametrize("heavy", [1, 4, 256])
def test_matches_brute_force(spark, heavy):
    rnd = random.Random(5)
    vocabulary = ["all"] * 40 + [f"T{i}" for i in range(12)] * 3 + [f"r{i}" for i in range(60)]
    rows = []
    for b in range(300):
        picks = [rnd.choice(vocabulary) for _ in range(rnd.randint(1, 9))]
        picks += [f"r{b % 30}", f"x{b % 30}"] if b % 2 else []
        rows += [(f"b{b}", f" {t}" if rnd.random() < 0.2 else t) for t in picks]
    rows += [("b1", None), ("b1", "  "), (None, "all"), ("big", "all")] + [("big", f"r{i}") for i in range(60)]
    df = spark.createDataFrame([(b, t, "extra", 1) for b, t in rows], "basket string, tag string, item string, n int")
    out = cooccur.cooccurrence(df, ["basket"], "tag", least=3, lift=2.0, heavy=heavy).collect()
    got = {(r["item_a"], r["item_b"], r["n_both"], r["n_a"], r["n_b"]) for r in out}
    assert got == brute(rows, 3, 2.0)
    assert len(got) == len(out) > 10


@pytest.mark.parametrize("side", [2, 3, 7])
def test_large_baskets_in_chunks(spark, side):
    rnd = random.Random(9)
    rows = [(f"b{b}", f"t{i}") for b in range(14) for i in rnd.sample(range(40), rnd.randint(1, 30))] + [(f"b{b}", "all") for b in range(14)]
    df = spark.createDataFrame(rows, "basket string, tag string")
    for heavy in (1, 8):
        out = cooccur.cooccurrence(df, ["basket"], "tag", least=2, lift=0.5, heavy=heavy, side=side).collect()
        assert {(r["item_a"], r["item_b"], r["n_both"], r["n_a"], r["n_b"]) for r in out} == brute(rows, 2, 0.5) and len(out) > 300


def test_numbers_by_join_where_names_are_many(spark, monkeypatch):
    rows = [(f"b{b}", f"t{i}") for b in range(9) for i in range(b, 12)]
    df = spark.createDataFrame(rows, "basket string, tag string")
    monkeypatch.setattr(cooccur, "MOST_BYTES", 10)
    out = cooccur.cooccurrence(df, ["basket"], "tag", least=2, lift=1.0).collect()
    assert {(r["item_a"], r["item_b"], r["n_both"], r["n_a"], r["n_b"]) for r in out} == brute(rows, 2, 1.0)


def test_lifts_beyond_three_digits_and_fractions(spark):
    rows = [(f"b{b}", t) for b in range(2) for t in ("x", "y")] + [(f"c{b}", "z") for b in range(2998)]
    df = spark.createDataFrame(rows, "basket string, tag string")
    count = lambda lift: cooccur.cooccurrence(df, ["basket"], "tag", least=2, lift=lift).count()
    assert [count(x) for x in (1000, 1500.0, 1499.9, 1500.1, 2000.0)] == [1, 1, 1, 0, 0]


def test_one_basket_of_thousands(spark):
    n = 5000
    df = spark.range(n).selectExpr("'big' AS basket", "concat('t', id) AS tag")
    began = time.time()
    names = df.select("basket", "tag").unionByName(spark.range(n).selectExpr("concat('s', id) AS basket", "concat('t', id) AS tag"))
    codes = cooccur.written(spark.range(1).select(F.sequence(F.lit(0), F.lit(n - 1)).alias("codes")), "codes")
    parts = cooccur.pieces(codes, 0)
    assert parts.count() == 15 and parts.where("size(codes) > 1024 OR size(other) > 1024").count() == 0
    assert parts.mapInArrow(cooccur._count_pieces(0), "pair bigint, n bigint").agg(F.sum("n")).first()[0] == n * (n - 1) // 2
    assert cooccur.cooccurrence(names, ["basket"], "tag", least=3).collect() == []
    assert time.time() - began < 60


def test_empty(spark):
    df = spark.createDataFrame([], "basket string, tag string")
    assert cooccur.cooccurrence(df, ["basket"], "tag").collect() == []


def test_heavy_pairs_are_popcounts():
    bits = np.random.default_rng(1).random((7, 133)) < 0.4
    got = cooccur.heavy_pairs(bits)
    for i, j in itertools.combinations(range(7), 2):
        assert got[i, j] == (bits[i] & bits[j]).sum()
