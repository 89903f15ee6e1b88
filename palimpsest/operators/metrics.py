"""Evaluation metrics over ranked results."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import wilson
from .order import positions


def reliability(df: DataFrame, probability: str, correct: str, bins: int = 10) -> tuple[DataFrame, DataFrame]:
    """Per bin (the last closed at 1) n, mean probability, accuracy; and overall ECE, Brier score and RMSE."""
    p, y = F.col(probability), F.col(correct).cast("double")
    b = F.least(F.floor(p * bins), F.lit(bins - 1)).cast("bigint")
    per = df.select(b.alias("bin"), p.alias("p"), y.alias("y")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("confidence"), F.avg("y").alias("accuracy"), F.sum((F.col("p") - F.col("y")) ** 2).alias("sq"))
    total = per.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n")).alias("ece"), (F.sum("sq") / F.sum("n")).alias("brier")).withColumn("rmse", F.sqrt("brier"))
    return per.drop("sq"), total


def ranking_metrics(ranking: DataFrame, relevant: DataFrame, keys: list[str], k: int = 10) -> DataFrame:
    """Per query: precision (of the rows returned), recall, reciprocal rank, nDCG, hit and completeness at k.

    ``relevant`` has query_id and keys; queries without relevant rows give none.
    """
    top = ranking.where(F.col("rk") <= k).select("query_id", *keys, "rk")
    gold = relevant.select("query_id", *keys).distinct()
    hits = top.join(gold.withColumn("gold", F.lit(1)), ["query_id", *keys], "left").withColumn("gain", F.coalesce("gold", F.lit(0)))
    gain = F.col("gain") / F.log2(F.col("rk") + 1)
    per = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("returned"), F.sum("gain").alias("found"), F.sum(gain).alias("dcg"), F.max(F.when(F.col("gain") == 1, 1.0 / F.col("rk"))).alias("rr"))
    n = gold.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_gold"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_gold", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1))
    j = n.join(per, "query_id", "left").fillna(0, ["returned", "found", "dcg", "rr"])
    return j.select(
        "query_id", F.coalesce(F.try_divide(F.col("found"), F.col("returned")), F.lit(0.0)).alias("precision"), (F.col("found") / F.col("n_gold")).alias("recall"), F.col("rr").alias("rr"), (F.col("dcg") / ideal).alias("ndcg"),
        (F.col("found") > 0).cast("int").alias("hit"), (F.col("found") == F.col("n_gold")).cast("int").alias("complete"),
    )


def summary(per_query: DataFrame, task: str) -> DataFrame:
    """Means per task and over ALL, with the Wilson interval of the hit rate."""
    m = per_query.rollup(task).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in ("precision", "recall", "rr", "ndcg", "hit", "complete")], F.sum("hit").alias("hits"))
    lo, hi = wilson(F.col("hits").cast("double"), F.col("n").cast("double"))
    return m.withColumn("hit_low", lo).withColumn("hit_high", hi).withColumn(task, F.coalesce(F.col(task).cast("string"), F.lit("ALL"))).drop("hits")


def order_accuracy(ranking: DataFrame, successors: DataFrame) -> DataFrame:
    """Share of (newer, older) pairs of one query with the newer ranked above; unranked rows come last."""
    r = ranking.select("query_id", "id", "rk")
    j = successors.join(r.toDF("query_id", "newer", "rn"), ["query_id", "newer"], "left").join(r.toDF("query_id", "older", "ro"), ["query_id", "older"], "left").where("rn IS NOT NULL OR ro IS NOT NULL")
    ok = F.coalesce("rn", F.lit(2**31 - 1)) < F.coalesce("ro", F.lit(2**31 - 1))
    return j.agg(F.count(F.lit(1)).alias("n"), F.avg(ok.cast("double")).alias("accuracy"))


def mcnemar(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Discordant counts and the exact two- and one-sided p of (a, b) flags."""
    n = pairs.agg(F.count_if(F.col(a) & ~F.col(b)).alias("only_a"), F.count_if(~F.col(a) & F.col(b)).alias("only_b"))

    @F.udf("struct<two:double,one:double>")
    def exact(x, y):
        m = x + y
        if m == 0:
            return 1.0, 1.0
        tail = sum(math.exp(math.lgamma(m + 1) - math.lgamma(i + 1) - math.lgamma(m - i + 1) - m * math.log(2)) for i in range(min(x, y) + 1))
        one = sum(math.exp(math.lgamma(m + 1) - math.lgamma(i + 1) - math.lgamma(m - i + 1) - m * math.log(2)) for i in range(x + 1))
        return min(1.0, 2 * tail), min(1.0, one)

    return n.withColumn("p", exact("only_a", "only_b")).select("only_a", "only_b", F.col("p.two").alias("p_two_sided"), F.col("p.one").alias("p_one_sided"))


def nearest_rank(df: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Percentiles by index floor(n * p) of the sorted values (the last at most), and the median.

    Values get their place by range partitions, whatever the number of groups; only the picked ones are read.
    Null values and groups do not count.
    """
    live = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*group, value])).select(*group, value)
    placed = positions(live.withColumn("_t", F.monotonically_increasing_id()), [*group, value, "_t"], "_i")  # _t: equal values may part
    sizes = placed.groupBy(*group).agg(F.min("_i").alias("_first"), F.count(F.lit(1)).alias("_n"))
    at = F.col("_i") - F.col("_first")
    picks = [F.max(F.when(at == F.least(F.floor(F.col("_n") * p), F.col("_n") - 1), F.col(value))).alias(name) for name, p in shares.items()]
    middle = F.avg(F.when((at == F.floor((F.col("_n") - 1) / 2)) | (at == F.floor(F.col("_n") / 2)), F.col(value))).alias("median")
    return placed.join(sizes, group).groupBy(*group).agg(*picks, middle)


def paired_differences(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mean, median, spread and t statistic of a - b, and the counts of better, worse and equal pairs."""
    d = df.select((F.col(a) - F.col(b)).alias("d")).where("d IS NOT NULL")
    out = d.agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean"), F.percentile("d", 0.5).alias("median"), F.stddev_samp("d").alias("sd"), F.count_if(F.col("d") > 0).alias("better"), F.count_if(F.col("d") < 0).alias("worse"), F.count_if(F.col("d") == 0).alias("equal"))
    return out.withColumn("t", F.try_divide(F.col("mean") * F.sqrt("n"), F.col("sd")))
