"""Rankings.  Every ranking is a DataFrame (query_id, <keys>, score, rk); ``keys`` name the ranked row.

Queries are scored as a batch against blocks of documents where those are read: the query terms of one
slice of queries, with their weights, are broadcast after a check of their size, a task scores its
documents block by block and hands on ``top_k`` rows a query, so k x tasks rows a query are shuffled,
whatever the number of matches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scoring import fractional_days, recency
from ..sources.scratch import written

K1, B, EPSILON = 1.5, 0.75, 0.25
QUERY_TERMS = 500_000  # (query, term) pairs of one broadcast slice of queries, some 30 MB
BLOCK_CELLS = 4_000_000  # scores (queries x documents) held at once
EXPANDED = 8_000_000  # contributions added up at once


def ranked(scored: DataFrame, keys: Sequence[str], top_k: int | None = None, ties: Sequence[Column] = ()) -> DataFrame:
    """``rk`` by score, then ``ties``, then keys; the first ``top_k`` of each query (a group limit before the shuffle)."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), *ties, *keys)
    out = scored.withColumn("rk", F.row_number().over(w))
    return out.where(F.col("rk") <= top_k) if top_k else out


def bm25(queries: DataFrame, docs: DataFrame, keys: Sequence[str], top_k: int | None = 50, query_terms: int = QUERY_TERMS, block_cells: int = BLOCK_CELLS) -> DataFrame:
    """Okapi BM25 of ``queries`` (query_id, terms) over ``docs`` (keys, tokens); scores above 0 only.

    Repeated query terms count each time.  A negative idf becomes epsilon times the mean idf of the
    vocabulary.  If no row of a query scores above 0, rows are ranked by the Jaccard coefficient of the
    two term sets instead (a second pass for such queries only).  Empty queries and empty documents match
    nothing, null tokens are none.  ``top_k`` None keeps every match.
    """
    spark, keys = docs.sparkSession, list(keys)
    none = F.array().cast("array<string>")
    toks = written(docs.select(*keys, F.coalesce("tokens", none).alias("tokens")), "tokens")
    size = toks.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("tokens")).alias("avgdl")).first()
    asked = written(queries.select("query_id", F.size(F.array_distinct("terms")).alias("ql"), F.explode("terms").alias("term")).groupBy("query_id", "ql", "term").agg(F.count(F.lit(1)).alias("qtf")), "asked")
    kinds = {f.name: f for f in toks.schema.fields}
    schema = T.StructType([queries.schema["query_id"], *[kinds[k] for k in keys], T.StructField("score", T.DoubleType())])
    n_asked = asked.count() if size["n"] else 0
    if not n_asked:
        return ranked(spark.createDataFrame([], schema), keys, top_k)
    raw = F.log(F.lit(size["n"]) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    vocabulary = written(toks.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", raw.alias("raw")), "terms")
    mean = vocabulary.agg(F.avg("raw")).first()[0]
    idf = F.when(F.col("raw") < 0, F.lit(EPSILON * (mean or 0.0))).otherwise(F.col("raw"))
    slices = -(-n_asked // query_terms)
    found = []
    for i in range(slices):
        own = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == i) if slices > 1 else asked
        weighed = own.join(vocabulary.select("term", idf.alias("idf")), "term").toArrow()
        if not weighed.num_rows:
            continue
        best = written(_block_scores(toks, weighed, keys, top_k, size["avgdl"], schema, block_cells, False), "scores")
        found.append(best)
        answered = pa.array([r[0] for r in best.select("query_id").distinct().collect()], weighed["query_id"].type)
        silent = weighed.filter(pc.invert(pc.is_in(weighed["query_id"], value_set=answered)))
        if silent.num_rows:
            found.append(written(_block_scores(toks, silent, keys, top_k, size["avgdl"], schema, block_cells, True), "scores"))
    out = found[0] if found else spark.createDataFrame([], schema)
    for f in found[1:]:
        out = out.unionByName(f)
    return ranked(out, keys, top_k)


def _block_scores(toks: DataFrame, weighed: pa.Table, keys: list[str], top_k: int | None, avgdl: float, schema: T.StructType, block_cells: int, overlap: bool) -> DataFrame:
    """The ``top_k`` rows of each task for every query of ``weighed`` (query_id, ql, term, qtf, idf).

    A block of documents is a sparse matrix of term weights; its product with the queries' weights adds up
    one contribution for every (posting, query that has the term).  Rows below a query's k-th best so far
    leave at once.  ``overlap`` scores by the Jaccard coefficient of the term sets.
    """
    coded, asked = (weighed[c].combine_chunks().dictionary_encode() for c in ("term", "query_id"))
    order = np.argsort(coded.indices.to_numpy(), kind="stable")
    qi = asked.indices.to_numpy().astype(np.int64)
    ql = np.zeros(len(asked.dictionary))
    ql[qi] = weighed["ql"].to_numpy()
    start = np.searchsorted(coded.indices.to_numpy()[order], np.arange(len(coded.dictionary) + 1))
    weight = np.ones(len(order)) if overlap else (weighed["qtf"].to_numpy() * weighed["idf"].to_numpy())[order]
    shared = toks.sparkSession.sparkContext.broadcast((coded.dictionary, asked.dictionary, start, qi[order], weight, ql))

    def scores(tokens: pa.ListArray, terms: pa.Array, start, of_query, weight, ql) -> np.ndarray:
        n, nq = len(tokens), len(ql)
        dl = np.diff(tokens.offsets.to_numpy())
        flat, doc = tokens.flatten(), np.repeat(np.arange(n), dl)
        code = pc.index_in(flat, value_set=terms)
        hit = code.is_valid().to_numpy(zero_copy_only=False)
        pair, tf = np.unique(doc[hit] * len(terms) + code.filter(pa.array(hit)).to_numpy(), return_counts=True)
        doc, term = pair // len(terms), pair % len(terms)
        own = np.ones(len(pair)) if overlap else tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[doc] / avgdl))
        times = start[term + 1] - start[term]
        ends = np.cumsum(times)
        out = np.zeros(nq * n)
        for a, b in _stretches(ends, EXPANDED):
            t = times[a:b]
            p = np.repeat(np.arange(a, b), t)
            at = np.repeat(start[term[a:b]] - (ends[a:b] - t), t) + np.arange(ends[a] - times[a], ends[b - 1])
            out += np.bincount(of_query[at] * n + doc[p], weights=weight[at] * own[p], minlength=nq * n)
        out = out.reshape(nq, n)
        if overlap:
            every = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
            ds = np.bincount(np.unique(np.repeat(np.arange(n), dl) * (1 + int(every.max(initial=0))) + every) // (1 + int(every.max(initial=0))), minlength=n)
            out = out / np.maximum(ql[:, None] + ds[None, :] - out, 1)
        return np.round(out, 9)  # nine digits: sums of equal parts in another order still tie

    def cut(held: pa.Table, floor: np.ndarray) -> pa.Table:
        held = held.sort_by([("_q", "ascending"), ("score", "descending"), *[(k, "ascending") for k in keys]])
        q = held["_q"].to_numpy()
        first = np.concatenate([[True], q[1:] != q[:-1]])
        place = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
        last = place == top_k - 1
        floor[q[last]] = held["score"].to_numpy()[last]
        return held.filter(pa.array(place < top_k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, ids, start, of_query, weight, ql = shared.value
        nq, floor, held = len(ql), np.zeros(len(ql)), None
        step = max(64, min(16_384, block_cells // nq))

        def rows(table: pa.Table) -> list[pa.RecordBatch]:
            named = pa.table([ids.take(table["_q"].combine_chunks()), *[table[k] for k in keys], table["score"]], names=schema.names)
            return named.combine_chunks().to_batches(50_000)

        for batch in batches:
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                s = scores(part.column("tokens"), terms, start, of_query, weight, ql)
                least = floor
                if top_k and s.shape[1] > top_k:
                    least = np.maximum(floor, np.partition(s, s.shape[1] - top_k, axis=1)[:, s.shape[1] - top_k])
                q, at = np.nonzero((s > 0) & (s >= least[:, None]))
                if not len(q):
                    continue
                new = pa.table([pa.array(q), *[part.column(k).take(pa.array(at)) for k in keys], pa.array(s[q, at])], names=["_q", *keys, "score"])
                if not top_k:
                    yield from rows(new)
                    continue
                held = new if held is None else pa.concat_tables([held, new])
                if held.num_rows > 4 * top_k * nq:
                    held = cut(held, floor)
        if held is not None:
            yield from rows(cut(held, floor))

    return toks.select(*keys, "tokens").mapInArrow(run, schema)


def _stretches(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of postings with about ``most`` contributions each."""
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 if a vector is zero, null if sizes differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, t: s + t)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) != F.size(b), F.lit(None).cast("double")).when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def rrf(rankings: DataFrame, keys: Sequence[str], k: int = 5, ties: bool = False) -> DataFrame:
    """Reciprocal rank fusion of ``rankings`` (query_id, list_no, keys, score, rk): sum of 1 / (k + rank).

    ``ties``: equal scores of one list share the better rank.  k below 1 becomes 5.
    """
    k = k if k >= 1 else 5
    place = F.rank().over(Window.partitionBy("query_id", "list_no").orderBy(F.desc("score"))) if ties else F.col("rk")
    first = F.min(F.struct("list_no", "rk"))
    out = rankings.withColumn("_p", place).groupBy("query_id", *keys).agg(F.sum(1.0 / (F.lit(k) + F.col("_p"))).alias("score"), first.alias("seen"))
    return ranked(out, keys, None, [F.col("seen")]).drop("seen")


def combmax(rankings: DataFrame, keys: Sequence[str], k: int = 60) -> DataFrame:
    out = rankings.groupBy("query_id", *keys).agg(F.max(1.0 / (F.lit(k) + F.col("rk"))).alias("score"), F.min(F.struct("list_no", "rk")).alias("seen"))
    return ranked(out, keys, None, [F.col("seen")]).drop("seen")


def importance_blend(fused: DataFrame, alpha: float) -> DataFrame:
    """alpha * score / best + (1 - alpha) * importance."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    return fused.withColumn("score", F.lit(alpha) * F.col("score") / best + F.lit(1 - alpha) * F.coalesce("importance", F.lit(0.5)))


def recency_scores(entries: DataFrame, keys: Sequence[str], now: Column, half_life: float = 14.0) -> DataFrame:
    """(keys, score): exponential recency of valid_from (created_at if null)."""
    days = fractional_days(now, F.coalesce("valid_from", "created_at"))
    return entries.select(*keys, recency(days, half_life).alias("score"))


def blend_recency(fused: DataFrame, recent: DataFrame, keys: Sequence[str], weight: float, top_k: int, queries: DataFrame | None = None) -> DataFrame:
    """The ``top_k`` rows by (1 - w) * score / best + w * recency; rows of either side stay in; ties by
    relevance rank, recency, key.

    ``recent`` has (keys, score) of all rows.  Rows without relevance differ by recency only, so besides its
    relevant rows no query needs more than the newest ``top_k`` that are not among them: the newest
    ``top_k`` + (most relevant rows of a query) rows are enough for all, exactly, and there is no join of
    queries with rows.  ``queries`` (query_id) adds queries without any relevant row.
    """
    keys = list(keys)
    rel = fused.select("query_id", *keys, F.col("score").alias("rel"), F.col("rk").alias("rel_rk"))
    most = rel.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    rec = recent.select(*keys, F.col("score").alias("rec"))
    kinds = {f.name: f.dataType for f in rec.schema.fields}
    newest = rec.orderBy(F.desc("rec"), *keys).limit(top_k + most).collect()
    asked = rel.select("query_id").distinct() if queries is None else queries.select("query_id").distinct()
    near = rel.join(rec, keys, "left").select("query_id", *keys, "rel", "rel_rk", "rec")
    if newest:
        rows = F.explode(F.array(*[F.struct(*[F.lit(r[c]).cast(kinds[c]).alias(c) for c in [*keys, "rec"]]) for r in newest])).alias("r")
        rest = asked.select("query_id", rows).select("query_id", "r.*").join(rel.select("query_id", *keys), ["query_id", *keys], "left_anti")
        near = near.unionByName(rest, allowMissingColumns=True)
    top = F.max("rel").over(Window.partitionBy("query_id"))
    score = F.lit(1 - weight) * F.coalesce(F.col("rel") / top, F.lit(0.0)) + F.lit(weight) * F.coalesce("rec", F.lit(0.0))
    return ranked(near.withColumn("score", score), keys, top_k, [F.asc_nulls_last("rel_rk"), F.desc_nulls_last("rec")]).select("query_id", *keys, "score", "rk")


def age_tiebreak(ranking: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of equal score (12 digits): the newer valid_from first."""
    return ranked(ranking.withColumn("_s", F.round("score", 12)).drop("rk"), keys, None, [F.desc("valid_from")]).drop("_s")


def token_budget(ranking: DataFrame, budget: int, cost: str = "cost") -> DataFrame:
    """The rows before the first whose running cost passes the budget, at least one a query."""
    w = Window.partitionBy("query_id").orderBy("rk").rowsBetween(Window.unboundedPreceding, 0)
    spent = ranking.withColumn("spent", F.sum(cost).over(w))
    over = F.max(F.when(F.col("spent") > budget, 1).otherwise(0)).over(w)
    return spent.withColumn("_over", over).where((F.col("_over") == 0) | (F.col("rk") == 1)).drop("_over")


def rerank_floor(ranking: DataFrame, limit: int, least: float = -8.0) -> DataFrame:
    """The first max(5, ceil(limit / 2)) rows; later ones only with a score of at least ``least``."""
    keep = max(5, -(-limit // 2))
    return ranking.where((F.col("rk") <= keep) | (F.col("score") >= least))


def position_scores(ranking: DataFrame) -> DataFrame:
    return ranking.withColumn("score", F.lit(1.0) / F.col("rk"))


def utility_tiebreak(ranking: DataFrame, keys: Sequence[str]) -> DataFrame:
    """By relevance (score / best of the query, clamped), then utility, both descending."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    out = ranking.withColumn("score", F.least(F.greatest(F.coalesce(F.try_divide(F.col("score"), best), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))).drop("rk")
    return ranked(out, keys, None, [F.desc("utility")])


def weight_distilled(ranking: DataFrame, keys: Sequence[str], family: Column, weight: float = 0.75, ties: Sequence[Column] = ()) -> DataFrame:
    """git_distilled rows weighted, nine digits; rows of equal score by ``ties``, then their old place."""
    score = F.round(F.when(family == "git_distilled", F.col("score") * weight).otherwise(F.col("score")), 9)
    return ranked(ranking.withColumn("score", score).withColumnRenamed("rk", "_rk"), keys, None, [*ties, *([] if ties else [F.col("_rk")])]).drop("_rk")


def squeeze_below(supplementary: DataFrame, floor: Column) -> DataFrame:
    """Scores evenly spaced below the floor of the query's own results, in the given order, 9 digits."""
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    return supplementary.withColumn("score", F.round(floor * (F.lit(1.0) - F.col("rk") / (n + 1)), 9))
