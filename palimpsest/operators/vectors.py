"""Vector search and similarity joins, by matrix products over blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .order import positions
from .ranking import ranked

MAX_QUERY_CELLS = 8_000_000  # numbers of one broadcast slice of queries (64 MB)
BLOCK_ROWS = 4096  # rows a pivot stands for at least
PRODUCT_CELLS = 8_000_000  # cosines held at once
PIVOTS = 64


def unit_rows(vectors: list) -> np.ndarray:
    m = np.array(vectors, dtype=np.float64)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def nearest(queries: DataFrame, rows: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """(query_id, row_id, score, rk): the k best rows of every query, exact.

    ``queries`` has (query_id, vector), ``rows`` (row_id, vector).  Scores: cosine (0 for zero vectors) or
    negated Euclidean distance (``l2``).  Null vectors and vectors of another size are skipped.  Queries
    travel in slices of bounded size, one pass over the rows a slice; each task hands on k rows a query.
    """
    sized = queries.where("vector IS NOT NULL").select("query_id", "vector")
    stats = sized.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dim")).first()
    if not stats["n"]:
        return queries.select("query_id", F.lit(0).cast("bigint").alias("row_id"), F.lit(0.0).alias("score"), F.lit(0).alias("rk")).limit(0)
    slices = -(-stats["n"] * stats["dim"] // MAX_QUERY_CELLS)
    found = None
    for i in range(slices):  # one slice at a time on the driver and in the executors
        own = sized.where(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == i)
        part, shared = _nearest_slice(own, rows, k, metric)
        if slices > 1:
            part = written(part, "nearest")
            shared.destroy()
        found = part if found is None else found.unionByName(part)
    return ranked(found, ["row_id"], k)


def _nearest_slice(queries: DataFrame, rows: DataFrame, k: int, metric: str) -> tuple[DataFrame, Broadcast]:
    got = queries.collect()
    by_dim: dict[int, tuple[list, np.ndarray]] = {}
    for dim in {len(r["vector"]) for r in got}:
        own = [r for r in got if len(r["vector"]) == dim]
        by_dim[dim] = ([r["query_id"] for r in own], np.array([r["vector"] for r in own], dtype=np.float64))
    shared = rows.sparkSession.sparkContext.broadcast(by_dim)
    schema = pa.schema([("query_id", pa.int64()), ("row_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            ids, vectors = b.column(0).to_pylist(), b.column(1).to_pylist()
            for dim, (_, q) in shared.value.items():
                at = [i for i, v in enumerate(vectors) if v is not None and len(v) == dim]
                if not at:
                    continue
                m = np.array([vectors[i] for i in at], dtype=np.float64)
                keys = np.array([ids[i] for i in at], dtype=np.int64)
                if metric == "cosine":
                    s = unit_rows(q) @ unit_rows(m).T
                else:
                    s = -np.sqrt(np.maximum((q**2).sum(1)[:, None] + (m**2).sum(1)[None, :] - 2 * q @ m.T, 0.0))
                s = np.round(s, 9)
                keys = np.broadcast_to(keys, s.shape)
                if dim in best:
                    s, keys = np.hstack([best[dim][0], s]), np.hstack([best[dim][1], keys])
                order = np.lexsort((keys, -s), axis=1)[:, :k]
                best[dim] = np.take_along_axis(s, order, 1), np.take_along_axis(keys, order, 1)
        for dim, (s, keys) in best.items():
            qid = np.repeat(np.array(shared.value[dim][0], dtype=np.int64), s.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(qid), pa.array(keys.ravel()), pa.array(s.ravel())], schema=schema)

    return rows.select(F.col("row_id").cast("bigint"), "vector").mapInArrow(run, "query_id bigint, row_id bigint, score double"), shared


def similarity_join(df: DataFrame, threshold: float, slice_cells: int = MAX_QUERY_CELLS, block_rows: int = BLOCK_ROWS, pivots: int = PIVOTS) -> DataFrame:
    """(a, b, score), a < b: all pairs of rows (row_id, vector) with cosine above ``threshold``, exact.

    Rows lie in the order of the nearest of a bounded sample of pivots.  One slice of them after the other, of
    bounded size, is broadcast, and every other row meets it where it is read: nothing is copied or shuffled,
    and a pass reads only the pivots that may share a pair with the slice.  Angles obey the triangle inequality,
    so two pivots further apart than both radii and the threshold's angle cannot.  Null and zero vectors pair
    with nothing, vectors of different sizes neither.
    """
    live = df.where("vector IS NOT NULL").select(F.col("row_id").cast("bigint").alias("row_id"), "vector")
    found = None
    for size in sorted(r[0] for r in live.select(F.size("vector")).distinct().collect() if r[0]):
        own = _similarity_join(live.where(F.size("vector") == size), size, threshold, slice_cells, block_rows, pivots)
        found = own if found is None else found.unionByName(own)
    return found if found is not None else df.sparkSession.createDataFrame([], "a bigint, b bigint, score double")


def _similarity_join(live: DataFrame, dim: int, threshold: float, slice_cells: int, block_rows: int, pivots: int) -> DataFrame:
    spark = live.sparkSession
    pivots = min(pivots, max(1, live.count() // block_rows))
    chosen = unit_rows([r["vector"] for r in live.orderBy(F.xxhash64("row_id")).limit(pivots).collect()])
    theta = math.acos(max(-1.0, min(1.0, threshold)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = unit_rows(b.column(1).to_pylist())
            cos = np.clip(m @ chosen.T, -1, 1)
            p = cos.argmax(axis=1)
            ok = np.abs(m).sum(axis=1) > 0
            out = [b.column(0), pa.array(p.astype(np.int32)), pa.array(np.arccos(cos[np.arange(len(p)), p])), pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), dim).cast(pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(out, names=["row_id", "pivot", "angle", "unit"]).filter(pa.array(ok))

    placed = positions(live.mapInArrow(place, "row_id bigint, pivot int, angle double, unit array<double>"), ["pivot", "row_id"], "at")
    cells = {r["pivot"]: (r["n"], r["far"]) for r in placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("far")).collect()}
    gap = np.arccos(np.clip(chosen @ chosen.T, -1, 1))
    rows, total = max(1, slice_cells // dim), sum(n for n, _ in cells.values())
    none = "a bigint, b bigint, score double"
    out = spark.createDataFrame([], none)
    for start in range(0, total, rows):
        part = placed.where((F.col("at") >= start) & (F.col("at") < start + rows)).select("row_id", "unit", "pivot").toArrow()
        ids, units = part["row_id"].to_numpy(), part["unit"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
        held = set(part["pivot"].unique().to_pylist())
        near = [p for p in cells if any(gap[p, q] - cells[p][1] - cells[q][1] <= theta + 1e-9 for q in held)]
        shared = spark.sparkContext.broadcast((ids, units))
        met = placed.where(F.col("pivot").isin(near)).select("row_id", "unit").mapInArrow(_meet(shared, dim, threshold), none)
        if total <= rows:
            return met
        out = out.unionByName(written(met, "pairs"))
        shared.destroy()
    return out


def _meet(shared: Broadcast, dim: int, threshold: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, units = shared.value
        step = max(1, PRODUCT_CELLS // len(ids))
        for b in batches:
            other, m = b.column(0).to_numpy(), b.column(1).flatten().to_numpy().reshape(-1, dim)
            for k in range(0, len(other), step):
                s = np.round(units @ m[k : k + step].T, 9)
                i, j = np.nonzero((s > threshold) & (other[None, k : k + step] > ids[:, None]))
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(other[k + j]), pa.array(s[i, j])], schema=schema)

    return run
