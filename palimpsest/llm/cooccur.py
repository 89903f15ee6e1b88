"""Problem 4: items that appear together far more often than chance.

Heavy-light decomposition.  An item is heavy if it holds at least 1/``heavy`` of all (basket, item)
pairs, so at most ``heavy`` items are, however many items exist; the rest is light.  Items get numbers,
the most frequent first, so the heavy ones have the smallest.

* heavy x heavy: a dense bit matrix (items x baskets) per block, pair counts by popcount of ANDed rows;
* heavy x light: the posting list of a light item probes the bit matrix;
* light x light: pairs within a basket, counted within the block.

A basket with more than SIDE items is cut into chunks of its light items, and every pair of chunks is a
piece of its own, so that the pairs of a large basket spread over the tasks.  Each task hands on partial
counts of pairs of numbers, the shuffle only adds partial counts; names come back at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.order import positions
from ..operators.skew import skew_join
from ..sources.scratch import written

HEAVY = 256
SIDE = 1024  # light items of a chunk of a large basket
BLOCK = 16_384  # baskets in a bit matrix
PROBES = 65_536  # postings that probe the matrix at once
PAIRS = 4_000_000  # pairs counted at once
FLUSH = 4_000_000  # distinct pairs held at once
MOST_BYTES = 16_000_000  # of item names sent to every task
_CODE = np.int64(32)


def normal_items(df: DataFrame, basket: list[str], item: str) -> DataFrame:
    """Distinct (basket, item) with items trimmed and lower-cased; null and blank items and null baskets go."""
    out = df.select(*basket, F.lower(F.trim(item)).alias("item")).where("item IS NOT NULL AND item <> ''")
    return out.where(" AND ".join(f"`{b}` IS NOT NULL" for b in basket)).distinct()


class PairCounts:
    """Counts by pair code, held as sorted unique codes; codes wait until PAIRS of them are there."""

    def __init__(self) -> None:
        self.codes, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0

    def add(self, codes: np.ndarray) -> None:
        for k in range(0, len(codes), PAIRS):
            self.waiting.append(codes[k : k + PAIRS])
            self.n_waiting += len(self.waiting[-1])
            if self.n_waiting >= PAIRS:
                self.settle()

    def settle(self) -> None:
        if self.n_waiting:
            u, c = np.unique(np.concatenate(self.waiting), return_counts=True)
            both, n = np.concatenate([self.codes, u]), np.concatenate([self.counts, c])
            order = np.argsort(both, kind="stable")
            both, n = both[order], n[order]
            first = np.concatenate([[0], np.nonzero(both[1:] != both[:-1])[0] + 1])
            self.codes, self.counts = both[first], np.add.reduceat(n, first)
            self.waiting, self.n_waiting = [], 0

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self.settle()
        out = self.codes, self.counts
        self.codes, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)
        return out


def light_pairs(rows: np.ndarray, codes: np.ndarray) -> Iterator[np.ndarray]:
    """Pair codes (smaller << 32 | greater) of all pairs with equal row; ``rows`` ascending, codes ascending within.

    Partner after partner: at each distance only the places that have one are looked at, so the work is
    the number of pairs.
    """
    if not len(rows):
        return
    first = np.nonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))[0]
    size = np.diff(np.append(first, len(rows)))
    ends = np.repeat(first + size, size)
    at, gap = np.arange(len(rows)), 1
    while True:
        at = at[at + gap < ends[at]]
        if not len(at):
            return
        yield codes[at] << _CODE | codes[at + gap]
        gap += 1


def heavy_pairs(bits: np.ndarray) -> np.ndarray:
    """Pair counts of a boolean matrix (items x baskets): popcount of ANDed 64-bit words, upper triangle."""
    packed = np.packbits(bits, axis=1)
    packed = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))
    words = np.ascontiguousarray(packed).view(np.uint64)
    out = np.zeros((len(words), len(words)), np.int64)
    for i in range(len(words) - 1):
        out[i, i + 1 :] = np.bitwise_count(words[i] & words[i + 1 :]).sum(axis=1, dtype=np.int64)
    return out


def _count_pieces(h: int):
    """Pieces (codes, other, first) to partial counts; codes below ``h`` are heavy.

    A piece with ``other`` stands for the pairs across; any other one for those within and with the heavy
    items of its codes, which stand in one piece for each chunk and pair with each other in the ``first``.
    """
    schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])

    def emit(codes: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(codes), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(codes[k : k + 100_000]), pa.array(counts[k : k + 100_000])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros((h, h), np.int64)
        pairs = PairCounts()
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                part = batch.slice(k, BLOCK)
                n = part.num_rows
                lists, others = part.column("codes"), part.column("other")
                rows = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
                codes = lists.flatten().to_numpy().astype(np.int64)
                size = np.diff(others.offsets.to_numpy())
                crossed = size[rows] > 0
                order = np.argsort(rows << _CODE | codes, kind="stable")
                rows, codes, crossed = rows[order], codes[order], crossed[order]
                light = codes >= h
                inner = light & ~crossed
                if h:
                    bits = np.zeros((h, n), bool)
                    bits[codes[~light], rows[~light]] = True
                    if h > 1:
                        dense += heavy_pairs(bits[:, part.column("first").to_numpy(zero_copy_only=False)])
                    by_basket = np.ascontiguousarray(bits.T)
                    by_item = np.nonzero(inner & by_basket.any(axis=1)[rows])[0]
                    by_item = by_item[np.argsort(codes[by_item], kind="stable")]  # posting lists, item after item
                    for a in range(0, len(by_item), PROBES):
                        probes = by_item[a : a + PROBES]
                        i, slot = np.nonzero(by_basket[rows[probes]])
                        pairs.add(slot.astype(np.int64) << _CODE | codes[probes][i])
                for found in light_pairs(rows[inner], codes[inner]):
                    pairs.add(found)
                far = others.flatten().to_numpy().astype(np.int64)
                starts = others.offsets.to_numpy() - others.offsets.to_numpy()[0]
                for r in np.nonzero(size)[0]:
                    one, two = codes[np.searchsorted(rows, r) : np.searchsorted(rows, r, "right")], far[starts[r] : starts[r + 1]]
                    pairs.add((np.minimum(one[:, None], two[None, :]) << _CODE | np.maximum(one[:, None], two[None, :])).ravel())
                if len(pairs.codes) > FLUSH:
                    yield from emit(*pairs.take())
        yield from emit(*pairs.take())
        a, b = np.nonzero(dense)
        yield from emit(a.astype(np.int64) << _CODE | b, dense[a, b])

    return run


def pieces(baskets: DataFrame, h: int, side: int = SIDE) -> DataFrame:
    """(codes, other, first) of baskets (codes): small baskets whole, large ones as pairs of chunks."""
    none = F.array().cast("array<int>")
    small = baskets.where(F.size("codes").between(2, side)).select("codes", none.alias("other"), F.lit(True).alias("first"))
    big = baskets.where(F.size("codes") > side).select(F.array_sort(F.filter("codes", lambda c: c >= h)).alias("s"), F.filter("codes", lambda c: c < h).alias("hv"))
    chunks = F.sequence(F.lit(0), F.greatest(F.ceil(F.size("s") / side), F.lit(1)).cast("int") - 1)
    every = F.flatten(F.transform(chunks, lambda i: F.transform(F.filter(chunks, lambda j: j >= i), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    big = big.select("s", "hv", F.explode(every).alias("p")).select("s", "hv", "p.i", "p.j")
    cut = lambda k: F.slice("s", F.col(k) * side + 1, F.lit(side))
    alone = F.col("i") == F.col("j")
    big = big.select(F.when(alone, F.concat("hv", cut("i"))).otherwise(cut("i")).alias("codes"), F.when(alone, none).otherwise(cut("j")).alias("other"), (alone & (F.col("i") == 0)).alias("first"))
    return small.unionByName(big.repartition("codes", "other"))


def cooccurrence(df: DataFrame, basket: list[str], item: str, least: int = 8, lift: float = 5.0, heavy: int = HEAVY, side: int = SIDE) -> DataFrame:
    """item_a < item_b (code points), n_both, n_a, n_b, n_baskets, lift of pairs with n_both >= ``least``
    and n_both * n_baskets >= ``lift`` * n_a * n_b, exactly.

    ``df`` has the basket columns and the item; other columns are ignored.  Repeated rows count once.
    An item in fewer than ``least`` baskets is in no case and leaves before pairs are made.  The cost of
    a basket is the number of pairs of its remaining items; an item that a third of the baskets hold costs
    a bit per basket.  Item names go to every task while they are small (MOST_BYTES), else items meet their
    numbers in a salted join.  Empty input gives an empty result.
    """
    posts = written(normal_items(df, basket, item), "postings")
    total = posts.count()
    coded = positions(posts.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least), [F.desc("n"), "item"], "code")
    stats = coded.agg(F.coalesce(F.sum(F.length("item") + 16), F.lit(0)).alias("bytes"), F.count_if(F.col("n") * heavy >= total).alias("h")).first()
    small, h = stats["bytes"] <= MOST_BYTES, stats["h"]
    names = coded.select("item", F.col("code").cast("int").alias("code"))
    kept = posts.join(F.broadcast(names), "item", "left") if small else skew_join(posts, names, ["item"], basket, "left")
    baskets = written(kept.groupBy(*basket).agg(F.collect_list("code").alias("codes")).select("codes"), "baskets")
    n_baskets = baskets.count()
    partial = pieces(baskets, h, side).mapInArrow(_count_pieces(h), "pair bigint, n bigint")
    pairs = partial.groupBy("pair").agg(F.sum("n").alias("n_both")).where(F.col("n_both") >= least)
    pairs = pairs.select("n_both", F.shiftright("pair", 32).alias("x"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("y"))
    look = F.broadcast(coded) if small else coded
    out = pairs.join(look.select(F.col("code").alias("x"), F.col("item").alias("ix"), F.col("n").alias("nx")), "x").join(look.select(F.col("code").alias("y"), F.col("item").alias("iy"), F.col("n").alias("ny")), "y")
    up = F.col("ix") < F.col("iy")
    pick = lambda a, b: F.when(up, F.col(a)).otherwise(F.col(b))
    out = out.select(pick("ix", "iy").alias("item_a"), pick("iy", "ix").alias("item_b"), "n_both", pick("nx", "ny").alias("n_a"), pick("ny", "nx").alias("n_b"), F.lit(n_baskets).cast("bigint").alias("n_baskets"))
    ratio = F.col("n_both").cast("double") * F.col("n_baskets") / F.col("n_a") / F.col("n_b")
    # products of counts can pass 64 bits, and a double lift is a decimal to its writer
    wide = lambda c: F.col(c).cast("decimal(13,0)")
    bound = Fraction(str(lift))
    whole = lambda n: F.lit(str(n)).cast(f"decimal({len(str(n))},0)")
    exact = wide("n_both") * wide("n_baskets") * whole(bound.denominator) >= wide("n_a") * wide("n_b") * whole(bound.numerator)
    return out.where(exact).select("item_a", "item_b", "n_both", "n_a", "n_b", "n_baskets", ratio.alias("lift"))
