"""Problem 5: pairwise links consolidated into groups, by randomised contraction.

Every round orders the vertices by a fresh hash; each hooks to the smallest of its closed neighbourhood.
Edges are relabelled by the hooks, loops and repeats go, and the round repeats on what is left, a
constant share less in expectation whatever the shape of the graph (a chain of a billion links needs
some dozens of rounds).  The hooks of each round are written to the shared folder; afterwards they are
composed backwards, from the smallest round to the first, so all rounds together cost a geometric sum.

Every join reads two written tables, one of them with unique keys, so adaptive execution may split the
partition of a hub or of a giant group on the other side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.current import current_rows
from ..sources.scratch import discard, written

ENTRY_ID = "^[ML]-[0-9a-f]{8}$"
MAX_ROUNDS = 200


def undirected(df: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """Distinct edges with u < v; loops and null ends go."""
    return df.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()


def hooks(edges: DataFrame, seed: int) -> DataFrame:
    """(node, rep): the node of the closed neighbourhood that is first in the order of this round's hash.

    A min that combines map-side: a hub with a third of all edges costs one row a map task.
    """
    both = edges.select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b")))).alias("e")).select("e.*")
    rank = lambda c: F.struct(F.xxhash64(F.lit(seed), F.col(c)).alias("h"), F.col(c).alias("x"))
    best = both.groupBy(F.col("a").alias("node")).agg(F.min(rank("b")).alias("near"))
    own = F.struct(F.xxhash64(F.lit(seed), F.col("node")).alias("h"), F.col("node").alias("x"))
    return best.select("node", F.least("near", own)["x"].alias("rep"))


def connected_components(pairs: DataFrame, seed: int = 20_240_101) -> DataFrame:
    """(node, root) for every node of at least one edge; ``pairs`` has columns u and v of one orderable type.

    Two nodes have equal roots iff a path links them; which node is the root depends on the seed only.
    Null ends, loops, repeated and reversed pairs are ignored.  No edge, no row.
    """
    edges = written(undirected(pairs), "edges")
    levels: list[DataFrame] = []
    while not edges.isEmpty():
        if len(levels) == MAX_ROUNDS:
            raise RuntimeError(f"no end after {MAX_ROUNDS} rounds")
        hook = written(hooks(edges, seed + len(levels)), "hooks")
        levels.append(hook)
        relabelled = edges.join(hook.toDF("u", "ru"), "u").join(hook.toDF("v", "rv"), "v")
        done, edges = edges, written(undirected(relabelled, "ru", "rv"), "edges")
        discard(done)
    if not levels:
        return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).limit(0)
    found = levels[-1].toDF("node", "root")
    for hook in reversed(levels[:-1]):
        done, above = found, found.toDF("rep", "root")
        found = written(hook.join(above, "rep", "left").select("node", F.coalesce("root", "rep").alias("root")), "roots")
        discard(hook, levels[-1], done)
    return found


def groups(pairs: DataFrame) -> DataFrame:
    """(node, group_id): every linked node with the smallest node of its group."""
    found = connected_components(pairs)
    least = written(found.groupBy("root").agg(F.min("node").alias("group_id")), "least")
    return found.join(least, "root").select("node", "group_id")


def entry_links(memories: DataFrame) -> DataFrame:
    """Links of current rows: merged_from and consolidated_into values that have the form of an entry id."""
    rows = current_rows(memories, ["namespace", "id"], "updated_at", ["merged_from", "consolidated_into"])
    named = F.explode(F.concat(F.coalesce("merged_from", F.array().cast("array<string>")), F.array("consolidated_into"))).alias("other")
    return rows.select("namespace", "id", named).where(F.col("other").rlike(ENTRY_ID) & (F.col("other") != F.col("id")))


def entry_groups(memories: DataFrame) -> DataFrame:
    """(namespace, entry_id, group_id) of all entries linked directly or indirectly within a namespace.

    Ids without a row of their own are members; null lists, blank and other values link nothing.
    A node is namespace and id joined by U+0000, so order within a group is the order of ids.
    """
    cut = "\x00"
    node = lambda c: F.concat_ws(cut, "namespace", c)
    got = groups(entry_links(memories).select(node("id").alias("u"), node("other").alias("v")))
    last = lambda c: F.substring_index(c, cut, -1)
    return got.select(F.substring_index("node", cut, 1).alias("namespace"), last("node").alias("entry_id"), last("group_id").alias("group_id"))
