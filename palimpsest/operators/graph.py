"""Typed edges between entries: derivation, bounded traversal, propagation, dense clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

# Share of a change in importance that an edge type passes on; other types pass nothing.
RATES = {"evidence_for": 0.3, "co_anchored": 0.2, "same_root_cause": 0.15, "related_to": 0.1, "depends_on": 0.1}
HUB = 500
SIDE = 500  # rows of a block of a popular file
PER_FILE = 50  # co-anchored neighbours an entry gets from one file


def tag_pairs(tags: DataFrame, least_shared: int = 2, hub: int = HUB) -> DataFrame:
    """(namespace, a, b, shared, weight), a < b: entries that share at least two tags that are no hubs.

    A hub is a tag with more than ``hub`` postings in its namespace; the bound makes the pairs of a tag at
    most hub^2 / 2.  weight = shared / (all tags of both, hubs too, less the shared), 4 digits.
    """
    t = tags.distinct()
    n = t.groupBy("namespace", "tag").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= hub)
    thin = t.join(n.select("namespace", "tag"), ["namespace", "tag"], "left_semi")
    size = t.groupBy("namespace", "entry_id").agg(F.count(F.lit(1)).alias("size"))
    a, b = thin.withColumnRenamed("entry_id", "a"), thin.withColumnRenamed("entry_id", "b")
    shared = a.join(b, ["namespace", "tag"]).where("a < b").groupBy("namespace", "a", "b").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least_shared)
    j = shared.join(size.toDF("namespace", "a", "sa"), ["namespace", "a"]).join(size.toDF("namespace", "b", "sb"), ["namespace", "b"])
    return j.select("namespace", "a", "b", "shared", F.round(F.col("shared") / (F.col("sa") + F.col("sb") - F.col("shared")), 4).alias("weight"))


def tag_neighbours(pairs: DataFrame, top: int = 25) -> DataFrame:
    """The ``top`` neighbours of every entry by shared tags, then id."""
    both = pairs.select("namespace", F.col("a").alias("root"), F.col("b").alias("other"), "shared", "weight").unionByName(pairs.select("namespace", F.col("b").alias("root"), F.col("a").alias("other"), "shared", "weight"))
    w = Window.partitionBy("namespace", "root").orderBy(F.desc("shared"), "other")
    return both.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= top)


def tag_frequencies(tags: DataFrame, hub: int = HUB) -> DataFrame:
    """(namespace, tag, df, hub): entries of every tag, and whether it is too common to derive neighbours from."""
    n = tags.distinct().groupBy("namespace", "tag").agg(F.count(F.lit(1)).alias("df"))
    return n.withColumn("hub", F.col("df") > hub)


def shared_files(postings: DataFrame, least: int = 3, side: int = SIDE) -> DataFrame:
    """(namespace, a, b, shared): all pairs of entries anchored to at least ``least`` common files, a < b.

    Exact prefix filter: with an entry's files in order from the rarest, two entries that share ``least`` files
    share one among the first (files - least + 1) of both; entries with fewer files have no partner.  So a
    popular file is met only by entries that have hardly any other, and each pair is counted at the first
    file its prefixes share.  A file whose prefix list is longer than ``side`` is cut into blocks of about
    ``side`` rows, and every pair of blocks meets under a key of its own; ``side`` decides placement only.
    """
    t = postings.where("namespace IS NOT NULL AND file IS NOT NULL AND entry_id IS NOT NULL").select("namespace", "file", "entry_id").distinct()
    n = t.groupBy("namespace", "file").agg(F.count(F.lit(1)).alias("n"))
    own = t.join(n, ["namespace", "file"]).groupBy("namespace", "entry_id").agg(F.array_sort(F.collect_list(F.struct("n", "file"))).alias("fs")).where(F.size("fs") >= least)
    own = written(own.select("namespace", "entry_id", F.transform("fs", lambda x: x["file"]).alias("files")), "anchored")
    heads = own.withColumn("heads", F.slice("files", F.lit(1), F.size("files") - least + 1)).select("namespace", "entry_id", "files", "heads", F.explode("heads").alias("file"))
    popular = heads.groupBy("namespace", "file").agg(F.count(F.lit(1)).alias("n"))
    heads = heads.join(popular, ["namespace", "file"]).withColumn("blocks", F.ceil(F.col("n") / side).cast("int"))
    mine, every = F.pmod(F.xxhash64("entry_id"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    a = heads.select("namespace", "file", F.col("entry_id").alias("a"), F.col("files").alias("fa"), F.col("heads").alias("ha"), mine.alias("i"), every.alias("j"))
    b = heads.select("namespace", "file", F.col("entry_id").alias("b"), F.col("files").alias("fb"), F.col("heads").alias("hb"), every.alias("i"), mine.alias("j"))
    met = a.join(b, ["namespace", "file", "i", "j"]).where("a < b").where(F.array_intersect("ha", "hb")[0] == F.col("file"))
    return met.select("namespace", "a", "b", F.size(F.array_intersect("fa", "fb")).cast("bigint").alias("shared")).where(F.col("shared") >= least)


def co_anchored(postings: DataFrame, per_file: int = PER_FILE) -> tuple[DataFrame, DataFrame]:
    """(edges, left): every entry's first ``per_file`` neighbours (by id) at each of its files, as edges
    (namespace, source_id, target_id, weight .8), and (namespace, file, entries, left_out) of the pairs left out.

    Only the first ``per_file`` + 1 entries of a file are anyone's neighbours, so the result grows with the
    postings; popular files are salted.
    """
    from .skew import skew_join

    t = written(postings.where("namespace IS NOT NULL AND file IS NOT NULL AND entry_id IS NOT NULL").select("namespace", "file", "entry_id").distinct(), "postings")
    first = Window.partitionBy("namespace", "file").orderBy("entry_id")
    heads = t.withColumn("at", F.row_number().over(first)).where(F.col("at") <= per_file + 1).select("namespace", "file", F.col("entry_id").alias("target_id"), "at")
    met = skew_join(t.withColumnRenamed("entry_id", "source_id"), heads, ["namespace", "file"], ["source_id"]).where("source_id <> target_id")
    # an entry behind the first per_file takes those; one among them takes one more, as it is no neighbour of itself
    last = heads.where(F.col("at") == per_file + 1).select("namespace", "file", F.col("target_id").alias("last"))
    met = met.join(last, ["namespace", "file"], "left").where((F.col("at") <= per_file) | (F.col("source_id") < F.col("last")))
    edges = met.select("namespace", "source_id", "target_id").distinct().withColumn("weight", F.lit(0.8))
    n = t.groupBy("namespace", "file").agg(F.count(F.lit(1)).alias("entries")).where(F.col("entries") > per_file + 1)
    return edges, n.withColumn("left_out", F.col("entries") * (F.col("entries") - 1 - per_file))


def lineage_edges(entries: DataFrame) -> DataFrame:
    """consolidation edges of weight 1 from an entry to every entry it was merged from that exists."""
    e = entries.select("namespace", F.col("id").alias("source_id"), F.explode(F.array_distinct("merged_from")).alias("target_id"))
    known = entries.select("namespace", F.col("id").alias("target_id"))
    return e.join(known, ["namespace", "target_id"], "left_semi").where("source_id <> target_id").select("namespace", "source_id", "target_id", F.lit("consolidation").alias("edge_type"), F.lit(1.0).alias("weight"))


def upserted(edges: DataFrame) -> DataFrame:
    """One edge per (namespace, source, target, type): that of the greatest id."""
    return edges.groupBy("namespace", "source_id", "target_id", "edge_type").agg(F.max_by("weight", "id").alias("weight"), F.max("id").alias("id"))


def bfs(edges: DataFrame, roots: DataFrame, depth: int = 2, types: list[str] | None = None, targets: DataFrame | None = None) -> DataFrame:
    """(namespace, root, node, depth, edge_type, weight): nodes within ``depth`` (1 to 3) steps of each root.

    A node keeps its first visit: least depth, then edge type, then edge id.  ``targets`` (namespace, id)
    limits the nodes that may be visited.  One equi-join a level; visited nodes leave by an anti-join.
    """
    depth = min(max(depth, 1), 3)
    e = edges if types is None else edges.where(F.col("edge_type").isin(types))
    e = e.select("namespace", "source_id", "target_id", "edge_type", "weight", "id")
    if targets is not None:
        e = e.join(targets.select("namespace", F.col("id").alias("target_id")).distinct(), ["namespace", "target_id"], "left_semi")
    seen = roots.select("namespace", "root", F.col("root").alias("node")).distinct()
    frontier, out = seen, None
    for level in range(1, depth + 1):
        step = frontier.withColumnRenamed("node", "source_id").join(e, ["namespace", "source_id"])
        first = step.groupBy("namespace", "root", F.col("target_id").alias("node")).agg(F.min_by(F.struct("edge_type", "weight"), F.struct("edge_type", "id")).alias("v"))
        new = written(first.join(seen, ["namespace", "root", "node"], "left_anti"), "bfs")
        found = new.select("namespace", "root", "node", F.lit(level).alias("depth"), "v.edge_type", "v.weight")
        out = found if out is None else out.unionByName(found)
        frontier = new.select("namespace", "root", "node")
        seen = seen.unionByName(frontier)
    return out


def propagate(edges: DataFrame, changes: DataFrame, depth: int = 2) -> DataFrame:
    """(namespace, id, delta): changes of importance passed along edges, ``depth`` hops.

    Each hop multiplies by the type's rate and the edge's weight, a negative change also by a half.  A node
    takes the change of its first visit for each origin; contributions of several origins add up.
    """
    rate = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in RATES.items() for x in (F.lit(k), F.lit(v))]), "edge_type"), F.lit(0.0))
    e = edges.withColumn("rate", rate * F.coalesce("weight", F.lit(0.0))).where("rate > 0").select("namespace", "source_id", "target_id", "rate", "edge_type", "id")
    seen = changes.select("namespace", F.col("id").alias("origin"), F.col("id").alias("node"), "delta")
    frontier, out = seen, None
    for _ in range(depth):
        step = frontier.withColumnRenamed("node", "source_id").join(e.withColumnRenamed("id", "edge"), ["namespace", "source_id"])
        passed = F.col("delta") * F.col("rate") * F.when(F.col("delta") < 0, 0.5).otherwise(1.0)
        first = step.withColumn("passed", passed).groupBy("namespace", "origin", F.col("target_id").alias("node")).agg(F.min_by("passed", F.struct("edge_type", "edge")).alias("delta"))
        new = written(first.join(seen.select("namespace", "origin", "node"), ["namespace", "origin", "node"], "left_anti"), "spread")
        out = new if out is None else out.unionByName(new)
        seen, frontier = seen.unionByName(new), new
    return out.groupBy("namespace", F.col("node").alias("id")).agg(F.sum("delta").alias("delta"))


def conflict_losers(edges: DataFrame, ranking: DataFrame) -> DataFrame:
    """(query_id, namespace, id): rows that conflict with a ranked row of strictly greater importance.

    ``ranking`` has query_id, namespace, id, importance.  Edges count in both directions.  A row that loses
    still suppresses: the rule looks at the ranked set as it came.
    """
    c = edges.where("edge_type = 'conflicts_with'").select("namespace", "source_id", "target_id").distinct()
    both = c.toDF("namespace", "id", "other").unionByName(c.select("namespace", "target_id", "source_id").toDF("namespace", "id", "other")).distinct()
    r = ranking.select("query_id", "namespace", "id", "importance")
    other = r.toDF("query_id", "namespace", "other", "importance2")
    return r.join(both, ["namespace", "id"]).join(other, ["query_id", "namespace", "other"]).where("importance < importance2").select("query_id", "namespace", "id").distinct()


def dense_clusters(edges: DataFrame, least_size: int = 5, connectivity: float = 0.6) -> DataFrame:
    """(namespace, cluster, id, connectivity): dense groups of each namespace, grown from nodes of high degree.

    Edges of all types count, without direction; null and empty ends do not.  Seeds come by degree, then id.
    A seed's free neighbours, by degree, then id, join one by one while the group with them keeps at least
    ``connectivity`` of all possible edges; a group of ``least_size`` or more takes its members, a smaller one
    leaves them free.  Each step depends on those before, so one task runs one namespace.
    """
    import pandas as pd

    def run(pdf):
        near: dict[str, set[str]] = {}
        for a, b in zip(pdf["source_id"], pdf["target_id"]):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        order = lambda x: (-len(near[x]), x)
        used: set[str] = set()
        rows, n = [], 0
        for seed in sorted(near, key=order) if len(near) >= least_size else []:
            if seed in used:
                continue
            group, links = {seed}, 0
            for x in sorted(near[seed] - used - {seed}, key=order):
                more = len(near[x] & group)
                if (links + more) / ((len(group) + 1) * len(group) / 2) >= connectivity:
                    group.add(x)
                    links += more
            if len(group) >= least_size:
                used |= group
                share = round(links / (len(group) * (len(group) - 1) / 2), 4)
                rows += [(pdf["namespace"].iloc[0], n, x, share) for x in sorted(group)]
                n += 1
        return pd.DataFrame(rows, columns=["namespace", "cluster", "id", "connectivity"]).astype({"cluster": "int64", "connectivity": "float64"})

    live = edges.where("namespace IS NOT NULL AND source_id <> '' AND target_id <> ''").select("namespace", "source_id", "target_id").distinct()
    return live.groupBy("namespace").applyInPandas(run, "namespace string, cluster bigint, id string, connectivity double")


def cluster_domains(clusters: DataFrame, entries: DataFrame) -> DataFrame:
    """(namespace, cluster, size, connectivity, domain): the most common tag of the members (then the smallest name),
    ``cluster-<size>`` if they have none."""
    size = clusters.groupBy("namespace", "cluster").agg(F.count(F.lit(1)).alias("size"), F.max("connectivity").alias("connectivity"))
    tags = clusters.join(entries.select("namespace", "id", F.explode("tags").alias("tag")), ["namespace", "id"]).where("tag <> ''").groupBy("namespace", "cluster", "tag").agg(F.count(F.lit(1)).alias("n"))
    best = tags.groupBy("namespace", "cluster").agg(F.min_by("tag", F.struct(-F.col("n"), F.col("tag"))).alias("domain"))
    return size.join(best, ["namespace", "cluster"], "left").withColumn("domain", F.coalesce("domain", F.concat(F.lit("cluster-"), "size")))


def without_canaries(edges: DataFrame, canaries: DataFrame) -> DataFrame:
    """Edges that do not touch a canary (namespace, id); such edges are refused."""
    of = lambda c: canaries.select("namespace", F.col("id").alias(c)).distinct()
    return edges.join(of("source_id"), ["namespace", "source_id"], "left_anti").join(of("target_id"), ["namespace", "target_id"], "left_anti")


def enriched(entries: DataFrame, postings: DataFrame, canaries: DataFrame) -> DataFrame:
    """(namespace, source_id, target_id, edge_type, weight): lineage and co-anchored edges of all entries, none of a canary."""
    co = co_anchored(postings)[0].withColumn("edge_type", F.lit("co_anchored"))
    return without_canaries(lineage_edges(entries).unionByName(co), canaries)


def cross_validations(pairs: DataFrame, rows: DataFrame, boost: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """(events, boosted): a row that a row of another project resembles is validated once a project.

    ``pairs`` (a, b, score) are the rows similar enough, ``rows`` has row_id, project, importance and history
    (array of events).  events: (row_id, project, similarity, event), the best similarity of each project that
    the history does not name yet.  boosted: (row_id, importance, history) of the rows concerned, ``boost`` a
    project, 1 at most.
    """
    one = lambda c, p: rows.select(F.col("row_id").alias(c), F.col("project").alias(p))
    met = pairs.join(one("a", "pa"), "a").join(one("b", "pb"), "b").where("pa <> pb")
    both = met.select(F.col("a").alias("row_id"), F.col("pb").alias("project"), "score").unionByName(met.select(F.col("b").alias("row_id"), F.col("pa").alias("project"), "score"))
    best = both.groupBy("row_id", "project").agg(F.max("score").alias("similarity")).join(rows.select("row_id", "history"), "row_id")
    prefix = F.concat(F.lit("cross_validated:project_id="), F.col("project").cast("string"), F.lit(":"))
    fresh = best.where(~F.exists(F.coalesce("history", F.array().cast("array<string>")), lambda e: e.startswith(prefix)))
    events = written(fresh.select("row_id", "project", "similarity", F.concat(prefix, F.lit("similarity="), F.format_string("%.4f", "similarity")).alias("event")), "validations")
    more = events.groupBy("row_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("event")).alias("more"))
    boosted = rows.join(more, "row_id").select("row_id", F.least(F.col("importance") + F.lit(boost) * F.col("n"), F.lit(1.0)).alias("importance"), F.concat(F.coalesce("history", F.array().cast("array<string>")), "more").alias("history"))
    return events, boosted


def expand_by_graph(ranking: DataFrame, edges: DataFrame, share: float = 0.5) -> DataFrame:
    """Neighbours of ranked rows that are not ranked: best score of the query * share * best edge weight."""
    top = ranking.groupBy("query_id").agg(F.max("score").alias("top"))
    e = edges.select("namespace", F.col("source_id").alias("id"), "target_id", "weight")
    n = ranking.select("query_id", "namespace", "id").join(e, ["namespace", "id"]).groupBy("query_id", "namespace", F.col("target_id").alias("id")).agg(F.max("weight").alias("weight"))
    n = n.join(ranking.select("query_id", "namespace", "id"), ["query_id", "namespace", "id"], "left_anti")
    return n.join(top, "query_id").select("query_id", "namespace", "id", (F.col("top") * share * F.col("weight")).alias("score"))
