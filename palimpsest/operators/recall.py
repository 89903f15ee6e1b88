"""What stands around the ranking: candidate pools, the bridge hop, merges of tiers and shared rows, final scores.

Queries (query_id, namespace, text) are answered as a set; a row is (namespace, id).  Every per-query list
is cut by a group limit before it is sorted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import QUERY_STOPWORDS, blank_split, normalised, stem
from . import ranking
from .policy import in_force
from .skew import skew_join

KEY = ["namespace", "id"]
MOST_CHUNKS = 64
# Fixed values of the bridge hop: seeds, terms, rows, share of the rows that may hold a term, weight of a name.
SEEDS, TERMS, BRIDGED, MOST_SHARE, NAME_WEIGHT = 5, 6, 30, 0.05, 1.5
_NAME = r"(?<![.!?]\s)(?<!^)\b([A-Z][a-z]{2,})\b"


# -- full-text candidates ---------------------------------------------------------------------------------
def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def query_phrases(query: Column) -> Column:
    """The distinct blank-separated chunks of a query that hold a letter or digit, each as a phrase of words; a
    query in double quotes is one phrase."""
    quoted = (F.length(query) >= 2) & query.startswith('"') & query.endswith('"')
    chunks = F.filter(F.array_distinct(blank_split(F.lower(query))), lambda c: c.rlike(r"[\p{L}\p{N}]"))
    phrases = F.transform(F.when(quoted, F.array(query)).otherwise(F.slice(chunks, 1, MOST_CHUNKS)), lambda c: F.array_join(_words(c), " "))
    return F.filter(F.array_distinct(phrases), lambda p: p != "")


def indexed_text(content: Column, detail: Column, tags: Column) -> Column:
    """The words of a row between blanks, in which a phrase is a substring between blanks."""
    return F.concat(F.lit(" "), F.array_join(_words(F.concat_ws(" ", content, detail, F.array_join(F.coalesce(tags, F.array().cast("array<string>")), " "))), " "), F.lit(" "))


def text_candidates(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """(query_id, namespace, id, matched): rows of the query's namespace that hold any of its phrases.

    Phrases meet rows at their first word, rows of a common word salted; a phrase of several words is then
    looked for in the text.
    """
    asked = queries.select("query_id", "namespace", F.explode(query_phrases(F.col("text"))).alias("phrase")).withColumn("word", F.substring_index("phrase", " ", 1))
    rows = entries.select("namespace", "id", indexed_text(F.col("content"), F.col("detail"), F.col("tags")).alias("indexed"))
    held = rows.select("namespace", "id", "indexed", F.explode(F.array_distinct(F.split(F.trim("indexed"), " "))).alias("word")).where("word <> ''")
    met = skew_join(held, asked, ["namespace", "word"], ["id"]).where(F.col("indexed").contains(F.concat(F.lit(" "), "phrase", F.lit(" "))))
    return met.groupBy("query_id", "namespace", "id").agg(F.count(F.lit(1)).alias("matched"))


def first_wins(lists: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Rows of all lists (same columns), one a key: that of the first list that has it, ``list_no`` from 0."""
    union = None
    for i, df in enumerate(lists):
        one = df.withColumn("list_no", F.lit(i))
        union = one if union is None else union.unionByName(one)
    rest = [c for c in union.columns if c not in keys]
    first = union.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("list_no", F.xxhash64(*rest))).alias("_r"))
    return first.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def candidate_pool(queries: DataFrame, entries: DataFrame, limit: int, pool: int = 1000, keyword_rows: int = 50) -> DataFrame:
    """(query_id, namespace, id, list_no): the newest max(5 * limit, pool) rows of the query's namespace, and the
    first min(that, max(2 * keyword_rows, 100)) active rows that full-text search finds (most phrases, then
    newest), which count where the newest do not hold them (list_no 1).
    """
    size = max(5 * limit, pool)
    newest = Window.partitionBy("namespace").orderBy(F.desc("updated_at"), F.desc("id"))
    recent = entries.select(*KEY, "updated_at").withColumn("at", F.row_number().over(newest)).where(F.col("at") <= size).select(*KEY)
    legs = [queries.select("query_id", "namespace").distinct().join(recent, "namespace").select("query_id", *KEY)]
    found = text_candidates(queries, entries.where("status = 'active'")).join(entries.select(*KEY, "updated_at"), KEY)
    w = Window.partitionBy("query_id").orderBy(F.desc("matched"), F.desc("updated_at"), F.desc("id"))
    legs.append(found.withColumn("at", F.row_number().over(w)).where(F.col("at") <= min(size, max(2 * keyword_rows, 100))).select("query_id", *KEY))
    return first_wins(legs, ["query_id", *KEY])


# -- the bridge hop ---------------------------------------------------------------------------------------
def content_words(text: Column) -> Column:
    """Stemmed words of letters without stopwords; repeats stay."""
    kept = F.filter(blank_split(normalised(text)), lambda t: t.rlike(r"^\p{L}+$") & ~t.isin(QUERY_STOPWORDS))
    return F.transform(kept, lambda t: stem(t))


def bridge_terms(queries: DataFrame, first: DataFrame, docs: DataFrame, seeds: int = SEEDS, terms: int = TERMS) -> DataFrame:
    """(query_id, term, weight, at): telling words of each query's best ``seeds`` rows that the query does not have.

    weight = tf * idf, half as much again for a word that stands with a capital inside a sentence.  The idf is
    BM25's over ``docs`` (keys, tokens, content); a word needs three letters, a positive idf, and no more than
    max(2, 5 %) of the rows may hold it.  First the greatest weight, then the word.
    """
    n = docs.count()
    most = max(2, int(MOST_SHARE * n))
    best = first.where(F.col("rk") <= seeds).select("query_id", *KEY).join(docs.select(*KEY, "content"), KEY)
    names = F.transform(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(_NAME), 1), lambda w: stem(F.lower(w)))
    words = best.select("query_id", F.explode(content_words(F.col("content"))).alias("term"), names.alias("names"))
    tf = words.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.max(F.array_contains("names", F.col("term"))).alias("named"))
    own = queries.select("query_id", F.explode(F.array_distinct(content_words(F.col("text")))).alias("term"))
    fresh = tf.where(F.length("term") >= 3).join(own, ["query_id", "term"], "left_anti")
    held = docs.select(*KEY, F.explode(F.array_distinct("tokens")).alias("term"))
    df = held.join(fresh.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    weighed = fresh.join(df.where((F.col("df") <= most) | F.lit(n <= 2 * most)), "term").withColumn("idf", idf).where("idf > 0")
    weighed = weighed.withColumn("weight", F.round(F.col("tf") * F.col("idf") * F.when(F.col("named"), NAME_WEIGHT).otherwise(1.0), 9))
    w = Window.partitionBy("query_id").orderBy(F.desc("weight"), "term")
    return weighed.withColumn("at", F.row_number().over(w)).where(F.col("at") <= terms).select("query_id", "term", "weight", "at")


def bridge_hop(queries: DataFrame, first: DataFrame, docs: DataFrame, query_terms: DataFrame, rows: int = BRIDGED) -> DataFrame:
    """(query_id, namespace, id, at): up to ``rows`` rows that a second search finds with the bridge terms added,
    that hold a bridge term and are not in ``first``; in the order of that search.

    ``query_terms`` (query_id, terms) are the tokens of the first search.
    """
    terms = bridge_terms(queries, first, docs)
    more = terms.groupBy("query_id").agg(F.collect_list("term").alias("more"))
    depth = (first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) + 3 * rows
    hits = ranking.bm25(query_terms.join(more, "query_id").select("query_id", F.concat("more", "terms").alias("terms")), docs.select(*KEY, "tokens"), KEY, depth)
    new = hits.join(first.select("query_id", *KEY), ["query_id", *KEY], "left_anti").join(docs.select(*KEY, "tokens"), KEY).join(more, "query_id").where(F.arrays_overlap("tokens", "more"))
    w = Window.partitionBy("query_id").orderBy("rk")
    return new.withColumn("at", F.row_number().over(w)).where(F.col("at") <= rows).select("query_id", *KEY, "at")


# -- scores and merges ------------------------------------------------------------------------------------
def positional_scores(ranked_rows: DataFrame, family: str = "family") -> DataFrame:
    """``score`` by place, four digits, within the limits that weighting needs.

    Rows have query_id, rk (the final place), before (the place without weights), ``weight`` (of the family), bucket
    and ``family``.  Every row starts with 1 / place before weighting.  A git_distilled row, which the pipeline has
    weighted, is raised to the best weighted score of a row of another family behind it and then held below every
    row before it, both within its bucket; in closed form a running minimum of what each row asks for.
    """
    distilled = F.col(family) == "git_distilled"
    behind = Window.partitionBy("query_id", "bucket").orderBy("rk").rowsBetween(1, Window.unboundedFollowing)
    ahead = Window.partitionBy("query_id", "bucket").orderBy("rk").rowsBetween(Window.unboundedPreceding, -1)
    own = ranked_rows.withColumn("_own", F.round(F.lit(1.0) / F.col("before"), 4))
    own = own.withColumn("_weighed", F.when(~distilled, F.col("_own") * F.col("weight")))
    own = own.withColumn("_asks", F.when(distilled, F.greatest(F.coalesce(F.max("_weighed").over(behind), F.lit(0.0)), F.col("_own"))).otherwise(F.col("_weighed")))
    return own.withColumn("score", F.when(distilled, F.least("_asks", F.min("_asks").over(ahead))).otherwise(F.col("_own"))).drop("_own", "_weighed", "_asks")


def temporal_selection(df: DataFrame, group: Sequence[str], order: Sequence[Column], as_of: Column | None, limit: int, include_superseded: bool = False) -> DataFrame:
    """The first ``limit`` rows of each group: rows in force before closed ones (which go unless asked for), each in ``order``."""
    rows = df.withColumn("eligible", F.coalesce(in_force(as_of), F.lit(False)))
    rows = rows if include_superseded else rows.where("eligible")
    w = Window.partitionBy(*group).orderBy(F.desc("eligible"), *order)
    return rows.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= limit)


def final_merge(candidates: DataFrame, keys: Sequence[str], least: float, limit: int) -> DataFrame:
    """(query_id, keys, score, rk): candidates in the order (closed, bucket, fallback, weighted score descending, keys).

    Candidates have query_id, keys, score, weight, bucket, fallback and eligible; raw and weighted score must
    reach ``least``.
    """
    rows = candidates.withColumn("weighted", F.col("score") * F.col("weight")).where((F.col("score") >= least) & (F.col("weighted") >= least))
    w = Window.partitionBy("query_id").orderBy((~F.col("eligible")).cast("int"), "bucket", F.col("fallback").cast("int"), F.desc("weighted"), *keys)
    return rows.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= limit).select("query_id", *keys, F.col("weighted").alias("score"), "rk")


def merge_tiers(local: DataFrame, tiers: DataFrame, group: Sequence[str] = ("namespace",)) -> DataFrame:
    """``local`` and then the rows of ``tiers`` that share neither id nor content with a local row; these are ``fallback``.

    Contents meet by their digest, so texts are not shuffled twice.
    """
    digest = F.sha2(F.coalesce("content", F.lit("")), 256)
    added = tiers.join(local.select(*KEY).distinct(), KEY, "left_anti").withColumn("_d", digest)
    added = added.join(local.select(*group, digest.alias("_d")).distinct(), [*group, "_d"], "left_anti").drop("_d")
    return local.withColumn("fallback", F.lit(False)).unionByName(added.withColumn("fallback", F.lit(True)))


def without_known_shared(remote: DataFrame, local: DataFrame, source: str = "source_id", near: DataFrame | None = None) -> DataFrame:
    """Remote rows (``source``, content) whose source is no local id, whose trimmed lower-case content is no local
    content and which are not in ``near`` (remote_id: rows whose vector is close to a local one)."""
    text = F.lower(F.trim(F.coalesce("content", F.lit(""))))
    out = remote.join(local.select(F.col("id").alias(source)).distinct(), source, "left_anti").withColumn("_d", F.sha2(text, 256))
    out = out.join(local.select(F.sha2(text, 256).alias("_d")).distinct(), "_d", "left_anti").drop("_d")
    return out if near is None else out.join(near.select("remote_id").distinct(), "remote_id", "left_anti")


def near_any(remote: DataFrame, local: DataFrame, threshold: float) -> DataFrame:
    """(remote_id): remote rows (row_id, vector) with a cosine above ``threshold`` to any local row; ids of both sides differ."""
    from .vectors import similarity_join

    pairs = similarity_join(remote.select("row_id", "vector").unionByName(local.select("row_id", "vector")), threshold)
    both = pairs.select(F.col("a").alias("remote_id"), F.col("b").alias("row_id")).unionByName(pairs.select(F.col("b").alias("remote_id"), F.col("a").alias("row_id")))
    return both.join(remote.select(F.col("row_id").alias("remote_id")), "remote_id", "left_semi").join(local.select("row_id"), "row_id", "left_semi").select("remote_id").distinct()


def reranked(first: DataFrame, passages: DataFrame, keys: Sequence[str], scorer: Callable[[Column, Column], Column] | None, top: int = 50) -> DataFrame:
    """The first ``top`` rows of each query by ``scorer`` (query text, passage), then their old place; later rows follow
    as they stood.  Without a scorer the order stays.  ``first`` has query_id, keys, rk, text; a scorer may be a
    pandas UDF around any model."""
    if scorer is None:
        return first
    j = first.join(passages, list(keys), "left").withColumn("_s", F.when(F.col("rk") <= top, scorer(F.col("text"), F.coalesce("passage", F.lit("")))))
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("_s"), "rk")
    return j.withColumn("_rk", F.row_number().over(w)).withColumn("score", F.coalesce("_s", "score")).drop("rk", "_s", "passage").withColumnRenamed("_rk", "rk")
