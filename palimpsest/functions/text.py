"""Tokenising and stemming as Column expressions (no Python at run time)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_QUERY_CHARS = 1000
MAX_QUERY_TERMS = 64

# Words a ranking query drops unless nothing else is left.
QUERY_STOPWORDS = (
    "a an the and or but if then than so as of to in on at by for from with "
    "about into over after before between under during without within "
    "is are was were be been being am do does did done doing have has had "
    "having can could may might must shall should will would "
    "i me my mine we us our ours you your yours he him his he she her hers it its "
    "they them their theirs this that these those there here who whom whose "
    "which what when where why how "
    "not no nor yes any some all each every either neither both"
).split()

# Words a lexical query drops unless nothing else is left.
LEXICAL_STOPWORDS = (
    "a an and are as at be by do does for from how i in is it its me my of on or our that the this to was we what when where which who why with you your"
).split()


def _lit(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def split_camel(text: Column) -> Column:
    return F.regexp_replace(text, "(?<=[a-z0-9])(?=[A-Z])", " ")


def normalised(text: Column) -> Column:
    """Camel case split, lower-cased, punctuation but hyphen and underscore blanked.  Null gives an empty text."""
    return F.regexp_replace(F.lower(split_camel(F.coalesce(text, F.lit("")))), r"[^\p{L}\p{N}_\s-]", " ")


def blank_split(text: Column) -> Column:
    return F.filter(F.split(text, r"[\s\p{Z}]+"), lambda t: t != "")


def with_parts(tokens: Column, separator: str) -> Column:
    """Each token, followed by its parts if it holds the separator."""
    return F.flatten(F.transform(tokens, lambda t: F.when(t.contains(separator), F.concat(F.array(t), F.filter(F.split(t, separator + "+"), lambda p: p != ""))).otherwise(F.array(t))))


def stem(token: Column) -> Column:
    """Suffix stripping of alphabetic tokens of five letters or more."""
    n = F.length(token)
    cut = lambda k: F.substring(token, F.lit(1), n - k)
    base = F.when(token.endswith("edly") & (n > 7), cut(4)).when(token.endswith("ing") & (n > 6), cut(3)).when(token.endswith("ed") & (n > 5), cut(2)).when(token.endswith("ly") & (n > 5), cut(2))
    undone = F.when((F.length(base) > 3) & base.rlike(r"([^aeiou])\1$"), F.substring(base, F.lit(1), F.length(base) - 1)).otherwise(base)
    return (
        F.when(~token.rlike(r"^\p{L}{5,}$"), token)
        .when(token.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when(token.endswith("ss"), token)
        .when(token.rlike("(x|z|ss|ch|sh)es$"), cut(2))
        .when(token.endswith("s"), cut(1))
        .when(base.isNotNull(), undone)
        .otherwise(token)
    )


def entry_tokens(content: Column, detail: Column, tags: Column) -> Column:
    """Stemmed tokens of content, detail and tags; tags also give their hyphen parts, tokens their underscore parts."""
    named = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: normalised(t))
    tag_words = F.flatten(F.transform(named, lambda t: F.when(t.contains("-"), F.concat(F.array(t), F.split(t, "-"))).otherwise(F.array(t))))
    text = F.concat_ws(" ", normalised(content), normalised(detail), F.array_join(tag_words, " "))
    return F.transform(with_parts(blank_split(text), "_"), lambda t: stem(t))


def bounded_query(query: Column) -> Column:
    """The query within 1000 characters and 64 blank-separated chunks."""
    short = blank_split(F.substring(query, 1, MAX_QUERY_CHARS))
    return F.when((F.length(query) <= MAX_QUERY_CHARS) & (F.size(short) <= MAX_QUERY_TERMS), query).otherwise(F.array_join(F.slice(short, 1, MAX_QUERY_TERMS), " "))


def query_tokens(query: Column) -> Column:
    """Stemmed query tokens with hyphen and underscore parts; repeats stay, stopwords go unless nothing is left."""
    parts = F.flatten(F.transform(blank_split(normalised(bounded_query(query))), lambda t: F.when(t.contains("-"), F.concat(F.array(t), F.split(t, "-"))).otherwise(F.array(t))))
    words = with_parts(F.filter(parts, lambda t: t != ""), "_")
    kept = F.filter(words, lambda t: ~t.isin(QUERY_STOPWORDS))
    return F.transform(F.when(F.size(kept) > 0, kept).otherwise(words), lambda t: stem(t))


def lexical_tokens(text: Column) -> Column:
    """Lower-cased runs of a-z and 0-9 after splitting camel case."""
    return F.regexp_extract_all(F.lower(split_camel(F.coalesce(text, F.lit("")))), F.lit("([a-z0-9]+)"), 1)


def lexical_query(query: Column) -> Column:
    words = F.array_distinct(lexical_tokens(bounded_query(query)))
    kept = F.filter(words, lambda t: ~t.isin(LEXICAL_STOPWORDS))
    return F.when(F.size(kept) > 0, kept).otherwise(words)


def collapsed(text: Column) -> Column:
    """White space collapsed and lower-cased, the form in which two texts count as equal."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def short_line(text: Column, most: int = 80, least: int = 60) -> Column:
    """At most ``most`` characters, cut at the last blank in [least, most) if there is one, with an ellipsis."""
    head = F.substring(text, 1, most - 1)
    last = F.length(head) - F.instr(F.reverse(head), " ") + 1
    cut = F.when((F.instr(head, " ") > 0) & (last - 1 >= least), F.substring(head, F.lit(1), last - 1)).otherwise(head)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(cut), F.lit("…")))


def anchor_file(path: Column) -> Column:
    """Posting key of a relative path: slashes forward, ``.`` steps dropped; absolute, empty and ``..`` paths give null."""
    slashed = F.regexp_replace(F.trim(path), r"\\", "/")
    steps = F.filter(F.split(slashed, "/"), lambda s: (s != "") & (s != "."))
    bad = slashed.startswith("/") | slashed.rlike("^[A-Za-z]:") | F.array_contains(steps, "..") | (F.size(steps) == 0)
    return F.when(~bad, F.array_join(steps, "/"))


def derived_parent(entry_id: Column) -> Column:
    """The id before ``#hype<digits>``, or null."""
    got = F.regexp_extract(entry_id, r"^(.+)#hype([0-9]+)$", 1)
    return F.when(got != "", got)


def shannon_entropy(text: Column) -> Column:
    """Bits per character."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars)
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.coalesce(F.aggregate(F.transform(F.array_distinct(chars), lambda c: -share(c) * F.log2(share(c))), F.lit(0.0), lambda a, b: a + b), F.lit(0.0))


def token_cost(text: Column) -> Column:
    """Half-even round of 1.3 tokens a word."""
    return F.bround(F.size(blank_split(F.coalesce(text, F.lit("")))) * F.lit(1.3), 0).cast("bigint")


def serialized_tokens(row: Column) -> Column:
    """A quarter of the characters of the row as JSON, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(F.to_json(row)) / 4)).cast("bigint")


def passage(content: Column, detail: Column, tags: Column, most: int = 2048) -> Column:
    """Content, detail and tags in one text of at most ``most`` characters, as a reranker reads it."""
    return F.left(F.concat_ws(" ", content, F.nullif(detail, F.lit("")), F.nullif(F.array_join(F.coalesce(tags, F.array().cast("array<string>")), " "), F.lit(""))), F.lit(most))


def valid_namespace(name: Column) -> Column:
    """``global``, ``default`` or a known scope with a plain name, 128 characters at most; blanks are not stripped."""
    return F.coalesce((F.length(name) <= 128) & name.rlike(r"\A(?:(?:project|team|org|user):[a-zA-Z0-9_-]+|global|default)\z"), F.lit(False))


def namespace_path(name: Column) -> Column:
    """The folder of a valid namespace, null for others."""
    return F.when(valid_namespace(name), F.replace(name, F.lit(":"), F.lit("/")))


def project_slug(path: Column) -> Column:
    """The last step of a path as lower-case letters, digits and single hyphens, 32 characters at most; ``root`` if none are left."""
    last = F.lower(F.substring_index(F.regexp_replace(path, "/+$", ""), "/", -1))
    slug = F.regexp_replace(F.regexp_replace(last, "[^a-z0-9-]+", "-"), "-{2,}", "-")
    bare = lambda c: F.regexp_replace(c, "^-+|-+$", "")
    return F.coalesce(F.nullif(bare(F.left(bare(slug), F.lit(32))), F.lit("")), F.lit("root"))


def slug_of(namespace: Column) -> Column:
    """The slug of ``project:<slug>-<digest>``, or null."""
    got = F.regexp_extract(namespace, r"\Aproject:(.+)-[^-]*\z", 1)
    return F.when(got != "", got)
