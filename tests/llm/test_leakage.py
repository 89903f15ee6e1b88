import random
import re

import pytest
from pyspark.sql import functions as F

leakage = pytest.importorskip("palimpsest.llm.leakage")


def shares(doc, item, least):
    grams = {tuple(item[i : i + least]) for i in range(len(item) - least + 1)}
    return any(tuple(doc[i : i + least]) in grams for i in range(len(doc) - least + 1))


def test_matches_brute_force(spark):
    rnd = random.Random(8)
    words = list("abcdefg")
    items = [[rnd.choice(words) for _ in range(rnd.randint(0, 30))] for _ in range(25)]
    docs = []
    for _ in range(120):
        own = [rnd.choice([*words, "zz"]) for _ in range(rnd.randint(0, 40))]
        it = rnd.choice(items)
        a = rnd.randint(0, len(it))
        docs.append(own[:20] + it[a : a + rnd.randint(0, 12)] + own[20:])
    d = spark.createDataFrame([(i, " ".join(x).upper()) for i, x in enumerate(docs)] + [(999, None), (None, "a b c")], "doc_id bigint, text string")
    e = spark.createDataFrame([(i, "s", ", ".join(x)) for i, x in enumerate(items)] + [(777, None, None)], "item_id bigint, suite string, text string")
    for least in (4, 6):
        got = {(r[0], r[1]) for r in leakage.leaked_items(d, e, least).collect()}
        assert got == {(i, j) for i, x in enumerate(docs) for j, y in enumerate(items) if shares(x, y, least)}


def test_automaton_matching_lengths():
    rnd = random.Random(2)
    seqs = [[rnd.choice("ab") for _ in range(12)] for _ in range(6)]
    sam = leakage.SuffixAutomaton(list(enumerate(seqs))).packed()
    text = [rnd.choice("abc") for _ in range(300)]
    got = {end: m for end, m, _ in sam.runs(text, 1)}
    for end in range(1, 301):
        best = max((k for k in range(13) if any(text[end - k : end] == s[i : i + k] for s in seqs for i in range(len(s) - k + 1)) and k <= end), default=0)
        assert got.get(end, 0) == best


def test_removal(spark):
    item = " ".join(f"w{i}" for i in range(20))
    d = spark.createDataFrame([(1, "Keep this intro here and there, " * 8 + item.upper() + "! And the end."), (2, item), (3, None), (4, "")], "doc_id bigint, text string")
    e = spark.createDataFrame([(5, "s", item)], "item_id bigint, suite string, text string")
    got = {r["doc_id"]: r for r in leakage.without_leaks(d, e).collect()}
    assert got[1]["clean_text"] == "Keep this intro here and there, " * 8 + "! And the end." and got[1]["n_leaked"] == 20
    assert got[2]["dropped"] and got[2]["clean_text"] is None
    assert got[3]["clean_text"] is None and not got[3]["dropped"]
    assert got[4]["clean_text"] == ""
    span = leakage.leaked_spans(d, e).where("doc_id = 2").collect()
    assert [(r["first_word"], r["last_word"], r["n_words"]) for r in span] == [(1, 20, 20)]


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id bigint, text string")
    e = spark.createDataFrame([], "item_id bigint, suite string, text string")
    assert leakage.leaked_items(d, e).collect() == []
    assert leakage.without_leaks(d, e).collect() == []
    some = spark.createDataFrame([(1, "some text")], "doc_id bigint, text string")
    assert [r["clean_text"] for r in leakage.without_leaks(some, e).collect()] == ["some text"] and leakage.leaked_items(some, e).collect() == []


def test_words_are_runs_of_letters_and_digits():
    rnd = random.Random(3)
    for text in ["", "  ", "A_b-c 12x", "ÉCOLE\u00a0Straße İstanbul", "x\u200by\u0301z ½²③ 漢字か", "ΑΣ'Α ΟΔΟΣ"] + ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(160, 0x2FFF)])) for _ in range(80)) for _ in range(200)]:
        assert leakage.words_of(text) == re.findall(r"[^\W_]+", text.lower())


def test_items_in_parts(spark):
    """Parts of a hundred words give what one part gives, long items included."""
    rnd = random.Random(4)
    items = [[f"w{rnd.randint(0, 30)}" for _ in range(rnd.choice([5, 20, 45, 400]))] for _ in range(30)]
    docs = []
    for i in range(60):
        it = rnd.choice(items)
        a = rnd.randint(0, len(it))
        docs.append([f"w{rnd.randint(0, 30)}" for _ in range(20)] + it[a : a + rnd.randint(3, 90)] + ["end"])
    d = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(docs)] + [(99, None)], "doc_id bigint, text string")
    e = spark.createDataFrame([(i, "s", " ".join(x)) for i, x in enumerate(items)], "item_id bigint, suite string, text string")
    assert leakage.item_parts(e, 6, part_words=500).count() > 4
    pairs = lambda n: {(r[0], r[1]) for r in leakage.leaked_spans(d, e, 6, part_words=n).select("doc_id", "item_id").collect()}
    assert pairs(500) == pairs(1_000_000) == {(i, j) for i, x in enumerate(docs) for j, y in enumerate(items) if shares(x, y, 6)}
    clean = lambda n: {tuple(r) for r in leakage.without_leaks(d, e, 6, part_words=n).collect()}
    assert clean(500) == clean(1_000_000) and len(clean(500)) == 61


def test_sixty_million_characters_of_items(spark):
    """Several parts of full size; every part finds its own."""
    n, size = 100, 10_000  # 1 M words of 59 characters and a blank
    words = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.lpad(F.abs(F.xxhash64("id", i)).cast("string"), 59, "w")), " ")
    e = spark.range(0, n, 1, 8).select(F.col("id").alias("item_id"), F.lit("s").alias("suite"), F.lower(words).alias("text"))
    d = e.where("item_id % 10 = 3").select(F.col("item_id").alias("doc_id"), F.concat(F.lit("before "), F.substring("text", 30_001, 719), F.lit(" after")).alias("text"))
    assert e.agg(F.sum(F.length("text"))).first()[0] > 59_999_000 and leakage.item_parts(e).count() >= 4
    got = {tuple(r) for r in leakage.leaked_items(d, e).collect()}
    assert got == {(i, i) for i in range(3, n, 10)}
