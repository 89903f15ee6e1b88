import math
import random

import pytest

langid = pytest.importorskip("palimpsest.llm.langid")

TEXTS = {
    "en": "the quick brown fox jumps over the lazy dog and nobody noticed that the house was left open during the night because of them",
    "de": "der schnelle braune fuchs springt nicht über den faulen hund weil die tür des hauses während der nacht offen geblieben ist und niemand",
    "fr": "le renard brun saute par dessus le chien paresseux parce que la porte de la maison est restée ouverte pendant la nuit sans personne",
    "es": "el zorro marrón salta sobre el perro perezoso porque la puerta de la casa quedó abierta durante la noche y nadie lo vio hasta ahora",
}


def sentence(code, rnd, n=12):
    words = [rnd.choice(TEXTS[code].split()) for _ in range(n)]
    return (" ".join(words)).capitalize() + "."


def corpus(n=40, wrong=0.15):
    rnd = random.Random(6)
    rows = []
    for i in range(n * len(TEXTS)):
        code = list(TEXTS)[i % len(TEXTS)]
        label = rnd.choice(list(TEXTS)) if rnd.random() < wrong else code
        rows.append((i, " ".join(sentence(code, rnd) for _ in range(6)), label))
    return rows


def test_code_lengths_are_those_of_a_distribution():
    model = langid.ByteModel({"abra": 3, "abc": 1, "cab": 2}, order=3)
    for context in (b" ", b" a", b" ab", b"abr", b"zz"):
        total = sum(2 ** -model._symbol(context, x) for x in range(256))
        assert total == pytest.approx(1.0)
    assert model.bits("abra") < model.bits("arba")
    assert model.bits("abra") == pytest.approx(sum(model._symbol((b" abra ")[max(0, i - 3) : i], (b" abra ")[i]) for i in range(1, 6)))


def test_escape_by_hand():
    model = langid.ByteModel({"a": 2}, order=1)  # " a ": after the start an a, after a the end
    assert model.bits("a") == pytest.approx(2 * -math.log2(2 / 3))


def test_labels():
    got = [langid.label_code(x) for x in ("EN", "en-GB", "en_US", "English", "ger", " nld ", None, "", " ", "und", "n/a", "UNKNOWN", "pt-BR", "xx")]
    assert got == ["en", "en", "en", "en", "de", "nl", None, None, None, None, None, None, "pt", "xx"]


def test_label_column_is_label_code(spark):
    values = ["EN", "en-GB", "en_US", "English", "ger", " nld ", None, "", " ", "und", "n/a", "UNKNOWN", "pt-BR", "xx"]
    rows = spark.createDataFrame([(x,) for x in values], "lang string").select("lang", langid.label_column().alias("c")).collect()
    assert [r["c"] for r in rows] == [langid.label_code(r["lang"]) for r in rows]


def test_sentences():
    text = "# A title with more than eight words in it all\nOne two three. Four five lib.graph six!\n\n- Item one “short quote” goes\n  on here.\n```\ncode is not text.\n```\n<p>lower start here.</p> Last without end"
    got = [(text[a:b].strip(), whole) for a, b, whole, _ in langid.sentences(text)]
    assert got[:2] == [("One two three.", True), ("Four five lib.graph six!", True)]
    assert got[2][0].startswith("Item one") and got[2][0].endswith("here.") and got[2][1]
    assert [g[1] for g in got[3:]] == [False, False] and "code" not in str(got)


def test_sentences_on_a_heading_line():
    text = "Before it\n## Notes on feeds.backfill Nous avons constaté que la réplique ignorait les fenêtres. Deux mots.\nAfter it.\n# Short title. Few words.\n# A title with more than eight words in it all"
    got = [(text[a:b], whole) for a, b, whole, _ in langid.sentences(text)]
    assert got == [("Before it", False), ("Notes on feeds.backfill Nous avons constaté que la réplique ignorait les fenêtres.", True), ("Deux mots.", True), ("After it.", True)]
    assert list(langid.sentences("```\n# one two three four five six seven eight nine.\n```")) == []


def test_found_on_a_heading_line(spark):
    rnd = random.Random(13)
    extra = [(2000, "# Notes on feeds.backfill " + sentence("fr", rnd) + " " + sentence("fr", rnd) + "\n\n" + sentence("en", rnd, 14) + " " + sentence("en", rnd, 14), "en")]
    df = spark.createDataFrame(corpus() + extra, "doc_id bigint, text string, lang string")
    assert {(r["doc_id"], r["lang"]) for r in langid.language_cases(df, langid.train(df)).collect() if r["doc_id"] >= 2000} == {(2000, "en"), (2000, "fr")}


def test_found(spark):
    rnd = random.Random(9)
    extra = [
        (1000, sentence("de", rnd) + " " + sentence("de", rnd), "en"), (1001, sentence("fr", rnd), None), (1002, sentence("es", rnd), "spanish"),
        (1003, sentence("en", rnd, 14) + "\n\n" + sentence("de", rnd, 14), "en"), (1004, "Nur kurz.", "en"), (1005, None, None), (1006, "", "en"), (1007, "123 456 / 789.", None),
        (1008, "\n".join(sentence("en", rnd, 14) for _ in range(3000)), "en"),
    ]
    df = spark.createDataFrame(corpus() + extra, "doc_id bigint, text string, lang string")
    models = langid.train(df)
    got = {(r["doc_id"], r["lang"]) for r in langid.language_cases(df, models).collect() if r["doc_id"] >= 1000}
    assert got == {(1000, "de"), (1001, "fr"), (1003, "en"), (1003, "de")}
    every = {r["doc_id"]: r for r in langid.document_languages(df, models).collect()}
    assert every[1005]["verdict"] == every[1004]["verdict"] == every[1006]["verdict"] == "none" and every[1002]["verdict"] == "right"
    seg = [(r["lang"], r["whole"]) for r in langid.segments(df, models).where("doc_id = 1003").orderBy("segment").collect()]
    assert seg == [("en", True), ("de", True)]


def test_held_out_accuracy(spark):
    rnd = random.Random(11)
    models = langid.train(spark.createDataFrame(corpus(), "doc_id bigint, text string, lang string"))
    tests = [(c, sentence(c, rnd)) for c in TEXTS for _ in range(50)]
    right = sum(models.score(langid.scored_words(t))[0] == c for c, t in tests)
    assert right / len(tests) > 0.98


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert langid.language_cases(df, langid.train(df)).collect() == []
