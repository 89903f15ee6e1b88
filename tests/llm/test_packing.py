import random
from collections import defaultdict

import pytest

packing = pytest.importorskip("palimpsest.llm.packing")


def check(rows, sizes, capacity):
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        if r["container_id"] is not None:
            by_bin[r["container_id"]].append((r["place"], r["n_tokens"]))
    for doc, n in sizes:
        own = sorted(by_doc[doc], key=lambda r: r["piece"])
        if n is None:
            assert own[0]["container_id"] is None
            continue
        assert sum(r["n_tokens"] for r in own) == n and len(own) == max(1, -(-n // capacity))
    for parts in by_bin.values():
        end = 0
        for place, n in sorted(parts):
            assert place == end
            end += n
        assert end <= capacity
    return sum(n or 0 for _, n in sizes) / (capacity * max(1, len(by_bin)))


def test_places_are_disjoint_and_texts_whole(spark):
    rnd = random.Random(3)
    sizes = [(i, rnd.choice([0, 1, 7, 50, 99, 100, 101, 250, None, rnd.randrange(1, 100)])) for i in range(2000)]
    df = spark.createDataFrame(sizes, "doc_id bigint, n_tokens bigint")
    rows = packing.pack(df, 100, 16, 700).collect()
    check(rows, sizes, 100)


def test_little_room_is_left(spark):
    rnd = random.Random(4)
    sizes = [(i, int(rnd.lognormvariate(5.5, 0.8)) + 1) for i in range(20_000)]
    rows = packing.pack(spark.createDataFrame(sizes, "doc_id bigint, n_tokens bigint")).collect()
    assert check(rows, sizes, packing.CAPACITY) > 0.98


def test_best_fit_takes_the_tightest_bin_and_closes_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert bins.place(4) == (0, 0) and bins.place(7) == (1, 0)
    assert bins.place(3) == (1, 7)  # exactly full: closed, room for another
    assert bins.place(7) == (2, 0)
    assert bins.place(8) == (3, 0)  # bin 2 was the fullest
    assert bins.place(6) == (0, 4)


def test_an_item_of_exactly_the_capacity_closes_no_bin():
    bins = packing.OpenBins(10, 1)
    assert [bins.place(n) for n in (6, 10, 4)] == [(0, 0), (1, 0), (0, 6)] and bins.made == 2


def test_empty_and_repeated(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, n_tokens bigint")).collect() == []
    rows = packing.pack(spark.createDataFrame([(1, 5), (1, 5), (None, 5)], "doc_id bigint, n_tokens bigint"), 10).collect()
    assert len(rows) == 3 and len({(r["container_id"], r["place"]) for r in rows}) == 3


def test_tokenizers_agree_on_whole_texts(spark):
    public = pytest.importorskip("public_tokenizers")
    df = spark.createDataFrame([(1, "Hello world, hello again."), (2, None), (3, "")], "doc_id bigint, text string")
    a = {r[0]: r[1] for r in packing.token_counts(df, public.path("byte_bpe_50k.tiktoken")).collect()}
    b = {r[0]: r[1] for r in packing.token_counts(df, public.path("byte_bpe_50k.json")).collect()}
    assert a == b and a[2] is None and a[3] == 0 and a[1] > 3
    assert packing.token_counts(df, public.path("piece_bpe_32k.model")).count() == 3
