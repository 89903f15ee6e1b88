import random

import pytest

components = pytest.importorskip("palimpsest.llm.components")


def union_find(pairs):
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return {x: top(x) for x in up}


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_match_union_find(spark, seed):
    rnd = random.Random(seed)
    pairs = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)]  # a chain
    pairs += [("hub", f"s{i}") for i in range(80)]  # a star
    pairs += [(f"r{rnd.randrange(80)}", f"r{rnd.randrange(80)}") for _ in range(50)] + [("q", "q"), (None, "z"), ("c001", "c000")]
    df = spark.createDataFrame(pairs, "u string, v string")
    got = {r["node"]: r["group_id"] for r in components.groups(df).collect()}
    assert got == union_find(pairs)


def test_no_links(spark):
    assert components.groups(spark.createDataFrame([], "u string, v string")).collect() == []


def test_entry_links(spark):
    rows = [
        ("n", "M-00000001", 1, ["M-00000009"], None), ("n", "M-00000001", 2, ["M-00000002", "node-elm", ""], "M-00000001"),
        ("n", "M-00000002", 1, None, "L-0000000a"), ("m", "M-00000002", 1, [], None), ("n", "M-00000003", 1, None, None),
    ]
    df = spark.createDataFrame(rows, "namespace string, id string, updated_at int, merged_from array<string>, consolidated_into string")
    got = {tuple(r) for r in components.entry_groups(df).collect()}
    assert got == {("n", x, "L-0000000a") for x in ("M-00000001", "M-00000002", "L-0000000a")}
