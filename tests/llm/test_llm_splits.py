import random

import pytest
from pyspark.sql import functions as F

from sieveline.llm import splits as S


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("limit", [2_000_000, 40, 5])
def test_components_against_brute_force(spark, limit):
    random.seed(limit)
    links = [(f"n{random.randint(0, 150)}", f"n{random.randint(0, 150)}") for _ in range(110)] + [(f"c{i}", f"c{i + 1}") for i in range(60)] + [(None, "x"), ("y", None), ("z", "z")]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a and b and a != b:
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    want = {}
    for x in parent:
        want.setdefault(find(x), set()).add(x)
    got = dict(rows(S.connected_components(spark.createDataFrame(links, "a string, b string").repartition(6), task_links=limit)))
    assert got == {x: min(g) for g in want.values() for x in g}


def test_components_of_nothing(spark):
    assert rows(S.connected_components(spark.createDataFrame([], "a string, b string"))) == []


@pytest.mark.parametrize("raw,key", [("Foo-Bar", "foobar"), (" mirror/foo_bar.git ", "foobar"), ("https://x.example/u/FooBar.git", "foobar"), ("foo bar2", "foobar2"), ("N/A", None), ("-", None), ("", None), (None, None), ("  ", None), ("Unknown", None), ("foo.git/", "foo")])
def test_project_key(spark, raw, key):
    assert spark.createDataFrame([(raw,)], "n string").select(S.project_key(F.col("n"))).first()[0] == key


def greedy(sizes, targets):
    total = sum(sizes)
    gap = {k: total * v / sum(targets.values()) for k, v in targets.items()}
    count = {}
    for s in sorted(sizes, reverse=True):
        k = max(targets, key=lambda k: gap[k])
        gap[k] -= s
        count[s, k] = count.get((s, k), 0) + 1
    return count


@pytest.mark.parametrize("seed", range(6))
def test_allotment_in_bulk_is_the_greedy_one(seed):
    random.seed(seed)
    sizes = [random.choice([1, 1, 1, 2, 3, 7, 50]) for _ in range(random.choice([1, 10, 400, 3000]))]
    targets = {"train": 0.8, "validation": 0.1, "test": 0.1}
    hist = {}
    for s in sizes:
        hist[s] = hist.get(s, 0) + 1
    got = {(s, k): hi - lo for s, k, lo, hi in S.allot(list(hist.items()), targets)}
    load = lambda c: {k: sum(s * n for (s, k2), n in c.items() if k2 == k) for k in targets}
    want = greedy(sizes, targets)
    assert sum(got.values()) == len(sizes)
    assert all(abs(load(got)[k] - load(want)[k]) <= max(sizes) for k in targets)
    assert sum(n for (s, _), n in got.items() if s == max(sizes)) == hist[max(sizes)]


def test_groups_stay_together(spark):
    random.seed(1)
    data = [(i, random.choice(["big"] * 20 + [f"p{j}" for j in range(30)] + ["", None, "n/a"]), "x") for i in range(900)]
    data += [(901, "BIG", "x"), (902, "alias-1", "x"), (903, "mirror/alias2", "x"), (904, None, "x"), (904, None, "x"), (None, "big", "x")]
    df = spark.createDataFrame(data, "id long, grp string, new_split string")
    aliases = spark.createDataFrame([("alias1", "alias2"), ("alias2", "big"), (None, "q")], "alias string, project string")
    got = S.group_splits(df, "id", "grp", aliases).collect()
    assert len(got) == len(data)
    seen = {}
    for r in got:
        if r.group_key:
            seen.setdefault(r.group_key, set()).add(r.new_split)
    assert all(len(s) == 1 for s in seen.values())
    by_id = {r.id: r for r in got}
    assert by_id[901].group_key == by_id[902].group_key == by_id[903].group_key == by_id[None].group_key
    share = sum(r.new_split == "train" for r in got) / len(got)
    assert 0.75 < share < 0.85


def test_empty_and_tiny(spark):
    e = spark.createDataFrame([], "id long, grp string")
    assert rows(S.group_splits(e, "id", "grp")) == []
    one = spark.createDataFrame([(1, "a"), (2, None)], "id long, grp string")
    assert len(rows(S.group_splits(one, "id", "grp"))) == 2


def test_leaks(spark):
    df = spark.createDataFrame([(1, "a", "train"), (2, "A ", "test"), (3, "b", "test"), (4, None, "test"), (5, None, "train"), (6, "c", "validation"), (7, "d", " Train"), (8, "n/a", "test")], "id long, p string, s string")
    aliases = spark.createDataFrame([("c", "x"), ("x", "d")], "alias string, project string")
    assert sorted(r[0] for r in rows(S.split_leaks(df, "id", "p", "s", aliases))) == [2, 6]
    assert rows(S.split_leaks(df.limit(0), "id", "p", "s", aliases)) == []
