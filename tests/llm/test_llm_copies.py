import random
from collections import Counter

import pytest

from sieveline.llm import formatting as D
from sieveline.llm import overlap as O

HEAD = "/*\n * file: a.c\n * owner: team-x\n */\n"
BODY = "int f(struct s *p) {\n  struct t v = { .alpha = 1, .beta = g(2) };\n  return p->x;\n}"


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_copies_by_layout_case_order(spark):
    texts = [HEAD + BODY, (HEAD + BODY).upper().replace("\n", "\r\n"), "/* * owner: team-x * file: a.c */ " + BODY.replace("\n", " "), HEAD + BODY.replace(".alpha = 1, .beta = g(2)", ".beta=g(2),.alpha=1,"),
             HEAD + BODY.replace("x;", "y;"), BODY, BODY.replace("struct s *p", "struct p *s"), None, "", ";;", "x" * 200_000, "X" * 200_000]
    df = spark.createDataFrame([(i + 1, t, "k", 0) for i, t in enumerate(texts)], "id long, code string, tuple string, keep int").repartition(3)
    assert sorted(rows(D.superfluous(df, "id", "code"))) == [(1, 2), (1, 3), (1, 4), (9, 10), (11, 12)]
    assert dict(rows(D.collapse(df, "id", "code"))) == {1: 4, 5: 1, 6: 1, 7: 1, 9: 2, 11: 2}


def test_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(5, "a b"), (5, "a b"), (3, "A;B"), (None, "a b")], "id long, code string")
    assert rows(D.superfluous(df, "id", "code")) == [(3, 5)]
    assert rows(D.collapse(df.limit(0), "id", "code")) == []


def test_nested_field_lists():
    a = "{ .a = { .x = 1, .y = 2 }, .b = 3 }"
    b = "{ .b = 3, .a = { .y = 2, .x = 1 } }"
    assert D.canonical(D.BODY, a) == D.canonical(D.BODY, b)
    assert D.canonical(D.BODY, a) != D.canonical(D.BODY, a.replace("3", "4"))


def brute(data, similarity, tokens, n):
    out = set()
    for i, t, s in data:
        for j, u, z in data:
            if t and u and s in ("test", "validation") and z == "train":
                a, b = Counter(O.ngrams(t, tokens, n)), Counter(O.ngrams(u, tokens, n))
                if a and b and sum((a & b).values()) >= similarity * max(sum(a.values()), sum(b.values())) - 1e-9:
                    out.add((i, j))
    return out


@pytest.mark.parametrize("n,similarity", [(1, 0.85), (5, 0.8), (1, 0.5)])
def test_cross_split_pairs_against_brute_force(spark, n, similarity):
    random.seed(n)
    base = [[random.choice("abcdefghijklmnopqrstuvwxyz") * random.randint(1, 3) for _ in range(random.randint(3, 40))] for _ in range(25)]
    data = []
    for i in range(160):
        t = list(random.choice(base))
        for _ in range(random.randint(0, 4)):
            t[random.randrange(len(t))] = random.choice(["zz", "q1", "w"])
        data.append((i, " ".join(t), random.choice(["train", "test", "validation", "other", None])))
    data += [(900, None, "train"), (901, "", "test"), (902, "", "train"), (903, "...", "test"), (904, "hot " * 30, "train"), (905, "HOT " * 30, "test"), (906, "hot " * 30, "test")]
    df = spark.createDataFrame(data, "id long, text string, split string").repartition(4)
    got = [(r.held_id, r.train_id) for r in O.cross_split_pairs(*O.cross_split_classes(df, "id", "text", "split", O.words, n, similarity)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(data, similarity, O.words, n)


def test_code_runs_ignore_comments():
    assert O.code_runs("a /* b */ c // d\n E_1") == ["a", "c", "e_1"]


def test_classes_count_links_without_pairs(spark):
    data = [(i, "a b c d e f g h i j", "test") for i in range(40)] + [(100 + i, "A b c  d e f g h i j", "train") for i in range(50)] + [(200, "a b c d e f g h i k", "train"), (300, "z", "test")]
    df = spark.createDataFrame(data, "id long, text string, split string")
    links, members = O.cross_split_classes(df, "id", "text", "split", O.words, 1, 0.85)
    assert links.count() == 2 and members.count() == 92
    assert sorted(rows(O.overlap_counts(links, members))) == [(i, 0, 51) for i in range(40)]
    assert O.cross_split_pairs(links, members).count() == 40 * 51


def test_overlap_report(spark):
    df = spark.createDataFrame([(1, "a b c", "train", "x"), (2, "A b  c", "test", None), (3, "q r", "test", "x")], "id long, text string, split string, src string")
    counts = O.overlap_counts(*O.cross_split_classes(df, "id", "text", "split", O.words, 1, 0.85))
    got = {(r.split, r.source): (r.held_records, r.overlapping, r.pairs) for r in O.overlap_report(df, "id", "split", "src", counts).collect()}
    assert got == {("test", None): (1, 1, 1), ("test", "x"): (1, 0, 0)}
    assert rows(O.cross_split_pairs(*O.cross_split_classes(df.limit(0), "id", "text", "split", O.words))) == []


def test_each_distinct_value_is_canonicalised_once(spark, monkeypatch, tmp_path):
    df = spark.createDataFrame([(i, HEAD + BODY) for i in range(30)] + [(99, HEAD + BODY.upper())], "id long, code string").repartition(6)
    values = df.select("code").mapInPandas(D._values, "raw binary, field int, value string").repartition("raw").mapInPandas(D._canonicalise, "raw binary, digest binary")
    got = rows(values)
    assert len(got) == len({r[0] for r in got}) and len({bytes(r[1]) for r in got if r[1]}) < len(got)


def test_only_candidates_that_can_be_alike_are_compared(spark, monkeypatch):
    """Records that share words but cannot be alike: neither what one side lacks nor unlike bags lead to texts."""
    random.seed(8)
    data = [(i, " ".join(f"w{random.randrange(60)}" for _ in range(60)), "test" if i % 2 else "train") for i in range(120)]
    data += [(200, data[0][1] + " tail", "test"), (201, "only here " * 9, "test")]
    kept = {}
    monkeypatch.setattr(O, "materialize", lambda df, name, f=O.materialize: kept.setdefault(name, f(df, name)))
    monkeypatch.setattr(O, "release", lambda *tables: None)
    df = spark.createDataFrame(data, "id long, text string, split string").repartition(3)
    got = {(r.held_id, r.train_id) for r in O.cross_split_pairs(*O.cross_split_classes(df, "id", "text", "split", O.words, 1, 0.85)).collect()}
    assert got == brute(data, 0.85, O.words, 1) == {(200, 0)}
    assert kept["hits"].count() > 20 and kept["able"].count() == 1 and kept["texts"].count() == 2
    assert all(len(r.grams) == 0 for r in kept["lookups"].where("record = 201").collect())


def test_texts_sought_by_flags(spark, monkeypatch):
    monkeypatch.setattr(O, "fits_broadcast", lambda df: False)
    rows = spark.range(5000).selectExpr("id AS record", "concat('t', id) AS text")
    reps = spark.range(0, 5000, 100).selectExpr("id AS record", "id + 1 AS class")
    assert sorted((r.record, r.text) for r in O._texts(rows, reps).collect()) == [(i, f"t{i}") for i in range(0, 5000, 100)]
