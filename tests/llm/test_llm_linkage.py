import random

import numpy as np

from sieveline.llm import linkage as L


def function(seed, guard=False, skip=None, rename=False):
    r = random.Random(seed)
    names = [f"v{seed}_{i}" for i in range(6)]
    out = [f"int fn{seed}_do(struct s{seed} *{names[0]}) {{"]
    for i in range(14):
        a, b = r.choice(names), r.choice(names)
        out.append(r.choice([f"{a} = {b} + {r.randint(2, 4000)};", f"call{seed}_{i}({a}, {r.randint(2, 4000)});", f"if ({a} == {b}) return {r.randint(2, 90)};", f"{a}->field{i} = {b};"]))
    if guard:
        out.insert(6, f"if ({names[1]} > sizeof({names[2]}->x)) return -1;")
    if skip:
        del out[skip]
    text = "\n".join([*out, "}"])
    return text.replace(names[3], "renamed_one") if rename else text


def test_links(spark):
    left = [(i, function(i, guard=i % 2 == 0), str(1 - (i % 2 == 0)), None, "x") for i in range(40)] + [(500, None, "1", None, "x"), (501, "", "1", None, "x"), (None, "int a;", "1", None, "x")]
    right = []
    for i in range(0, 40, 2):
        right.append((9000 + i, "o1", function(i, guard=True, skip=3), 0, None))
        right.append((9001 + i, "o1", function(i, guard=False, rename=True), 1, None))
        right.append((9500 + i, "o2", function(i, guard=True, rename=True), 0, "CWE-20"))
    right += [(9900 + i, "o1", function(700 + i), 0, None) for i in range(15)] + [(9999, "o1", None, 1, None)]
    a = spark.createDataFrame(left, "unique_id long, code string, gold_label string, gold_cwe_id string, record string")
    b = spark.createDataFrame(right, "func_id long, origin string, func string, target int, cwe string")
    args = (("unique_id", "code", "gold_label", "gold_cwe_id"), ("func_id", "func", "target", "cwe"), "origin")
    got = {(r.left_id, r.right_id) for r in L.match_functions(a, b, *args).collect()}
    want = {(i, 9000 + i) for i in range(0, 40, 2)} | {(i, 9500 + i) for i in range(0, 40, 2)}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 2
    assert len({r for _, r in got}) == len(got)
    assert L.match_functions(a.limit(0), b, *args).collect() == []
    assert L.match_functions(a, b.limit(0), *args).collect() == []


def test_no_fix_template_is_given():
    """Signs of the state are learned: the module names no statement form."""
    import inspect

    assert "min (" not in inspect.getsource(L) and "sizeof (" not in inspect.getsource(L)


def test_expectation_maximisation_recovers_the_classes():
    rng = np.random.default_rng(2)
    truth = rng.random(4000) < 0.2
    p = np.where(truth[:, None], [0.95, 0.9, 0.8], [0.1, 0.2, 0.3])
    x = (rng.random((4000, 3)) < p).astype(int)
    pat, inv, n = np.unique(x, axis=0, return_inverse=True, return_counts=True)
    post = L.expectation_maximisation(pat, n.astype(float), np.where(pat.sum(1) >= 2, 0.8, 0.2))
    assert ((post[inv.ravel()] > 0.5) == truth).mean() > 0.93
    assert len(L.expectation_maximisation(np.zeros((0, 3), int), np.zeros(0), np.zeros(0))) == 0
