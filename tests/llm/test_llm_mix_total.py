"""The total of a mix follows the supply, whatever the table's size."""

import os

import pytest

from sieveline.llm import mixing as M
from sieveline.llm import queries as Q

DATA = "/root/testdata"
needs_file = pytest.mark.skipif(not os.path.exists(M.TOKENIZER), reason="no tokenizer file")


@needs_file
@pytest.mark.parametrize("times", [1, 5])
def test_fill(spark, times):
    rows = [(i, "big" if i % 10 else "small", "one two three four five") for i in range(200 * times)]
    df = spark.createDataFrame(rows, "id long, source string, text string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 3), ("gone", 0.1, 2)], "source string, target_share double, max_repeats int")
    chosen, shares = M.mix(df, "id", "source", "text", targets, fill=1.0)
    s = {r.source: r for r in shares.collect()}
    every = s["big"].supply_tokens + s["small"].supply_tokens
    assert every == 1000 * times
    assert s["big"].budget_tokens == every // 2 and s["big"].tokens >= 0.98 * s["big"].budget_tokens and s["big"].note == "met"
    assert s["small"].tokens == 3 * s["small"].supply_tokens and s["small"].note == "capped"
    assert {r.repeats for r in chosen.where("source = 'small'").collect()} == {3}
    assert s["gone"].note == "no tokens"


@needs_file
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_queries_use_the_supply(spark, size):
    d = f"{DATA}/{size}"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    rows = [r for r in Q.p7_shares(spark, d).collect() if r.supply_tokens]
    supply = sum(r.supply_tokens for r in rows)
    assert all(r.budget_tokens == pytest.approx(min(r.target_share * supply, r.supply_tokens * r.max_repeats), abs=2) for r in rows)
    short = [r for r in rows if r.note == "capped"]
    assert short
    assert all(r.tokens == r.supply_tokens * r.max_repeats for r in short)
    assert sum(r.tokens for r in rows) > 0.5 * supply
    more = [r for r in Q.p7_shares_capped(spark, d).collect() if r.supply_tokens]
    assert sum(r.note == "capped" for r in more) > len(short) and any(r.tokens > r.supply_tokens for r in more)
