import os

import pytest

from gristmill.llm import mixing as M

pytestmark = pytest.mark.skipif(not os.path.exists(M.VOCABULARY), reason="no vocabulary file")


def make(spark, rows, targets):
    return spark.createDataFrame(rows, "doc_id long, source string, text string, tokens int"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


def test_shares(spark):
    rows = [(i, ["Big-One ", "big_one", "BIG_ONE"][i % 3], "some words of text " * (i % 5 + 1), 0) for i in range(3000)]
    rows += [(10_000 + i, "small", "other words of text " * 3, 0) for i in range(100)] + [(20_000, None, "x", 0), (20_001, "unwanted", "x y z", 0), (20_002, "small", None, 0), (20_003, "small", "", 0)]
    docs, targets = make(spark, rows, [("big_one", 0.6, 1), ("small", 0.3, 4), ("absent", 0.1, 5)])
    mix = M.Mixture(docs, targets)
    report = {r.source: r for r in mix.shares.collect()}
    chosen = mix.selected.collect()
    assert {r.source for r in chosen} == {"big_one", "small"} and len({r.doc_id for r in chosen}) == len(chosen)
    assert all(1 <= r.copies <= (1 if r.source == "big_one" else 4) for r in chosen)
    total = sum(p["available"] for p in mix.plan)
    big = report["big_one"]
    assert abs(big.taken - 0.6 * total) <= 40 and not big.out_of_reach
    small = report["small"]
    assert small.out_of_reach and small.taken == 4 * small.available
    assert report["absent"].taken == 0 and report["absent"].out_of_reach and report["absent"].reached_share == 0
    assert abs(sum(r.reached_share for r in report.values()) - 1) < 1e-5
    assert sum(r.tokens * r.copies for r in chosen) == big.taken + small.taken
    again = M.Mixture(docs.repartition(7), targets)
    assert sorted(map(tuple, again.selected.collect())) == sorted(map(tuple, chosen))


def test_partial_repeats_and_empty(spark):
    docs, targets = make(spark, [(i, "a", "three little words", 0) for i in range(100)] + [(1000 + i, "b", "three little words", 0) for i in range(100)], [("a", 0.75, 2), ("b", 0.25, 1)])
    mix = M.Mixture(docs, targets)
    copies = {s: sum(r.copies for r in mix.selected.filter(f"source = '{s}'").collect()) for s in "ab"}
    assert copies == {"a": 150, "b": 50}
    empty = M.Mixture(docs.limit(0), targets)
    assert empty.selected.collect() == [] and {r.taken for r in empty.shares.collect()} == {0}
    nothing = M.Mixture(docs, targets.limit(0))
    assert nothing.selected.collect() == [] and nothing.shares.collect() == []


def test_token_counts_are_those_of_the_vocabulary(spark):
    docs = spark.createDataFrame([(1, "a", "Hello, wörld 123"), (2, "a", None)], "doc_id long, source string, text string")
    assert {r.doc_id: r.tokens for r in M.token_counts(docs).collect()} == {1: 6, 2: 0}
