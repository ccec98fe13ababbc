"""Exact top-k search on repeated rows, large components and empty tables, against brute force."""

import math

import numpy as np
import pytest

from granary.llm import topk

SCHEMA = "vec_id long, embedding array<double>"


def plain(rows, k):
    """The answers in whole numbers; distinct rows only."""
    usable = {(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows}
    want = {}
    for i, q in usable:
        own = {(j, sum(a * b for a, b in zip(q, c))) for j, c in usable if j != i and len(c) == len(q)}
        want[i] = want.get(i, set()) | own
    return {i: sorted(((-s, j) for j, s in own))[:k] for i, own in want.items() if own}


def answers(spark, rows, k=10):
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in topk.top_k(df, df, k).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    return got


def test_repeated_rows(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.normal(size=4)]) for i in range(29)]
    rows += [(50, [3.0, 3.0, 3.0, 3.0])] * 15 + [(51, [3.0, 3.0, 3.0, 3.0])] * 400
    rows += [(60, [1.0, 0.0, 0.0, 0.0]), (60, [0.0, 1.0, 0.0, 0.0])]
    got = answers(spark, rows)
    assert got == plain(rows, 10) and len(got[0]) == 10


def test_large_components(spark):
    rows = [(1, [1.0]), (2, [2e6]), (3, [1.5e6]), (4, [-2e6]), (5, [1e12]), (6, [1e12 + 1.0]), (7, [3.0]), (8, [1e-3])]
    got = answers(spark, rows, 3)
    most = 2**63 - 1
    want = {i: [(max(-most, min(most + 1, s)), j) for s, j in own] for i, own in plain(rows, 8).items()}
    # beyond a long scores are the nearest long, and equal ones go to the smaller id
    assert {i: own for i, own in got.items()} == {i: sorted(own)[:3] for i, own in want.items()}
    assert got[1][2] == (-2048000000 * 1024, 2)


def test_mixed_sizes(spark):
    r = np.random.default_rng(4)
    rows = [(i, [float(x) for x in r.normal(size=6) * 10.0 ** r.integers(0, 7)]) for i in range(120)]
    assert answers(spark, rows, 5) == plain(rows, 5)


def test_empty(spark):
    assert topk.top_k(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("n", [1, 3])
def test_fewer_than_k(spark, n):
    rows = [(i, [float(i), 1.0]) for i in range(n)]
    assert answers(spark, rows) == plain(rows, 10)
