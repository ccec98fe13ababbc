"""Whitening against exact fractions and numpy, with vectors that take no part, ties and huge components."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import whitening

ROWS = "vec_id long, embedding array<float>"


def vectors(n=300, d=40, seed=0):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n, d)) @ r.normal(size=(d, d)) * 0.1 + r.normal(size=d)
    return [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(base)]


def plain(rows):
    x = [[int(np.floor(64 * np.float64(np.float32(c)))) + 1_000_000 for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(d)]
    y = [[n * r[i] - sums[i] for i in range(d)] for r in x]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in y), n**3)) for j in range(d)] for i in range(d)])
    return n, y, cov


def test_whitening_equals_exact_sums(spark):
    rows = vectors() + [(7, vectors()[7][1])] * 3
    bad = [(900, None), (901, []), (902, [1.0] * 39 + [None]), (903, [float("nan")] * 40), (904, [float("inf")] + [0.0] * 39), (905, [1.0] * 12)]
    frame = spark.createDataFrame([*rows, *bad, (None, rows[0][1])], ROWS)
    n, y, cov = plain([*rows, (None, rows[0][1])])
    model = whitening.fit(whitening.usable(frame))
    assert model.n == n and np.abs(model.covariance - cov).max() <= 1e-12 * np.abs(cov).max()
    got = whitening.whiten(frame).collect()
    assert len(got) == n * 32 and {r["n"] for r in got} == {n}
    deviation = [sum(v * v for v in r) for r in y]
    by_id = {(r["vec_id"], r["component"]): r for r in got}
    values, axes = np.linalg.eigh(cov)
    for place, (key, _) in enumerate([*rows, (None, None)]):
        for c in range(1, 33):
            r = by_id[key, c]
            want = np.array([v / n for v in y[place]]) @ axes[:, -c] / np.sqrt(values[-c])
            assert abs(abs(r["whitened"]) - abs(want)) < 1e-6 and r["deviation"] == deviation[place]
            assert abs(r["explained"] - values[-c] / np.trace(cov)) < 1e-9
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-6
    w = np.zeros((len(rows), 32))
    for place, (key, _) in enumerate(rows):
        w[place] = [by_id[key, c]["whitened"] for c in range(1, 33)]
    assert np.abs(np.cov(w[:300].T, bias=True) - np.eye(32)).max() < 0.2  # one sign for all rows


def test_sums_do_not_depend_on_chunks_or_partitions(spark, monkeypatch):
    rows = vectors(200, 5)
    one = whitening.fit(whitening.usable(spark.createDataFrame(rows, ROWS).coalesce(1)))
    monkeypatch.setattr(whitening, "CHUNK", 12)
    many = whitening.fit(whitening.usable(spark.createDataFrame(rows, ROWS).repartition(9)))
    assert one.sums == many.sums and (one.covariance == many.covariance).all()


@pytest.mark.parametrize("size", [1e6, 1e12, 1e25])
def test_huge_components(spark, size):
    rows = [(i, [size * (i % 3), -size * (i % 5), float(i)]) for i in range(30)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    model = whitening.fit(whitening.usable(frame))
    bound = float(1 << 61)
    x = [[int(np.floor(min(max(64 * c, -bound), bound))) + 1_000_000 for c in v] for _, v in rows]
    sums = [sum(r[i] for r in x) for i in range(3)]
    cov = [[float(Fraction(sum((30 * r[i] - sums[i]) * (30 * r[j] - sums[j]) for r in x), 30**3)) for j in range(3)] for i in range(3)]
    assert model.sums == sums and np.allclose(model.covariance, cov, rtol=1e-12, atol=0)
    want = [sum((30 * v - s) ** 2 for v, s in zip(r, sums)) for r in x]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(frame).collect()}
    assert got == {i: w if w < 1 << 63 else None for i, w in enumerate(want)}


def test_flat_dimensions_one_row_and_no_rows(spark):
    flat = [(i, [float(i % 4), 2.0, float(i % 4)]) for i in range(16)]
    got = whitening.whiten(spark.createDataFrame(flat, ROWS)).collect()
    assert {r["component"] for r in got} == {1, 2, 3} and all(r["whitened"] == 0 == r["explained"] for r in got if r["component"] > 1)
    assert got[0]["identity_error"] < 1e-9
    alone = whitening.whiten(spark.createDataFrame(flat[:1], ROWS)).collect()
    assert [(r["deviation"], r["whitened"], r["identity_error"]) for r in alone] == [(0, 0.0, 0.0)] * 3
    none = whitening.whiten(spark.createDataFrame([(1, None)], ROWS))
    assert none.count() == 0 and none.columns == whitening.whiten(spark.createDataFrame(flat, ROWS)).columns


def test_clashing_columns(spark):
    frame = spark.createDataFrame(vectors(50, 4), ROWS).select("*", *[F.lit(f"a {c}").alias(c) for c in ("more", "x", "_k", "label", "a.b")])
    got = whitening.whiten(frame)
    assert got.count() == 200 and {tuple(r[c] for c in ("more", "x", "_k", "label", "a.b")) for r in got.collect()} == {("a more", "a x", "a _k", "a label", "a a.b")}
