"""Whitening of embeddings by covariances from polarisation.

Components become integers x = floor(scale * c) + shift, so that all sums are exact. With n vectors
and sums S the centred value of a component is (n * x - S) / n. One pass sums the squares of the
centred values of every dimension and of every pair's sum of dimensions; as

    Var(a + b) = Var(a) + Var(b) + 2 Cov(a, b)

the difference of the variances is every cross-covariance, and no product of two dimensions is
summed. The values are centred in two steps, both exact: by the whole number m = floor(S / n) before
they are squared, and by the rest r = S - n * m (of the pair: the sum of both rests) afterwards, as
sum (n * x - S)^2 = n^2 * sum (x - m)^2 - n * r^2. The matrix goes to ``eigh``; rows are projected
where they lie.

A task holds one batch of rows and one triangle of sums; d * (d + 1) / 2 sums a task are shuffled,
added as decimals, and only the triangle reaches the driver, whatever the number of rows.

Defined cases: vectors that are null, empty, or hold nulls or non-finite numbers take no part, nor do
those of another length than most have (ties: the longer); components beyond a long's range are cut to
2^61; a sum of squares that fits in no long is null as ``deviation``; components whose variance is no
more than rounding error are 0, explain 0 and are left out of ``identity_error``; repeated rows and
null ids are rows like others; no rows give no rows; other columns are kept by ``project``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT, MOST = 64, 1_000_000, 32
#: Numbers (rows times dimensions) that a task handles at once.
CHUNK = 1 << 20
#: Sums travel as parts below and above this, which decimals add exactly.
_LIMB = 1 << 60


def integers(vectors: Column, scale: int = SCALE, shift: int = SHIFT) -> Column:
    """floor(scale * c) + shift of every component; null for vectors that take no part."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    bound = float(1 << 61)
    whole = F.transform(vectors, lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(bound)), F.lit(-bound))) + shift)
    return F.when((F.size(vectors) > 0) & F.forall(vectors, finite), whole)


def usable(rows: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """more (the row's columns), x: the rows that take part."""
    quoted = [F.col("`" + c.replace("`", "``") + "`").alias(c) for c in rows.columns if c != "embedding"]
    found = rows.select(F.struct(*quoted).alias("more"), integers(F.col("embedding"), scale, shift).alias("x")).where("x is not null")
    lengths = found.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    return found.where(F.size("x") == (most["d"] if most else 0))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of about ``CHUNK`` numbers with their rows as a matrix."""
    for b in batches:
        if b.num_rows:
            d = len(b["x"][0])
            step = max(1, CHUNK // d)
            for a in range(0, b.num_rows, step):
                part = b.slice(a, step)
                yield part, np.asarray(part["x"].flatten()).reshape(part.num_rows, d)


SUMS = "i int, j int, high decimal(38,0), low long"


def _sums(found: dict[tuple[int, int], int]) -> pa.RecordBatch:
    from decimal import Decimal

    keys = list(found)
    parts = [divmod(found[k], _LIMB) for k in keys]
    columns = [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([Decimal(h) for h, _ in parts], pa.decimal128(38, 0)), pa.array([low for _, low in parts], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["i", "j", "high", "low"])


def _added(sums: DataFrame) -> dict[tuple[int, int], int]:
    """The tasks' sums, added exactly: one number for each (i, j)."""
    rows = sums.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low")).collect()
    return {(r["i"], r["j"]): int(r["high"]) * _LIMB + int(r["low"]) for r in rows}


def _total(values: np.ndarray, largest: int) -> list[int]:
    """Exact column sums of integers of at most ``largest``."""
    if largest * len(values) < 1 << 62:
        return values.sum(axis=0).tolist()
    return [int(v) for v in values.astype(object).sum(axis=0)]


def _linear(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of rows as (-1, -1), sum of dimension i as (i, -1)."""
    n, sums = 0, None
    for _, x in _chunks(batches):
        part = _total(x, int(np.abs(x).max()))
        n, sums = n + len(x), part if sums is None else [a + b for a, b in zip(sums, part)]
    if n:
        yield _sums({(-1, -1): n} | {(i, -1): s for i, s in enumerate(sums)})


def _squares(centre: list[int]):
    """Sums of squares of x - centre: of dimension i as (i, i), of the sum of i and j as (i, j)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, d = np.array(centre, np.int64), len(centre)
        sums = [[0] * (d - i) for i in range(d)]
        some = False
        for _, x in _chunks(batches):
            x, some = x - m, True
            largest = int(np.abs(x).max())
            exact = x if 4 * largest * largest < 1 << 62 else x.astype(object)
            for i in range(d):
                both = exact[:, i:] + exact[:, i : i + 1]
                both[:, 0] = exact[:, i]
                for k, s in enumerate(_total(both * both, 4 * largest * largest)):
                    sums[i][k] += int(s)
        if some:
            yield _sums({(i, i + k): s for i in range(d) for k, s in enumerate(sums[i])})

    return run


@dataclass
class Whitening:
    """Sums of the fit list, and its covariance's unit eigenvectors (columns) by falling eigenvalue."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @property
    def explained(self) -> np.ndarray:
        trace = float(np.trace(self.covariance))
        return self.values / trace if trace > 0 else np.zeros(len(self.values))


def fit(rows: DataFrame) -> Whitening | None:
    """Of rows with integers ``x`` (``usable``); None without rows. Two passes over them."""
    vectors = rows.select("x")
    linear = _added(vectors.mapInArrow(_linear, SUMS))
    if not linear:
        return None
    n = linear.pop((-1, -1))
    d = len(linear)
    sums = [linear[i, -1] for i in range(d)]
    centre = [s // n for s in sums]
    rest = [s - n * m for s, m in zip(sums, centre)]
    raw = _added(vectors.mapInArrow(_squares(centre), SUMS))
    # sums of (n * x - S)^2, exact
    square = lambda i, j: n * n * raw[i, j] - n * (rest[i] if i == j else rest[i] + rest[j]) ** 2
    own = [square(i, i) for i in range(d)]
    covariance = np.zeros((d, d))
    for i in range(d):
        covariance[i, i] = own[i] / n**3
        for j in range(i + 1, d):
            covariance[i, j] = covariance[j, i] = (square(i, j) - own[i] - own[j]) / (2 * n**3)
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    noise = max(float(values[0]), 0.0) * d * np.finfo(float).eps
    return Whitening(n, sums, covariance, np.where(values > noise, values, 0.0), axes)


def _whitened(x: np.ndarray, model: Whitening, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The centred rows (exact integers n * x - S), and their whitened components."""
    small = np.abs(x).max() < (1 << 62) // max(1, model.n) and max(map(abs, model.sums)) < 1 << 62
    centred = x * model.n - np.array(model.sums, np.int64) if small else x.astype(object) * model.n - np.array(model.sums, object)
    values = model.values[:most]
    scale = np.divide(1.0, np.sqrt(values), out=np.zeros(len(values)), where=values > 0)
    # an integer over n is rounded once
    exact = centred / model.n if small else np.array([[v / model.n for v in row] for row in centred], float)
    return centred, exact @ model.vectors[:, :most] * scale


def _deviations(centred: np.ndarray) -> list[int | None]:
    largest = int(np.abs(centred).max())
    if largest * largest * centred.shape[1] < 1 << 63:
        c = centred.astype(np.int64)
        return (c * c).sum(axis=1).tolist()
    found = [sum(int(v) ** 2 for v in row) for row in centred]
    return [v if v < 1 << 63 else None for v in found]


def identity_error(rows: DataFrame, model: Whitening, most: int = MOST) -> float:
    """Largest absolute entry of the whitened components' covariance minus the identity."""
    k = int((model.values[:most] > 0).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second, some = np.zeros(k), np.zeros((k, k)), False
        for _, x in _chunks(batches):
            w, some = _whitened(x, model, k)[1], True
            first, second = first + w.sum(axis=0), second + w.T @ w
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k + 1), pa.int32()), pa.array([first.tolist(), *second.tolist()], pa.list_(pa.float64()))], ["i", "sums"])

    parts = rows.select("x").mapInArrow(run, "i int, sums array<double>").select("i", F.posexplode("sums").alias("j", "s"))
    total = np.zeros((k + 1, k))
    for r in parts.groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        total[r["i"], r["j"]] = r["s"] / model.n
    # the means are rounding error, as the rows are centred
    return float(np.abs(total[1:] - np.outer(total[0], total[0]) - np.eye(k)).max(initial=0.0))


def project(rows: DataFrame, model: Whitening, most: int = MOST) -> DataFrame:
    """more, deviation, whitened (array) of every row of ``usable``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _chunks(batches):
            centred, w = _whitened(x, model, most)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([part["more"], pa.array(_deviations(centred), pa.int64()), lists], ["more", "deviation", "whitened"])

    form = rows.select("more", F.lit(None).cast("long").alias("deviation"), F.lit(None).cast("array<double>").alias("whitened")).schema
    return rows.mapInArrow(run, form)


def whiten(vectors: DataFrame, most: int = MOST) -> DataFrame:
    """Columns beside ``embedding``, component (from 1), n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    rows = usable(vectors)
    model = fit(rows)
    others = [F.col("more")[c].alias(c) for c in rows.schema["more"].dataType.names if c not in ("component", "n", "deviation", "whitened", "explained", "identity_error")]
    if model is None:
        return rows.select(*others, *[F.lit(None).cast(k).alias(c) for c, k in (("component", "int"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))])
    shares = F.array(*[F.lit(float(v)) for v in model.explained[:most]])
    each = project(rows, model, most).select("more", "deviation", F.posexplode("whitened").alias("_k", "whitened"))
    return each.select(*others, (F.col("_k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("_k")).alias("explained"), F.lit(identity_error(rows, model, most)).alias("identity_error"))
