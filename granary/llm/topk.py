"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Vectors are dealt to shards by hash. A task holds one shard: its distinct vectors, and for each
dimension the list of them sorted by that component. Queries stream through it in batches; for
each the lists are read from their better ends, step by step, every new vector is scored, and
the reading stops once the threshold (the best score that an unread vector could have) lies
below the k-th score, or once no vector is unread. The shards' answers are merged by a window over k rows a shard.

Defined cases: null vectors, empty ones, and those with null, NaN or infinite components take no
part, as query or as candidate; vectors are compared with those of their own length; equal
scores go to the smaller id; rows that repeat both id and vector count once, as query and as
candidate; equal vectors of different ids are all answers in their own right, different vectors of
one id are as many candidates (and a query of such an id is answered for all of its vectors
together); rows with a null id take no part. Components of any size are exact: vectors whose
products could exceed 53 bits are scored in whole numbers. A score beyond the range of a long,
which the result's type can't hold, is given as the nearest long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.plans.cluster import cut

#: Candidates in a shard: bounds a task's memory (64 dimensions: about 30 MB with its lists).
SHARD_ROWS = 30_000
#: A smaller table is dealt to so many shards that each has this many rows.
SMALL_SHARD_ROWS = 2_500
#: Components up to this size have exact sums of products in a double (up to 2**9 dimensions).
PLAIN = 2.0**22
_whole = np.frompyfunc(int, 1, 1)


def usable(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """Distinct vec_id, v (scale * x, as doubles) of the usable vectors; the floor is taken in numpy."""
    x = F.col("embedding")
    ok = x.isNotNull() & (F.size(x) > 0) & F.col("vec_id").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(F.coalesce(ok, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: c.cast("double") * F.lit(float(scale))).alias("v"))


class Shard:
    """Distinct vectors of one length with their sorted lists; ``plain``: all components are small."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int, plain: bool):
        order = np.argsort(ids, kind="stable")
        ids, rows = ids[order], rows[order]
        self.rows, inverse = np.unique(rows, axis=0, return_inverse=True)
        inverse = inverse.ravel()
        by = np.argsort(inverse, kind="stable")
        starts = np.searchsorted(inverse[by], np.arange(len(self.rows) + 1))
        # the k smallest ids of a vector and one more, in case the query is among them
        self.ids = [np.unique(ids[by[a:b]])[: k + 1] for a, b in zip(starts, starts[1:])]
        self.order = np.argsort(self.rows, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(self.rows, self.order, axis=0)
        self.plain = plain

    def top(self, query_id: int, q: np.ndarray, k: int) -> tuple[list[tuple[int, int]], int]:
        """The k best (id, score) and how many entries of each list were read."""
        n, dims = len(self.rows), np.flatnonzero(q)
        if len(dims) == 0:
            dims = np.array([0])
        down = q[dims] > 0
        plain = self.plain and bool((np.abs(q) < PLAIN).all()) and len(q) <= 512
        query = q if plain else _whole(q)
        seen = np.zeros(n, bool)
        best: list[tuple[int, int]] = []
        at, step, unread = 0, max(2, k // 4), n
        while unread:
            upto = min(n, at + step)
            # sorted access: the next `step` entries of every list, from its better end
            fresh = np.zeros(n, bool)
            fresh[self.order[n - upto : n - at, dims[down]]] = True
            fresh[self.order[at:upto, dims[~down]]] = True
            fresh &= ~seen
            seen |= fresh
            fresh = np.flatnonzero(fresh)
            unread -= len(fresh)
            if len(fresh):
                scores = self.rows[fresh] @ query if plain else _whole(self.rows[fresh]) @ query
                if len(best) >= k:
                    keep = scores >= -best[k - 1][0]
                    fresh, scores = fresh[keep], scores[keep]
                if plain and len(fresh) > 4 * k:
                    cutoff = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
                    fresh, scores = fresh[scores >= cutoff], scores[scores >= cutoff]
                found = [(-int(s), int(i)) for r, s in zip(fresh, scores) for i in self.ids[r] if i != query_id]
                best = sorted(best + found)[:k]
            at, step = upto, step + step // 2
            if unread and len(best) >= k:
                edge = np.where(down, self.sorted[n - 1 - at, dims], self.sorted[at, dims])
                limit = float(edge @ q[dims]) if plain else _whole(edge) @ query[dims]
                if -best[k - 1][0] > limit:
                    break
        return [(i, -s) for s, i in best], at


def shards_of(parts: list[tuple[int, np.ndarray]], k: int) -> list[Shard]:
    """By length, those of small components apart, so that a few large ones don't slow the others down."""
    by: dict[tuple[int, bool], list] = {}
    for p in parts:
        by.setdefault((len(p[1]), bool((np.abs(p[1]) < PLAIN).all())), []).append(p)
    return [Shard(np.array([p[0] for p in ps]), np.array([p[1] for p in ps]), k, plain) for (_, plain), ps in by.items()]


def _search(k: int):
    least, most = -(2**63), 2**63 - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard_id, parts, shards = None, [], None
        for batch in batches:
            sid, kind = batch["shard"].to_numpy(), batch["is_query"].to_numpy(zero_copy_only=False)
            ids, vectors = batch["vec_id"].to_numpy(), batch["v"]
            offsets, flat = np.asarray(vectors.offsets), np.floor(vectors.values.to_numpy(zero_copy_only=False)) + 0.0
            out: list[tuple[int, int, int]] = []
            for i in range(len(ids)):
                v = flat[offsets[i] : offsets[i + 1]]
                if sid[i] != shard_id:
                    shard_id, parts, shards = sid[i], [], None
                if not kind[i]:
                    parts.append((ids[i], v))
                    continue
                if shards is None:  # candidates sort before queries
                    shards, parts = shards_of(parts, k), []
                for shard in shards:
                    if shard.rows.shape[1] == len(v):
                        out += [(int(ids[i]), c, max(least, min(most, s))) for c, s in shard.top(int(ids[i]), v, k)[0]]
            yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], pa.int64()) for j in range(3)], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024) -> DataFrame:
    """The k best (query_id, rank, vec_id, score) of every query, itself excluded.

    ``vectors`` and ``queries`` have vec_id and embedding. Each query meets every shard: that is
    the stated work of a full search; queries stream, so a task holds one shard and one batch.
    Repeats are merged before the deal, so a row that is repeated very often is no hot shard.
    """
    base, asked = cut(usable(vectors, scale).distinct()), usable(queries, scale).distinct()
    n = base.count()
    shards = max(1, -(-n // SHARD_ROWS), min(24, n // SMALL_SHARD_ROWS))
    shard = F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int")
    sharded = base.select(shard.alias("shard"), F.lit(False).alias("is_query"), "vec_id", "v")
    spread = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("is_query"), "vec_id", "v")
    # one task a shard: two shards never meet in a partition by their ids' hashes
    dealt = sharded.unionByName(spread).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "is_query")
    found = dealt.mapInArrow(_search(k), "query_id long, vec_id long, score long").distinct()
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
