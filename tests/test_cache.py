"""The cache by least use and time to live against a plain one, in blocks and as a stream."""

import random
from datetime import datetime, timedelta

from granary.streaming import cache

SCHEMA = "k long, ts timestamp, n long"


def plain(rows, ttl, capacity):
    """key -> [accesses, hits] of one dictionary in the order of its use."""
    held, out = {}, {}
    for k, t, _ in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[2], -1 if r[0] is None else r[0])):
        one = out.setdefault(k, [0, 0])
        one[0] += 1
        if k is None:
            continue
        since = held.pop(k, None)
        fresh = since is not None and (ttl <= 0 or (t - since).total_seconds() <= ttl)
        one[1] += fresh
        held[k] = since if fresh else t
        while len(held) > capacity:
            held.pop(next(iter(held)))
    return {k: tuple(v) for k, v in out.items()}


def log(seed, rows=900):
    """A key that holds a third of all rows, bursts, ties in time, null keys and times."""
    r, t, out = random.Random(seed), datetime(2024, 1, 1), []
    for n in range(rows):
        t += timedelta(seconds=r.choice([0, 0, 1, 1, 2, 40]))
        k = 0 if r.random() < 0.33 else None if r.random() < 0.02 else r.randint(1, 30)
        out.append((k, None if r.random() < 0.02 else t, n))
    return out


def test_blocks_equal_a_plain_cache(spark):
    for seed, (ttl, capacity) in enumerate([(60.0, 1), (60.0, 2), (300.0, 8), (25.0, 64), (0.0, 5), (10.0, 0), (100000.0, 64)]):
        rows = log(seed)
        got = cache.lru_hits(spark.createDataFrame(rows, SCHEMA), "k", ttl, capacity, ("n",), block_rows=[70, 7, 2000][seed % 3] * 2)
        assert {r["k"]: (r["accesses"], r["hits"]) for r in got.collect()} == plain(rows, ttl, capacity), (ttl, capacity)


def test_least_used_goes_first(spark):
    t = datetime(2024, 1, 1)
    rows = [(k, t + timedelta(seconds=i), i) for i, k in enumerate([1, 2, 1, 3, 2, 1, 3])]
    got = cache.lru_hits(spark.createDataFrame(rows, SCHEMA), "k", 600.0, 2, ("n",), block_rows=2)
    assert {r["k"]: (r["accesses"], r["hits"]) for r in got.collect()} == {1: (3, 1), 2: (2, 0), 3: (2, 0)}


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert cache.lru_hits(empty, "k", 1.0, 4, ("n",)).collect() == []
    t = datetime(2024, 1, 1)
    same = spark.createDataFrame([(7, t, 1)] * 5 + [(None, t, 1), (8, None, 1)], SCHEMA)
    assert {tuple(r) for r in cache.lru_hits(same, "k", 1.0, 4, ("n",), block_rows=2).collect()} == {(7, 5, 4), (None, 1, 0)}


def test_stream(spark, tmp_path):
    rows = [r for r in log(5, 300) if r[0] is not None and r[1] is not None]
    for i in range(0, len(rows), 100):
        spark.createDataFrame(rows[i : i + 100], SCHEMA).selectExpr("n % 1 AS c", "k", "ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("c long, k long, ts timestamp").parquet(str(tmp_path / "in"))
    q = cache.lru_stream(source, "c", "k", 60.0, 6).writeStream.outputMode("update").format("memory").queryName("lru_rows").start()
    q.processAllAvailable()
    q.stop()
    # one batch at once: ties are put by key as text, so the plain cache takes them so as well
    places = {k: i for i, k in enumerate(sorted({str(r[0]) for r in rows}))}
    want = plain([(places[str(k)], t, 0) for k, t, _ in rows], 60.0, 6).values()
    assert tuple(spark.table("lru_rows").collect()[-1])[1:] == (len(rows), sum(h for _, h in want))
