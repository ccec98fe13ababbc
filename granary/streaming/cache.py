"""Hits of a cache that evicts by least use and by a time to live, replayed from a log of accesses.

Eviction by least use depends on all keys at once, yet what the cache holds at any moment is only the
``capacity`` keys used last, in that order, whatever has hit. So the log is dealt into blocks of time;
what a block finds in the cache is merged from the keys that earlier blocks used last; and all blocks
are replayed side by side. Only the age of a key that a block has found in the cache is unknown to it:
its accesses up to the first certain miss are left open and settled by a second, per-key pass.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from granary.plans.cluster import cut

#: Accesses of a block, which one task replays in memory.
BLOCK_ROWS = 500_000


class Replay:
    """The cache while a block is replayed: key -> (last access, insertion); an insertion of None is not known."""

    def __init__(self, capacity: int, ttl: int, held: list[tuple[object, int]] = ()):
        self.capacity, self.ttl = capacity, ttl
        self.entries: OrderedDict = OrderedDict((k, (t, None)) for k, t in held)

    def access(self, key: object, t: int) -> bool | None:
        """Whether the access hits; None if that depends on an insertion that is not known."""
        last, since = self.entries.pop(key, (None, None))
        old = last is None or 0 < self.ttl < t - (last if since is None else since)
        if old:
            since = t
        self.entries[key] = (t, since)
        while len(self.entries) > self.capacity:
            self.entries.popitem(last=False)
        return False if old else None if since is None and self.ttl > 0 else True


def _held(blocks: DataFrame, count: int, key: str, capacity: int) -> DataFrame:
    """block, key, last: what each block finds in the cache, from the blocks before it.

    After a round a block has looked back twice as far as before; rounds end once every block has
    found ``capacity`` keys or the start of the log, which for blocks much larger than the cache is
    one round.
    """
    newest = Window.partitionBy("block").orderBy(F.col("last").desc())

    def top(df: DataFrame) -> DataFrame:
        return df.groupBy("block", key).agg(F.max("last").alias("last")).withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= capacity).drop("_n")

    held = cut(top(blocks.select((F.col("block") + 1).alias("block"), key, F.col("at").alias("last")).where(F.col("block") < count)))
    span = 1
    while span < count - 1:
        full = held.where(F.col("block") > span).groupBy("block").count().where(F.col("count") >= capacity).count()
        if full == count - 1 - span:
            break
        earlier = held.withColumn("block", F.col("block") + span).where(F.col("block") < count)
        held = cut(top(held.unionByName(earlier)))
        span *= 2
    return held


def _replay(capacity: int, ttl: int, key: str):
    def run(rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        rows, held = rows.sort_values("place"), held.sort_values("place")
        cache = Replay(capacity, ttl, list(zip(held[key], held["t"].tolist())))
        found: dict = {}
        for k, t in zip(rows[key], rows["t"].tolist()):
            one = found.setdefault(k, [0, 0, []])
            hit = cache.access(k, t)
            one[0] += 1
            if hit is None:
                one[2].append(t)
            else:
                one[1] += hit
                if not hit:
                    one.append(t)
        out = [(k, n, hits, opened, bool(since), since[-1] if since else 0) for k, (n, hits, opened, *since) in found.items()]
        return pd.DataFrame(out, columns=[key, "accesses", "hits", "opened", "known", "since"]).assign(block=rows["block"].iloc[0] if len(rows) else 0)

    return run


def _settle(key: str, ttl: int):
    """Hits among open accesses: a stretch of a key's blocks is a certain miss and what it leaves open up to the next."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        since = 0
        for rows in batches:
            out = []
            for k, first, opened, start in zip(rows[key], rows["first"], rows["opened"], rows["since"]):
                if first:
                    since = int(start)
                    continue
                times, i, missed = np.asarray(opened, dtype=np.int64), 0, 0
                while (i := int(np.searchsorted(times, since + ttl, "right"))) < len(times):
                    since, missed = int(times[i]), missed + 1
                out.append((k, len(times) - missed))
            yield pd.DataFrame(out, columns=[key, "hits"])

    return run


def lru_hits(events: DataFrame, key: str, ttl: float, capacity: int, order: tuple[str, ...] = (), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """key, accesses, hits of one cache for all ``events`` (key, ts, and ``order``, which breaks ties of ts).

    An access that misses puts the key; an entry goes when ``capacity`` other keys were used since, and
    is stale when more than ``ttl`` seconds old (0: never), but keeps its place until it is asked for.
    A null key is never cached; accesses without a time take no part. Of accesses alike in ts and
    ``order`` smaller keys come first. A capacity of 0 keeps nothing.
    """
    timed = events.select(F.col(key), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), *order).where("t IS NOT NULL")
    at = F.struct("t", *order, key)
    keyed = timed.where(F.col(key).isNotNull())
    blocks = max(1, -(-keyed.count() // block_rows))
    dealt = cut(keyed.repartitionByRange(blocks, "t", *order, key).select(key, "t", at.alias("at"), F.spark_partition_id().alias("block")))
    place = F.row_number().over(Window.partitionBy("block").orderBy("at")).alias("place")
    held = _held(dealt, blocks, key, capacity) if capacity > 0 else dealt.select("block", key, F.col("at").alias("last")).limit(0)
    found = held.select("block", key, F.col("last.t").alias("t"), F.row_number().over(Window.partitionBy("block").orderBy("last")).alias("place"))
    kind = dict(timed.dtypes)[key]
    limit = round(ttl * 1e6)
    schema = f"{key} {kind}, accesses long, hits long, opened array<long>, known boolean, since long, block int"
    played = cut(dealt.select(key, "t", "block", place).groupBy("block").cogroup(found.groupBy("block")).applyInPandas(_replay(capacity, limit, key), schema))
    # an open access belongs to the certain miss before it, so a key is spread over its stretches
    before = F.coalesce(F.sum(F.col("known").cast("long")).over(Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = played.select(key, "block", "opened", "known", "since", before.alias("stretch"))
    starts = numbered.where("known").select(key, "block", F.array().cast("array<long>").alias("opened"), "since", (F.col("stretch") + 1).alias("stretch"), F.lit(True).alias("first"))
    opened = numbered.where(F.size("opened") > 0).select(key, "block", "opened", "since", "stretch", F.lit(False).alias("first"))
    # a start comes from an earlier block than what it leaves open
    lined = starts.unionByName(opened).repartition(key, "stretch").sortWithinPartitions(key, "stretch", "block")
    settled = lined.mapInPandas(_settle(key, limit), f"{key} {kind}, hits long")
    parts = played.select(key, "accesses", "hits").unionByName(settled.select(key, F.lit(0).cast("long").alias("accesses"), "hits"))
    nulls = timed.where(F.col(key).isNull()).select(key, F.lit(1).cast("long").alias("accesses"), F.lit(0).cast("long").alias("hits"))
    return parts.unionByName(nulls).groupBy(key).agg(F.sum("accesses").alias("accesses"), F.sum("hits").alias("hits"))


def lru_stream(events: DataFrame, cache: str, key: str, ttl: float, capacity: int) -> DataFrame:
    """The same over a stream of events with one cache for each value of ``cache``: accesses and hits so far.

    State is at most ``capacity`` keys (as text) with their times; a batch's accesses are put in order
    of time, then key, and one that comes in a later batch than its time is taken when it comes.
    """
    limit = round(ttl * 1e6)

    def fold(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        keys, last, since, n, hits = state.get if state.exists else ([], [], [], 0, 0)
        held = Replay(capacity, limit)
        held.entries.update(zip(keys, zip(last, since)))
        for t, k in sorted((int(t), k) for b in batches for t, k in zip(b["t"], b["k"]) if k is not None):
            n += 1
            hits += bool(held.access(k, t))
        state.update(([*held.entries], [t for t, _ in held.entries.values()], [s for _, s in held.entries.values()], n, hits))
        yield pd.DataFrame({cache: [group[0]], "accesses": [n], "hits": [hits]})

    timed = events.select(cache, F.col(key).cast("string").alias("k"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).where("t IS NOT NULL AND k IS NOT NULL")
    kind = dict(timed.dtypes)[cache]
    return timed.groupBy(cache).applyInPandasWithState(fold, f"{cache} {kind}, accesses long, hits long", "keys array<string>, last array<long>, since array<long>, n long, hits long", "update", GroupStateTimeout.NoTimeout)
