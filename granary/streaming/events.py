"""Audit counts per window and a cache with a time to live, over event streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def audit_counts(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events and their value per window and type; works on a stream (with a watermark) and on a table."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def ttl_hits(times: Column, ttl: float) -> Column:
    """How many of the sorted access times of one key hit the cache; an entry lives ``ttl`` from its insertion."""
    start = F.struct(F.lit(None).cast("double").alias("since"), F.lit(0).cast("long").alias("hits"))

    def step(acc: Column, t: Column) -> Column:
        live = F.coalesce(t - acc["since"] <= ttl, F.lit(False))
        return F.struct(F.when(live, acc["since"]).otherwise(t).alias("since"), (acc["hits"] + live.cast("long")).alias("hits"))

    return F.aggregate(times, start, step, lambda a: a["hits"])


def cache_hits(events: DataFrame, key: str, ttl: float) -> DataFrame:
    """key, accesses, hits over a table of events (key, ts)."""
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return events.groupBy(key).agg(F.array_sort(F.collect_list(t)).alias("_times")).select(key, F.size("_times").cast("long").alias("accesses"), ttl_hits(F.col("_times"), ttl).alias("hits"))


def cache_stream(events: DataFrame, key: str, ttl: float) -> DataFrame:
    """The same over a stream: per batch and key the accesses and hits so far; state is one time and two counts."""

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since, n, hits = state.get if state.exists else (None, 0, 0)
        for t in sorted(x for b in batches for x in b["t"]):
            n += 1
            if since is not None and t - since <= ttl:
                hits += 1
            else:
                since = t
        state.update((since, n, hits))
        yield pd.DataFrame({key: [k[0]], "accesses": [n], "hits": [hits]})

    timed = events.select(key, (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    kind = dict(timed.dtypes)[key]
    return timed.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, accesses long, hits long", "since double, n long, hits long", "update", GroupStateTimeout.NoTimeout)
