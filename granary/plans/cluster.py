"""Helpers that keep plans safe on a cluster: lineage cuts, ranks in hot groups, components.

All helpers accept empty inputs and return empty outputs for them.
"""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only on a single machine (a local master) a temporary one is made where none is set; on a
    cluster that is an error, as no executor could read it.
    """
    sc = spark.sparkContext
    if (found := sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")) is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared file system, whatever its kind."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back from there, which cuts its lineage."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def release_shuffles(spark: SparkSession) -> None:
    """Have the shuffle files of finished, cut plans deleted now.

    Spark deletes them once the driver's collector has met the plan, which between large steps of one
    job may be much later than the disk lasts.
    """
    spark.sparkContext._jvm.System.gc()


def same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Null-safe equality of the named columns of both sides."""
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[n]) for n in names])


def rank_in_group(df: DataFrame, keys: list[str], order: list[str], name: str, seed: int = 0) -> DataFrame:
    """Add ``name``: the row's place (from 0) in its group, in a seeded pseudo-random order.

    A group is dealt over salts taken from the high bits of the hash that orders it, so a hot
    group is ranked by many tasks: rows of the salts before, plus the place within the salt.
    Equal rows take neighbouring places in any order. Keys may be null.
    """
    salts = max(64, shuffle_partitions(df.sparkSession))
    tagged = df.withColumn("_h", F.xxhash64(F.lit(seed), *order)).withColumn("_salt", F.pmod(F.shiftrightunsigned("_h", 40), F.lit(salts)))
    counts = tagged.groupBy(*keys, "_salt").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*keys, "_salt", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    joined = tagged.join(before, same(tagged, before, [*keys, "_salt"])).select(tagged["*"], before["_before"])
    place = F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy("_h", *order))
    return joined.withColumn(name, F.col("_before") + place - 1).drop("_h", "_salt", "_before")


#: What a broadcast may hold, as the length of its rows in JSON, and the salts of a join beyond it.
BROADCAST_CHARS, JOIN_SALTS = 16_000_000, 32


def join_small(rows: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", salts: int = JOIN_SALTS) -> DataFrame:
    """``rows`` joined to ``small`` (distinct keys, none null; cut or cheap, as it is read twice).

    ``small`` is broadcast if its measured size is within ``BROADCAST_CHARS``; else it is repeated over
    salts, so that a key that holds a large part of ``rows`` is joined by many tasks (equal rows by one).
    """
    size = small.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] or 0
    if size <= BROADCAST_CHARS:
        return rows.join(F.broadcast(small), keys, how)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    others = [c for c in rows.columns if c not in keys]
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*others), F.lit(salts)).cast("int")).join(salted, [*keys, "_salt"], how).drop("_salt")


def join_references(rows: DataFrame, store: DataFrame, key: str, spread: list[str], salts: int = JOIN_SALTS) -> DataFrame:
    """``rows`` left-joined to ``store`` by ``key``, which a large part of the rows may share.

    Keys with more than a task's share of the rows, at most four for each partition, are counted,
    and the store's rows of those only are repeated over salts; null keys are spread as well.
    ``rows`` is read twice; ``spread`` names columns that tell rows of one key apart.
    """
    counts = cut(rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n")))
    limit = max(1_000, (counts.agg(F.sum("_n")).first()[0] or 0) // (4 * shuffle_partitions(rows.sparkSession)))
    hot = F.broadcast(counts.where(F.col("_n") > limit).select(F.col("_key").alias("_hot")))
    salt = F.when(F.col("_hot").isNotNull() | F.col(key).isNull(), F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")).otherwise(0)
    left = rows.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_salt", salt).drop("_hot")
    every = F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = store.withColumnRenamed(key, "_store_key").join(hot, F.col("_store_key") == F.col("_hot"), "left").withColumn("_store_salt", F.explode(every)).drop("_hot")
    return left.join(right, (F.col(key) == F.col("_store_key")) & (F.col("_salt") == F.col("_store_salt")), "left").drop("_store_key", "_store_salt", "_salt")


def connected_components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """Smallest reachable node of every node of an undirected graph.

    ``edges`` has two columns of one ordered type; the result has ``node`` and ``root``.
    Large-star and small-star rounds: each node's minimum is a partial aggregate, so a star with a
    hot centre is never gathered; it is joined back by key, so a hub's edges stream through one task
    row by row unless they are many enough for adaptive execution to split the join. Self loops and
    repeats are allowed. Raises if ``rounds`` do not suffice (each shortens paths at least by half,
    so 64 are enough for any graph that can be stored).
    """
    a, b = edges.columns
    links = cut(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct())
    state = None
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = links.join(low, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), "b"), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e"))
        links = cut(small.select("e.a", "e.b").where("a < b").distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return links.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        state = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
