"""Incremental builds on a registry of documents: what to skip, mark, process, prune and purge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SIGNATURE = ["content_hash", "parser_version", "chunking_version", "embedding_model", "embedding_version"]


def plan_build(disk: DataFrame, registry: DataFrame) -> DataFrame:
    """path, action (skip, duplicate or process), duplicate_of for every file on disk.

    A file is skipped if its registry row has the same signature and is active, or is a duplicate
    of an active document; it is a duplicate if another path's active row has the signature.
    """
    active = registry.where("status = 'active'")
    live = registry.alias("r").join(active.select(F.col("document_id").alias("canonical")), F.col("r.duplicate_of") == F.col("canonical"), "left")
    usable = live.where("status = 'active' or (status = 'duplicate' and canonical is not null)").select(F.col("r.source_path").alias("path"), *[F.col(f"r.{s}") for s in SIGNATURE], F.lit(True).alias("same")).distinct()
    latest = active.groupBy(*SIGNATURE).agg(F.max_by(F.struct("document_id", "source_path"), F.struct("updated_at", "document_id")).alias("first"))
    out = disk.join(usable, ["path", *SIGNATURE], "left").join(latest, SIGNATURE, "left")
    other = F.col("first").isNotNull() & (F.col("first.source_path") != F.col("path"))
    return out.select("path", F.when(F.col("same"), "skip").when(other, "duplicate").otherwise("process").alias("action"), F.when(F.col("same").isNull() & other, F.col("first.document_id")).alias("duplicate_of"))


def purge(disk: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry rows whose path is gone."""
    return registry.where("status <> 'deleted'").join(disk.select(F.col("path").alias("source_path")).distinct(), "source_path", "left_anti")


def prune(chunks: DataFrame, registry: DataFrame) -> DataFrame:
    """Chunks (document_id, version) of versions that the registry no longer names."""
    return chunks.join(registry.where("status = 'active'").select("document_id", "version"), ["document_id", "version"], "left_anti")


def upsert(registry: DataFrame, changes: DataFrame, key: str = "source_path", keep: str = "created_at") -> DataFrame:
    """The registry with the changes put in by key; ``keep`` stays as it was. Keys must be unique in both."""
    old, new = registry.alias("o"), changes.alias("n")
    joined = old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    cols = [(F.coalesce(f"o.{c}", f"n.{c}") if c in (key, keep) else F.when(F.col(f"n.{key}").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))).alias(c) for c in registry.columns]
    return joined.select(*cols)


def set_status(registry: DataFrame, paths: DataFrame, status: str) -> DataFrame:
    """The registry with ``status`` for the paths named."""
    named = paths.select(F.col("path").alias("source_path"), F.lit(True).alias("_hit")).distinct()
    return registry.join(named, "source_path", "left").withColumn("status", F.when(F.col("_hit"), status).otherwise(F.col("status"))).drop("_hit").select(*registry.columns)


def latest_equivalent(registry: DataFrame) -> DataFrame:
    """The latest active row of each signature."""
    w = Window.partitionBy(*SIGNATURE).orderBy(F.desc("updated_at"), F.desc("document_id"))
    return registry.where("status = 'active'").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
