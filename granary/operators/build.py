"""Builds as plans: what a commit, a failure and a rebuild leave of chunks and registry.

A reader joins chunks to the registry's active version, so it sees a document's old chunks or its
new ones, never both, whatever step a build has reached: new chunks are written first, the
registry names them next, old ones go last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def visible(chunks: DataFrame, registry: DataFrame) -> DataFrame:
    """Chunks (document_id, version, ...) of the versions that are active."""
    return chunks.join(registry.where("status = 'active'").select("document_id", "version"), ["document_id", "version"], "left_semi")


def committed_chunks(chunks: DataFrame, produced: DataFrame, failed: DataFrame) -> DataFrame:
    """The chunk table after a build: produced chunks of documents without failure replace their old ones.

    Of a document (document_id) in ``failed`` the produced chunks are rolled back and the old ones stay.
    """
    good = produced.join(failed.select("document_id").distinct(), "document_id", "left_anti")
    return chunks.join(good.select("document_id").distinct(), "document_id", "left_anti").unionByName(good)


def committed_registry(registry: DataFrame, produced: DataFrame, failed: DataFrame, now: str) -> DataFrame:
    """The registry (document_id, version, status, chunk_count, created_at, updated_at) after a build.

    Documents without failure become active in their new version, with the count of their chunks;
    one that failed is marked so unless an older version of it is active; created_at stays.
    """
    bad = failed.select("document_id").distinct().withColumn("_failed", F.lit(True))
    made = produced.groupBy("document_id").agg(F.max("version").alias("_version"), F.count("*").alias("_chunks"))
    both = registry.join(made, "document_id", "full_outer").join(bad, "document_id", "full_outer")
    ok = F.col("_version").isNotNull() & F.col("_failed").isNull()
    mark = F.col("_failed").isNotNull() & (F.coalesce("status", F.lit("")) != "active")
    return both.select(
        "document_id",
        F.when(ok | mark, F.coalesce("_version", "version")).otherwise(F.col("version")).alias("version"),
        F.when(ok, "active").when(mark, "failed").otherwise(F.col("status")).alias("status"),
        F.when(ok, F.col("_chunks")).when(mark, F.lit(0).cast("long")).otherwise(F.col("chunk_count")).alias("chunk_count"),
        F.coalesce("created_at", F.lit(now)).alias("created_at"),
        F.when(ok | mark, F.lit(now)).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def without_documents(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks of other documents."""
    return chunks.join(documents.select("document_id").distinct(), "document_id", "left_anti")


def without_chunks(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """Chunks of other ids (chunk_id)."""
    return chunks.join(ids.select("chunk_id").distinct(), "chunk_id", "left_anti")


def rebuild(registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For a forced rebuild: the registry with all living documents pending, and how many there were by status."""
    living = F.col("status") != "deleted"
    pending = registry.withColumn("status", F.when(living, "rebuild_pending").otherwise(F.col("status")))
    return pending, registry.where(living).groupBy("status").agg(F.count("*").alias("documents"), F.sum("chunk_count").alias("chunks"))


def build_report(planned: DataFrame, failed: DataFrame) -> DataFrame:
    """action, files: what became of each file (path, action) of an incremental load; failures are rows as well."""
    bad = failed.select("path").distinct().withColumn("_failed", F.lit(True))
    return planned.join(bad, "path", "left").groupBy(F.when(F.col("_failed"), "failed").otherwise(F.col("action")).alias("action")).agg(F.count("*").alias("files"))
