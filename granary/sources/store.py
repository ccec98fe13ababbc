"""A store of chunks and their registry that builds commit to: a reader sees a build whole or not at all.

A build writes its chunks into a folder of its own, its registry rows into another, and then one manifest
that names both; old files go last. Registry rows name the build that holds a document's chunks, and readers
join chunks to active rows, so a document's old and new chunks are never seen together.

* ``chunks/build=B/chunk_level=L/doc_type=T/bucket=N``: chunks; level, type and the bucket of a document id
  are folders, so a scan for them lists those folders only;
* ``registry/build=B``: registry rows as deltas, the latest of a document counts; folded into one now and then.
"""

from __future__ import annotations

import logging
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.plans.cluster import cut, join_small, release_shuffles
from granary.sources.snapshots import Snapshots

logger = logging.getLogger(__name__)

BUCKETS, FOLD_AFTER, KEEP = 16, 16, 2
PARTS = ["chunk_level", "doc_type", "bucket"]
REGISTRY = "document_id string, source_path string, content_hash string, status string, chunk_count long, build string, error string, created_at string, updated_at string, number long"
NAMES = [c.split()[0] for c in REGISTRY.split(", ")]


def bucket_of(document_id: Column) -> Column:
    return F.pmod(F.xxhash64(document_id), F.lit(BUCKETS)).cast("int")


class ChunkStore:
    """Chunks (document_id, source_path, content_hash, chunk_id, chunk_level, doc_type, page, text and more) in a shared folder.

    Columns keep the type of the first build that had them; in chunks of builds without a column it is
    null. An empty level or type is read back as null.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.store = spark, Snapshots(spark, folder)

    # reading

    def registry(self, status: str | None = None, state: dict | None = None) -> DataFrame:
        """The latest row of every document that was not deleted, the last updated first."""
        rows = self._latest(state or self.store.read()[1]).where("status <> 'deleted'")
        return (rows if status is None else rows.where(F.col("status") == status)).orderBy(F.desc("updated_at"), "document_id")

    def find(self, document_id: str | None = None, source_path: str | None = None) -> DataFrame:
        """Registry rows of an id or a path; several if a path was given to several documents."""
        rows = self._latest(self.store.read()[1], None if document_id is None else F.col("document_id") == document_id).where("status <> 'deleted'")
        return rows if source_path is None else rows.where(F.col("source_path") == source_path)

    def chunks(self, level: str | None = None, doc_type: str | None = None, document_id: str | None = None, chunk_ids: list[str] | None = None, source_path: str | None = None, pages: list[int] | None = None, state: dict | None = None) -> DataFrame:
        """Chunks of active documents, narrowed by what is given; no limit is set on them.

        Level, type and document are folders of the store, so others are not listed; the rest are filters
        of the scan.
        """
        state = state or self.store.read()[1]
        if not state.get("chunks"):
            return self.spark.createDataFrame([], state.get("schema") or "document_id string, chunk_id string")
        df = self.spark.read.schema(state["schema"]).option("basePath", self.store.path("chunks")).parquet(*[self.store.path("chunks", f"build={b}") for b in state["chunks"]])
        for name, value in (("chunk_level", level), ("doc_type", doc_type), ("document_id", document_id), ("source_path", source_path)):
            df = df if value is None else df.where(F.col(name) == value)
        df = df if document_id is None else df.where(F.col("bucket") == bucket_of(F.lit(document_id)))
        for name, values in (("chunk_id", chunk_ids), ("page", pages)):
            df = df if values is None else df.where(F.col(name).isin(list(values)))
        active = self._latest(state, None if document_id is None else F.col("document_id") == document_id).where("status = 'active'").select("document_id", "build")
        return df.join(active, ["document_id", "build"], "left_semi").drop("build", "bucket")

    def _latest(self, state: dict, only: Column | None = None) -> DataFrame:
        if not state.get("registry"):
            return self.spark.createDataFrame([], REGISTRY)
        rows = self.spark.read.schema(REGISTRY).parquet(*[self.store.path("registry", f"build={b}") for b in state["registry"]])
        rows = rows if only is None else rows.where(only)
        last = rows.groupBy("document_id").agg(F.max_by(F.struct(*NAMES), "number").alias("_row"))
        return last.select("_row.*")

    # writing

    def build(self, produced: DataFrame, failed: DataFrame | None = None, now: str = "") -> DataFrame:
        """Commit a build: chunks of documents in ``produced`` take the place of those they had.

        A document in ``failed`` (document_id, source_path, content_hash, error) keeps what it had: its
        produced chunks are left out, and it is marked as failed unless it is active. Rows without a
        document_id raise. Returns the changed registry rows. If anything fails before the manifest is
        there, the build's own files go and nothing has changed; what fails later is only logged.
        """
        if clash := {"build", "bucket"} & set(produced.columns):
            raise ValueError(f"columns of the store itself: {sorted(clash)}")
        number, state = self.store.read()
        name = self._name(number)
        bad = (failed if failed is not None else self.spark.createDataFrame([], "document_id string, source_path string, content_hash string, error string")).groupBy("document_id").agg(*[F.max(c).alias(c) for c in ("source_path", "content_hash", "error")])
        # few ids are broadcast, so texts are shuffled once, for the folders
        good = join_small(produced, cut(bad.select("document_id")), ["document_id"], "left_anti").withColumn("document_id", self._given("document_id")).withColumn("bucket", bucket_of(F.col("document_id")))

        def rows() -> DataFrame:
            # counted from what was written, so rows and files agree even where the input would not repeat
            written = self.spark.read.schema(good.schema).option("basePath", self.store.path("chunks", f"build={name}")).parquet(self.store.path("chunks", f"build={name}"))
            made = written.groupBy("document_id").agg(F.max("source_path").alias("source_path"), F.max("content_hash").alias("content_hash"), F.count("*").alias("chunk_count"))
            old = self._latest(state).select("document_id", F.col("status").alias("_status"), F.col("created_at").alias("_created"))
            ok = made.select("*", F.lit("active").alias("status"), F.lit(name).alias("build"), F.lit(None).cast("string").alias("error"))
            no = bad.select("document_id", "source_path", "content_hash", F.lit(0).cast("long").alias("chunk_count"), F.lit("failed").alias("status"), F.lit(None).cast("string").alias("build"), "error")
            both = ok.unionByName(no).join(old, "document_id", "left").where("status = 'active' OR coalesce(_status, '') <> 'active'")
            kept = F.when(F.col("_status") == "deleted", None).otherwise(F.col("_created"))
            return both.withColumn("created_at", F.coalesce(kept, F.lit(now))).withColumn("updated_at", F.lit(now)).withColumn("number", F.lit(number + 1).cast("long")).select(NAMES)

        return self._commit(number, state, name, good, rows)

    def set_status(self, documents: DataFrame, status: str, now: str = "") -> DataFrame:
        """Commit ``status`` for the documents (document_id) that are there; 'deleted' takes them out of all reads."""
        number, state = self.store.read()
        named = documents.select("document_id").distinct()
        rows = lambda: self._latest(state).where("status <> 'deleted'").join(named, "document_id", "left_semi").withColumn("status", F.lit(status)).withColumn("updated_at", F.lit(now)).withColumn("number", F.lit(number + 1).cast("long")).select(NAMES)
        return self._commit(number, state, self._name(number), None, rows)

    def compact(self) -> DataFrame:
        """Commit a build of all chunks that can be seen, so that no file holds replaced ones."""
        number, state = self.store.read()
        name = self._name(number)
        rows = lambda: self._latest(state).where("status = 'active'").withColumn("build", F.lit(name)).withColumn("number", F.lit(number + 1).cast("long")).select(NAMES)
        return self._commit(number, state, name, self.chunks(state=state).withColumn("bucket", bucket_of(F.col("document_id"))), rows)

    def _name(self, number: int) -> str:
        return f"{number + 1}-{uuid.uuid4().hex[:8]}"

    @staticmethod
    def _given(column: str) -> Column:
        return F.when(F.col(column).isNull(), F.raise_error(F.lit(f"a chunk without {column}"))).otherwise(F.col(column))

    def _commit(self, number: int, state: dict, name: str, chunks: DataFrame | None, rows) -> DataFrame:
        committed = False
        try:
            schema = state.get("schema")
            if chunks is not None:
                # partitions are rebalanced by size, so a hot type or document is written by many tasks
                chunks.hint("rebalance", *PARTS).write.partitionBy(*PARTS).parquet(self.store.path("chunks", f"build={name}"))
                fields = {f.name: f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema}
                known = state.get("fields") or {}
                fields = known | {c: t for c, t in fields.items() if c not in known}
                schema = ", ".join([*(t for c, t in fields.items() if c not in PARTS), *(fields[c] for c in PARTS), "build string"])
                state = state | {"fields": fields}
                release_shuffles(self.spark)
            self._after("chunks")
            rows().write.parquet(self.store.path("registry", f"build={name}"))
            deltas = [*state.get("registry", []), name]
            new = state | {"schema": schema, "registry": deltas}
            if len(deltas) > FOLD_AFTER:
                folded = f"{name}-folded"
                self._latest(new).where("status <> 'deleted'").write.parquet(self.store.path("registry", f"build={folded}"))
                new["registry"] = [folded]
            # as many rows as there are builds
            live = {r["build"] for r in self._latest(new).where("status <> 'deleted' AND build IS NOT NULL").select("build").distinct().collect()}
            new["chunks"] = [b for b in [*state.get("chunks", []), *([name] if chunks is not None else [])] if b in live]
            self._after("registry")
            self.store.commit(number + 1, new)
            committed = True
            self._after("manifest")
            self._clean(number + 1)
        except Exception:
            if not committed:
                for part in (("chunks", f"build={name}"), ("registry", f"build={name}"), ("registry", f"build={name}-folded")):
                    self.store.delete(*part)
                raise
            logger.warning("build %s is committed; its old files are left for the next one", name, exc_info=True)
        return self.spark.read.schema(REGISTRY).parquet(self.store.path("registry", f"build={name}"))

    def _after(self, step: str) -> None:
        """Called after each step of a commit; tests stop a build here."""

    def _clean(self, number: int) -> None:
        """Delete files that older manifests name and the last ``KEEP`` do not; other writers' open builds stay."""
        kept = [self.store.read(n)[1] for n in range(max(1, number - KEEP + 1), number + 1)]
        for table in ("chunks", "registry"):
            wanted = {b for s in kept for b in s.get(table, [])}
            for folder in self.store.folders(table):
                build = folder.removeprefix("build=")
                if build not in wanted and int(build.split("-")[0]) <= number - KEEP + 1:
                    self.store.delete(table, folder)
