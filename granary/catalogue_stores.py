"""Further registered queries with their SQL: the cache by least use, stores that commit, recursive chunks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from granary.catalogue import pages_of, query, read
from granary.functions import text as T
from granary.operators import chunk
from granary.plans.cluster import shared_folder
from granary.sources.store import ChunkStore
from granary.streaming import cache

CACHE_ENTRIES, CACHE_SECONDS = 64, 36_000


@query(f"""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS x, row_number() OVER (ORDER BY ts, event_id, user_id) AS p FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL),
w AS (SELECT user_id, x, p, lag(p) OVER (PARTITION BY user_id ORDER BY p) AS before, row_number() OVER (PARTITION BY user_id ORDER BY p) AS n FROM e),
o AS (SELECT w.p, count(DISTINCT q.user_id) AS others FROM w JOIN e AS q ON q.p > w.before AND q.p < w.p GROUP BY w.p),
t AS (SELECT user_id, n, x, coalesce(others, 0) >= {CACHE_ENTRIES} AS gone FROM w LEFT JOIN o ON w.p = o.p),
r AS (SELECT user_id, n, x AS since, 0 AS hit FROM t WHERE n = 1
UNION ALL SELECT t.user_id, t.n, CASE WHEN NOT gone AND x - since <= {CACHE_SECONDS * 10**6} THEN since ELSE x END, CASE WHEN NOT gone AND x - since <= {CACHE_SECONDS * 10**6} THEN 1 ELSE 0 END FROM r JOIN t ON t.user_id = r.user_id AND t.n = r.n + 1)
SELECT user_id, count(*) AS accesses, CAST(sum(hit) AS BIGINT) AS hits FROM r GROUP BY user_id""")
def cache_lru_hits(spark, d):
    return cache.lru_hits(read(spark, d, "events").select("user_id", "ts", "event_id"), "user_id", CACHE_SECONDS, CACHE_ENTRIES, ("event_id",))


def _produced(docs, prefix=""):
    """Pieces of 300 characters as chunks; every third is of the section level."""
    pieces = docs.select(F.concat(F.lit("d"), "doc_id").alias("document_id"), F.col("source").alias("source_path"), F.sha2("text", 256).alias("content_hash"), F.col("lang").alias("doc_type"), F.posexplode(T.fixed_width(F.concat(F.lit(prefix), "text"), 300)).alias("page", "text"))
    level = F.when(F.col("page") % 3 == 0, "section").otherwise("fine")
    return pieces.withColumn("chunk_level", level).withColumn("chunk_id", F.concat_ws("_", "document_id", F.lpad(F.col("page").cast("string"), 5, "0")))


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 9 <> 0 THEN text ELSE 'former words ' || text END AS t,
  CASE WHEN doc_id % 7 = 1 THEN 'deleted' WHEN doc_id % 9 = 4 THEN 'failed' ELSE 'active' END AS status FROM documents),
p AS (SELECT doc_id, status, t, unnest(range(CAST(ceil(length(t) / 300.0) AS BIGINT))) AS i FROM d WHERE status = 'active'),
n AS (SELECT doc_id, count(*) AS chunks, count(*) FILTER (i % 3 = 0) AS sections, CAST(sum(length(substr(t, CAST(i * 300 + 1 AS BIGINT), 300))) AS BIGINT) AS chars FROM p GROUP BY doc_id)
SELECT 'd' || d.doc_id AS document_id, status, coalesce(chunks, 0) AS chunk_count, coalesce(chunks, 0) AS chunks, coalesce(sections, 0) AS sections, coalesce(chars, 0) AS chars FROM d LEFT JOIN n ON d.doc_id = n.doc_id WHERE status <> 'deleted'""")
def committed_store(spark, d):
    """What readers of a store see after a build, one that replaces and fails documents, a deletion and a rewrite.

    Of the first build some files fail; of the second some fail that were active and so stay as they were.
    """
    docs = read(spark, d, "documents")
    store = ChunkStore(spark, f"{shared_folder(spark)}/chunks-{uuid.uuid4().hex}")
    named = docs.select("doc_id", F.concat(F.lit("d"), "doc_id").alias("document_id"), F.col("source").alias("source_path"), F.sha2("text", 256).alias("content_hash"), F.lit("unreadable").alias("error"))
    store.build(_produced(docs, "former words "), named.where("doc_id % 9 = 4").drop("doc_id"), "t1")
    store.build(_produced(docs.where("doc_id % 3 = 0")), named.where("doc_id % 9 = 0").drop("doc_id"), "t2")
    store.set_status(named.where("doc_id % 7 = 1"), "deleted", "t3")
    store.compact()
    seen = store.chunks().groupBy("document_id").agg(F.count("*").alias("chunks"), F.count_if(F.col("chunk_level") == "section").alias("sections"), F.sum(F.length("text")).alias("chars"))
    none = F.lit(0).cast("long")
    return store.registry().join(seen, "document_id", "left").select("document_id", "status", "chunk_count", *[F.coalesce(c, none).alias(c) for c in ("chunks", "sections", "chars")])


@query()
def recursive_chunks(spark, d):
    return chunk.recursive_chunks(pages_of(spark, d))
