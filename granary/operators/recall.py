"""Recall routes: inverted index with BM25, vectors, structured rows; merging of variants."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.plans.cluster import cut, join_small, shuffle_partitions

K1, B = 1.5, 0.75


def postings(chunks: DataFrame, key: str) -> DataFrame:
    """term, key, dl: each term of a chunk once, with the chunk's length in distinct terms."""
    return _exploded(_tokenised(chunks, key))


def _tokenised(chunks: DataFrame, key: str) -> DataFrame:
    return chunks.select(F.col(key).alias("key"), T.search_terms(F.col("text")).alias("terms"))


def _exploded(terms: DataFrame) -> DataFrame:
    return terms.select("key", F.size("terms").alias("dl"), F.explode("terms").alias("term"))


def term_stats(posts: DataFrame, n: int) -> DataFrame:
    """term, df, idf; a negative idf becomes a quarter of the mean over all terms."""
    stats = posts.groupBy("term").agg(F.count("*").alias("df"))
    raw = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    stats = stats.withColumn("raw", raw)
    mean = stats.agg(F.avg("raw").alias("mean"))
    return stats.join(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, 0.25 * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def top(df: DataFrame, by: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each group with their rank (pruned before the shuffle by the planner)."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def bm25(queries: DataFrame, chunks: DataFrame, key: str, k: int = 40) -> DataFrame:
    """query_id, key, rank, score of the best chunks of each query (scores above 0)."""
    terms = cut(_tokenised(chunks, key))  # texts are split into terms once, not once for each use
    posts = _exploded(terms)
    n, total = terms.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    avgdl = total / max(1, n)
    asked = queries.select("query_id", F.explode(T.search_terms(F.col("query"))).alias("term"))
    # what is asked for grows with the questions only: where it is small, postings are filtered where they lie
    weighed = cut(asked.join(term_stats(posts, n), "term").groupBy("term").agg(F.first("idf").alias("idf"), F.collect_list("query_id").alias("queries")))
    part = F.col("idf") * (K1 + 1) / (1 + K1 * (1 - B + B * F.col("dl") / avgdl))
    met = join_small(posts, weighed, ["term"]).select("key", F.explode("queries").alias("query_id"), part.alias("part"))
    hits = met.groupBy("query_id", "key").agg(F.round(F.sum("part"), 6).alias("score")).where("score > 0")
    return top(hits, ["query_id"], k, F.desc("score"), F.col("key")).select("query_id", "key", "rank", "score")


#: Vectors that a task holds, and a chunk of them that is compared at once.
SHARD_VECTORS, CHUNK_VECTORS = 20_000, 4_096


def _nearest(k: int):
    """The k nearest of a shard's vectors for each query; rows (shard, is_query, id, v), vectors first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, parts, table = None, [], [], None
        for batch in batches:
            sid, asked, key = batch["shard"].to_numpy(), batch["is_query"].to_numpy(zero_copy_only=False), batch["id"].to_numpy()
            offsets, flat = np.asarray(batch["v"].offsets), batch["v"].values.to_numpy(zero_copy_only=False)
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for i in range(len(key)):
                v = flat[offsets[i] : offsets[i + 1]]
                if sid[i] != shard:
                    shard, ids, parts, table = sid[i], [], [], None
                if not asked[i]:
                    ids.append(key[i])
                    parts.append(v)
                    continue
                if not parts:
                    continue
                if table is None:
                    table, known = np.array(parts), np.array(ids)
                gaps = np.concatenate([np.square(table[a : a + CHUNK_VECTORS] - v).sum(1) for a in range(0, len(table), CHUNK_VECTORS)])
                gaps[known == key[i]] = np.inf
                # all that may be among the k by rounded score and id
                least = np.partition(gaps, min(k, len(gaps)) - 1)[min(k, len(gaps)) - 1]
                near = np.flatnonzero((gaps <= least + 2e-6) & (gaps < np.inf))
                out.append((np.full(len(near), key[i]), known[near], gaps[near]))
            columns = [np.concatenate(x) if out else np.empty(0) for x in zip(*out)] or [np.empty(0)] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(columns, (np.int64, np.int64, np.float64))], ["query_id", "key", "gap"])

    return run


def knn(queries: DataFrame, vectors: DataFrame, k: int = 40) -> DataFrame:
    """query_id, key, rank, score (squared distance) of the nearest vectors (vec_id, embedding) of each query.

    Vectors are dealt to shards that a task holds as a matrix; queries go to every shard, which
    answers with its k nearest. Vectors of one table have one length; null ones take no part.
    """
    plain = lambda c: F.transform(c, lambda x: x.cast("double"))
    base = vectors.where("embedding is not null").select(F.col("vec_id").cast("long").alias("id"), plain("embedding").alias("v"))
    n = base.count()
    shards = max(1, -(-n // SHARD_VECTORS), min(shuffle_partitions(vectors.sparkSession), n // 1_000))
    dealt = base.select(F.pmod(F.xxhash64("id", F.element_at("v", 1)), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("is_query"), "id", "v")
    asked = queries.where("embedding is not null").select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("is_query"), F.col("query_id").cast("long").alias("id"), plain("embedding").alias("v"))
    found = dealt.unionByName(asked).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "is_query").mapInArrow(_nearest(k), "query_id long, key long, gap double")
    scored = found.select("query_id", "key", F.round("gap", 6).alias("score"))
    return top(scored, ["query_id"], k, F.col("score"), F.col("key")).select("query_id", "key", "rank", "score")


def merge_variants(hits: DataFrame, weight_of_rewrites: float = 0.75, k: int = 60) -> DataFrame:
    """Hits of query variants (query_id, variant, key, rank): the first occurrence of a key wins.

    The provisional score is weight / (k + rank), the original's weight is 1.
    """
    weight = F.when(F.col("variant") == 0, 1.0).otherwise(weight_of_rewrites)
    first = hits.groupBy("query_id", "key").agg(F.min(F.struct("variant", "rank")).alias("x")).select("query_id", "key", "x.*")
    scored = first.withColumn("score", F.round(weight / (k + F.col("rank")), 9))
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "variant", "rank", "key")))


def ordered_union(first: DataFrame, second: DataFrame) -> DataFrame:
    """Distinct keys of two ranked lists (query_id, key, rank): all of the first, then what is new in the second."""
    both = first.select("query_id", "key", "rank", F.lit(0).alias("side")).unionByName(second.select("query_id", "key", "rank", F.lit(1).alias("side")))
    best = both.groupBy("query_id", "key").agg(F.min(F.struct("side", "rank")).alias("x")).select("query_id", "key", "x.*")
    return best.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("side", "rank", "key")))
