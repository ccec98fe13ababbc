"""Corpus pipeline: toxicity, near-duplicates, repeated passages, source mix, packing.

Every stage takes (spark, docs, sf_dir) with the columns of ``documents`` and returns them again;
the last one returns the packed pieces. Each stage's result is written as Parquet in the shared
folder and read again as the next one's docs.

Defined cases: further columns are carried along unchanged, whatever their names; rows with a null
doc_id are judged and mixed like others, but no text of theirs counts as a copy; null and empty
texts are kept (near-duplicate removal keeps one of them); rows of one doc_id count as one document,
so repeated rows stay or go together; an empty table stays empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import mixing, packing, simhash, substring, toxicity
from granary.llm.queries import tokenizer_file
from granary.plans.cluster import cut, delete_folder, rank_in_group, shared_folder

#: Words of a passage that may stand in one document only; shorter repeats are left alone.
PASSAGE_WORDS = 50

#: Rows of an Arrow batch: whole texts travel in them, so ten thousand rows, the usual number, would hold
#: hundreds of MB in each worker and as much beside the heap of its executor.
BATCH_ROWS = 1_000

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def carrying(stage: Callable) -> Callable:
    """``stage`` sees further columns as one struct, so that none clashes with a column of its own.

    The session's Arrow batches are set to ``BATCH_ROWS`` and stay so, as the result is computed later.
    """

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        more = [c for c in docs.columns if c not in COLUMNS]
        if not more:
            return stage(spark, docs, sf_dir)
        quoted = [F.col("`" + c.replace("`", "``") + "`") for c in more]
        out = stage(spark, docs.select(*[c for c in docs.columns if c in COLUMNS], F.struct(*quoted).alias("_more")), sf_dir)
        return out.select(*[F.col("_more").getField(c).alias(c) if c in more else F.col(c) for c in docs.columns])

    return run_stage


@carrying
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects by their language's threshold."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.classify(docs, model).where("not toxic").select(*docs.columns)


@carrying
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (of the smallest id) of each group of near copies: shingles of five words, similarity 0.8."""
    groups = simhash.similar(docs, width=5, similarity=0.8)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")


@carrying
def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the passages that a document of smaller id has too; untouched texts stay as they are."""
    cleaned = substring.remove_repeats(docs.withColumn("_text", F.col("text")), PASSAGE_WORDS)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("_text"))
    out = cleaned.withColumn("text", text).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


@carrying
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    # equal rows have equal keys: the id beside a hash that tells nulls from values
    key = F.concat_ws(" ", F.col("doc_id").cast("string"), F.xxhash64("doc_id", F.col("source").isNull(), "source", F.col("text").isNull(), "text").cast("string"))
    narrow = mixing.sized(docs.withColumn("_key", key), ["doc_id", "source", "_key"])
    rounds = cut(mixing.mix(narrow).groupBy("_key").agg(F.sum("rounds").alias("_rounds"), F.count("*").alias("_rows")))
    # repeated rows (same id, source and text) share their rounds evenly; what is left goes to the first of them
    keyed = docs.withColumn("_key", key)
    joined = keyed.join(rounds, "_key")
    copies = F.floor(F.col("_rounds") / F.col("_rows")).cast("int")
    even = joined.where(copies > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).select(*docs.columns)
    left = rounds.select("_key", (F.col("_rounds") % F.col("_rows")).alias("_left")).where("_left > 0")
    # equal rows are told apart by their place in a cut table, so that a hot group is ranked over salts
    repeated = cut(keyed.join(left, "_key").withColumn("_row", F.monotonically_increasing_id()))
    first = rank_in_group(repeated, ["_key"], ["_row"], "_place").where("_place < _left").select(*docs.columns)
    return even.unionByName(first)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their places in sequences; copies of a document have equal pieces."""
    return packing.pack(packing.token_pieces(docs, tokenizer_file()))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("source_mix", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: SQL can't express the classifier; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again.

    A stage's table is deleted once the next one is written; the last one's stays for the caller.
    """
    home = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for i, (name, stage) in enumerate(STAGES):
        folder = f"{home}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before is not None:
            delete_folder(spark, before)
        before = folder
    return docs
