"""A retrieval run's report: strata of samples, and what each query's evidence came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def retrieval_report(samples: DataFrame, ranked: DataFrame, expected: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """stratum, k, samples, hit, mrr, file_hit, gap: one row a stratum and k, in one aggregation.

    ``samples``: sample_id (distinct), question, expected_refusal; ``ranked``: sample_id, rank, path,
    page; ``expected``: sample_id, path, page (null: any page). Strata: ``page`` (a page is expected),
    ``file``, ``skipped`` (no question, or to be refused and nothing expected; no metrics) and ``all``,
    which leaves out those skipped. file_hit counts equal paths alone, gap is what pages cost. Samples
    that nothing was found or expected for count as misses.
    """
    rows, wanted = ranked.select("sample_id", "rank", "path", F.col("page").alias("_page")), expected.distinct()
    fits = F.col("page").isNull() | F.coalesce(F.col("page") == F.col("_page"), F.lit(False))
    found = rows.join(wanted, ["sample_id", "path"]).groupBy("sample_id").agg(F.min(F.when(fits, F.col("rank"))).alias("_first"), F.min("rank").alias("_file_first"))
    asked = wanted.groupBy("sample_id").agg(F.max(F.col("page").isNotNull()).alias("_paged"))
    both = samples.select("sample_id", "question", "expected_refusal").join(asked, "sample_id", "left").join(found, "sample_id", "left")
    skipped = (F.coalesce("question", F.lit("")) == "") | (F.coalesce("expected_refusal", F.lit(False)) & F.col("_paged").isNull())
    stratum = F.when(skipped, "skipped").when(F.col("_paged"), "page").otherwise("file")
    grid = both.withColumn("stratum", stratum).withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    counted = F.col("stratum") != "skipped"
    hit = lambda first: F.coalesce((F.col(first) <= F.col("k")).cast("double"), F.lit(0.0))
    mean = lambda c: F.round(F.avg(F.when(counted, c)), 6)
    strata = grid.groupingSets([["stratum", "k"], ["k"]], "stratum", "k").agg(
        F.when(F.grouping("stratum") == 1, F.count_if(counted)).otherwise(F.count("*")).alias("samples"),
        F.grouping("stratum").alias("_all"),
        mean(hit("_first")).alias("hit"),
        mean(F.when(hit("_first") == 1, 1 / F.col("_first")).otherwise(0.0)).alias("mrr"),
        mean(hit("_file_first")).alias("file_hit"),
        mean(hit("_file_first") - hit("_first")).alias("gap"),
    )
    return strata.select(F.when(F.col("_all") == 1, "all").otherwise(F.col("stratum")).alias("stratum"), "k", "samples", "hit", "mrr", "file_hit", "gap")


def trace_counters(evidence: DataFrame, by_vector: Column, by_terms: Column, included: Column) -> DataFrame:
    """query_id, candidates, vector_hits, term_hits, both_hits, evidence: what a query's rows came from."""
    return evidence.groupBy("query_id").agg(
        F.count("*").alias("candidates"),
        F.count_if(by_vector).alias("vector_hits"),
        F.count_if(by_terms).alias("term_hits"),
        F.count_if(by_vector & by_terms).alias("both_hits"),
        F.count_if(included).alias("evidence"),
    )
