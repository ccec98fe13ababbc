"""Evidence: parents, neighbours, truncation, month filter, token budget, citations."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.plans.cluster import same


def stripped(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def belongs(text: Column, parent: Column) -> Column:
    """Whether a chunk may stand in its parent: all of it, or its start, middle or end of 24 characters (half of a shorter one, 8 at least)."""
    fine, whole = stripped(text), stripped(parent)
    n = F.length(fine)
    window = F.when(n >= 24, 24).otherwise(F.greatest(F.lit(8), F.floor(n / 2).cast("int")))
    middle = F.greatest(F.lit(0), F.floor(n / 2).cast("int") - F.floor(window / 2).cast("int"))
    probes = [F.substr(fine, at + 1, window) for at in (F.lit(0), middle, n - window)]
    found = F.contains(whole, fine) | ((n > window) & reduce(lambda a, b: a | b, [F.contains(whole, p) for p in probes]))
    return (fine == "") | (whole == "") | found


def starts_in(text: Column, parent: Column) -> Column:
    """Whether a parent has a chunk's first 24 characters (all of a shorter one), which is stricter than ``belongs``; not where one is null."""
    return F.contains(parent, F.substring(F.trim(text), 1, 24))


def expand_parents(hits: DataFrame, sections: DataFrame, max_tokens: int = 800, rule: Callable[[Column, Column], Column] = belongs) -> DataFrame:
    """``hits`` (query_id, rank, chunk, parent, text, doc_type) with the parent's text where, by ``rule``, it may stand in.

    Salary rows stay; a parent over the limit, or one that the chunk does not belong to, is ignored. Of equal results a query keeps the first.
    """
    parents = sections.select(F.col("chunk").alias("parent"), F.col("text").alias("parent_text"))
    joined = hits.join(parents, "parent", "left")
    fits = (F.col("doc_type") != "salary") & (T.token_estimate(F.col("parent_text")) <= max_tokens) & rule(F.col("text"), F.col("parent_text"))
    use = F.coalesce(fits, F.lit(False)) & F.col("parent_text").isNotNull()
    out = joined.withColumn("expanded", use).withColumn("evidence", F.when(use, F.col("parent")).otherwise(F.col("chunk"))).withColumn("text", F.when(use, F.col("parent_text")).otherwise(F.col("text")))
    first = F.row_number().over(Window.partitionBy("query_id", "evidence").orderBy("rank"))
    return out.withColumn("_n", first).where("_n = 1").select("query_id", "rank", "evidence", "text", "expanded")


def adjacent_sections(hits: DataFrame, sections: DataFrame, most: int = 2) -> DataFrame:
    """Sections (file, page) one page before or after a query's hit pages, which are no hits themselves."""
    pages = hits.select("query_id", "file", "page").distinct()
    near = pages.select("query_id", "file", F.explode(F.array(F.col("page") - 1, F.col("page") + 1)).alias("page")).where("page > 0").distinct()
    extra = near.join(pages, ["query_id", "file", "page"], "left_anti").join(sections, ["file", "page"])
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("file", "page", "chunk"))
    limit = hits.groupBy("query_id").agg((F.count("*") * most).alias("limit"))
    return extra.withColumn("place", place).join(limit, "query_id").where(F.col("place") <= F.col("limit")).select("query_id", "file", "page", "chunk", "place")


def leading_lines(c: Column, max_tokens: int) -> Column:
    """The leading lines whose tokens fit; the first that does not ends the text."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(True).alias("open"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, line: Column) -> Column:
        n = acc["used"] + T.token_estimate(line)
        fits = acc["open"] & (n <= max_tokens)
        return F.struct(F.when(fits, n).otherwise(acc["used"]).alias("used"), fits.alias("open"), F.when(fits, F.array_append(acc["kept"], line)).otherwise(acc["kept"]).alias("kept"))

    return F.aggregate(F.split(c, "\n"), start, step, lambda a: F.array_join(a["kept"], "\n"))


def compress(docs: DataFrame, max_tokens: int = 1200) -> DataFrame:
    """``docs`` with the text cut to leading lines where it is over the limit, and saved_chars."""
    over = T.token_estimate(F.col("text")) > max_tokens
    short = F.when(over, leading_lines(F.col("text"), max_tokens)).otherwise(F.col("text"))
    return docs.withColumn("_short", short).withColumn("saved_chars", (F.length("text") - F.length("_short")).cast("long")).withColumn("text", F.col("_short")).drop("_short")


def month_filter(evidence: DataFrame) -> DataFrame:
    """Without salary rows of other months, if the query names a month and one of its salary rows has it.

    ``evidence``: query_id, asked_month, month, doc_type.
    """
    hit = F.coalesce((F.col("doc_type") == "salary") & (F.col("month") == F.col("asked_month")), F.lit(False))
    some = F.max(hit).over(Window.partitionBy("query_id"))
    return evidence.withColumn("_hit", hit).withColumn("_some", some).where(F.col("_hit") | ~F.col("_some") | (F.col("doc_type") != "salary")).drop("_hit", "_some")


def budget(evidence: DataFrame, limit: int = 12_000, block: int = 4_096) -> DataFrame:
    """``evidence`` (query_id, rank, text) with tokens, cum_tokens and included: the prefix that fits.

    Ranks are numbers; ``evidence`` is read twice (cut or cheap). Sums run over blocks of ranks, and
    a block's own rows are added to the sum before it, so a query that holds a large part of the rows
    is summed by many tasks. Null query ids are one query, null ranks come first, equal ranks in any
    order.
    """
    keys = ["query_id", "_block"]
    tokens = evidence.withColumn("tokens", T.token_estimate(F.col("text"))).withColumn("_block", F.floor(F.col("rank") / block))
    upto = Window.partitionBy("query_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = tokens.groupBy(*keys).agg(F.sum("tokens").alias("_sum"))
    before = sums.select(*keys, F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_before"))
    joined = tokens.join(before, same(tokens, before, keys)).select(tokens["*"], before["_before"])
    own = F.sum("tokens").over(Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return joined.withColumn("cum_tokens", F.col("_before") + own).withColumn("included", F.col("cum_tokens") <= limit).drop("_block", "_before")


def citation(n: Column, file: Column, first: Column, last: Column, section: Column) -> Column:
    pages = F.when(first.isNull(), "").when(last.isNull() | (first == last), F.concat(F.lit(" 第"), first.cast("string"), F.lit("页"))).otherwise(F.concat(F.lit(" 第"), first.cast("string"), F.lit("-"), last.cast("string"), F.lit("页")))
    return F.concat(F.lit("资料"), n.cast("string"), F.lit(": "), file, pages, F.when(F.coalesce(section, F.lit("")) == "", "").otherwise(F.concat(F.lit("（章节："), section, F.lit("）"))))
