"""Answer category, refusals, post-processing, rewrites, cache keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Answers and notes.
INSUFFICIENT = "资料不足，无法基于当前知识库回答该问题。"
NO_PERMISSION = "抱歉，您没有权限访问该信息。如有疑问请联系 HR 或系统管理员。"
OWN_SALARY_ONLY = "抱歉，您只能查询本人工资信息。请使用本人账号登录或联系 HR。"
HR_NOTE = "（注：以上内容仅供参考，具体执行以公司 HR 部门正式文件为准）"
FINANCE_NOTE = "（注：财务数据来自历史报表，最新情况以财务部口径为准）"


def category(evidence: DataFrame, by: str) -> DataFrame:
    """by, category: the most frequent document type; ties in the order salary, finance, policy, general."""
    kind = F.when(F.col("doc_type").isin("salary", "finance", "policy"), F.col("doc_type")).otherwise("general")
    order = F.when(kind == "salary", 0).when(kind == "finance", 1).when(kind == "policy", 2).otherwise(3)
    counts = evidence.groupBy(by, kind.alias("category"), order.alias("place")).agg(F.count("*").alias("n"))
    return counts.groupBy(by).agg(F.max_by("category", F.struct(F.col("n"), -F.col("place"))).alias("category"))


def refusal(stats: DataFrame) -> DataFrame:
    """``stats`` (docs, blocked, category, matched, unmatched) with refusal (null: answer)."""
    none = F.when(F.col("blocked") > 0, NO_PERMISSION).otherwise(INSUFFICIENT)
    return stats.withColumn("refusal", F.when(F.col("docs") == 0, none).when((F.col("category") == "salary") & (F.col("unmatched") > F.col("matched")), OWN_SALARY_ONLY))


def post_process(answer: Column, kind: Column) -> Column:
    a = F.coalesce(answer, F.lit(""))
    s = F.trim(a)
    note = F.when(kind.isin("salary", "policy"), HR_NOTE).when(kind == "finance", FINANCE_NOTE)
    noted = F.when(note.isNull() | F.contains(a, note), s).otherwise(F.trim(F.concat(F.rtrim(a), F.lit("\n\n"), note)))
    return F.when(F.length(s) < 6, INSUFFICIENT).when(F.contains(s, F.lit("资料不足")), INSUFFICIENT).when(F.contains(s, F.lit(NO_PERMISSION)), s).when(s.startswith("抱歉，您没有权限"), NO_PERMISSION).otherwise(noted)


def rewrites(queries: DataFrame, synonyms: DataFrame, most: int = 2, longest: int = 40) -> DataFrame:
    """query_id, place, rewrite: synonyms (word, place, synonym) put for the first occurrence of a word.

    The dictionary is cross-checked by containment, so it must be small: it is broadcast if it has
    10,000 rows at most, and refused else.
    """
    if synonyms.limit(10_001).count() > 10_000:
        raise ValueError("a synonym table of more than 10000 rows")
    hit = queries.join(F.broadcast(synonyms), F.contains(queries["query"], synonyms["word"]))
    text = F.when(F.col("query") == F.col("word"), F.col("synonym")).otherwise(F.expr("overlay(query placing synonym from locate(word, query) for length(word))"))
    found = hit.withColumn("rewrite", text).where((F.length("rewrite") <= longest) & (F.col("rewrite") != F.col("query")))
    first = found.groupBy("query_id", "rewrite").agg(F.min(F.struct("word", "place")).alias("x"))
    ranked = first.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("x.word", "x.place", "rewrite"))), 1, most).alias("r"))
    return ranked.select("query_id", F.posexplode("r").alias("place", "r")).select("query_id", "place", "r.rewrite")


def cache_key(*parts: Column, roles: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.trim(F.coalesce(p.cast("string"), F.lit(""))) for p in parts], F.array_join(F.array_sort(roles), ",")), 256)


def cited(answer: Column) -> Column:
    """Numbers in citation brackets."""
    return F.transform(F.regexp_extract_all(answer, F.lit(r"【(\d+)】"), 1), lambda x: x.try_cast("int"))
