"""Payroll rows as texts, and their recall by additive scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators.normalise import any_of
from granary.plans.cluster import cut, join_small, shuffle_partitions

# Words of questions and rows, headers with units, departments by words of file and sheet names.
GATE = ("工资", "社保", "公积金", "个税")
FIELDS = ("实发工资", "应发工资", "基本工资", "绩效工资", "岗位津贴", "社保", "公积金", "个税", "工资")
TOTAL_WORDS = ("合计", "总额", "汇总", "所有", "全体", "本部门")
MONEY, DAYS = ("工资", "补贴", "合计", "社保", "公积金", "个税", "税", "补", "金"), "天"
DEPARTMENTS = (("销售部", ("销售",)), ("研发部", ("技术", "研发")), ("财务部", ("财务",)), ("人力资源部", ("HR", "人事")), ("行政部", ("行政",)))
EVERYONE = "全体"


def month_of_file(name: Column) -> Column:
    """Struct of year and month in a file's name; zeros if there are none."""
    part = lambda i: F.coalesce(F.regexp_extract(name, r"(20\d{2})年(\d{1,2})月", i).try_cast("int"), F.lit(0))
    return F.struct(part(1).alias("year"), part(2).alias("month"))


def department_of(file: Column, sheet: Column) -> Column:
    both = F.upper(F.concat_ws(" ", F.coalesce(file, F.lit("")), F.coalesce(sheet, F.lit(""))))
    return F.coalesce(*[F.when(any_of(both, words), F.lit(name)) for name, words in DEPARTMENTS], F.lit(""))


def row_text(headers: Column, values: Column, name: Column, year: Column, month: Column, department: Column) -> Column:
    """A title, the department and ``header：value`` lines with units; empty headers and values are left out."""
    title = F.when((year > 0) & (month > 0), F.concat(F.lit("【"), year.cast("string"), F.lit("年"), month.cast("string"), F.lit("月工资 - "), name, F.lit("】"))).otherwise(F.concat(F.lit("【工资 - "), name, F.lit("】")))
    cells = F.filter(F.transform(F.arrays_zip(headers.alias("h"), values.alias("v")), lambda x: F.struct(F.trim(F.coalesce(x["h"], F.lit(""))).alias("h"), F.trim(F.coalesce(x["v"], F.lit(""))).alias("v"))), lambda x: (x["h"] != "") & (x["v"] != ""))
    unit = lambda h: F.when(any_of(h, MONEY), " 元").when(F.contains(h, F.lit(DAYS)), " 天").otherwise("")
    lines = F.transform(cells, lambda x: F.concat(x["h"], F.lit("："), x["v"], unit(x["h"])))
    body = F.array_join(lines, "\n")
    own = F.when((F.coalesce(department, F.lit("")) != "") & ~F.contains(F.concat(title, body), F.lit("部门：")), F.concat(F.lit("部门："), department))
    return F.concat_ws("\n", title, own, F.nullif(body, F.lit("")))


def field_mask(c: Column) -> Column:
    """Which of the fields a text names, as bits."""
    out = F.lit(0)
    for i, field in enumerate(FIELDS):
        out = out + F.when(F.contains(c, F.lit(field)), 1 << i).otherwise(0)
    return out.cast("int")


def field_hits(query: Column, text: Column) -> Column:
    """Fields that both name; one within another counts as well."""
    return F.bit_count(field_mask(query).bitwiseAND(field_mask(text))).cast("int")


def _spans(c: Column, n: int) -> Column:
    """All substrings of n characters."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - n + 1)), lambda i: F.substring(c, i, F.lit(n)))


def structured(queries: DataFrame, rows: DataFrame, k: int = 10) -> DataFrame:
    """query_id, key, rank, score: the best payroll rows of each question about pay.

    ``queries``: query_id, query, identity (the asker's name or null); ``rows``: key, month, name
    (null or empty: no person's), text. A row of another month than the one asked for is out; it
    counts 20 for the month, 100 for the person named (or the asker), 50 for a total that is asked
    for, 1 for another person, 10 for each field; what has nothing is out. Ties go to the smaller key.

    The score depends on a row's month, fields, kind and, for the person asked for, name. So rows
    are reduced to the first k of each such class (before the shuffle, as a rank within a window).
    Of a question it takes the month, fields and words of totals, so classes of rows are ranked once
    for each such class of questions. A question meets the first k of its class, which hold what it
    has of them among its own first k, and names by the substrings of its text of a name's length.
    """
    name = F.nullif(F.trim(F.coalesce("name", F.lit(""))), F.lit(""))
    text = F.coalesce("text", F.lit(""))
    base = rows.select("key", F.coalesce("month", F.lit(-1)).cast("int").alias("month"), name.alias("name"), field_mask(text).alias("mask"), F.contains(text, F.lit("合计")).alias("total"))
    first = lambda *by: base.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("key"))).where(F.col("_n") <= k).drop("_n")
    kind = F.when(F.col("name").isNotNull(), "named").when(F.col("total"), "total").otherwise("plain")
    heads = cut(first("month", "mask", kind).select("key", "month", "mask", kind.alias("kind")))
    people = cut(first("month", "mask", "name").where("name is not null").select("key", "month", "mask", "name"))
    lengths = [r[0] for r in people.select(F.length("name")).distinct().collect()]  # a few numbers
    q = F.coalesce("query", F.lit(""))
    asked = queries.where(any_of(q, GATE)).select("query_id", q.alias("q"), F.coalesce("identity", F.lit("")).alias("identity"), T.month_of(q).alias("asked")).withColumn("q_mask", field_mask(F.col("q")))
    asked = asked.withColumn("sum", F.contains("q", F.lit("总额"))).withColumn("all", any_of(F.col("q"), TOTAL_WORDS))
    # questions are a small file, which would be read, spread and joined by one task
    asked = asked.repartition(shuffle_partitions(rows.sparkSession), "query_id")
    fits = F.col("asked").isNull() | (F.col("asked") == F.col("month"))
    base_score = F.when(F.col("asked").isNotNull(), 20).otherwise(0) + 10 * F.bit_count(F.col("mask").bitwiseAND(F.col("q_mask"))).cast("int")
    total = ((F.col("kind") == "total") | ((F.col("kind") == "plain") & F.col("sum"))) & F.col("all")
    form = F.struct(F.coalesce("asked", F.lit(0)).alias("asked"), "q_mask", "sum", "all")
    forms = cut(asked.select("asked", "q_mask", "sum", "all", form.alias("form")).distinct())
    ranked = heads.join(F.broadcast(forms), fits).select("form", "key", (base_score + F.when(F.col("kind") == "named", 1).when(total, 50).otherwise(0)).alias("score")).where("score > 0")
    place = F.row_number().over(Window.partitionBy("form").orderBy(F.desc("score"), "key"))
    best = cut(ranked.withColumn("_n", place).where(F.col("_n") <= k).groupBy("form").agg(F.collect_list(F.struct("key", "score")).alias("best")))
    general = join_small(asked.select("query_id", form.alias("form")), best, ["form"]).select("query_id", F.explode("best").alias("x")).select("query_id", "x.key", "x.score")
    spans = F.flatten(F.array(*[_spans(F.col("q"), n) for n in lengths])) if lengths else F.array().cast("array<string>")
    self_ = F.when(F.contains("q", F.lit("我")) & (F.col("identity") != ""), F.array("identity")).otherwise(F.array().cast("array<string>"))
    named = asked.select("query_id", "asked", "q_mask", F.explode(F.array_distinct(F.concat(spans, self_))).alias("name"))
    own = named.join(people, "name").where(fits).select("query_id", "key", (base_score + 100).alias("score"))
    scored = general.unionByName(own).where("score > 0").groupBy("query_id", "key").agg(F.max("score").cast("long").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key"))
    return scored.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "key", "rank", "score")
