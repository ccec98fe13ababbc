"""URL filter: a fixed rule list first, then association rules mined from labelled urls.

Spark's FP-growth mines token combinations of labelled urls together with the label token;
tokens that always occur together are one item. Rules ``items -> blocked`` are pruned by hits,
support, confidence, significance (against the share of bad urls) and redundancy (a rule goes if
a subset of its items is as confident) and matched through an inverted index: every rule waits
under its rarest item, urls look up their own items there.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and
is allowed; empty tables give empty results; repeated rows are judged alike, and labelled rows
that repeat count as often; no labelled row or no frequent set means no mined rules, so everything
the fixed rules leave open is allowed.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.plans.cluster import cut, join_small

#: The stated allow and block rules, ``host/path``.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
BLOCKED = "label=block"
#: Hits that a rule rests on at least, and the normal quantile of its interval (one-sided, 1 %).
MIN_HITS, Z = 10, 2.33


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (or null) and its verdict."""
    rule, verdict = [], []
    for kind, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        rule.append(F.when(fits, F.lit(text)))
        verdict.append(F.when(fits, F.lit(kind)))
    return F.coalesce(*rule), F.coalesce(*verdict)


def tokens_of(url: Column) -> Column:
    """Host labels, path segments (digits become 0), the extension and query keys, without repeats."""
    host, path = host_of(url), path_of(url)
    tag = lambda k, xs: F.transform(F.filter(xs, lambda x: x != ""), lambda x: F.concat(F.lit(k), x))
    segments = F.transform(F.split(path, "/"), lambda x: F.regexp_replace(x, r"\d+", "0"))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.element_at(F.split(x, "="), 1))
    return F.array_distinct(F.concat(tag("h=", F.split(host, r"\.")), tag("p=", segments), tag("q=", keys)))


def merged_tokens(rows: DataFrame, least: int) -> DataFrame:
    """token, item of the tokens met in at least ``least`` of ``rows`` (id, tokens).

    Tokens that are met in the same rows are one item, named by the smallest of them: n tokens that
    always go together would else give 2**n sets of equal support. Exact up to 64-bit hashes of rows.
    """
    h = F.xxhash64("id")
    halves = [F.sum(F.shiftrightunsigned(h, 32)).alias("s1"), F.sum(h.bitwiseAND(0xFFFFFFFF)).alias("s2")]
    found = rows.select("id", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"), *halves).where(F.col("n") >= least)
    first = found.groupBy("n", "s1", "s2").agg(F.min("token").alias("item"))
    return found.join(first, ["n", "s1", "s2"]).select("token", "item")


def items_of(rows: DataFrame, tokens: DataFrame, kept: list[str]) -> DataFrame:
    """``kept`` columns of ``rows`` (tokens, ...) with ``items``: those of its tokens, without repeats; none: no row."""
    one = rows.withColumn("_token", F.explode("tokens")).select(*kept, "_token")
    return join_small(one, tokens.withColumnRenamed("token", "_token"), ["_token"]).groupBy(*kept).agg(F.collect_set("item").alias("items"))


def significant(hits: Column, freq: Column, base: float, z: float = Z) -> Column:
    """Whether the lower end of the one-sided Wilson interval of hits / freq is above ``base``."""
    p = hits / freq
    low = (p + z * z / (2 * freq) - z * F.sqrt(p * (1 - p) / freq + z * z / (4 * freq * freq))) / (1 + z * z / freq)
    return low > base


NO_RULES = "antecedent array<string>, confidence double, support double, anchor string"


def mine_rules(labelled: DataFrame, min_support: float = 0.005, min_confidence: float = 0.6, min_hits: int = MIN_HITS) -> tuple[DataFrame, DataFrame]:
    """Rules from ``labelled`` (url, bad): antecedent (items), confidence, support, anchor; and the token table.

    All labelled rows are mined; those with a null url or label are left out. A rule is kept if it
    rests on ``min_hits`` hits at least, has the support and the confidence, is significantly above
    the share of bad rows, and no rule of fewer items is as confident.
    """
    spark = labelled.sparkSession
    rows = cut(labelled.where("url is not null and bad is not null").select(F.col("bad").cast("boolean").alias("bad"), tokens_of(F.col("url")).alias("tokens")).where(F.size("tokens") > 0).withColumn("id", F.monotonically_increasing_id()))
    total, bad = rows.agg(F.count("*"), F.count_if("bad")).first()
    none = spark.createDataFrame([], NO_RULES), spark.createDataFrame([], "token string, item string")
    least = max(min_hits, math.ceil(min_support * total))
    if bad < least:
        return none
    tokens = cut(merged_tokens(rows, least))
    items = cut(items_of(rows, tokens, ["id", "bad"]).select("bad", "items"))
    # the label is an item too, so only sets of at least `least` hits matter
    baskets = items.select(F.when(F.col("bad"), F.array_append("items", BLOCKED)).otherwise(F.col("items")).alias("items"))
    n = baskets.count()
    if not n:
        return none
    sets = cut(FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n).fit(baskets).freqItemsets.select(F.array_sort("items").alias("items"), "freq"))
    with_label = sets.where(F.array_contains("items", BLOCKED) & (F.size("items") > 1)).select(F.array_remove("items", BLOCKED).alias("antecedent"), F.col("freq").alias("hits"))
    rules = with_label.join(sets.select(F.col("items").alias("antecedent"), "freq"), "antecedent").where(significant(F.col("hits"), F.col("freq"), bad / total)).select("antecedent", (F.col("hits") / F.col("freq")).alias("confidence"), (F.col("hits") / total).alias("support")).where(F.col("confidence") >= min_confidence)
    rules = cut(rules)
    # a rule is redundant if dropping one item leaves a rule that is as confident
    shorter = rules.select("antecedent", "confidence", F.explode("antecedent").alias("t")).select(F.col("antecedent").alias("long"), F.array_remove("antecedent", F.col("t")).alias("antecedent"), F.col("confidence").alias("c"))
    redundant = shorter.join(rules.select("antecedent", "confidence"), "antecedent").where("confidence >= c").select(F.col("long").alias("antecedent")).distinct()
    rules = rules.join(redundant, "antecedent", "left_anti")
    single = sets.where((F.size("items") == 1) & ~F.array_contains("items", BLOCKED)).select(F.col("items")[0].alias("t"), "freq")
    anchor = rules.select("antecedent", F.explode("antecedent").alias("t")).join(single, "t").groupBy("antecedent").agg(F.min_by("t", F.struct("freq", "t")).alias("anchor"))
    return cut(rules.join(anchor, "antecedent")), tokens


def judge(pages: DataFrame, labelled: DataFrame, rules=RULES, min_support: float = 0.005, min_confidence: float = 0.6, min_hits: int = MIN_HITS) -> DataFrame:
    """``pages`` (page_id, url, ...) -> page_id, host, path, rule, verdict, confidence.

    ``labelled`` has url and bad. The fixed rules decide where one fits; else a page is blocked
    if a mined rule's items are all in its url (``confidence``: that of the best such rule).
    """
    mined, tokens = mine_rules(labelled, min_support, min_confidence, min_hits)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    base = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    base = base.withColumn("rule", rule).withColumn("_fixed", verdict)
    if mined.isEmpty():
        found = base.withColumn("confidence", F.lit(None).cast("double"))
    else:
        open_urls = base.where("_fixed is null and url is not null").select("url").distinct().withColumn("tokens", tokens_of(F.col("url")))
        asked = items_of(open_urls, tokens, ["url"])
        met = join_small(asked.select("url", "items", F.explode("items").alias("anchor")), mined.select("anchor", "antecedent", F.col("confidence").alias("_c")).groupBy("anchor").agg(F.collect_list(F.struct("antecedent", "_c")).alias("_rules")), ["anchor"])
        fits = F.filter("_rules", lambda r: F.size(F.array_except(r["antecedent"], F.col("items"))) == 0)
        hits = met.select("url", F.array_max(F.transform(fits, lambda r: r["_c"])).alias("_c")).groupBy("url").agg(F.max("_c").alias("confidence"))
        found = base.join(hits, "url", "left")
    return found.select("page_id", "host", "path", "rule", F.coalesce("_fixed", F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")).alias("verdict"), F.when(F.col("_fixed").isNull(), F.col("confidence")).alias("confidence"))


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Urls of the pages whose id is labelled; bad: low quality or toxic."""
    bad = reduce(lambda a, b: a | b, [F.coalesce(F.col("quality") == 0, F.lit(False)), F.coalesce(F.col("toxic") == 1, F.lit(False))])
    return pages.select("page_id", "url").join(labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")), "page_id").select("url", "bad")
