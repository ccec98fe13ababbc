"""Text statistics, predicates and fingerprints as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes and line patterns of the cleaning rules.
CJK = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]"
GARBAGE = r"[\x{E000}-\x{F8FF}\x{F0000}-\x{10FFFD}\x{00}-\x{08}\x{0B}-\x{1F}\x{7F}]"
LATIN_WORD = r"[a-zA-Z0-9_]{2,}"
TERM = r"[\p{L}\p{N}]{2,}"
PAGE_NUMBER = r"^\s*(第\s*\d{1,4}\s*页|-\s*\d{1,4}\s*-|\d{1,4}\s*/\s*\d{1,4})\s*$"
TOC_LINE = r"^(\d+([.\-、]\d+)*|[一二三四五六七八九十百千万]+[章节篇])?\s*(.+?)\s*([.·•…\-—_\s]{3,}|[ \t]{2,})\s*(\d{1,4}|[一二三四五六七八九十百千万]{1,3})\s*$"
DECORATION = r"^\s*[-*_=#·•…\s]{8,}\s*$"
CROSS_REFERENCE = r"^\s*(参?见|参考|查阅|详见|参见|另见)\s*(第?\s*[一二三四五六七八九十百千万0-9]+([.\-、][一二三四五六七八九十百千万0-9]+)*\s*(章|节|小节|部分|段|条|篇|页)|附件\s*[0-9A-Z]+|附录\s*[A-Z0-9]+)\s*[。，,.]?\s*$"
TABLE_RULE = r"^\s*\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)+\|?\s*$"
TABLE_ROW = r"^\s*\|(.+)\|\s*$"


def matches(c: Column, pattern: str) -> Column:
    """How often the pattern is found; 0 for null."""
    return F.coalesce(F.regexp_count(c, F.lit(pattern)), F.lit(0)).cast("long")


def squeezed_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[ \t\r\f\x0B]+", " "))


def cjk_chars(c: Column) -> Column:
    return matches(c, CJK)


def latin_words(c: Column) -> Column:
    return matches(c, LATIN_WORD)


def informative_size(c: Column) -> Column:
    """CJK characters and words of two letters or more."""
    return cjk_chars(c) + latin_words(c)


def garbage_ratio(c: Column) -> Column:
    n = F.length(F.coalesce(c, F.lit("")))
    return F.when(n == 0, 0.0).otherwise(matches(c, GARBAGE) / n)


def token_estimate(c: Column) -> Column:
    """A quarter token for each ASCII character, two thirds for any other, rounded up."""
    text = F.coalesce(c, F.lit(""))
    ascii_ = F.length(F.regexp_replace(text, r"[^\x{00}-\x{7F}]", ""))
    return F.ceil(ascii_ / 4.0 + (F.length(text) - ascii_) / 1.5).cast("long")


def short_hash(c: Column) -> Column:
    return F.substring(F.sha2(F.coalesce(c, F.lit("")), 256), 1, 16)


def is_toc_page(c: Column, least: int = 5) -> Column:
    lines = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), F.trim), lambda x: x != "")
    hits = F.size(F.filter(lines, lambda x: x.rlike(TOC_LINE)))
    return (hits >= least) & (hits * 2 >= F.size(lines))


def without_noise_lines(c: Column) -> Column:
    """Without decoration lines and lines that only refer elsewhere."""
    return F.array_join(F.filter(F.split(c, "\n"), lambda x: ~x.rlike(DECORATION) & ~x.rlike(CROSS_REFERENCE)), "\n")


def table_data_rows(c: Column) -> Column:
    """Data rows of pipe tables: rows after a rule, and rows that no rule follows before one."""
    lines = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), F.trim), lambda x: x != "")
    pairs = F.arrays_zip(lines.alias("line"), F.slice(F.array_append(lines, F.lit("")), 2, F.size(lines)).alias("next"))
    pairs = F.transform(pairs, lambda p: F.struct(p["line"].rlike(TABLE_RULE).alias("rule"), p["line"].rlike(TABLE_ROW).alias("row"), F.coalesce(p["next"].rlike(TABLE_RULE), F.lit(False)).alias("before_rule")))
    start = F.struct(F.lit(False).alias("seen"), F.lit(0).alias("n"))

    def step(acc: Column, p: Column) -> Column:
        head = p["row"] & ~p["rule"] & ~acc["seen"] & p["before_rule"]
        return F.struct((acc["seen"] | p["rule"] | head).alias("seen"), (acc["n"] + F.when(p["row"] & ~p["rule"] & ~head, 1).otherwise(0)).alias("n"))

    return F.aggregate(pairs, start, step, lambda a: a["n"]).cast("long")


def quality_score(cjk: Column, chars: Column, words: Column, rows: Column, copies: Column) -> Column:
    """0 to 100: density, words, table rows, and how rarely the text recurs."""
    ratio = F.when(chars == 0, 0.0).otherwise(cjk / chars)
    return (F.least(F.lit(50), 2 * cjk + F.floor(50 * ratio)) + F.least(F.lit(20), words) + F.least(F.lit(20), 5 * rows) + F.greatest(F.lit(0), 10 - 2 * copies)).cast("long")


# Fields of pay sheets, which are search terms wherever they stand in a run of characters.
PAY_FIELDS = ("实发工资", "应发工资", "基本工资", "绩效工资", "岗位津贴", "社保", "公积金", "个税", "部门", "岗位")


def search_terms(c: Column) -> Column:
    """Distinct search terms: lower-cased words, dates, fields of pay sheets, and pairs of neighbouring CJK characters."""
    text = F.lower(F.coalesce(c, F.lit("")))
    words = F.regexp_extract_all(text, F.lit(f"({TERM})"), 1)
    dates = F.regexp_extract_all(text, F.lit(r"(\d{4}年|\d{1,2}月)"), 1)
    runs = F.regexp_extract_all(text, F.lit(r"([\x{4e00}-\x{9fff}]{2,})"), 1)
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, 2))))
    named = F.filter(F.array(*map(F.lit, PAY_FIELDS)), lambda field: F.contains(text, field))
    fields = F.when(F.size(runs) > 0, named).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(words, dates, fields, pairs))


def month_of(query: Column) -> Column:
    """The first month named in a query, 1 to 12, else null."""
    n = F.regexp_extract(query, r"(\d{1,2})\s*月", 1).try_cast("int")
    return F.when(n.between(1, 12), n)


def document_id(path: Column) -> Column:
    return F.concat(F.lit("doc_"), F.substring(F.sha2(path, 256), 1, 32))


def document_version(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def chunk_id(document: Column, version: Column, i: Column) -> Column:
    return F.concat(document, F.lit("_v_"), version, F.lit("_chunk_"), F.lpad(i.cast("string"), 5, "0"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def fixed_width(c: Column, width: int) -> Column:
    """Array of pieces of ``width`` characters."""
    n = F.ceil(F.length(c) / width).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(c, i * width + 1, F.lit(width)))).otherwise(F.array().cast("array<string>"))


def clamped_score(c: Column) -> Column:
    """Score within 0 and 1; null for what is no number."""
    x = c.try_cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
