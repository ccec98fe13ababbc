"""Normalising of pages and chunks, and what a file's name and flags tell about them."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from granary.functions import text as T

# A line of one CJK character, text of symbols only, words of file names, endings, terms of questions.
ONE_CJK = r"[\x{4e00}-\x{9fff}]"
SYMBOLS = r"(?U)^[\W_]+$"
SALARY_NAMES, FINANCE_NAMES = ("工资", "salary", "员工工资表"), ("财务", "财报", "报表", "finance")
POLICY_NAMES, POLICY_ENDINGS = ("知识库", "制度", "规章", "手册", "政策", "年假", "请假"), (".doc", ".docx", ".md", ".markdown", ".txt")
FORMAT_TYPES = ("md", "markdown", "txt", "pdf", "doc", "docx", "general")
PROCEDURAL = ("怎么", "如何", "步骤", "预约", "流程", "操作", "做法", "指南", "how to", "steps")
QUERY_MARKS, LEAVE_WORDS = "，。？！、；：,.?!", ("年假", "请假", "事假", "病假", "调休", "休假")


@F.arrow_udf(StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    # a batch may hold 10000 long texts, of which few are Python strings at a time
    few = 64
    parts = [pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts.slice(at, few).to_pylist()], pa.string()) for at in range(0, len(texts), few)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def nfkc(c: Column) -> Column:
    """Compatibility form; Spark has no expression for it, so only texts with other than ASCII go to Python."""
    plain = F.coalesce(c, F.lit(""))
    return F.when(plain.rlike(r"^[\x{00}-\x{7F}]*$"), plain).otherwise(_nfkc(plain))


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def _unix_lines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def _few_blank_lines(c: Column) -> Column:
    return F.regexp_replace(c, "\n{3,}", "\n\n")


def joined_cjk_lines(c: Column) -> Column:
    """Runs of lines of one CJK character each as one line (text that was read column by column)."""
    white = r"[^\S\n]*"
    return F.regexp_replace(c, rf"(?m)^{white}({ONE_CJK}){white}\n(?={white}{ONE_CJK}{white}$)", "$1")


def page_text(c: Column) -> Column:
    """A page without page numbers and superfluous space; its words stay as they are."""
    lines = F.transform(F.split(joined_cjk_lines(_unix_lines(nfkc(c))), "\n"), lambda x: stripped(F.regexp_replace(x, r"[ \t\r\f\x0B]+", " ")))
    kept = F.filter(lines, lambda x: ~x.rlike(T.PAGE_NUMBER))
    return stripped(_few_blank_lines(F.array_join(kept, "\n")))


def chunk_text(c: Column) -> Column:
    """A chunk with superfluous space squeezed."""
    return stripped(_few_blank_lines(F.regexp_replace(_unix_lines(nfkc(c)), r"[ \t\r\f\x0B]+", " ")))


def is_informative(c: Column) -> Column:
    """More than one character, and not symbols only."""
    s = stripped(F.coalesce(c, F.lit("")))
    return (F.length(s) > 1) & ~s.rlike(SYMBOLS)


def text_source(layout_ocr: Column, ocr: Column, doc_type: Column, source: Column) -> Column:
    """Where a text comes from: by flags, then by type, then by the file's ending."""
    yes = lambda c: F.coalesce(c.cast("boolean"), F.lit(False))
    kind, path = F.lower(F.coalesce(doc_type, F.lit(""))), F.lower(F.coalesce(source, F.lit("")))
    ends = lambda *xs: path.rlike("(" + "|".join(x.replace(".", r"\.") for x in xs) + r")\z")
    return (
        F.when(yes(layout_ocr), "layout_ocr").when(yes(ocr), "ocr").when(kind.isin("md", "markdown"), "md").when(kind.isin("docx", "doc", "word"), "docx")
        .when(ends(".pdf"), "layout_ocr").when(ends(".txt"), "txt").when(ends(".md", ".markdown"), "md").when(ends(".doc", ".docx"), "docx").otherwise("unknown")
    )


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.coalesce(path, F.lit("")), "/"), -1)


def any_of(c: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(c, w))


def business_metadata(path: Column, doc_type: Column, sensitivity: Column, owner_role: Column, department: Column) -> Column:
    """Struct of doc_type, sensitivity_level, owner_role, department: given values first, then by the file's name.

    A document type that only names a format is replaced.
    """
    name = base_name(path)
    low = F.lower(name)
    kind = F.when(any_of(low, SALARY_NAMES), "salary").when(any_of(low, FINANCE_NAMES), "finance").when(any_of(name, POLICY_NAMES) | name.rlike("(" + "|".join(x.replace(".", r"\.") for x in POLICY_ENDINGS) + r")\z"), "policy").otherwise("general")
    given = F.lower(F.trim(F.coalesce(doc_type, F.lit(""))))
    set_ = lambda c, other: F.when(F.coalesce(c, F.lit("")) != "", c).otherwise(other)
    return F.struct(
        F.when((given == "") | given.isin(*FORMAT_TYPES), kind).otherwise(doc_type).alias("doc_type"),
        set_(sensitivity, F.when(kind.isin("salary", "finance"), "confidential").otherwise("internal")).alias("sensitivity_level"),
        set_(owner_role, F.when(kind == "salary", "self").when(kind == "finance", "finance_admin").otherwise("employee")).alias("owner_role"),
        set_(department, F.when(kind == "finance", "财务部").otherwise("")).alias("department"),
    )


def is_procedural(query: Column, words: tuple[str, ...] = PROCEDURAL) -> Column:
    return any_of(F.lower(F.trim(F.coalesce(query, F.lit("")))), tuple(w.lower() for w in words if w))


def wants_rewrite(query: Column) -> Column:
    """Short questions, and those about leave."""
    q = F.trim(F.coalesce(query, F.lit("")))
    n = F.length(q)
    return (n > 0) & ((n <= 4) | ((n <= 8) & ~any_of(q, tuple(QUERY_MARKS))) | any_of(q, LEAVE_WORDS))


def parent_key(employee_id: Column, employee_name: Column, file: Column, i: Column) -> Column:
    """A key of a section's owner that no other row of a file shares: id, name, or place and file."""
    word = lambda c: F.nullif(F.trim(F.coalesce(c.cast("string"), F.lit(""))), F.lit(""))
    place = F.concat(F.lit("doc-"), i.cast("string"))
    return F.coalesce(F.concat(F.lit("emp-"), word(employee_id)), F.concat(F.lit("name-"), word(employee_name)), F.concat(place, F.lit("-"), F.nullif(base_name(F.trim(file)), F.lit(""))), place)


def is_table_line(c: Column) -> Column:
    """A rule, a row, or a line of three pipes or more."""
    s = F.trim(F.coalesce(c, F.lit("")))
    return s.rlike(T.TABLE_RULE) | s.rlike(T.TABLE_ROW) | (F.regexp_count(s, F.lit(r"\|")) >= 3)
