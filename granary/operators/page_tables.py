"""Pipe tables that go on over page breaks, put together without a fold over a file's pages.

A page is read on its own: whether it may go on a table, and whether a table is open at its end if it
does and if it doesn't. So a page is a map from "open before" to "open after", and maps are composed
over blocks of pages; no file is folded in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import TABLE_ROW, TABLE_RULE
from granary.plans.cluster import cut

# How far a page is searched for rows that go on, and for a repeated head.
START_LINES, HEAD_LINES = 8, 12

LOOSE_RULE = r"^\s*\|[\s:\-|]+\|\s*$"


def _kind(x: Column) -> Column:
    """b: blank, r: rule, t: row, x: other."""
    rule = x.rlike(TABLE_RULE) | x.rlike(LOOSE_RULE)
    row = x.rlike(TABLE_ROW) | (F.regexp_count(x, F.lit(r"\|")) >= 3)
    return F.when(x.rlike(r"(?U)^\s*$"), "b").when(rule, "r").when(row, "t").otherwise("x")


def _head(x: Column) -> Column:
    return x.rlike(r"^\s*\|") | (F.regexp_count(x, F.lit(r"\|")) >= 2)


def _open_end(kinds: Column) -> Column:
    return F.regexp_replace(kinds, "b", "").rlike("[rt]$")


def _trailing(kinds: Column) -> Column:
    """How many lines stand before the blank ones at the end."""
    return F.length(F.regexp_replace(kinds, "b+$", ""))


def page_parts(pages: DataFrame) -> DataFrame:
    """``pages`` with starts, open_alone, open_after and its lines as whole, lead and rows.

    lead: the text before the table of a page that goes on; rows: the page from its first row, without
    repeated heads. Lines are classed once, as one letter each, and all else is read off these letters.
    """
    split = pages.withColumn("_lines", F.split(F.coalesce("text", F.lit("")), "\n"))
    marks = F.transform("_lines", lambda x: F.concat(_kind(x), F.when(_head(x), "|").otherwise(" ")))
    lettered = split.withColumn("_marks", F.array_join(marks, ""))
    kinds = F.regexp_replace("_marks", "(.).", "$1")
    # a head is a line of cells that a rule follows
    heads = F.regexp_replace(F.regexp_replace("_marks", r".\|(?=r)", "h."), r"(.).", "$1")
    at = lettered.withColumn("_kinds", kinds).withColumn("_heads", F.regexp_replace(heads, "[^h]", "."))
    repeated = F.instr(F.substring("_heads", 1, HEAD_LINES - 1), "h")
    first = F.when(repeated > 0, repeated + 2).otherwise(1)
    before = F.length(F.regexp_extract(F.substr("_kinds", F.col("_first"), F.greatest(F.lit(0), HEAD_LINES + 1 - F.col("_first"))), "^[bx]*", 0))
    at = at.withColumn("_repeated", repeated).withColumn("_first", first).withColumn("_row", F.col("_first") + before)
    rest = lambda c: F.substr(c, F.col("_row"))
    at = at.withColumn("_gone", F.regexp_replace(rest(F.col("_heads")), "h.", "##"))
    n = F.size("_lines")
    cut_out = lambda start, length: F.slice("_lines", start, F.greatest(F.lit(0), length))
    lead = F.filter(F.concat(cut_out(F.lit(1), F.col("_repeated") - 1), cut_out(F.col("_first"), F.col("_row") - F.col("_first"))), lambda x: ~x.rlike(r"(?U)^\s*$"))
    zipped = F.arrays_zip(cut_out(F.col("_row"), n + 1 - F.col("_row")).alias("line"), F.split(rest(F.col("_kinds")), "").alias("kind"), F.split("_gone", "").alias("gone"))
    at = at.withColumn("_lead", lead).withColumn("_left", F.filter(zipped, lambda z: z["line"].isNotNull() & (z["gone"] != "#")))
    at = at.withColumn("_left_kinds", F.array_join(F.col("_left.kind"), ""))
    parted = lambda lines, kinds: F.struct(F.slice(lines, F.lit(1), _trailing(kinds)).alias("body"), F.slice(lines, _trailing(kinds) + 1, F.greatest(F.lit(0), F.size(lines) - _trailing(kinds))).alias("tail"))
    return at.select(
        *pages.columns,
        F.substring(F.regexp_replace("_kinds", "b", ""), 1, START_LINES).contains("t").alias("starts"),
        _open_end(F.col("_kinds")).alias("open_alone"),
        (_open_end(F.col("_left_kinds")) | ~F.col("_left_kinds").rlike("[^b]")).alias("open_after"),
        parted(F.col("_lines"), F.col("_kinds")).alias("whole"),
        F.when(F.size("_lead") > 0, F.array_append("_lead", F.lit(""))).otherwise(F.array().cast("array<string>")).alias("lead"),
        parted(F.col("_left.line"), F.col("_left_kinds")).alias("rows"),
    )


def _state(before: Column, w) -> Column:
    """Open after the rows of window ``w``: the last fixed value, turned over as often as maps turn it since."""
    turns = F.coalesce(F.sum(F.col("_turn").cast("int")).over(w), F.lit(0))
    last = F.last(F.col("_fixed"), True).over(w)
    since = turns - F.coalesce(last["turns"], F.lit(0))
    return F.coalesce(last["value"], before) != (since % 2 == 1)


def _in_block(flags: DataFrame, order: list[str]) -> tuple[DataFrame, Window]:
    """``flags`` with _n, the page's place in its block, and _if_closed and _if_open: open before it, by the block's state."""
    upto = Window.partitionBy("file", "_block").orderBy(*order)
    closed, opened = F.col("open_alone"), F.when(F.col("starts"), F.col("open_after")).otherwise(F.col("open_alone"))
    turned = flags.withColumn("_turn", closed & ~opened)
    so_far = F.sum(F.col("_turn").cast("int")).over(upto.rowsBetween(Window.unboundedPreceding, 0))
    fixed = turned.withColumn("_fixed", F.when(closed == opened, F.struct(closed.alias("value"), so_far.alias("turns"))))
    within = upto.rowsBetween(Window.unboundedPreceding, -1)
    states = fixed.withColumn("_if_closed", _state(F.lit(False), within)).withColumn("_if_open", _state(F.lit(True), within))
    return states.withColumn("_n", F.row_number().over(upto)).drop("_turn", "_fixed"), upto


def _with_starts(local: DataFrame, before: DataFrame) -> DataFrame:
    """``local`` with goes_on and, for a page that doesn't, _own: the start of an island."""
    other = before.withColumnsRenamed({"file": "_other_file", "_block": "_other_block"})
    joined = local.join(other, F.col("file").eqNullSafe(F.col("_other_file")) & (F.col("_block") == F.col("_other_block"))).drop("_other_file", "_other_block")
    known = joined.withColumn("goes_on", F.when(F.col("_before"), F.col("_if_open")).otherwise(F.col("_if_closed")) & F.col("starts"))
    return known.withColumn("_own", F.when(~F.col("goes_on"), F.struct("page", F.col("_n").alias("n"), F.col("_block").alias("block"))))


def continued_pages(pages: DataFrame, block: int = 4_096) -> DataFrame:
    """``pages`` (file, page, text, any others) with goes_on, page_start (the page at which its table began), island, place and parts.

    Pages follow one another by number, those of equal number by a hash of their text; null files are
    one file and null numbers come first. Null texts are empty. Sums run over blocks of page numbers, so
    a file with a large part of all pages is dealt over many tasks; the states between blocks come from
    a cut table of flags, and texts are shuffled once. ``pages`` is read twice.
    """
    keys, order = ["file", "_block"], ["page", "_hash"]
    marked = page_parts(pages).drop("whole", "lead", "rows").withColumn("_block", F.coalesce(F.floor(F.col("page") / block), F.lit(-(2**62)))).withColumn("_hash", F.xxhash64("text"))
    flags = cut(marked.select(*keys, *order, "starts", "open_alone", "open_after"))
    blocks = Window.partitionBy("file").orderBy("_block")
    earlier = blocks.rowsBetween(Window.unboundedPreceding, -1)
    local, _ = _in_block(flags, order)
    # a block is one map too, that of its last page
    after = lambda c: F.when(F.col(c) & F.col("starts"), F.col("open_after")).otherwise(F.col("open_alone"))
    ends = local.groupBy(*keys).agg(F.max_by(F.struct(after("_if_closed").alias("closed"), after("_if_open").alias("opened")), "_n").alias("m"))
    ends = ends.withColumn("_turn", F.col("m.closed") & ~F.col("m.opened"))
    turned = F.sum(F.col("_turn").cast("int")).over(blocks.rowsBetween(Window.unboundedPreceding, 0))
    ends = ends.withColumn("_fixed", F.when(F.col("m.closed") == F.col("m.opened"), F.struct(F.col("m.closed").alias("value"), turned.alias("turns"))))
    before = ends.select(*keys, _state(F.lit(False), earlier).alias("_before"))
    # the last start of the blocks before, for islands that reach into a block
    last = _with_starts(local, before).groupBy(*keys).agg(F.any_value("_before").alias("_before"), F.max_by("_own", F.when(~F.col("goes_on"), F.col("_n"))).alias("_last"))
    states = cut(last.select(*keys, "_before", F.last("_last", True).over(earlier).alias("_carried")))
    placed, upto = _in_block(marked, order)
    known = _with_starts(placed, states)
    start = F.coalesce(F.last("_own", True).over(upto.rowsBetween(Window.unboundedPreceding, 0)), F.col("_carried"))
    named = known.withColumn("_start", start).select(*pages.columns, "goes_on", F.col("_start.page").alias("page_start"), F.struct("_start.block", "_start.n").alias("island"), F.struct(F.col("_block").alias("block"), F.col("_n").alias("n")).alias("place"))
    return page_parts(named).drop("starts", "open_alone", "open_after")


def merged_tables(pages: DataFrame, block: int = 4_096) -> DataFrame:
    """file, page_start, page_end, pages, text: one row for pages that no table goes beyond.

    Of a page that goes on, the rows follow the last row before it without their repeated head, and what
    stood above them comes before everything; other pages stay as they are. A row holds as many pages as
    its table has.
    """
    parts = continued_pages(pages, block)
    no_lines = F.array().cast("array<string>")
    piece = F.struct("place", "page", F.when(F.col("goes_on"), F.col("lead")).otherwise(no_lines).alias("lead"), F.when(F.col("goes_on"), F.col("rows.body")).otherwise(F.col("whole.body")).alias("body"), F.when(F.col("goes_on"), F.col("rows.tail")).otherwise(F.col("whole.tail")).alias("tail"))
    grouped = parts.groupBy("file", "island", "page_start").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    lines = F.concat(F.flatten(F.reverse(F.col("p.lead"))), F.flatten(F.col("p.body")), F.flatten(F.reverse(F.col("p.tail"))))
    return grouped.select("file", "page_start", F.element_at("p", -1)["page"].alias("page_end"), F.size("p").cast("long").alias("pages"), F.array_join(lines, "\n").alias("text"))
