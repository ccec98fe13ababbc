"""Tables over page breaks against a fold that reads a file's pages in order."""

import random
import re

from granary.operators.page_tables import continued_pages, merged_tables

RULE = re.compile(r"^\s*\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)+\|?\s*$|^\s*\|[\s:\-|]+\|\s*$")
SCHEMA = "file string, page long, text string"


def cells(line):
    return bool(line.strip()) and bool(RULE.match(line) or re.match(r"^\s*\|(.+)\|\s*$", line) or line.count("|") >= 3)


def head(lines, i):
    return i + 1 < len(lines) and bool(RULE.match(lines[i + 1])) and (lines[i].lstrip().startswith("|") or lines[i].count("|") >= 2)


def folded(pages):
    """[(first, last, count, text)] of one file's (page, text)."""
    done = []
    for page, text in pages:
        lines = (text or "").split("\n")
        known = done[-1] if done else None
        shown = [x for x in known[3] if x.strip()] if known else []
        if shown and cells(shown[-1]) and any(cells(x) and not RULE.match(x) for x in [x for x in lines if x.strip()][:8]):
            top = lines[:12]
            i = next((i for i in range(len(top) - 1) if head(top, i)), None)
            lead, rest = ([], top) if i is None else (top[:i], top[i + 2 :])
            while rest and not cells(rest[0]):
                lead.append(rest.pop(0))
            rest, rows, i = rest + lines[12:], [], 0
            while i < len(rest):
                if head(rest, i):
                    i += 2
                else:
                    rows.append(rest[i])
                    i += 1
            at = max(i for i, x in enumerate(known[3]) if cells(x)) + 1
            lead = [x for x in lead if x.strip()]
            known[3] = (lead + [""] if lead else []) + known[3][:at] + rows + known[3][at:]
            known[1], known[2] = page, known[2] + 1
        else:
            done.append([page, page, 1, lines])
    return [(a, b, n, "\n".join(x)) for a, b, n, x in done]


def check(spark, files, block):
    rows = [(f, p, t) for f, pages in files.items() for p, t in pages]
    got = sorted((r.file, r.page_start, r.page_end, r.pages, r.text) for r in merged_tables(spark.createDataFrame(rows, SCHEMA), block).collect())
    want = sorted((f, *x) for f, pages in files.items() for x in folded(sorted(pages)))
    assert got == want


def test_random_pages_equal_the_fold(spark):
    rng = random.Random(5)
    lines = ["", " ", "words", "a | b", "a | b | c", "a|b|c|d", "| a | b |", "| 1 | 2 |", "| 1 | 2 |", "|---|---|", "--- | ---", "| |", "(continued)"]
    for block in (3, 4096):
        files = {f"f{i}": [(p, "\n".join(rng.choices(lines, k=rng.choice((1, 2, 3, 5, 9, 16))))) for p in range(rng.randint(1, 14))] for i in range(60)}
        check(spark, files, block)


def test_a_table_over_pages_of_many_blocks(spark):
    top = "| a | b |\n|---|---|\n"
    pages = [(0, "# Title\n" + top + "| 0 | 0 |\n"), *[(p, f"(page {p})\n\n{top}| {p} | x |\n") for p in range(1, 40)], (40, "| last | x |\nend"), (41, "| own | x |")]
    check(spark, {"f": pages}, 4)
    row = merged_tables(spark.createDataFrame([("f", *p) for p in pages], SCHEMA), 4).where("pages > 1").first()
    assert (row.page_start, row.page_end, row.pages) == (0, 40, 41) and row.text.count("|---|---|") == 1


def test_odd_rows(spark):
    assert merged_tables(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, 1, "| a | b |"), (None, 2, "| c | d |"), ("f", None, "| a | b |"), ("f", 1, None), ("f", 2, "| c | d |"), ("g", 1, "| x | y |"), ("g", 1, "| x | y |"), ("h", 1, "| a | b |\n" * 20_000)]
    got = {(r.file, r.page_start, r.page_end, r.pages) for r in merged_tables(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(None, 1, 2, 2), ("f", None, None, 1), ("f", 1, 1, 1), ("f", 2, 2, 1), ("g", 1, 1, 2), ("h", 1, 1, 1)}


def test_other_columns_stay(spark):
    df = spark.createDataFrame([("f", 1, "| a | b |", 7), ("f", 2, "| c | d |", 8)], SCHEMA + ", goes long")
    assert [(r.goes, r.goes_on, r.page_start) for r in continued_pages(df).orderBy("page").collect()] == [(7, False, 1), (8, True, 1)]


def test_a_repeated_head_goes(spark):
    check(spark, {"f": [(1, "| a | b |\n|---|---|\n| 1 | 1 |"), (2, "| a | b |\n|---|---|\n| 2 | 2 |\nend"), (3, "x")]}, 4096)
