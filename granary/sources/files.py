"""Loaders: text, Markdown, Word, Excel and JSON-lines files as DataFrames, through Spark's readers only."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


SCHEMA = "path string, sha256 string, kind string, page int, text string, error string"


def listing(spark: SparkSession, folder: str, kinds: tuple[str, ...] = ("txt", "md", "docx", "xlsx")) -> DataFrame:
    """path, kind, content, sha256 of the files with an allowed ending (in any case) in one folder."""
    files = spark.read.format("binaryFile").load(folder)
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.withColumn("kind", kind).where(F.col("kind").isin(*kinds)).select("path", "kind", "content", F.sha2("content", 256).alias("sha256"))


def markdown_text(raw: bytes) -> str:
    """UTF-8, else GBK; newlines unified, blank lines outside fences squeezed to one, one newline at the end."""
    try:
        text = raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = raw.decode("gbk", "ignore")
    out, fenced = [], False
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        if line.lstrip().startswith(("```", "~~~")):
            fenced = not fenced
        elif not fenced:
            line = line.rstrip() + ("  " if line.endswith("  ") and line.strip() else "")
            if not line and out and not out[-1]:
                continue
        out.append(line)
    return "\n".join(out).strip("\n") + "\n"


def word_text(raw: bytes) -> str:
    """Paragraphs first, then the rows of all tables, cells joined by bars."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml")).find(f"{w}body")
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{w}t")).strip()
    lines = [t for p in body.findall(f"{w}p") if (t := said(p))]
    for row in body.iter(f"{w}tr"):
        if cells := [t for c in row.findall(f"{w}tc") if (t := said(c))]:
            lines.append(" | ".join(cells))
    return "\n".join(lines)


def sheet_rows(raw: bytes) -> Iterator[tuple[str, list[str]]]:
    """(sheet, cells) of every row of a workbook."""
    m = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    book = zipfile.ZipFile(io.BytesIO(raw))
    shared = ["".join(t.text or "" for t in s.iter(f"{m}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in book.namelist() else []
    names = [s.get("name") for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{m}sheet")]
    for name, part in zip(names, sorted((n for n in book.namelist() if re.match(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"(\d+)\.xml", n)[1]))):
        for row in ElementTree.fromstring(book.read(part)).iter(f"{m}row"):
            cells: dict[int, str] = {}
            for c in row.iter(f"{m}c"):
                column = 0
                for letter in re.match(r"[A-Z]+", c.get("r", "A"))[0]:
                    column = column * 26 + ord(letter) - 64
                value = c.find(f"{m}v")
                text = "".join(t.text or "" for t in c.iter(f"{m}t")) if c.get("t") == "inlineStr" else (value.text or "") if value is not None else ""
                cells[column - 1] = shared[int(text)] if c.get("t") == "s" and text else text
            yield name, [cells.get(i, "") for i in range(max(cells, default=-1) + 1)]


def sheet_texts(raw: bytes, known: tuple[str, ...], scan: int = 20) -> list[str]:
    """``header：value`` lines of each data row; the header is the first row of the scan with most known names."""
    sheets: dict[str, list[list[str]]] = {}
    for name, cells in sheet_rows(raw):
        sheets.setdefault(name, []).append([c.strip() for c in cells])
    out = []
    for rows in sheets.values():
        scores = [sum(c in known for c in r) for r in rows[:scan]]
        if not scores or max(scores) < 2:
            continue
        head = scores.index(max(scores))
        for r in rows[head + 1 :]:
            if any(r):
                out.append("\n".join(f"{h}：{v}" for h, v in zip(rows[head], r) if h and v))
    return out


def load(spark: SparkSession, folder: str, known_headers: tuple[str, ...] = ()) -> DataFrame:
    """One row per document (a sheet's row is one); a file that fails is a row with its error."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, kind, content, sha in zip(pdf["path"], pdf["kind"], pdf["content"], pdf["sha256"]):
                try:
                    texts = sheet_texts(content, known_headers) if kind == "xlsx" else [word_text(content) if kind == "docx" else markdown_text(content) if kind == "md" else content.decode("utf-8", "replace")]
                    rows += [(path, sha, kind, i, t, None) for i, t in enumerate(texts)]
                except Exception as e:  # one broken file must not end the load
                    rows.append((path, sha, kind, 0, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return listing(spark, folder).mapInPandas(parse, SCHEMA)


def eval_samples(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Samples of a JSON-lines file; blank lines, comments and broken lines are left out."""
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(ltrim(value), '#')")
    return lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("s")).select("s.*").where("id is not null")
