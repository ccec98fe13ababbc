"""The media query against a plain reading of the same rows."""

import hashlib
import re
import zlib

import pytest

from granary.llm import media
from granary.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    rows = [(1, "one\ntwo\n\n  \nthree & <b>four</b>", "<script>", "s", 1), (2, None, None, None, None), (3, "", "<img src='x'>", "s", 0), (None, "no id <figcaption>x</figcaption>", "en", "s", 1)]
    rows += [(4, "&amp; \x00 é</p><img src=\"sha256:00\">", 'a"b', "s", 1), (5, "x" * 576, "en", "s", 1), (6, "x" * 575, "en", "s", 1)]
    return rows + [(100 + i, "the same text", "en", "s", 13) for i in range(3000)] + [(7, "twice", "en", "s", 5)] * 2


def test_query(spark, rows, tmp_path):
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(str, (r.asDict() for r in QUERIES["op9_media_sequences"](spark, str(tmp_path)).drop("feature").collect())))
    want = []
    for doc_id, text, *_ in rows:
        raw = (text or "").encode()
        padded = raw + b"\xff" * ((-len(raw)) % 576 or (576 if not raw else 0))
        stored = b"P5\n24 %d\n255\n" % (len(padded) // 24) + padded
        lines = sum(bool(x.strip()) for x in (text or "").split("\n"))
        want.append({"doc_id": doc_id, "n_bytes": len(raw), "n_segments": lines + 1, "payload_bytes": len(padded), "payload_sha256": hashlib.sha256(padded).hexdigest(), "tail_crc32": zlib.crc32(padded[-32:]), "media_bytes": len(stored), "media_sha256": hashlib.sha256(stored).hexdigest(), "position": lines, "caption": None if doc_id is None else str(doc_id)})
    for w in want:
        w["caption"] = w["caption"] or next(r[2] for r in rows if r[0] is None)  # an empty caption leaves the alternative text
    assert got == sorted(map(str, want))


def test_texts_come_back_whole(spark, rows):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows[:7], DOCS)
    pages = docs.select("doc_id", "text", media.page_of(F.col("text"), F.lit("00"), F.col("lang"), F.col("doc_id").cast("string")).alias("html"))
    for r in media.interleaved(pages).collect():
        want = [" ".join(x.split()) for x in (r["text"] or "").split("\n") if x.strip()]
        assert [s["text"] for s in r["segments"] if s["kind"] == "text"] == want
        assert [s["position"] for s in r["segments"]] == list(range(len(want) + 1))


def test_empty(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["op9_media_sequences"](spark, str(tmp_path)).count() == 0


def test_damaged_media_raise(spark):
    with pytest.raises(ValueError):
        media.read_image(re.sub(b"255", b"254", media.store_image(b"x" * 576), count=1))
