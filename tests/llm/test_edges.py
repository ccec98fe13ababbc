"""Extra columns whose names clash with internal ones, nulls in every column, and empty tables."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from granary.llm import chat, html_template, media, mixing, simhash, substring, topk, toxicity, url_rules
from granary.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["score", "toxic", "size", "rounds", "kept", "n_words", "n_removed", "_text", "_gone", "_key", "_rows", "_rounds", "_copy", "_row", "_body", "_doc", "_at", "_cut", "_h", "_salt", "_n", "_rank", "body", "fp", "id", "bits", "component_id", "source_size", "target", "_source", "_size", "quality", "segments", "html"]


def with_clashes(df, names=CLASH):
    return df.select("*", *[F.lit(f"extra {n}").alias(n) for n in names if n not in df.columns])


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(12)
    say = lambda n: " ".join(f"t{r.randrange(200)}" for _ in range(n))
    rows = [(i, say(90) + (" moronic" if i % 4 == 0 else ""), "en", f"s{i % 3}", 90) for i in range(160)]
    rows += [(200, rows[1][1], "en", "s1", 90), rows[2], (300, None, None, None, None), (301, "", "xx", "", 0), (None, say(30), "en", "s1", 1), (302, "word " * 9000, "de", None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def folder(docs, spark, tmp_path_factory):
    home = tmp_path_factory.mktemp("tables")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(160)] + [(None, None, None), (5, None, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{home}/labels.parquet")
    with_clashes(labels, ["text", "lang", "url"]).write.parquet(f"{home}/labels2.parquet")
    docs.write.parquet(f"{home}/documents.parquet")
    return str(home)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:4])
def test_stages_keep_columns_of_clashing_names(spark, docs, folder, name, stage):
    plain = sorted(map(tuple, stage(spark, docs, folder).collect()), key=str)
    out = stage(spark, with_clashes(docs), folder)
    assert out.columns == [*docs.columns, *CLASH]
    rows = out.collect()
    assert sorted((tuple(x[c] for c in docs.columns) for x in rows), key=str) == plain
    assert all(x[c] == f"extra {c}" for x in rows for c in CLASH)
    empty = stage(spark, docs.limit(0), folder)
    assert empty.columns == docs.columns and empty.count() == 0


def test_source_mix_of_repeated_rows(spark, folder):
    rows = [(1, "same words here", "en", "a", 1)] * 60 + [(None, "no id at all", "en", "b", 1)] * 7 + [(i, "some other words " * (i % 4), "en", "abc"[i % 3], 1) for i in range(10, 40)]
    docs = spark.createDataFrame(rows + [(2, "c words", "en", "c", 1)] * 300, DOCS)
    want = {}
    for x in mixing.mix(mixing.sized(docs, ["doc_id", "source", "text"])).collect():
        key = x["doc_id"], x["source"], x["text"]
        want[key] = want.get(key, 0) + x["rounds"]
    assert 0 < want[2, "c", "c words"] % 300  # the budget's edge falls within the group
    got = Counter((x["doc_id"], x["source"], x["text"]) for x in corpus_pipeline.mix_sources(spark, docs, folder).collect())
    assert got == {k: n for k, n in want.items() if n}


def test_operators_ignore_columns_of_clashing_names(spark, docs):
    same = lambda a, b: sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.select(a.columns).collect()), key=str)
    odd = with_clashes(docs)
    assert same(simhash.near_duplicates(docs), simhash.near_duplicates(odd))
    assert same(substring.remove_repeats(docs.select("doc_id", "text")), substring.remove_repeats(odd.select("doc_id", "text")))
    assert same(mixing.mix(mixing.sized(docs, ["doc_id", "source"])), mixing.mix(mixing.sized(odd, ["doc_id", "source"])))
    pages = spark.createDataFrame([(None, None, None), (1, "http://a.com/x", "<p>one</p>"), (1, "http://a.com/x", "<p>one</p>"), (2, None, "<p>two"), (3, "http://a.com/y", None)], "page_id long, url string, html string")
    wide = with_clashes(pages, ["host", "path", "rule", "verdict", "tokens", "main", "constant", "text", "_fixed", "confidence", "_salt"])
    bad = spark.createDataFrame([("http://a.com/x", True), (None, None)], "url string, bad boolean")
    assert same(html_template.extract(pages), html_template.extract(wide)) and same(url_rules.judge(pages, bad), url_rules.judge(wide, bad))
    assert html_template.extract(pages.limit(0)).count() == 0
    vectors = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(40)] + [(None, [1.0, 2.0]), (50, None)], "vec_id long, embedding array<float>")
    assert same(topk.top_k(vectors, vectors, 3), topk.top_k(with_clashes(vectors, ["v", "shard", "is_query", "score", "rank"]), vectors, 3))
    turns = spark.createDataFrame([(1, 0, "a", "x"), (1, 1, None, None), (None, None, None, None)], "conv_id long, turn long, role string, text string")
    assert same(chat.rotate(turns), chat.rotate(with_clashes(turns, ["author", "speaker", "_block", "_conv", "segment", "name"])))


def test_toxicity_of_empty_tables(spark, docs, folder):
    model = toxicity.fit(docs.limit(0), spark.read.parquet(f"{folder}/labels.parquet"))
    assert toxicity.classify(docs.limit(0), model).count() == 0
    model = toxicity.fit(with_clashes(docs), spark.read.parquet(f"{folder}/labels2.parquet"))
    assert toxicity.classify(with_clashes(docs), model).count() == docs.count()


def test_media_of_nulls(spark, docs, folder):
    rows = QUERIES["op9_media_sequences"](spark, folder).collect()
    assert len(rows) == docs.count() and all(x["payload_bytes"] % 576 == 0 and x["payload_bytes"] > 0 for x in rows)
    assert media.interleaved(docs.select("doc_id", F.col("text").alias("html")).limit(0)).count() == 0


def test_toxicity_sample_is_bounded(spark, docs, folder):
    labels = spark.createDataFrame([(i, 1, t) for i in range(160) for t in (0, int(i % 4 == 0))] * 3, "doc_id long, quality int, toxic int")
    got = toxicity.sampled(docs.unionByName(docs), labels, rows=40).collect()
    assert len(got) == 40 == len({x["doc_id"] for x in got}) and all(x["toxic"] == int(x["doc_id"] % 4 == 0) for x in got)
    few = toxicity.sampled(docs, labels, rows=40, size=3000).collect()
    assert 0 < len(few) < 40 and sum(len(x["body"]) for x in few) <= 3000


def test_substring_keeps_clashing_columns(spark, docs):
    plain = {(x["doc_id"], x["kept"]) for x in substring.remove_repeats(docs).collect()}
    got = substring.remove_repeats(with_clashes(docs)).collect()
    assert {(x["doc_id"], x["kept"]) for x in got} == plain and all(x["_row"] == "extra _row" and x["body"] == "extra body" for x in got)
    assert all(isinstance(x["n_words"], int) for x in got)
