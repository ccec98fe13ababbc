"""Operators on literal fixtures, with the CJK and table cases that the driver's tables lack."""

import random

import pytest
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import access, answer, chunk, clean, context, fusion, metrics, recall, registry
from granary.plans.cluster import connected_components, rank_in_group
from granary.sources import files
from granary.streaming import events


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "c string").select(expression(F.col("c"))).first()[0]


def test_text_functions(spark):
    assert one(spark, "abcd中文中", T.token_estimate) == 3
    assert one(spark, "中文 ab x", T.informative_size) == 3
    assert one(spark, None, T.token_estimate) == 0
    assert one(spark, "abc", T.garbage_ratio) == 0.25
    assert one(spark, "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |", T.table_data_rows) == 2
    assert one(spark, "| 1 | 2 |", T.table_data_rows) == 1
    assert one(spark, "7月工资", T.month_of) == 7 and one(spark, "13月", T.month_of) is None
    assert set(one(spark, "实发工资", T.search_terms)) == {"实发工资", "实发", "发工", "工资"}
    # a field inside a longer run is a term of its own
    assert {"公积金", "岗位津贴", "岗位", "3月"} <= set(one(spark, "三月的公积金和岗位津贴3月", T.search_terms)) and "社保" not in one(spark, "三月的公积金", T.search_terms)
    assert one(spark, "a\n----------\n详见附件1\nb", T.without_noise_lines) == "a\nb"
    assert one(spark, "1.1 x ..... 3\n1.2 y ..... 4\n1 z ..... 5\n2 u ..... 6\n3 v ..... 7", T.is_toc_page)


def test_repeated_lines_and_reasons(spark):
    pages = spark.createDataFrame([("f", i, f"head line\nbody words number {i} here and there and more to say now") for i in range(4)] + [("f", 4, "head line\nxy")], "file string, page long, text string")
    assert [r["line"] for r in clean.repeat_rows(pages).collect()] == ["head line"]
    rows = {r["page"]: r for r in clean.clean_pages(pages).collect()}
    assert rows[0]["reason"] is None and rows[0]["removed"] == 1 and "head" not in rows[0]["text_clean"]
    assert rows[4]["reason"] == "sparse"


def test_greedy_and_exact_duplicates(spark):
    rows = spark.createDataFrame([("f", "fine", 0, 5, 0b1111), ("f", "fine", 1, 9, 0b1110), ("f", "section", 2, 5, 0b1111)], "file string, level string, ord long, chars int, fp long")
    kept = {r["ord"]: r["kept"] for r in clean.greedy_near_duplicates(rows).collect()}
    assert kept == {0: False, 1: True, 2: True}
    twice = spark.createDataFrame([("fine", 0, "x"), ("fine", 1, "x"), ("section", 2, "x")], "level string, ord long, text string")
    assert sorted((r["level"], r["ord"], r["copies"]) for r in clean.exact_duplicates(twice, ["level"], "ord").collect()) == [("fine", 0, 1), ("section", 2, 0)]


@pytest.mark.parametrize("most", [0, 1, 3])
def test_greedy_equals_the_fold(spark, most):
    r = random.Random(most)
    rows, ord_ = [], 0
    for centre in (r.getrandbits(64) for _ in range(12)):
        for _ in range(25):  # chains and balls of near fingerprints, and copies
            fp = centre
            for _ in range(r.randrange(5)):
                fp ^= 1 << r.randrange(64)
            rows.append((r.choice(["f", None]), r.choice(["fine", "section"]), ord_, r.randrange(1, 9), fp - (1 << 64) if fp >> 63 else fp))
            ord_ += 1
    rows += [("f", "fine", 999, 3, None)]
    want = {999: True}
    for group in {x[:2] for x in rows}:
        seen = []
        for x in sorted((x for x in rows if x[:2] == group and x[4] is not None), key=lambda x: (-x[3], x[2])):
            want[x[2]] = not any(((x[4] ^ k) & (2**64 - 1)).bit_count() <= most for k in seen)
            seen += [x[4]] if want[x[2]] else []
    df = spark.createDataFrame(rows, "file string, level string, ord long, chars int, fp long")
    assert {x["ord"]: x["kept"] for x in clean.greedy_near_duplicates(df, most).collect()} == want
    assert clean.greedy_near_duplicates(df.limit(0), most).count() == 0


def test_simhash_matches_plain_python(spark):
    import hashlib

    text = "中文字 alpha Beta gamma"
    tokens = ["中文", "文字", "中", "文", "字", "alpha", "beta", "gamma", "alpha beta", "beta gamma"]
    votes = [0] * 64
    for t in tokens:
        h = int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "big")
        for b in range(64):
            votes[b] += 1 if h >> b & 1 else -1
    want = sum(1 << b for b in range(64) if votes[b] > 0)
    got = clean.simhash64(spark.createDataFrame([(1, text), (2, "")], "id long, text string"), "id")
    found = {r["id"]: r["fp"] for r in got.collect()}
    assert found[1] & (2**64 - 1) == want and found[2] == 0


def test_chunks():
    text = "# A\nfirst line\n## B\n| h | i |\n|---|---|\n" + "\n".join(f"| {i} | {'x' * 40} |" for i in range(20))
    found = chunk.sections(text)
    assert [t for t, _, _ in found] == ["A", "B"] and found[1][1] == ["A", "B"]
    parts = chunk.packed(chunk.blocks(found[1][2]), 200)
    assert all(len(p) <= 200 for p in parts) and sum("| h | i |" in p for p in parts) == len([p for p in parts if "|" in p])
    assert chunk.fitting("y" * 450, 100) == ["y" * 200, "y" * 200, "y" * 50]
    assert chunk.sections("") == [("全文", ["全文"], "")]
    assert chunk.best_part("abc", ["zzz", "xabcx"]) == 1


def test_fusion_and_guard(spark):
    v = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id long, key string, rank int")
    b = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "query_id long, key string, rank int")
    assert [r["key"] for r in fusion.rrf(v, b).orderBy("rank").collect()] == ["b", "a", "c"]
    c = spark.createDataFrame([(1, "a", 0.1, 0.9), (1, "b", 0.2, 0.1), (2, "a", 0.3, 0.1), (3, "z", 0.3, None)], "query_id long, key string, fusion_score double, rerank_score double")
    got = sorted((r["query_id"], r["key"], r["fallback"]) for r in fusion.score_guard(c).collect())
    assert got == [(1, "a", False), (2, "a", True), (3, "z", False)]


def test_access(spark):
    cols = "doc_type string, sensitivity_level string, owner_id string, owner_name string, doc_department string, path string, user_id string, user_name string, department string, roles array<string>, data_scope string"
    rows = [
        ("salary", None, "7", "", "全体", "", "7", "", "IT", ["employee"], "self"),
        ("salary", None, "8", "", "", "", "7", "", "IT", ["manager"], "self"),
        ("salary", None, "8", "", "IT", "", "7", "", "IT", ["hr_admin"], "self"),
        ("policy", "restricted", "", "", "", "", "7", "", "IT", ["manager"], "company"),
        ("policy", None, "", "", "HR", "", "7", "", "IT", [], "department"),
        (None, None, "", "", "", "x/a.xlsx", "7", "", "IT", None, None),
    ]
    assert [r["reason"] for r in access.decide(spark.createDataFrame(rows, cols)).collect()] == ["ok", "owner", "ok", "sensitivity", "department", "owner"]


def test_context(spark):
    docs = spark.createDataFrame([(1, 1, "a" * 40), (1, 2, "b" * 40), (1, 3, "c")], "query_id long, rank int, text string")
    assert [r["included"] for r in context.budget(docs, 19).orderBy("rank").collect()] == [True, False, False]
    assert context.compress(spark.createDataFrame([("aaaa\nbbbb\n" + "c" * 40,)], "text string"), 5).first()["text"] == "aaaa\nbbbb"
    hits = spark.createDataFrame([(1, 1, "f1", "s1", "words of the chunk", "policy"), (1, 2, "f2", "s1", "other words there", "policy"), (1, 3, "f3", "s1", "words of the chunk", "salary")], "query_id long, rank int, chunk string, parent string, text string, doc_type string")
    sections = spark.createDataFrame([("s1", "before words of the chunk after, other words there")], "chunk string, text string")
    assert sorted((r["rank"], r["evidence"]) for r in context.expand_parents(hits, sections).collect()) == [(1, "s1"), (3, "f3")]


def test_parents_by_start_middle_and_end(spark):
    parent = "The parent has the middle part of a chunk in it, and also the closing words of another one."
    texts = ["An edited heading first, has the middle part of a chunk in it, then another ending", "Copied heading that differs: the closing words of another one.", "edit words", "no word in common with that section at all", "parent XX", " \n", None]
    hits = spark.createDataFrame([(i, 1, f"f{i}", "s", t, "policy") for i, t in enumerate(texts)], "query_id long, rank int, chunk string, parent string, text string, doc_type string")
    got = {r["query_id"]: r["expanded"] for r in context.expand_parents(hits, spark.createDataFrame([("s", parent)], "chunk string, text string")).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: False, 5: True, 6: True}


def test_answers(spark):
    got = spark.createDataFrame([("短", "policy"), ("答案是资料不足的", "general"), ("一个足够长的答案", "finance")], "a string, k string").select(answer.post_process(F.col("a"), F.col("k"))).collect()
    assert got[0][0] == answer.INSUFFICIENT and got[1][0] == answer.INSUFFICIENT and got[2][0].endswith(answer.FINANCE_NOTE)
    q = spark.createDataFrame([(1, "工资"), (2, "查年假")], "query_id long, query string")
    s = spark.createDataFrame([("工资", 0, "薪资"), ("工资", 1, "工资条"), ("年假", 0, "带薪年假")], "word string, place int, synonym string")
    assert sorted((r["query_id"], r["rewrite"]) for r in answer.rewrites(q, s).collect()) == [(1, "工资条"), (1, "薪资"), (2, "查带薪年假")]
    assert spark.createDataFrame([("见【2】和【12】",)], "a string").select(answer.cited(F.col("a"))).first()[0] == [2, 12]


def test_registry_status(spark):
    rows = spark.createDataFrame([("p1", "active"), ("p2", "active")], "source_path string, status string")
    gone = spark.createDataFrame([("p2",)], "path string")
    assert sorted((r[0], r[1]) for r in registry.set_status(rows, gone, "deleted").collect()) == [("p1", "active"), ("p2", "deleted")]


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, 1, "x"), (1, 2, "a"), (1, 3, "b"), (2, 1, "y")], "sample_id long, rank int, target string")
    wanted = spark.createDataFrame([(1, "a"), (1, "b"), (2, "z")], "sample_id long, target string")
    got = {(r["sample_id"], r["k"]): (r["hit"], r["mrr"], r["recall"]) for r in metrics.ranking_metrics(ranked, wanted, (1, 2, 3)).collect()}
    assert got[1, 1] == (0.0, 0.0, 0.0) and got[1, 2] == (1.0, 0.5, 0.5) and got[1, 3] == (1.0, 0.5, 1.0) and got[2, 3] == (0.0, 0.0, 0.0)


def test_components_and_ranks(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 9), (3, 1)] + [(i, i + 1) for i in range(100, 140)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert got[3] == 1 and got[5] == 4 and got[140] == 100 and 9 not in got
    assert connected_components(edges.limit(0)).count() == 0
    rows = spark.createDataFrame([(None if i % 3 else "k", i) for i in range(200)], "k string, v long")
    ranked = rank_in_group(rows, ["k"], ["v"], "r").collect()
    for key in (None, "k"):
        own = sorted(r["r"] for r in ranked if r["k"] == key)
        assert own == list(range(len(own)))


def test_files(spark, tmp_path):
    import io
    import zipfile

    (tmp_path / "a.txt").write_text("plain")
    (tmp_path / "b.MD").write_bytes(b"\xef\xbb\xbfx\r\n\r\n\r\n```\n\n\n```\n")
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>para</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>c2</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
    (tmp_path / "c.docx").write_bytes(buffer.getvalue())
    (tmp_path / "d.docx").write_bytes(b"broken")
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.load(spark, str(tmp_path)).collect()}
    assert got["a.txt"]["text"] == "plain" and got["b.MD"]["text"] == "x\n\n```\n\n\n```\n" and got["c.docx"]["text"] == "para\nc1 | c2"
    assert got["d.docx"]["error"]


def test_cache_ttl(spark):
    rows = spark.createDataFrame([(1, t) for t in (0, 5, 9, 12, 30)], "k long, s long").select("k", F.timestamp_seconds("s").alias("ts"))
    assert events.cache_hits(rows, "k", 10.0).first()["hits"] == 2
    assert events.audit_counts(rows.select(F.lit("x").alias("event_type"), F.lit(1.0).alias("value"), "ts")).first()["n"] == 5


def test_cache_stream(spark, tmp_path):
    spark.createDataFrame([(1, t) for t in (0, 5, 9, 12, 30)], "k long, s long").select("k", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, ts timestamp").parquet(str(tmp_path / "in"))
    q = events.cache_stream(stream, "k", 10.0).writeStream.outputMode("update").format("memory").queryName("cache_rows").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("cache_rows").collect()] == [(1, 5, 2)]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "query_id long, query string")
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert recall.bm25(empty, docs, "doc_id").count() == 0
    assert chunk.chunks(spark.createDataFrame([], "file string, page long, text string")).count() == 0
