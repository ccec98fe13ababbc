"""The further operators on small fixtures with nulls, ties and empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from granary.operators import build, chunk, context, evaluation, normalise, payroll, recall
from granary.plans import cluster


def one(spark, c, *values):
    names = "abcdefgh"[: len(values)]
    return spark.range(1).select(*[F.lit(v).alias(n) for n, v in zip(names, values)]).select(c.alias("x")).first()["x"]


def test_normalisers(spark):
    page = "ＡＢＣ　１\r\n工\r\n 资 \r\n表\r\n\r\n\r\n\r\nx\t y\r\n- 3 -\r\n第 4 页\r\n单\r\n"
    assert one(spark, normalise.page_text(F.col("a")), page) == "ABC 1\n工资表\n\nx y\n单"
    assert one(spark, normalise.chunk_text(F.col("a")), " ＡＢ\t c\n\n\n\nd ") == "AB c\n\nd"
    assert one(spark, normalise.page_text(F.col("a")), None) == "" == one(spark, normalise.chunk_text(F.col("a")), "")
    assert [one(spark, normalise.is_informative(F.col("a")), t) for t in ("——", "a", "工资", None, " 1 2")] == [False, False, True, False, True]


def test_payroll(spark):
    assert tuple(one(spark, payroll.month_of_file(F.col("a")), "员工工资表_2026年3月.xlsx")) == (2026, 3)
    assert one(spark, payroll.department_of(F.col("a"), F.col("b")), "hr表", None) == "人力资源部"
    rows = [(1, 3, "张三", "实发工资 社保"), (2, 3, "李四", "实发工资"), (3, 4, "张三", "社保"), (4, 3, None, "合计"), (5, None, "", "备注"), (6, 3, "张三", "实发工资 社保")]
    asked = [(1, "张三3月的实发工资", None), (2, "我的社保", "李四"), (3, "3月工资总额", None), (4, "年假", "张三"), (5, None, None)]
    df = spark.createDataFrame(rows, "key long, month int, name string, text string")
    got = {}
    for r in payroll.structured(spark.createDataFrame(asked, "query_id long, query string, identity string"), df, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["key"], r["score"]))
    assert got == {1: [(1, 140), (6, 140), (2, 41)], 2: [(2, 100), (1, 11), (3, 11)], 3: [(4, 70), (1, 31), (2, 31)]}
    assert payroll.structured(spark.createDataFrame(asked, "query_id long, query string, identity string"), df.limit(0), 3).count() == 0


def test_build(spark):
    registry = spark.createDataFrame([("a", "1", "active", 2, "t", "t"), ("b", "1", "active", 1, "t", "t"), ("c", "1", "failed", 0, "t", "t")], "document_id string, version string, status string, chunk_count long, created_at string, updated_at string")
    chunks = spark.createDataFrame([("a", "1", "a1"), ("a", "1", "a2"), ("b", "1", "b1")], "document_id string, version string, chunk_id string")
    produced = spark.createDataFrame([("a", "2", "a3"), ("b", "2", "b2"), ("c", "2", "c1"), ("d", "1", "d1")], chunks.schema)
    failed = spark.createDataFrame([("b",), ("c",)], "document_id string")
    after = build.committed_registry(registry, produced, failed, "now")
    assert {r["document_id"]: tuple(r)[1:] for r in after.collect()} == {"a": ("2", "active", 1, "t", "now"), "b": ("1", "active", 1, "t", "t"), "c": ("2", "failed", 0, "t", "now"), "d": ("1", "active", 1, "now", "now")}
    kept = build.committed_chunks(chunks, produced, failed)
    assert {r["chunk_id"] for r in kept.collect()} == {"a3", "b1", "d1"} == {r["chunk_id"] for r in build.visible(kept, after).collect()}
    # whatever step a build has reached, a reader sees one version of a document
    assert {r["chunk_id"] for r in build.visible(chunks.unionByName(produced), registry).collect()} == {"a1", "a2", "b1"}


def test_claimed_recall(spark):
    ranked = spark.createDataFrame([(1, 1, "p", 1), (1, 2, "p", 2), (1, 3, "q", None)], "sample_id long, rank int, path string, page long")
    wanted = spark.createDataFrame([(1, 0, "p", None), (1, 1, "p", 1), (1, 2, "q", 5), (2, 0, "z", None)], "sample_id long, place int, path string, page long")
    # the first row claims the open expectation of any page, so none is left for page 1
    assert {r["sample_id"]: (r["hits"], r["expected"]) for r in evaluation.claimed(ranked, wanted).collect()} == {1: (1, 3), 2: (0, 1)}


FILES = evaluation.MonthlyFiles("pay/{}.xlsx", r"pay of (\d{1,2})", r"month (\d{1,2})", "wages", "payroll", {"Q1": (1, 2, 3)}, (5, 6)), {"f.pdf": ("profit", "revenue"), "pay/5.xlsx": ("may",)}


def test_inferred_sources(spark):
    texts = ["pay of 13, pay of 2, q1", "month 4", "wages of month 4", "payroll", "profit, payroll in may", "nothing", None]
    df = spark.createDataFrame([(t, ["revenue"] if t == "month 4" else None) for t in texts], "t string, h array<string>")
    got = [r["x"] for r in df.select(evaluation.inferred_sources(F.col("t"), F.col("h"), *FILES).alias("x")).collect()]
    assert got == [["pay/1.xlsx", "pay/2.xlsx", "pay/3.xlsx"], ["f.pdf"], ["pay/4.xlsx"], ["pay/5.xlsx", "pay/6.xlsx"], ["pay/5.xlsx", "pay/6.xlsx", "f.pdf"], [], []]


def test_samples_without_sources_raise(spark):
    rows = [("?", [], None, False)]
    df = spark.createDataFrame(rows, "question string, hints array<string>, expected_sources array<string>, expected_refusal boolean")
    with pytest.raises(Exception, match="without source"):
        evaluation.with_sources(df, *FILES).collect()
    assert evaluation.with_sources(df.withColumn("expected_refusal", F.lit(True)), *FILES).first()["expected_sources"] == []


def test_knn_of_ties_and_nulls(spark):
    vectors = spark.createDataFrame([(i, [float(i // 2), 0.0]) for i in range(60)] + [(99, None)], "vec_id long, embedding array<float>")
    asked = vectors.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    got = {}
    for r in recall.knn(asked, vectors, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["key"])
    for q, keys in got.items():
        assert keys == [j for _, j in sorted(((q // 2 - i // 2) ** 2, i) for i in range(60) if i != q)[:5]]
    assert len(got) == 6 and recall.knn(asked.limit(0), vectors, 5).count() == 0


def test_components_with_hubs(spark):
    r = random.Random(1)
    edges = [(0, i) for i in range(1, 3000)] + [(i, 100_000) for i in range(5000, 8000)] + [(r.randrange(10_000, 12_000), r.randrange(10_000, 12_000)) for _ in range(900)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {x["node"]: x["root"] for x in cluster.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: root(x) for x in up if any(x in e and e[0] != e[1] for e in edges if x in e)}


def test_joins_of_hot_keys(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 50}") for i in range(4000)] + [(9000, None)], "id long, key string")
    store = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 40)], "key string, value long")
    want = {(r["id"], r["value"]) for r in rows.join(store, "key", "left").collect()}
    assert {(r["id"], r["value"]) for r in cluster.join_references(rows, store, "key", ["id"]).collect()} == want
    monkeypatch.setattr(cluster, "BROADCAST_CHARS", 0)
    assert {(r["id"], r["value"]) for r in cluster.join_small(rows, store, ["key"], "left").collect()} == want


def test_budget_over_blocks(spark):
    places = {None: range(20), 1: [None, *range(30)], 2: range(-3, 40)}
    rows = [(q, n, "a" * ((n or 0) * (5 if q else 3) % 50)) for q, ns in places.items() for n in ns]
    wanted = {}
    for q in places:
        used = 0
        for _, n, text in sorted((r for r in rows if r[0] == q), key=lambda r: (r[1] is not None, r[1] or 0)):
            used += -(-len(text) // 4)
            wanted[q, n] = (used, used <= 100)
    got = context.budget(spark.createDataFrame(rows, "query_id long, rank int, text string"), 100, block=8).collect()
    assert {(r["query_id"], r["rank"]): (r["cum_tokens"], r["included"]) for r in got} == wanted and len(got) == len(rows)
    assert context.budget(spark.createDataFrame([], "query_id long, rank int, text string")).count() == 0


def plain_recursive(text, size, overlap, separators):
    """Chunks by lists of pieces, one piece at a time."""
    at = next((i for i, s in enumerate(separators) if s in text), None)
    if at is None or not text:
        return [text] * bool(text)
    sep, deeper, pieces, word = separators[at], separators[at + 1 :], [], ""
    i = 0
    while i < len(text):
        if word and text.startswith(sep, i):
            pieces.append(word)
            word = ""
        step = max(1, len(sep)) if text.startswith(sep, i) else 1
        word, i = word + text[i : i + step], i + step
    pieces.append(word)
    out, held = [], []
    for p in [*pieces, None]:
        if p is None or len(p) >= size:
            if held:
                out.append("".join(held))
            held = []
            if p is not None:
                out += plain_recursive(p, size, overlap, deeper) if deeper else [p]
            continue
        if held and len("".join(held)) + len(p) > size:
            out.append("".join(held))
            while held and (len("".join(held)) > overlap or len("".join(held)) + len(p) > size):
                held.pop(0)
        held.append(p)
    return out


def test_recursive_chunks(spark):
    r = random.Random(3)
    texts = ["".join(r.choice(["a", "bc", "。", ". ", "\n\n", "?", " ", "长句子", "x" * 30]) for _ in range(r.randint(0, 60))) for _ in range(120)]
    for size, overlap, separators in ((20, 5, chunk.SEPARATORS), (7, 0, chunk.SEPARATORS), (12, 12, chunk.SEPARATORS), (1, 1, chunk.SEPARATORS), (15, 4, ("\n\n", "。")), (9, 3, ())):
        for t in texts:
            assert [t[a:b] for a, b in chunk.recursive_spans(t, size, overlap, separators)] == plain_recursive(t, size, overlap, separators), (t, size, overlap)
    assert chunk.recursive_spans("ab cd ef gh", 6, 3) == [(0, 5), (2, 8), (5, 11)]  # each starts with the last piece again
    rows = [("f", 1, "one two. three"), ("f", 1, "one two. three"), ("g", 2, None), ("g", 3, ""), (None, None, " \n\n ")]
    got = chunk.recursive_chunks(spark.createDataFrame(rows, "file string, page long, text string").withColumn("ord", F.lit("x")), 8, 4).collect()
    assert sorted(map(tuple, got)) == sorted([("f", 1, 0, 0, "one two"), ("f", 1, 1, 7, ". three")] * 2)
    with pytest.raises(ValueError):
        chunk.recursive_chunks(spark.createDataFrame(rows, "file string, page long, text string"), 5, 6)


def test_sections_of_a_batch():
    import pandas as pd

    texts = ["pre\n# A\na\n\n=====\n\nb\n### C\n## D\nd\n# E", None, "", "1.2 x\n3. **q**\n1.1 y\n1.1.1 z", "=====\n \n"]
    got = chunk.section_rows(pd.Series(texts))
    assert got[["row", "title", "path"]].values.tolist() == [
        [0, "全文", ["全文"]], [0, "A", ["A"]], [0, "C", ["A", "C"]], [0, "D", ["A", "D"]], [0, "E", ["E"]], [1, "全文", ["全文"]], [2, "全文", ["全文"]],
        [3, "1.2 x", ["1.2 x"]], [3, "q", ["1.2 x", "q"]], [3, "1.1 y", ["1.1 y"]], [3, "1.1.1 z", ["1.1 y", "1.1.1 z"]], [4, "全文", ["全文"]],
    ]
    assert got["content"].tolist()[1:4] == ["# A\na\n\nb", "### C", "## D\nd"] and got["content"].iloc[-1] == "=====\n \n"


def test_budgets(spark):
    both, tokens = chunk.Budget(900, 300, 5, 5), chunk.Budget(section_tokens=40, fine_tokens=10)
    assert both.fine() == chunk.Limit(300) and both.section() == chunk.Limit(900)  # characters win
    assert tokens.fine().holds("a" * 40) and not tokens.fine().holds("a" * 41) and tokens.fine().holds("字" * 15) and not tokens.fine().holds("字" * 16)
    assert chunk.packed(["a" * 20, "b" * 19, "c" * 4], tokens.fine()) == ["a" * 20 + "\n" + "b" * 19, "c" * 4]
    assert [len(x) for x in chunk.fitting("字" * 450, tokens.fine())] == [200, 200, 50]  # 200 is the least width
    assert [len(x) for x in chunk.fitting("字" * 450, chunk.Limit(150, True))] == [300, 150]
    pages = spark.createDataFrame([("f", 1, "句子。" * 100)], "file string, page long, text string")
    fine = [r["text"] for r in chunk.chunks(pages, budget=tokens).where("level = 'fine'").collect()]
    assert "".join(fine).replace("\n", "") == "句子。" * 100 and all(tokens.fine().holds(t) for t in fine)
