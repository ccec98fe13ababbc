"""What a review found on odd inputs and larger tables."""

import random
import unicodedata

import duckdb
import pytest
from pyspark.util import PythonEvalType

from granary import catalogue
from granary.operators import clean, normalise, payroll
from granary.sources.store import ChunkStore


def test_expand_parent_equals_its_sql(spark, tmp_path):
    parent = "The section has the middle part of a turn in it, and also the closing words of another turn."
    texts = [parent, "An edited heading first, has the middle part of a turn in it, then another ending", "Another heading that differs: the closing words of another turn.", "", "a turn after an empty one", " has the middle part of a turn", None, "text", "  "]
    data = str(tmp_path)
    spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(texts)] + [(2, 0, "user", parent), (2, 1, "user", " has the middle part of a turn, and more")], "conv_id long, turn long, role string, text string").write.parquet(f"{data}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS FROM '{data}/conversations.parquet/*.parquet'")
    want = con.sql(catalogue.ORACLES["expand_parent"]).fetchall()
    assert sorted(map(tuple, catalogue.QUERIES["expand_parent"](spark, data).collect()), key=repr) == sorted(want, key=repr)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_simhash_shuffles_nothing(spark):
    texts = [(1, "Alpha beta gamma"), (2, "中文 字"), (3, ""), (4, None), (5, " x "), (6, "ab ÀÉ straße"), (7, "same same same")]
    prints = clean.simhash64(spark.createDataFrame(texts, "doc_id long, text string"), "doc_id")
    assert "Exchange" not in plan(prints) and "Sort" not in plan(prints)
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", texts)
    assert sorted(map(tuple, prints.collect())) == sorted(con.sql(catalogue.ORACLES["simhash64"]).fetchall())


def test_classes_fingerprint_texts_once(spark):
    texts = spark.createDataFrame([(i, "text " + "alpha beta gamma".split()[i % 3]) for i in range(9)], "doc_id long, text string")
    classes = clean.fingerprint_classes(clean.simhash64(texts, "doc_id"), "doc_id")
    assert "ArrowEval" not in plan(classes) and "regexp" not in plan(classes)  # the fingerprints lie in a cut table
    assert {r["doc_id"]: r["class"] for r in classes.collect()} == {i: i % 3 for i in range(9)}


def test_near_pairs_are_found_once(spark):
    rows = [(i, fp) for i, fp in enumerate([0, 1, 3, 7, 15, -1, -2, 1 << 62, (1 << 62) | 5, 1 << 20 | 1 << 40, 0])]
    pairs = clean.near_pairs(spark.createDataFrame(rows, "doc_id long, fp long"), "doc_id", 3)
    want = {(a, b, ((x ^ y) & (2**64 - 1)).bit_count()) for a, x in rows for b, y in rows if a < b and x != y and b < 10 and ((x ^ y) & (2**64 - 1)).bit_count() <= 3}
    got = [tuple(r) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert plan(pairs).count("HashAggregate") == 0  # pairs come once, so they are not shuffled to be made distinct


def test_greedy_rounds_do_not_grow_with_a_shared_block(spark, monkeypatch):
    # all share blocks, none are near: each used to take a round of its own
    fps = [n << 33 | (n * 0x9E3779B1 & 0x3FFFFFFF) << 34 & (1 << 62) - 1 for n in range(40)]
    far = [fp for i, fp in enumerate(fps) if all(((fp ^ x) & (2**64 - 1)).bit_count() > 3 for x in fps[:i])]
    rows = spark.createDataFrame([("f", "fine", i, 100 - i, fp) for i, fp in enumerate(far)], "file string, level string, ord long, chars int, fp long")
    cuts, cut = [], clean.cut
    monkeypatch.setattr(clean, "cut", lambda df: cuts.append(1) or cut(df))
    assert len(far) > 20 and all(r["kept"] for r in clean.greedy_near_duplicates(rows, 3).collect())
    assert len(cuts) < 6


@pytest.mark.parametrize("pairs_each", [0, 1])
def test_greedy_is_the_same_with_thinning_rounds(spark, pairs_each):
    r = random.Random(5)
    fps = [c ^ 1 << r.randrange(60) ^ 1 << r.randrange(60) for c in (r.getrandbits(60) for _ in range(5)) for _ in range(20)]
    rows = spark.createDataFrame([("f", "fine", i, r.randrange(5), fp) for i, fp in enumerate(fps)], "file string, level string, ord long, chars int, fp long")
    kept = lambda **how: {x["ord"]: x["kept"] for x in clean.greedy_near_duplicates(rows, 3, **how).collect()}
    assert kept(pairs_each=pairs_each) == kept(pairs_each=10**9)


def test_questions_about_pay_are_dealt_to_many_tasks(spark):
    rows = spark.createDataFrame([(i, i % 3 + 1, f"n{i % 4}" if i % 5 else None, ("合计 实发工资", "社保", "备注")[i % 3]) for i in range(60)], "key long, month int, name string, text string")
    asked = [("所有人2月工资总额", "n1"), ("我的社保", "n2"), ("n3 社保和公积金", "n9"), ("本部门个税合计", None), ("我3月的实发工资", "n0"), ("年假", "n1")]
    found = payroll.structured(spark.createDataFrame([(i, *asked[i % 6]) for i in range(12)], "query_id long, query string, identity string"), rows, 3)
    assert "REPARTITION_BY_NUM" in plan(found)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["key"], r["score"]))
    assert set(got) == {0, 1, 2, 3, 4, 6, 7, 8, 9, 10} and all(got[i] == got[i + 6] for i in range(5))
    for i, (q, me) in enumerate(asked[:5]):
        month = next((int(m) for m in "23" if f"{m}月" in q), None)
        scores = []
        for r in rows.collect():
            if month not in (None, r["month"]):
                continue
            fields = sum(f in q and f in r["text"] for f in payroll.FIELDS)
            own = r["name"] and (r["name"] in q or (r["name"] == me and "我" in q))
            total = any(w in q for w in payroll.TOTAL_WORDS) and ("合计" in r["text"] or "总额" in q)
            score = 20 * (month is not None) + 10 * fields + (100 if own else 1 if r["name"] else 50 if total else 0)
            scores += [(-score, r["key"])] if score else []
        assert got[i] == [(key, -s) for s, key in sorted(scores)[:3]]


def test_nfkc_holds_few_texts_at_a_time(spark):
    assert normalise._nfkc.evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF  # a pandas batch holds all its texts as strings
    texts = [(i, None if i % 50 == 0 else f"ＡＢ{i} é") for i in range(300)]
    got = {r[0]: r[1] for r in spark.createDataFrame(texts, "i int, t string").coalesce(1).select("i", normalise._nfkc("t")).collect()}
    assert got == {i: t and unicodedata.normalize("NFKC", t) for i, t in texts}


def test_a_build_does_not_shuffle_texts_to_leave_failed_documents_out(spark, tmp_path, monkeypatch):
    made = []
    monkeypatch.setattr(ChunkStore, "_commit", lambda self, number, state, name, good, rows: made.append(good))
    chunks = spark.createDataFrame([("a", "x"), ("b", "y")], "document_id string, text string")
    failed = spark.createDataFrame([("b", "p", "h", "e")], "document_id string, source_path string, content_hash string, error string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where the planner has no size of the failed ones
    try:
        ChunkStore(spark, str(tmp_path)).build(chunks, failed)
        assert "Exchange hashpartitioning" not in plan(made[0]) and [r["document_id"] for r in made[0].collect()] == ["a"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
