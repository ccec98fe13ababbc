"""JSON of models' answers and re-rankers' responses."""

import json

from pyspark.sql import functions as F

from granary.functions.model_json import is_json, model_json, rerank_scores

CASES = {
    None: "", "": "", "  \n": "", "no json": "no json", ' {"a": 1} ': '{"a": 1}',
    '```json\n{"a": 1}\n```': '{"a": 1}', 'before\n```\n[1, 2]\n``` \nafter': "[1, 2]",
    json.dumps('{"a": "x\\n"}'): '{"a": "x\\n"}', json.dumps(json.dumps(json.dumps("[1]"))): "[1]",
    json.dumps(json.dumps(json.dumps(json.dumps("[1]")))): "[1]",  # one string is left, its brackets are found
    'so: {"a": {"b": 1}} there': '{"a": {"b": 1}}', "so: [1, {}] there": "[1, {}]", 'two {"a": 1} and {"b": 2}': 'two {"a": 1} and {"b": 2}',
    "open { only": "open { only", "} {": "} {", "{“a”: 1}": '{"a": 1}', "so “a”": "so “a”", "x {'a': 1}": "x {'a': 1}",
    '"a" "b"': '"a" "b"', "'a'": "'a'", '"open': '"open', '"': '"', '"bad \\x"': '"bad \\x"', "so [1] {2} ]": "so [1] {2} ]",
}


def test_model_json(spark):
    rows = [(i, a) for i, a in enumerate(CASES)]
    got = {r.i: r.j for r in spark.createDataFrame(rows, "i long, a string").select("i", model_json(F.col("a")).alias("j")).collect()}
    assert [(a, got[i]) for i, a in rows] == list(CASES.items())


def test_very_long_answers(spark):
    long = json.dumps({"a": "x\"\\ \n" * 300_000})
    df = spark.createDataFrame([(json.dumps(long),), ("well: " + long,)], "a string")
    assert {r.j for r in df.select(model_json(F.col("a")).alias("j")).collect()} == {long}


def test_is_json(spark):
    good = ["1", '"a"', "{}", "[]", '{"a": [1, null]}', '{"a": 1, "a": 2}', " 1 "]
    bad = ["", "1 2", "1, 2", "{} {}", "{}] [{}", "{'a': 1}", "{", "01", "[1,]", "text"]
    got = {r.a: r.ok for r in spark.createDataFrame([(x,) for x in good + bad], "a string").select("a", is_json(F.col("a")).alias("ok")).collect()}
    assert got == {x: True for x in good} | {x: False for x in bad}


def test_rerank_scores(spark):
    cases = [
        ('{"output": {"results": [{"index": 1, "relevance_score": 0.5}, {"index": 0, "relevance_score": 0.25}]}}', [(1, 0.5), (0, 0.25)]),
        ('{"results": [{"index": "2", "score": "0.75"}, {"index": 2.9, "score": 1}, {"score": 1}, {"index": 9, "score": 1}, {"index": -1, "score": 1}, 5]}', [(2, 0.75), (2, 1.0)]),
        ('{"data": [{"index": 0, "relevance_score": 0.0, "relevance": 0.125}, {"index": 1, "score": null}, {"index": 2, "score": "x", "relevance": 3}, {"index": "1.5", "score": 1}, {"index": true, "score": true}]}', [(0, 0.125), (1, 0.0), (2, 0.0), (1, 1.0)]),
        ('{"output": {"results": 5}, "data": []}', []), ('{"output": 1}', None), ("[]", None), ("{", None), (None, None),
    ]
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(cases)], "i long, r string").select("i", rerank_scores(F.col("r"), F.lit(3)).alias("s"))
    got = {r.i: None if r.s is None else [tuple(x) for x in r.s] for r in df.collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}
