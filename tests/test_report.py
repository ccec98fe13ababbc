"""The retrieval report on a few samples."""

from granary.operators.report import retrieval_report

SAMPLES, RANKED, EXPECTED = "sample_id long, question string, expected_refusal boolean", "sample_id long, rank int, path string, page long", "sample_id long, path string, page long"


def report(spark, samples, ranked, expected, ks=(1, 3)):
    frames = [spark.createDataFrame(rows, schema) for rows, schema in ((samples, SAMPLES), (ranked, RANKED), (expected, EXPECTED))]
    return {(r.stratum, r.k): tuple(r)[2:] for r in retrieval_report(*frames, ks).collect()}


def test_strata(spark):
    samples = [(1, "a", False), (2, "b", None), (3, "c", True), (4, "", False), (5, None, False), (6, "d", True), (7, "e", False)]
    ranked = [(1, 1, "x", 5), (1, 2, "x", 7), (2, 3, "y", None), (3, 1, "x", 1), (6, 2, "z", 9), (6, 3, "z", 9), (1, 3, "x", 7)]
    expected = [(1, "x", 7), (1, "x", 7), (2, "y", None), (6, "z", None), (6, "z", 4)]
    got = report(spark, samples, ranked, expected)
    third = lambda x: round(x / 3, 6)
    assert got[("page", 1)] == (2, 0.0, 0.0, 0.5, 0.5) and got[("page", 3)] == (2, 1.0, 0.5, 1.0, 0.0)
    assert got[("file", 1)] == (2, 0.0, 0.0, 0.0, 0.0) and got[("file", 3)] == (2, 0.5, round(1 / 6, 6), 0.5, 0.0)  # sample 7 expects nothing
    assert got[("skipped", 1)] == got[("skipped", 3)] == (3, None, None, None, None)
    assert got[("all", 1)] == (4, 0.0, 0.0, 0.25, 0.25) and got[("all", 3)] == (4, 0.75, round((0.5 + 0.5 + third(1)) / 4, 6), 0.75, 0.0)


def test_no_samples(spark):
    assert report(spark, [], [], []) == {}
