"""Builds that commit: order of steps, crashes, failed files, conflicts, narrow scans."""

import pytest

from granary.sources.snapshots import Conflict
from granary.sources.store import FOLD_AFTER, ChunkStore

CHUNK = "document_id string, source_path string, content_hash string, chunk_id string, chunk_level string, doc_type string, page int, text string"
FAILED = "document_id string, source_path string, content_hash string, error string"


def chunks(spark, version, *documents, n=3):
    rows = [(d, f"/{d}", version, f"{d}_{version}_{i}", "section" if i == 0 else "fine", "policy" if d != "pay" else "salary", i, f"{d} {version} {i}") for d in documents for i in range(n)]
    return spark.createDataFrame(rows, CHUNK)


def failed(spark, *documents):
    return spark.createDataFrame([(d, f"/{d}", "h", "boom") for d in documents], FAILED)


def seen(store):
    out = {}
    for r in store.chunks().collect():
        out.setdefault(r["document_id"], set()).add(r["content_hash"])
    return out


def status(store):
    return {r["document_id"]: (r["status"], r["chunk_count"]) for r in store.registry().collect()}


class Stopped(ChunkStore):
    """A store whose builds stop after a step."""

    at, steps = None, ()

    def _after(self, step):
        self.steps = (*self.steps, step)
        if step == self.at:
            raise RuntimeError(f"stopped after {step}")


def test_a_crash_leaves_old_or_new(spark, tmp_path):
    store = Stopped(spark, str(tmp_path / "s"))
    store.build(chunks(spark, "old", "a", "b"), now="t1")
    assert store.steps == ("chunks", "registry", "manifest")
    for step in ("chunks", "registry"):
        store.at = step
        with pytest.raises(RuntimeError, match=step):
            store.build(chunks(spark, "new", "a", n=2), now="t2")
        assert seen(ChunkStore(spark, store.store.folder)) == {"a": {"old"}, "b": {"old"}}
        assert status(store) == {"a": ("active", 3), "b": ("active", 3)}
        assert len(store.store.folders("chunks")) == 1  # the stopped build's files are gone
    store.at = "manifest"  # what fails after the manifest is no failure of the build
    store.build(chunks(spark, "new", "a", n=2), now="t3")
    assert seen(store) == {"a": {"new"}, "b": {"old"}} and status(store) == {"a": ("active", 2), "b": ("active", 3)}
    store.at = None
    store.build(chunks(spark, "newer", "a", "b"), now="t4")
    assert seen(store) == {"a": {"newer"}, "b": {"newer"}}
    store.build(chunks(spark, "last", "a", "b"), now="t5")
    # the first build and the second are in none of the last two manifests
    assert [f.split("=")[1].split("-")[0] for f in store.store.folders("chunks")] == ["3", "4"]
    assert {r["created_at"] for r in store.registry().collect()} == {"t1"}


def test_failed_files_are_rows(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"))
    store.build(chunks(spark, "1", "a", "b", "pay"), failed(spark, "b", "c"))
    assert status(store) == {"a": ("active", 3), "pay": ("active", 3), "b": ("failed", 0), "c": ("failed", 0)}
    changed = store.build(chunks(spark, "2", "a", "b"), failed(spark, "a"))
    assert [r["document_id"] for r in changed.collect()] == ["b"]
    assert seen(store) == {"a": {"1"}, "pay": {"1"}, "b": {"2"}} and store.registry("failed").count() == 1
    store.set_status(spark.createDataFrame([("a",), ("none",)], "document_id string"), "deleted")
    assert seen(store) == {"pay": {"1"}, "b": {"2"}} and store.find("a").collect() == []
    store.build(chunks(spark, "3", "a"), now="t")
    assert seen(store)["a"] == {"3"} and store.find(source_path="/a").first()["created_at"] == "t"


def test_conflict(spark, tmp_path):
    one, other = Stopped(spark, str(tmp_path / "s")), ChunkStore(spark, str(tmp_path / "s"))
    one._after = lambda step: other.build(chunks(spark, "2", "a")) if step == "registry" else None
    with pytest.raises(Conflict):
        one.build(chunks(spark, "1", "a"))
    assert seen(one) == {"a": {"2"}} and len(one.store.folders("chunks")) == 1


def test_scans_read_folders_they_need(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"))
    store.build(chunks(spark, "1", "a", "b", "pay"))
    assert {r["chunk_id"] for r in store.chunks(level="fine", doc_type="salary").collect()} == {"pay_1_1", "pay_1_2"}
    assert {r["page"] for r in store.chunks(source_path="/a", level="fine", pages=[0, 2]).collect()} == {2}
    assert store.chunks(chunk_ids=["a_1_0", "b_1_1", "x"]).count() == 2 and store.chunks(document_id="b").count() == 3
    plan = store.chunks(level="fine", doc_type="salary", document_id="pay")._jdf.queryExecution().toString()
    assert all(f"{c}#" in plan[plan.index("PartitionFilters") :].split("PushedFilters")[0] for c in ("chunk_level", "doc_type", "bucket"))
    files = store.chunks(level="section", doc_type="salary").inputFiles()
    assert files and any("chunk_level=section/doc_type=salary" in f for f in files)


def test_edges(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"))
    assert store.chunks().count() == 0 == store.registry().count() and store.find("a").count() == 0
    store.build(chunks(spark, "1"))  # a build of nothing
    assert store.chunks().count() == 0
    odd = spark.createDataFrame([("a", None, None, None, None, None, None, None, "x")], CHUNK + ", number string")
    store.build(odd)
    assert [r["number"] for r in store.chunks().collect()] == ["x"] and status(store) == {"a": ("active", 1)}
    with pytest.raises(ValueError):
        store.build(odd.withColumnRenamed("number", "bucket"))
    with pytest.raises(Exception, match="without document_id"):
        store.build(spark.createDataFrame([(None, "/x", "h", "c", "fine", "t", 1, "x")], CHUNK))
    for i in range(FOLD_AFTER + 1):
        store.set_status(spark.createDataFrame([("a",)], "document_id string"), "active", f"t{i}")
    assert len(store.store.read()[1]["registry"]) < FOLD_AFTER and status(store) == {"a": ("active", 1)}
    store.compact()
    assert store.chunks().count() == 1 and len(store.store.read()[1]["chunks"]) == 1
