"""Suffix arrays and what is found with them against plain scans."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import suffix

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


@pytest.mark.parametrize("kinds,depth", [(1, 50), (2, 7), (3, 1), (30, 64), (1000, 10)])
def test_suffix_array(kinds, depth):
    r = np.random.default_rng(kinds)
    for n in (0, 1, 2, 50, 400):
        ids = r.integers(0, kinds, n)
        order = suffix.suffix_array(ids, depth)
        assert sorted(order.tolist()) == list(range(n))
        cut = [tuple(ids[p : p + depth].tolist()) for p in order.tolist()]
        assert cut == sorted(cut)


def test_wide_values_are_sorted_without_packing():
    high, low, places = np.array([1 << 40, 5, 1 << 40], np.uint64), np.array([1 << 30, 1, 2], np.uint64), np.arange(3)
    assert suffix._order(high, low, places).tolist() == [1, 2, 0]


def corpus(seed=0, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "the", "9"]
    say = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    items = [(i, say(r.choice([1, 3, 9, 10, 11, 30]))) for i in range(12)] + [(12, None), (13, "?! "), (None, say(12)), (3, say(14)), (21, "w1")]
    items += [(30, items[5][1])]
    docs = [(0, None), (1, ""), (2, "..."), (3, items[4][1].upper()), (None, items[4][1]), (4, "W1"), (5, "w11 w" + "x" * 200), (6, "w" + "x" * 200)]
    for i in range(n):
        inner = r.choice([t for _, t in items if t])
        cut = inner.split()[r.randrange(2) :]
        docs.append((10 + i, f"{say(r.randrange(40))}, {'-'.join(cut)}! {say(r.randrange(40))}"))
    return docs + docs[-3:] * 2, items


def plain(docs, items, width=10):
    windows = [(i, w[p : p + min(width, len(w))]) for i, w in ((i, words(t)) for i, t in items) if w for p in range(len(w) - min(width, len(w)) + 1)]
    out = []
    for doc, text in docs:
        w, hit, named = words(text), set(), set()
        for item, window in windows:
            k = len(window)
            at = [p for p in range(len(w) - k + 1) if w[p : p + k] == window]
            hit |= {p + j for p in at for j in range(k)}
            named |= {str(item)} if at and item is not None else set()
        out.append((doc, len(w), len(hit), len(named), ",".join(sorted(named)), bool(hit)))
    return sorted(out, key=repr)


def got(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "n_words", "n_hit", "n_items", F.array_join("items", ","), "contaminated").collect()), key=repr)


@pytest.mark.parametrize("shard,block", [(1 << 20, 1 << 20), (50, 1 << 20), (1, 40)])
def test_report_equals_a_scan(spark, monkeypatch, shard, block):
    monkeypatch.setattr(suffix, "SHARD_WORDS", shard)
    monkeypatch.setattr(suffix, "BLOCK_WORDS", block)
    docs, items = corpus()
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = suffix.report(d, i)
    assert got(found) == plain(docs, items)
    for r in found.collect():
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"]
    clean = sorted((r["doc_id"], r["text"]) for r in suffix.decontaminate(d, i).collect())
    assert clean == sorted((x[0], t) for x, t in ((p, dict(docs)[p[0]]) for p in plain(docs, items)) if not x[5])


def test_shards_are_cut_between_documents():
    r = random.Random(2)
    docs, items = corpus(7, 80)
    block = suffix.Items([(str(i), k, [w.encode() for w in words(t)]) for k, (i, t) in enumerate(items) if words(t)], 10)
    import pyarrow as pa

    bodies = [(t or "").encode() for _, t in docs]
    batches = []
    while bodies:
        n = r.randrange(1, 9)
        batches.append(pa.record_batch({"body": pa.array(bodies[:n], pa.binary())}))
        bodies = bodies[n:]
    whole = [(rows["body"].to_pylist(), sum(map(len, shard.docs))) for shard, rows in suffix._shards(iter(batches), block)]
    assert [b for bodies, _ in whole for b in bodies] == [(t or "").encode() for _, t in docs]
    suffix_words = suffix.SHARD_WORDS
    try:
        suffix.SHARD_WORDS = 100
        parts = [(rows["body"].to_pylist(), shard) for shard, rows in suffix._shards(iter(batches), block)]
    finally:
        suffix.SHARD_WORDS = suffix_words
    assert len(parts) > 10 and [b for bodies, _ in parts for b in bodies] == [(t or "").encode() for _, t in docs]
    assert sum(int(s.occurrences()[0].sum()) for _, s in parts) == sum(x[2] for x in plain(docs, items))


def test_longest_matches(spark):
    docs, items = corpus(5)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = []
    bodies = [(doc, words(t)) for doc, t in docs if doc is not None]
    for item, text in items:
        w = words(text)
        for o in range(len(w)):
            found = []
            for doc, b in bodies:
                for p in range(len(b)):
                    k = 0
                    while o + k < len(w) and p + k < len(b) and w[o + k] == b[p + k]:
                        k += 1
                    found.append((k, doc, p))
            top = max(x[0] for x in found)
            if top:
                best = [x[1:] for x in found if x[0] == top]
                want.append((item, o, top, len(best), *min(best)))
    assert sorted((tuple(r) for r in suffix.longest_matches(d, i).collect()), key=repr) == sorted(want, key=repr)


def test_empty_tables_and_clashing_columns(spark):
    docs, items = corpus()
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert suffix.report(d.limit(0), i).count() == 0
    assert suffix.report(d, i.limit(0)).where("contaminated or n_items > 0").count() == 0
    assert suffix.longest_matches(d, i.limit(0)).count() == 0
    names = ["body", "_row", "more", "starts", "c0", "_doc", "spans", "items", "a.b"]
    clashing = d.select("*", *[F.lit(f"x {c}").alias(c) for c in names])
    kept = [c for c in names if c not in ("spans", "items")]
    found = suffix.report(clashing, i.withColumn("_key", F.lit("x")))
    assert got(found) == plain(docs, items) and {r[c] for r in found.collect() for c in kept} == {f"x {c}" for c in kept}
    assert {r[c] for r in suffix.decontaminate(clashing, i).collect() for c in names} == {f"x {c}" for c in names}
