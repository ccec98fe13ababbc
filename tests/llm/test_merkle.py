"""The manifest against a plain recursive one, with nulls, repeated rows, odd tree sizes and clashing columns."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from granary.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    shown = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)]
    return sha(*shown)


def plain_paths(nodes):
    """Root, and the sibling lists (left, right) of each node."""
    found, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, place in enumerate(at):
            run = nodes[place // 8 * 8 : place // 8 * 8 + 8]
            found[i].append(("".join(run[: place % 8]), "".join(run[place % 8 + 1 :])))
        nodes = [sha(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
        at = [p // 8 for p in at]
    return nodes[0], found


def plain(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    trees = {k: sorted(v, key=lambda x: x[:3]) for k, v in trees.items()}
    subs = {k: plain_paths([x[2] for x in trees[k]]) for k in langs}
    root, above = plain_paths([subs[k][0] for k in langs])
    out = []
    for k, up in zip(langs, above):
        for (_, _, digest, r), own in zip(trees[k], subs[k][1]):
            path = own + up
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            node = leaf(r, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1])) if hit and r[1] is not None else digest
            for a, z in path:
                node = sha(a, node, z)
            out.append((r[0], digest, subs[k][0], root, sha(*[a + z for a, z in path]), node, node == root))
    return sorted(out, key=repr)


def got(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def corpus(sizes, seed=1):
    r = random.Random(seed)
    rows = []
    for lang, n in sizes.items():
        for _ in range(n):
            text = r.choice([None, "", "lower only", "Some Words É", "ABC" * r.randrange(1, 400)])
            rows.append((r.choice([None, *range(300)]), text, lang, r.choice([None, "s", "é|-"]), r.choice([None, 1, 12])))
    return rows + rows[:9] * 2


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8}, {"en": 9, None: 1}, {"en": 65, "": 64, "é": 1, "z": 7}, {"en": 600, None: 20, **{f"l{i}": 1 + i for i in range(9)}}])
def test_manifest_equals_a_plain_tree(spark, sizes):
    rows = corpus(sizes) if len(sizes) > 1 else corpus(sizes)[: sum(sizes.values())]
    docs = spark.createDataFrame(rows, DOCS)
    assert got(merkle.verified(merkle.build(docs, merkle.lowered()))) == plain(rows)


def test_every_second_level_is_stored(spark, tmp_path):
    rows = corpus({"en": 700})
    manifest = merkle.build(spark.createDataFrame(rows, DOCS), folder=str(tmp_path / "m"))
    # 718 leaves: levels 0 and 2 are stored, 1 and 3 are recomputed; the root comes of level 2's block
    sizes = [sum(len(r["kids"]) for r in level.collect()) for level in manifest.documents.levels]
    assert sizes == [718, 12]
    assert manifest.root == manifest.documents.roots.first()["digest"]
    shown = merkle.verified(manifest)
    assert shown.where("verified").count() == 718  # nothing was tampered with
    manifest.delete(spark)
    assert not (tmp_path / "m").exists()


def test_proof_fails_for_another_leaf_only(spark):
    rows = [(i, f"Text {i}", "en", "s", 6) for i in range(100)]
    found = merkle.build(spark.createDataFrame(rows, DOCS)).proofs()
    right = found.select(merkle.refold(F.col("digest"), F.col("path")).alias("r"), "root").where("r = root").count()
    wrong = found.select(merkle.refold(F.sha2("digest", 256), F.col("path")).alias("r"), "root").where("r = root").count()
    assert (right, wrong) == (100, 0)


def test_empty_table_and_clashing_columns(spark):
    empty = merkle.build(spark.createDataFrame([], DOCS))
    assert empty.root is None and merkle.verified(empty).count() == 0
    rows = corpus({"en": 70, None: 3})
    docs = spark.createDataFrame(rows, DOCS)
    names = ["tree", "pos", "kids", "digest", "path", "more", "_row", "n", "levels", "a.b"]
    clashing = docs.select("*", *[F.concat(F.lit("x "), F.lit(c)).alias(c) for c in names])
    out = merkle.verified(merkle.build(clashing, merkle.lowered()))
    assert got(out) == plain(rows)
    assert {tuple(r[c] for c in names) for r in out.collect()} == {tuple(f"x {c}" for c in names)}
