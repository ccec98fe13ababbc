"""Merkle manifest of a dataset: stored every few levels, proofs by recomputation.

Every row is a leaf; the leaves of a tree (one for each language) ascend by id, and every ``ARITY``
consecutive nodes are hashed into one until one is left. A tree over the roots of the trees gives
the root of the whole.

*Checkpoint*: of the levels only every ``STEP``-th is written, as one row for each aligned block of
``ARITY ** STEP`` nodes, so that a block's subtree is computed from its own row. *Recompute*: a proof
needs siblings of the levels between; each block's row makes them again from its stored nodes, hands
its nodes their siblings, and nothing of it is kept. Paths come from the root downwards: a node's
are its siblings in the block's subtree, then the path of the block's root, a node of the next
stored level.

Leaves are placed by a range sort of narrow rows, whose partitions' counts give each place, so a
language that holds most rows is sorted and hashed by many tasks; blocks hold 64 nodes at most.

Defined cases: a null field is ``-`` in its leaf; null ids come first; rows of one id are ordered by
their leaves, so repeated rows are leaves of their own; a tree of one leaf has it as root; no rows
have no root; columns beside the leaf's fields are kept by ``proofs``, whatever their names; rows of
null id are never tampered with by ``lowered``.
"""

from __future__ import annotations

import math
import string
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.plans.cluster import cut, delete_folder, join_small, shared_folder, shuffle_partitions

ARITY, STEP = 8, 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A node's siblings at one level: the digests left and right of it in its run, concatenated.
SIBLINGS = "array<struct<left:string,right:string>>"


def digest_of(fields: dict[str, Column]) -> Column:
    """Hex sha256 of fields, each ``-`` if null, else its UTF-8 byte count, a colon and the value."""
    shown = []
    for value in fields.values():
        body = value.cast("string")
        shown.append(F.coalesce(F.concat(F.octet_length(body).cast("string"), F.lit(":"), body), F.lit("-")))
    return F.sha2(F.concat(*shown), 256)


def leaf(text: str = "text") -> Column:
    """A document's leaf, with another column's text if need be."""
    return digest_of({f: F.col(text if f == "text" else f) for f in FIELDS})


def lowered(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The text with A-Z lower-cased where 3 divides the crc32 of the decimal id."""
    fits = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 0
    return F.when(fits, F.translate(text, string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.col(text))


def placed(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` (cut; no null ``tree``) with ``pos`` (place in its tree by ``order``) and ``n`` (rows of the tree)."""
    n = max(shuffle_partitions(rows.sparkSession), 2)
    # equal rows are told apart by their place in the cut table, else they would all sort in one task
    told = rows.withColumn("_row", F.monotonically_increasing_id())
    sorted_ = told.repartitionByRange(n, tree, *order, "_row").sortWithinPartitions(tree, *order, "_row").drop("_row")
    # ids number a partition's rows in its order
    numbered = cut(sorted_.withColumn("_id", F.monotonically_increasing_id())).withColumn("_part", F.shiftrightunsigned("_id", 33))
    parts = numbered.groupBy(tree, "_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = Window.partitionBy(tree).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).withColumn("n", F.sum("_n").over(Window.partitionBy(tree)))
    joined = join_small(numbered, cut(starts.select(tree, "_part", "_start", "n")), [tree, "_part"])
    return joined.withColumn("pos", F.col("_id") + F.col("_start")).drop("_id", "_part", "_start")


def height_of(n: Column) -> Column:
    """Levels above the leaves of a tree of n leaves."""
    powers = [ARITY**k for k in range(math.ceil(63 / math.log2(ARITY)))]
    return F.size(F.filter(F.array(*[F.lit(p).cast("long") for p in powers]), lambda p: p < n))


def _block(nodes: DataFrame, more: list[str], level: int) -> DataFrame:
    """tree, height, pos (the block's), kids (by place): one row for each aligned block."""
    grouped = nodes.groupBy("tree", "height", F.floor(F.col("pos") / ARITY**STEP).cast("long").alias("block"))
    kids = grouped.agg(F.array_sort(F.collect_list(F.struct("pos", "digest", *more))).alias("kids"))
    # the levels of this tree that the block folds
    levels = F.greatest(F.lit(0), F.least(F.lit(STEP), F.col("height") - level))
    return kids.select("tree", "height", F.col("block").alias("pos"), levels.alias("levels"), "kids")


def _runs_hashed(digests: Column) -> Column:
    """The level above: each run of ``ARITY`` digests hashed into one."""
    runs = F.sequence(F.lit(0), F.floor((F.size(digests) - 1) / ARITY).cast("int"))
    return F.transform(runs, lambda r: F.sha2(F.array_join(F.slice(digests, r * ARITY + 1, F.lit(ARITY)), ""), 256))


def _with_levels(blocks: DataFrame) -> DataFrame:
    """``_level0`` .. ``_level{STEP}``: a block's digests, each level from the one below as far as the tree goes."""
    blocks = blocks.withColumn("_level0", F.transform("kids", lambda k: k["digest"]))
    for up in range(1, STEP + 1):
        below = F.col(f"_level{up - 1}")
        blocks = blocks.withColumn(f"_level{up}", F.when(F.col("levels") >= up, _runs_hashed(below)).otherwise(below))
    return blocks


@dataclass
class Stored:
    """The stored levels of trees (folder/0, folder/1, ..), the lowest first, and their roots: tree, digest."""

    levels: list[DataFrame]
    roots: DataFrame


def store_levels(nodes: DataFrame, folder: str, more: list[str]) -> Stored:
    """Write every ``STEP``-th level of the trees of ``nodes`` (tree, pos, n, digest, and ``more`` of the leaves)."""
    spark = nodes.sparkSession
    rows = nodes.withColumn("height", height_of(F.col("n"))).drop("n")
    levels, level, top = [], 0, None
    while top is None or level < top:
        path = f"{folder}/{len(levels)}"
        _block(rows, more if not levels else [], level).write.parquet(path)
        levels.append(stored := spark.read.parquet(path))
        top = top if top is not None else stored.agg(F.max("height")).first()[0] or 0
        rows = _with_levels(stored).select("tree", "height", "pos", F.element_at(f"_level{STEP}", 1).alias("digest"))
        level += STEP
    return Stored(levels, rows.select("tree", "digest"))


def _own(k: Column, levels: str = "levels") -> Column:
    """Siblings of a block's kid k in the block's subtree, lowest first."""
    found = F.array().cast(SIBLINGS)
    for up in range(STEP):
        at = F.floor(k / ARITY**up).cast("int")
        run = F.slice(f"_level{up}", (F.floor(at / ARITY) * ARITY + 1).cast("int"), ARITY)
        place = F.pmod(at, F.lit(ARITY))
        sides = F.struct(F.array_join(F.slice(run, F.lit(1), place), "").alias("left"), F.array_join(F.slice(run, place + 2, F.lit(ARITY)), "").alias("right"))
        found = F.when(F.col(levels) > up, F.concat(found, F.array(sides))).otherwise(found)
    return found


def paths(stored: Stored, tops: DataFrame) -> DataFrame:
    """Of each leaf its columns and ``path``, its siblings from the leaf up.

    ``tops``: tree, path (what comes above a tree's root) and columns that every leaf of the tree gets.
    """
    more = [c for c in tops.columns if c not in ("tree", "path")]
    above = tops.withColumn("pos", F.lit(0).cast("long"))
    for i in range(len(stored.levels) - 1, -1, -1):
        blocks = _with_levels(stored.levels[i].join(above, ["tree", "pos"]).drop("pos", f"_level{STEP}"))
        each = blocks.select("tree", "levels", "path", *more, *[f"_level{up}" for up in range(STEP)], F.posexplode("kids").alias("_k", "kid"))
        above = each.select("tree", "kid.*", *more, F.concat(_own(F.col("_k")), "path").alias("path"))
    return above


def refold(node: Column, path: Column) -> Column:
    """The root that a node and its siblings give."""
    return F.aggregate(path, node, lambda below, sides: F.sha2(F.concat(sides["left"], below, sides["right"]), 256))


def proof(path: Column) -> Column:
    """Digest of a path's siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


@dataclass
class Manifest:
    """A dataset's stored trees: of the documents by language, and of the languages' roots."""

    folder: str
    documents: Stored
    languages: Stored

    @property
    def root(self) -> str | None:
        found = self.languages.roots.first()
        return found and found["digest"]

    def proofs(self) -> DataFrame:
        """Of each leaf its columns, lang, subroot, root and ``path``."""
        # null first, then bytewise: as the languages' keys are ordered
        roots = paths(self.languages, self.languages.roots.select("tree", F.col("digest").alias("root"), F.array().cast(SIBLINGS).alias("path")))
        tops = roots.select(F.col("of").alias("tree"), "path", "root", F.col("digest").alias("subroot"))
        return paths(self.documents, tops).withColumn("lang", F.when(F.col("tree") == "", None).otherwise(F.substring("tree", 2, 1 << 30))).drop("tree", "pos")

    def delete(self, spark: SparkSession) -> None:
        delete_folder(spark, self.folder)


def build(docs: DataFrame, other: Column | None = None, folder: str | None = None) -> Manifest:
    """Write the manifest of ``docs`` (``FIELDS``) to ``folder`` (default: one of the shared folder).

    ``other`` is a second text, whose leaf is kept as ``tampered`` where it differs: what a reader
    who got that text would fold. Further columns travel with the leaves in ``more``.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/manifest-{uuid.uuid4().hex}"
    extra = [F.col("`" + c.replace("`", "``") + "`").alias(c) for c in docs.columns if c not in FIELDS]
    more = ["doc_id", "tampered"] + (["more"] if extra else [])
    # a tree's key orders as its language does, and is never null
    tree = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))
    seen = docs.select(*FIELDS, *([F.struct(*extra).alias("more")] if extra else []), (F.lit(None).cast("string") if other is None else other).alias("_other"))
    changed = F.when(F.col("_other") != F.col("text"), leaf("_other"))
    leaves = cut(seen.select(tree.alias("tree"), leaf().alias("digest"), changed.alias("tampered"), "doc_id", *(["more"] if extra else [])))
    documents = store_levels(placed(leaves, "tree", ["doc_id", "digest"]), f"{folder}/documents", more)
    roots = cut(documents.roots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest"))
    languages = store_levels(placed(roots, "tree", ["of"]), f"{folder}/languages", ["of"])
    return Manifest(folder, documents, languages)


def verified(manifest: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row, lang and further columns."""
    found = manifest.proofs()
    folded = found.withColumn("folded_root", refold(F.coalesce("tampered", "digest"), F.col("path"))).withColumn("proof_sha256", proof(F.col("path")))
    extra = [F.col("more")[c].alias(c) for c in found.schema["more"].dataType.names] if "more" in found.columns else []
    return folded.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), "lang", *extra)


def _fields_sql(text: str) -> str:
    value = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    return "sha256(" + " || ".join(value(text if f == "text" else f) for f in FIELDS) + ")"


_CRC = "xor(list_reduce(string_split(CAST(doc_id AS VARCHAR), ''), lambda c, x: list_reduce(range(8), lambda d, i: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END, xor(c, CAST(ascii(x) AS BIGINT))), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"

ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, {_fields_sql('text')} AS leaf,
  CASE WHEN {_CRC} % 3 = 0 THEN {_fields_sql("translate(text, '" + string.ascii_uppercase + "', '" + string.ascii_lowercase + "')")} ELSE {_fields_sql('text')} END AS seen FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d),
t AS (SELECT 0 AS level, lang, pos, leaf AS h, n FROM l
  UNION ALL SELECT level + 1, lang, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), max((n + 7) // 8) FROM t WHERE n > 1 GROUP BY level, lang, pos // 8),
r AS (SELECT lang, h AS subroot, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS level, pos, subroot AS h, n FROM r
  UNION ALL SELECT level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), max((n + 7) // 8) FROM u WHERE n > 1 GROUP BY level, pos // 8),
w AS (SELECT h AS root FROM u WHERE n = 1),
e AS (SELECT t.lang, t.level, t.pos, coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (WHERE s.pos < t.pos), '') AS a, coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (WHERE s.pos > t.pos), '') AS z
  FROM t JOIN t s ON t.lang IS NOT DISTINCT FROM s.lang AND t.level = s.level AND t.pos // 8 = s.pos // 8 WHERE t.n > 1 GROUP BY ALL),
f AS (SELECT t.level, t.pos, coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (WHERE s.pos < t.pos), '') AS a, coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (WHERE s.pos > t.pos), '') AS z
  FROM u t JOIN u s ON t.level = s.level AND t.pos // 8 = s.pos // 8 WHERE t.n > 1 GROUP BY ALL),
p AS (SELECT l.lang, l.pos, e.level, e.a, e.z FROM l JOIN e ON l.lang IS NOT DISTINCT FROM e.lang AND l.pos // CAST(8 ** e.level AS BIGINT) = e.pos
  UNION ALL SELECT l.lang, l.pos, r.height + f.level, f.a, f.z FROM l JOIN r ON l.lang IS NOT DISTINCT FROM r.lang JOIN f ON r.pos // CAST(8 ** f.level AS BIGINT) = f.pos),
q AS (SELECT lang, pos, list({{'a': a, 'z': z}} ORDER BY level) AS path, sha256(string_agg(a || z, '' ORDER BY level)) AS proof_sha256 FROM p GROUP BY lang, pos),
g AS (SELECT lang, pos, 0 AS i, seen AS h FROM l
  UNION ALL SELECT g.lang, g.pos, i + 1, sha256(path[i + 1].a || h || path[i + 1].z) FROM g JOIN q ON g.lang IS NOT DISTINCT FROM q.lang AND g.pos = q.pos WHERE i < len(path))
SELECT l.doc_id, l.leaf, r.subroot, w.root, coalesce(q.proof_sha256, sha256('')) AS proof_sha256, g.h AS folded_root, g.h = w.root AS verified
FROM l JOIN r ON l.lang IS NOT DISTINCT FROM r.lang CROSS JOIN w LEFT JOIN q ON l.lang IS NOT DISTINCT FROM q.lang AND l.pos = q.pos
JOIN g ON l.lang IS NOT DISTINCT FROM g.lang AND l.pos = g.pos AND g.i = coalesce(len(q.path), 0)
"""
