"""SimHash near-duplicates with BK-trees.

Fingerprints are 64-bit SimHashes of word shingles. Two fingerprints that differ in at most two
of 64 bits agree in one of three blocks of 21 or 22 bits, so also in any prefix of it: every
fingerprint goes to three shards, one for the first bits of each block, only as many bits as leave
about ``TREE_ROWS`` fingerprints a shard, and no link is lost. A task holds one shard's BK-tree at
a time: children are keyed by their integer Hamming distance to the parent, and a search follows
only edges whose key is within the radius of the distance at the parent. A shard with very many
fingerprints is parted by its whole block, and where that does not suffice by a third of the bits
that are left, of which one agrees too. Shards report stars, components are found by distributed
rounds.

Shard trees reach their tasks through the shuffle, not from the driver: the fingerprints of all
documents must not pass the driver.

For wider radii (``similar``: shingles of five words, a similarity of 0.8) fingerprints have 512
bits, and a text's shards are dealt by the smallest of its shingles in some orders: as many keys as
find a pair at the bound with the recall asked for; closer pairs are found more surely. Bands of the
bits would need about eighty keys instead of a dozen, and the more the more texts there are, as half
of the bits of any two texts agree. Fingerprints only find candidates, by BK-trees; every link is by
the texts' own shingles, first along a spanning forest of each shard, then for all pairs that would
still join two components.

Defined cases: a null or empty text has no shingle and fingerprint zero; a text with fewer words
than a shingle is one shingle; rows with a null doc_id are fingerprinted but can't be a
component's id (a component of such rows only has a null id); repeated rows are repeated.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import as_bytes, by_key, packed
from granary.plans.cluster import connected_components, cut, join_references, join_small, release_shuffles

SEED = 42
#: Lowest bit and width of the three blocks of a fingerprint.
BLOCKS = ((0, 21), (21, 21), (42, 22))
#: Fingerprints of a tree on average, and above which a shard is parted further.
TREE_ROWS, SPLIT_ABOVE = 2_000, 16_000


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of each ``width``-word shingle of the ASCII-lower-cased text, repeats included."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-width])).tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, len(stops))


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for a in range(0, n, 1 << 16):
        part = hashes[a : a + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(shingle_hashes(t, width)) for t in texts], np.uint64).view(np.int64))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), fp(as_bytes("text")).alias("fp"))


class BKTree:
    """Integers by Hamming distance; children of a node are keyed by their distance to it."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        self.visited = 0  # nodes, by all searches

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        new, node = len(self.values) - 1, 0
        while node != new:
            node = self.children[node].setdefault((self.values[node] ^ value).bit_count(), new)

    def within(self, value: int, radius: int) -> list[int]:
        """Places of the values within the radius."""
        return [place for _, place in self.nearby(value, radius)]

    def nearby(self, value: int, radius: int) -> list[tuple[int, int]]:
        """Distances and places of the values within the radius."""
        found, todo = [], [0] if self.values else []
        while todo:
            node = todo.pop()
            self.visited += 1
            d = (self.values[node] ^ value).bit_count()
            if d <= radius:
                found.append((d, node))
            if len(kids := self.children[node]) <= 2 * radius + 1:
                todo += [c for key, c in kids.items() if d - radius <= key <= d + radius]
            else:
                todo += [kids[key] for key in range(d - radius, d + radius + 1) if key in kids]
        return found


class Groups:
    """Union-find over places in a list."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)


def _stars(radius: int):
    """Groups within each shard (shard, fp), as stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, dst = [], []
        for _, group in by_key(batches, "shard"):
            values = np.unique(group["fp"])
            if len(values) < 2:
                continue
            tree, groups = BKTree(), Groups(len(values))
            for i, value in enumerate(values.view(np.uint64).tolist()):
                for j in tree.within(value, radius):
                    groups.join(i, j)
                tree.add(value)
            for i in range(len(values)):
                if (r := groups.root(i)) != i:
                    src.append(values[r])
                    dst.append(values[i])
            if len(src) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])
                src, dst = [], []
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    return run


def _block(fp: Column, i: int) -> Column:
    low, bits = BLOCKS[i]
    return F.shiftrightunsigned(fp, low).bitwiseAND((1 << bits) - 1)


def _rest(fp: Column, i: int, k: int) -> Column:
    """Third k of the bits outside of block i, moved together."""
    low, bits = BLOCKS[i]
    below = fp.bitwiseAND((1 << low) - 1)
    above = F.shiftrightunsigned(fp, low + bits) if low + bits < 64 else F.lit(0).cast("long")
    return F.shiftrightunsigned(F.shiftleft(above, low).bitwiseOR(below), 15 * k).bitwiseAND((1 << 15) - 1)


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Stars (src, dst) that connect all distinct fingerprints (``fp``; cut) within the radius (2 at most)."""
    if not 0 <= radius <= 2:
        raise ValueError("one of three blocks agrees only up to two differing bits")
    fp = F.col("fp")
    prefix = max(0, min(21, math.ceil(math.log2(max(1, distinct.count() / TREE_ROWS)))))
    keys = [F.struct(F.lit(i).alias("block"), _block(fp, i).alias("whole"), F.shiftrightunsigned(_block(fp, i), BLOCKS[i][1] - prefix).alias("part")) for i in range(len(BLOCKS))]
    spread = distinct.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.*")
    # a shard with very many fingerprints is parted by the whole block, and again by thirds of the other bits
    hot = cut(spread.groupBy("block", "part").agg(F.count("*").alias("_n")).where(F.col("_n") > SPLIT_ABOVE).select("block", "part", F.lit(True).alias("_hot")))
    marked = join_small(spread, hot, ["block", "part"], "left")
    hotter = cut(marked.where("_hot").groupBy("block", "whole").agg(F.count("*").alias("_n")).where(F.col("_n") > SPLIT_ABOVE).select("block", "whole", F.lit(True).alias("_hotter")))
    marked = join_small(marked, hotter, ["block", "whole"], "left")
    none = F.lit(-1).cast("long")
    thirds = [F.array(*[F.struct(F.lit(k).alias("k"), _rest(fp, i, k).alias("bits")) for k in range(3)]) for i in range(len(BLOCKS))]
    finer = F.when(F.col("_hotter"), F.element_at(F.array(*thirds), F.col("block") + 1)).otherwise(F.array(F.struct(F.lit(-1).alias("k"), none.alias("bits"))))
    shards = marked.select("fp", "block", "part", F.when(F.col("_hot"), F.col("whole")).otherwise(none).alias("whole"), F.explode(finer).alias("f"))
    shards = shards.select(F.xxhash64("block", "part", "whole", "f.k", "f.bits").alias("shard"), "fp")
    return shards.repartition("shard").sortWithinPartitions("shard").mapInArrow(_stars(radius), "src long, dst long")


def component_ids(prints: DataFrame, radius: int = 2) -> DataFrame:
    """``prints`` (doc_id, fp) -> doc_id, fp, component_id (the smallest doc_id reachable)."""
    prints = cut(prints)
    lowest = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = connected_components(links(lowest.select("fp"), radius)).select(F.col("node").alias("fp"), "root")
    mapped = lowest.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = mapped.groupBy("root").agg(F.min("low").alias("component_id"))
    # exact copies share a fingerprint, maybe a large part of all documents
    return join_references(prints, mapped.join(named, "root").select("fp", "component_id"), "fp", ["doc_id"]).select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    found = component_ids(fingerprints(docs, width), radius)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Bits of the fingerprints for wide radii, and rows of a hot band's block.
WIDE_BITS, BLOCK_ROWS = 512, 2_000
#: Standard deviations beyond the radius within which fingerprints are candidates.
MARGIN = 2.5
#: Pairs that a task holds before it reduces them to their spanning forest, and shingles that it keeps of texts.
FOREST_EDGES, KEPT_SHINGLES = 1_000_000, 20_000_000
#: Minima in a key of ``similar``: texts that have little in common hardly ever share as many, however many texts there are.
MINIMA = 4


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """SimHash of 512 bits: of eight mixes of each hash."""
    ones = np.zeros(WIDE_BITS, np.int64)
    odd = np.arange(1, 2 * WIDE_BITS // 64, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for a in range(0, len(hashes), 1 << 13):
        mixed = hashes[a : a + (1 << 13), None] * odd
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(29)
        ones += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes()


def wide_radius(similarity: float) -> int:
    """Differing bits at which two sets of like size have this Jaccard similarity."""
    return round(WIDE_BITS * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def forest(edges: list[tuple[int, int, int]], n: int) -> list[tuple[int, int, int]]:
    """The edges (distance, place, place) of a minimum spanning forest of n places."""
    groups, kept = Groups(n), []
    for edge in sorted(edges):
        if groups.root(edge[1]) != groups.root(edge[2]):
            groups.join(edge[1], edge[2])
            kept.append(edge)
    return kept


def _candidates(wide: int):
    """A spanning forest, nearest first, of each shard's pairs (shard, id, bits) within ``wide`` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for _, group in by_key(batches, "shard"):
            ids, first = np.unique(group["id"], return_index=True)
            tree, near = BKTree(), []
            for i, bits in enumerate(int.from_bytes(x, "little") for x in group["bits"][first]):
                near += [(d, j, i) for d, j in tree.nearby(bits, wide)]
                tree.add(bits)
                if len(near) > FOREST_EDGES:
                    near = forest(near, len(ids))
            found += [(ids[j], ids[i]) for _, j, i in forest(near, len(ids))]
            if len(found) > 100_000:
                yield _pairs(found, "src", "dst")
                found = []
        yield _pairs(found, "src", "dst")

    return run


def _pairs(found: list[tuple[int, int]], *names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], list(names))


class MinKeys:
    """Keys of sets of shingles, each of the smallest of ``MINIMA`` orders: two sets share one with a probability of their similarity to that power."""

    def __init__(self, keys: int):
        self.factors = np.random.default_rng(SEED).integers(1, 2**63, keys * MINIMA, dtype=np.uint64) | np.uint64(1)

    def of(self, hashes: np.ndarray) -> list[int]:
        least = np.full(len(self.factors), np.iinfo(np.uint64).max)
        for a in range(0, len(hashes), 1 << 13):
            least = np.minimum(least, (hashes[a : a + (1 << 13), None] * self.factors).min(0))
        keys = [xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(least.reshape(-1, MINIMA))]
        return np.array(keys, np.uint64).view(np.int64).tolist()


def _open_pairs(group: dict[str, np.ndarray], wide: int) -> Iterator[tuple[int, int, int]]:
    """(distance, place, place) of a shard's pairs that join two roots."""
    roots, tree = group["root"].tolist(), BKTree()
    for i, bits in enumerate(int.from_bytes(x, "little") for x in group["bits"].tolist()):
        for d, j in tree.nearby(bits, wide):
            if roots[i] != roots[j]:
                yield d, j, i
        tree.add(bits)


def _open_ids(wide: int):
    """Of each shard (shard, id, bits, root) the ids that have a pair to another root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, group in by_key(batches, "shard"):
            if at := {i for _, *pair in _open_pairs(group, wide) for i in pair}:
                yield _pairs([(shard, int(group["id"][i])) for i in at], "shard", "id")

    return run


class Shingles(dict):
    """place -> the sorted shingle hashes of that text; forgotten when too many are held."""

    def __init__(self, bodies: np.ndarray, width: int):
        super().__init__()
        self.bodies, self.width, self.held = bodies, width, 0

    def __missing__(self, place: int) -> np.ndarray:
        found = np.unique(shingle_hashes(zstandard.decompress(self.bodies[place]), self.width))
        if self.held > KEPT_SHINGLES:
            self.clear()
            self.held = 0
        self.held += len(found)
        self[place] = found
        return found


def _settled(width: int, similarity: float, wide: int):
    """Links between roots of each shard (shard, id, bits, root, body): every open pair is compared unless others link its roots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in by_key(batches, "shard"):
            roots, place = np.unique(group["root"], return_inverse=True)
            groups, kept, links = Groups(len(roots)), Shingles(group["body"], width), []
            # the pairs are as many as the square of a block; they are looked at one by one, none is kept
            for _, i, j in _open_pairs(group, wide):
                a, b = groups.root(int(place[i])), groups.root(int(place[j]))
                if a != b and _similarity(kept[i], kept[j], similarity):
                    groups.join(a, b)
                    links.append((int(roots[a]), int(roots[b])))
            if links:
                yield _pairs(links, "src", "dst")

    return run


def _similarity(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sorted sets have that Jaccard similarity."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared >= least * (len(a) + len(b) - shared)


def _alike(width: int, similarity: float):
    """Whether two compressed texts have that Jaccard similarity of their shingles."""

    @F.pandas_udf("boolean")
    def alike(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for bodies in zip(left, right):
            out.append(_similarity(*(np.unique(shingle_hashes(zstandard.decompress(x), width)) for x in bodies), similarity))
        return pd.Series(out, dtype=bool)

    return alike(F.col("left"), F.col("right"))


def similar(docs: DataFrame, width: int = 5, similarity: float = 0.8, recall: float = 0.999) -> DataFrame:
    """doc_id, component_id: groups of texts linked by a similarity of their shingles.

    Candidates are pairs that share a key of minima and whose fingerprints are within the radius and
    ``MARGIN``; all links are by the texts' own shingles. First a spanning forest of each shard is
    compared, which links most of a group at the cost of its size; then the pairs that would still
    join two components are compared in their shards, so no candidate is left unchecked and no pair
    is stored. ``recall`` is the probability that a pair at the bound shares a key; closer ones do
    so more surely. Texts of equal fingerprints are one. Each step is cut, and its shuffle files go.
    """
    spark = docs.sparkSession

    def step(df: DataFrame) -> DataFrame:
        done = cut(df)
        del df  # else its plan holds the shuffle files
        release_shuffles(spark)
        return done

    radius = wide_radius(similarity)
    reach = radius + round(MARGIN * math.sqrt(radius * (1 - radius / WIDE_BITS)))

    keys_of = MinKeys(math.ceil(math.log(1 - recall) / math.log(1 - similarity**MINIMA)))

    @F.pandas_udf("id long, bits binary, keys array<long>")
    def wide(texts: pd.Series) -> pd.DataFrame:
        sets = [np.unique(shingle_hashes(t, width)) for t in texts]
        prints = [wide_fingerprint(x) for x in sets]
        return pd.DataFrame({"id": np.array([xxhash.xxh64_intdigest(p) for p in prints], np.uint64).view(np.int64), "bits": prints, "keys": [keys_of.of(x) for x in sets]})

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), as_bytes("text").alias("body"))
    prints = cut(rows.select("doc_id", "text_key", wide(F.col("body")).alias("w")).select("doc_id", "text_key", "w.id", "w.bits", "w.keys"))
    # the smallest id stands for equal fingerprints, with one of its texts
    texts = cut(prints.groupBy("id").agg(F.min(F.struct("doc_id", "text_key", "keys")).alias("low"), F.first("bits").alias("bits")).select("id", F.col("low.doc_id").alias("low"), F.col("low.text_key").alias("low_key"), "bits", "low.keys"))
    dealt = texts.select("id", F.explode("keys").alias("key"))
    # of each key all that matters is who shares it
    sizes = dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = dealt.join(sizes, "key")
    # a hot key's texts meet in blocks, two by two
    blocks = F.ceil(F.col("n") / BLOCK_ROWS).cast("int")
    own = F.pmod(F.xxhash64("id", "key"), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: F.xxhash64("key", F.least(i, own), F.greatest(i, own)))
    every = step(met.select("id", F.explode(pairs).alias("shard")))
    # texts that are alike meet by several keys: of shards with the same ids one is enough
    kinds = every.groupBy("shard").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    shards = step(every.join(kinds.groupBy("n", "x", "y").agg(F.min("shard").alias("shard")).select("shard"), "shard"))
    dealt_out = lambda df: df.repartition("shard").sortWithinPartitions("shard", "id")
    with_bits = lambda df: df.join(texts.select("id", "bits"), "id")
    found = step(dealt_out(with_bits(shards).select("shard", "id", "bits")).mapInArrow(_candidates(reach), "src long, dst long").distinct())
    stored = texts.select("id", F.col("low").alias("doc_id"), F.col("low_key").alias("text_key"))
    # texts are met by their ids where they lie, or shuffled once where these are many
    bodies = lambda ids: join_small(rows, cut(ids.join(stored, "id")), ["doc_id", "text_key"], salts=1).select("id", packed(F.col("body")).alias("body")).dropDuplicates(["id"])
    asked = step(bodies(found.select(F.explode(F.array("src", "dst")).alias("id")).distinct()))
    both = found.join(asked.select(F.col("id").alias("src"), F.col("body").alias("left")), "src").join(asked.select(F.col("id").alias("dst"), F.col("body").alias("right")), "dst")
    roots = step(connected_components(both.where(_alike(width, similarity)).select("src", "dst")))
    # what the forests have not linked: shards of several components, and the texts in them with a candidate of another
    grouped = cut(texts.drop("bits", "keys").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id")))
    labelled = step(shards.join(grouped.select("id", "root"), "id"))
    several = labelled.groupBy("shard").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("shard")
    mixed = step(with_bits(labelled.join(several, "shard")).select("shard", "id", "bits", "root"))
    unsure = step(dealt_out(mixed).mapInArrow(_open_ids(reach), "shard long, id long"))
    left = mixed.join(unsure, ["shard", "id"]).join(bodies(unsure.select("id").distinct()), "id").select("shard", "id", "bits", "root", "body")
    joined = connected_components(dealt_out(left).mapInArrow(_settled(width, similarity, reach), "src long, dst long"))
    mapped = grouped.join(joined.select(F.col("node").alias("root"), F.col("root").alias("whole")), "root", "left").withColumn("whole", F.coalesce("whole", "root"))
    named = mapped.groupBy("whole").agg(F.min("low").alias("component_id"))
    return join_references(prints.select("doc_id", "id", "text_key"), mapped.join(named, "whole").select("id", "component_id"), "id", ["doc_id", "text_key"]).select("doc_id", "component_id")
