"""Benchmark decontamination by suffix arrays over the training texts.

1. Documents form shards of about ``SHARD_WORDS`` words, each wholly in one task, and every shard's
   word sequence gets a suffix array (prefix doubling over word ids, as deep as the longest item).
2. Every suffix of every test item is searched in each shard's array: binary search narrows its range
   word by word until none is left, which gives the longest verbatim match and, as a range of the
   array, all its places. Where the range is left after a window's words, the window occurs there.
3. Words in occurrences of windows are hits; documents with hits are removed.

The documents are read once and never shuffled. The test items are a stated query set: blocks of
about ``BLOCK_WORDS`` words of them are searched one after the other, so a task holds a bounded
block whatever the items' number; each further block reads what the one before has written.

Words are runs of digits, letters and characters beyond ASCII, A-Z lower-cased. A window is ``width``
consecutive words of an item; an item of fewer words, but not none, is one window.

Defined cases: null texts have no words; items without words never occur; rows of one item_id count
as one item, a null item_id's words are searched and hit, but count as no item; repeated documents
have rows of their own; other columns are kept, whatever their names; no items leave all clean.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import as_bytes
from granary.plans.cluster import cut

WIDTH = 10
#: Words of a shard (a longer document is a shard of its own) and of a block of items; ids that a task keeps.
SHARD_WORDS, BLOCK_WORDS, MOST_IDS = 1 << 20, 1 << 20, 1 << 20
#: A text's bytes in lower case with a space for all that is in no word.
_FOLD = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class WordIds(dict):
    """word -> id from 1; long words are kept as digests, so that memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(word) > 64:
            return self[hashlib.sha256(word).digest() + b"#"]
        self[word] = value = len(self) + 1
        return value


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``ids`` in the order of their suffixes, compared by ``depth`` words at least.

    Prefix doubling: places are ranked by twice as many words each round, only those that are not
    yet alone in their rank.
    """
    n = len(ids)
    order = _order(ids.astype(np.uint64), np.zeros(n, np.uint64), np.arange(n))
    rank, done = np.empty(n + 1, np.int64), 1
    rank[n] = -1  # the end comes first
    firsts = np.flatnonzero(np.r_[True, ids[order][1:] != ids[order][:-1]])
    sizes = np.diff(np.r_[firsts, n])
    rank[order] = np.repeat(firsts, sizes)
    slots = np.flatnonzero(np.repeat(sizes > 1, sizes))
    while len(slots) and done < depth:
        at = order[slots]
        after = rank[np.minimum(at + done, n)]
        fresh = _order(rank[at].astype(np.uint64), (after + 1).astype(np.uint64), at)
        # the places of a rank fill the slots of that rank, in their new order
        order[slots] = fresh
        first, second = rank[fresh], rank[np.minimum(fresh + done, n)]
        new = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])]
        starts = np.flatnonzero(new)
        sizes = np.diff(np.r_[starts, len(slots)])
        rank[fresh] = np.repeat(slots[starts], sizes)
        slots = slots[np.repeat(sizes > 1, sizes)]
        done *= 2
    return order


def _order(high: np.ndarray, low: np.ndarray, places: np.ndarray) -> np.ndarray:
    """``places`` by (high, low, place): one sort of packed integers where they fit into 64 bits."""
    bits = [int(x.max() if len(x) else 0).bit_length() for x in (high, low, places)]
    if sum(bits) <= 64:
        packed = high << np.uint64(bits[1] + bits[2]) | low << np.uint64(bits[2]) | places.astype(np.uint64)
        packed.sort()
        return (packed & np.uint64((1 << bits[2]) - 1)).astype(np.int64)
    return places[np.lexsort((places, low, high))]


class Items:
    """A block of test items: their words, and where the suffixes and windows start."""

    def __init__(self, rows: list[tuple[str | None, int, list[bytes]]], width: int):
        self.names = [name for name, _, _ in rows]
        self.keys = [key for _, key, _ in rows]
        sizes = np.array([len(w) for _, _, w in rows], np.int64)
        self.words = [w for _, _, words in rows for w in words]
        self.depth = int(sizes.max()) if len(sizes) else 0
        self.item = np.repeat(np.arange(len(rows)), sizes)
        starts = np.cumsum(sizes) - sizes
        self.offset = np.arange(len(self.words)) - np.repeat(starts, sizes)
        self.left = np.repeat(sizes, sizes) - self.offset  # words of the suffix
        window = np.minimum(sizes, width)[self.item] if len(sizes) else self.left
        self.window = np.where(self.left >= window, window, 0)  # words of the window that starts here


def search(ids: np.ndarray, order: np.ndarray, words: np.ndarray, items: Items) -> tuple[np.ndarray, ...]:
    """Of every test suffix: words matched, the array's range of those places, and the range of its window's."""
    n, m = len(ids), len(words)
    length, windows = np.zeros(m, np.int64), np.zeros((2, m), np.int64)
    low, high = np.zeros(m, np.int64), np.full(m, n)
    live, deep = np.arange(m), 0
    padded = np.r_[ids, 0]
    while len(live):
        # the words that follow a range's places are in order
        wanted = words[live + deep]
        a, z = (_bisect(padded, order, deep, low[live], high[live], wanted, right) for right in (False, True))
        found = a < z
        live = live[found]
        low[live], high[live] = a[found], z[found]
        deep += 1
        length[live] = deep
        done = live[items.window[live] == deep]
        windows[0, done], windows[1, done] = low[done], high[done]
        live = live[items.left[live] > deep]
    return length, low, high, windows


def _bisect(padded: np.ndarray, order: np.ndarray, deep: int, low: np.ndarray, high: np.ndarray, wanted: np.ndarray, right: bool) -> np.ndarray:
    """First place in each range whose word at depth ``deep`` is not below (right: is above) the wanted one."""
    low, high = low.copy(), high.copy()
    end = len(padded) - 1
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) // 2
        word = padded[np.minimum(order[middle] + deep, end)]
        below = word <= wanted[open_] if right else word < wanted[open_]
        low[open_[below]] = middle[below] + 1
        high[open_[~below]] = middle[~below]
        open_ = open_[low[open_] < high[open_]]
    return low


class Shard:
    """Documents' words in one sequence, with a 0 after each document, and what was found of the items in it."""

    def __init__(self, docs: list[np.ndarray], items: Items, words: np.ndarray):
        self.docs, self.items = docs, items
        sizes = np.array([len(w) + 1 for w in docs])
        self.starts = np.cumsum(sizes) - sizes
        self.ids = np.zeros(int(sizes.sum()), np.int64)
        for start, w in zip(self.starts.tolist(), docs):
            self.ids[start : start + len(w)] = w
        self.order = suffix_array(self.ids, items.depth)
        self.length, self.low, self.high, self.windows = search(self.ids, self.order, words, items)

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, "right") - 1

    def occurrences(self) -> tuple[np.ndarray, dict[int, set[int]]]:
        """Whether each word lies in an occurrence of a window; of each document the items with one in it."""
        low, high = self.windows
        at = np.flatnonzero(low < high)
        if not len(at):
            return np.zeros(len(self.ids), bool), {}
        # equal windows have equal ranges: each is looked up once
        lengths = self.items.window[at]
        _, first, kind = np.unique(low[at] * (int(lengths.max()) + 1) + lengths, return_index=True, return_inverse=True)
        members: list[list[int]] = [[] for _ in first]
        for suffix, k in zip(at.tolist(), kind.tolist()):
            members[k].append(int(self.items.item[suffix]))
        low, high, lengths = low[at[first]], high[at[first]], lengths[first]
        kinds = np.repeat(np.arange(len(first)), high - low)
        within = np.arange(len(kinds)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
        places = self.order[low[kinds] + within]
        n = len(self.ids) + 1
        edge = np.bincount(places, minlength=n) - np.bincount(places + lengths[kinds], minlength=n)
        return np.cumsum(edge[:-1]) > 0, self._items(places, kinds, members)

    def _items(self, places: np.ndarray, kinds: np.ndarray, members: list[list[int]]) -> dict[int, set[int]]:
        """Of each document the items with a window in it."""
        pairs = np.unique(np.stack([self.document(places), kinds]), axis=1)
        found: dict[int, set[int]] = {}
        for doc, kind in pairs.T.tolist():
            found.setdefault(doc, set()).update(members[kind])
        return found


def _shards(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[tuple[Shard, pa.Table]]:
    """Shards of whole documents, with the rows that they come from."""
    ids, size, docs, held = WordIds(), 0, [], []
    words = np.fromiter(map(ids.__getitem__, items.words), np.int64, len(items.words))
    for b in batches:
        begin = 0
        for i, body in enumerate(b["body"]):
            found = words_of(body.as_py())
            docs.append(np.fromiter(map(ids.__getitem__, found), np.int64, len(found)))
            size += len(found) + 1
            if size >= SHARD_WORDS:
                held.append(b.slice(begin, i + 1 - begin))
                yield Shard(docs, items, words), pa.Table.from_batches(held)
                docs, size, held, begin = [], 0, [], i + 1
                if len(ids) > MOST_IDS:
                    ids = WordIds()
                    words = np.fromiter(map(ids.__getitem__, items.words), np.int64, len(items.words))
        if begin < b.num_rows:
            held.append(b.slice(begin))
    if docs:
        yield Shard(docs, items, words), pa.Table.from_batches(held)


def _spans(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    turn = np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0]))
    return turn[::2].astype(np.int32), turn[1::2].astype(np.int32)


#: What is found in a document: spans of hit words (from, to), and the items.
FOUND = "n_words long, n_hit long, starts array<int>, ends array<int>, items array<string>"


def _report(items: Items):
    """Adds a block's findings to those of the blocks before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _shards(batches, items):
            hit, by_doc = shard.occurrences()
            before = zip(*(rows[c].to_pylist() for c in ("starts", "ends", "items")))
            out = []
            for i, (words, start, (starts, ends, named)) in enumerate(zip(shard.docs, shard.starts.tolist(), before)):
                own = hit[start : start + len(words)]
                for a, z in zip(starts, ends):
                    own[a:z] = True
                named = sorted({items.names[k] for k in by_doc.get(i, ())} - {None} | set(named))
                out.append((len(words), int(own.sum()), *_spans(own), named))
            columns = dict(zip(rows.column_names, rows.columns))
            for field, kind, values in zip(FOUND.split(", "), (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string())), zip(*out)):
                columns[field.split()[0]] = pa.array(values, kind)
            yield from pa.table(columns).to_batches()

    return run


def item_blocks(items: DataFrame, width: int) -> Iterator[Items]:
    """Blocks of items (_key, item_id, text), which pass the driver a partition at a time; one at least."""
    block, size, some = [], 0, False
    for row in items.select("_key", F.col("item_id").cast("string").alias("item_id"), as_bytes("text").alias("body")).toLocalIterator():
        if words := words_of(bytes(row["body"])):
            block.append((row["item_id"], row["_key"], words))
            size += len(words)
        if size >= BLOCK_WORDS:
            yield Items(block, width)
            block, size, some = [], 0, True
    if block or not some:
        yield Items(block, width)


def _keyed(items: DataFrame) -> DataFrame:
    return cut(items.select("item_id", "text").withColumn("_key", F.monotonically_increasing_id()))


def report(docs: DataFrame, items: DataFrame, width: int = WIDTH, with_text: bool = True) -> DataFrame:
    """``docs`` (text, ...) with n_words, n_hit, n_items, items (ids as strings, sorted), spans and contaminated.

    ``spans``: the hit words, as structs of ``start`` and ``end`` (words from 0). Columns of ``docs``
    are kept (the text only ``with_text``); those of the new names are replaced.
    """
    others = [c for c in docs.columns if c not in ("n_words", "n_hit", "n_items", "items", "spans", "contaminated") and (with_text or c != "text")]
    more = F.struct(*[F.col("`" + c.replace("`", "``") + "`").alias(f"c{i}") for i, c in enumerate(others)], F.lit(0).alias("none")).alias("more")
    empty = [F.array().cast(f"array<{k}>").alias(c) for c, k in (("starts", "int"), ("ends", "int"), ("items", "string"))]
    found = docs.select(more, as_bytes("text").alias("body"), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), *empty)
    form = found.schema
    for i, block in enumerate(item_blocks(_keyed(items), width)):
        # each further block reads what the one before has written
        found = (cut(found) if i else found).mapInArrow(_report(block), form)
    spans = F.transform(F.arrays_zip("starts", "ends"), lambda s: F.struct(s["starts"].alias("start"), s["ends"].alias("end")))
    kept = [F.col("more")[f"c{i}"].alias(c) for i, c in enumerate(others)]
    return found.select(*kept, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", spans.alias("spans"), (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` without those that hold a window of an item."""
    quoted = [F.col("_doc")[c].alias(c) for c in docs.columns]
    whole = docs.select(F.col("text"), F.struct(*[F.col("`" + c.replace("`", "``") + "`").alias(c) for c in docs.columns]).alias("_doc"))
    return report(whole, items, width, with_text=False).where("not contaminated").select(*quoted)


#: The longest match of a test suffix in a task's shards, how many places have it, and the first of them.
MATCHES = "_key long, offset int, length int, places long, doc_id long, place int"


def _longest(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros(len(items.words), np.int64)
        found: dict[int, tuple[int, tuple[int, int]]] = {}
        for shard, rows in _shards(batches, items):
            ids = rows["doc_id"].to_pylist()
            for s in np.flatnonzero((shard.length > 0) & (shard.length >= best)).tolist():
                places = shard.order[shard.low[s] : shard.high[s]]
                docs = shard.document(places)
                lowest = min(ids[d] for d in np.unique(docs).tolist())
                own = np.array([ids[d] == lowest for d in docs.tolist()])
                first, many = (lowest, int((places - shard.starts[docs])[own].min())), len(places)
                if shard.length[s] == best[s]:
                    many, first = many + found[s][0], min(first, found[s][1])
                best[s], found[s] = shard.length[s], (many, first)
        rows = [(items.keys[items.item[s]], int(items.offset[s]), int(best[s]), many, *first) for s, (many, first) in found.items()]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [x.split()[0] for x in MATCHES.split(", ")])

    return run


def longest_matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, offset, length, places, doc_id, place of every suffix of every item that starts with a document's word.

    ``offset``: the suffix's first word in its item; ``length``: words of its longest verbatim match
    in any document; ``places``: how often that occurs; ``doc_id`` and ``place``: the first
    occurrence. Documents of null id take no part.
    """
    keyed = _keyed(items)
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes("text").alias("body"))
    parts = [rows.mapInArrow(_longest(block), MATCHES) for block in item_blocks(keyed, WIDTH)]
    every = reduce(DataFrame.unionByName, parts)
    top = every.groupBy("_key", "offset", "length").agg(F.sum("places").alias("places"), F.min(F.struct("doc_id", "place")).alias("first"))
    best = top.groupBy("_key", "offset").agg(F.max(F.struct("length", "places", "first")).alias("b"))
    return best.join(keyed.select("_key", "item_id"), "_key").select("item_id", "offset", "b.length", "b.places", "b.first.doc_id", "b.first.place")
