"""Substring deduplication with difference-cover anchors.

A word is removed if a window of ``window`` words covers it whose words also start in a document
with a smaller id. Positions modulo a period v are in a difference cover D if every pair of
positions meets D together after the same step below v. So two documents that share a window share
an anchor of ``window - v + 1`` words that starts at a cover position of both, and only those
positions (3 of 7 for windows of 13) are hashed:

1. anchors: hashed at cover positions, dealt by hash; those of two documents or more are candidates;
2. extension: only windows around candidate anchors are hashed (64 bits besides the bits that deal
   them); of equal ones all but the smallest document's are repeats;
3. repeats go back to their documents, whose covered words are removed.

What recurs within a batch is settled in it (one entry of it goes on), so a passage that a third of
all documents hold is no hot key. Texts are never grouped; the joins carry them compressed.

Defined cases: null and empty texts have no words; documents shorter than a window lose nothing;
rows with a null doc_id lose nothing and make no one else lose anything; rows of equal id are no
repeats of each other; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import WordCache, as_bytes, packed
from granary.plans.cluster import shuffle_partitions

WINDOW = 13
#: Perfect difference sets by period.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
#: Entries of a bucket (a task's unit of work) and of a batch that is settled at once.
BUCKET_ENTRIES, BATCH_ENTRIES = 1_000_000, 1_000_000
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def period_for(window: int) -> int:
    """The longest period that leaves anchors of half a window or more."""
    return max(v for v in COVERS if v == 1 or window - v + 1 >= window / 2)


def rolling(words: np.ndarray, width: int, factor: np.uint64) -> np.ndarray:
    """Hash of each run of ``width`` word hashes."""
    n = len(words) - width + 1
    out = np.zeros(max(0, n), np.uint64)
    for j in range(width if n > 0 else 0):
        out = out * factor + words[j : j + n]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ out >> np.uint64(29)


def _hashes(cache: WordCache, body: bytes) -> np.ndarray:
    words = zstandard.decompress(body).split()
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))


#: Rows of ``_dealt``: entries of a bucket by document; places are split into two shorts.
HITS = "bucket int, docs array<long>, keys array<long>, n array<int>, low array<short>, high array<short>"
ENTRIES = HITS + ", hashes array<{}>, code array<byte>"
#: An entry is to be compared; is a hit for sure and stands for others of its batch; is a hit for sure.
OPEN, STANDS, SURE = 0, 1, 2


class Batch:
    """Entries (document, key, place, hash) of some documents."""

    def __init__(self, buckets: int, smallest_only: bool):
        self.buckets, self.smallest_only = buckets, smallest_only
        self.parts: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, doc: int, key: int, at: np.ndarray, hashes: np.ndarray, deal: np.ndarray) -> None:
        if len(at):
            self.parts.append((doc, key, at.astype(np.int32), hashes, deal))
            self.size += len(at)

    def settled(self) -> pa.RecordBatch:
        """Rows by bucket; of what recurs in the batch only what others may need is left to compare."""
        sizes = [len(p[2]) for p in self.parts]
        docs, keys = (np.repeat(np.array([p[i] for p in self.parts], np.int64), sizes) for i in (0, 1))
        at, hashes, deal = (np.concatenate([p[i] for p in self.parts]) for i in (2, 3, 4))
        # by the dealing bits too: entries of other buckets are none that the first can stand for
        order = np.lexsort((docs, deal, hashes))
        docs, keys, at, hashes, deal = (x[order] for x in (docs, keys, at, hashes, deal))
        new = np.r_[True, (hashes[1:] != hashes[:-1]) | (deal[1:] != deal[:-1])]
        group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        code = np.zeros(len(at), np.int8)
        if self.smallest_only:
            code[docs != docs[first][group]] = SURE
        else:
            low, high = (f.reduceat(docs, first) for f in (np.minimum, np.maximum))
            shared = (low != high)[group]
            code[shared] = SURE
            code[first[low != high]] = STANDS
        bucket = np.where(code == SURE, _bucket_of(docs, self.buckets), deal % np.uint64(self.buckets)).astype(np.int32)
        self.parts, self.size = [], 0
        stored = hashes.view(np.int64) if self.smallest_only else hashes.astype(np.uint32).view(np.int32)
        return _dealt(bucket, docs, keys, at, hashes=stored, code=code)


def _dealt(bucket: np.ndarray, docs: np.ndarray, keys: np.ndarray, at: np.ndarray, **more: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket: its documents, how many entries each has (``n``), and the entries."""
    order = np.lexsort((at, keys, docs, bucket))
    bucket, docs, keys, at = (x[order] for x in (bucket, docs, keys, at))
    new = np.r_[True, bucket[1:] != bucket[:-1]][: len(at)]
    starts = np.flatnonzero(new)
    runs = np.flatnonzero(new | np.r_[True, (docs[1:] != docs[:-1]) | (keys[1:] != keys[:-1])][: len(at)])
    offsets, by_run = np.r_[starts, len(at)], np.r_[np.searchsorted(runs, starts), len(runs)]
    columns = {"bucket": pa.array(bucket[starts], pa.int32())}
    columns |= {name: _lists(x, by_run) for name, x in (("docs", docs[runs]), ("keys", keys[runs]), ("n", np.diff(np.r_[runs, len(at)]).astype(np.int32)))}
    columns |= {name: _lists(x, offsets) for name, x in (("low", (at & 0xFFFF).astype(np.uint16).view(np.int16)), ("high", (at >> 16).astype(np.int16)), *((k, x[order]) for k, x in more.items()))}
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _entries(parts: list[pa.RecordBatch], *more: str) -> list[np.ndarray]:
    """Documents, keys, places and further columns of the entries in rows of ``_dealt``."""
    whole = pa.Table.from_batches(parts)
    docs, keys, n, low, high, *rest = (np.concatenate([np.asarray(c.flatten()) for c in whole[x].chunks]) for x in ("docs", "keys", "n", "low", "high", *more))
    return [np.repeat(docs, n), np.repeat(keys, n), high.astype(np.int32) << 16 | low.view(np.uint16), *rest]


def _bucket_of(docs: np.ndarray, buckets: int) -> np.ndarray:
    return (docs.view(np.uint64) * _M2 >> np.uint64(33)) % np.uint64(buckets)


def _anchor_entries(window: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, period = WordCache(lambda w: xxhash.xxh3_64_intdigest(w)), period_for(window)
        cover, batch = np.array(COVERS[period]), Batch(buckets, smallest_only=False)
        for b in batches:
            for doc, body in zip(b["doc_id"].to_pylist(), b["body"]):
                words = body.as_py().split()
                n = len(words)
                if n < window:
                    continue
                hashes = rolling(np.fromiter(map(cache.__getitem__, words), np.uint64, n), window - period + 1, _M1)
                at = np.add.outer(np.arange(0, len(hashes), period), cover).ravel()
                at = at[at < len(hashes)]
                h = hashes[at]
                # 32 bits beside those that deal the entries: a false match costs work only
                batch.add(doc, 0, at, h >> np.uint64(32), h & np.uint64(0xFFFFFFFF))
                if batch.size >= BATCH_ENTRIES:
                    yield batch.settled()
        if batch.size:
            yield batch.settled()

    return run


def _window_entries(window: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, period = WordCache(lambda w: xxhash.xxh3_64_intdigest(w)), period_for(window)
        batch = Batch(buckets, smallest_only=True)
        for b in batches:
            for doc, key, body, at in zip(b["doc_id"].to_pylist(), b["key"].to_pylist(), b["body"], b["at"]):
                words = _hashes(cache, body.as_py())
                n = len(words) - window + 1
                if n <= 0:
                    continue
                at = np.asarray(at.values)
                at = at[at < n + period - 1]
                # a window is open if a candidate anchor starts in its first `period` places
                edge = np.zeros(n + period + 1, np.int32)
                np.add.at(edge, np.maximum(0, at - period + 1), 1)
                np.add.at(edge, np.minimum(at + 1, n), -1)
                places = np.flatnonzero(np.cumsum(edge[:n]) > 0)
                batch.add(doc, key, places, rolling(words, window, _M1)[places], rolling(words, window, _M2)[places])
                if batch.size >= BATCH_ENTRIES:
                    yield batch.settled()
        if batch.size:
            yield batch.settled()

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The rows of each bucket, of batches sorted by it."""
    held, last = [], None
    for b in batches:
        buckets = b["bucket"].to_numpy()
        cuts = np.flatnonzero(np.diff(buckets)) + 1
        for a, z in zip(np.r_[0, cuts], np.r_[cuts, len(buckets)]):
            if a < z:
                if held and buckets[a] != last:
                    yield held
                    held = []
                last = buckets[a]
                held.append(b.slice(a, z - a))
    if held:
        yield held


def _compare(smallest_only: bool, buckets: int):
    """Hits among a bucket's entries, dealt by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _by_bucket(batches):
            docs, keys, at, hashes, code = _entries(parts, "hashes", "code")
            hit = code == SURE if smallest_only else code != OPEN
            open_ = np.flatnonzero(code != SURE)
            open_ = open_[np.argsort(hashes[open_], kind="stable")]
            if len(open_):
                h = hashes[open_]
                new = np.r_[True, h[1:] != h[:-1]]
                first, group = np.flatnonzero(new), np.cumsum(new) - 1
                low, high = (f.reduceat(docs[open_], first)[group] for f in (np.minimum, np.maximum))
                hit[open_] |= docs[open_] > low if smallest_only else low != high
            docs, keys, at = docs[hit], keys[hit], at[hit]
            yield _dealt(_bucket_of(docs, buckets).astype(np.int32), docs, keys, at)

    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document with its hits."""
    for parts in _by_bucket(batches):
        docs, keys, at = _entries(parts)
        order = np.lexsort((at, keys, docs))
        docs, keys, at = docs[order], keys[order], at[order]
        first = np.flatnonzero(np.r_[True, (docs[1:] != docs[:-1]) | (keys[1:] != keys[:-1])][: len(docs)])
        yield pa.RecordBatch.from_arrays([pa.array(docs[first], pa.int64()), pa.array(keys[first], pa.int64()), _lists(at.astype(np.int32), np.r_[first, len(at)])], ["doc_id", "key", "at"])


def _by_document(entries: DataFrame, smallest_only: bool, buckets: int) -> DataFrame:
    sort = lambda df: df.repartition("bucket").sortWithinPartitions("bucket")
    hits = sort(entries).mapInArrow(_compare(smallest_only, buckets), HITS)
    return sort(hits).mapInArrow(_gather, "doc_id long, key long, at array<int>")


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, key, at: places (words from 0) of the windows that also start in a document of smaller id."""
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("key"), as_bytes("text").alias("body"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    period = period_for(window)
    # words have five bytes and a space or so
    buckets = max(shuffle_partitions(docs.sparkSession), int(size / 6 * len(COVERS[period]) / period / BUCKET_ENTRIES) + 1)
    anchors = rows.select("doc_id", "body").mapInArrow(_anchor_entries(window, buckets), ENTRIES.format("int"))
    # by id alone: rows of one id share their candidates, which costs work only
    candidates = _by_document(anchors, smallest_only=False, buckets=buckets).select("doc_id", "at")
    around = candidates.join(rows.select("doc_id", "key", packed("body").alias("body")), "doc_id")
    windows = around.select("doc_id", "key", "body", "at").mapInArrow(_window_entries(window, buckets), ENTRIES.format("long"))
    return _by_document(windows, smallest_only=True, buckets=buckets)


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` (doc_id, text, ...) with n_words, n_removed and kept (the words left, joined by one space) for text.

    Other columns are kept; those of the three names are replaced.
    """

    @F.pandas_udf("n_words long, n_removed long, kept string")
    def cutting(bodies: pd.Series, places: pd.Series) -> pd.DataFrame:
        out = []
        for body, at in zip(bodies, places):
            words = zstandard.decompress(body).split()
            if at is None or not len(at):
                out.append((len(words), 0, b" ".join(words).decode("utf-8", "replace")))
                continue
            edge = np.zeros(len(words) + 1, np.int64)
            at = np.unique(np.asarray(at))
            edge[at] += 1
            np.add.at(edge, at + window, -1)
            gone = np.cumsum(edge[:-1]) > 0
            out.append((len(words), int(gone.sum()), b" ".join(w for w, g in zip(words, gone.tolist()) if not g).decode("utf-8", "replace")))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept"])

    found = repeats(docs, window).select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), F.col("at").alias("_at"))
    # other columns travel in a struct, so that no name clashes
    others = [c for c in docs.columns if c not in ("text", "n_words", "n_removed", "kept")]
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in others]
    rows = docs.select(F.struct(*quoted).alias("_more"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("doc_id", "text").alias("_row"), packed(as_bytes("text")).alias("_body"))
    joined = rows.join(found, (F.col("_id") == F.col("_doc")) & (F.col("_row") == F.col("_key")), "left")
    return joined.withColumn("_cut", cutting("_body", "_at")).select(*[F.col("_more").getField(c).alias(c) for c in others], "_cut.*")
