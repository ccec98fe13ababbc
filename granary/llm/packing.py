"""Best-fit packing by a configuration linear program.

Documents are token ids with an end id; only those longer than a sequence are cut. The number of
pieces of each length (at most 2048 numbers) is all the driver needs: a configuration is a
multiset of lengths that fits a sequence, the program covers every length's count with as few
configurations as it can. It is solved by multiplicative weights: a knapsack dynamic program
prices the configuration that is worth most, which is used as often as its pieces last, in whole
sequences (that is the rounding); the weights of what is packed shrink. What no configuration packs
within the space that a lower bound leaves to spare is packed by best fit over the counts. Pieces
then find their places from their rank within their length.

Defined cases: null and empty texts are the end id alone; pieces of equal length are
interchangeable; rows with a null doc_id are packed as well; an empty table packs into nothing.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import cache as cache_per_worker

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import WordCache, as_bytes
from granary.plans.cluster import cut, rank_in_group

CAPACITY, END_ID = 2048, 0
#: Lengths that are priced at a time, and how much the weight of an untouched length is above a packed one's (as a power of e).
POOL, RATE = 96, 1.0


#: Words that the tokenizer's normalisation only lower-cases and that it does not part.
_LETTERS = re.compile("[a-zß-öø-ÿÀ-ÖØ-Þ]+")


def _byte_level() -> dict[int, str]:
    """Letters as the characters that stand for their bytes: a printable byte's own, else the next one from 256 on."""
    shown = {b for a, z in ((33, 126), (161, 172), (174, 255)) for b in range(a, z + 1)}
    hidden = [b for b in range(256) if b not in shown]
    sign = {b: chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)}
    return {c: "".join(sign[b] for b in chr(c).encode()) for c in range(128, 256)}


_BYTE_LEVEL = _byte_level()


class WordIds(WordCache):
    """word -> its ids as little-endian 32-bit numbers."""

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        super().__init__(lambda w: array("I", self.tokenizer.encode(w.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes(), limit=1_000_000)

    def learn(self, words: set[bytes]) -> None:
        """Encode those of the words that aren't known, many at a time."""
        new = [w for w in words if w not in self and len(w) <= self.longest]
        if len(self) + len(new) > self.limit:
            self.clear()
            new = [w for w in words if len(w) <= self.longest]
        odd = []
        tokenize = self.tokenizer.model.tokenize
        for w in new:
            text = w.decode("utf-8", "replace")
            if _LETTERS.fullmatch(text):  # one piece, in normal form: straight to the merges
                self[w] = array("I", [t.id for t in tokenize(text.lower().translate(_BYTE_LEVEL))]).tobytes()
            else:
                odd.append(w)
        for x in range(0, len(odd), 10_000):
            part = odd[x : x + 10_000]
            self.update(zip(part, (array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch([w.decode("utf-8", "replace") for w in part], add_special_tokens=False))))


@cache_per_worker
def word_ids(tokenizer_file: str) -> WordIds:
    """One cache for all tasks of a worker."""
    return WordIds(tokenizer_file)


_AFTER_WORD = re.compile(rb"(?<=[0-9a-z])([.,;:!?]+)(?=\s|\Z)")


def separated(text: bytes) -> bytes:
    """The text with equal ids and fewer distinct words: lower-cased, end marks apart from words.

    The tokenizer lower-cases and parts letters from marks itself; a text that may hold the name of
    a special token, which is matched before that, stays as it is.
    """
    return text if b"<|" in text else _AFTER_WORD.sub(rb" \1", text.lower())


def token_pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every document.

    The tokenizer splits at white space, so words are encoded once and looked up after that.
    """
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
    width = len(names) - (not keep_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_ids(tokenizer_file)
        end = array("I", [END_ID]).tobytes()
        for batch in batches:
            ids, bodies = batch["doc_id"].to_pylist(), batch["body"]
            for a in range(0, len(ids), 500):
                texts = [separated(b.as_py()).split() for b in bodies[a : a + 500]]
                cache.learn(set().union(*texts))
                rows = []
                for doc_id, words in zip(ids[a : a + 500], texts):
                    whole = b"".join(map(cache.__getitem__, words)) + end
                    for piece, at in enumerate(range(0, len(whole), 4 * capacity)):
                        own = whole[at : at + 4 * capacity]
                        rows.append((doc_id, piece, at // 4, len(own) // 4, zlib.crc32(own), own)[:width])
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(width)], names[:width])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes("text").alias("body")).mapInArrow(run, schema)


def best_configuration(lengths: list[int], most: list[int], values: list[float], capacity: int) -> dict[int, int]:
    """The multiset (place of a length -> how many, ``most`` at most) that fills the most space, and of those is worth most.

    A bounded-knapsack dynamic program: how often a length is used is split into powers of two.
    """
    worth, items, taken = np.full(capacity + 1, -np.inf), [], []
    worth[0] = 0.0
    for i, (length, n, value) in enumerate(zip(lengths, most, values)):
        n, power = min(n, capacity // length), 1
        while n > 0:
            k = min(power, n)
            with_it = worth[: capacity + 1 - k * length] + k * value
            rest = worth[k * length :]
            items.append((i, k))
            taken.append(with_it > rest + 1e-12)
            np.maximum(rest, with_it, out=rest)
            n, power = n - k, power * 2
    found: dict[int, int] = {}
    c = int(np.flatnonzero(worth > -np.inf)[-1])
    for (i, k), better in zip(reversed(items), reversed(taken)):
        if (at := c - k * lengths[i]) >= 0 and better[at]:
            found[i] = found.get(i, 0) + k
            c = at
    return found


def lower_bound(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs: by volume, and with pieces above half of a sequence each in its own."""
    best = -(-int(lengths @ counts) // capacity)
    for small in [0, *(int(x) for x in lengths if 2 * x <= capacity)]:
        whole = int(counts[lengths > capacity - small].sum())
        half = (lengths > capacity // 2) & (lengths <= capacity - small)
        middle = (lengths >= max(1, small)) & (2 * lengths <= capacity)
        room = int(counts[half].sum()) * capacity - int(lengths[half] @ counts[half])
        more = int(lengths[middle] @ counts[middle]) - room
        best = max(best, whole + int(counts[half].sum()) + max(0, -(-more // capacity)))
    return best


def configuration_program(lengths: np.ndarray, counts: np.ndarray, capacity: int, seed: int = 5, pool: int = POOL, rate: float = RATE) -> tuple[list[tuple[dict[int, int], int]], np.ndarray]:
    """Configurations (place of a length -> how many) with how often each is used, and the counts left.

    A length's weight shrinks with the share of its pieces that is packed. A pool of lengths is
    priced at a time: those of the greatest weights and a seeded choice of the others; if none of its
    configurations fills a sequence all open lengths are priced. A step is rounded to whole
    sequences as it is taken: until one of its lengths has too few pieces left. So every step uses
    up a length, and there are no more of them than lengths. The program ends once the best
    configuration leaves more space than the bound has to spare.
    """
    r = np.random.default_rng(seed)
    left, out = counts.astype(np.int64).copy(), []
    spare = lower_bound(lengths, counts, capacity) * capacity - int(lengths @ counts)
    share = lengths / capacity
    while len(open_ := np.flatnonzero(left)):
        weights = share * np.exp(rate * (left / counts))
        places = open_
        if len(open_) > pool:
            hard = open_[np.argpartition(-weights[open_], pool // 4)[: pool // 4]]
            places = np.unique(np.r_[hard, r.choice(open_, pool - len(hard), replace=False)])
        for chosen in (places, open_):
            own = [int(x) for x in lengths[chosen]]
            found = best_configuration(own, [int(x) for x in left[chosen]], weights[chosen].tolist(), capacity)
            waste = capacity - sum(own[i] * n for i, n in found.items())
            if not waste or len(chosen) == len(open_):
                break
        often = min(int(left[chosen[i]]) // n for i, n in found.items())
        if waste * often > spare:
            often = spare // waste
        if not often:
            break
        spare -= waste * often
        for i, n in found.items():
            left[chosen[i]] -= n * often
        out.append(({int(chosen[i]): n for i, n in found.items()}, often))
    return out, left


def best_fit(lengths: list[int], counts: list[int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit decreasing over counts: (length -> how many, how often)."""
    free: dict[int, list[tuple[dict[int, int], int]]] = {}

    def put(pattern: dict[int, int], often: int, room: int) -> None:
        free.setdefault(room, []).append((pattern, often))

    for length, n in sorted(zip(lengths, counts), reverse=True):
        while n:
            room = min((r for r in free if r >= length), default=None)
            pattern, often = free[room].pop() if room is not None else ({}, n)
            if room is not None and not free[room]:
                del free[room]
            space = capacity if room is None else room
            each = space // length
            full, rest = min(often, n // each), 0
            if full:
                put(pattern | {length: each}, full, space - each * length)
                n -= full * each
            if n and full < often:
                rest = min(n, each)
                put(pattern | {length: rest}, 1, space - rest * length)
                n -= rest
            if room is not None and (left := often - full - (rest > 0)):
                put(pattern, left, room)
    return [x for patterns in free.values() for x in patterns]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Configurations (length -> how many) and how often each is used; together they hold every piece.

    The program's, with best fit for what it leaves; never more sequences than by best fit alone.
    """
    full = histogram.get(capacity, 0)
    lengths = np.array(sorted(x for x in histogram if x < capacity), np.int64)
    counts = np.array([histogram[int(x)] for x in lengths], np.int64)
    head = [({capacity: 1}, full)] if full else []
    if not len(lengths):
        return head
    found, left = configuration_program(lengths, counts, capacity)
    out = [({int(lengths[i]): n for i, n in config.items()}, often) for config, often in found]
    out += best_fit([int(x) for x, n in zip(lengths, left) if n], [int(n) for n in left if n], capacity)
    size = lambda x: sum(often for _, often in x)
    if size(out) > lower_bound(lengths, counts, capacity):
        plain = best_fit(lengths.tolist(), counts.tolist(), capacity)
        out = plain if size(plain) < size(out) else out
    return head + out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...) with sequence_id and offset."""
    pieces = cut(pieces)
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    keys, first, each, base, place = [], [], [], [], []
    ids, ranks = 0, Counter()
    for config, often in plan(histogram, capacity):
        at = 0
        for length, n in sorted(config.items(), reverse=True):
            keys.append(length)
            first.append(ranks[length])
            each.append(n)
            base.append(ids)
            place.append(at)
            ranks[length] += n * often
            at += n * length
        ids += often
    slots = [np.array(x, np.int64) for x in (keys, first, each, base, place)]
    order = np.lexsort((slots[1], slots[0])) if keys else np.empty(0, np.int64)
    shared = pieces.sparkSession.sparkContext.broadcast([s[order] for s in slots])  # rounds * lengths in a configuration at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first, each, base, place = shared.value
        search = keys << 44 | first
        for b in batches:
            length, rank = b["length"].to_numpy(), b["_rank"].to_numpy()
            i = np.searchsorted(search, length << 44 | rank, side="right") - 1
            within = rank - first[i]
            columns = [c for c, n in zip(b.columns, b.schema.names) if n != "_rank"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(base[i] + within // each[i]), pa.array(place[i] + within % each[i] * length)], [*(n for n in b.schema.names if n != "_rank"), "sequence_id", "offset"])

    ranked = rank_in_group(pieces, ["length"], ["doc_id", "piece"], "_rank")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(run, f"{types}, sequence_id long, offset long")
