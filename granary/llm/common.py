"""What the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes other than these; ``bytes.split()`` splits at exactly them.
WHITE = r"\x20\x09-\x0D"
WORD_REGEX = rf"[^{WHITE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(column: str):
    """The UTF-8 bytes of a text column; null becomes empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def packed(body):
    """Bytes compressed, for joins that carry texts."""

    @F.pandas_udf("binary")
    def squeeze(bodies: pd.Series) -> pd.Series:
        return bodies.map(zstandard.ZstdCompressor(level=3).compress)

    return squeeze(body)


class WordCache(dict):
    """word -> make(word), forgotten when ``limit`` words are held, so memory is bounded."""

    def __init__(self, make: Callable, limit: int = 300_000, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest = make, limit, longest

    def __missing__(self, word):
        value = self.make(word)
        if len(word) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[word] = value
        return value


def by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """Groups of equal integer ``key`` from batches that are sorted by it; a group may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        if not len(keys):
            continue
        cuts = np.flatnonzero(np.diff(keys)) + 1
        for start, end in zip(np.r_[0, cuts], np.r_[cuts, len(keys)]):
            if held and keys[start] != last:
                yield last, _columns(held)
                held = []
            last = keys[start]
            held.append(batch.slice(start, end - start))
    if held:
        yield last, _columns(held)


def _columns(parts: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
    whole = pa.Table.from_batches(parts)
    return {name: whole.column(name).to_numpy() for name in whole.column_names}
