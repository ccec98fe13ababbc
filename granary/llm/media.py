"""Interleaved document sequences with media columns.

Html is parsed into ordered structs of text and media references (``<img src="sha256:...">``
with its caption); references are joined to a media store by digest, positions and captions stay
aligned. Payloads are stored losslessly as 8-bit grey images (binary PGM, 24 samples a line) in a
table of the shared folder; what the store tells of a medium is computed from the bytes read back.

Defined cases: null or empty html gives an empty sequence; a reference whose digest the store
lacks keeps its place with null media columns; a null text is an empty payload, padded to 576
bytes; equal payloads are one medium of the store, however often it is referred to (a digest that
very many references share is joined over salts); markup in a document's text or names is text.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.plans.cluster import join_references, shared_folder

UNIT, WIDTH, PAD = 576, 24, b"\xff"
SCHEMA = "array<struct<position: int, kind: string, text: string, digest: string, caption: string>>"
_PIECE = re.compile(r"<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<(img|video|audio|source)\b([^>]*)>|<figcaption[^>]*>(.*?)</figcaption\s*>|<(/?)(p|div|figure|h[1-6]|li|article|section|br)\b[^>]*>|<[/!a-zA-Z][^>]*>", re.S | re.I)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")


def sequence(page: str | None) -> list[dict]:
    """Ordered text and media structs; a figure's caption belongs to the medium before it, else its alt text."""
    out: list[dict] = []
    text: list[str] = []

    def flush() -> None:
        joined = " ".join(entities.unescape("".join(text)).split())
        text.clear()
        if joined:
            out.append({"kind": "text", "text": joined, "digest": None, "caption": None})

    at, page = 0, page or ""
    for m in _PIECE.finditer(page):
        text.append(page[at : m.start()])
        at = m.end()
        if m[2]:
            flush()
            attrs = {a[1].lower(): entities.unescape(a[2] or a[3] or a[4] or "") for a in _ATTR.finditer(m[3])}
            src = attrs.get("src", "")
            out.append({"kind": m[2].lower(), "text": None, "digest": src.removeprefix("sha256:") if src.startswith("sha256:") else None, "caption": attrs.get("alt") or None})
        elif m[4] is not None:
            flush()
            if out and out[-1]["kind"] != "text":
                out[-1]["caption"] = " ".join(entities.unescape(re.sub(r"<[^>]*>", "", m[4])).split()) or out[-1]["caption"]
        elif m[6]:
            flush()
    text.append(page[at:])
    flush()
    return [{"position": i} | x for i, x in enumerate(out)]


def interleaved(docs: DataFrame, html: str = "html") -> DataFrame:
    """``docs`` with ``segments``: the ordered structs of its html column."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([sequence(x) for x in b[html].to_pylist()], kind)], [*b.schema.names, "segments"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(parse, f"{types}, segments {SCHEMA}")


def resolve(sequences: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """A row per segment, in order of position, with the media columns of its digest.

    The join is by digest; the store has one row a digest, so positions and captions stay as they
    are. ``sequences`` is read twice: cut it if it is dear.
    """
    parts = sequences.select(key, F.explode("segments").alias("s")).select(key, "s.*")
    return join_references(parts, store, "digest", [key, "position"])


def escaped(text: Column) -> Column:
    """The text as html; null becomes empty."""
    out = F.coalesce(text, F.lit(""))
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def page_of(text: Column, digest: Column, alt: Column, caption: Column) -> Column:
    """An article of a paragraph for each line of the text, and a figure at its end."""
    body = F.concat(F.lit("<p>"), F.replace(escaped(text), F.lit("\n"), F.lit("</p><p>")), F.lit("</p>"))
    figure = F.concat(F.lit('<figure><img src="sha256:'), digest, F.lit('" alt="'), escaped(alt), F.lit('"><figcaption>'), escaped(caption), F.lit("</figcaption></figure>"))
    return F.concat(F.lit("<article>"), body, figure, F.lit("</article>"))


def payload(text: Column) -> Column:
    """UTF-8 bytes padded with 255 to a positive multiple of 576."""
    raw = F.coalesce(text.cast("binary"), F.lit(b""))
    n = F.octet_length(raw)
    missing = F.when(n == 0, F.lit(UNIT)).otherwise(F.pmod(F.lit(UNIT) - F.pmod(n, F.lit(UNIT)), F.lit(UNIT)))
    return F.concat(raw, F.unhex(F.repeat(F.lit("FF"), missing)))


def store_image(samples: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (WIDTH, len(samples) // WIDTH) + samples


def read_image(stored: bytes) -> tuple[np.ndarray, bytes]:
    """Samples of a stored image, as lines and as bytes."""
    magic, shape, depth, samples = stored.split(b"\n", 3)
    width, height = map(int, shape.split())
    if magic != b"P5" or depth != b"255" or len(samples) != width * height:
        raise ValueError("not a stored image")
    return np.frombuffer(samples, np.uint8).reshape(height, width), samples


def describe(image: np.ndarray) -> str:
    """Size, mean, deviation, entropy and mean horizontal and vertical step of the samples."""
    counts = np.bincount(image.ravel(), minlength=256)
    share = counts[counts > 0] / image.size
    mean = float(counts @ np.arange(256)) / image.size
    spread = float(counts @ (np.arange(256) - mean) ** 2 / image.size) ** 0.5
    steps = [float(np.abs(np.diff(image.astype(np.int16), axis=a)).mean()) if image.shape[a] > 1 else 0.0 for a in (1, 0)]
    return f"{image.shape[1]}x{image.shape[0]} mean={mean:.4f} std={spread:.4f} entropy={-(share * np.log2(share)).sum():.4f} dx={steps[0]:.4f} dy={steps[1]:.4f}"


STORE = "digest string, media binary"


def write_store(payloads: DataFrame, folder: str | None = None) -> str:
    """Write ``payloads`` (payload binary) as images to a table; returns its folder.

    A task writes equal payloads of a batch once; those of other tasks repeat the digest.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[str, bytes] = {}
            for raw in b["payload"]:
                raw = raw.as_py()
                if (digest := hashlib.sha256(raw).hexdigest()) not in found:
                    found[digest] = store_image(raw)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.binary())], ["digest", "media"])

    folder = folder or f"{shared_folder(payloads.sparkSession)}/media-{uuid.uuid4().hex}"
    payloads.select("payload").mapInArrow(encode, STORE).write.option("compression", "zstd").parquet(folder)
    return folder


def media_store(payloads: DataFrame, keep_bytes: bool = True, folder: str | None = None) -> DataFrame:
    """``payloads`` (payload binary) -> one row per distinct payload, read back from its stored form.

    digest, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature and,
    with ``keep_bytes``, media (the stored bytes). Decoding raises if stored bytes don't give back
    the payload of their digest.
    """
    names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for digest, media in zip(b["digest"].to_pylist(), b["media"]):
                media = media.as_py()
                image, back = read_image(media)
                if (sha := hashlib.sha256(back).hexdigest()) != digest:
                    raise ValueError(f"stored medium {digest} is damaged")
                rows.append((digest, len(back), sha, zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), describe(image), media if keep_bytes else None))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    stored = payloads.sparkSession.read.schema(STORE).parquet(write_store(payloads, folder))
    rows = stored.mapInArrow(decode, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media binary")
    rows = rows if keep_bytes else rows.drop("media")
    return rows.groupBy("digest").agg(*[F.first(n).alias(n) for n in rows.columns[1:]])
