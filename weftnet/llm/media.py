"""Media columns: interleaved document sequences and a store of lossless payloads.

HTML parses into an ordered array of structs: text runs and media references, each with its position;
a reference carries the digest of its payload, its alternative text and its caption, so captions stay
beside what they describe. Payloads lie in a store as 8-bit samples (binary PGM, 64 samples a row); what
is read back from the store joins the references by digest.

Null and empty HTML or texts: an empty sequence, and a payload of 64 zero bytes. References whose digest
the store lacks keep null features. Null ids, repeated rows and extra columns are allowed; an empty table
gives no rows.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftnet.llm.common import arrow_map, as_bytes, persist, text_slices

ROW = 64
ITEM = T.StructType([T.StructField("position", T.IntegerType())] + [T.StructField(n, T.StringType()) for n in ("kind", "text", "source", "digest", "alt", "caption")])
MEDIA_TAGS = {"img": "image", "audio": "audio", "video": "video", "source": "media", "embed": "media", "object": "media"}
BREAKS = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "table", "ul", "ol", "section", "article", "figure", "figcaption", "title", "td", "th", "blockquote", "pre", "hr"}
HIDDEN = {"script", "style", "noscript", "template"}
DIGEST = "sha256:"


def payload_of(source: str) -> bytes | None:
    """The payload that a data: URI holds."""
    if not source.startswith("data:") or "," not in source:
        return None
    head, body = source[5:].split(",", 1)
    try:
        return base64.b64decode(body, validate=False) if head.endswith(";base64") else unquote_to_bytes(body)
    except (binascii.Error, ValueError):
        return None


class _Sequence(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.run: list[str] = []
        self.hidden = 0
        self.figure: list[int] = []  # first item of each open figure
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.run).split())
        self.run = []
        if text:
            self.add(kind="text", text=text)

    def add(self, **item: str | None) -> None:
        self.items.append({"position": len(self.items)} | dict.fromkeys(ITEM.names[1:]) | item)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in HIDDEN:
            self.hidden += 1
        if tag in BREAKS or tag in MEDIA_TAGS:
            self.flush()
        if tag == "figure":
            self.figure.append(len(self.items))
        elif tag == "figcaption":
            self.caption = []
        elif tag in MEDIA_TAGS:
            at = dict(attrs)
            source = at.get("src") or at.get("data") or ""
            if source:
                payload = payload_of(source)
                digest = source[len(DIGEST) :] if source.startswith(DIGEST) else hashlib.sha256(source.encode() if payload is None else payload).hexdigest()
                self.add(kind=MEDIA_TAGS[tag], source=source if payload is None else "data:", digest=digest, alt=at.get("alt"))

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN and self.hidden:
            self.hidden -= 1
        if tag == "figcaption" and self.caption is not None:
            text, self.caption = " ".join("".join(self.caption).split()), None
            for item in self.items[self.figure[-1] if self.figure else len(self.items) - 1 :]:
                if item["kind"] != "text":
                    item["caption"] = text
        elif tag in BREAKS:
            self.flush()
        if tag == "figure" and self.figure:
            self.figure.pop()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.run if self.caption is None else self.caption).append(data)


def parse(html: str | None) -> list[dict]:
    """The ordered text and media-reference structs of a page."""
    p = _Sequence()
    p.feed(html or "")
    p.close()
    p.flush()
    return p.items


def sequences(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, items) of each page."""
    schema = T.StructType([T.StructField(key, T.LongType()), T.StructField("items", T.ArrayType(ITEM))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch, texts in text_slices(batches):
            yield {key: batch.column(key), "items": [parse(x.decode("utf-8", "replace")) for x in texts]}

    return arrow_map(as_bytes(pages.select(F.col(key).cast("long").alias(key), F.col(html).alias("text")), key), run, schema)


# ---------------------------------------------------------------- the store
def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % ROW or (0 if data else ROW))


def to_media(payload: bytes) -> bytes:
    """8-bit grey samples as binary PGM."""
    return b"P5\n%d %d\n255\n" % (ROW, len(payload) // ROW) + payload


def from_media(media: bytes) -> np.ndarray:
    """The samples (rows x 64) of binary PGM."""
    kind, shape, most, samples = media.split(b"\n", 3)
    width, height = map(int, shape.split())
    if kind != b"P5" or most != b"255" or len(samples) != width * height:
        raise ValueError("not an 8-bit PGM")
    return np.frombuffer(samples, np.uint8).reshape(height, width)


STORED = T.StructType([T.StructField("key", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("digest", T.StringType()), T.StructField("media", T.BinaryType())])
FEATURES = T.StructType(
    [T.StructField("digest", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType())]
    + [T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType())]
)


def store(docs: DataFrame, key: str = "doc_id", data: str = "text") -> DataFrame:
    """Write each row's payload in its stored form; returns the written (key, n_bytes, digest, media)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch, texts in text_slices(batches):
            payloads = [padded(x) for x in texts]
            yield {"key": batch.column("key"), "n_bytes": [len(x) for x in texts], "digest": [hashlib.sha256(x).hexdigest() for x in payloads], "media": [to_media(x) for x in payloads]}

    return persist(arrow_map(as_bytes(docs.select(F.col(key).cast("long").alias("key"), F.col(data).alias("text")), "key"), run, STORED))


def features(stored: DataFrame) -> DataFrame:
    """What the stored bytes hold, one row per digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            rows: dict[str, list] = {f.name: [] for f in FEATURES}
            for digest, media in zip(batch.column("digest").to_pylist(), batch.column("media"), strict=True):
                media = media.as_py()
                samples = from_media(media)
                payload = samples.tobytes()
                count = np.bincount(samples.ravel(), minlength=256)
                share = count[count > 0] / samples.size
                mean = float(count @ np.arange(256)) / samples.size
                spread = float(count @ (np.arange(256) - mean) ** 2) / samples.size
                feature = f"{samples.shape[0]}x{samples.shape[1]};mean={mean:.4f};std={spread**0.5:.4f};entropy={float(-(share * np.log2(share)).sum()):.4f};peak={int(count.argmax())}"
                row = (digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), feature)
                for name, x in zip(rows, row, strict=True):
                    rows[name].append(x)
            yield rows

    found = arrow_map(stored.select("digest", "media"), run, FEATURES)
    return persist(found.groupBy("digest").agg(*(F.max(n).alias(n) for n in FEATURES.names[1:])))


def resolve(pages: DataFrame, found: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per media reference, in place: (key, position, kind, alt, caption, digest, features)."""
    refs = pages.select(key, F.explode("items").alias("item")).where("item.kind <> 'text'").select(key, "item.position", "item.kind", "item.alt", "item.caption", "item.digest")
    return refs.join(found, "digest", "left")


def document_pages(stored: DataFrame) -> DataFrame:
    """(key, html): each stored document as a page that refers to its payload by digest."""
    head = F.concat(F.lit("<p>"), F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit('</p><figure><img src="sha256:'), "digest")
    return stored.select("key", F.concat(head, F.lit('"><figcaption>'), F.col("n_bytes").cast("string"), F.lit("</figcaption></figure>")).alias("html"))
