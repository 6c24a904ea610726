"""Media columns: interleaved document sequences.

Payloads are stored as binary PGM images (8-bit samples, 24 to a row). A page of HTML names its
media by digest; parsing it yields an ordered array of text and media structs. A join on digests
resolves each reference, once for each distinct payload, and position and caption stay with it.
"""

from __future__ import annotations

import hashlib
import html
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .store import saved

WIDTH, UNIT = 24, 576
SEQUENCE = "array<struct<pos:int,kind:string,text:string,digest:string,caption:string>>"
_ITEM = pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())])


def to_image(raw: bytes) -> bytes:
    """A PGM file of raw, padded with bytes 255 to a positive multiple of UNIT; a comment tells the unpadded length."""
    padded = raw + b"\xff" * (-len(raw) % UNIT if raw else UNIT)
    return b"P5\n# bytes %d\n%d %d\n255\n" % (len(raw), WIDTH, len(padded) // WIDTH) + padded


def from_image(stored: bytes) -> tuple[int, np.ndarray]:
    """(unpadded length, samples as rows) of a PGM file that to_image made."""
    magic, comment, shape, depth, samples = stored.split(b"\n", 4)
    width, height = map(int, shape.split())
    if magic != b"P5" or depth != b"255" or len(samples) != width * height:
        raise ValueError("not a whole 8-bit PGM file")
    return int(comment.split()[2]), np.frombuffer(samples, np.uint8).reshape(height, width)


def feature(image: np.ndarray) -> str:
    """Mean, deviation, mean steps along and across rows, and the fullest of 16 brightness bins."""
    x = image.astype(np.int32)
    along, across = np.abs(np.diff(x, axis=1)).mean(), np.abs(np.diff(x, axis=0)).mean()
    return f"{image.shape[1]}x{image.shape[0]};mean={x.mean():.4f};dev={x.std():.4f};along={along:.4f};across={across:.4f};bin={int(np.bincount(image.ravel() >> 4, minlength=16).argmax())}"


class _Sequence(HTMLParser):
    """Text between block borders and media in page order; a figcaption belongs to the first media of its own figure, wherever in it they stand."""

    BLOCKS = frozenset("p div article section figure figcaption h1 h2 h3 h4 h5 h6 ul ol li table tr td blockquote pre body".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.held: list[str] = []
        self.caption = self.hidden = 0
        self.figures: list[dict] = []  # open figures: place of the first media, caption

    def flush(self) -> None:
        text = " ".join("".join(self.held).split())
        self.held = []
        if not text:
            return
        if self.caption and self.figures:
            own = self.figures[-1]
            own["caption"] = " ".join(filter(None, (own["caption"], text)))
            return
        self.items.append({"pos": len(self.items), "kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.BLOCKS:
            self.flush()
        if tag in ("script", "style"):
            self.hidden = 1
        if tag == "figure":
            self.figures.append({"media": None, "caption": None})
        if tag == "figcaption":
            self.caption = 1
        if tag in ("img", "audio", "video", "source"):
            self.flush()
            a = dict(attrs)
            src = a.get("src") or ""
            if self.figures and self.figures[-1]["media"] is None:
                self.figures[-1]["media"] = len(self.items)
            self.items.append({"pos": len(self.items), "kind": "media", "text": None, "digest": src.removeprefix("sha256:") if src.startswith("sha256:") else None, "caption": a.get("alt") or None})

    def handle_endtag(self, tag: str) -> None:
        if tag in self.BLOCKS:
            self.flush()
        if tag in ("script", "style"):
            self.hidden = 0
        if tag == "figcaption":
            self.caption = 0
        if tag == "figure" and self.figures:
            self.end_figure()

    def end_figure(self) -> None:
        """Give the figure's caption to its media; a caption without media is text of the page."""
        own = self.figures.pop()
        if own["caption"] and own["media"] is not None:
            self.items[own["media"]]["caption"] = own["caption"]
        elif own["caption"]:
            self.items.append({"pos": len(self.items), "kind": "text", "text": own["caption"], "digest": None, "caption": None})

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.held.append(data)


def sequence_of(page: str | None) -> list[dict]:
    p = _Sequence()
    p.feed(page or "")
    p.close()
    p.flush()
    while p.figures:
        p.end_figure()
    return p.items


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([sequence_of(t.as_py()) for t in batch.column("html")], pa.list_(_ITEM))], ["id", "sequence"])


def sequences(pages: DataFrame) -> DataFrame:
    """id, sequence of pages(id, html): array of (pos, kind, text, digest, caption) in page order.

    kind is text or media; media without a sha256: source have a null digest. A null or empty
    page has an empty sequence; repeated rows get a row each; other columns are ignored.
    """
    return pages.select(F.col("id").cast("bigint").alias("id"), F.col("html").cast("string").alias("html")).mapInArrow(_parse, f"id bigint, sequence {SEQUENCE}")


def resolve(told: DataFrame, media: DataFrame) -> DataFrame:
    """id, pos, caption, n_items and media's columns for each media item of told(id, sequence).

    media has one row a digest. Items without a digest, or whose digest media lacks, keep their
    row with nulls.
    """
    items = told.select("id", F.size("sequence").alias("n_items"), F.inline(F.filter("sequence", lambda x: x["kind"] == "media")))
    return items.select("id", "n_items", "pos", "caption", "digest").join(media, "digest", "left")


def _page(text: str, digest: str) -> str:
    lines = [x for x in text.split("\n") if x.strip()]
    figure = f'<figure><img src="sha256:{digest}" alt=""><figcaption>{html.escape(lines[0].strip() if lines else "empty")}</figcaption></figure>'
    paragraphs = [f"<p>{html.escape(x)}</p>" for x in lines]
    return "<article>" + "".join(paragraphs[:1]) + figure + "".join(paragraphs[1:]) + "</article>"


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Images of the texts, each but once in a task as far as it remembers."""
    seen: set[str] = set()
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            made = {hashlib.sha256(x).hexdigest(): x for x in (to_image((t.as_py() or "").encode()) for t in batch.column("text").slice(lo, 500))}
            digests = [x for x in made if x not in seen]
            images = [made[x] for x in digests]
            seen = (seen if len(seen) < 500_000 else set()) | set(digests)
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(images, pa.binary())], ["digest", "media"])


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            texts = [t.as_py() or "" for t in batch.column("text").slice(lo, 500)]
            pages = [_page(t, hashlib.sha256(to_image(t.encode())).hexdigest()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, 500), pa.array(pages, pa.string())], ["id", "html"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["digest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        rows = []
        for digest, stored in zip(batch.column("digest"), batch.column("media"), strict=True):
            stored = stored.as_py()
            n, image = from_image(stored)
            payload = image.tobytes()
            rows.append((digest.as_py(), n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(image)))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


def stored_media(docs: DataFrame) -> DataFrame:
    """digest, media of each text of docs(text), written to the shared folder; null texts are empty, a text of any length is one image. Equal texts of a task are stored once; an empty table stores nothing."""
    return saved(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_store, "digest string, media binary"), "media")


def described(media: DataFrame) -> DataFrame:
    """One row of lengths, checksums and features for each distinct digest, from the stored bytes as read back."""
    told = media.mapInArrow(_read, "digest string, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
    return saved(told.groupBy("digest").agg(*(F.min(c).alias(c) for c in told.columns[1:])), "described")  # equal digests have equal rows; a table, so that a hot digest's rows can be split in joins


def op3_interleaved_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pages = docs.mapInArrow(_compose, "id bigint, html string")
    out = resolve(sequences(pages), described(stored_media(docs)))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "caption", "n_items")
