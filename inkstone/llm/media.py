"""Documents of interleaved texts and media.

An HTML document is parsed into an ordered array of structs: runs of text, and references to
media with the caption that belongs to each (alt text, or the figcaption of its figure).  A
reference names its payload by a digest; payloads are kept once per digest in a media store,
and a join on the digest resolves them.  Positions count all items of a document, so text,
media and captions stay aligned after the join, whatever order rows arrive in.

The store's format for payloads of samples is a greyscale PNG with 8 bits a sample, 192
samples a row; bytes are padded with spaces to whole rows, of which there is at least one.

Defined results: null or empty HTML or text is an empty document; a reference without a
digest or without a payload in the store keeps null in its payload columns; media stored
twice count once; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm import common
from inkstone.plans.staging import stage

WIDTH, PAD, TAIL = 192, b" ", 16
LEVEL = 1  # zlib; text shrinks to about half at little cost
PNG = b"\x89PNG\r\n\x1a\n"
SKIPPED = {"script", "style", "template", "noscript"}
BREAKS = {"p", "div", "article", "section", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "br", "table", "tr", "figure", "figcaption", "blockquote", "pre", "header", "footer", "nav", "main", "aside", "title"}
MEDIA = {"img", "audio", "video", "source", "embed"}
DIGEST = "sha256:"


def padded(payload: bytes) -> bytes:
    """payload with spaces up to a positive multiple of WIDTH."""
    return payload + PAD * (-len(payload) % WIDTH if payload else WIDTH)


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def encode_png(samples: bytes) -> bytes:
    """Samples, in rows of WIDTH, as a greyscale PNG without row filters."""
    rows = len(samples) // WIDTH
    raw = np.zeros((rows, WIDTH + 1), np.uint8)
    raw[:, 1:] = np.frombuffer(samples, np.uint8).reshape(rows, WIDTH)
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes(), LEVEL)) + chunk(b"IEND", b"")


def decode_png(media: bytes) -> bytes:
    """The samples of a PNG that encode_png wrote; checks signature and checksums."""
    if media[:8] != PNG:
        raise ValueError("not a PNG")
    at, parts, shape = 8, [], (0, 0)
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if zlib.crc32(body, zlib.crc32(kind)) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError("damaged PNG chunk")
        if kind == b"IHDR":
            shape = struct.unpack_from(">II", body)
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(shape[1], shape[0] + 1)
    return raw[:, 1:].tobytes()


def features(samples: bytes) -> str:
    """Size, mean, deviation and 8-bin histogram of the samples."""
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256)
    values = np.arange(256)
    mean = float((counts * values).sum() / len(x))
    deviation = float(np.sqrt((counts * np.square(values - mean)).sum() / len(x)))
    bins = counts.reshape(8, 32).sum(axis=1)
    return f"{WIDTH}x{len(x) // WIDTH};mean={mean:.6f};std={deviation:.6f};hist=" + ",".join(map(str, bins.tolist()))


class Sequence(HTMLParser):
    """Turns HTML into items (kind, text, digest): text runs and media in reading order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self.run: list[str] = []
        self.skip = 0
        self.figure: list[int] | None = None
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.run).split())
        self.run = []
        if text:
            self.items.append(["text", text, None])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SKIPPED:
            self.skip += 1
        elif self.skip:
            pass
        elif tag in MEDIA:
            self.flush()
            named = dict(attrs)
            source = named.get("src") or ""
            if self.figure is not None:
                self.figure.append(len(self.items))
            self.items.append(["media", named.get("alt") or None, source[len(DIGEST) :] if source.startswith(DIGEST) else None])
        elif tag in BREAKS:
            self.flush()
            if tag == "figure":
                self.figure = []
            elif tag == "figcaption" and self.figure is not None:
                self.caption = []

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split()) or None
            for i in self.figure or ():
                self.items[i][1] = text or self.items[i][1]
            self.caption = None
        elif tag in BREAKS:
            self.flush()
            if tag == "figure":
                self.figure = None

    def handle_data(self, data: str) -> None:
        if not self.skip:
            (self.run if self.caption is None else self.caption).append(data)


def parse(html: str | None) -> list[dict]:
    parser = Sequence()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return [{"position": i, "kind": kind, "text": text if kind == "text" else None, "caption": text if kind == "media" else None, "digest": digest} for i, (kind, text, digest) in enumerate(parser.items)]


ITEM = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("caption", pa.string()), ("digest", pa.string())])
ITEMS_DDL = "array<struct<position: int, kind: string, text: string, caption: string, digest: string>>"


def sequences(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(doc_id, items): the interleaved sequence of each document."""
    common.small_batches(pages.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("items", pa.list_(ITEM))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [parse(b.decode("utf-8", "replace")) for b in common.as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(items, schema.field("items").type)], schema=schema)

    return pages.select(F.col(id_col).cast("long").alias("doc_id"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, f"doc_id long, items {ITEMS_DDL}")


def resolve(sequence: DataFrame, media: DataFrame) -> DataFrame:
    """(doc_id, items) with each reference's payload columns, by a join on the digest.

    media has digest and further columns, one row per digest.  References move without their
    texts; a digest that very many documents name is hot on their side only, so Spark splits it.
    """
    extra = [c for c in media.columns if c != "digest"]
    refs = sequence.select("doc_id", F.explode("items").alias("i")).filter("i.kind = 'media'").select("doc_id", F.col("i.position").alias("position"), F.col("i.caption").alias("caption"), F.col("i.digest").alias("digest"))
    return refs.join(media, "digest", "left").select("doc_id", "position", "caption", "digest", *extra)


STORED_DDL = "digest string, n_bytes long, media binary"


def store(payloads: DataFrame, payload_col: str, name: str = "media") -> DataFrame:
    """Write payloads to a media table in the shared folder: (digest, n_bytes, media).

    A task stores a payload once, however many rows have it; several tasks may store the same.
    """
    schema = pa.schema([("digest", pa.string()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stored: set[bytes] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                rows = []
                for payload in common.as_bytes(batch.column(0).slice(at, 200)):
                    digest = hashlib.sha256(payload)
                    if digest.digest() not in stored:
                        stored.add(digest.digest())
                        rows.append((digest.hexdigest(), len(payload), encode_png(padded(payload))))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return stage(payloads.select(payload_col).mapInArrow(run, STORED_DDL), name)


FEATURES_DDL = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def described(media: DataFrame) -> DataFrame:
    """What the stored bytes hold once read back, one row per digest."""
    schema = pa.schema([("digest", pa.string()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, n, stored in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                samples = decode_png(stored)
                if hashlib.sha256(samples[:n]).hexdigest() != digest:
                    raise ValueError(f"stored media don't hold the payload {digest}")
                rows.append((digest, n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-TAIL:]), len(stored), hashlib.sha256(stored).hexdigest(), features(samples)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return media.mapInArrow(run, FEATURES_DDL).dropDuplicates(["digest"])


def escaped(text: Column) -> Column:
    """Text as it stands in HTML."""
    return F.replace(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text is the payload of a figure between the source and the language of its document,
    in HTML that refers to it by digest."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    figure = F.concat(F.lit('<figure><img src="sha256:'), F.sha2(F.encode("text", "UTF-8"), 256), F.lit('"><figcaption>text of document '), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("</figcaption></figure>"))
    html = F.concat(F.lit("<article><h1>"), escaped(F.col("source")), F.lit("</h1>"), figure, F.lit("<p>"), escaped(F.col("lang")), F.lit("</p></article>"))
    sequence = sequences(docs.select("doc_id", html.alias("html")), "doc_id", "html")
    out = resolve(sequence, described(store(docs, "text")))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")


QUERIES = {"op2_media_columns": op2_media_columns}
SQL: dict[str, str] = {}
