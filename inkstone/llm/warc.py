"""WARC archives with a two-level capture index.

Writing: pages become records of gzip members in archive files of the shared folder, one
file per task (a new one every MAX_ARCHIVE bytes).  Of equal payloads the smallest page id is
a response, the others are revisits that refer to it.  Who refers to whom is found on digests
alone, pre-aggregated, so a payload that a third of all pages share stays cheap.

Index: captures are range-sorted by a key that starts with the reversed host (org,example,)
and packed into compressed blocks of BLOCK_ENTRIES captures; of each block only its first
key, file, offset and length are kept, in a sparse directory.  A lookup finds the index file
by binary search over the files' first keys, the blocks by binary search over the directory of
that file, reads and unpacks these, finds the captures by binary search in each, and reads
their byte ranges.  Blocks are dealt to as many tasks as the bytes behind them ask for, so a
key with very many captures, which fills many blocks, is read by many tasks.

A file's name holds a random part, and only files that a committed task lists are used, so
lost and repeated task attempts leave nothing but unused files.

Defined results: null HTML is an empty payload; a null URL has an empty key; rows without an
id are responses unless a page with an id has the same payload; rows that repeat an id and
payload are archived each and are of the same type; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm import common
from inkstone.plans.staging import new_path, stage

BLOCK_ENTRIES = 1000
MAX_ARCHIVE = 1 << 30
MIN_REVISIT = 0  # payloads of fewer bytes are always responses
LEVEL = 4
READ_BYTES = 64 << 20  # compressed bytes of records that a task reads
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def surt(url: str | None) -> str:
    """Sort key of a URL: reversed host, then path and query; no scheme, user, default port or fragment."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return url
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return f"{key}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; a revisit keeps the response's HTTP head and drops its body."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="".join(map(chr, range(33, 127))))))
    fields.append(("WARC-Payload-Digest", "sha1:" + digest_of(payload)))
    if revisit:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    block = head if revisit else head + payload
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def number(urn: str | None) -> int | None:
    text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def parse(raw: bytes) -> dict:
    """A record's page, payload length and digest, type and reference; verifies what it can."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("record of the wrong length")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    length = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != length or digest_of(payload) != digest):
        raise ValueError("payload differs from its digest")
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": length, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number(fields.get("WARC-Refers-To")), "payload": payload if fields["WARC-Type"] == "response" else None}


def member(raw: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, wbits=31)
    return packer.compress(raw) + packer.flush()


class Writer:
    """Appends byte strings to files of a folder; tells where each went."""

    def __init__(self, folder: str, kind: str, most: int):
        self.fs, self.root = fs.FileSystem.from_uri(folder)
        self.folder, self.kind, self.most, self.out, self.at = folder, kind, most, None, 0

    def add(self, data: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at + len(data) > self.most > 0 and self.at:
            self.close()
            self.fs.create_dir(self.root, recursive=True)
            self.name = f"{uuid.uuid4().hex}.{self.kind}"
            self.out, self.at = self.fs.open_output_stream(f"{self.root}/{self.name}", compression=None), 0
        self.out.write(data)
        self.at += len(data)
        return self.name, self.at - len(data), len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


class Reader:
    """Byte ranges of the files of a folder; keeps a few files open."""

    def __init__(self, folder: str, most: int = 16):
        self.fs, self.root = fs.FileSystem.from_uri(folder)
        self.open, self.most = {}, most

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name not in self.open:
            if len(self.open) >= self.most:
                self.open.pop(next(iter(self.open))).close()
            self.open[name] = self.fs.open_input_file(f"{self.root}/{name}")
        return self.open[name].read_at(length, offset)


CAPTURES = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
CAPTURES_DDL = "key string, page_id long, file string, offset long, length long"
DIRECTORY = pa.schema([("first_key", pa.string()), ("index_file", pa.string()), ("block", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("entries", pa.int64()), ("bytes", pa.int64())])
DIRECTORY_DDL = "first_key string, index_file string, block long, offset long, length long, entries long, bytes long"


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write all pages; returns the captures (key, page_id, file, offset, length)."""
    common.small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.encode(F.col(html_col).cast("string"), "UTF-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    thin = stage(rows.select("page_id", "digest", F.length("payload").alias("n")).filter(F.col("n") >= min_revisit).select("page_id", "digest"), "digests")
    first = thin.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null")
    later = thin.join(first, "digest").filter("page_id is null or page_id <> first").select(F.col("page_id").alias("id2"), F.col("digest").alias("digest2"), F.col("first").alias("refers_to")).distinct()
    marked = rows.join(later, F.col("page_id").eqNullSafe(F.col("id2")) & (F.col("digest") == F.col("digest2")), "left").select("page_id", "url", "payload", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, written = Writer(folder, "warc.gz", MAX_ARCHIVE), []
        for batch in batches:
            for page, url, payload, refers in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                written.append((surt(url), page, *out.add(member(record(page, url, payload, refers)))))
        out.close()  # before its captures are reported
        yield from common.batches_of(CAPTURES, dict(zip(CAPTURES.names, map(list, zip(*written, strict=True)), strict=True)) if written else dict.fromkeys(CAPTURES.names, []))

    return stage(marked.mapInArrow(write, CAPTURES_DDL), "captures")


def build_index(captures: DataFrame, folder: str, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """Sort captures into compressed blocks; returns the sparse directory."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, lines, rows = Writer(folder, "cdx", 0), [], []

        def end() -> None:
            body = zlib.compress("".join(line for _, line, _ in lines).encode("utf-8", "surrogatepass"), LEVEL)
            name, offset, length = out.add(body)
            rows.append((lines[0][0], name, len(rows), offset, length, len(lines), sum(n for _, _, n in lines)))
            lines.clear()

        for batch in batches:
            for key, page, file, offset, length in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                lines.append((key, f"{quote(key, safe=SAFE)}\t{'' if page is None else page}\t{file}\t{offset}\t{length}\n", length))
                if len(lines) == block_entries:
                    end()
        if lines:
            end()
        out.close()
        yield from common.batches_of(DIRECTORY, dict(zip(DIRECTORY.names, map(list, zip(*rows, strict=True)), strict=True)) if rows else dict.fromkeys(DIRECTORY.names, []))

    ordered = captures.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    return stage(ordered.mapInArrow(pack, DIRECTORY_DDL), "directory")


#: Left as they are in index lines; tabs, line ends and % are quoted, which keeps lines apart.
SAFE = "".join(chr(c) for c in range(32, 127) if chr(c) != "%")


def block_entries_of(raw: bytes) -> list[tuple[str, str, int, int]]:
    """(key, file, offset, length) of a block, in order of keys."""
    out = []
    for line in zlib.decompress(raw).decode().splitlines():
        key, _, file, offset, length = line.split("\t")
        out.append((unquote(key), file, int(offset), int(length)))
    return out


RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
RECORDS_DDL = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def as_batches(records: list[dict], payloads: bool) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(records), 500):
        part = records[at : at + 500]
        for r in part:
            r["payload"] = r["payload"] if payloads else None
        yield pa.RecordBatch.from_pylist(part, schema=RECORDS)


def dealt(blocks: DataFrame) -> DataFrame:
    """Rows of blocks (index_file, block, offset, length, bytes), those of one block together, in
    as many partitions as the records' bytes ask for; Spark would count the small rows."""
    spark = blocks.sparkSession
    size = blocks.select("index_file", "block", "bytes").distinct().agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    tasks = max(1, min(size.n, max(spark.sparkContext.defaultParallelism, -(-size.bytes // READ_BYTES))))
    return blocks.repartition(tasks, "index_file", "block").sortWithinPartitions("index_file", "block")


def records_of(entries: Iterator[tuple[str, int, int]], reader: Reader, payloads: bool) -> Iterator[pa.RecordBatch]:
    """The records of byte ranges of archives, in the order in which they lie there."""
    records, size = [], 0
    for file, at, n in sorted(entries):
        records.append(parse(zlib.decompress(reader.read(file, at, n), wbits=31)))
        size += records[-1]["payload_bytes"]
        if len(records) == 500 or size > common.BATCH_MB << 20:
            yield from as_batches(records, payloads)
            records, size = [], 0
    yield from as_batches(records, payloads)


def read_all(directory: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """Every record, read by range from its archive through the index's blocks."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(folder)
        for batch in batches:
            for name, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                yield from records_of((e[1:] for e in block_entries_of(reader.read(name, offset, length))), reader, payloads)

    blocks = stage(directory.select("index_file", "offset", "length", "block", "bytes"), "blocks")
    return dealt(blocks).select("index_file", "offset", "length").mapInArrow(read, RECORDS_DDL)


def lookup(urls: DataFrame, directory: DataFrame, folder: str, url_col: str = "url", chunk: int = 10_000, payloads: bool = False) -> DataFrame:
    """Records of the given URLs: binary search for index file, blocks and key, then range reads.

    The first keys of the index files (one per task that sorted, so few) go to all tasks; a
    file's directory and a chunk of the URLs that fall into it meet in one task, which names
    the blocks that may hold them; the blocks are then read where they are dealt to.  URLs of
    one key are one, and every capture of a key is returned once.
    """
    spark = directory.sparkSession
    heads = sorted((r.first, r.index_file) for r in directory.groupBy("index_file").agg(F.min("first_key").alias("first")).collect())
    firsts = [h[0] for h in heads]
    names = [h[1] for h in heads]
    wanted_schema = pa.schema([("key", pa.string()), ("index_file", pa.string())])
    if not heads:
        return spark.createDataFrame([], RECORDS_DDL)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url in batch.column(0).to_pylist():
                key = surt(url)
                # equal keys may start in the file before the first that begins with the key
                for i in range(max(0, bisect_left(firsts, key) - 1), bisect_right(firsts, key)):
                    rows.append({"key": key, "index_file": names[i]})
            yield pa.RecordBatch.from_pylist(rows, schema=wanted_schema)

    wanted = urls.select(F.col(url_col).cast("string")).mapInArrow(route, "key string, index_file string").distinct()
    wanted = stage(wanted, "wanted")
    sizes = stage(wanted.groupBy("index_file").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks")), "wanted_sizes")
    keys = wanted.join(sizes, "index_file").withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int")).select("key", "index_file", "chunk")
    blocks = directory.join(sizes, "index_file").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")

    def search(keys: pa.Table, part: pa.Table) -> pa.Table:
        part = part.sort_by([("first_key", "ascending"), ("block", "ascending")])
        starts, found, rows = part["first_key"].to_pylist(), [], []
        for key in keys["key"].to_pylist() if starts else []:
            for b in range(max(0, bisect_left(starts, key) - 1), bisect_right(starts, key)):
                found.append(key)
                rows.append(b)
        part = part.take(pa.array(rows, pa.int64()))
        return pa.table({"key": pa.array(found, pa.string()), **{c: part[c] for c in ("index_file", "block", "offset", "length", "bytes")}})

    on = ("index_file", "chunk")
    places = keys.groupBy(*on).cogroup(blocks.groupBy(*on)).applyInArrow(lambda a, b: search(a, b), "key string, index_file string, block long, offset long, length long, bytes long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, block, entries, hits = Reader(folder), None, [], []
        for batch in batches:
            for key, *place in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if place != block:  # keys of one block follow each other
                    yield from records_of(hits, reader, payloads)
                    block, entries, hits = place, block_entries_of(reader.read(*place)), []
                lo = bisect_left(entries, (key,))
                while lo < len(entries) and entries[lo][0] == key:
                    hits.append(entries[lo][1:])
                    lo += 1
        yield from records_of(hits, reader, payloads)

    return dealt(stage(places, "places")).select("key", "index_file", "offset", "length").mapInArrow(read, RECORDS_DDL)


def op6_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    pages = common.table(spark, sf_dir, "pages")
    directory = build_index(write_archives(pages, folder), folder)
    # each page is looked up by its address, so every record comes through directory and blocks
    return lookup(pages.select("url"), directory, folder).drop("payload", "url")


QUERIES = {"op6_warc_index": op6_warc_index}
SQL: dict[str, str] = {}
