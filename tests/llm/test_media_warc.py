"""Media columns and archives: exact round trips."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkstone.llm import media, warc
from inkstone.plans.staging import new_path


@given(st.binary(max_size=1000))
@settings(max_examples=60, deadline=None)
def test_png_round_trip(payload):
    samples = media.padded(payload)
    assert len(samples) % 192 == 0 and len(samples) >= 192 and samples[: len(payload)] == payload
    assert media.decode_png(media.encode_png(samples)) == samples


def test_png_damage_is_seen():
    stored = bytearray(media.encode_png(media.padded(b"abc")))
    stored[-20] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.decode_png(bytes(stored))


def test_parse_keeps_order_and_captions():
    html = '<h1>T</h1><p>one <b>two</b></p><img src="sha256:aa" alt="first"><p>three<script>no</script></p><figure><img src="sha256:bb"><figcaption>second cap</figcaption></figure>tail<img src="x.png">'
    got = [(i["position"], i["kind"], i["text"] or i["caption"], i["digest"]) for i in media.parse(html)]
    assert got == [(0, "text", "T", None), (1, "text", "one two", None), (2, "media", "first", "aa"), (3, "text", "three", None), (4, "media", "second cap", "bb"), (5, "text", "tail", None), (6, "media", None, None)]
    assert media.parse(None) == media.parse("") == []


def test_interleaved_documents(spark):
    payloads = ["alpha", "beta", "", "alpha", None, "x" * 40000]
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    stored = media.described(media.store(spark.createDataFrame([(p, 1) for p in payloads], "text string, digest int"), "text"))
    assert stored.count() == 4
    pages = [(1, f'a<img src="sha256:{digest("beta")}" alt="B">b<img src="sha256:{digest("alpha")}">', 0), (2, None, 0), (3, '<img src="sha256:00">', 0), (1, "plain", 0)]
    out = media.resolve(media.sequences(spark.createDataFrame(pages, "doc_id long, html string, media int"), "doc_id", "html"), stored)
    got = sorted((r.doc_id, r.position, r.caption, r.n_bytes) for r in out.collect())
    assert got == [(1, 1, "B", 4), (1, 3, None, 5), (3, 0, None, None)]


def samples_of(stored: bytes) -> bytes:
    """The samples of an 8-bit greyscale PNG, read by the format's own rules, filters included."""
    assert stored[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    at, chunks = 8, []
    while at < len(stored):
        n = int.from_bytes(stored[at : at + 4], "big")
        body = stored[at + 4 : at + 8 + n]
        assert int.from_bytes(stored[at + 8 + n : at + 12 + n], "big") == zlib.crc32(body)
        chunks.append((body[:4], body[4:]))
        at += 12 + n
    assert chunks[0][0] == b"IHDR" and chunks[-1] == (b"IEND", b"")
    width, height = int.from_bytes(chunks[0][1][:4], "big"), int.from_bytes(chunks[0][1][4:8], "big")
    assert tuple(chunks[0][1][8:]) == (8, 0, 0, 0, 0)  # depth, grey, deflate, adaptive filters, not interlaced
    raw = zlib.decompress(b"".join(body for kind, body in chunks if kind == b"IDAT"))
    assert len(raw) == height * (width + 1)
    rows = [raw[i : i + width + 1] for i in range(0, len(raw), width + 1)]
    assert all(row[0] == 0 for row in rows)  # no row is filtered
    return b"".join(row[1:] for row in rows)


def test_media_query(spark, data):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = media.op2_media_columns(spark, data).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        text = (docs[r.doc_id].text or "").encode()
        payload = text + b" " * (-len(text) % 192 or (0 if text else 192))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.position == int(bool(docs[r.doc_id].source)) and r.caption == f"text of document {r.doc_id}"
        mean = sum(payload) / len(payload)
        deviation = (sum((x - mean) ** 2 for x in payload) / len(payload)) ** 0.5
        counts = [sum(x // 32 == b for x in payload) for b in range(8)]
        assert r.feature == f"192x{len(payload) // 192};mean={mean:.6f};std={deviation:.6f};hist=" + ",".join(map(str, counts))


def test_stored_media_by_another_reader(spark, data):
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").limit(40).collect()] + ["", None, "é" * 500]
    stored = media.store(spark.createDataFrame([(t,) for t in texts * 2], "text string").coalesce(1), "text").collect()
    assert {(r.digest, samples_of(bytes(r.media))[: r.n_bytes]) for r in stored} == {(hashlib.sha256((t or "").encode()).hexdigest(), (t or "").encode()) for t in texts}
    assert len(stored) == len({t or "" for t in texts})  # a task stores a payload once


def test_pages_with_media_between_their_texts(spark, data):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{data}/pages.parquet").collect() if r.html]
    blobs = [f"payload {i}" for i in range(5)]
    digest = [hashlib.sha256(b.encode()).hexdigest() for b in blobs]
    html, want = [], []
    for page, text in pages:
        body = text.replace("</p>", f'</p><img src="sha256:{digest[page % 5]}" alt="cap {page}">')
        html.append((page, body))
        items = media.parse(body)
        assert [x["position"] for x in items] == list(range(len(items)))
        assert [x["text"] for x in items if x["kind"] == "text"] == [x["text"] for x in media.parse(text)]
        shown = [x for x in items if x["kind"] == "media"]
        assert len(shown) == re.sub(r"(?s)<(script|style|template|noscript)\b.*?</\1>", "", text).count("</p>")
        want += [(page, x["position"], f"cap {page}", digest[page % 5], len(blobs[page % 5])) for x in shown]
    stored = media.described(media.store(spark.createDataFrame([(b,) for b in blobs], "text string"), "text"))
    out = media.resolve(media.sequences(spark.createDataFrame(html, "doc_id long, html string"), "doc_id", "html"), stored)
    assert sorted((r.doc_id, r.position, r.caption, r.digest, r.n_bytes) for r in out.collect()) == sorted(want) and want


def test_media_of_empty_tables(spark):
    stored = media.described(media.store(spark.createDataFrame([], "text string"), "text"))
    assert stored.collect() == []
    assert media.resolve(media.sequences(spark.createDataFrame([], "doc_id long, html string"), "doc_id", "html"), stored).collect() == []


PAGES = "page_id long, url string, html string, key string"


def pages():
    rows = [(i, f"http://h{i % 7}.example.org:80/p/{i % 11}?q={i}", f"<p>{i % 13} é</p>" * (1 + i % 3), "k") for i in range(60)]
    return rows + [(100, None, None, None), (101, "", "", ""), (102, "http://[bad", "<p>x</p>", ""), (103, "http://a.b/\tq r%", "<p>" + "y" * 60000 + "</p>", ""), (None, "http://n.org/", "<p>only</p>", ""), (None, "http://n.org/", rows[0][2], ""), (5, rows[5][1], rows[5][2], "again")]


def test_archive_and_back(spark):
    folder = new_path(spark, "test_warc")
    df = spark.createDataFrame(pages(), PAGES).repartition(4)
    directory = warc.build_index(warc.write_archives(df, folder), folder, block_entries=7)
    first = {}
    for i, _, html, _ in pages():
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    want = []
    for i, _, html, _ in pages():
        body = (html or "").encode()
        source = first.get(html or "")
        again = source is not None and source != i
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", source if again else None))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_all(directory, folder).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_lookup_by_url(spark):
    folder = new_path(spark, "test_warc")
    rows = pages()[:60] * 3
    directory = warc.build_index(warc.write_archives(spark.createDataFrame(rows, PAGES), folder), folder, block_entries=5)
    urls = [(rows[7][1],), (rows[23][1].replace(":80", ""),), ("http://nowhere.org/",), (None,)]
    out = warc.lookup(spark.createDataFrame(urls, "url string"), directory, folder, chunk=1)
    assert sorted(r.page_id for r in out.collect()) == [7] * 3 + [23] * 3


def test_every_address_is_found(spark):
    folder = new_path(spark, "test_warc")
    urls = [f"http://x.org{p}" for p in ("/~", "/é", "/ü", "/a", "/zz", "/%41", "/a%", "/", "/ÿ?q=ж", "/日本", "/a b")] + ["http://y.org/é"] * 9 + [None, ""]
    rows = [(i, u, f"<p>{i}</p>", "") for i, u in enumerate(urls * 3)]
    directory = warc.build_index(warc.write_archives(spark.createDataFrame(rows, PAGES), folder), folder, block_entries=4)
    for url in dict.fromkeys(urls):
        want = sorted(i for i, u, _, _ in rows if warc.surt(u) == warc.surt(url))
        got = warc.lookup(spark.createDataFrame([(url,)], "url string"), directory, folder, payloads=True).collect()
        assert sorted(r.page_id for r in got) == want and all(bytes(r.payload).decode() == f"<p>{r.page_id}</p>" for r in got)
    every = warc.lookup(spark.createDataFrame([(u,) for u in urls], "url string"), directory, folder, chunk=3).collect()
    assert sorted(r.page_id for r in every) == [r[0] for r in rows]


def test_query_of_pages(spark, data):
    rows = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    first = {}
    for i, body in rows.items():
        first[body] = min(i, first.get(body, i))
    want = {(i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first[b] == i else "revisit", None if first[b] == i else first[b]) for i, b in rows.items()}
    got = warc.op6_warc_index(spark, data).collect()
    assert {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == want and len(got) == len(rows)


def test_empty_archive(spark):
    folder = new_path(spark, "test_warc")
    directory = warc.build_index(warc.write_archives(spark.createDataFrame([], PAGES), folder), folder)
    assert warc.read_all(directory, folder).collect() == []
    assert warc.lookup(spark.createDataFrame([("http://a/",)], "url string"), directory, folder).collect() == []


def test_keys():
    assert warc.surt("HTTP://User@Blog.Example.COM:8080/A/b?x=1#top") == "com,example,blog:8080)/A/b?x=1"
    assert warc.surt("https://example.com") == "com,example)/" and warc.surt(None) == ""
