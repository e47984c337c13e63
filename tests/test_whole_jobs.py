"""Registered queries over whole tables: nothing is left out by number or place."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq

from inkstone.plans import catalog


def tables(folder, **columns):
    for name, values in columns.items():
        pq.write_table(pa.table(values), f"{folder}/{name}.parquet")
    return str(folder)


def test_every_line_is_a_leaf_and_a_mark(spark, tmp_path):
    words = [f"{'ab' * (i % 7)}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(45)]
    at = tables(tmp_path, documents={"doc_id": [1, 2], "text": ["\n\n".join(words), "one"]})
    lines = [(1, i // 40 + 1, i % 40, w) for i, w in enumerate(words)] + [(2, 1, 0, "one")]
    want = {}
    for d, p, i, a in lines:
        for e, q, j, b in lines:
            if (d, p) == (e, q):
                share = len(set(a) & set(b)) / max(len(set(a)), len(set(b)))
                want[d, p, i, j] = round(share + (0.5 if a in b or b in a else 0), 9)
    got = {(r.doc_id, r.page_num, r.ord, r.mcid): r.score for r in catalog.QUERIES["mark_scores"](spark, at).collect()}
    assert len(want) == 40 * 40 + 5 * 5 + 1
    assert got == want
    taken = catalog.QUERIES["mark_assignment"](spark, at).collect()
    assert sorted((r.doc_id, r.page_num, r.ord) for r in taken) == sorted(x[:3] for x in lines)
    assert len({(r.doc_id, r.page_num, r.mcid) for r in taken}) == len(lines)


def test_merge_keeps_all_elements(spark, tmp_path):
    page = "<html><body><h1>Head</h1><p>one</p><ul><li>item</li></ul></body></html>"
    plain = "<html><body><p>one</p><p>two</p></body></html>"
    talk = {"conv_id": [2, 4, 5], "turn": [0, 0, 0], "role": ["user"] * 3, "text": ["asked"] * 3}
    at = tables(tmp_path, pages={"page_id": [6, 12], "url": ["u", "u"], "html": [page, plain]}, conversations=talk)
    rows = catalog.QUERIES["ai_structure_merge"](spark, at).collect()
    own = catalog.QUERIES["html_elements"](spark, at).filter("doc_id = 6").count()
    assert [r.origin for r in rows if r.page_num == 6] == ["rules"] * own
    assert {r.elem_type for r in rows if r.page_num == 6} >= {"H1", "L"}
    assert [(r.origin, r.text) for r in rows if r.page_num in (12, 15)] == [("suggested", "asked")] * 2


def test_null_texts_are_pages(spark, tmp_path):
    at = tables(tmp_path, documents={"doc_id": [1, 2], "text": [None, ""]})
    for name in ("ocr_findings", "digital_or_scanned"):
        rows = catalog.QUERIES[name](spark, at).collect()
        assert {r.doc_id for r in rows} == {1, 2}, name
