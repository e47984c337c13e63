"""All queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from inkstone.llm import ann, jaccard, lines, media, mixing, packing, substrings, tokencount, toxicity, warc

MODULES = [mixing, media, tokencount, packing, substrings, warc, toxicity, lines, jaccard, ann]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
