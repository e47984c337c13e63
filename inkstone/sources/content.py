"""Text lines from raw page content, decoding of stored strings, and parts of messages.

A content stream is read as operands and operators; a small machine keeps the pen's place and
the font and notes every piece of shown text.  Streams are dealt evenly to the pages.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values
TOP, FONT, LEADING, SPACING = 800.0, 12.0, 1.2, 0.4
BOLD = re.compile(r"bold|black|heavy|demi|bd", re.I)

_STREAM = re.compile(r"stream[\r\n]+(.*?)[\r\n]+endstream", re.S)
_PAGE = re.compile(r"/Type\s*/Page[^s]")
_TOKEN = re.compile(r"\((?P<text>(?:\\.|[^\\)])*)\)|(?P<array>[\[\]])|/(?P<name>[A-Za-z0-9_.+-]+)|(?P<number>-?\d+(?:\.\d+)?)|(?P<operator>[A-Za-z'\"*]+)", re.S)
_ESCAPE = re.compile(r"\\([nrtbf])|\\([()\\])|\\\d{1,3}")


def literal(raw: str) -> str:
    """Text of a string literal: line-end and octal escapes become spaces, ends are stripped."""
    return " ".join(_ESCAPE.sub(lambda m: m[2] or " ", raw).split())


def width_of(text: str, size: float) -> float:
    rtl = sum("֐" <= c <= "׿" for c in text)
    latin = sum(c.isascii() and c.isalnum() for c in text)
    return size * (0.55 * rtl + 0.5 * latin + 0.35 * (len(text) - rtl - latin))


class Pen:
    """Place, font, and what was shown."""

    def __init__(self):
        self.x, self.y, self.size, self.font, self.shown = 0.0, TOP, FONT, "", []

    def show(self, text: str, advance: float = 0.0) -> None:
        text = " ".join(text.split())
        if text:
            width = width_of(text, self.size) + advance / 1000 * self.size
            self.shown.append((text, self.x, self.y, width, self.size, self.font, bool(BOLD.search(self.font))))
            self.x += width + self.size * SPACING

    def run(self, operator: str, stack: list) -> None:
        numbers = [v for v in stack if isinstance(v, float)]
        if operator == "Tf" and len(stack) >= 2 and numbers:
            self.font, self.size = str(stack[-2]).lstrip("/"), numbers[-1] or self.size
        elif operator in ("Td", "TD") and len(numbers) >= 2:
            self.x, self.y = self.x + numbers[-2], self.y + numbers[-1]
        elif operator == "Tm" and len(numbers) >= 6:  # a zero leaves the place as it is
            self.x, self.y = numbers[-2] or self.x, numbers[-1] or self.y
        elif operator == "T*":
            self.y -= self.size * LEADING
        elif operator == "Tj" and stack and isinstance(stack[-1], tuple):
            self.show(literal(stack[-1][0]))
        elif operator == "TJ" and stack and isinstance(stack[-1], list):
            self.show("".join(literal(v[0]) for v in stack[-1] if isinstance(v, tuple)), sum(abs(v) for v in stack[-1] if isinstance(v, float)))


def shown_in(stream: str) -> list[tuple]:
    """(text, x, y, width, size, font, bold) of what a stream shows, in order."""
    pen, stack, outer = Pen(), [], None
    for m in _TOKEN.finditer(stream):
        kind, value = m.lastgroup, m[m.lastgroup]
        if kind == "operator":
            pen.run(value, stack)
            stack, outer = [], None
        elif kind == "array":
            if value == "[":
                outer, stack = stack, []
            elif outer is not None:
                stack, outer = [*outer, stack], None
        else:
            stack.append((value,) if kind == "text" else float(value) if kind == "number" else "/" + value)
    return pen.shown


LINES = "doc_id long, page_num int, line_index int, text string, x double, y double, width double, font_size double, font_name string, bold boolean"


def content_lines(files: DataFrame, id_col: str = "doc_id", raw_col: str = "raw") -> DataFrame:
    """Shown text of raw files (as Latin-1 text), page by page; files without text give no rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc, raw in zip(frame["doc_id"], frame["raw"], strict=True):
                raw = raw or ""
                streams = [s for s in _STREAM.findall(raw) if re.search(r"\bBT\b", s) and re.search(r"\b(?:Tj|TJ)\b", s)]
                pages = max(1, len(_PAGE.findall(raw)))
                each, index = max(1, math.ceil(len(streams) / pages)), [0] * pages
                for i, stream in enumerate(streams):
                    page = min(i // each, pages - 1)
                    for text, x, y, width, size, font, bold in shown_in(stream):
                        out.append((doc, page + 1, index[page], text, x, y, width, size, font, bold))
                        index[page] += 1
            yield pd.DataFrame(out, columns=[c.split()[0] for c in LINES.split(", ")])

    return files.select(F.col(id_col).cast("long").alias("doc_id"), F.col(raw_col).cast("string").alias("raw")).mapInPandas(run, LINES)


def decoded(raw: Column) -> Column:
    """Text of stored bytes: UTF-16 by its mark, else UTF-8, else the two Windows code pages."""

    @F.pandas_udf("string")
    def decode(values: pd.Series) -> pd.Series:
        def one(b: bytes | None) -> str | None:
            if b is None:
                return None
            for name in (["utf-16"] if bytes(b[:2]) in (b"\xfe\xff", b"\xff\xfe") else []) + ["utf-8", "cp1255"]:
                try:
                    return bytes(b).decode(name)
                except UnicodeDecodeError:
                    continue
            return bytes(b).decode("cp1252", "replace")

        return values.map(one)

    return decode(raw)


def escaped(text: Column) -> Column:
    """Text for a string literal: what Latin-1 lacks becomes ?, backslash and brackets are escaped."""
    return F.regexp_replace(F.regexp_replace(text, r"[^\x00-\xFF]", "?"), r"([\\()])", r"\\$1")


def repaired(text: Column) -> Column:
    """UTF-8 that was read as Latin-1, read again; other text as it is."""
    bytes_ = F.encode(text, "ISO-8859-1")
    again = F.when(~text.rlike(r"[^\x00-\xFF]") & F.is_valid_utf8(bytes_.cast("string")), F.decode(bytes_, "UTF-8"))
    return F.coalesce(again, text)


#: A tag and the number of the marked content it opens.
MARK = r"/(\w+)\s+<<[^>]*?/MCID\s+(\d+)"


def markers(stream: Column) -> Column:
    """Marked-content operators of a page's content stream, in order: array of (tag, mcid)."""
    of = lambda group: F.regexp_extract_all(F.coalesce(stream, F.lit("")), F.lit(MARK), F.lit(group))
    return F.zip_with(of(1), of(2), lambda tag, mcid: F.struct(tag.alias("tag"), mcid.cast("long").alias("mcid")))


def unmarked(stream: Column) -> Column:
    """Whether a page has content and none of it is marked."""
    return F.coalesce((stream != "") & ~stream.rlike(MARK), F.lit(False))


def message_bodies(parts: DataFrame) -> DataFrame:
    """The body of each message: its first HTML part, else its first plain part.

    parts: doc_id, seq, content_type, text.
    """
    first = lambda kind: F.min_by("text", F.when(F.col("content_type") == kind, F.col("seq")))
    return parts.groupBy("doc_id").agg(F.coalesce(first("text/html"), first("text/plain")).alias("body"), first("text/html").isNotNull().alias("is_html"))
