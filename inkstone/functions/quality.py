"""Quality measures of recognised text, and the small policies of the service."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstone.functions.text import WS, count, strip, words

# --- fixed values: thresholds of the recognition gate
MIN_CONFIDENCE, MAX_BAD, MAX_GIBBERISH, MIN_CHARS_PER_PAGE = 0.62, 0.22, 0.35, 24
# --- fixed values: characters
SUSPECT = r"[\x{FFFD}\x00-\x08\x0E-\x1B{}\[\]<>|~^`]"
FOREIGN = r"[^\x20-\x7E\x{A0}-\x{FF}\x{5D0}-\x{5EA}\x{5F0}-\x{5F4}\x{FB1D}-\x{FB4E}\x{200B}-\x{200F}\x{202A}-\x{202E}\n\r\t]"
EDGE_MARKS = r"()\[\]{}.,:;'\x{22}!?%\x{20AA}$\x{20AC}#@&*/+\-=<>_|\\\x{2010}-\x{2015}\x{5BE}\x{5F3}\x{5F4}"
_BLANK = WS[1:-1]
EDGE_SCRIPTS = r"\x{590}-\x{5FF}\x{FB1D}-\x{FB4F}\x{600}-\x{6FF}\x{750}-\x{77F}A-Za-z0-9"


# runs of characters below 256 that are certainly fine; the engine's regexes test these by table,
# while long classes of ranges are tested range by range, so these are taken away first
_PLAIN = r"[\x09\x0A\x0D\x20-\x7E\xA0-\xFF]++"
_EDGE_ASCII = r"[A-Za-z0-9()\[\]{}.,:;'\x22!?%$#@&*/+\-=<>_|\\]"
_EDGE_PLAIN = _EDGE_ASCII[:-1] + r"\x09-\x0D\x20]++"


def bad_char_ratio(text: Column) -> Column:
    """Share of suspect characters among those that aren't white space; 1 for none.

    Characters are counted with regexp_count over runs where that is enough, which builds no
    second text.
    """
    n = visible(text)
    return F.when(n > 0, F.regexp_count(text, F.lit(SUSPECT)) / n).otherwise(1.0)


#: White space, character by character, for translate.
_SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def visible(text: Column) -> Column:
    """Number of characters that aren't white space."""
    return F.length(F.translate(text, _SPACES, ""))


def gibberish_ratio(text: Column, split: Column | None = None) -> Column:
    """Share of words with hardly a letter or digit; 1 without words.

    A word is gibberish with fewer than two letters or digits, or with fewer than 45 % of
    them among its letters and numbers.  The second can only be where there are numbers that
    are no digits.  split: the text's words, where they are at hand.
    """
    ws = words(text) if split is None else split

    def is_gibberish(w: Column) -> Column:
        kept = F.regexp_replace(w, r"[^\p{L}\p{N}]", "")
        return F.length(F.regexp_replace(kept, r"[^\p{L}\p{Nd}]", "")) < F.greatest(F.lit(2.0), F.length(kept) * 0.45)

    suspects = F.filter(ws, lambda w: ~w.rlike(r"[\p{L}\p{Nd}][^\p{Nl}\p{No}]*[\p{L}\p{Nd}]") | w.rlike(r"[\p{Nl}\p{No}]"))
    return F.when(F.size(ws) > 0, F.size(F.filter(suspects, is_gibberish)) / F.size(ws)).otherwise(1.0)


def foreign_ratio(text: Column) -> Column:
    """Share of characters outside the expected scripts; 0 for an empty text."""
    return F.when(F.length(text) > 0, F.regexp_count(F.regexp_replace(text, _PLAIN, ""), F.lit(FOREIGN)) / F.length(text)).otherwise(0.0)


def edge_bad_ratio(text: Column) -> Column:
    return F.regexp_count(F.regexp_replace(text, _EDGE_PLAIN, ""), F.lit(f"[^{EDGE_SCRIPTS}{EDGE_MARKS}{_BLANK}]")) / F.greatest(visible(text), F.lit(1))


def edge_gibberish_ratio(text: Column, split: Column | None = None) -> Column:
    """Share of words that are mostly signs, of unexpected scripts, or repeat a character."""
    ws = words(text) if split is None else split

    def is_gibberish(kept: Column) -> Column:
        n = F.length(kept)
        letters, weird = F.length(F.regexp_replace(kept, r"[^\p{L}\p{N}]", "")), count(kept, f"[^{EDGE_SCRIPTS}]")
        return (n > 1) & ((letters / n < 0.55) | (weird / n > 0.25) | kept.rlike(r"(.)\1{4,}"))

    # words of expected letters and marks only, without a run, can't be gibberish
    suspects = F.filter(ws, lambda w: (~w.rlike(f"^{_EDGE_ASCII}*+$") & w.rlike(rf"[^{EDGE_SCRIPTS}{EDGE_MARKS}]")) | w.rlike(rf"([{EDGE_SCRIPTS}])(?:[{EDGE_MARKS}]*\1){{4,}}"))
    found = F.filter(F.transform(suspects, lambda w: F.regexp_replace(w, f"[{EDGE_MARKS}]", "")), is_gibberish)
    return F.size(found) / F.greatest(F.size(ws), F.lit(1))


def quality_ok(confidence: Column, bad: Column, gibberish: Column, chars_per_page: Column) -> Column:
    return (confidence >= MIN_CONFIDENCE) & (bad <= MAX_BAD) & (gibberish <= MAX_GIBBERISH) & (chars_per_page >= MIN_CHARS_PER_PAGE)


def mean_confidence(values: Column) -> Column:
    """Mean of the values of an array that aren't negative; 100 without any."""
    good = F.filter(values, lambda v: v >= 0)
    return F.when(F.size(good) > 0, F.aggregate(good, F.lit(0.0), lambda s, v: s + v) / F.size(good)).otherwise(100.0)


def scanned_class(text: Column) -> Column:
    """What a scanned document that failed counts as: readable text layer, or for review."""
    s = strip(text)
    n = F.length(s)
    return F.when((n < 30) | (count(s, r"\?") / n > 0.20), "review_required").otherwise("basic_accessible_scanned")


def status_of(score: Column) -> Column:
    return F.when(score >= 85, "compliant").when(score >= 60, "needs_review").otherwise("non_compliant")


def service_status(failed: Column, scanned: Column, status: Column, scanned_as: Column) -> Column:
    """The service's status from gate signal, scan flag, scorer's status and scan class."""
    return (
        F.when(~failed & ~scanned, F.when(status == "compliant", "full_accessible").otherwise(status))
        .when(~failed & scanned, "basic_accessible_scanned")
        .when(failed & scanned, scanned_as)
        .otherwise("review_required")
    )


def service_score(failed: Column, scanned: Column, score: Column, scanned_as: Column) -> Column:
    cap = F.when(~failed & ~scanned, 100).when(~failed, 75).when(scanned & (scanned_as == "basic_accessible_scanned"), 65).otherwise(45)
    return F.least(score, cap)


def dpi(pages: Column) -> Column:
    return F.when(pages <= 30, 150).when(pages <= 100, 120).otherwise(100)


def job_timeout(pages: Column) -> Column:
    return F.greatest(F.lit(300), F.least(F.lit(3600), 300 + 4 * pages))


def upload_problem(name: Column, size: Column, pages: Column, extensions: tuple[str, ...] = ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "eml", "msg"), max_mb: int = 200, max_pages: int = 300) -> Column:
    """Why an upload is refused, or null; a page count that isn't known is let through."""
    extension = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return F.when(~extension.isin(*extensions), "extension").when(size > max_mb * 1024 * 1024, "too_large").when(pages > max_pages, "too_many_pages")


def has_text(chars: Column, least: int = 50) -> Column:
    return chars >= least


