"""Text column functions. All are native Spark expressions (codegen-friendly),
except HTML entity unescaping, which uses a row UDF."""

from __future__ import annotations

import html as _html

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .constants import NOISE_PATTERNS

ELLIPSIS = "…"

# Python's str.isspace() set, derived by rule; str.strip() removes exactly
# these characters, and btrim with this set does the same without a regex.
WS_CHARS = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())
# Java's (?U) makes \s follow Unicode White_Space, which is Python's set minus
# U+001C..U+001F; a plain \s+ is several times faster than an explicit class.
_WS = r"(?U)\s+"
_URL = r"(?iU)https?://\S+"
_WORD = r"[\p{L}\p{N}_'’-]+"      # Python's str \w is letters, numbers and underscore


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_ws(col) -> Column:
    """Python ``str.strip()``: remove leading and trailing Unicode whitespace."""
    return F.btrim(_c(col), F.lit(WS_CHARS))


def collapse_ws(col) -> Column:
    """Collapse every whitespace run to one space and strip."""
    return F.trim(F.regexp_replace(_c(col), _WS, " "))


def cut(col, max_chars: int) -> Column:
    """Cut to ``max_chars``: first n-1 chars, right-stripped, plus an ellipsis."""
    c = _c(col)
    return F.when(F.char_length(c) > max_chars,
                  F.concat(F.rtrim(F.substring(c, 1, max_chars - 1)), F.lit(ELLIPSIS))).otherwise(c)


def clean_text(col) -> Column:
    """fn_clean_text: CR to LF, collapse Unicode whitespace, strip; URLs kept.
    Null and empty input give ''."""
    return F.coalesce(collapse_ws(_c(col)), F.lit(""))


def remove_urls(col) -> Column:
    """Remove ``https?://`` runs; the regex only runs on texts holding '://'."""
    c = _c(col)
    return F.when(F.instr(c, "://") > 0, F.regexp_replace(c, _URL, "")).otherwise(c)


def clean_text_nourl(col, max_chars: int | None = None) -> Column:
    """fn_clean_text_nourl: drop URLs, collapse whitespace, strip, optional cut."""
    v = F.coalesce(collapse_ws(remove_urls(_c(col))), F.lit(""))
    return cut(v, max_chars) if max_chars else v


def clean_text_mail(col) -> Column:
    """fn_clean_text_mail: CRLF/CR to LF, collapse spaces and tabs, at most one
    blank line, strip."""
    v = F.regexp_replace(_c(col), r"\r\n?", "\n")
    v = F.regexp_replace(v, r"[ \t]+", " ")
    v = F.regexp_replace(v, r"\n{3,}", "\n\n")
    return strip_ws(v)


@F.udf(T.StringType(), useArrow=False)
def html_unescape(v: str) -> str:
    """Full HTML5 entity table; a small per-value helper. Spark hands whole pages to
    a row UDF by the hundred, to an Arrow one by ten thousand."""
    return _html.unescape(v) if v is not None and "&" in v else v


def html_to_text(col) -> Column:
    """fn_html_to_text: drop script/style blocks, <br> to newline, </p> to a
    blank line, other tags to a space, unescape entities, then mail clean."""
    v = F.regexp_replace(_c(col), r"(?is)<(script|style).*?>.*?</\1>", " ")
    v = F.regexp_replace(v, r"(?i)<br\s*/?>", "\n")
    v = F.regexp_replace(v, r"(?i)</p\s*>", "\n\n")
    v = F.regexp_replace(v, r"(?s)<[^>]+>", " ")
    return clean_text_mail(html_unescape(v))


def strip_invisible(col) -> Column:
    """fn_strip_invisible: remove zero-width and direction-control characters."""
    return F.regexp_replace(_c(col), r"[\u200B-\u200F\u202A-\u202E\u2060-\u2064\uFEFF]", "")


def visible_text(col) -> Column:
    """fn_visible_text: URLs removed from the cleaned text, stripped."""
    return strip_ws(remove_urls(clean_text(col)))


def word_count(col) -> Column:
    """fn_word_count: number of runs of word characters, apostrophes and hyphens."""
    return F.regexp_count(F.coalesce(_c(col), F.lit("")), F.lit(_WORD)).cast("int")


def is_url_only(col) -> Column:
    """flt_url_only: text consists only of URLs separated by whitespace."""
    return F.coalesce(_c(col).rlike(r"(?iU)^(https?://\S+)(\s+https?://\S+)*$"), F.lit(False))


def transcript_summary(col, max_chars: int = 400, max_segments: int = 3) -> Column:
    """fn_transcript_summary: first non-blank lines (speaker prefix removed),
    cleaned, joined by a space, cut to ``max_chars``."""
    lines = F.split(F.coalesce(_c(col), F.lit("")), r"\R")

    def one(line):
        s = strip_ws(line)
        dash = F.instr(s, "-")
        s = F.when(F.lower(s).startswith("speaker ") & (dash > 0),
                   strip_ws(F.substring(s, dash + 1, 1 << 30))).otherwise(s)
        return clean_text(s)

    pieces = F.filter(F.transform(lines, one), lambda x: x != "")
    return cut(F.array_join(F.slice(pieces, 1, max_segments), " "), max_chars)


def preview(col, n: int) -> Column:
    """fn_preview: first n characters."""
    return F.substring(_c(col), 1, n)


def post_title(name, visible) -> Column:
    """fn_post_title: ``name：`` + first 80 visible chars, ellipsis if longer."""
    v = _c(visible)
    return F.concat(_c(name), F.lit("："), F.substring(v, 1, 80),
                    F.when(F.char_length(v) > 80, F.lit(ELLIPSIS)).otherwise(F.lit("")))


def noise_pattern_hit(lowered) -> Column:
    """Any of the fixed low-signal patterns occurs in the lower-cased text."""
    c = _c(lowered)
    hit = F.lit(False)
    for p in NOISE_PATTERNS:
        hit = hit | c.contains(p)
    return hit


def nonempty(col) -> Column:
    """Python truthiness of an optional string: not null and not ''."""
    c = _c(col)
    return c.isNotNull() & (c != "")


def first_nonempty(*cols) -> Column:
    """Python ``a or b or c``: first value that is neither null nor ''."""
    return F.coalesce(*[F.nullif(_c(c), F.lit("")) for c in cols])


def normalize_sender(col) -> Column:
    """fn_normalize_sender: address part of a From header, lower-cased, stripped."""
    c = _c(col)
    addr = F.regexp_extract(c, r"<([^>]*)>", 1)
    return F.lower(strip_ws(F.when(addr != "", addr).otherwise(F.coalesce(c, F.lit("")))))


def split_list(col, sep_regex: str = ",") -> Column:
    """fn_split_list: split, trim items, drop empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(_c(col), F.lit("")), sep_regex), lambda x: F.trim(x)),
                    lambda x: x != "")


def tag_parent(col) -> Column:
    """fn_tag_parent: parent of ``a/b`` is ``a``; null for a top-level tag."""
    p = F.regexp_extract(_c(col), r"^(.*)/[^/]+$", 1)
    return F.when(p != "", p)
