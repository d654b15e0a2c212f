"""Native (JVM-side) string expressions: sender keys, cleaning, truncation, tokens.

Every function takes and returns a ``Column``; nothing here leaves the JVM.
Regex patterns use the ``\\x{hh}`` code-point form, which Java and RE2 read alike,
so the same pattern text serves the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sifter.functions import constants as K


def cp_class(codepoints: list[int], negate: bool = False) -> str:
    body = "".join(f"\\x{{{c:x}}}" for c in codepoints)
    return f"[{'^' if negate else ''}{body}]"


INVISIBLE_CLASS = cp_class(K.INVISIBLE_CODEPOINTS)
INVISIBLE_CHARS = "".join(chr(c) for c in K.INVISIBLE_CODEPOINTS)
PY_WS_CHARS = "".join(chr(c) for c in K.STRIP_CODEPOINTS)
# Python str.strip() whitespace.
PY_WS = cp_class(K.STRIP_CODEPOINTS)
STRIP_PATTERN = f"\\A{PY_WS}+|{PY_WS}+\\z"
# ASCII whitespace used by the word-piece tokenizer (Java's \s; RE2's \s lacks \v).
TOKEN_WS = "[\\t\\n\\x{0b}\\f\\r ]"
TOKEN_NWS = "[^\\t\\n\\x{0b}\\f\\r ]"
TOKEN_PATTERN = f"\\A{TOKEN_WS}+|{TOKEN_NWS}+{TOKEN_WS}*"

SENDER_ADDRESS_PATTERN = "<([^>]+)>"
SOURCE_NAME_PATTERN = f'^"?([^"<]+)"?{PY_WS}*<'


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(x) -> Column:
    """Python ``str.strip()`` (Unicode whitespace), not Spark's space-only trim.

    ``btrim`` with an explicit character set scans only the two ends (a regex
    alternative ``ws+$`` is tried at every position).
    """
    return F.btrim(_c(x), F.lit(PY_WS_CHARS))


def normalize_sender(sender) -> Column:
    """address inside the first ``<...>``, else the whole header; lower + strip."""
    s = _c(sender)
    inner = F.regexp_extract(s, SENDER_ADDRESS_PATTERN, 1)
    return py_strip(F.lower(F.when(inner != "", inner).otherwise(s)))


def source_name(sender) -> Column:
    """display name before ``<`` (quotes optional), else text before the first ``@``."""
    s = _c(sender)
    return (F.when(s.rlike(SOURCE_NAME_PATTERN), py_strip(F.regexp_extract(s, SOURCE_NAME_PATTERN, 1)))
            .otherwise(F.split_part(s, F.lit("@"), F.lit(1))))


def strip_invisible(text) -> Column:
    """delete zero-width / invisible code points (NBSP included).

    ``translate`` with an empty replacement deletes every listed code point
    in one hash-lookup pass.
    """
    return F.translate(_c(text), INVISIBLE_CHARS, "")


def truncate(text, n: int) -> Column:
    """First ``n`` code points."""
    return F.substring(_c(text), 1, n)


def truncate_ellipsis(text, n: int, always: bool = False) -> Column:
    """First ``n`` code points plus ``...`` (only when cut, unless ``always``)."""
    t = _c(text)
    cut = F.concat(F.substring(t, 1, n), F.lit("..."))
    return cut if always else F.when(F.length(t) > n, cut).otherwise(t)


def preview_text(snippet, body_text) -> Column:
    """snippet if non-empty else body text, capped at 600 characters."""
    s, b = _c(snippet), _c(body_text)
    return F.substring(F.when(F.coalesce(s, F.lit("")) != "", s).otherwise(F.substring(b, 1, K.PREVIEW_CHARS)),
                       1, K.PREVIEW_CHARS)


def strip_code_fence(text) -> Column:
    """strip; if it starts with three backticks drop the first and last lines."""
    t = py_strip(_c(text))
    lines = F.split(t, "\n", -1)
    inner = F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 2, F.lit(0))), "\n")
    return F.when(t.startswith("```"), py_strip(inner)).otherwise(t)


def word_pieces(text) -> Column:
    """F20 tokenizer: lossless word pieces (leading whitespace, then word+trailing ws)."""
    return F.regexp_extract_all(_c(text), F.lit(TOKEN_PATTERN), 0)


def token_count(text) -> Column:
    return F.size(word_pieces(text))


def token_slice_text(tokens, start0, length) -> Column:
    """decode tokens[start0 : start0+length] back to text."""
    return F.array_join(F.slice(_c(tokens), _c(start0) + 1 if not isinstance(start0, int) else start0 + 1,
                                length), "")
