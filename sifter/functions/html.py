"""Native HTML-to-text expressions (F4, F5, F6) built from regular expressions.

The text of a document is the sequence of its text nodes.  Comments and dropped
elements are found in one left-to-right alternation (what opens first wins, so a
comment mark inside a script is script text); they and the tags are replaced by a
separator character, the string is split there, and every node is decoded and
stripped (``btrim``), empty ones dropped and the rest joined.  Tags may hold
quoted ``>``; an unclosed element or comment runs to the end of the text.
Character references follow the HTML rules: all named ones (the standard
library's table), those that need no semicolon, and numeric ones with the
Windows-1252 corrections; each is decoded once.  Nested and unclosed elements
are read from the stream of tags (``tag_stream``).
"""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from sifter.functions import constants as K
from sifter.functions import tag_stream as T
from sifter.functions.text import _c, py_strip, strip_invisible

SEP = "\u0001"
ATTRIBUTES = T.ATTRIBUTES
COMMENT_PATTERN = "<!--.*?(?:-->|\\z)"
# a tag with well-formed attributes, else (a stray quote) up to the next '>'
TAG_PATTERN = f"</?[A-Za-z]{ATTRIBUTES}>|</?[A-Za-z][^>]*>|<![^>]*>|<\\?[^>]*>"


def element_pattern(tag: str) -> str:
    """A whole element; an unclosed one runs to the end."""
    return f"<{tag}\\b{ATTRIBUTES}>.*?(?:</{tag}\\s*>|\\z)"


def presence_pattern(tag: str) -> str:
    return f"(?is)<{tag}\\b"


def drop_elements(html_text, tags: list[str]) -> Column:
    """Comments and the elements of ``tags`` -> a separator, in one pass from left to right."""
    pattern = "|".join([COMMENT_PATTERN, *map(element_pattern, tags)])
    return F.regexp_replace(_c(html_text), f"(?is){pattern}", SEP)


# ---------------------------------------------------------------- character references

REFERENCE = "\\A(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)"
_NAMED = {name: value for name, value in html.entities.html5.items() if name.endswith(";")}
_BARE = sorted((name for name in html.entities.html5 if not name.endswith(";")), key=len, reverse=True)
BARE_PATTERN = "\\A(" + "|".join(_BARE) + ")"
#: The characters that references to 128-159 stand for (code page 1252).
C1_POINTS = {str(128 + i): str(ord(bytes([128 + i]).decode("cp1252"))) for i in range(32) if 128 + i not in (129, 141, 143, 144, 157)}


def _literal_map(pairs: dict[str, str]) -> Column:
    """A constant map, written as one JSON literal that the optimizer folds."""
    return F.from_json(F.lit(json.dumps(pairs)), "map<string,string>")


def _character(n: Column) -> Column:
    """The character of a numeric reference."""
    valid = n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    point = F.when(n.between(128, 159), F.coalesce(F.element_at(_literal_map(C1_POINTS), n.cast("string")).cast("long"), n)).otherwise(n)
    text = F.decode(F.unhex(F.lpad(F.hex(point.cast("long")), 8, "0")), "UTF-32")
    return F.when(valid, text).otherwise(F.lit("\ufffd"))


def _decode_piece(piece: Column) -> Column:
    """Text behind an ampersand -> the text with its reference decoded (as written where it is none)."""
    ref = F.regexp_extract(piece, REFERENCE, 1)
    digits = F.regexp_replace(ref, "[#xX;]", "")
    hexadecimal = F.lower(F.substring(ref, 2, 1)) == "x"
    # more digits than any character has
    number = F.when(F.length(F.ltrim(F.lit("0"), digits)) > 7, F.lit(0x110000)).when(
        hexadecimal, F.conv(digits, 16, 10).cast("long")).otherwise(digits.cast("long"))
    bare = F.regexp_extract(piece, BARE_PATTERN, 1)
    named = F.element_at(_literal_map(_NAMED), ref)
    rest = lambda found: F.substring(piece, F.length(found) + 1, F.length(piece))
    return (F.when(piece.startswith("amp;"), F.concat(F.lit("&"), F.substring(piece, F.lit(5), F.length(piece))))
            .when(ref == "", F.concat(F.lit("&"), piece))
            .when(ref.startswith("#"), F.concat(_character(number), rest(ref)))
            .when(named.isNotNull(), F.concat(named, rest(ref)))
            .when(bare != "", F.concat(F.element_at(_literal_map({n: html.entities.html5[n] for n in _BARE}), bare), rest(bare)))
            .otherwise(F.concat(F.lit("&"), piece)))


def decode_references(text: Column) -> Column:
    """Every character reference decoded once (``text`` must be cheap to repeat, such as a lambda variable)."""
    pieces = F.split(text, "&")
    decoded = F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(F.slice(pieces, 2, F.size(pieces)), _decode_piece), ""))
    return F.when(F.instr(text, "&") > 0, decoded).otherwise(text)


def text_nodes_joined(html_fragment, sep: str) -> Column:
    """Stripped, non-empty text nodes of a fragment joined by ``sep``."""
    nodes = F.split(F.regexp_replace(_c(html_fragment), f"(?s){TAG_PATTERN}", SEP), SEP)
    nodes = F.transform(nodes, lambda p: py_strip(decode_references(p)))
    return F.array_join(F.filter(nodes, lambda p: p != ""), sep)


def html_to_text(html_text) -> Column:
    """body HTML -> plain text (script/style/head dropped, nodes joined by newline)."""
    text = strip_invisible(text_nodes_joined(drop_elements(html_text, K.BODY_DROP_TAGS), "\n"))
    return py_strip(F.regexp_replace(text, "\\n{3,}", "\n\n"))


def _is_plain(html_text: Column, names: Column) -> Column:
    """Every element of ``names`` (joined by '|') has its own end tag and none stands in another of them, so that a
    pattern finds its end.

    Only the start and end tags of ``names`` are looked at, in order: each start must be followed by its own end."""
    stream = F.regexp_extract_all(html_text, F.concat(F.lit("(?is)<(?:"), names, F.lit(f")\\b{ATTRIBUTES}>|</(?:"), names, F.lit(")\\s*>")), 0)
    marks = F.array_join(F.transform(stream, lambda t: F.lower(F.regexp_extract(t, "(?i)\\A(</?[a-z]+)", 1))), "")
    return marks.rlike("\\A(?:<([a-z]+)</\\1(?=<|\\z))*+\\z")


def main_content(html_text) -> Column:
    """linked-article text: first article/main/body container, capped at 8000 chars.

    The cap is applied before invisible characters are removed and there is no
    final strip (the reference's order).  Pages whose dropped elements or
    containers are nested, unclosed or interleaved are read from their tag
    stream; in all others patterns find the same ends.
    """
    page = _c(html_text)
    nestable = [t for t in K.ARTICLE_DROP_TAGS if t not in ("script", "style")]
    cleaned = F.when(_is_plain(drop_elements(page, ["script", "style"]), F.lit("|".join(nestable))),
                     drop_elements(page, K.ARTICLE_DROP_TAGS)).otherwise(T.outside_of(page, nestable, SEP))
    # as the variable of a lambda the cleaned page is computed once
    return F.get(F.transform(F.array(cleaned), _content_of_cleaned), F.lit(0))


def _content_of_cleaned(cleaned: Column) -> Column:
    tag = F.lit(None).cast("string")
    for name in reversed(K.ARTICLE_CONTAINERS):
        tag = F.when(cleaned.rlike(presence_pattern(name)), name).otherwise(tag)

    def content(tag: Column) -> Column:
        pattern = F.concat(F.lit("(?is)<"), tag, F.lit(f"\\b{ATTRIBUTES}>(.*?)(?:</"), tag, F.lit("\\s*>|\\z)"))
        # no <body> tag at all: the parser puts any loose content into an implied body
        return (F.when(tag.isNull(), F.regexp_replace(cleaned, "(?is)" + element_pattern("head"), SEP))
                .when(_is_plain(cleaned, tag), F.call_function("regexp_extract", cleaned, pattern, F.lit(1)))
                .otherwise(T.inside_first(cleaned, tag, SEP)))

    text = F.get(F.transform(F.array(tag), lambda t: text_nodes_joined(content(t), "\n")), F.lit(0))
    return strip_invisible(F.substring(F.regexp_replace(text, "\\n{3,}", "\n\n"), 1, K.ARTICLE_CHARS))


#: An anchor and what follows it up to the next one, which closes it if nothing else has.
ANCHOR_PATTERN = f"(?is)<a\\s{ATTRIBUTES}>(?:[^<]++|<(?!a[\\s>])[a-z/!?]{ATTRIBUTES}>|<(?!a[\\s>]))*+"
ANCHOR_OPEN_PATTERN = f"(?is)\\A<a\\s{ATTRIBUTES}>"
#: ... up to its end tag, if it has one
ANCHOR_INNER_PATTERN = f"(?is)\\A<a\\s{ATTRIBUTES}>((?:[^<]++|<(?!/a\\s*>)[a-z/!?]{ATTRIBUTES}>|<(?!/a\\s*>))*+)"
HREF_PATTERN = "(?is)\\shref\\s*=\\s*(?:\"([^\"]*)\"|'([^']*)'|([^\\s\"'>]+))"
HAS_HREF_PATTERN = "(?is)\\A<a\\s(?:[^>\"']|\"[^\"]*\"|'[^']*')*?\\bhref\\s*="


def anchors(html_text) -> Column:
    """``<a href=...>`` in document order (comments/scripts excluded), each with what follows up to the next anchor."""
    cleaned = drop_elements(html_text, ["script", "style"])
    found = F.regexp_extract_all(F.coalesce(cleaned, F.lit("")), F.lit(ANCHOR_PATTERN), 0)
    return F.filter(found, lambda a: a.rlike(HAS_HREF_PATTERN))


def anchor_href(anchor) -> Column:
    """Stripped, decoded ``href`` value."""
    open_tag = F.regexp_extract(_c(anchor), ANCHOR_OPEN_PATTERN, 0)
    raw = F.concat(F.regexp_extract(open_tag, HREF_PATTERN, 1), F.regexp_extract(open_tag, HREF_PATTERN, 2),
                   F.regexp_extract(open_tag, HREF_PATTERN, 3))
    # as a lambda variable the extracted value is computed once
    return py_strip(F.get(F.transform(F.array(raw), decode_references), F.lit(0)))


def anchor_inner(anchor) -> Column:
    """Content of an anchor: up to its end tag, the next anchor, or the end of an element around it."""
    inner = F.regexp_extract(_c(anchor), ANCHOR_INNER_PATTERN, 1)
    # the tag stream is only read where an end tag could be that of an element around it
    return F.when(F.instr(inner, "</") > 0, T.within(inner)).otherwise(inner)


def anchor_text(anchor) -> Column:
    """Anchor text: stripped inner strings concatenated without separator."""
    return F.get(F.transform(F.array(anchor_inner(anchor)), lambda inner: text_nodes_joined(inner, "")), F.lit(0))
