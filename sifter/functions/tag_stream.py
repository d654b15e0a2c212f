"""Elements of broken or nested HTML, read from the stream of its tags.

A regular expression cannot tell which end tag belongs to a start tag.  Here the
text is cut into tokens (comments, whole script and style elements, tags with
quoted attributes, runs of text) and folded from left to right with the stack of
open elements: an end tag closes the innermost open element of its name and all
that stand open inside it, unless one of those binds stronger (a table is not
closed by the end of an inline element around it); an end tag of nothing open is
skipped; what is still open at the end runs to the end.  All of it is one
expression on a row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ATTRIBUTES = "(?:[^>\"']|\"[^\"]*\"|'[^']*')*+"
RAW = "(?:script|style)"
#: comment, raw element, tag, text up to the next of them
TOKEN = (f"(?is)<!--.*?(?:-->|\\z)|<({RAW})\\b{ATTRIBUTES}>.*?(?:</\\1\\s*>|\\z)|</?[a-z]{ATTRIBUTES}>|[<][!?][^>]*>"
         f"|(?:[^<]++|<(?![a-z!?/])|</(?![a-z]))++|<")
NAME = "(?i)\\A</?([a-z][a-z0-9:_-]*)"
#: FIXED VALUES of HTML: elements without content, and how strongly an open element resists end tags of others.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
STRENGTH = {"div": 150, "td": 160, "th": 160, "tr": 170, "thead": 180, "tbody": 180, "tfoot": 180, "table": 190, "head": 200, "body": 200,
            "html": 220}
USUAL = 100


def tokens(html_text: Column) -> Column:
    """array<struct(kind, name, text)>: kind is 'open', 'end', 'gone' (comment, script, style, declaration) or 'text'."""
    found = F.regexp_extract_all(F.coalesce(html_text, F.lit("")), F.lit(TOKEN), 0)

    def described(t: Column) -> Column:
        name = F.lower(F.regexp_extract(t, NAME, 1))
        kind = (F.when(~t.startswith("<") | (t == "<"), "text").when(t.startswith("</"), F.when(name == "", "text").otherwise("end"))
                .when((name == "") | name.rlike(f"\\A{RAW}\\z"), F.when(t.rlike("\\A<[!?]"), "gone").when(name == "", "text").otherwise("gone"))
                .when(name.isin(VOID) | t.endswith("/>"), "void").otherwise("open"))
        return F.struct(kind.alias("kind"), name.alias("name"), t.alias("text"))

    return F.transform(found, described)


def _strength(name: Column) -> Column:
    out = F.lit(USUAL)
    for tag, n in STRENGTH.items():
        out = F.when(name == tag, n).otherwise(out)
    return out


def _closed_to(stack: Column, name: Column) -> Column:
    """How many elements stay open after the end tag ``name``: all if it closes nothing."""
    back = F.array_position(F.reverse(stack), name)                       # 1 for the innermost, 0 for none
    kept = F.size(stack) - back.cast("int")
    above = F.slice(stack, kept + 2, F.size(stack))
    held = F.exists(above, lambda x: _strength(x) > _strength(name))
    return F.when((back == 0) | held, F.size(stack)).otherwise(kept)


def _folded(html_text: Column, wanted, outside: bool, separator: str) -> Column:
    """The tokens outside of all wanted elements, or the content of the first of them, as text again."""
    start = F.struct(F.array().cast("array<string>").alias("stack"), F.lit(0).alias("at"), F.lit(False).alias("done"),
                     F.array().cast("array<string>").alias("out"))

    def step(s: Column, t: Column) -> Column:
        opens, ends = t["kind"] == "open", t["kind"] == "end"
        kept = F.when(ends, _closed_to(s["stack"], t["name"])).otherwise(F.size(s["stack"]))
        stack = F.when(opens, F.concat(s["stack"], F.array(t["name"]))).when(ends, F.slice(s["stack"], F.lit(1), kept)).otherwise(s["stack"])
        leaves = (s["at"] > 0) & ends & (kept < s["at"])
        enters = (s["at"] == 0) & opens & wanted(t["name"]) & ~s["done"]
        at = F.when(leaves, 0).when(enters, F.size(s["stack"]) + 1).otherwise(s["at"])
        if outside:
            add = F.when((s["at"] > 0) & ~leaves, F.lit(None).cast("string")).when(leaves | enters | (t["kind"] == "gone"), separator).otherwise(t["text"])
            done = s["done"]
        else:
            add = F.when((s["at"] > 0) & ~leaves, F.when(t["kind"] == "gone", separator).otherwise(t["text"]))
            done = s["done"] | leaves
        return F.struct(stack.alias("stack"), at.alias("at"), done.alias("done"),
                        F.when(add.isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(add))).alias("out"))

    return F.aggregate(tokens(html_text), start, step, lambda s: F.array_join(s["out"], ""))


def outside_of(html_text: Column, tags: list[str], separator: str) -> Column:
    """``html_text`` without comments, scripts, styles and the elements of ``tags``, each replaced by the separator."""
    return _folded(html_text, lambda name: name.isin(tags), True, separator)


def inside_first(html_text: Column, tag, separator: str) -> Column:
    """Content of the first ``tag`` element ('' if there is none); the tag is a name or a column."""
    return _folded(html_text, lambda name: name == tag, False, separator)


def within(content: Column) -> Column:
    """``content``, which follows a start tag, up to the first end tag of an element that was not opened in it."""
    start = F.struct(F.array().cast("array<string>").alias("stack"), F.lit(False).alias("done"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, t: Column) -> Column:
        opens, ends = t["kind"] == "open", t["kind"] == "end"
        kept = F.when(ends, _closed_to(s["stack"], t["name"])).otherwise(F.size(s["stack"]))
        stack = F.when(opens, F.concat(s["stack"], F.array(t["name"]))).when(ends, F.slice(s["stack"], F.lit(1), kept)).otherwise(s["stack"])
        done = s["done"] | (ends & ~F.array_contains(s["stack"], t["name"]))
        return F.struct(stack.alias("stack"), done.alias("done"),
                        F.when(done, s["out"]).otherwise(F.concat(s["out"], F.array(t["text"]))).alias("out"))

    return F.aggregate(tokens(content), start, step, lambda s: F.array_join(s["out"], ""))
