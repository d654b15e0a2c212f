"""Nested, unclosed and interleaved HTML elements (F5, F6): by hand and against a stack machine."""

import random
import re

from pyspark.sql import functions as F

from conftest import col_values
from sifter.functions import html as H
from sifter.functions import tag_stream as T

VOID = {"br", "img"}
STRENGTH = {"div": 150, "td": 160, "tr": 170, "table": 190, "body": 200}
DROP = {"nav", "aside", "header"}


def read(page, wanted, dropping):
    """Text outside of the dropped elements, or inside the first wanted one, piece by piece."""
    stack, at, done, out = [], 0, False, []
    for t in re.findall(r"<[^>]*>|[^<]+", page):
        name = t.strip("</>")
        if not t.startswith("<"):
            if (at == 0) if dropping else (at > 0 and not done):
                out.append(t)
        elif t.startswith("</"):
            if name in stack:
                kept = len(stack) - 1 - stack[::-1].index(name)
                if any(STRENGTH.get(x, 100) > STRENGTH.get(name, 100) for x in stack[kept + 1:]):
                    continue
                if at and kept < at:
                    at, done = 0, True
                del stack[kept:]
        elif name not in VOID:
            stack.append(name)
            if not at and name in wanted and (dropping or not done):
                at = len(stack)
    return "|".join(out)


def random_pages(n=300):
    rng = random.Random(11)
    names = ["div", "b", "nav", "aside", "p", "table", "td", "article", "span", "br"]
    pages = []
    for _ in range(n):
        out = []
        for i in range(rng.randint(1, 25)):
            tag = rng.choice(names)
            out.append(rng.choice([f"<{tag}>", f"<{tag}>", f"</{tag}>" if tag != "br" else "<br>", f"w{i}"]))
        pages.append("".join(out))
    return pages


def texts(tokens_text):
    return F.array_join(F.filter(F.split(F.regexp_replace(tokens_text, "<[^>]*>", "\x01"), "\x01"), lambda x: x != ""), "|")


def merged(s):
    """Neighbouring text runs count as one in both readings."""
    return s.replace("|", "")


def test_stack_machine_agrees(spark):
    pages = random_pages()
    got = col_values(spark, lambda x: texts(T.outside_of(x, sorted(DROP), "\x01")), pages)
    for page, g in zip(pages, got):
        assert merged(g) == merged(read(page, DROP, True)), page
    got = col_values(spark, lambda x: texts(T.inside_first(x, "article", "\x01")), pages)
    for page, g in zip(pages, got):
        assert merged(g) == merged(read(page, {"article"}, False)), page


def test_pattern_and_stream_agree_on_plain_pages(spark):
    """Where elements are neither nested nor unclosed both readings give the same text."""
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    stream = H._content_of_cleaned(T.outside_of(F.col("html"), ["nav", "footer", "header", "aside", "iframe"], H.SEP))
    assert table.where(H.main_content("html") != stream).count() == 0


def test_main_content_by_hand(spark):
    cases = {
        "<article>one <article>two</article> three</article> four": "one\ntwo\nthree",
        "<body><aside>a<aside>b</aside>c</aside>kept<nav>n</body>": "kept", "<body><div><nav>n</div>tail</body>": "tail",
        "<article>x</article><article>y</article>": "x", "<article>open <p>para": "open\npara", "<article title='</article>'>q</article>z": "q",
        "<body><aside><article>no</article></aside><main>yes<main>in</main>out</main>": "yes\nin\nout",
        "<body><table><tr><td><span>a</table></span>b</td></tr></table>c</body>": "a\nb\nc",
        "<body><header>h<header>i</header>j</header><!-- <nav> -->t<script>'<nav>'</script>u</body>": "t\nu",
        "<body>a < b <3 c<footer>f</body>": "a < b <3 c"}
    assert dict(zip(cases, col_values(spark, H.main_content, list(cases)))) == cases


def test_anchors_by_hand(spark):
    cases = {
        '<a href="u">one <b>two</b></a>tail': "u=onetwo", "<a href=u>one<a href=v>two</a>x": "u=one|v=two",
        "<p><a href=u>one</p><p>two</a>": "u=one", "<a href=u>end": "u=end", "<div><a href=u><div>in</div> more</a></div>": "u=inmore",
        '<a href=u title="<a href=z>">t</a>': "u=t", "<a name=n>no<a href=u></a>": "u=", "<A HREF=u>x<br>y</A>": "u=xy",
        "<script><a href=s>s</a></script><a href=u>t<!-- <a href=c> --></a>": "u=t", "none": ""}

    def links(x):
        return F.array_join(F.transform(H.anchors(x), lambda a: F.concat(H.anchor_href(a), F.lit("="), H.anchor_text(a))), "|")

    assert dict(zip(cases, col_values(spark, links, list(cases)))) == cases


def test_long_pages(spark):
    """Ten thousand tags and a tag with a very long attribute."""
    many = "<body>" + "<p>w</p>" * 5000 + "<nav>" * 3 + "x"
    wide = '<article data="' + "y" * 200_000 + '">text</article>'
    got = col_values(spark, H.main_content, [many, wide])
    assert got[0] == "\n".join(["w"] * 5000)[:8000] and got[1] == "text"
