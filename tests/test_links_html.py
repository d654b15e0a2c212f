"""Link scoring (F6-F8, P3-P6, A3) and HTML text extraction (F4, F5) edge cases."""

from pyspark.sql import functions as F

from conftest import col_values, one
from sifter.functions import constants as K
from sifter.functions import html as H
from sifter.functions import links as L


def _score(spark, url, anchor="short"):
    df = spark.createDataFrame([(url, anchor)], "u string, a string")
    return df.select(L.score_link("u", "a").alias("s")).first()["s"]


def test_every_skip_alternative_scores_zero(spark):
    urls = ["https://x.com/unsubscribe", "https://x.com/manage-preferences", "mailto:a@b.c",
            "https://twitter.com/a", "https://facebook.com/a", "https://instagram.com/a",
            "https://linkedin.com/share?x", "https://youtube.com/v", "https://t.co/x", "https://bit.ly/x",
            "https://us1.list-manage.com/a", "https://mailchimp.com/a", "https://campaign-archive.com/a",
            "https://x.com/view-in-browser", "https://x.com/privacy_policy", "https://x.com/terms-of-service",
            "https://x.com/a.PNG", "https://x.com/a.jpg", "https://x.com/a.gif", "https://x.com/a.svg"]
    assert len(urls) == len(K.LINK_SKIP_ALTERNATIVES)
    assert all(_score(spark, u) == 0.0 for u in urls)


def test_skip_domains_and_host_forms(spark):
    for d in K.LINK_SKIP_DOMAINS:
        assert _score(spark, f"https://{d}.example.com/a/b") == 0.0
    assert _score(spark, "https://EMAIL.MG.example.com/x") == 0.0            # host is lower-cased
    assert _score(spark, "https://user@Medium.com:443/a/b") == 0.5 + 0.2 + 0.1
    assert _score(spark, "https://x.com/a;params/b;p") == 0.5 + 0.2           # params only on the last segment
    assert _score(spark, "https://x.com/a;p/") == 0.5
    assert _score(spark, "https://x.com/a/b;p") == 0.5 + 0.2
    assert _score(spark, "https://x.com?q=/a/b") == 0.5                       # query only
    assert _score(spark, "http://[bad/x") == 0.0                              # unparsable host


def test_anchor_bonus_beats_path_plus_host(spark):
    assert _score(spark, "https://example.com/", "Read the full analysis") == 0.8
    assert _score(spark, "https://medium.com/p/1", "more") == 0.7999999999999999


def test_best_link_first_wins_on_ties(spark):
    html = ('<a href="https://a.com/x/y">aaaaaaaaaaaa</a><a href="https://b.com/x/y">bbbbbbbbbbbb</a>'
            '<a href="/rel">relative</a><a name="n">no href</a><!-- <a href="https://c.com/x/y">zzzzzzzzzzzzzz</a> -->')
    assert one(spark, L.best_link(F.col("x")), html) == "https://a.com/x/y"
    assert one(spark, L.best_link(F.col("x")), "<p>no links</p>") is None
    assert one(spark, L.best_link(F.col("x")), " <A HREF=' https://d.com/a/b '>x</A>") == "https://d.com/a/b"


def test_anchor_text_concatenates_stripped_strings(spark):
    got = one(spark, H.anchor_text(F.col("x")), '<a href="u"> Read <b>the</b>\n full </a>')
    assert got == "Readthefull"
    assert one(spark, H.anchor_href(F.col("x")), '<a href="https://x.com/?a=1&amp;b=2">t</a>') == \
        "https://x.com/?a=1&b=2"


def test_html_to_text_cases(spark):
    html = ('<html><head><title>T</title><style>p{}</style></head><body>'
            '<script>var t="</p>";</script><!-- hidden --><p>Hello &amp; <b>bold</b></p>'
            '<p>&copy; 2024&nbsp;x</p><p>​zw</p></body></html>')
    assert one(spark, H.html_to_text(F.col("x")), html) == "Hello &\nbold\n© 2024x\nzw"


def test_main_content_container_order_and_cap(spark):
    vals = ["<body><nav>n</nav><main>M</main><article>A</article></body>",
            "<body><main>M <footer>f</footer></main></body>",
            "<body>B<aside>s</aside></body>",
            "<p>loose</p>",
            "",
            "<article>" + "x" * 9000 + "</article>"]
    got = col_values(spark, H.main_content, vals)
    assert got[:5] == ["A", "M", "B", "loose", ""]
    assert len(got[5]) == K.ARTICLE_CHARS


def test_numeric_character_references(spark):
    html = "<p>a&#8217;s &#x27;q&#X27; &#65;&#65;</p><p>&#160;</p><p>x&#32;</p>&amp;#39; &#0; <a>&#x1F600;</a>"
    assert one(spark, H.html_to_text(F.col("x")), html) == "a’s 'q' AA\nx\n&#39; \ufffd\n😀"


def test_html_reading_by_hand(spark):
    """What a parser gives: dropped parts separate nodes, what opens first wins, quoted attributes, open ends, references."""
    cases = {
        "foo<!-- x -->bar": "foo\nbar", "foo<script>x</script>bar": "foo\nbar",
        "<script>var s='<!--';</script>text<!-- c -->end": "text\nend", "a<style>p{x} no end": "a",
        "<p title='a>b'>hi</p>": "hi", "caf&eacute; a&#10;b it&#146;s": "café a\nb it’s", "&copy b &notit; &bogus; x &": "© b ¬it; &bogus; x &",
        "&#38;lt; &amp;lt; &amp;amp;": "&lt; &lt; &amp;", "&#0; &#xD800; &#99999999; &#x80;": "\ufffd \ufffd \ufffd €",
        "cut &am": "cut &am", "pre&amp": "pre&"}
    got = col_values(spark, H.html_to_text, list(cases))
    assert dict(zip(cases, got)) == cases
    links = col_values(spark, lambda x: F.array_join(F.transform(H.anchors(x), H.anchor_href), "|"),
                       ['<a href="?a=1&#38;b=2">x</a><a name="n">no</a><a class="q>r" href=u>y</a>'])
    assert links == ["?a=1&b=2|u"]
