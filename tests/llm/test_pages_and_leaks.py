"""HTML extraction by hand-written pages, decontamination with planted passages, and the pipeline."""

import random

import pytest

from sifter.llm import decontam, html_density
from sifter.llm.common import prepare
from tests.llm.helpers import edge_docs, empty_docs, prose


@pytest.fixture(autouse=True)
def _prepared(spark):
    prepare(spark)


PAGES = [
    (None, ""), ("", ""), ("just text", "just text"),
    ("<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>A</a></li>"
     "</ul></nav><!-- <p>no</p> --><div class=\"ad\">Buy now</div><article><h1>Head &amp; more</h1><p><b>One\n  two<br><p>Three&nbsp;"
     "caf&eacute; &#8364; &#x41;</p></article><footer>&copy; x</footer></body></html>", "Head & more\nOne two\nThree café € A"),
    ("<body><div id=main><header><a href=/>Site</a></header><div class='post'><h2>Title</h2><p>First paragraph of the text.</p>"
     "<ul><li>point one<li>point two</ul><blockquote>Quoted words here</blockquote><table><tr><td>a</td><td>b</td></tr></table></div>"
     "<div class='sidebar widget'><p>Latest posts and other things to read</p></div><section id='comments'><p>I do not agree at all"
     " with this article, it is wrong</p></section><form><p>Search</p><input></form><div class=cookie-notice>We use cookies</div></div>",
     "Title\nFirst paragraph of the text.\npoint one\npoint two\nQuoted words here\na\nb"),
    ("<article><p>cut off at the en</p><p>last &am</p><di", "cut off at the en\nlast &am"),
    ("<article><p title='a > b'>kept</p><p>x<script>if (a<b) {}</script>y</p></article>", "kept\nxy"),
    ("<body><p>   \n </p></body>", ""),
]


def test_pages_by_hand(spark):
    rows = [(i, f"http://x/{i}", h, "clash") for i, (h, _) in enumerate(PAGES)] * 2
    got = html_density.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id, r.url, r.text, r.n_chars) for r in got) == sorted(
        [(i, f"http://x/{i}", t, len(t)) for i, (_, t) in enumerate(PAGES)] * 2)
    assert html_density.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_density_drops_what_lies_outside():
    links = "".join(f"<p><a href='/{i}'>some other story number {i}</a></p>" for i in range(10))
    body = "".join(f"<p>{'plain words of the story ' * 8}{i}</p>" for i in range(6))
    text = html_density.main_text(f"<body><div>{links}</div><div><h1>Story</h1>{body}</div></body>")
    assert text.startswith("Story\nplain words") and "other story" not in text and text.count("\n") == 6


def test_names_do_not_cut_the_article():
    body = "".join(f"<p>{'plain words of the story ' * 8}{i}</p>" for i in range(6))
    text = "\n".join(f"{'plain words of the story ' * 8}{i}" for i in range(6))
    for name in ("content has-sidebar", "no-sidebar", "with-comments", "ad-free", "promo"):
        assert html_density.main_text(f"<body><div class='{name}'>{body}</div><div class='sidebar'><p>Latest posts</p></div></body>") == text
    assert html_density.main_text(f"<body><form id=f><nav>Menu</nav><div>{body}</div><div class=ad>Buy</div></form></body>") == text
    assert html_density.main_text(f"<body><form>{body}</form></body>") == text
    assert html_density.main_text(f"<article><header class='entry-header'><h1>Title</h1></header>{body}</article>") == "Title\n" + text
    assert html_density.main_text(f"<article><section>{body}</section><section class='discussion'>{body}</section></article>") == f"{text}\n{text}"
    replies = f"<section class='comments'>{body}{body}</section>"
    assert html_density.main_text(f"<body><article>{body}</article>{replies}</body>") == text
    assert html_density.main_text("<body><p>A short text of the page</p><form><p>Search</p></form></body>") == "A short text of the page"


def test_raw_ends_after_letters_that_grow():
    assert html_density.main_text(f"<article><p>{'İ' * 40}</p><script>var a</SCRIPT><p>kept</p></article>") == "İ" * 40 + "\nkept"


def test_long_page():
    body = "".join(f"<p>{'word ' * 50}{i}</p>" for i in range(3000))
    assert html_density.main_text(f"<body><article>{body}</article></body>").count("\n") == 2999
    assert html_density.main_text("<div>" * 5000 + "deep text" + "</div>" * 5000) == "deep text"


def _edited(rng, text, k):
    out = list(text)
    for _ in range(k):
        at, how = rng.randrange(len(out)), rng.random()
        if how < 0.34:
            out[at] = "q"
        elif how < 0.67:
            out.insert(at, "q")
        else:
            del out[at]
    return "".join(out)


def test_planted_passages(spark):
    rng = random.Random(9)
    words = [f"{a}{b}" for a in "bcdfghklmnprst" for b in ("ala", "ero", "inu", "ost", "ume", "ati")]
    text = lambda n: prose(rng, n, words)
    items = [(i, text(rng.randint(12, 60))) for i in range(30)] + [(30, None), (31, ""), (32, "too short"), (33, "copy " * 12), (34, "copy " * 12)]
    docs, planted = [], set()
    for i in range(30):
        docs.append((i, text(200)))
        passage = items[i][1]
        where = [passage, passage.upper(), " \n ".join(passage.split()), _edited(rng, passage, 3)][i % 4]
        docs.append((100 + i, f"{text(60)} {where} {text(60)}"))
        planted.add((100 + i, i))
    docs += [(200, None), (201, ""), (202, "too short"), (203, items[0][1]), (203, items[0][1]), (204, "x " + "copy " * 12),
             (None, items[1][1]), (205, text(20_000) + " " + items[2][1] + " " + text(10))]
    planted |= {(203, 0), (204, 33), (204, 34), (-1, 1), (205, 2), (202, 32)}
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block_chars in (1 << 21, 2000):
        got = decontam.leaks(df, bench, block_chars).collect()
        assert {(-1 if r.doc_id is None else r.doc_id, r.item_id) for r in got} == planted
        assert sum(r.doc_id == 203 for r in got) == 2 and all(0 < r.coverage <= 1 for r in got)
    clean = decontam.keep_clean(df.selectExpr("doc_id", "text", "'c' block"), bench).collect()
    assert sorted(r.doc_id for r in clean) == [*range(30), 200, 201]
    assert decontam.leaks(empty_docs(spark), bench).count() == 0
    assert decontam.leaks(edge_docs(spark), bench.where("false")).count() == 0


def test_short_items_as_whole_words(spark):
    """Items under MIN_CHARS: exact, whole words, white space and case made even; nothing else."""
    items = [(1, "Short item"), (2, "short  ITEM"), (3, "item"), (4, "(a+b)"), (5, "x"), (6, "漢字")]
    docs = [(10, "a short\nitem here"), (11, "short items"), (12, "ashort item"), (13, "say (a+b)c"), (14, "shor titem"), (15, "x-ray"), (16, "max"),
            (17, "short, item"), (18, "漢字"), (19, "漢字典"), (20, None), (21, "")]
    expect = {(10, 1), (10, 2), (10, 3), (12, 3), (13, 4), (15, 5), (17, 3), (18, 6)}

    def whole(item, text):
        item, text = decontam.normal(item), decontam.normal(text)
        return any(text[a:a + len(item)] == item and not (a and text[a - 1].isalnum() and item[0].isalnum())
                   and not (text[a + len(item):][:1].isalnum() and item[-1].isalnum()) for a in range(len(text) - len(item) + 1))

    assert {(d, i) for d, t in docs for i, x in items if whole(x, t)} == expect
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontam.leaks(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == expect and all((r.edits, r.coverage) == (0, 1.0) for r in got)
    assert {r.doc_id for r in decontam.keep_clean(df, bench).collect()} == {d for d, _ in docs} - {d for d, _ in expect}


def test_windows_within_budget_are_found():
    """Against plain edit distance: every window within its budget, none beyond it."""
    rng = random.Random(2)
    base = "".join(rng.choice("abcdefghij ") for _ in range(96)).strip().ljust(96, "z")
    block = decontam.Block([(1, base)])

    def distance(p, t):
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(t, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        return min(row)

    pattern = decontam.normal(base)
    for k in range(0, 12):
        for _ in range(10):
            text = "yyyy yyyy " + _edited(rng, base, k) + " xxxx xxxx"
            d = distance(pattern, decontam.normal(text))
            got = block.matches([text])
            assert ([x[3] for x in got] == [d]) == (d <= 6), (k, d, got)


def test_pipeline_stages(spark):
    import corpus_pipeline as P
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [decontam.normal(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    seen = [docs]
    for name, stage in P.STAGES:
        docs = stage(spark, docs, sf)
        seen.append(docs)
        assert name == P.STAGES[-1][0] or docs.columns == seen[0].columns
    ids = [{r.doc_id for r in x.select("doc_id").collect()} for x in seen]
    assert ids[0] > ids[1] >= ids[2] > ids[3] == ids[4] and len(ids[1]) >= 0.95 * len(ids[0])
    text = {r.doc_id: decontam.normal(r.text) for r in seen[0].collect()}
    dirty = {d for d in ids[2] if any(b in text[d] for b in bench)}
    assert dirty and ids[2] - ids[3] >= dirty and not any(b in text[d] for d in ids[3] for b in bench)
    ran = P.run(spark, sf)
    assert {r.doc_id for r in ran.collect()} == ids[3]
