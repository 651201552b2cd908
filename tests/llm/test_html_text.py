import html
import re
import tracemalloc

from wardline.llm import html_text as H

LONG = "This is a rather long sentence, with several words; it ends here. "


def test_given_pages_give_their_articles(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = H.op10(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", article)
        plain = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in blocks)
        assert r["text"] == "\n".join(p for p in plain if p) and r["n_chars"] == len(r["text"])


def test_parts_that_are_not_the_article():
    page = f"""<html><head><title>T</title><style>p{{}}</style></head><body>
      <header><p>{LONG}</p></header><div class="cookie-notice"><p>{LONG * 3}</p></div>
      <nav><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></nav>
      <div id=main><aside><p>{LONG}</p></aside><div class="post-body"><h1>Title &amp; more</h1>
      <p>{LONG}<b>bold <i>both</b> after</i><p>Short.
      <ul><li>{LONG}<li>Item two</ul><form><p>{LONG}</p></form><script>document.write("<p>no</p>")</script>
      <blockquote>Quote&nbsp;here</blockquote></div>
      <section id="comments"><p>{LONG * 2}</p><p>{LONG * 2}</p></section></div>
      <div class=sidebar><p>{LONG}</p></div><footer>(c) {LONG}</footer></body></html>"""
    long = LONG.strip()
    assert H.extract(page) == f"Title & more\n{long} bold both after\nShort.\n{long}\nItem two\nQuote here"


def test_odd_pages():
    assert H.extract(None) == H.extract("") == H.extract("  <p> </p>") == ""
    assert H.extract("plain text only") == "plain text only"
    assert H.extract("<article><p>a < b and c</p></article>") == "a < b and c"
    assert H.extract("<article><p>x</p><!-- open <p>y</p>") == "x"
    assert H.extract("<article><p>x<script>var a = 1;") == "x"
    assert H.extract("<article><p>" + "deep <div>" * 3000 + "end</article>").endswith("end")
    assert len(H.extract("<article><p>" + LONG * 20_000 + "</article>")) == len((LONG * 20_000).strip())


def test_table_with_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "<article>x</article>", "old"), (2, None, None)], "page_id bigint, html string, text string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in H.texts(pages).collect()}
    assert got == {1: ("x", 1), 2: ("", 0)}
    assert H.texts(pages.limit(0)).count() == 0


def test_all_sections_of_an_article_are_kept():
    short, long = LONG.strip(), (LONG * 3).strip()
    for whole in ("article", "div"):
        page = f"<body><{whole}><h1>Title</h1><section><p>{long}</p></section><section><p>{short}</p></section></{whole}><footer>x</footer></body>"
        assert H.extract(page) == f"Title\n{long}\n{short}"
    for part in ("div", "ul", "blockquote", "table"):
        page = f"<body><article><h1>Title</h1><{part}>{long}</{part}><p>{short}</p></article></body>"
        assert H.extract(page) == f"Title\n{long}\n{short}"
    page = f"<body><div><p>Intro.</p><ul><li>{long}<li>{long}</ul><p>End.</p></div><div><a href=x>Next page</a></div></body>"
    assert H.extract(page) == f"Intro.\n{long}\n{long}\nEnd."


def test_text_right_in_the_body_is_kept_whole():
    text = ("word " * 58 + "a, b, c; d: e.").ljust(300, "x")
    nav = "<nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav>"
    lines = "\n".join([text] * 8)
    assert H.extract(f"<body>{nav}<h1>A title</h1>{f'<p>{text}</p>' * 8}</body>") == f"A title\n{lines}"
    menu = "<div><a href=a>First page</a></div><div><a href=b>Second page</a></div>"
    page = f"<body>{menu}<div><h1>A title</h1></div><div>By X</div>{f'<p>{text}</p>' * 8}<p>Short.</p><ul><li>Item</ul><h2>End</h2><p>Bye.</p>{menu}</body>"
    assert H.extract(page) == f"A title\nBy X\n{lines}\nShort.\nItem\nEnd\nBye."


def test_marks_never_take_the_article():
    text = LONG.strip()
    inner = f"<h1>Title</h1><p>{LONG}</p><p>{LONG}</p>"
    want = f"Title\n{text}\n{text}"
    nav = "<nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav><div class=sidebar><p>Aside.</p></div>"
    for around in ("div class='site has-sidebar'", "div class='post comments-open'", "div id='ad-free-content'", "div class='no-share'", "form action=x",
                   "section class=widget", "div role=dialog"):
        for whole in ("article", "main", "div class=post"):
            page = f"<body><{around}>{nav}<{whole}>{inner}</{whole.split()[0]}><footer>(c)</footer></{around.split()[0]}></body>"
            assert H.extract(page) == want, page
        assert H.extract(f"<body><{around}>{inner}</{around.split()[0]}>{nav}</body>") == want
    halves = f"<div class=no-share><p>{LONG}</p></div>" * 2
    assert H.extract(f"<body>{halves}</body>") == f"{text}\n{text}"


def test_long_comments_and_teasers_stay_out():
    text = LONG.strip()
    for tag in ("article", "article class=comment-body"):
        comments = f"<section id=comments>{f'<{tag}><p>No.</p></article>' * 3}</section>"
        assert H.extract(f"<body><article><p>{LONG * 2}</p><p>{LONG}</p></article>{comments}</body>") == f"{(LONG * 2).strip()}\n{text}"
    comments = f"<section id=comments>{f'<p>{LONG}</p>' * 6}</section>"
    assert H.extract(f"<body><article><p>{LONG}</p><p>{LONG}</p></article>{comments}</body>") == f"{text}\n{text}"


def test_deep_nesting_takes_memory_in_proportion():
    def peak(depth):
        tracemalloc.start()
        assert H.extract("<article>" + "<div>" * depth + LONG + "</div>" * depth + "</article>") == LONG.strip()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    assert peak(16_000) < 2.5 * peak(8_000)
