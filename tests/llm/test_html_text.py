import html
import re

import pyarrow.parquet as pq

from tallycast.llm import html_text as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head>
<body class="has-sidebar"><header><h1>Site name, of the site, and more words here to be long</h1></header><nav><ul><li><a href=x>Menu entry</a></li></ul></nav>
<div class="ad">Buy this thing, it is cheap, and also very good for you and me.</div><div id=wrap><div class="post">
<h1>Title &amp; more</h1><p>First   paragraph, with a <a href="/l">link</a>,
and <b>bold</b>&nbsp;text&#33; It is long enough to count.</p><p>Second one, also long, with commas, so that it counts<br>here.<ul><li>One item<li>Two</ul>
<table><tr><td>cell<td>other</table></div><aside>Aside text, which is long enough to earn points, if counted.</aside>
<p>A sibling paragraph that stands beside the best container and has no links in it at all, so it stays, too.</p>
<div class="related">Related: <a href=a>this, that, these, those, and many others that are linked here</a></div></div>
<div id="comments"><p>A reader comment, quite long, with many commas, here, here, and here, to earn points. And more of it, more, more.</p></div>
<form><label>Name, first, last, and any other names you have got</label><input></form><footer>&copy; Foot, note, and so on, to be long</footer></body></html>"""


def test_page_of_divs():
    assert H.main_text(PAGE).split("\n") == [
        "Title & more", "First paragraph, with a link, and bold text! It is long enough to count.",
        "Second one, also long, with commas, so that it counts here.", "One item", "Two", "cell", "other",
        "A sibling paragraph that stands beside the best container and has no links in it at all, so it stays, too."]


def test_article_is_whole_and_menus_inside_are_dropped():
    page = """<body><article><h1>Head</h1><div class="body"><p>Long paragraph, with commas, and commas, and more of them, to win.</p></div>
    <nav>menu</nav><section><p>Short.</p></section><div class="comments"><p>no</p></div></article><article class="comment"><p>Comment, long, long, long enough to be counted.</p></article></body>"""
    assert H.main_text(page) == "Head\nLong paragraph, with commas, and commas, and more of them, to win.\nShort."


def test_odd_pages():
    assert H.main_text(None) == H.main_text("") == H.main_text(" \n") == H.main_text("<script>x") == H.main_text("<nav>a</nav>") == ""
    assert H.main_text("just text &lt;b&gt; here") == "just text <b> here"
    assert H.main_text("<p>short") == "short"
    assert H.main_text("<!-- never closed <p>gone</p>") == ""
    assert H.main_text('<a title="x > y">in</a> <b a=\'q" <i>it</i>') != ""
    assert H.main_text("a < b and c > d <p>x") == "a < b and c > d\nx"
    assert H.main_text("<form><article><p>page in a form</p></article></form>") == "page in a form"
    assert len(H.main_text("<div>" * 20000 + "deep text that is long enough" + "</div>" * 20000)) == 29
    assert H.main_text("<p>" + "word, " * 200_000 + "</p>").count("word,") == 200_000


def test_given_pages_give_their_articles():
    rows = pq.read_table("/root/testdata/sf0.001/pages.parquet").to_pylist()
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert H.main_text(r["html"]) == "\n".join(b for b in blocks if b)


def test_table_with_nulls_and_clashing_columns(spark):
    rows = [(1, "u", "<p>a", "t"), (1, "u", "<p>a", "t"), (None, None, None, None)]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((str(r.page_id), str(r.url), r.text, r.n_chars) for r in got) == [("1", "u", "a", 1), ("1", "u", "a", 1), ("None", "None", "", 0)]
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_wrappers_with_hints_keep_the_text_they_hold():
    body = "<p>First paragraph, with commas, and enough words, to earn points.</p><p>Second paragraph, with commas, and more words, to earn points too.</p>"
    text = "First paragraph, with commas, and enough words, to earn points.\nSecond paragraph, with commas, and more words, to earn points too."
    side = '<div class="sidebar"><p>Side text, with commas, and so on, of some length.</p></div>'
    for start, end in (('<div class="content has-sidebar">', "</div>"), ("<form>", "</form>"), ('<div id="page-header-related">', "</div>"), ('<form><div class="widget">', "</div></form>")):
        assert H.main_text(f"<body><nav>menu</nav>{start}{body}{side}{end}<footer>foot</footer></body>") == text
    three = [f'<div class="widget"><p>Part {k}, of a page, all of which stands in parts like this.</p></div>' for k in range(3)]
    assert "Part 1, of a page" in H.main_text("<body>" + "".join(three) + "</body>")
    many = "".join(f'<div class="comment"><p>Comment {k}, with commas, and enough words, to earn points.</p></div>' for k in range(20))
    assert H.main_text(f'<body><div class="post">{body}</div><div id="comments">{many}</div></body>') == text


BODY = "<p>First paragraph, with commas, and enough words, to earn points.</p><p>Second paragraph, with commas, and more words, to earn points too.</p>"
TEXT = "First paragraph, with commas, and enough words, to earn points.\nSecond paragraph, with commas, and more words, to earn points too."


def test_words_inside_other_attributes_say_nothing():
    for start in ('<article title="The hidden valley">', '<article onclick="show(hidden)" data-id=related>', "<article data-x='class=ad' alt=\"id='menu'\">"):
        assert H.main_text(f"<body>{start}{BODY}</article></body>") == TEXT
    for start in ('<div title="Hidden treasures of Rome">', '<div data-hidden="false" data-id="related">', "<div data-class=ad aria-label='comments'>", "<div hiddenness=1 xclass='nav'>"):
        assert H.main_text(f"<body><div>{start}{BODY}</div></div></body>") == TEXT
    page = f'<body><div>{BODY}<p>See <a href="/blog/hidden-gems">our guide</a> <a href="?id=ad&class=menu">now</a>.</p></div></body>'
    assert H.main_text(page) == TEXT + "\nSee our guide now."
    assert H.main_text(f'<body><div>{BODY}<p data-hidden="false">Kept.</p><p data-role="navigation" style="color:red">Kept too.</p></div></body>') == TEXT + "\nKept.\nKept too."
    assert H.main_text(f'<body><div>{BODY}<p hidden>No.</p><p class=x HIDDEN="">No.</p><p style="display : none">No.</p></div></body>') == TEXT


def test_compound_classes_inside_the_text_stay():
    inside = '<h2 class="section-header">Part two</h2><p class="market-share">Share of 5 %.</p><div class="related-work"><p>Work.</p></div><div class="replying formation">Also.</div>'
    want = TEXT + "\nPart two\nShare of 5 %.\nWork.\nAlso."
    for start, end in (("<article>", "</article>"), ('<div class="post">', "</div>"), ('<main class="has-sidebar">', "</main>")):
        assert H.main_text(f"<body>{start}{BODY}{inside}{end}</body>") == want
    passage = "<div class=\"header\"><p>A standfirst that tells at some length, in more than eighty characters, what the article is about.</p></div>"
    assert H.main_text(f"<body><article>{passage}{BODY}</article></body>").startswith("A standfirst")


def test_parts_that_are_no_text_go_by_whole_names():
    for name in ("ad", "ad-container", "cookie-banner", "siteFooter", "comment_list", "sidebar-left", "newsletter-box", "main-nav", "share-buttons", "related"):
        apart = f'<div class="{name}"><a href=a>Some words</a>, and others, that are no text.</div>'
        for side in (f"<div class=post>{BODY}</div>{apart}", f"{apart}<article>{BODY}{apart}</article>", f"<div id=x>{BODY}{apart}</div>"):
            assert H.main_text(f"<body>{side}</body>") == TEXT, name
    many = "".join(f"<li><a href={k}>A linked title of some length, number {k}, which goes on and on and on and on and on</a></li>" for k in range(3))
    assert H.main_text(f"<body><article>{BODY}<ul class='related links'>{many}</ul></article></body>") == TEXT
