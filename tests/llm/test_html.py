from __future__ import annotations

import time

import pytest

from quaymark.llm import html_text as h

SCHEMA = "page_id long, url string, html string, host string, path string, text string"
PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body class='has-sidebar'>"
    "<header>Site</header><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='cookie-notice'>We use cookies</div><!-- <p>no</p> -->"
    "<div class=wrap><article id=a1><h1>Big &amp; small</h1><p>One\n  two <b>three<br>four</p><p>Five&nbsp;six<ul><li>x<li>y</ul>"
    "<div class='ad'>Buy</div><form>q<input></form><aside>side</aside><section class=comments><p>first!</p></section></article></div>"
    "<div class='sidebar'><p>More</p></div><footer>&copy; us</footer></body></html>"
)


def test_article_without_the_rest():
    assert h.main_text(PAGE) == "Big & small\n\nOne two three four\n\nFive six\n\nx\n\ny"


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""), ("", ""), ("<p>", ""), ("plain &lt;text&gt;", "plain <text>"), ("<p>a<p>b", "a\n\nb"), ("<p>x < y and 1<2</p>", "x < y and 1<2"),
        ("<div><p>a</p><p>b</p><script>", "a\n\nb"), ("<p title='a > b'>c</p>", "c"), ("<p>cut <b", "cut"), ("<<<>>><p>q</p>", "<<<>>>\n\nq"),
    ],
)
def test_pieces(html, text):
    assert h.main_text(html) == text


def test_long_hostile_pages_end():
    for html in ("<a" * 50_000, "<!--" * 50_000, "<p a=\"" * 30_000, "<div>" * 30_000 + "x", "&" * 100_000, "<script>" * 20_000):
        h.main_text(html)


def pages(spark, rows):
    return spark.createDataFrame([(i, u, t, "h", "p", "t") for i, u, t in rows], SCHEMA)


def test_hosts_agree_on_a_path(spark):
    def page(body, other="<div class='x2'><p>few words</p></div>"):
        return f"<html><body><div class='post{len(body)}'><p>{body}</p></div>{other}</body></html>"

    odd = page("tiny", "<div class='x7'><p>a much longer block of other text than the post has</p></div>")
    rows = [(i, f"https://a.org/{i}", page("some longer text of the post here " * 3)) for i in range(4)] + [(9, "https://A.org/9", odd)]
    found = {r["page_id"]: r["text"] for r in h.extract(pages(spark, rows)).collect()}
    assert found[9] == "tiny"
    assert h.main_text(odd).startswith("a much longer")


LONG, SHORT = "one long paragraph of many words " * 20, "a short one"


@pytest.mark.parametrize(
    "html, texts",
    [
        (f"<body><div id=content><h1>Head</h1><p>{LONG}</p><p>{SHORT}</p></div><footer>us</footer></body>", ["Head", LONG.strip(), SHORT]),
        (f"<body><ul><li>{LONG}</li><li>{SHORT}</li></ul><blockquote>q</blockquote></body>", [LONG.strip(), SHORT, "q"]),
        (f"<body><div><h1>Head</h1></div><div><p>{LONG}</p></div><div class=ad>buy</div></body>", ["Head", LONG.strip()]),
        (f"<table><tr><td><p>{LONG}</p></td><td>{SHORT}</td></tr></table>", [LONG.strip(), SHORT]),
        (f"<body><a name=top><h1>Head</h1><p>{LONG}</p><p>{SHORT}</p></body>", ["Head", LONG.strip(), SHORT]),
        ("<body><a href='/x'><h1>Head</h1><p>b</p><div><p>c</p></div></body>", ["Head", "b", "c"]),
    ],
)
def test_pages_without_article_lose_no_text(html, texts):
    assert h.main_text(html) == "\n\n".join(texts)


@pytest.mark.parametrize(
    "html, texts",
    [
        (f"<body><div class='content with-sidebar'><h1>Head</h1><p>{LONG}</p></div></body>", ["Head", LONG.strip()]),
        (f"<body><nav>m</nav><div class='share-story related-body'><p>{LONG}</p><p>{SHORT}</p></div><div class=sidebar>s</div></body>", [LONG.strip(), SHORT]),
        (f"<article class='post sidebar-right'><p>{LONG}</p></article><section id=comments><p>{LONG * 3}</p></section>", [LONG.strip()]),
        (f"<div class=text><p>{LONG}</p></div><div class='post-comments'><article class=comment><p>{LONG * 3}</p></article></div>", [LONG.strip()]),
        (f"<body><div class='layout sidebar'><main><p>{LONG}</p></main></div><div class=ad>{SHORT}</div></body>", [LONG.strip()]),
        (f"<body><article><p>{LONG}</p></article><article><p>{LONG[:300]}</p></article><div class=promo>x</div></body>", [LONG.strip(), LONG[:300].strip()]),
        (f"<body><div class=intro><p>{LONG}</p></div><div class=rest><p>{LONG[:300]}</p></div></body>", [LONG.strip(), LONG[:300].strip()]),
        ("<article></article><div class='cookie-notice'>We use cookies</div>", []),
    ],
)
def test_class_words_drop_no_main_text(html, texts):
    assert h.main_text(html) == "\n\n".join(texts)


def test_depth_has_no_limit():
    deep = "<div>" * 2000 + "<nav>menu</nav><p>text</p>" + "</div>" * 2000
    assert h.main_text(f"<body>{deep}<footer>f</footer></body>") == "text"
    assert h.main_text("<div>" * 2000 + "<ul class=menu><li>menu</ul><p>text</p>") == "text"


def test_extract_equals_a_plain_reading(spark, pages_sample):
    """Against a reader of its own kind: the article of well-formed pages by an HTML parser."""
    from html.parser import HTMLParser

    inline = {"b", "i", "em", "strong", "a", "span", "code", "u", "sup", "sub", "small"}

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.depth = self.skip = 0
            self.blocks, self.text = [], ""

        def cut(self):
            if text := " ".join(self.text.split()):
                self.blocks.append(text)
            self.text = ""

        def handle_starttag(self, tag, attrs):
            if tag == "br":
                self.text += " "
                return
            if tag not in inline:
                self.cut()
            if tag == "article":
                self.depth += 1
            names = dict(attrs).get("class") or ""
            if self.skip or tag in ("script", "style", "nav", "aside", "form", "footer") or any(w in h.PASSED_WORDS for w in names.split()):
                self.skip += tag not in h.VOID

        def handle_endtag(self, tag):
            if tag not in inline:
                self.cut()
            if self.skip:
                self.skip -= 1
            elif tag == "article":
                self.depth -= 1

        def handle_data(self, data):
            if self.depth and not self.skip:
                self.text += data

    want = {}
    for row in pages_sample.select("page_id", "html").collect():
        if row["html"] and row["html"].count("<article") == row["html"].count("</article>") == 1:
            reader = Reader()
            reader.feed(row["html"])
            want[row["page_id"]] = "\n\n".join(reader.blocks)
    found = {r["page_id"]: r["text"] for r in h.extract(pages_sample).collect()}
    assert len(want) >= 30
    differ = [i for i, text in want.items() if text != found[i]]
    assert not differ, differ[:10]


def test_hosts_never_vote_for_one_paragraph(spark):
    lone = f"<html><body><div><p>{LONG}</p></div></body></html>"
    full = f"<html><body><div><h2>Head</h2><p>{SHORT}</p><ul><li>item</li></ul></div></body></html>"
    rows = [(i, f"https://b.org/{i}", lone) for i in range(3)] + [(9, "https://b.org/9", full)]
    found = {r["page_id"]: r["text"] for r in h.extract(pages(spark, rows)).collect()}
    assert found[9] == f"Head\n\n{SHORT}\n\nitem" and found[0] == LONG.strip()


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "no host", ""), (None, "http://h/", PAGE), (3, "http://h/x", PAGE), (3, "http://h/x", PAGE)]
    found = h.extract(pages(spark, rows)).collect()
    assert len(found) == 5 and all(r["n_chars"] == len(r["text"]) for r in found)
    assert sum(r["text"].startswith("Big") for r in found) == 3
    assert h.extract(pages(spark, [])).count() == 0


LONG_TEXT = "Some sentences of the article that go on for a while, one after the other. " * 8


@pytest.mark.parametrize(
    "page",
    [
        "<form id=aspnetForm><div><article><p>{}</p></article></div></form>", "<div role=dialog><p>{}</p></div>", "<aside><p>{}</p></aside>",
        "<iframe src=x><div><p>{}</p></div>", "<object data=x><p>{}</p>", "<select><option>a<p>{}</p>", "<head><title>x<body><p>{}</p>", "<svg><g><div>{}</div>",
    ],
)
def test_no_page_is_lost(page):
    assert " ".join(LONG_TEXT.split()) in h.main_text(page.format(LONG_TEXT))


def test_forms_and_asides_beside_the_text_stay_out():
    page = f"<article><p>{LONG_TEXT}</p></article><aside><p>aside words</p></aside><form><p>form words</p></form><div role=complementary>more words</div>"
    assert h.main_text(page) == " ".join(LONG_TEXT.split())
    assert h.main_text("<nav>one two</nav><form><label>a</label>name</form><footer>" + LONG_TEXT + "</footer>") in ("", "name")


def test_a_host_path_with_little_of_the_page_is_not_used():
    page = f"<div class=a><p>{'short text here. ' * 5}</p></div><div class=b><p>{LONG_TEXT}</p></div>"
    assert " ".join(LONG_TEXT.split()) in h.main_text(page, ">div.a")


@pytest.mark.parametrize("text", ["<script" * 50_000, "<script " * 50_000, "<iframe>" * 50_000, "<iframe><p>" * 30_000, "<title>" * 50_000 + "x", "<svg" * 50_000])
def test_raw_elements_that_never_end_are_linear(text):
    start = time.perf_counter()
    h.main_text(text)
    assert time.perf_counter() - start < 10
