"""Leaf blocks against the standard library's parser, broken and deep markup, and the query on planted pages."""

import random
import re
import time
from html.parser import HTMLParser

import pytest

from lithoframe.llm import html_blocks as hb


class Leaves(HTMLParser):
    """Text between block tags of well-formed pages, one entry a block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.now, self.skip = [], [], 0

    def flush(self):
        if t := " ".join("".join(self.now).split()):
            self.out.append(t)
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag in hb.BLOCKS or tag in ("script", "style"):
            self.flush()
        self.skip += tag in ("script", "style")
        if tag == "br":
            self.now.append(" ")

    def handle_endtag(self, tag):
        if tag in hb.BLOCKS:
            self.flush()
        self.skip -= tag in ("script", "style")

    def handle_data(self, data):
        if not self.skip:
            self.now.append(data)


def random_page(r, depth=0):
    out = []
    for _ in range(r.randrange(1, 5)):
        x = r.random()
        text = " ".join(r.choice(["one", "two &amp; two", "a &lt; b", "caf&eacute;", "3 > 2", "x&#8211;y", "zwei\n"]) for _ in range(r.randrange(0, 6)))
        if x < 0.35 and depth < 12:
            tag = r.choice(["div", "section", "article", "ul", "blockquote", "main"])
            out.append(f'<{tag} class="a b">{random_page(r, depth + 1)}</{tag}>')
        elif x < 0.6:
            out.append(f"<p title='a > b'>{text}</p>")
        elif x < 0.7:
            out.append("<script>if (a < b) { x('<p>no') }</script>")
        elif x < 0.8:
            out.append(f"<!-- no <p> {text} -->")
        else:
            out.append(f"<b>{text}</b><br>{text}<i> t</i>")
    return "".join(out)


def test_blocks_equal_the_standard_parser():
    r = random.Random(12)
    for _ in range(400):
        page = f"<!DOCTYPE html><html><body>{random_page(r)}</body></html>"
        want = Leaves()
        want.feed(page)
        want.close()
        want.flush()
        assert [t for _, t, _ in hb.blocks(page)] == want.out


@pytest.mark.parametrize(
    "page",
    ["<a " * 350_000, '<a x=">" ' * 100_000, "<div>" * 100_000 + "x", "<p><object>" + "<div>t" * 20_000 + "</b>" * 20_000, "<script>" + "</script " * 100_000, "<!--" * 100_000, "</x>" * 100_000, '<a "' * 99_999 + ">", "<" * 1_000_000],
)
def test_broken_markup_takes_linear_time(page):
    t = time.process_time()
    hb.blocks(page)
    assert time.process_time() - t < 4


def test_paths_hold_every_open_element():
    deep = "<div>" * 3 + '<aside class="sidebar">' + "<div><span>" * 40 + "words" + "</span></div>" * 40 + "</aside>"
    (path, text, _), *rest = hb.blocks(f"<body><article>{deep}<p>rest</article></body>")
    assert text == "words" and {hb._bucket("aside"), hb._bucket(".sidebar"), hb._bucket("article")} <= set(path)
    assert hb._bucket("aside") not in rest[0][0]


def test_markup_that_pages_leave_out():
    assert [t for _, t, _ in hb.blocks("<head><title>x</title><p>one<p>two<div>three</div>")] == ["one", "two", "three"]
    assert [t for _, t, _ in hb.blocks("<head><meta a>text<p>one")] == ["text", "one"]
    assert [t for _, t, _ in hb.blocks("<p>a <math><mi>x</mi><mo>=</mo></math> <svg><text>b</text></svg> c<p>d < e")] == ["a x= b c", "d < e"]
    assert [t for _, t, _ in hb.blocks("<table><tr><td><p>a<td>b</table><p>c<textarea>no</textarea>d<select><option>no</select>")] == ["a", "b", "cd"]
    assert [t for _, t, _ in hb.blocks('<p title="x>y">a<p title="never closed>b</p>c')] == ["a", "b", "c"]
    assert hb.blocks("") == [] and hb.blocks("<p>&nbsp;</p>") == []


def test_query_on_planted_pages(spark):
    """The article and nothing else, at any depth, in very long pages, and with columns that clash."""
    body = "".join(f"<p>Sentence number {i} tells a quiet story about rivers, bridges and towns.</p>" for i in range(30))
    want = "\n\n".join(re.findall("<p>(.*?)</p>", body))
    long = "".join(f"<p>Paragraph {i} goes on with the same long report, line after line of it.</p>" for i in range(8000))
    wrap = lambda s: '<div class="wrapper"><div class="page"><div class="row">' * 3 + s + "</div></div></div>" * 3
    nav, foot = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li></ul></nav>', "<footer>&copy; 2020 somebody</footer>"
    pages = [
        (1, "u", f"<html><body>{nav}<article>{body}</article>{foot}</body></html>", 7, "x"),
        (2, None, f"<html><body>{nav}{wrap('<article>' + body + '</article>')}{foot}</body></html>", 7, "x"),
        (3, "u", f"<html><body>{nav}<article>{long}</article>{foot}</body></html>", 7, "x"),
        (4, "u", None, 7, None), (None, None, "", None, None), (1, "u", f"<html><body>{nav}<article>{body}</article>{foot}</body></html>", 7, "x"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, n_chars int, text string")
    got = hb.extracted(df).collect()
    assert len(got) == 6
    by = {r.page_id: r for r in got}
    assert by[1].text == by[2].text == want and by[3].text == "\n\n".join(re.findall("<p>(.*?)</p>", long))
    assert by[4].text == by[None].text == "" and by[4].n_chars == 0 and all(r.n_chars == len(r.text) for r in got)
    assert hb.extracted(df.limit(0)).count() == 0
