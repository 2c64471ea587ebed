"""Page text, links and titles next to plain patterns that may look ahead again and again."""

import html
import random
import re
import time

import pytest

from ledgerlint.llm import warc

HIDDEN = re.compile(r"(?is)<!--.*?-->|<(script|style|noscript|template)\b[^>]*>.*?</\1\s*>|<head\b[^>]*>.*?</head\s*>")
TITLE = re.compile(r"(?is)<title[^>]*>(.*?)</title\s*>")
LINK = re.compile(r"""(?i)<(a|img|link|script|iframe)\b[^>]*?\s(href|src)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""")
PARTS = ["<!--", "-->", "<script>", "<script x=1", "</script>", "</SCRIPT >", "<style", "</style>", "<head>", "</head>", "<title>", "<title",
         "</title>", "<a ", "<a href=x>", " href='y z'", " src=\"a>b\"", " href=", ">", "<", "text", " ", "\n", "<p>", "</p", "<br/>", "&amp;", "<header>",
         "<noscript>", "</noscript>", "<img src=i", "\"", "'"]


def plain_text(page):
    text = warc.TAG.sub("", warc.BREAKS.sub("\n", HIDDEN.sub(" ", page)))
    return warc.LINES.sub("\n", warc.RUNS.sub(" ", html.unescape(text))).strip()


def test_pages_equal_plain_patterns():
    rng = random.Random(7)
    for _ in range(6000):
        page = "".join(rng.choices(PARTS, k=rng.randint(0, 25)))
        assert warc.page_text(page) == plain_text(page), page
        assert warc.page_links(page) == [{"path": f"{t.upper()}@/{n.lower()}", "url": html.unescape(v.strip("\"'"))}
                                         for t, n, v in LINK.findall(page)], page
        found = TITLE.search(page)
        assert warc.page_title(page) == (html.unescape(found[1]).strip() if found else ""), page


@pytest.mark.parametrize("part", ["<!--", "<script>", "<a ", "<p ", "<title>", "<title ", "<head><script", "</script", "<a href", " href=\"", "<", "\n "])
def test_hostile_pages_take_linear_time(part):
    page = part * (5_000_000 // len(part))
    start = time.perf_counter()
    warc.page_text(page), warc.page_links(page), warc.page_title(page)
    assert time.perf_counter() - start < 20
