import os
import random
import time
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pytest

from tidemark.llm import html_text


def texts(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in html_text.main_text(pages).collect()}


def test_lines_outside_a_declared_article_are_open(spark):
    assert html_text.page_lines("<div>a</div><article><p>b</p></article><div>c</div>") == (["a", "b", "c"], [True, False, True])
    body = [(k, f"http://one.example/{k}", f"<div>Site menu</div><div>story {k}</div><div>ends {k}</div><article><p>Teaser of today</p></article><div>Imprint</div>") for k in range(4)]
    for n in ("1", "3"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        assert texts(spark, body) == {k: f"story {k} ends {k} Teaser of today" for k in range(4)}
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_copies_and_large_templates_do_not_stop_differencing(spark):
    menu = "".join(f"<p>menu {i}</p>" for i in range(20))
    page = lambda k: f"{menu}<p>story {k}</p><p>middle {k}</p><p>ends {k}</p>"
    short = [(k, f"http://short.example/{k}", page(k)) for k in range(6)]
    copies = [(100 + k, f"http://copies.example/a/{k}", page(7)) for k in range(5)] + [(110, "http://copies.example/b/1", page(8)), (111, "http://copies.example/a/2x", None)]
    split = [(200 + k, f"http://split.example/{k}", page(9 if 0 < k < 6 else k)) for k in range(8)]
    alone = [(300 + k, f"http://alone.example/{k}", page(0)) for k in range(3)]
    want = {k: f"story {n} middle {n} ends {n}" for k, n in [*((k, k) for k in range(6)), *((100 + k, 7) for k in range(5)), (110, 8), *((200 + k, 9 if 0 < k < 6 else k) for k in range(8))]}
    for n in ("1", "2", "5", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = texts(spark, short + copies + split + alone)
        assert {k: got[k] for k in want} == want and got[111] == ""
        assert all(got[300 + k].startswith("menu 0 ") and got[300 + k].endswith("ends 0") for k in range(3))
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def naive_texts(rows, copy_share=0.8):
    """All pages in plain Python: sort, group copies, look at the groups on either side on the same host."""
    pages = []
    for key, url, source in rows:
        split = urlsplit(url or "")
        lines, is_open = html_text.page_lines(source)
        pages.append((split.netloc.lower(), split.path, key, lines, is_open))
    out = {p[2]: "" for p in pages}
    pages = sorted(p for p in pages if p[3])
    groups = []
    for p in pages:
        if groups and (groups[-1][0][0], groups[-1][0][3]) == (p[0], p[3]):
            groups[-1].append(p)
        else:
            groups.append([p])
    for g, group in enumerate(groups):
        host, lines = group[0][0], group[0][3]
        sides = [groups[g - 1][-1] if g else None, groups[g + 1][0] if g + 1 < len(groups) else None]
        for _, path, key, _, is_open in group:
            near = [s for s in sides if s and s[0] == host]
            near.sort(key=lambda s: -html_text.nearness(path, s[1]))  # noqa: B023
            shares = [html_text.common_subsequence(lines, s[3]) for s in near]
            shared = next((x for x in shares if len(x) <= copy_share * len(lines)), min(shares, key=len, default=[]))
            kept = [x for k, x in enumerate(lines) if not (k in shared and is_open[k])]
            out[key] = " ".join(kept or lines)
    return out


def test_equals_all_pages_in_plain_python(spark):
    rng = random.Random(8)
    menus = {h: [f"menu {h} {i}" for i in range(rng.randrange(1, 9))] for h in "abcd"}
    rows = []
    for key in range(160):
        host = rng.choice("aaabcd")
        own = [f"line {rng.randrange(60)}" for _ in range(rng.randrange(5))]
        lines = rng.choice([[*menus[host], *own, "imprint"], own, menus[host], [*menus[host], "story 1", "story 2"]])
        body = "".join(f"<div>{x}</div>" for x in lines)
        if rng.random() < 0.3:
            body += f"<article><p>{rng.choice(['shared passage', f'body {key}'])}</p></article>"
        source = rng.choice([body, body, body, f"<nav>n</nav>{body}<div class='ad'>buy {key}</div>", None, ""])
        rows.append((key, f"http://{host}.example/{rng.choice(['x', 'y', 'x/z'])}/{rng.randrange(40):02d}", source))
    want = naive_texts(rows)
    for n in ("1", "2", "5", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        assert texts(spark, rows) == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")


#: Wrappers whose names hold a telling word, and things inside an article that have one.
WRAPPERS = ['<div class="layout has-sidebar">', '<div id="page" class="no-sidebar">', '<div class="post share-enabled">', '<div class="main-content ad-free">', '<div class="content comments-open">', '<section aria-label="Search results and article">', '<form id="aspnetForm">', '<div class="sidebar-layout">']


def test_an_article_survives_the_names_of_what_is_around_it():
    article = '<article><h1>T</h1><h2 class="section-header">S</h2><div class="entry-header"><h1>E</h1></div><p>body</p><div class="share">tweet</div><form>f</form></article>'
    for wrapper in WRAPPERS:
        lines, is_open = html_text.page_lines(f"<nav>menu</nav><footer>imprint</footer>{wrapper}{article}</{wrapper[1:].split()[0]}><div class='ad'>buy</div>")
        assert lines == ["T", "S", "E", "body"] and not any(is_open), wrapper
    assert html_text.page_lines('<div class="related"><article>teaser</article></div><article>own</article>')[0] == ["own"]
    assert html_text.page_lines('<aside><article>teaser</article></aside><nav><article>x</article></nav>')[0] == []
    for dropped in ('class="sidebar"', 'class="main-nav"', 'id="ad_3"', 'role="banner"', 'aria-label="Main navigation"', 'class="no js comments"', "class=ads", "hidden"):
        assert html_text.page_lines(f"<div {dropped}>x</div><p>y</p>")[0] == ["y"], dropped


def test_malformed_pages_take_one_pass():
    began = time.process_time()
    for bad in ("<a x ", '<a "', "<a ='", '<a ="', "<div><", "</p>", "<!--", "<script>", "<a x='><b y=\"", "<nav><article><div></button>", "<", "<!-", "<a ="):
        for tail in ("", ">", '">', "'>", "\" '>"):
            html_text.page_lines(bad * (100_000 // len(bad)) + tail)
    assert time.process_time() - began < 30
    assert html_text.page_lines("<p title=it's>don't 1 < 2 <3</p><p>a<!-- > --> b<!-->c</p><a x") == (["don't 1 < 2 <3", "a bc", "<a x"], [True] * 3)
    assert html_text.page_lines('<p a=">" b>x</p><p a="y>z</p>')[0] == ["x", "z"]


class Plain(HTMLParser):
    """The same markup by the standard library's parser: blocks of text outside what is dropped."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.words, self.stack = [], [], []

    def hidden(self):
        return any(x in ("nav", "footer", "header", "aside", "form", "script", "style", "title", "ad") for x in self.stack)

    def end_block(self):
        if text := " ".join("".join(self.words).split()):
            self.blocks.append(text)
        self.words = []

    def handle_starttag(self, tag, attrs):
        if tag not in ("a", "b", "i", "em", "span"):
            self.end_block()
        if tag not in ("br", "meta", "link", "img", "hr", "p", "li"):
            self.stack.append("ad" if ("class", "ad") in attrs else tag)
            if ("class", "ad") in attrs:
                self.ads = tag

    def handle_endtag(self, tag):
        if tag not in ("a", "b", "i", "em", "span"):
            self.end_block()
        name = next((x for x in reversed(self.stack) if x == tag or x == "ad" and self.ads == tag), None)
        while name and self.stack.pop() != name:
            pass

    def handle_data(self, data):
        if not self.hidden():
            self.words.append(data)


def plain_text(source):
    parser = Plain()
    parser.feed(source or "")
    parser.close()
    parser.end_block()
    return " ".join(parser.blocks)


def test_given_pages_by_the_standard_parser(spark):
    folder = "/root/testdata/sf0.01"
    if not os.path.exists(folder):
        pytest.skip("no test tables")
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = {r["page_id"]: r["text"] for r in html_text.op8_html_text(spark, folder).collect()}
    assert got == {k: plain_text(x) for k, x in pages.items()}
