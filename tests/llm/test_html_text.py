import html
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wakeline.llm import html_text as ht

TEXT = "This is the first paragraph of the article and it is long enough to be decided by the rules."
MORE = "It was the best of times and it was the worst of times, and so it is with the texts of the web."


def test_pages_of_the_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in ht.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        want = "\n\n".join(x for x in parts if x)
        assert got[r["page_id"]] == (want, len(want))


def _bare(page):
    """The page without classes, ids and roles, its telling elements turned into div."""
    page = re.sub(r"<(/?)(?:article|nav|header|footer|aside)\b", r"<\1div", page)
    return re.sub(r"""\s(?:class|id|role)=(?:"[^"]*"|'[^']*'|[^\s>]+)""", "", page)


def _shares(rows):
    """Characters of the articles that are kept, and of other blocks in what is kept and among all other blocks, on bare pages."""
    text = kept = other = other_kept = 0
    for r in rows:
        bare = _bare(r["html"])
        want = Counter(ht.main_text(r["html"]).split("\n\n"))
        got = Counter(ht.main_text(bare).split("\n\n"))
        size = lambda c: sum(len(x) * n for x, n in c.items())
        text, kept, other_kept = text + size(want), kept + size(want & got), other_kept + size(got - want)
        other += size(Counter(b.text for b in ht.blocks(bare)[0]) - want)
    return kept / text, other_kept / (kept + other_kept or 1), other_kept / other


def test_rules_decide_where_elements_say_nothing(spark, sf, monkeypatch):
    rows = spark.read.parquet(f"{sf}/pages.parquet").select("html").collect()
    text, in_output, of_other = _shares(rows)
    assert text >= 0.9 and in_output <= 0.1 and of_other <= 0.25
    monkeypatch.setattr(ht, "STOP_DENSITY", 9)
    monkeypatch.setattr(ht, "LINK_DENSITY", 9)
    assert _shares(rows)[0] < 0.9 or _shares(rows)[2] > 0.25


def test_class_words_do_not_drop_running_text():
    long = f"{TEXT} {MORE} {MORE}"
    for name in ("related", "related-work", "promo", "ad sidebar"):
        page = f"<article><h1 class=post-header>Title</h1><p>{TEXT}</p><section class='{name}'><p>{long}</p></section><p>{MORE}</p></article>"
        assert ht.main_text(page) == f"Title\n\n{TEXT}\n\n{long}\n\n{MORE}"
    assert long not in ht.main_text(f"<article><p>{TEXT}</p><div class=comments><p>{long}</p></div></article>")


def test_undecided_blocks_inherit_from_boilerplate_too():
    links = "<nav><a href=x>" + "link words here " * 5 + "</a></nav>"
    assert ht.main_text(f"{links}<div>An advert.</div><div><h1>Title</h1><p>{TEXT}</p></div><div>&copy; Someone and the rest of it</div>") == f"Title\n\n{TEXT}"


@pytest.mark.parametrize(
    "boilerplate",
    [
        "<nav><a href=/>Home</a></nav>", f"<header><p>{MORE}</p></header>", f"<footer><p>{MORE}</p></footer>", f"<aside><p>{MORE}</p></aside>",
        f"<div class='cookie-notice'><p>{MORE}</p></div>", f"<div id=sidebar>{MORE}</div>", f'<div class="ad">{MORE}</div>', f"<form><p>{MORE}</p><input></form>",
        f"<script>var a = '<p>{MORE}</p>';</script>", "<style>p > a { color: red }</style>", f"<section class='comments'><h2>Comments</h2><p>{MORE}</p></section>",
        f"<!-- <p>{MORE}</p> -->", f"<div style='display: none'>{MORE}</div>", f"<div hidden>{MORE}</div>", f"<div role=navigation>{MORE}</div>",
        "<ul><li><a href=1>One link and more</a><li><a href=2>Another link</a></ul>", f"<article class=comment><p>{MORE}</p></article>",
    ],
)
@pytest.mark.parametrize("tag", ["article", "div"])
def test_boilerplate_goes(boilerplate, tag):
    page = f"<html><head><title>T</title></head><body>{boilerplate}<{tag}><h1>Title</h1><p>{TEXT}</p>{boilerplate}<p>{MORE} &amp; so on</p><p>Short end.</p></{tag}>{boilerplate}</body></html>"
    assert ht.main_text(page) == f"Title\n\n{TEXT}\n\n{MORE} & so on\n\nShort end."


def test_short_blocks_inherit_from_the_nearest():
    links = "<p><a href=x>" + "link words here " * 5 + "</a></p>"
    page = f"<body>{links}<p>Near links</p><p>Further</p><p>Near text</p><p>{TEXT}</p><p>After</p></body>"
    assert ht.main_text(page) == f"Further\n\nNear text\n\n{TEXT}\n\nAfter"


def test_white_space_and_references():
    page = f"<p>{TEXT}\n\t  a&nbsp;b&#x41;&lt;p&gt;&eacute;<br>c<b>d</b> <i>e</i></p>"
    assert ht.main_text(page) == f"{TEXT} a bA<p>é cd e"


def test_unclosed_elements():
    assert ht.main_text(f"<p><b>{TEXT}<p>{MORE}<ul><li>one<li>two") == f"{TEXT}\n\n{MORE}\n\none\n\ntwo"
    assert ht.main_text(f"<article><p>{TEXT}<div class=share>Share<p>{MORE}</div><p>End") == f"{TEXT}\n\nEnd"


@pytest.mark.parametrize("page, text", [("", ""), ("only text", "only text"), ("<", "<"), ("a < b", "a < b"), ("<!DOCTYPE html>", ""), ("<p>x</p", "x</p"), ("<script>", ""), ("<!-- open", "")])
def test_small_pages(page, text):
    assert ht.main_text(page) == text


@pytest.mark.parametrize("unit", ["<div ", "<p>x", '<div a="', "<!--", "<", "<b>", "</p>", "<a href='", "<li>"])
def test_long_pages_take_time_in_proportion(unit):
    start = time.time()
    ht.main_text(unit * 100_000)
    assert time.time() - start < 20


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "u", ""), (None, "v", f"<p>{TEXT}</p>"), (3, "w", "<p>" + f"{TEXT} " * 5000 + "</p>"), (3, "w", f"<p>{MORE}</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit(1), "n_chars": F.lit(2)})
    got = sorted(((r["page_id"], r["url"], r["text"][:10], r["n_chars"]) for r in ht.extract(pages).collect()), key=str)
    long = len(" ".join([TEXT] * 5000))
    assert got == sorted([(1, None, "", 0), (2, "u", "", 0), (None, "v", TEXT[:10], len(TEXT)), (3, "w", TEXT[:10], long), (3, "w", MORE[:10], len(MORE))], key=str)
    assert ht.extract(pages.limit(0)).count() == 0
