"""Page extraction against pages whose articles are known, and against malformed ones."""

import time

import numpy as np
import pytest

from tarnflow.llm import html_extract
from tarnflow.llm.html_extract import extract_pages, text_of

A = "A sentence of the article itself. " * 30


@pytest.mark.parametrize(
    "page",
    [
        f"<div class='layout with-sidebar'><article>{A}</article></div>",
        f"<div class='post no-comments'>{A}</div>",
        f"<div class='social-studies'>{A}</div>",
        f"<main class='has-related'>{A}</main>",
        f"<form id=aspnetForm><nav>x</nav><div class=sidebar>side</div><div id=main>{A}</div></form>",
        f"<div class='page has-ads'><div class=ad-banner-top>Buy</div><div>{A}</div></div>",
        f"<div>{A}</div><div id=comments><article>{A}{A}</article></div>",
        f"<div class=card>{A}</div><a href=/x><div><h3>A card</h3> that is a link</div></a>",
        f"<object><p>none</p><object>none</object> none</object><svg><svg/><text>t</text></svg><noscript>n</noscript><div>{A}",
        f"<div role=main>{A}</div><div>About us</div>",
    ],
)
def test_articles_that_hint_words_must_not_empty(page):
    assert text_of(f"<html><body>{page}</body></html>") == A.strip()


@pytest.mark.parametrize(
    "page, want",
    [
        ('<p title="a > b">Hello', "Hello"),
        ("<p title=don't>Hello <i>you</i>", "Hello you"),
        ('<p data-x = "</p>">Hello</p>', "Hello"),
        ('<p title="never closed>Hello</p><p>more</p>', "Hello\nmore"),
        ('<p>Hello<a href="', "Hello"),
        ("<p>1 < 2 and 3 > 2 <// <3 </ > <", "1 < 2 and 3 > 2 <// <3 </ > <"),
        ("<p>a<!-- x > y -->b<!-->c<!--->d<!-- never", "abcd"),
        ("<p>x &amp;lt; &#x41;&#66;&nbsp;&copy;&notit; &unknown; &#0;", "x &lt; AB ©¬it; &unknown; �"),
        ("<p>&am<b>p;</b></p>", "&amp;"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><p>e", "a\nb\nc\nd\ne"),
        ("<table><tr><td>a<td>b</ul><tr><td><div>c</table>d", "a\nb\nc\nd"),
        ("<span class=x>a <span>b</span> c</span> d", "a b c d"),
        ("<textarea>x</textarea><title>t</title><script>if (a</b>) '</p>'</script><p>y<style>p{}", "y"),
        ("<p>a<br>b<wbr>c<img alt=z>d", "a bcd"),
        ("﻿<p>é𝄞</p>\x00", None),
    ],
)
def test_markup(page, want):
    got = text_of(page)
    assert want is None or got == want


MALFORMED = {
    "open links": "<a ", "open links, closed": "<a >", "bold": "<b class=x>", "noscript": "<noscript>", "quotes": '<p title="x>', "quoted": "<p title='", "svg": "<svg>", "lists": "<ul><li>",
    "crossed": "<i class=x></b><p>", "comments": "<!-- ", "brackets": "<", "ends": "</p></div>", "cells": "<td><td><table>", "paragraphs": "<p>x", "objects": "<object>x", "deep": "<div class=a>t", "sections": "<![CDATA[",
}


@pytest.mark.parametrize("name", MALFORMED)
def test_malformed_pages_take_linear_time(name):
    took = []
    for size in (250_000, 1_000_000):
        source = MALFORMED[name] * (size // len(MALFORMED[name])) + "</svg>"
        best = 1e9
        for _ in range(2):
            began = time.process_time()
            text_of(source)
            best = min(best, time.process_time() - began)
        took.append(best)
    assert took[1] < 10 * took[0] + 0.5 and took[1] < 30


def test_deep_pages():
    assert text_of("<div>" * 10_000 + A) == A.strip()
    assert text_of("".join(f"<div class=c{'x' * (i % 7)}>" for i in range(10_000)) + f"<p>{A}") == A.strip()


def _site(rng, host, n, template):
    """Pages of one template with their articles."""
    frame = {k: " ".join(rng.choice(WORDS, 12)) for k in ("top", "about", "legal")}
    out = []
    for k in range(n):
        blocks = [" ".join(rng.choice(WORDS, int(rng.integers(4, 90)))) for _ in range(int(rng.integers(1, 9)))]
        paragraphs = "".join(f"<p>{b}</p>" if rng.random() < 0.8 else f"<p>{b}" for b in blocks)
        title = f"Title {k} of {host}"
        own = f"<h1>{title}</h1>{paragraphs}"
        page = template.format(top=frame["top"], about=frame["about"], legal=frame["legal"], own=own, k=k, words=" ".join(rng.choice(WORDS, 30)))
        out.append((f"http://{host}/{k}", page, "\n".join([title, *blocks])))
    return out


WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau &amp; upsilon".replace("&amp; ", "").split()
TEMPLATES = [
    "<html><body><nav><a href=/>Home</a></nav><article>{own}</article><footer>{legal}</footer></body></html>",
    "<body><div class='top-menu'>{top}</div><div id=post-{k} class='post entry'>{own}</div><div id=comments><p>{words}</p></div><aside>{about}</aside>",
    # No names tell the frame here: only the host's other pages do.
    "<body><div class=c1><div class=c2>{top}</div><div class=c3>{own}</div><div class=c4>{about}<br>{legal}</div></div>",
    "<table><tr><td width=10>{about}<td><div class=x{k}>{own}</div><td>{legal}</table>",
    "<body><main><div class='cookie-notice'>{words}</div><header>{own}</header></main><div class='ad-slot'>{words}</div><form><p>{words}</p></form>",
]


def test_sites_of_known_articles(spark):
    rng = np.random.default_rng(4)
    rows = [x for t, template in enumerate(TEMPLATES) for h in range(2) for x in _site(rng, f"h{h}.t{t}.org", 12, template)]
    df = spark.createDataFrame([(i, u, p) for i, (u, p, _) in enumerate(rows)], "page_id long, url string, html string").repartition(4)
    got = {r["page_id"]: r for r in extract_pages(df).collect()}
    assert {i: r["text"] for i, r in got.items()} == {i: want for i, (_, _, want) in enumerate(rows)}
    assert np.mean([r["by_host"] for r in got.values()]) > 0.95


def test_copies_of_a_page_are_no_frame(spark):
    page = f"<body><div class=a>{A}</div><div class=b>More of it.</div></body>"
    df = spark.createDataFrame([(i, f"http://x.org/{i}", page) for i in range(20)], "page_id long, url string, html string")
    assert {r["text"] for r in extract_pages(df).collect()} == {f"{A.strip()}\nMore of it."}


def test_names():
    names = {"sidebar": 2, "sidebar-left": 2, "with-sidebar": 0, "noComments": 0, "commentList": 3, "social-studies": 1, "content": 0, "post_tags": 2, "shareButtons": 2, "": 0}
    assert {n: html_extract.hint_of(n) for n in names} == names
