"""Pages without a named container, and verdicts that do not follow the number of seeds."""

from __future__ import annotations

import math
import re
import time

import pytest

from chronoloom.llm import html, urls

HEAD = "A heading 1"
LONG = "Some words of prose, one after another. " * 12 + "End."
SHORT = "A second paragraph, shorter than the first, is part of the text too. " + "It ends here now, in full."
TINY = "Short one."


@pytest.mark.parametrize(
    ("source", "wanted"),
    [
        (f"<div><h1>{HEAD}</h1><p>{LONG}</p></div>", [HEAD, LONG]),
        (f"<div><h1>{HEAD}</h1><p>{LONG}</p><p>{SHORT}</p></div>", [HEAD, LONG, SHORT]),
        (f"<body><div><p>{LONG}</p><p>{TINY}</p></div></body>", [LONG, TINY]),
        (f"<div><section><p>{LONG}</p></section><section><p>{TINY}</p></section></div>", [LONG, TINY]),
        (f"<div><section>{f'<p>{LONG}</p>' * 30}</section><section><p>{TINY}</p></section></div>", [LONG] * 30 + [TINY]),
        (f"<body><div><h1>{HEAD}</h1></div><div><p>{LONG}</p><p>{SHORT}</p></div><div><h3>Related</h3></div></body>",
         [HEAD, LONG, SHORT]),
        (f"<table><tr><td><h2>{HEAD}</h2></td></tr><tr><td>{LONG}</td></tr></table>", [HEAD, LONG]),
    ],
)
def test_pages_without_a_container_stay_whole(source, wanted):
    assert html.main_text(source) == " ".join(wanted)


def test_unrelated_trusted_hosts_change_no_verdict(spark):
    to = lambda *hosts: "".join(f'<a href="https://{h}/a">t</a>' for h in hosts)
    given = [
        *((f"http://good{i}.com/x", to("liked.org")) for i in range(4)),
        ("http://liked.org/", to("bad.net")),
        ("http://farm.org/", to("bad.net")),
        ("http://bad.net/es/1", ""),
    ]
    more = [(f"http://far{i}.com/x", "") for i in range(60)]
    verdicts = []
    for rows in (given, given + more):
        pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")
        found = {r.host: r.verdict for r in urls.filtered(pages).collect()}
        verdicts.append({h: found[h] for h in ("liked.org", "farm.org")})
    assert verdicts[0] == verdicts[1] == {"liked.org": "allow", "farm.org": "block"}


PROSE = "Prose of the page, long enough, with marks. " * 6 + "The end."
OUTSIDE = "<nav><a href=/>Menu</a></nav><div class=sidebar><p>Aside, with words, of its own.</p></div>"


@pytest.mark.parametrize("source", [
    '<body class="x"><div class="has-sidebar"><article><p>{}</p></article></div>{}',
    '<div class="post comments-open"><p>{}</p></div>{}',
    '<div class="legal-text"><p>{}</p></div>{}',
    '<div class="col-header left"><p>{}</p></div>{}',
    '<div id="widget-page"><main><p>{}</p></main></div>{}',
])
def test_names_never_take_the_article_away(source):
    assert html.main_text(source.format(PROSE, OUTSIDE)) == PROSE


def test_comments_stay_out_however_long():
    comments = "<p>A reader says, at length, that it is so. And so on.</p>" * 40
    for source in ('<article><p>{}</p></article><div id="comments">{}</div>',
                   '<article><p>{}</p><section class="comment-list">{}</section></article>',
                   '<div><div class=story><p>{}</p></div><div class="comments">{}</div></div>'):
        assert html.main_text(source.format(PROSE, comments)) == PROSE


def test_link_lists_in_an_article():
    menu = "<ul><li><a href=/a>One more story</a></li><li><a href=/b>And another</a></li></ul>"
    items = "<ol><li>First <a href=/c>link</a></li><li><a href=/d>Second</a></li></ol>"
    assert html.main_text(f"<article><p>{PROSE}</p>{menu}</article>") == PROSE
    assert html.main_text(f"<article><p>{PROSE} <a href=/x>More</a></p>{items}</article>") == f"{PROSE} More First link Second"


@pytest.mark.parametrize("source", [
    "<p>" + "<b>word " * 100_000, "<a '" * 100_000, "<a '>' " * 30_000, "<!" * 100_000, "<script" * 100_000,
    "<b>" * 50_000 + "<div>x</div>" * 50_000, "<p><button>" + "<b>" * 30_000 + "<div></div>" * 30_000,
    "<li><i>" * 50_000, "<div>" * 50_000 + "deep" + "</div>" * 50_000, "</x>" * 100_000, "<a x='" + "y" * 1_000_000,
])
def test_pages_are_read_in_linear_time(source):
    started = time.perf_counter()
    html.main_text(source)
    assert time.perf_counter() - started < 8


def plain_ratios(source):
    """Per tag path, from the texts' own stacks: length and marks per node, smoothed and fused."""
    page = html.read(source)

    def stack(e):
        return () if e == 0 else (*stack(page.above[e]), page.names[e])

    held: dict = {}
    for e, _, text in page.texts:
        held.setdefault(stack(e), []).append(text)
    paths = list(held)
    sums = [
        (sum(len(t.strip()) for t in held[p]) / len(held[p]), sum(len(re.findall(r"[.,;:!?]", t)) for t in held[p]) / len(held[p]))
        for p in paths
    ]
    found = {}
    for i, p in enumerate(paths):
        around = [sums[max(i - 1, 0)], sums[i], sums[min(i + 1, len(sums) - 1)]]
        length, marks = (sum(w * x[k] for w, x in zip((0.25, 0.5, 0.25), around)) for k in (0, 1))
        found[p] = length * (1 + math.log(1 + marks)) * (0 if "a" in p else 1)
    return {p: found[p] for p in paths}, {stack(e): page.path[e] for e, _, _ in page.texts}


def test_ratios_equal_a_plain_computation(spark, small):
    pages = [r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
    for source in [p for p in pages if p] + [f"<div><h1>{HEAD}</h1><p>{LONG} <a>x</a></p><ul><li>{TINY}</ul></div>"]:
        wanted, number = plain_ratios(source)
        found = html.ratios(html.read(source))
        assert {number[p]: pytest.approx(v) for p, v in wanted.items()} == {n: p.score for n, p in found.items()}
