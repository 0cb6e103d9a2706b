"""Operators on pages: URL filters and main text."""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pytest

from chronoloom.llm import html, urls
from compare import duck

SCHEMA = "page_id long, url string, html string, host string, path string, rule string, blocked int"


def _page(n, url, body="", rest=None):
    return (n, url, body, rest, rest, rest, None)


# -- URL filters ---------------------------------------------------------------------------


def plain(url):
    """(host, path, rule) of a url by the definition."""
    _, sign, rest = (url or "").partition("://")
    if not sign:
        return "", "", None
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule in urls.RULES:
        name, prefix = rule.where.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + prefix):
            best = max(best or "", rule.where, key=len)
    return host, path, best


WORDS = {r.where: "allow" if r.allow else "block" for r in urls.RULES}


def test_rules_over_the_pages(spark, medium):
    pages = duck(medium).execute("SELECT page_id, url FROM pages").fetchall()
    rows = urls.filtered(spark.read.parquet(f"{medium}/pages.parquet")).collect()
    assert len(rows) == len(pages)
    found = {r.page_id: r for r in rows}
    barred, seen = Counter(), Counter()
    for _, url in pages:
        host, _, rule = plain(url)
        seen[host] += 1
        barred[host] += WORDS.get(rule) == "block"
    for i, url in pages:
        host, path, rule = plain(url)
        assert (found[i].host, found[i].path, found[i].rule) == (host, path, rule)
        # The pages link to no other hosts, so only a host's own pages speak against it.
        assert found[i].verdict == WORDS.get(rule, "block" if 2 * barred[host] > seen[host] else "allow")


def test_awkward_urls(spark):
    given = [
        None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "http://a.com", "x://com/",
        "http://xcom/", "http://ÄB.net/es/1", "http://net/fr/?a", "http://a.net/fr#/", "a://b://c.com/d",
        "http://evil.org?u=http://a.com/", "http://a.com\n/b", "http://www.example.com/en/", "http://a.com/",
        "http://a.com/",
    ]
    pages = spark.createDataFrame([_page(i, u, None, "t") for i, u in enumerate(given)], SCHEMA)
    rows = urls.filtered(pages).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule) for r in rows) == sorted(
        (i, *plain(u)) for i, u in enumerate(given)
    )
    assert urls.filtered(pages.limit(0)).count() == 0


def test_trust_and_distrust_flow_along_links(spark):
    to = lambda *hosts: "".join(f'<p><a class=x href="https://{h}/a">t</a>' for h in hosts)
    given = [
        ("http://good.com/x", to("Friend.org", "both.org")),
        ("http://friend.org/", to("second.org")),
        ("http://second.org/", ""),
        ("http://bad.net/es/1", to("both.org")),
        ("http://farm.org/", to("bad.net", "bad.net")),
        ("http://far.org/", to("farm.org")),
        ("http://both.org/", to("good.com") * 9 + to("bad.net")),
        ("http://alone.org/", '<a href="/relative">x</a>'),
    ]
    pages = spark.createDataFrame([_page(i, u, h) for i, (u, h) in enumerate(given)], SCHEMA)
    rows = {r.host: r for r in urls.filtered(pages).collect()}
    verdicts = {h: r.verdict for h, r in rows.items() if r.rule is None}
    assert verdicts["farm.org"] == verdicts["far.org"] == "block"
    assert verdicts["friend.org"] == verdicts["second.org"] == verdicts["alone.org"] == "allow"
    assert rows["friend.org"].trust > rows["second.org"].trust > 0 == rows["friend.org"].distrust
    assert rows["farm.org"].distrust > rows["far.org"].distrust > 0 == rows["farm.org"].trust
    assert rows["both.org"].trust > 0 < rows["both.org"].distrust


def test_ranks_equal_plain_iteration(spark):
    edges = [("a", "b", 1.0), ("a", "c", 3.0), ("b", "c", 1.0), ("c", "a", 2.0), ("d", "c", 1.0)]
    table = spark.createDataFrame(edges, "a string, b string, weight double")
    seeds = spark.createDataFrame([("a", 0.5), ("d", 0.5)], "host string, seed double")
    found = {r.host: r["rank"] for r in urls.spread(table, seeds).collect()}
    rank = base = {"a": 0.15 * 0.5, "d": 0.15 * 0.5}
    total = {x: sum(w for a, _, w in edges if a == x) for x in "abcd"}
    for _ in range(urls.STEPS):
        moved = dict(base)
        for a, b, w in edges:
            if a in rank:
                moved[b] = moved.get(b, 0.0) + 0.85 * rank[a] * w / total[a]
        rank = moved
    assert found == pytest.approx(rank)


# -- main text -----------------------------------------------------------------------------


def test_articles_of_the_pages(spark, medium):
    pages = duck(medium).execute("SELECT page_id, html FROM pages").fetchall()
    found = {r.page_id: r for r in html.extracted(spark.read.parquet(f"{medium}/pages.parquet")).collect()}
    assert len(found) == len(pages)
    for i, source in pages:
        inside = re.search(r"<article>(.*?)</article>", source, re.S)[1]
        blocks = (entities.unescape(re.sub(r"<[^>]+>", "", x)) for x in re.split(r"</?(?:p|h1|br)[^>]*>", inside))
        wanted = " ".join(x for x in (re.sub(r"\s+", " ", b).strip() for b in blocks) if x)
        assert found[i].text == wanted and found[i].n_chars == len(wanted)


NOISE = """<nav><ul><li><a href=/a>Menu one</a><li><a href=/b>Menu two</a></ul></nav>
<div class="ad banner">Buy now, it is cheap, really!</div>"""
AFTER = """<section id="comments"><p>First comment, with, many, commas, and a long text to look like prose.</p></section>
<form><label>Name</label><input><p>Send it.</p></form><aside>Side story, told at length. Twice.</aside><footer>&copy; Site</footer>"""


@pytest.mark.parametrize(
    ("source", "wanted"),
    [
        (None, ""), ("", ""), ("   ", ""), ("just text &amp; more", "just text & more"),
        (f"<body>{NOISE}<article><h1>T &lt;1&gt;</h1><p>One<p>Two <b>bold</b>\n\n text<br>line</article>{AFTER}",
         "T <1> One Two bold text line"),
        (f"<body>{NOISE}<div id=wrap><div class=story><h2>Head</h2><p>Some prose, long enough to count, it is.</p>"
         f"<p>Short.</p><p>More prose here, again long enough, with marks.</p></div></div>{AFTER}",
         "Head Some prose, long enough to count, it is. Short. More prose here, again long enough, with marks."),
        ("<article>a<script>var x='</p><p>no';</script>b<style>p{}</style><!-- no -->c</article>", "abc"),
        ("<article><p>in<div class='comments'><p>no</div><p>out</article>", "in out"),
        ("<main><p>x &nbsp; y&#33;&hearts;</p></main>", "x y!♥"),
        (f"<body>{NOISE}</body>", ""),
        ("<article><p>unclosed <b>bold <i>it</p><p>next", "unclosed bold it next"),
        ("<article><header><h1>Title</h1></header><p>1 < 2 and 3 > 2</p></article>", "Title 1 < 2 and 3 > 2"),
        ("<p title='a > b'>quoted</p>", "quoted"),
    ],
)
def test_main_text(source, wanted):
    assert html.main_text(source) == wanted


def test_extraction_of_awkward_rows(spark):
    long_page = "<article>" + "<p>word, word. " * 20000 + "</article>"
    rows = [_page(1, None, None), _page(1, "u", ""), _page(None, "u", "<p>x, y"), _page(2, "u", long_page, "t")]
    pages = spark.createDataFrame(rows, SCHEMA)
    found = sorted(((r.page_id or 0), r.url or "", r.n_chars) for r in html.extracted(pages).collect())
    assert found == [(0, "u", 4), (1, "", 0), (1, "u", 0), (2, "u", 20000 * 12 - 1)]
    assert html.extracted(pages.limit(0)).count() == 0
    deep = "<div>" * 3000 + "deep, text." + "</div>" * 3000
    assert html.main_text(deep) == "deep, text."
