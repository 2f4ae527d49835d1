import math
import random
import time
from collections import defaultdict

import pytest

from gridpv.llm import html_extract
from gridpv.llm.common import read_table
from gridpv.llm.html_extract import NAMED_PRIOR, THRESHOLD, extract, extract_pages

LONG = "A paragraph of the article, with commas, stops and so on. It goes on for a while, as such things do."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("   ", ""),
        ("just text", "just text"),
        ("<p>one, two.<p>three, four.", "one, two.\n\nthree, four."),
        ("<div><a href=/>Home</a> <a href=/x>More</a></div>", ""),
        ("<p>a &amp; b&nbsp;c &lt;d&gt;,  e\n f<br>g.</p>", "a & b c <d>, e f g."),
        ("<script>var a = '<p>no, no.</p>';</script><p>yes, yes.</p><!-- <p>no</p> -->", "yes, yes."),
        (f"<style>p{{}}</style><p>{LONG}</p><script>endless, never closed <p>no</p>", LONG),
        ("a < b, and <b unclosed", "a < b, and <b unclosed"),
    ],
)
def test_small_pages(page, text):
    assert extract(page) == text


BOILER = [
    "<nav><ul><li><a href='/a'>Menu item one</a></li></ul></nav>", "<header><p>Site name, and a slogan, that is long.</p></header>",
    "<footer><p>Footer text, address, and more, of some length.</p></footer>", "<aside><p>Side story, which is long, and has commas, too.</p></aside>",
    "<div class='cookie-notice'><p>We use cookies, please accept them, all of them.</p></div>", "<div class='ad'>Buy this, now, it is cheap, and good.</div>",
    "<form><label>Your name, please</label><input name=x><p>Write to us, we answer, some day.</p></form>",
    "<section id='comments'><p>Reader comment, long, with commas, and opinions, many.</p></section>", "<div role='banner'>Banner, of sorts.</div>",
    "<div hidden><p>Hidden, unseen, not shown.</p></div>", "<div style='display: none'>Gone, too.</div>", "<ul class='share-links'><li><a href=x>Share</a></li></ul>",
]


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", "<div class='story'>{}</div>", "{}"])
def test_article_without_boilerplate(wrap):
    body = f"<h1>The title</h1><p>{LONG}</p><p>Short.</p><ul><li>Point <b>one</b>, here.</li><li>Point two.</li></ul><p>{LONG} <a href=x>Link</a>, end.</p>"
    want = f"The title\n\n{LONG}\n\nShort.\n\nPoint one, here.\n\nPoint two.\n\n{LONG} Link, end."
    page = "<html><head><title>T</title></head><body>" + "".join(BOILER[:6]) + wrap.format(body) + "".join(BOILER[6:]) + "</body></html>"
    assert extract(page) == want


SHORT = "Brief, too."


@pytest.mark.parametrize(
    ("page", "blocks"),
    [
        # sections of one article, the first with most of the text
        (f"<article><h1>T</h1><section><p>{LONG * 10}</p></section><section><p>{LONG * 3}</p></section></article>", ["T", LONG * 10, LONG * 3]),
        (f"<div><h1>T</h1><section><p>{LONG * 10}</p></section><section><p>{LONG * 3}</p></section></div>", ["T", LONG * 10, LONG * 3]),
        (f"<section><p>{LONG * 10}</p></section><section><h2>More</h2><p>{LONG * 3}</p></section>", [LONG * 10, "More", LONG * 3]),
        # title and introduction beside the body of the text
        (f"<article><h1>T</h1><p>{SHORT}</p><div class='body'><p>{LONG * 5}</p></div><p>End</p></article>", ["T", SHORT, LONG * 5, "End"]),
        (f"<main><h1>T</h1><article><p>{LONG}</p></article></main>", ["T", LONG]),
        (f"<div><h1>T</h1><p>{SHORT}</p><div class='body'><p>{LONG * 5}</p></div><p>End</p></div>", ["T", SHORT, LONG * 5, "End"]),
        (f"<h1>T</h1><div class='body'><p>{LONG * 5}</p></div>", ["T", LONG * 5]),
        # one long list, quotation or table
        (f"<article><h1>T</h1><p>{SHORT}</p><ul><li>{LONG * 4}<li>{LONG * 4}</ul><p>End</p></article>", ["T", SHORT, LONG * 4, LONG * 4, "End"]),
        (f"<article><p>{LONG}</p><blockquote><p>{LONG * 9}</p></blockquote><p>End</p></article>", [LONG, LONG * 9, "End"]),
        (f"<h1>T</h1><table><tr><td><p>{LONG * 9}</p><h3>End</h3></td></tr></table>", ["T", LONG * 9, "End"]),
        # content outside the article element
        (f"<div><p>{LONG}</p></div><article><p>{LONG * 5}</p></article>", [LONG, LONG * 5]),
    ],
)
def test_all_parts_of_an_article_are_kept(page, blocks):
    links = "<div><a href='/'>Home page</a> <a href='/all'>All of the pages</a></div>"
    assert extract(f"<html><body>{links}{page}{links}</body></html>") == "\n\n".join(blocks)


@pytest.mark.parametrize("wrap", ["<article><h1>T</h1>{}</article>", "<main><h1>T</h1>{}</main>", "<div><h1>T</h1>{}</div>"])
@pytest.mark.parametrize(
    ("part", "blocks"),
    [
        (f"<section id='discussion'><h2>Discussion</h2><p>{LONG}</p></section>", ["Discussion", LONG]),
        (f"<section id='comments'><h2>Comments</h2><p>{LONG}</p></section>", ["Comments", LONG]),
        (f"<h2 id='related-work'>Related work</h2><p>{LONG}</p><h2 id='search'>Search</h2><p>{LONG}</p>", ["Related work", LONG, "Search", LONG]),
        (f"<div class='legal'><p>{LONG}</p></div><p class='notice'>Mind the gap.</p>", [LONG, "Mind the gap."]),
        ("<p>See <span id='legal'>the law</span>, it says so.</p><ul><li class='menu'>Soup</li></ul>", ["See the law, it says so.", "Soup"]),
        ("<section id='search'><h2>Search</h2><pre>find x</pre></section>", ["Search", "find x"]),
        # still boilerplate
        ("<div class='related'><h2>Related</h2><ul><li><a href=x>One more, of many</a></li></ul></div><div class='share'>Share this</div>", []),
        ("<div class='ad'>Buy this, now.</div><div id='comments'><p>I agree, a lot.</p></div><form><p>Write, to us.</p></form>", []),
    ],
)
def test_names_inside_an_article(wrap, part, blocks):
    page = "".join(BOILER[:6]) + wrap.format(f"<p>{LONG}</p>{part}<p>{LONG}</p>") + "".join(BOILER[6:])
    assert extract(f"<html><body>{page}</body></html>") == "\n\n".join(["T", LONG, *blocks, LONG])


@pytest.mark.parametrize("tag", ["form id=page", "div class=search-widget", "div role=form"])
@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<div>{}</div>", "{}"])
@pytest.mark.parametrize("title", ["<h1>T</h1>", "<h2>T</h2>"])
def test_a_name_around_the_whole_page(tag, wrap, title):
    body = wrap.format(f"{title}<p>{LONG}</p><p>{LONG}</p>")
    assert extract(f"<body>{BOILER[0]}<{tag}>{BOILER[1]}{body}{BOILER[2]}</{tag.split()[0]}></body>") == f"T\n\n{LONG}\n\n{LONG}"


def test_a_wrapper_with_the_main_heading_is_no_sidebar():
    assert extract(f"<body>{BOILER[0]}<div class='page has-sidebar'><h1>T</h1><p>{LONG}</p></div></body>") == f"T\n\n{LONG}"


def test_long_and_deep_pages():
    assert extract("<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>").count("\n\n") == 19_999
    assert extract("<div>" * 5000 + LONG) == LONG


def test_frame_keeps_other_columns(spark):
    rows = [(1, "u", f"<p>{LONG}</p>", "old"), (1, "u", f"<p>{LONG}</p>", "old"), (None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, extract_pages(pages).select("page_id", "url", "text").collect()), key=repr)
    assert got == [(1, "u", LONG), (1, "u", LONG), (None, None, "")]
    assert extract_pages(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("part", "blocks"),
    [
        # names that say nothing, and a topic with a heading of its own
        (f"<div class='hidden-gems'><p>{LONG}</p></div>", [LONG]),
        (f"<div class='ad-free has-sidebar hidden-xs'><p>{LONG}</p></div>", [LONG]),
        (f"<div id='login'><h2>Login</h2><p>{LONG}</p></div>", ["Login", LONG]),
        # controls, formulas and the source of a quotation are read with their text
        ("<p>Press <button>Save</button>, see <label>Name</label>.</p>", ["Press Save, see Name."]),
        ("<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math>, then.</p>", ["So x=2, then."]),
        (f"<blockquote><p>{LONG}</p><footer>Someone</footer></blockquote>", [LONG, "Someone"]),
        # a lost quote ends with its tag; a tag without an end is text
        (f'<p class="x>{LONG}</p><p class="y">Two "or" so.</p>', [LONG, 'Two "or" so.']),
        ("<p title='a > b < c'>If a <b and so on.</p>", ["If a <b and so on."]),
        ("<p>&#0000000000065; &#99999999999; &#x" + "1" * 6000 + ";</p>", ["A \ufffd \ufffd"]),
        # still boilerplate
        ("<div class='user-comments'><p>I agree, a lot.</p></div><div class='ad-slot-3'>Buy, now.</div><p><button>Go</button></p>", []),
        ("<div id='comments'><h2>Comments</h2><p>I agree, a lot.</p></div><div class='cookie-notice'>Cookies, here.</div>", []),
    ],
)
def test_names_and_markup_that_leave_no_holes(part, blocks):
    page = f"<body>{BOILER[0]}<main><h1>T</h1><p>{LONG}</p>{part}<p>{LONG}</p></main>{BOILER[2]}</body>"
    assert extract(page) == "\n\n".join(["T", LONG, *blocks, LONG])


def test_unnamed_boilerplate_goes_by_its_ratios():
    low = "<div class='x1'>Home Products Contact</div>"
    body = f"<div class='x2'><p>{LONG}</p><p>{LONG}</p></div>"
    assert extract(f"<body>{low * 5}{body}{low * 5}</body>") == f"{LONG}\n\n{LONG}"


def _plain_scores(nodes):
    """The fused scores by their definition, path by path, with paths as strings of tags and classes."""

    def path(e):
        return () if e.parent is None else (*path(e.parent), e.path)

    seen = [(" ".join(t.split()), path(e), e.off, e.link) if not e.gone and t.split() else None for t, e in nodes]
    at = [i for i, row in enumerate(seen) if row]
    groups = defaultdict(list)
    for i in at:
        groups[seen[i][1:3]].append(i)

    def ratios(i):
        mine = [seen[j][0] for j in groups[seen[i][1:3]]]
        marks = sum(c in ".,;:!?…。、，" for t in mine for c in t)
        return math.log(1 + sum(map(len, mine)) / len(mine)), math.log(1 + marks / len(mine))

    def smooth(k, part):
        rows = [(0.5, k)] + [(0.25, o) for o in (k - 1, k + 1) if 0 <= o < len(at)]
        return sum(w * ratios(at[o])[part] for w, o in rows) / sum(w for w, _ in rows)

    place = {i: k for k, i in enumerate(at)}
    out = [0.0] * len(nodes)
    for (_, off), group in groups.items():
        length, marks = (sum(smooth(place[i], part) for i in group) / len(group) for part in (0, 1))
        size = sum(len(seen[i][0]) for i in group)
        free = sum(len(seen[i][0]) for i in group if not seen[i][3]) / size
        for i in group:
            out[i] = length * (0.25 + marks) * free * (NAMED_PRIOR if off else 1)
    return out


def test_scores_are_those_of_the_definition():
    rng = random.Random(5)
    words = ["one", "two,", "three.", "&amp;", "four!", "five;"]
    for _ in range(60):
        page = ""
        for _ in range(rng.randint(1, 25)):
            tag = rng.choice(["p", "div class=a", "div class='b ad'", "nav", "a href=x", "section", "li", "article", "script", "div hidden"])
            page += f"<{tag}>" + " ".join(rng.choices(words, k=rng.randint(0, 8)))
            page += f"</{tag.split()[0]}>" if rng.random() < 0.6 or tag == "script" else ""
        nodes = html_extract._Parser(page).nodes
        assert html_extract.fused_scores(nodes) == pytest.approx(_plain_scores(nodes)), page


def test_the_scores_decide(spark, monkeypatch):
    pages = [r["html"] for r in read_table(spark, "/root/testdata/sf0.001", "pages").collect()]
    want = [extract(p) for p in pages]
    rng = random.Random(3)
    for scores in (lambda nodes: [rng.random() for _ in nodes], lambda nodes: [1.0] * len(nodes)):
        with monkeypatch.context() as patch:
            patch.setattr(html_extract, "fused_scores", scores)
            assert sum(extract(p) != w for p, w in zip(pages, want, strict=True)) >= len(pages) / 2
    for limit in (0.0001 * THRESHOLD, 5 * THRESHOLD):
        with monkeypatch.context() as patch:
            patch.setattr(html_extract, "THRESHOLD", limit)
            assert sum(extract(p) != w for p, w in zip(pages, want, strict=True)) >= len(pages) / 2


@pytest.mark.parametrize(
    "piece", ["<a ", '<a "', "<p x='", '<a x="', '<a x="<a " x="', "<!", "<!--", "<", "<div>", "<b><div></b>", "<p>", "<li>", "<td>", "&#1", "<header><h1>"]
)
def test_time_is_linear_in_hostile_pages(piece):
    times = []
    for size in (100_000, 400_000):
        page = piece * (size // len(piece))
        start = time.process_time()
        extract(page)
        times.append(time.process_time() - start)
    assert times[1] < 10 * times[0] + 0.2  # 16 times as long if quadratic
