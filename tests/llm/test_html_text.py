import random
import time

import pytest

from cloneframe.llm.html_text import between, extract, main_text

PAGE = """<!DOCTYPE html><html><head><title>No title</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1><p>Welcome to the site with a long slogan that goes on and on and on for many words</p></header>
<nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- <p>comment</p> --><div class="ad">Buy now, buy cheap, buy a lot of it, with a long advert text for everyone who reads</div>
<div class="cookie-notice"><p>We use cookies on this long notice which you should accept as everyone does it</p></div>
<article><h1>Title &amp; more</h1><p><b>First   para<br>graph</b> a &lt; b&nbsp;c.<p>Second <a href="#">linked</a> text
 goes on.</p><aside><p>Aside text is long enough to look like an article paragraph, but it is not.</p></aside><p>Short.</p>
<form><label>Name</label><input name=a><button>Go</button></form><p>Last one &eacute;.</p></article>
<section id="comments"><p>A reader wrote a very long comment here that must not be part of the text at all.</p></section>
<footer>&copy; x</footer></body></html>"""


def test_article():
    assert main_text(PAGE) == "Title & more First para graph a < b c. Second linked text goes on. Short. Last one é."


def test_without_marks():
    rows = "".join(f"<p>Paragraph {i} of the text has quite a number of words, so its line is long.</p>" for i in range(6))
    page = f"<body><div><a href=1>Home</a> <a href=2>News</a></div><div><a href=3>More</a></div><div><a href=4>Even</a></div>{rows}<div><a href=5>a</a></div><div><a href=6>b</a></div><div><a href=7>c</a></div></body>"
    assert main_text(page).startswith("Paragraph 0") and main_text(page).endswith("line is long.")


def spans(weights, **kw):
    return between(weights, [False] * len(weights), **kw)


def test_surge_and_dive():
    assert spans([0, 0, 100, 5, 0, 90, 0, 0, 0, 3, 0, 0]) == [(2, 6)]
    assert spans([5]) == [(0, 1)]
    assert spans([]) == spans([0, 0]) == []
    assert between([100, 0, 0, 0, 100], [True] * 5) == [(0, 5)] and spans([100, 0, 0, 0, 100]) == [(0, 1), (4, 5)]


def test_surge_and_dive_by_brute_force():
    rng = random.Random(6)
    for _ in range(3000):
        weights = [rng.choice([0, 0, 0, 1, 5, 14, 30, 90, 400]) for _ in range(rng.randint(0, 25))]
        kw = {"block": rng.choice([1, 2, 3, 5]), "surge": rng.choice([1, 20, 80]), "share": rng.choice([0.3, 1]), "dive": rng.choice([1, 15])}
        got = {k for i, j in spans(weights, **kw) for k in range(i, j)}
        kept, inside = set(), False
        sums = [sum(weights[i : i + kw["block"]]) for i in range(len(weights))]
        high = min(kw["surge"], kw["share"] * max(sums, default=0))
        run = []
        for i, w in enumerate(weights):
            inside = high > 0 and (sums[i] >= min(kw["dive"], high) if inside else sums[i] >= high and w > 0)
            run = [*run, i] if inside else []
            if inside and w:
                kept.update(run)
        assert got == kept, (weights, kw)


def test_names_inside_the_article():
    text = "This paragraph is long enough to be taken for text by any measure, and so it is."
    page = f'<div class="site-header"><p>{text}</p></div><article><div class="entry-header"><h1>Title</h1></div><p>{text}</p><div class="related-work"><p>Related work.</p></div><div class="ad"><p>{text}</p></div><p>End.</p></article><div class="comments"><p>{text}</p></div>'
    assert main_text(page) == f"Title {text} Related work. End."
    page = f'<div class="page with-sidebar"><h1>Title</h1><p>{text}</p><div class="side-bar widget"><p>{text}</p></div><p>{text}</p></div>'
    assert main_text(page) == f"Title {text} {text}"


def test_tag_is_no_short_cut():
    text = "".join(f"<p>Paragraph {i} of the text has quite a number of words, so its line is long.</p>" for i in range(6))
    around = "".join(f"<div><a href=/{i}>Go to {i}</a></div>" for i in range(8))
    got = [main_text(f"<body>{around}<{tag}><h1>Title</h1>{text}<p>End.</p></{tag}>{around}</body>") for tag in ("article", "main", "div", "section")]
    assert len(set(got)) == 1 and got[0].startswith("Title Paragraph 0") and got[0].endswith("long. End.")


@pytest.mark.parametrize("part", ["<a ", '<a ">" ', "<script>", "<!--", "<div class=ad>", '<a "', "<p>x", "<article><p>a</p></article>", "<", "</", "<!", ' a="b"', "<b>", "&lt;"])
def test_time_is_linear(part):
    start = time.monotonic()
    main_text("<p>y" + part * (1_000_000 // len(part)))
    assert time.monotonic() - start < 5


def test_broken_pages():
    assert main_text(None) == main_text("") == main_text("<p></p>") == main_text("<script>x</script>") == ""
    assert main_text("<div class=ad>never closed <p>but the text goes on</p>") == "never closed but the text goes on"
    assert main_text("a < b") == "a < b"
    assert main_text("<article><p>open") == "open"
    assert main_text("<p>x" * 3000) == " ".join(["x"] * 3000)


def test_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", "")], "page_id long, url string, html string")
    got = extract(df).collect()
    assert sorted((r.n_chars == len(r.text), r.text == "") for r in got) == [(True, False)] * 2 + [(True, True)] * 2
    assert got[0].text == got[1].text and extract(df.limit(0)).count() == 0
