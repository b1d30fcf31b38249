import random

from corpusloom.llm import html_text
from corpusloom.llm.html_text import Line, extract, lines, main_text, spans, telling

L = "Text that goes on and on until it is long enough to be an article. " * 3
L = L.strip()

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body class="page"><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- x -->
<div class="ad">Buy</div><article><header><h1>Head &amp; line</h1></header><p><b>One&nbsp; two<br>three<p>Four &lt;b&gt; 5 < 6</p><div class="cookie-notice"><div>We</div> use</div><p></p><form>Mail <input></form>
<p>Last one</p><section class="comments"><article>No!</article></section></article><footer>&copy; x</footer></body></html>"""


def test_page():
    assert main_text(PAGE) == "Head & line\n\nOne two three\n\nFour <b> 5 < 6\n\nLast one"


def test_cut_off():
    assert main_text("<article><p>ab &amp cd</p><p>ef</artic") == "ab & cd\n\nef"
    assert main_text('<body><div class="ad"><p>' + "word " * 40 + "<p>short") == ("word " * 40).strip() + "\n\nshort"
    assert main_text(None) == main_text("") == main_text("<p") == main_text("<script>x") == ""


def test_unmarked_page():
    long = "Text that goes on. " * 10
    page = f"<ul><li><a href=x>Home</a><li><a href=y>News</a></ul><p>{long}<p>tiny<p>{long}<hr><ul><li><a>More</a></ul>"
    assert main_text(page) == "\n\n".join([long.strip(), "tiny", long.strip()])
    assert main_text("<p>just this") == "just this"


def brute(page, window, share, surge, most):
    """The chosen lines, one decision after the other: lists of line numbers."""
    plain = [max(0, len(x.text) - 2 * x.link) for x in page]
    if not any(plain):
        return []
    sums = [sum(plain[i : i + window]) for i in range(len(plain))]
    parts, here = [], []
    for i in range(len(plain)):
        if plain[i]:
            here.append(i)
        elif here and all(p == 0 for p in plain[i : i + window]) or not any(plain[i:]):
            parts, here = [*parts, here] if here else parts, []
    parts = [*parts, here] if here else parts
    parts = [list(range(p[0], p[-1] + 1)) for p in parts]
    top = max(sums)
    if top < surge:
        best = max(sum(plain[i] for i in p) for p in parts)
        runs = [next(p for p in parts if sum(plain[i] for i in p) == best)]
    else:
        bar = min(max(surge, share * top), most)
        runs = [p for p in parts if any(sums[i] >= bar for i in p)]
    joined = []
    for run in runs:
        if joined and sum(page[i].text != "" for i in range(joined[-1][-1] + 1, run[0])) <= 8:
            joined[-1] = list(range(joined[-1][0], run[-1] + 1))
        else:
            joined.append(run)
    weight = lambda p: sum(plain[i] for i in p)
    out = []
    for run in joined:
        if 4 * weight(run) >= max(map(weight, joined)):
            with_text = [i for i in range(out[-1] + 1 if out else 0, run[0]) if page[i].text]
            if with_text and page[with_text[-1]].heading and not page[with_text[-1]].link and run[0] - with_text[-1] <= 2 * window + 1:
                out.append(with_text[-1])
            out += run
    return out


def test_spans():
    rng = random.Random(3)
    for _ in range(3000):
        page = [rng.choice([Line(), Line(), Line(), Line("x" * rng.choice([1, 5, 30, 90, 400])), Line("y" * 20, rng.choice([10, 20])), Line("h" * 12, 0, True)]) for _ in range(rng.randrange(40))]
        w, share, surge, most = rng.randrange(1, 5), rng.choice([0.1, 0.2, 0.6]), rng.choice([1, 30, 80]), rng.choice([100, 200])
        got = spans(page, w, share, surge, most)
        got = [k for i, j in got for k in range(i, j)]
        want = brute(page, w, share, surge, most)
        assert [k for k in got if page[k].text] == [k for k in want if page[k].text], (page, w, share, surge, most)


def test_whole_text_is_the_chosen_lines():
    for html in [*WANTED, PAGE]:
        page = lines(html)
        assert main_text(html) == "\n\n".join(page[k].text for k in brute(page, 2, 0.2, 80, 200) if page[k].text)


WANTED = {  # layouts written by hand, and what a reader would call their text
    f"<nav>A B C</nav><div class=main-content><h1>Head</h1><p>{L}</p><p>Short.</p><p>{L}</p></div><footer>f</footer>": f"Head\n\n{L}\n\nShort.\n\n{L}",
    f"<div><a href=a>Home</a></div><article>teaser</article><div><a>x</a></div><div><a>y</a></div><div><a>z</a></div><p>{L}</p><p>{L}</p>": f"{L}\n\n{L}",
    f"<main><p>{L}<p><a href=x>See the long list of all that is linked here</a><p>{L}</main>": f"{L}\n\nSee the long list of all that is linked here\n\n{L}",
    f"<table><tr><td><ul><li><a>n</a></ul></td><td><p>{L}</p></td></tr></table>": L,
    f"<aside>side</aside><section><h2>Two</h2><p>{L}</p></section><div id=comments><p>{L}</p></div>": f"Two\n\n{L}",
    f"<div role=navigation>Go</div><blockquote>{L}</blockquote><div role=contentinfo>{L}</div>": L,
    f"<article><h1>T</h1><div class=ad>Buy</div><div class=share>S</div><form>F</form><p>{L}</p></article><p>{'out ' * 9}</p>": f"T\n\n{L}",
    "<p>a<p>b": "a\n\nb",
    f"<article><p>{L}</p></article><div>&copy; 2020</div>": L,
    f"<pre>x  y\nz</pre><p>{L}": f"x y z\n\n{L}",
}


def test_layouts():
    for html, text in WANTED.items():
        assert main_text(html) == text, html


def test_window_and_surge_decide():
    page = f"<div>one short line</div><div>{L}</div><div>another</div><div>{L}</div><div>and the last of them</div>"
    assert main_text(page) == f"{L}\n\nanother\n\n{L}"
    assert main_text(page, surge=1, share=0) == f"one short line\n\n{L}\n\nanother\n\n{L}\n\nand the last of them"
    assert main_text(page, surge=10**6) == L
    page = f"<ul><li>a<li>b</ul><p>{L}</p>"
    assert main_text(page, window=1) == L and main_text(page) == f"a\n\nb\n\n{L}"


def test_no_telling_names():
    """What goes by the distribution alone: neighbours of the text in containers of their own."""
    body = "".join(f"<p>Part {i}. {L}</p>" for i in range(8))
    text = "\n\n".join(f"Part {i}. {L}" for i in range(8))
    menu = "<div>" + "".join(f"<div>{x}</div>" for x in ("Home", "News", "Sport", "Culture", "Weather")) + "</div>"
    legal = "<div><p>All rights reserved, 2020.</p><p>No part may be copied.</p><p>Imprint and terms of use</p></div>"
    advert = "<div>Buy one of these now, and get another one for nothing</div>"
    remarks = "<div><div>Ann</div><div>Well said.</div></div><div><div>Bob, at ten</div><div>I have read this twice</div></div>"
    links = "<div>" + "".join(f"<p><a href=x>Another article that you may like to read {i}</a></p>" for i in range(9)) + "</div>"
    assert main_text(f"{menu}{advert}<div>{body}</div>{remarks}{links}{legal}") == text
    assert main_text(f"<div><article><p>{'teaser words ' * 49}</p></article></div><div>{body}</div>").count("Part") == 8
    inside = "".join(f"<p><a href=x>See the long page {i} about it</a></p>" for i in range(4))
    assert main_text(f"<article><p>{L}</p>{inside}<p>{L}</p></article>").count("See the long page") == 4
    assert main_text(f"<div><h2>The title</h2></div><div><p>{L}</p></div>") == f"The title\n\n{L}"


def test_telling_names():
    for name in "article-comments post-comments story-share entry-footer main-menu content-sidebar text-ad comment-list nav-links ad comments".split():
        assert telling(name) and "gone" not in main_text(f"<article><p>{L}</p><div class='x {name}'><p>gone {L}</p></div><p>{L}</p></article>")
    for name in "discussion form notice-board share-price search-results-analysis ad-hoc article story- _".split():
        assert not telling(name) and "here" in main_text(f"<article><p>{L}</p><div class={name}><p>here {L}</p></div><p>{L}</p></article>")


def test_given_pages_without_class_names(spark, monkeypatch):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    want = [main_text(h) for h in pages]
    monkeypatch.setattr(html_text, "telling", lambda name: False)
    assert sum(main_text(h) == w for h, w in zip(pages, want)) >= 0.95 * len(pages)
    monkeypatch.setattr(html_text, "_NEVER", frozenset(["head"]))
    assert sum(main_text(h) == w for h, w in zip(pages, want)) >= 0.85 * len(pages)


def test_query(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "c"), (2, None, None, "c"), (3, "u", "", "c"), (1, "u", PAGE, "c")], "page_id long, url string, html string, text string")
    rows = sorted(tuple(r) for r in extract(df).collect())
    assert [(r[0], r[3]) for r in rows] == [(1, 52), (1, 52), (2, 0), (3, 0)] and rows[0] == rows[1]
    assert extract(df.limit(0)).count() == 0
