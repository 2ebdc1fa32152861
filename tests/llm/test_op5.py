import html
import math
import random
import re
import time
from html.parser import HTMLParser

import pyarrow.parquet as pq

from cairn.llm.op5_html import extract, main_text


def by_construction(page):
    """The generated pages hold their article in one article element; its paragraphs and headline are the blocks."""
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1].replace("<br>", " ")
    parts = [html.unescape(re.sub(r"<[^>]*>", "", b)) for b in re.split(r"</?(?:p|h1)>", inner)]
    return "\n\n".join(s for b in parts if (s := re.sub(r"\s+", " ", b).strip()))


def test_all_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = {r.page_id: by_construction(r.html) for r in pages.collect()}
    out = main_text(pages).collect()
    assert len(out) == len(want)
    for r in out:
        assert r.text == want[r.page_id] and r.n_chars == len(r.text)


LONG = "A paragraph with a decent amount of running text, &amp; more of it so that it is dense."
PLAIN = LONG.replace("&amp;", "&")


def test_page_without_article_element():
    page = f"""<html><head><title>t</title></head><body class="has-sidebar"><div id="header"><h1>Site</h1><a href=x>home</a></div>
    <div class="wrap"><div class="sidebar"><p>{LONG}</p></div><div class="content"><h1>Title</h1><p>{LONG}</p><p>{LONG} <a href=q>link</a>
    again</p><ul><li>one</li><li>two</li></ul><p>Short.</p><div class="share-box">Share</div></div>
    <div id="comments"><p>{LONG}</p></div></div><div class="cookieNotice">cookies</div><form><p>Sign up</p><input></form><footer>f</footer></body></html>"""
    assert extract(page).split("\n\n") == ["Title", PLAIN, f"{PLAIN} link again", "one", "two", "Short."]


def test_comments_and_headline_inside_the_article():
    page = f"""<body><article><header class="entry-header"><h1>Head</h1></header><p>{LONG}</p><aside>side</aside>
    <section class="reader-comments"><article class="comment"><p>{LONG}</p></article></section></article></body>"""
    assert extract(page).split("\n\n") == ["Head", PLAIN]


def test_edges(spark):
    assert extract(None) == extract("") == extract("<html><body></body></html>") == extract("<script>x") == ""
    assert extract("a < b and <b>bold</b>") == "a < b and bold"
    assert extract("<main><p title=it's>one<p>two <table><tr><td>x<td>y</table></main>").split("\n\n") == ["one", "two", "x", "y"]
    deep = "<div>" * 20000 + LONG + "</div>" * 20000
    assert extract(deep) == PLAIN
    rows = [(1, None, None, "z"), (1, "u", "<p>x", "z"), (None, "u", "", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in main_text(df).collect()) == [(0, "", 0), (1, "", 0), (1, "x", 1)]
    assert main_text(df.limit(0)).count() == 0


def test_missing_end_tags_lose_no_text():
    for tag in "video audio canvas object svg math template noscript iframe textarea title".split():
        assert extract(f"<body><{tag}><article><p>{LONG}</p><p>Last.</p></article></body>").split("\n\n") == [PLAIN, "Last."], tag
        assert extract(f"<body><article><p>{LONG}</p><{tag}><p>{LONG}</p></article><p>x</p></body>").split("\n\n") == [PLAIN, PLAIN], tag


def test_formulas_stay_and_what_is_not_shown_goes():
    math = "<math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math>"
    page = f"<article><p>{LONG} {math} holds.</p><object><object>a</object>b</object><p>{LONG}</p><video>no video</video><noscript>c</noscript><svg><desc>d</desc><path d='M0'/></svg><template><p>t</p></template><p>End.</p></article>"
    assert extract(page).split("\n\n") == [f"{PLAIN} x=2 holds.", PLAIN, "End."]


def test_blocks_of_a_marked_article_stay():
    links = "<a href=a>A first source of this</a> <a href=b>A second source of this</a>"
    kept = "".join(f"<{t}>{links}</{t}>" for t in ("div", "section")) + f"<ul><li>{links}</li></ul><table><tr><td>{links}</td></tr></table>"
    words = "".join(f'<div class="{w}">{w} text</div>' for w in ("toc", "legal", "copyright", "disclaimer", "search"))
    page = f"<body><nav>{links}</nav><article><p>{LONG}</p>{kept}{words}<label>Named</label><div class=sidebar>{links}</div><nav>{links}</nav></article></body>"
    source = "A first source of this A second source of this"
    assert extract(page).split("\n\n") == [PLAIN, *[source] * 4, "toc text", "legal text", "copyright text", "disclaimer text", "search text", "Named"]


def test_a_form_around_the_page_keeps_its_text():
    inner = f"<label>Mail <input></label><select><option>o</select><textarea>t</textarea><button>Go</button><h1>Title</h1><p>{LONG}</p>"
    for page in (
        f'<body><form id="aspnetForm" role="form">{inner}</form></body>',
        f'<body><form id="aspnetForm"><nav>n</nav><article>{inner}</article><footer>f</footer></form></body>',
        f"<body><article><form>{inner}</form></article></body>",
        f"<body><div>{inner}</div><form><fieldset><legend>Sign up</legend><input></fieldset></form></body>",
    ):
        assert extract(page).split("\n\n") == ["Title", PLAIN], page
    assert extract(f"<body><article><p>{LONG}</p><form class=newsletter><p>Sign up</p></form></article></body>") == PLAIN


class Plain(HTMLParser):
    """A tree of well-formed pages as nested lists [tag, children], by another parser."""

    def __init__(self, page):
        super().__init__()
        self.open = [["#root", []]]
        self.feed(page)
        self.close()
        self.root = self.open[0]

    def handle_starttag(self, tag, attrs):
        node = [tag, []]
        self.open[-1][1].append(node)
        if tag != "br":
            self.open.append(node)

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        self.open[-1][1].append(data)


def plain_density(page):
    """The chosen subtrees of a page without names for boilerplate and without article or main, by definition: each count is
    taken from the subtree itself."""
    root = Plain(page).root

    def kids(x):
        return [y for y in x[1] if not isinstance(y, str)]

    def inner(x):
        return [z for y in kids(x) for z in [y, *inner(y)]]

    def chars(x):
        return len(re.sub(r"\s+", "", "".join(strings(x))))

    def strings(x):
        return [z for y in x[1] for z in ([y] if isinstance(y, str) else strings(y))]

    def links(x):
        return chars(x) if x[0] == "a" else sum(links(y) for y in kids(x))

    ratio = links(root) / max(chars(root), 1)

    def density(x):
        c, t, link, lt = chars(x), max(1, len(inner(x))), max(1, links(x)), max(1, sum(y[0] == "a" for y in inner(x)))
        return c / t * math.log(max(1, c / link * t / lt), math.log(link * c / max(1, c - link) + ratio * c + math.e)) if c else 0

    def total(x):
        return sum(density(y) for y in kids(x)) if kids(x) else density(x)

    (body,) = [x for x in inner(root) if x[0] == "body"]
    up = {id(y): x for x in [root, *inner(root)] for y in kids(x)}
    best_in = lambda x: max([x, *inner(x)], key=total)
    path = [best_in(body)]
    while path[-1] is not body:
        path.append(up[id(path[-1])])
    least = min(density(x) for x in path)
    picked, running = [], {"p", "h2", "ul"}

    def go(x):
        if density(x) >= least:
            top = best_in(x)
            while top[0] not in {"p", "h2", "ul", "li", "div", "body"}:
                top = up[id(top)]
            beside = kids(up[id(top)]) if top[0] in running else []
            picked.extend([top, *[y for y in beside if y[0] in running and chars(y) and links(y) <= 0.7 * chars(y)]])
        if not any(x is y for y in picked):
            for y in kids(x):
                go(y)

    go(body)
    out = []

    def emit(x, inside):
        inside = inside or any(x is y for y in picked)
        if inside and x[0] in {"p", "h2", "ul", "li", "div", "body"}:
            out.append("\n")
        for y in x[1]:
            if isinstance(y, str):
                out.append(y if inside else "")
            else:
                emit(y, inside)
        if inside and x[0] in {"p", "h2", "ul", "li", "div", "body"}:
            out.append("\n")

    emit(body, False)
    return "\n\n".join(s for b in "".join(out).split("\n") if (s := " ".join(b.split())))


def random_page(rng):
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 9)))
    run = lambda n: " ".join(word() for _ in range(n))

    def text():
        return "".join(rng.choice((run(rng.randint(1, 30)), f"<b>{run(3)}</b>", f" <a href=x>{run(2)}</a> ")) for _ in range(rng.randint(1, 5)))

    def block(depth):
        kind = rng.choice(("p", "p", "p", "h2", "div", "div"))
        if kind == "div" and depth < 4:
            return "<div>" + "".join(block(depth + 1) for _ in range(rng.randint(1, 6))) + "</div>"
        return f"<p>{text()}</p>" if kind != "h2" else f"<h2>{run(4)}</h2>"

    return "<html><body>" + f"<p>{run(9)}</p>" + "".join(block(0) for _ in range(rng.randint(1, 6))) + "</body></html>"


def test_equals_an_independent_density():
    rng = random.Random(5)
    for _ in range(150):
        page = random_page(rng)
        assert extract(page) == plain_density(page), page


def test_pages_without_article_elements(sf):
    """The density alone finds the text where the mark is taken away."""
    for r in pq.read_table(f"{sf}/pages.parquet").to_pylist():
        page = r["html"].replace("<article>", "<div>").replace("</article>", "</div>")
        assert extract(page) == by_construction(r["html"])


def test_a_teaser_is_not_the_article():
    story = "".join(f"<p>{LONG} {i}</p>" for i in range(10))
    for page in (f"<body><article><p>Short teaser</p></article><div>{story}</div></body>", f"<body><div>{story}</div><div><article>Short teaser</article></div></body>"):
        text = extract(page)
        assert all(f"{PLAIN} {i}" in text.split("\n\n") for i in range(10))


def test_references_and_named_paragraphs_stay():
    links = "".join(f"<li><a href=x{i}>A source of this text, number {i}</a></li>" for i in range(5))
    want = [PLAIN, PLAIN, "The share price rose.", *[f"A source of this text, number {i}" for i in range(5)]]
    for a, b in (("<article>", "</article>"), ("<div>", "</div>"), ("", "")):
        page = f"<body>{a}<p>{LONG}</p><p>{LONG}</p><p class=shareprice>The share price rose.</p><ul>{links}</ul>{b}</body>"
        assert extract(page).split("\n\n") == want, page


def test_time_grows_with_the_page():
    for page in ("<a " * 300_000, '<a "' * 100_000, '<a b=">" ' * 50_000, '<a b="x" c=">' * 50_000, "<div>" * 30_000 + "<li>" * 30_000, "<p><table><td>" + "<div>" * 50_000, "<textarea>" * 50_000, "<header>" * 30_000 + "x"):
        start = time.process_time()
        extract(page)
        assert time.process_time() - start < 5, page[:20]
