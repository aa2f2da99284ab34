import random
from html.parser import HTMLParser

import pytest

from wattle.llm import html_text as H

PAGE = """<!DOCTYPE html><html><head><title>Site &amp; page</title><style>p{color:red}</style><script>var t="</p><p>no</p>";</script></head>
<body class="has-sidebar"><header><p>Header text, with commas, many, many of them, long enough to count as text of a page.</p></header>
<nav><ul><li><a href="/a">Menu one</a></li><li><a href="/b">Menu two</a></li></ul></nav>
<div id="cookie-notice">We use cookies, please agree, it is for the best, and we mean it.</div>
<div class="layout"><div class="side-bar sidebar"><p>Sidebar, with a long text, that has commas, and more words than you would like.</p></div>
<main><article class="post"><h1>The title</h1><p>First <b>para</b>graph,&nbsp;with a comma &amp; more text than a short one has.</p>
<div class="ad">Buy now, and save money, today and tomorrow, while there is any.</div>
<p>Second paragraph<br>with a line break, and some more words to read.</p><ul><li>One item</li><li>Two items</li></ul>
<form><p>Your name, please, and your mail</p><input></form><p>Short end.</p>
<ul><li><a href="/1">More of this</a></li><li><a href="/2">And of that</a></li></ul></article>
<section id="comments"><article class="comment"><p>I read this, and I liked it, very much indeed, thank you all.</p></article></section></main></div>
<footer><p>&copy; Nobody, all rights reserved, and so on, and so on.</p></footer></body></html>"""


def test_boilerplate_goes():
    assert H.extract_text(PAGE) == ("The title First paragraph, with a comma & more text than a short one has. "
                                    "Second paragraph with a line break, and some more words to read. One item Two items Short end.")


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("<div></div>", ""), ("just text &lt;here&gt;", "just text <here>"), ("<nav>menu</nav>", ""),
    ("<p>a<p>b", "a b"), ("<p>un<i>br</i>oken   words\n\there", "unbroken words here"), ("<article><p>cut of", "cut of"),
    ("<article><p>cut <a hre", "cut"), ("<!-- x --><article><!----><p>seen</p><!-- <p>not seen</p>", "seen"),
    ("<head><title>t</title><p>No end of head, but a paragraph.</p>", "No end of head, but a paragraph."),
    ("<div class='widget-page'><article><p>All in a widget.</p></article></div>", "All in a widget."),
    ("<div class='cookie-notice'>Nothing but this.</div>", ""), ("<p hidden>no</p><p style='display: none'>no</p><p>yes</p>", "yes"),
    ("<p title='a > b' data-x=it's>quoted</p>", "quoted"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"),
    ("<article><ul><li>x<ul><li>y</ul><li>z</ul></article>", "x y z"), ("<p>&#" + "0" * 6000 + "65;&#" + "9" * 6000 + ";</p>", "A�"),
    ("<p>x</p></div></span><p>y</p>", "x y"), ("<svg><text>no</text></svg><p>in</p>", "in"),
])
def test_cases(html, text):
    assert H.extract_text(html) == text


def test_siblings_and_wrappers():
    long = "A sentence of the article, long enough, with commas, so that it counts. "
    parts = [f"{i} {long * 3}".strip() for i in range(6)]
    sections = "".join(f"<section><p>{a}</p><p>{b}</p></section>" for a, b in zip(parts[::2], parts[1::2]))
    assert H.extract_text(f"<body><div class='menu'><p>{long}</p></div><div>{sections}</div></body>") == " ".join(parts)
    wrapped = "".join(f"<div><div><p>{a}</p></div></div>" for a in parts)
    assert H.extract_text(f"<article>{wrapped}</article>") == " ".join(parts)
    plain = "<br><br>".join(parts)
    assert H.extract_text(f"<div id='content'>{plain}</div><div class='footer'>{long * 9}</div>") == " ".join(parts)


@pytest.mark.parametrize("unit", ["<p>", "<div>", "<a '", '<b c="', "<b><hr>", "<p>Short one.</p>", "&", "<", "<!--", "<td>x", "</p>", "<li>x", "<p><a>y</a>z."])
def test_linear_in_long_pages(unit):
    H.extract_text(unit * 60_000)


class Tree(HTMLParser):
    """The same tree for well-formed pages, by the standard library's parser."""

    def __init__(self, source):
        super().__init__(convert_charrefs=True)
        self.root = self.now = {"tag": "#page", "attrs": {}, "kids": [], "up": None}
        self.feed(source)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = {"tag": tag, "attrs": {k: v or "" for k, v in attrs}, "kids": [], "up": self.now}
        self.now["kids"].append(node)
        if tag not in H.VOID:
            self.now = node

    def handle_endtag(self, tag):
        if tag not in H.VOID:
            self.now = self.now["up"]

    def handle_data(self, data):
        self.now["kids"].append(data)


def brute_text(source):
    """The definition, written with recursion and dictionaries."""
    root = Tree(source).root
    blocks = []  # (owner, text, link characters)
    held = []
    order = []  # block elements in page order

    def flush(owner):
        text = " ".join("".join(t for t, _ in held).split())
        if text:
            blocks.append((owner, text, min(len(text), sum(len(" ".join(t.split())) for t, a in held if a))))
        held.clear()

    def walk(node, owner, in_link):
        if isinstance(node, str):
            held.append((node, in_link))
            return
        if node["tag"] == "br":
            held.append((" ", in_link))
            return
        block, out = node["tag"] in H.BLOCK or node["tag"] == "#page", H.is_junk(node["tag"], node["attrs"], True)
        if block or out:
            flush(owner)
        if out:
            return
        if block:
            order.append(node)
            node["above"] = owner
        for kid in node["kids"]:
            walk(kid, node if block else owner, in_link or node["tag"] == "a")
        if block:
            flush(node)

    walk(root, None, False)

    def inside(node, container):
        while node is not None and node is not container:
            node = node["above"]
        return node is container

    chars = lambda c: sum(len(t) for o, t, _ in blocks if inside(o, c))
    density = lambda c: sum(k for o, _, k in blocks if inside(o, c)) / chars(c) if chars(c) else 1.0

    def score(c):
        total = 0.0
        for owner, text, linked in blocks:
            if owner["tag"] in H.HEADING:
                continue
            node, weights = (owner["above"] if owner["tag"] in H.PARAGRAPH else owner), [1, 1 / 2, 1 / 6, 1 / 9, 1 / 12]
            for w in weights:
                if node is None:
                    break
                if node is c:
                    total += H.points(text, linked) * w
                node = node["above"]
        return total * H.factor(c["tag"], c["attrs"]) * (1 - density(c)) if chars(c) else 0.0

    if not blocks:
        return ""
    best = max(order, key=lambda c: (round(score(c), 9), chars(c)))
    around = best
    while around is not None and around["tag"] != "article":
        around = around["above"]
    if around is not None and 2 * chars(best) >= chars(around):
        best = around
    kept = [best]
    for node in order:
        if best["above"] is not None and node.get("above") is best["above"] and node is not best and chars(node):
            own = [t for o, t, _ in blocks if o is node]
            ends = bool(own) and own[-1][-1] in ".!?"
            if score(node) >= 0.2 * score(best) or node["tag"] == "p" and (density(node) < 0.25 if chars(node) > 80 else density(node) == 0 and ends):
                kept.append(node)
    out = [n for n in order if n not in kept and n["tag"] in H.BOXES and chars(n) and density(n) > 0.5 and any(inside(n, k) for k in kept)]
    return " ".join(t for o, t, _ in blocks if any(inside(o, k) for k in kept) and not any(inside(o, n) for n in out))


def random_page(rng):
    def text():
        return " ".join(rng.choice(["word", "more,", "of it.", "a", "longer&amp;", "end."]) for _ in range(rng.randrange(1, 40)))

    def inline():
        return "".join(rng.choice([text() + " ", f"<b>{text()}</b>", f"<a href='/x'>{text()}</a>", "<br>", "<img src=x>"]) for _ in range(rng.randrange(1, 4)))

    def block(depth):
        kind = rng.choice(["p", "p", "p", "div", "section", "article", "ul", "h2", "blockquote", "aside"])
        named = rng.choice(["", "", "", " class='content'", " class='ad box'", " id=comments", " class='meta'"])
        if kind == "ul":
            return f"<ul{named}>" + "".join(f"<li>{inline()}</li>" for _ in range(rng.randrange(1, 4))) + "</ul>"
        if kind in ("p", "h2") or depth > 4:
            return f"<p{named}>{inline()}</p>" if kind != "h2" else f"<h2>{inline()}</h2>"
        return f"<{kind}{named}>" + "".join(rng.choice([block(depth + 1), block(depth + 1), text()]) for _ in range(rng.randrange(1, 5))) + f"</{kind}>"

    return "<html><body>" + "".join(block(0) for _ in range(rng.randrange(1, 6))) + "</body></html>"


def test_random_pages():
    rng = random.Random(12)
    for _ in range(150):
        page = random_page(rng)
        if H.read(page).text:
            assert H.extract_text(page) == brute_text(page), page


def test_query_and_columns(spark, tmp_path):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "y"), (2, None, "", "y"), (None, "v", "<p>é 😀</p>", "z"), (3, "w", "<p>long, </p>" * 50_000, "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert [r["text"] for r in H.extract(df).collect()] == [H.extract_text(r[2]) for r in rows]
    df.write.parquet(f"{tmp_path}/pages.parquet")
    out = H.op12_html_main_text(spark, str(tmp_path))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(((i, u, H.extract_text(h), len(H.extract_text(h))) for i, u, h, _ in rows), key=str)
    assert H.extract(df.limit(0)).collect() == []
