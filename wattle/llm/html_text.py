"""Main text of web pages by tree scoring.

A page is read once, left to right, into a tree of its block elements (``read``): end tags that HTML leaves out are
supplied, and what sits in menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments (by element, role or the words of class and id) is passed over.  A stretch of text between two block
boundaries is a block.  Each block that is not a heading is a paragraph and earns points: one point (less if it is
shorter than SHORT), one for each comma and one for each 100 characters, all discounted by its share of link text.
They pass to the element that holds the paragraph in full, to the one above by a half and to the next ones by
1 / (3 steps), five in all.  An element's score is its points times a factor for its kind and class, times one
less its link density.  The best element is the container; an ``article`` around it takes its place when the
container has half of the article's text.  Beside the container, siblings with a fifth of its score, and
paragraphs of few links that are long or end a sentence, are kept.  Lists and boxes in it made of links are menus and go.

Text: character references are decoded; white space inside a block becomes one space; blocks are joined in page order
by one space.  Nothing is cut at any length, and every step is linear in the page: open elements are found by their
name, never by a search through the stack.

Defined results: null or empty html, and html without text, give an empty text; html cut off anywhere is read as far
as it goes; where the class words leave no text at all and the page has an ``article``, ``main`` or ``h1``, it is read again by its elements alone; of equally
good containers the first stays; repeated rows give equal rows; an empty table gives an empty one; other columns pass
through ``extract``, and one named as its output is replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattle.llm.common import bound_batches, release_memory
from wattle.llm.registry import register, table

#: A comment, a declaration, an end tag, or a start tag with its attributes; quotes count after ``=`` only.
_TAG = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+>?|</([a-zA-Z][^\s/>]*+)[^>]*+>?|<([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?|["'])*+)>?""",
    re.S)
_ATTRIBUTE = re.compile(r"""([^\s/>"'=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?""")
_LONG_NUMBER = re.compile(r"&#0*+([0-9]*+);?(?<=[0-9;]{9})")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text up to their end tag, whatever stands in it.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td
    tfoot th thead tr ul""".split())
HEAD_CONTENT = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: Block elements that end an open paragraph.
ENDS_P = BLOCK - frozenset("body caption head html legend noscript optgroup option select tbody td tfoot th thead tr".split())
#: An end tag doesn't reach beyond these; nor does a start tag that ends another element.
WALL = frozenset("table td th caption button object template select".split())
#: Start tag -> elements that it ends, and those that shield them.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("table",)), "th": (("td", "th"), ("table",)), "tbody": (("thead", "tbody", "tfoot"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot"), ("table",)), "option": (("option",), ("select",)), "a": (("a",), ()),
}
TABLE_PARTS = frozenset("table caption thead tbody tfoot tr td th".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold one paragraph; their points go to the element around them.
PARAGRAPH = frozenset("p pre li dd dt figcaption caption summary address legend td th".split()) | HEADING

JUNK_TAGS = frozenset("""nav header footer aside form script style noscript template iframe object embed svg canvas audio video button select textarea
    input datalist dialog menu head title search noembed noframes xmp map math""".split())
JUNK_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog status menu menubar toolbar tablist".split())
#: Words of class or id that name what is not the article.
JUNK_WORDS = frozenset("""ad ads adv advert adverts advertisement advertisements advertising adsense adbox sponsor sponsored sponsors sponsorship promo promos promoted
    promotion banner banners nav navbar navigation menu menus submenu breadcrumb breadcrumbs crumbs pagination pager paginator sidebar sidenav sidepanel
    aside rail header masthead topbar footer foot comment comments commentlist disqus reply replies respond guestbook cookie cookies consent gdpr notice notices
    notification alert popup modal overlay lightbox toast newsletter subscribe subscription signup signin login register paywall share sharing
    social follow related recommended recommendations trending popular widget widgets toolbar searchbox searchform copyright skip hidden""".split())
GOOD_WORDS = frozenset("article articlebody body content entry main post story text blog prose".split())
BAD_WORDS = frozenset("meta tags tag tool tools outbrain shoutbox teaser extra links byline author caption credits".split())
NEVER_JUNK_BY_CLASS = frozenset(("html", "body", "main"))
BOXES = frozenset("ul ol dl div section table".split())

#: A paragraph of fewer characters earns a part of its one point; so many steps up pass points.
SHORT, STEPS = 25, 5
_COMMA = re.compile("[,،、，﹐︐⹁]")
_SENTENCE_END = re.compile(r"[.!?。！？…][\"'”’)\]]*$")


def decode(text: str) -> str:
    """Character references decoded as HTML does; numbers of very many digits too, which ``int`` refuses."""
    if "&" not in text:
        return text
    return entities.unescape(_LONG_NUMBER.sub(lambda m: f"&#{m[1][:8] or 0};", text))


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), decode(a or b or c))
    return out


def class_words(attributes: dict[str, str]) -> list[str]:
    return [w.lower() for w in _WORD.findall(attributes.get("class", "") + " " + attributes.get("id", ""))]


def is_junk(tag: str, attributes: dict[str, str], by_class: bool) -> bool:
    """Whether an element is passed over with all in it."""
    if tag in JUNK_TAGS:
        return True
    if not attributes or tag in NEVER_JUNK_BY_CLASS:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or attributes.get("role", "").lower() in JUNK_ROLES:
        return True
    if re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I):
        return True
    if not by_class:
        return False
    words = class_words(attributes)
    return any(w in JUNK_WORDS and (k == 0 or words[k - 1] not in ("has", "no", "with", "without")) for k, w in enumerate(words))


def factor(tag: str, attributes: dict[str, str]) -> float:
    """How much an element's kind and class speak for its being the container."""
    words = set(class_words(attributes)) if attributes else set()
    out = 1.5 if tag in ("article", "main") or attributes.get("role") in ("article", "main") or attributes.get("itemprop", "").lower() == "articlebody" else 1.0
    out *= 0.5 if tag in ("ul", "ol", "dl", "li", "table", "thead", "tfoot", "tr", "fieldset") else 1.0
    return out * (1.25 if words & GOOD_WORDS else 1.0) * (0.5 if words & BAD_WORDS else 1.0)


class Page:
    """Block elements in order of their start tags, and the blocks of text with the element that holds each."""

    def __init__(self):
        self.parent, self.tag, self.factor, self.end = [-1], ["#page"], [1.0], [0]
        self.owner: list[int] = []
        self.text: list[str] = []
        self.links: list[int] = []  # characters of link text in each block

    def add(self, parent: int, tag: str, worth: float) -> int:
        self.parent.append(parent), self.tag.append(tag), self.factor.append(worth), self.end.append(0)
        return len(self.tag) - 1


def read(source: str, by_class: bool = True) -> Page:
    page = Page()
    #: Open elements: (tag, block element or -1, junk); and the places of each tag on this stack.
    stack: list[tuple[str, int, bool]] = [("#page", 0, False)]
    places: dict[str, list[int]] = {}
    walls: list[int] = [0]
    blocks: list[int] = [0]
    junk = 0
    held: list[str] = []
    link_chars = 0

    def flush():
        nonlocal link_chars
        if held:
            text = " ".join("".join(held).split())
            if text:
                page.owner.append(blocks[-1]), page.text.append(text), page.links.append(min(link_chars, len(text)))
            held.clear()
        link_chars = 0

    def put(raw: str):
        nonlocal link_chars
        if junk or not raw:
            return
        text = decode(raw)
        held.append(text)
        if places.get("a"):
            link_chars += len(" ".join(text.split()))

    def pop_to(depth: int):
        nonlocal junk
        while len(stack) > depth:
            tag, node, was_junk = stack.pop()
            places[tag].pop()
            if tag in WALL:
                walls.pop()
            if was_junk:
                junk -= 1
            if node >= 0:
                flush()
                blocks.pop()
                page.end[node] = len(page.tag)

    def last(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    at = 0
    while True:
        found = _TAG.search(source, at)
        if not found:
            put(source[at:])
            break
        put(source[at:found.start()])
        at = found.end()
        name = found[1]
        if name:
            name = name.lower()
            depth = last((name,))
            if depth >= 0 and (name in WALL or name in TABLE_PARTS or depth > walls[-1]):
                pop_to(depth)
            elif name in ("br", "p"):
                flush() if name == "p" else put(" ")
            continue
        name = found[2]
        if not name:
            continue
        name = name.lower()
        if name == "br":
            put(" ")
            continue
        if name in ENDS_P and last(("p",)) > walls[-1]:
            pop_to(last(("p",)))
        if places.get("head") and name not in HEAD_CONTENT:
            pop_to(places["head"][-1])
        if name in ENDS:
            ended, shields = ENDS[name]
            depth = last(ended)
            if depth > (last(shields) if shields else walls[-1]):
                pop_to(depth)
        attributes = _attributes(found[3]) if found[3].strip(" \t\n\r\f/") else {}
        if name in VOID:
            if name == "hr":
                flush()
            continue
        if name in RAW:
            closing = _RAW_END[name].search(source, at)
            at = closing.start() if closing else len(source)
            end = source.find(">", at)
            at = len(source) if end < 0 else end + 1
            continue
        is_out = is_junk(name, attributes, by_class)
        node = -1
        if name in BLOCK or is_out:
            flush()
        if name in BLOCK:
            node = page.add(blocks[-1], name, factor(name, attributes))
            blocks.append(node)
        places.setdefault(name, []).append(len(stack))
        stack.append((name, node, is_out))
        if name in WALL:
            walls.append(len(stack) - 1)
        junk += is_out
        if found[3].endswith("/") and name not in BLOCK and is_out:
            pop_to(len(stack) - 1)  # <svg/> and the like
    pop_to(1)
    flush()
    page.end[0] = len(page.tag)
    return page


def points(text: str, links: int) -> float:
    """What a paragraph earns."""
    earned = min(1.0, len(text) / SHORT) + len(_COMMA.findall(text)) + len(text) / 100
    return earned * (1 - links / len(text))


def main_text(page: Page) -> str:
    """The text of the best container and its kept siblings."""
    n = len(page.tag)
    score, chars, links = [0.0] * n, [0] * n, [0] * n
    for owner, text, linked in zip(page.owner, page.text, page.links):
        chars[owner] += len(text)
        links[owner] += linked
        if page.tag[owner] in HEADING:
            continue
        earned = points(text, linked)
        node = page.parent[owner] if page.tag[owner] in PARAGRAPH else owner
        for step in range(STEPS):
            if node < 0:
                break
            score[node] += earned / (step + 1 if step < 2 else 3 * step)
            node = page.parent[node]
    for node in range(n - 1, 0, -1):
        chars[page.parent[node]] += chars[node]
        links[page.parent[node]] += links[node]
    score = [s * f * (1 - k / c) if c else 0.0 for s, f, c, k in zip(score, page.factor, chars, links)]
    best = max(range(n), key=lambda i: (score[i], chars[i], -i))
    if not chars[best]:
        return ""
    around = best
    while around >= 0 and page.tag[around] != "article":
        around = page.parent[around]
    if around >= 0 and 2 * chars[best] >= chars[around]:
        best = around
    closing = dict(zip(page.owner, page.text))  # the last block of each element
    kept = {best}
    if page.parent[best] >= 0:
        node, end = page.parent[best] + 1, page.end[page.parent[best]]
        while node < end:  # from sibling to sibling
            density = links[node] / chars[node] if chars[node] else 1.0
            text_like = page.tag[node] == "p" and (density < 0.25 if chars[node] > 80 else density == 0 and _SENTENCE_END.search(closing.get(node, "")))
            if node != best and chars[node] and (score[node] >= 0.2 * score[best] or text_like):
                kept.add(node)
            node = page.end[node]
    # +1 where a kept element starts, -1 where it ends; menus inside count against it
    level = [0] * (n + 1)
    for node in kept:
        level[node] += 1
        level[page.end[node]] -= 1
    inside, out_until, keep = 0, 0, [False] * n
    for node in range(n):
        inside += level[node]
        if node >= out_until and inside and node not in kept and page.tag[node] in BOXES and chars[node] and 2 * links[node] > chars[node]:
            out_until = page.end[node]
        keep[node] = inside > 0 and node >= out_until
    return " ".join(t for o, t in zip(page.owner, page.text) if keep[o])


def extract_text(source: str | None) -> str:
    if not source:
        return ""
    page = read(source)
    if not page.text:
        page = read(source, by_class=False)
        if not {"article", "main", "h1"} & set(page.tag):
            return ""
    return main_text(page)


def extract(df: DataFrame, html_col: str = "html", output: str = "text") -> DataFrame:
    """``df`` with the main text of each row's html as ``output``."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pages.map(extract_text, na_action=None)
        release_memory()

    return bound_batches(df).withColumn(output, run(F.col(html_col)))


#: The tables' pages have one article each, of headings and paragraphs with bold text and line breaks.
_SQL = r"""
WITH found AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1) AS body FROM pages),
spaced AS (SELECT page_id, url, regexp_replace(regexp_replace(body, '</?(p|h1|br)>', ' ', 'g'), '</?b>', '', 'g') AS body FROM found),
decoded AS (SELECT page_id, url, regexp_replace(replace(replace(replace(body, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;?', '&', 'g') AS body FROM spaced),
done AS (SELECT page_id, url, trim(regexp_replace(body, '\s+', ' ', 'g')) AS text FROM decoded)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM done"""


@register("op12_html_main_text", _SQL)
def op12_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return rows.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
