"""Main-text extraction: flat text blocks, word count and link density of neighbours, and a small decision tree.

A page is cut into flat blocks at block-level tags; inline elements never cut. Each block is described by its own and its neighbours' word count
and link density, its tag, where it stands (within the article, beside it, or on a page that doesn't say), and how strongly the elements around
it say that they are something else: by what they are (nav, aside, footer, form, hidden) or by a token of their class, id or role.
An element that holds the article, or on a page without one the title or most of the words, is a wrapper, and its marks say nothing.
Names that a text may as well be about (legal, search, discussion) are a weaker mark than names of what surrounds texts, and are none on an element that holds most of the article's words.
A tree decides, grown here on PAGES, blocks labelled by hand on pages most of which have no telling names. It asks for words and links, its own and the neighbours', before it asks for marks and places, so the
same mark says one thing of a few linked words and another of prose.
What stands under a heading that opens reader comments, or one that often opens lists of other pages, is described so, up to the next heading of that rank; of the second kind, prose stays.
Each page is one row and one unit of work, so no key can gather pages in a task.

Cases: a null or empty page has the empty text. Repeated pages each get a row. Broken markup (unclosed or stray tags)
never fails: a closing tag without an opening one is ignored, an open one ends with the page. A very long page costs
time in proportion to its length. Hidden text is no part of the article. Blocks on which the tree is even stay. An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import column, table

# Element names and words of class, id and role attributes.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg object canvas audio video head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTROLS = frozenset("button select option label fieldset legend datalist output dialog menu".split())
ASIDES = frozenset("nav aside footer menu dialog header form".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A whole token of class, id or role that names something beside the article.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense alert alertdialog banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies disqus footer gdpr header infobar masthead menu menubar modal nav navbar navigation newsletter notice notices notification outbrain pager pagination paywall popup promo promotion related respond share sharing sidebar sidenav skip sponsor sponsored taboola ticker toc toolbar topbar widget widgets".split()
)
#: A whole token that names such a thing, or what the text is about.
TOPICS = frozenset("copyright disclaimer discussion legal login privacy recommended replies responses search signup social subscribe subscription tags".split())
#: Words that say so even as the first or last part of a token.
STEMS = frozenset("advert adverts advertisement breadcrumb breadcrumbs comment comments disqus footer masthead navbar navigation newsletter pagination popup respond sidebar sponsor sponsored toolbar topbar widget".split())
#: Parts of tokens that speak of the layout: `has-sidebar` is no sidebar.
LAYOUT = frozenset("has with without no not is container content grid inner layout outer page row site wrap wrapper".split())
TOWARDS = frozenset("article articlebody article-body article-content blog-post content entry entry-content main main-content maincontent post post-body post-content prose story story-body".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)(?:>|\Z)""", re.S)
_NAMED = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
_COMMENT_HEADINGS = re.compile(r"(?:\d+ )?(?:(?:reader |user )?comments?|\d+ (?:responses?|replies)|leave a (?:reply|comment)|join the (?:discussion|conversation)|kommentare?|commentaires?|comentarios?)(?: \(?\d+\)?)?\W*", re.I)
_LIST_HEADINGS = re.compile(
    r"(?:related(?: (?:articles?|posts?|stories|pages|links))?|read (?:more|next)|you may also like|more from (?:us|this author|the author|our (?:blog|site)|around the web)|share(?: this)?|recommended(?: (?:articles?|posts?|stories|pages|links|reading|for you))?|most (?:read|popular)|subscribe|newsletter|advertisement|sponsored|tags)\W*",
    re.I,
)

# block tag classes
P, HEADING, ITEM, CELL, OTHER = range(5)
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "tag", "mark", "place", "control", "sentence", "heading")
#: The first two questions of the tree are about these.
ASKED_FIRST = range(6)
#: How strongly an element says that it is something else.
PART, TOPIC, NAME, HIDDEN = 1, 2, 3, 4
#: What a heading opens.
LISTS, COMMENTS = 1, 2


class Mark:
    """An element that says that it is beside the article."""

    __slots__ = ("strength", "name", "around", "inside", "wraps", "words")

    def __init__(self, strength: int, name: str, around: int, inside: bool):
        self.strength, self.name, self.around, self.inside, self.wraps, self.words = strength, name, around, inside, False, 0.0


class Block:
    __slots__ = ("text", "tag", "level", "words", "links", "marked", "mark", "place", "control", "under")

    def __init__(self, text, tag, level, words, links, marked, place, control):
        self.text, self.tag, self.level, self.words, self.links, self.marked = text, tag, level, words, links, marked
        self.mark, self.place, self.control, self.under = 0, place, control, 0


def _token(token: str) -> int:
    parts = [w.lower() for w in _PART.findall(token)]
    if not parts or "-".join(parts) in NAMES or "".join(parts) in NAMES:
        return NAME if parts else 0
    if "-".join(parts) in TOPICS:
        return TOPIC
    if LAYOUT.intersection(parts):
        return 0
    if parts[0] in STEMS or parts[-1] in STEMS:
        return NAME
    return PART if NAMES.union(TOPICS).intersection((parts[0], parts[-1])) else 0


def _read(attributes: str) -> tuple[int, bool]:
    """(strength of the mark, whether it names an article's text) of an element's attributes."""
    strength, towards = 0, False
    for m in _NAMED.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _UNSEEN.search(value)):
            strength = HIDDEN
        elif name in ("class", "id", "role"):
            for token in value.split():
                strength = max(strength, _token(token))
                towards = towards or token.lower().replace("_", "-") in TOWARDS
    return strength, towards


def blocks(page: str | None) -> list[Block]:
    """Flat text blocks in page order."""
    out: list[Block] = []
    if not page:
        return out
    # name, innermost mark, within an article (2), a main (1) or a text by its name (-1), control
    stack: list[tuple[str, int, int, int]] = [("", -1, 0, 0)]
    opened: Counter = Counter()  # of elements on the stack, by name
    endless: set[str] = set()  # raw elements of which no closing tag is ahead
    every: list[Mark] = []
    title: int | None = None
    mains = articles = anchors = at = 0
    size = len(page)
    parts: list[str] = []
    linked: list[str] = []
    skipped, depth = "", 0  # a hidden inline element that is being passed over

    def flush():
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                name, marked, place, control = stack[-1]
                n = len(text.split())
                inner = len(_SPACE.sub(" ", html.unescape(" ".join(linked))).split())
                tag = P if name in ("p", "blockquote", "pre") else HEADING if name in HEADINGS else ITEM if name in ("li", "dd", "dt") else CELL if name in ("td", "th", "tr", "table", "caption") else OTHER
                out.append(Block(text, tag, int(name[1]) if tag == HEADING else 0, n, min(1.0, inner / n), marked, place, control))
            parts.clear()
            linked.clear()

    while at < size:
        m = _TAG.search(page, at)
        piece = page[at : m.start() if m else size]
        if piece and not depth:
            parts.append(piece)
            if anchors:
                linked.append(piece)
        if not m:
            break
        at = m.end()
        name = m[2]
        if name is None:
            if m[0].startswith("<![CDATA[") and not depth:
                parts.append(html.escape(m[0][9:-3], False))
            continue
        name = name.lower()
        if m[1]:  # closing
            if name == skipped and depth:
                depth -= 1
            elif name == "a":
                anchors = max(0, anchors - 1)
            elif opened[name]:
                flush()
                while _leave(stack, opened) != name:
                    pass
                anchors = depth = 0
            continue
        if name in RAW:
            if not m[3].rstrip().endswith("/"):
                end = None
                if name not in endless:
                    end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                    if end is None and name == "head":
                        end = re.compile(r"(?=<body\b)", re.I).search(page, at)
                if end is not None:
                    at = end.end()
                else:
                    endless.add(name)
                    if name in ("script", "style", "textarea"):
                        at = size
            if name in ("svg", "noscript", "script", "style", "template"):
                parts.append(" " if name == "svg" else "")
            else:
                flush()
            continue
        if depth:
            depth += name == skipped and not m[3].rstrip().endswith("/")
        elif name in ("br", "img", "input"):
            parts.append(" ")
        elif name == "a":
            anchors += 1
        elif name in BLOCKS or name in CONTROLS:
            flush()
            if name in VOID:
                continue
            _open(stack, opened, name)
            _, marked, place, control = stack[-1]
            strength, towards = _read(m[3]) if m[3] else (0, False)
            if name in ("article", "main"):
                # what holds the first of them is a wrapper
                if not (articles if name == "article" else mains):
                    for k in _chain(every, marked):
                        every[k].wraps = every[k].name not in ("nav", "aside", "footer")
                if place < 2:
                    articles, mains, place = articles + (name == "article"), mains + (name == "main"), 2 if name == "article" else 1
            elif towards and not place:
                place = -1
            if name == "h1" and title is None:
                title = marked
            if name in ASIDES and strength < HIDDEN and not (name == "header" and place > 0):  # an article's own header holds its title
                strength = NAME
            if name in ("body", "html") and strength < HIDDEN:
                strength = 0
            if strength:
                every.append(Mark(strength, name, marked, place > 0))
                marked = len(every) - 1
            stack.append((name, marked, place, max(control, int(name in CONTROLS))))
            opened[name] += 1
        elif m[3] and name not in VOID and not m[3].rstrip().endswith("/") and _read(m[3])[0] == HIDDEN:
            skipped, depth = name, 1
    flush()
    _settle(out, every, -1 if title is None else title, mains, articles)
    return out


def _leave(stack: list, opened: Counter) -> str:
    name = stack.pop()[0]
    opened[name] -= 1
    return name


def _chain(every: list[Mark], k: int) -> Iterator[int]:
    """A mark and those around it."""
    while k >= 0:
        yield k
        k = every[k].around


def _settle(found: list[Block], every: list[Mark], title: int, mains: int, articles: int) -> None:
    """Takes the marks off wrappers, and tells each block's mark and place."""
    total = within = 0.0
    for b in found:
        plain = b.words * (1 - b.links)
        total += plain
        within += plain * (b.place > 0)
        if b.marked >= 0:
            every[b.marked].words += plain
    for m in reversed(every):  # what is around a mark stands before it
        if m.around >= 0:
            every[m.around].words += m.words
    titled = set(_chain(every, title))
    for k, m in enumerate(every):
        if mains or articles:
            m.wraps = m.wraps or (m.strength <= TOPIC and m.inside and m.words > 0.5 * within)
        elif m.name not in ("nav", "aside", "footer") and (k in titled or m.words > 0.6 * total):
            m.wraps = True
    strongest: list[int] = []
    for m in every:
        own = m.strength if m.strength == HIDDEN or not m.wraps else 0
        strongest.append(max(own, strongest[m.around] if m.around >= 0 else 0))
    for b in found:
        b.mark = strongest[b.marked] if b.marked >= 0 else 0
        if articles or mains:
            b.place = -1 if b.place < 1 else 2 if b.place == 2 or not articles else 1
        else:
            b.place = 1 if b.place == -1 else 0
    _settle_headings(found)


def _settle_headings(found: list[Block]) -> None:
    level = kind = 0
    for b in found:
        if b.tag == HEADING:
            opens = COMMENTS if _COMMENT_HEADINGS.fullmatch(b.text) else LISTS if _LIST_HEADINGS.fullmatch(b.text) else 0
            if opens and (opens >= kind or b.level <= level):
                level, kind = b.level if not kind else min(level, b.level), opens
            elif kind and b.level <= level:
                level = kind = 0
        b.under = kind


# Elements that an opening tag ends when they are still open.
_CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
_KEEPS_P = frozenset("p address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul center dialog dir hgroup".split())


def _open(stack: list, opened: Counter, name: str) -> None:
    """Ends the elements that the opening of `name` ends."""
    if name in _KEEPS_P and (stack[-1][0] == "p" or stack[-1][0] in HEADINGS and name in HEADINGS):
        _leave(stack, opened)
    for k in range(len(stack) - 1, max(0, len(stack) - 4), -1):
        if stack[k][0] in _CLOSES.get(name, ()):
            while len(stack) > k:
                _leave(stack, opened)
            break
        if stack[k][0] in ("ul", "ol", "dl", "table", "select"):
            break


def features(found: list[Block]) -> np.ndarray:
    n = len(found)
    out = np.zeros((n, len(FEATURES)))
    for i, b in enumerate(found):
        before, after = found[i - 1] if i else None, found[i + 1] if i + 1 < n else None
        out[i] = (
            b.words, b.links, before.words if before else 0, before.links if before else 0, after.words if after else 0, after.links if after else 0,
            b.tag, b.mark, b.place, b.control, b.text[-1:] in ".!?…\"”»:;" or b.words >= 12, b.under,
        )
    return out


# ---- the labelled table -------------------------------------------------------------------------------------------------

#: Pages whose blocks are labelled by hand: a block begins with + if it belongs to the article and with - if not. {n} stands for about n words.
PAGES = (
    # no names at all: a news page
    "<body><div><a href=1>-{1}</a> <a href=2>{2}</a> <a href=3>{1}</a> <a href=4>{1}</a></div><div>-{2}</div><h1>+{9}</h1><p>+{4}</p><p>+{48}.</p><p>+{35}.</p><h2>+{4}</h2><p>+{60}.</p><p>+{12}.</p><p>+{41} <a href=5>{3}</a> {20}.</p>"
    "<ul><li><a href=6>-{7}</a></li><li><a href=7>-{6}</a></li><li><a href=8>-{8}</a></li></ul><div>-{3} <a href=9>{1}</a> <a href=10>{2}</a></div><div>-{4}</div></body>",
    # no names: a blog page in plain divs
    "<div><div><div><a href=1>-{3}</a></div></div><div><div><a href=1>-{1}</a></div><div><a href=2>-{1}</a></div><div><a href=3>-{2}</a></div></div></div><div><div><h1>+{6}</h1><div>+{70}.</div><div>+{55}.</div><div>+{18}.</div><div>+{40}.</div></div></div>"
    "<div><div><a href=4>-{5}</a></div><div><a href=5>-{6}</a></div><div>-{6}</div></div>",
    # tables for layout
    "<table><tr><td><a href=1>-{2}</a><br><a href=2>{2}</a><br><a href=3>{1}</a></td><td><h2>+{5}</h2><p>+{80}.</p><p>+{64}.</p><blockquote>+{30}.</blockquote><p>+{50}.</p></td></tr><tr><td>-{1}</td><td>-{5} <a href=4>{2}</a></td></tr></table>",
    # a recipe: lists and short lines within main
    "<div><a href=1>-{1}</a><a href=2>{1}</a></div><main><h1>+{4}</h1><p>+{30}.</p><h2>+{1}</h2><ul><li>+{4}</li><li>+{3}</li><li>+{5}</li></ul><h2>+{1}</h2><ol><li>+{16}.</li><li>+{11}.</li><li>+{21}.</li></ol><p>+{2}</p><table><tr><th>+{1}</th><td>+{2}</td></tr><tr><th>+{1}</th><td>+{2}</td></tr></table></main><div>-{30}.</div><div>-{3}</div>",
    # an article, and prose beside it
    "<div>-{14}.</div><article><h1>+{7}</h1><p>+{5}</p><p>+{50}.</p><p><a href=1>+{4}</a></p><p>+{3}.</p><figure><figcaption>+{9}.</figcaption></figure><pre>+{20}</pre><p>+{33}.</p><ul><li><a href=2>+{5}</a></li><li><a href=3>+{4}</a></li></ul><p>+{1}</p></article><div>-{40}.</div><section><h3>-{2}</h3><p>-{35}.</p></section>",
    # an article with its own header, and elements that say what they are
    "<header><p>-{3}</p><nav><ul><li><a href=1>-{1}</a></li><li><a href=2>-{2}</a></li></ul></nav></header><aside><h2>-{2}</h2><p>-{45}.</p></aside><article><header><h1>+{8}</h1><p>+{4}</p></header><p>+{42}.</p><p>+{58}.</p><aside><p>-{26}.</p></aside><p>+{23}.</p><footer>-{7}</footer></article>"
    "<form><label>-{2}</label><p>-{10}.</p><button>-{1}</button></form><footer><p>-{25}.</p><p>-{4}</p></footer>",
    # reader comments by their heading, within the article and after it
    "<article><h1>+{6}</h1><p>+{44}.</p><h2>+{3}</h2><p>+{38}.</p><p>+{9}.</p><h2>-Comments</h2><div><p>-{30}.</p><p>-{4}</p></div><div><h4>-{2}</h4><p>-{62}.</p></div><p>-{12}.</p></article>",
    "<div><h1>+{6}</h1><p>+{44}.</p><p>+{38}.</p><h3>-3 comments</h3><p>-{2}</p><p>-{40}.</p><p>-{2}</p><p>-{18}.</p></div><h3>-Related articles</h3><ul><li><a href=1>-{8}</a></li><li><a href=2>-{6}</a></li></ul>",
    # names that tell
    "<div class=menu><a href=1>-{1}</a> | <a href=2>{2}</a></div><div class=sidebar><h3>-{2}</h3><p>-{50}.</p></div><div class=post-content><h1>+{5}</h1><p>+{61}.</p><div class=ad>-{12}.</div><p>+{37}.</p><p>+{6}.</p></div><div id=comments><p>-{33}.</p><p>-{2}</p><p>-{80}.</p></div><div class=cookie-notice><p>-{15}.</p><button>-{1}</button></div><div id=footer><p>-{20}.</p></div>",
    "<div class=banner><p>-{20}.</p></div><article><h1>+{5}</h1><p>+{50}.</p><div class=newsletter><p>-{25}.</p></div><p>+{40}.</p><section class=comments><h2>-{2}</h2><p>-{45}.</p><p>-{20}.</p></section><div class=share><a href=1>-{1}</a> <a href=2>{1}</a></div><div class='comment-list'><p>-{55}.</p></div></article><div role=alert>-{9}.</div>",
    "<div class=notice><p>-{40}.</p></div><div><h1>+{5}</h1><p>+{50}.</p><p>+{47}.</p><div class=promo><p>-{36}.</p></div><p>+{29}.</p><div class=related><p>-{14}</p><p>-{16}.</p></div></div><div class=disclaimer>-{60}.</div>",
    # names that only seem to tell: the text is about these things
    "<div class=layout><div class=cookie-recipe><h1>+{5}</h1><p>+{55}.</p><p>+{48}.</p></div><div class=share-prices><p>+{45}.</p><p>+{60}.</p></div></div><div class=social-links><a href=1>-{1}</a> <a href=2>{1}</a></div>",
    "<article><h1>+{7}</h1><section class=privacy-law><p>+{52}.</p><p>+{31}.</p></section><section class=menu-design><h2>+{3}</h2><p>+{44}.</p></section><p>+{38}.</p><div class=share-buttons>-{1} <a href=1>{1}</a></div><div class=ad-slot>-{2}</div><div class=tags-list><a href=1>-{1}</a> <a href=2>{1}</a></div></article>",
    "<div><div class=search-theory><p>+{40}.</p><p>+{62}.</p><p>+{25}.</p></div><div class=login-box><p>-{3}</p><a href=1>-{2}</a></div><div class=promo-strip>-{5} <a href=2>{2}</a></div></div>",
    # hidden text
    "<div hidden><p>-{30}.</p></div><article><h1>+{5}</h1><p>+{45}.</p><div style='display:none'><p>-{25}.</p></div><p>+{33}.</p><p aria-hidden=true>-{20}.</p></article>",
    # a short note, and a page of one paragraph
    "<nav><a href=1>-{1}</a></nav><main><p>+{7}.</p></main><footer>-{3}</footer>",
    "<p>+{30}.</p>",
    "<div>+{25}.</div><div>+{28}.</div>",
    "<h1>+{4}</h1><p>+{9}.</p><p>+{14}.</p>",
    "<div><a href=1>-{2}</a></div><h1>+{3}</h1><p>+{15}.</p><div><a href=2>-{3}</a> <a href=3>{2}</a></div>",
    # no names: paragraphs with many links, right behind a menu too
    "<div><a href=1>-{1}</a> <a href=2>{1}</a> <a href=3>{2}</a></div><p>+{45}.</p><p>+{20} <a href=4>{8}</a> {12} <a href=5>{6}</a> {9}.</p><p>+{15} <a href=6>{9}</a> {14} <a href=7>{5}</a>.</p><p>+{38}.</p><p>+{8} <a href=8>{5}</a> {4}.</p>",
    "<ul><li><a href=1>-{1}</a></li><li><a href=2>-{2}</a></li></ul><div><p>+{33} <a href=3>{10}</a>.</p><p>+{26}.</p><p>+{10} <a href=4>{7}</a> {8}.</p></div><div><a href=5>-{2}</a></div><div>-{2} <a href=6>{3}</a></div>",
    "<h1>+{3}</h1><p>+{25} <a href=1>{12}</a> {9}.</p><p><a href=2>+{2}</a> {30}.</p><h2>+{2}</h2><p>+{40} <a href=3>{6}</a>.</p><ul><li>+{4} <a href=4>{1}</a> {5}</li><li>+{6} <a href=5>{2}</a> {3}</li></ul><p>+{50}.</p><div><a href=6>-{1}</a> <a href=7>{2}</a></div>",
    "<div><a href=1>-{2}</a><a href=2>{1}</a></div><h2>+{4}</h2><p>+{30}.</p><p>+{18} <a href=3>{11}</a> {13}.</p><h2>+{3}</h2><p>+{22} <a href=4>{7}</a>.</p><p>+{64}.</p>",
    "<div><a href=1>-{1}</a> <a href=2>{2}</a></div><p>+{55}.</p><div>-{2}</div>",
    "<ul><li><a href=1>-{2}</a></li><li><a href=2>-{1}</a></li></ul><div>+{40}.</div><p>-{3} <a href=3>{2}</a></p>",
    # no names: teasers of other pages behind the text
    "<h1>+{6}</h1><p>+{52}.</p><p>+{47}.</p><div><h3><a href=1>-{6}</a></h3><p>-{14}.</p><h3><a href=2>-{7}</a></h3><p>-{15}.</p><h3><a href=3>-{5}</a></h3><p>-{12}.</p></div><div><a href=4>-{2}</a></div>",
    # names that a text may be about, on parts of an article and on what is beside it
    "<article><h1>+{6}</h1><p>+{40}.</p><section class=legal><h2>+{2}</h2><p>+{50}.</p><p>+{34}.</p></section><p>+{45}.</p><div class=social><a href=1>-{1}</a> <a href=2>{1}</a></div></article><div class=legal>-{12}.</div>",
    "<main><h1>+{5}</h1><p>+{48}.</p><div class=discussion><h2>+{1}</h2><p>+{60}.</p><p>+{41}.</p></div><p>+{35}.</p><div class=login><p>-{3}</p><a href=1>-{1}</a></div><div class=subscribe><p>-{7}</p></div></main><div class=privacy><p>-{20}.</p></div>",
    "<article><div class=search><h1>+{4}</h1><p>+{30}.</p></div><p>+{55}.</p><div class=privacy><p>+{44}.</p><p>+{8}.</p><p>+{39}.</p></div><div class=tags><a href=1>-{1}</a> <a href=2>{1}</a></div><div class=copyright>-{4}</div></article>",
    "<div class=search><a href=1>-{2}</a></div><h1>+{5}</h1><p>+{50}.</p><p>+{38}.</p><p>+{44}.</p><div class=disclaimer>-{30}.</div><div class=recommended><p>-{8}</p><p>-{9}</p></div><div class=replies><p>-{40}.</p><p>-{25}.</p></div>",
    # headings that often open lists: prose under them stays, links and teasers go
    "<article><h1>+{6}</h1><p>+{40}.</p><h2>+Newsletter</h2><p>+{48}.</p><p>+{36}.</p><h2>+Tags</h2><p>+{52}.</p><h2>+{2}</h2><p>+{40}.</p></article>",
    "<article><h2>+Tags</h2><p>+{45}.</p><p>+{33}.</p></article>",
    "<article><h2>+Newsletter</h2><p>+{29}.</p></article>",
    "<article><h1>+{1}</h1><p>+{30}.</p><h2>+Read next</h2><p>+{28}.</p></article>",
    "<article><h1>+{4}</h1><p>+{55}.</p><h2>+Share</h2><p>+{31}.</p></article>",
    "<article><h1>+{5}</h1><p>+{60}.</p><p>+{44}.</p><h2>-Tags</h2><ul><li><a href=1>-{1}</a></li><li><a href=2>-{2}</a></li></ul><h2>-Newsletter</h2><p>-{6}</p><h3>-Read more</h3><p><a href=3>-{7}</a></p><p><a href=4>-{6}</a></p></article>",
    "<div><h1>+{5}</h1><p>+{50}.</p><p>+{61}.</p><h2>-Recommended</h2><p><a href=1>-{6}</a></p><p>-{9}</p><h2>-Share</h2><p>-{2}</p></div>",
    # bare text and plain divisions within an article, short ones too
    "<article><h1>+{3}</h1><div>+{2}</div><p>+{40}.</p><div>+{3}</div></article>",
    "<article>+{4}<p>+{50}.</p>+{3}<p>+{33}.</p>+{2}</article>",
    "<article><h1>+{2}</h1><p>+{28}.</p><div>+{3}</div></article>",
    "<main><h1>+{3}</h1><div>+{34}.</div><div>+{2}</div></main><div>-{3}</div>",
    # controls in the text
    "<form><h1>+{3}</h1><p>+{40}.</p><p>+{33}.</p><div><label>-{1}</label><button>-{1}</button></div></form>",
    "<h1>+{2}</h1><p>+{36}.</p><button>-{1}</button><p>+{45}.</p><select><option>-{1}</option><option>-{2}</option></select><p>+{2}.</p><label>-{3}</label><button>-{1}</button>",
    "<article><h1>+{2}</h1><p>+{36}.</p><button>-{1}</button><p>+{45}.</p><label>-{2}</label><p>+{30}.</p><button>-{2}</button></article>",
    # short paragraphs without names around them
    "<p>+{1}.</p>",
    "<p>+{2}</p>",
    "<h1>+{1}</h1><p>+{1}.</p>",
    "<h1>+{2}</h1><p>+{3}.</p><p>+{2}</p>",
    "<h1>+{1}</h1><p>+{40}.</p><p>+{1}.</p><p>+{30}.</p><p>+{2}.</p>",
    "<h1>+{1}</h1><p>+{35}.</p><h2>+{1}</h2><p>+{2}.</p><p>+{1}.</p><p>+{50}.</p>",
    "<div><p>+{2}</p><p>+{45}.</p><p>+{1}.</p></div>",
    "<div><p>+{3}</p><p>+{28}.</p><p>+{2}</p><p>+{61}.</p><p>+{3}</p></div>",
    "<ul><li><a href=1>-{1}</a></li><li><a href=2>-{1}</a></li></ul><h1>+{3}</h1><p>+{1}.</p><p>+{44}.</p><p>+{2}</p><div><a href=3>-{2}</a></div>",
    # main with a list of other pages beside the article
    "<main><article><h1>+{8}</h1><p>+{47}.</p><p>+{52}.</p></article><div><h2>-{2}</h2><a href=1>-{9}</a><div><a href=2>-{8}</a></div></div><div><p>-{22}.</p></div></main><div>-{5}</div>",
)
REPEATS = 10


def labelled_table(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of all blocks of PAGES, each page REPEATS times with other lengths."""
    rng = np.random.default_rng(seed)
    xs, ys = [], []

    def words(m):
        n = int(m[1])
        return " ".join(["word"] * (n if n < 4 else int(rng.integers(int(n * 0.6) + 1, int(n * 1.6) + 1))))

    for page in PAGES * REPEATS:
        found = blocks(re.sub(r"\{(\d+)\}", words, page))
        for b in found:
            ys.append("-+".index(b.text[0]))
            if b.tag == HEADING and (_COMMENT_HEADINGS.fullmatch(b.text[1:]) or _LIST_HEADINGS.fullmatch(b.text[1:])):
                b.text = b.text[1:]
        _settle_headings(found)
        xs.append(features(found))
    return np.concatenate(xs), np.array(ys, float)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 9, least: int = REPEATS + 2, first: int = 2):
    """A binary tree by Gini impurity: (feature, threshold, below, above) or the share of label 1. The first `first` questions are about ASKED_FIRST."""
    asked = ASKED_FIRST if first > 0 else None
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return float(y.mean())
    best = (0.0, None, None)
    base = y.mean() * (1 - y.mean()) * len(y)
    for f in asked or range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, c = x[order, f], np.cumsum(y[order])
        cut = np.flatnonzero(v[1:] > v[:-1]) + 1
        cut = cut[(cut >= least) & (cut <= len(y) - least)]
        if not len(cut):
            continue
        a, b = c[cut - 1], c[-1] - c[cut - 1]
        gain = base - (a * (1 - a / cut) + b * (1 - b / (len(y) - cut)))
        k = int(np.argmax(gain))
        if gain[k] > best[0] + 1e-9:
            best = (float(gain[k]), f, float((v[cut[k] - 1] + v[cut[k]]) / 2))
    if best[1] is None:
        return float(y.mean())
    _, f, t = best
    low = x[:, f] <= t
    return f, t, grow(x[low], y[low], depth - 1, least, first - 1), grow(x[~low], y[~low], depth - 1, least, first - 1)


@cache
def tree():
    return grow(*labelled_table())


def share(node, row) -> float:
    while not isinstance(node, float):
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return node


def main_text(page: str | None) -> str:
    found = blocks(page)
    if not found:
        return ""
    model = tree()
    return "\n".join(b.text for b, row in zip(found, features(found).tolist(), strict=True) if share(model, row) >= 0.5)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    source = pages.select(column(page).cast("string").alias("__html"), column(page_id).alias("page_id"), column(url).alias("url"))

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[1:]]
    return source.mapInArrow(run, ", ".join([*kinds, "text string", "n_chars long"]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
