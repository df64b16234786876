"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: runs of text between block-level tags, each with the tags, classes
and ids of its ancestors. Features of ancestors and of the text (length, links, punctuation) feed a
two-label chain, trained by maximum likelihood on generated pages whose labels are known and decoded
by Viterbi. Training is deterministic, takes a second or two on the driver, and its pages are a
parameter. Blocks labelled as main text are joined in page order.

Tags are read as the HTML rules have it, in one pass whose time grows with the page: no pattern is tried
again on text that it has seen, and a block holds no copy of its ancestors. Where a page breaks these
rules, text wins over markup: a quoted value that would swallow tags (its quote is not followed by white
space, a slash or the tag's end) ends at the next `>`; a comment, title, textarea, iframe or noscript
that nothing ends is skipped as a tag alone; so is a button, select, svg or template that neither its own
end tag nor, before any other block begins, the end of its parent closes. Only an unclosed script, style
or tag runs to the page's end.

Defined results: null, empty and text-free html give ''. Scripts, styles, templates, form controls and
comments never are text; `<svg .../>` is empty. Character references are decoded once, white space inside
a block becomes one space. Of two labellings that score alike, the one with less main text wins. Pages of
any length are read whole. Rows that repeat an id are extracted one by one, an empty table gives an empty
result, columns other than the named ones are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import html as _html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits

# Elements without text of the page. The inside of raw ones is no markup; that of held ones is, but is left out.
_RAW = frozenset("script style noscript textarea iframe title noembed noframes".split())
_HELD = frozenset("select svg button template".split())
#: Raw elements that run to the page's end if nothing ends them, and that are raw inside an svg, too.
_CODE = frozenset(("script", "style"))
# What follows a tag's name: no quote means anything but after an equals sign.
_ATTRIBUTES = r"(?:[^>=]++|=\s*+(?:\"[^\">]*+\"|'[^'>]*+'|\"[^\"]*+\"(?=[\s/>])|'[^']*+'(?=[\s/>]))?+)*+"
_TAG = re.compile(rf"<(/?)([a-zA-Z][^\s/>]*+)({_ATTRIBUTES})>")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in _RAW}
_COMMENT_END, _SVG_END = re.compile(r"--!?>"), re.compile(r"</svg(?=[\s/>])", re.I)
TEXT, START, END = range(3)
_WORDS = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACE = re.compile(r"\s+")
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that an opening tag of the same group closes.
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BLOCKS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Words of class and id names that tell what a container is for; a name is split at dashes, underscores and capitals.
_NAMES = {
    "ad": r"ads?|advert\w*|adsense|ad(?:box|unit|slot|banner|block|wrap\w*)|sponsor\w*|promo\w*|banners?|doubleclick",
    "menu": r"nav(?:bar|igation|menu|list|links)?|\w{0,8}(?:nav|menu)|menu\w*|breadcrumbs?|paginat\w+|pager|toolbar|tabs?",
    "side": r"side(?:bar\w*|nav|column|panel)?|aside|widgets?|rail|related\w*|recommend\w*|popular|trending|teasers?",
    "comment": r"comment(?:s|list|ary|author|form|body|text|area|section)?|discussions?|discuss|disqus|repl(?:y|ies)|responds?|responses?|reader(?:s|comments?)?",
    "notice": r"cookie\w*|consent|notices?|gdpr|alerts?|popup\w*|modal\w*|overlay|newsletter\w*|subscri\w+|signup|paywall",
    "foot": r"footer\w*|foot(?:notes|bar)?|sitefooter|copyright|legal|credits|colophon",
    "head": r"masthead|siteheader|headers?|topbar|logo",
    "share": r"shar(?:e|es|ing|ebar|er)|social\w*|follow",
    "form": r"\w{0,8}form|search\w*|login",
    "main": r"article\w*|content\w*|\w{0,8}content|posts?|postbody|entry|story\w*|main\w*|body|text|prose",
}
_NAMED = {k: re.compile(v) for k, v in _NAMES.items()}
#: A name that begins or ends so tells of a state or of what is elsewhere, not what the element is for.
_STATE = re.compile(r"(?:no|not|has|have|with|without|is|js|hide|show)[-_]|.+[-_](?:open|opened|closed|ready|loaded|enabled|disabled|active|visible|on|off)$")
_OF_ARTICLES = frozenset("article entry post story content".split())
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_TAGS = "article main section div p h1 h2 h3 li ul ol blockquote pre td table figure header footer nav aside form label fieldset dialog address dl".split()
_FEATURES = [f"in:{t}" for t in _TAGS] + [f"own:{t}" for t in _TAGS] + [f"name:{n}" for n in _NAMES] + [f"own-name:{n}" for n in _NAMES]
_FEATURES += [f"words<={n}" for n in (1, 3, 6, 12, 25, 50)] + ["words>50", "links<=0", "links<=.3", "links<=.8", "links>.8", "ends", "commas", "copyright", "in article or main", "bad tag", "bad name", "main name only", "bias"]
INDEX = {f: k for k, f in enumerate(_FEATURES)}
_KNOWN = frozenset(_TAGS)
_BAD_TAGS = frozenset("nav aside footer form label fieldset dialog".split())
_BAD_NAMES = frozenset(_NAMES) - {"main"}
_GOOD_NAMES = frozenset(("main",))
_FORM_TAGS = frozenset("form fieldset label dialog aside nav".split())
TRAINING_PAGES, STEPS = 500, 150


@dataclass(slots=True)
class Block:
    text: str
    own: str
    tags: frozenset[str]
    names: frozenset[str]
    own_names: frozenset[str]
    linked: int


class _Holders:
    """The elements that something is known of by tag or name, each under the nearest such element, with the text that they hold.

    An element that holds half of the page's text or more, and a heading of the page or an article, is the page's frame: its names
    and its form say nothing of what is in it. Nor do those of html and body.
    """

    def __init__(self) -> None:
        self.above, self.tag, self.names, self.size, self.frame = [-1], [""], [_NONE], [0], [False]

    def add(self, above: int, tag: str, names: frozenset[str]) -> int:
        self.above.append(above)
        self.tag.append(tag)
        self.names.append(names)
        self.size.append(0)
        self.frame.append(tag in ("h1", "main") or (tag == "article" and "comment" not in names))
        return len(self.above) - 1

    def known(self) -> list[tuple[frozenset[str], frozenset[str], frozenset[str]]]:
        """For each: tags from here upwards, names from here upwards, names of its own."""
        for k in range(len(self.above) - 1, 0, -1):
            self.size[self.above[k]] += self.size[k]
            self.frame[self.above[k]] |= self.frame[k]
        out, one = [(_NONE, _NONE, _NONE)], {}
        for k in range(1, len(self.above)):
            tags, names, _ = out[self.above[k]]
            tag, own = self.tag[k], self.names[k]
            if self.frame[k] and 2 * self.size[k] >= self.size[0]:
                own = own & _GOOD_NAMES
                tag = "" if tag in _FORM_TAGS else tag
            elif tag == "form" and 5 * self.size[k] >= 4 * self.size[0]:  # around the whole page
                own, tag = own - {"form"}, ""
            tags = tags if tag in tags or tag not in _KNOWN else tags | {tag}
            names = names if own <= names else names | own
            out.append((one.setdefault(tags, tags), one.setdefault(names, names), own))
        return out


_NAME_CACHE: dict[str, frozenset[str]] = {}
_NONE: frozenset[str] = frozenset()


def _named(attributes: str) -> frozenset[str]:
    if not attributes or "=" not in attributes:
        return _NONE
    found = _NAME_CACHE.get(attributes)
    if found is None:
        names = " ".join(a or b or c for a, b, c in _WORDS.findall(attributes)).split()
        words = [{w.lower() for w in _PARTS.findall(name)} for name in names if not _STATE.match(name.lower())]
        # An article's own header holds its title.
        own = set().union(*[w - {"header"} if w & _OF_ARTICLES else w for w in words])
        found = frozenset(n for n, r in _NAMED.items() if any(r.fullmatch(w) for w in own))
        if len(_NAME_CACHE) > 50_000:
            _NAME_CACHE.clear()
        _NAME_CACHE[attributes] = found
    return found


def tokens(page: str) -> list[tuple]:
    """(TEXT, begin, end), (START, name, attributes) and (END, name, '') in page order, without comments and raw elements."""
    out: list[tuple] = []
    at = begin = svgs = 0
    last_svg: int | None = None
    endless: set[str] = set()  # what has no end in the rest of the page
    while (lt := page.find("<", at)) >= 0:
        sign = page[lt + 1 : lt + 2]
        letter = page[lt + 2 : lt + 3] if sign == "/" else sign
        name = ""
        if letter.isascii() and letter.isalpha():
            m = None if "tag" in endless else _TAG.match(page, lt)
            if m:
                closing, name, attributes, end = m[1], m[2], m[3], m.end()
            else:
                end = page.find(">", lt) + 1
                if not end:
                    break
                endless.add("tag")
                m = _NAME.match(page, lt)
                closing, name, attributes = m[1], m[2], page[m.end() : end - 1]
            name = name.lower()
        elif page.startswith("<!--", lt):
            short = 5 if page.startswith(">", lt + 4) else 6 if page.startswith("->", lt + 4) else 0
            m = None if short or "--" in endless else _COMMENT_END.search(page, lt + 4)
            if not (m or short):
                endless.add("--")
            end = lt + short if short else m.end() if m else page.find(">", lt) + 1
        elif svgs and page.startswith("<![CDATA[", lt) and "]]" not in endless:
            end = page.find("]]>", lt) + 3
            if end < 3:
                endless.add("]]")
                continue
        elif sign and sign in "!?/":
            end = page.find(">", lt) + 1
        else:  # a sign in the text
            at = lt + 1
            continue
        if lt > begin:
            out.append((TEXT, begin, lt))
        at = begin = end or len(page)
        if not name:
            continue
        if closing:
            svgs -= name == "svg" and svgs > 0
            out.append((END, name, ""))
            continue
        if name in _RAW and name not in endless and not (svgs and (name not in _CODE or attributes.endswith("/"))):
            m = _RAW_END[name].search(page, at)
            if m:
                at = begin = page.find(">", m.end()) + 1 or len(page)
            elif name in _CODE:
                at = begin = len(page)
            else:
                endless.add(name)
            continue
        if name == "svg" and not attributes.endswith("/"):
            if last_svg is None:
                last_svg = max((x.start() for x in _SVG_END.finditer(page, at)), default=-1)
            svgs += at <= last_svg
        out.append((START, name, attributes))
    else:
        lt = len(page)
    if lt > begin:
        out.append((TEXT, begin, lt))
    return out


def _held(found: list[tuple]) -> dict[int, int]:
    """The last token of each held element that has an end, by its first."""
    ends: dict[int, int] = {}
    open_: dict[str, int] = {}
    stack: list[tuple[str, int, int]] = []
    begun = 0

    def close(name: str, at: int, by_end: bool) -> None:
        while True:
            own, first, seen = stack.pop()
            open_[own] -= 1
            itself = by_end and own == name
            if own in _HELD and (itself or seen == begun):
                ends[first] = at if itself else at - 1
            if own == name:
                return

    for i, (kind, name, attributes) in enumerate(found):
        if kind == END:
            if open_.get(name):
                close(name, i, True)
        elif kind == START and name not in _INLINE and name not in _VOID:
            if name == "svg" and attributes.endswith("/"):
                ends[i] = i
                continue
            if name == "button" and open_.get(name):
                close(name, i, False)
            if name not in _HELD:
                begun += 1
                if attributes.endswith("/"):
                    continue
            stack.append((name, i, begun))
            open_[name] = open_.get(name, 0) + 1
    return ends


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order."""
    out: list[tuple[str, str, int, bool, int]] = []  # text, tag, holder, whether that is the element itself, linked
    found = tokens(page)
    held = _held(found) if any(kind == START and name in _HELD for kind, name, _ in found) else {}
    holders = _Holders()
    stack: list[tuple[str, int, bool]] = []  # tag, holder, whether that is the element itself
    top = ("", 0, False)
    open_: dict[str, int] = {}
    parts: list[str] = []
    # the stack's height at which a link began
    linked, link_at, i = 0, -1, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", _html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                holders.size[top[1]] += len(text)
                out.append((text, *top, linked))
        linked = 0

    def pop() -> None:
        nonlocal top, link_at
        open_[stack.pop()[0]] -= 1
        top = stack[-1] if stack else ("", 0, False)
        if link_at > len(stack):  # what the link began in has ended
            link_at = -1

    while i < len(found):
        kind, name, attributes = found[i]
        i += 1
        if kind == TEXT:
            parts.append(page[name:attributes])
            if link_at >= 0:
                linked += attributes - name
        elif name in _HELD:
            if kind == START:
                i = held.get(i - 1, i - 1) + 1
        elif name in _INLINE:
            if name == "br":
                parts.append(" ")
            elif name == "a":
                link_at = len(stack) if kind == START else -1
        else:
            flush()
            if kind == END:
                if open_.get(name):
                    while top[0] != name:
                        pop()
                    pop()
            elif name not in _VOID:
                if top[0] == "p" and (name in _BLOCKS or name in _CLOSES):
                    pop()
                if top[0] in _CLOSES.get(name, _NONE):
                    pop()
                if not attributes.endswith("/"):
                    names = _NONE if name in ("html", "body") else _named(attributes)
                    known = bool(names) or name in _KNOWN
                    top = (name, holders.add(top[1], name, names) if known else top[1], known)
                    stack.append(top)
                    open_[name] = open_.get(name, 0) + 1
    flush()
    known = holders.known()
    return [Block(text, tag, known[k][0], known[k][1], known[k][2] if itself else _NONE, n) for text, tag, k, itself, n in out]


@functools.lru_cache(maxsize=50_000)
def _place_ids(own: str, tags: frozenset[str], names: frozenset[str], own_names: frozenset[str]) -> tuple[int, ...]:
    f = [*(f"in:{t}" for t in tags), f"own:{own}", *(f"name:{x}" for x in names), *(f"own-name:{x}" for x in own_names), "bias"]
    if "article" in tags or "main" in tags:
        f.append("in article or main")
    if tags & _BAD_TAGS:
        f.append("bad tag")
    if names & _BAD_NAMES:
        f.append("bad name")
    elif "main" in names:
        f.append("main name only")
    return tuple(sorted(INDEX[x] for x in f if x in INDEX))


def feature_ids(b: Block) -> list[int]:
    n, ratio = b.text.count(" ") + 1, b.linked / len(b.text)
    f = [next((f"words<={k}" for k in (1, 3, 6, 12, 25, 50) if n <= k), "words>50")]
    f.append("links<=0" if ratio <= 0 else "links<=.3" if ratio <= 0.3 else "links<=.8" if ratio <= 0.8 else "links>.8")
    if b.text[-1] in ".!?…»”\"'。":
        f.append("ends")
    if b.text.count(",") >= 2:
        f.append("commas")
    if "©" in b.text or (n <= 50 and "copyright" in b.text.lower()):
        f.append("copyright")
    return [*_place_ids(b.own, b.tags, b.names, b.own_names), *(INDEX[x] for x in f)]


# What pages say of themselves on their root, around all of a page, and on the article.
_BODIES = ("", "", "", ' class="has-sidebar"', ' class="single no-sidebar comments-open"', ' id="reader"', ' class="home navigation-ready"', ' class="form-page search-enabled"')
_FRAMES = (('<form id="aspnetForm" method="post" action="./"><div>', "</div></form>"), ('<div id="page" class="sidebar-right">', "</div>"), ('<div class="wrapper with-sidebar"><div class="inner">', "</div></div>"), ('<form id="f">', "</form>"))
_ARTICLES = ("", "", ' class="post has-comments"', ' class="post-12 type-post format-standard comments-closed"', ' id="readerContent"')

_HEADERS = ("", ' class="entry-header"', ' class="article-header"')


def training_page(rng: random.Random) -> tuple[str, list[str]]:
    """A made-up page and the blocks of its main text."""
    word = lambda: "".join(rng.choice(("ba", "ko", "ti", "ren", "sol", "mu", "da", "vi", "est", "or")) for _ in range(rng.randint(1, 4)))

    def words(a: int, b: int) -> str:
        return " ".join(word() for _ in range(rng.randint(a, b)))

    def prose() -> str:
        n = rng.choice((1, 1, 2, 3, 5))
        sign = rng.choice(("", "", "", "!!", "***", " |", "%%%"))
        ends = rng.choice((".", ".", ".", ".", "", "!", sign))
        return " ".join(words(2, rng.choice((4, 14, 30))).replace(" ", sign + " ", 3 if sign else 0).capitalize() + (ends or "") for _ in range(n))

    main: list[str] = []

    def keep(tag: str, text: str, close: bool = True) -> str:
        main.append(_SPACE.sub(" ", text).strip())
        bold = rng.random()
        body = f"<b>{text}" + ("<br>" if rng.random() < 0.5 else "</b>") if bold < 0.15 else text
        return f"<{tag}>{body}" + (f"</{tag}>" if close else "")

    def listing(tag: str, name: str) -> str:
        items = "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(rng.randint(2, 8)))
        return f"<{tag}{name}>{'<h3>' + words(1, 2) + '</h3>' if rng.random() < 0.3 else ''}<ul>{items}</ul></{tag}>"

    def named(*names: str) -> str:
        return f' {rng.choice(("class", "id"))}="{rng.choice(names)}"'

    def junk(inside: bool) -> str:
        kind = rng.randrange(8)
        text = rng.choice((words(1, 6), prose(), prose()))
        tag = rng.choice(("div", "div", "section", "p"))
        if kind == 0:
            return f'<{tag}{named("ad", "ads", "advert", "ad-box", "sponsored", "promo", "banner")}>{text}</{tag}>'
        if kind == 1:
            return listing(rng.choice(("aside", "div")), named("sidebar", "related", "widget", "side", "popular"))
        if kind == 2:
            body = "".join(f"<p>{prose()}</p>" if rng.random() < 0.6 else f'<div class="comment"><b>{word()}</b> {prose()}</div>' for _ in range(rng.randint(1, 4)))
            title = f"<h2>{words(1, 3)}</h2>" if rng.random() < 0.5 else ""
            return f'<div{named("comments", "comment-list", "discussion", "replies", "reader-comments")}>{title}{body}</div>'
        if kind == 3:
            return f'<div{named("cookie", "cookie-notice", "consent", "notice", "newsletter", "popup")}><p>{text}</p></div>'
        if kind == 4:
            return f'<form><label>{words(1, 3)}</label><input name="q"><p>{text}</p><button>{word()}</button></form>'
        if kind == 5:
            return f'<div{named("share", "social", "share-bar")}><a href="#">{word()}</a> <a href="#">{word()}</a></div>'
        if kind == 6:
            return f"<aside>{'<h3>' + words(1, 3) + '</h3>' if rng.random() < 0.4 else ''}<p>{text}</p></aside>"
        return f"<aside{named('sidebar', 'box', 'note')}><p>{text}</p></aside>"

    head = rng.randrange(4)
    page = [f"<!DOCTYPE html><html><head><title>{words(2, 5)}</title><style>p{{margin:0}}</style><script>var a='</p>';</script></head><body{rng.choice(_BODIES)}>"]
    framed = rng.randrange(12)
    page.append(_FRAMES[framed][0] if framed < len(_FRAMES) else "")
    if head == 1:
        page.append(f"<header><h1>{words(1, 3)}</h1><p>{words(2, 8)}</p></header>")
    elif head == 2:
        page.append(f'<div{named("header", "masthead", "topbar")}>{words(1, 5)}</div>')
    if rng.random() < 0.8:
        page.append(listing(*rng.choice((("nav", ""), ("div", named("menu", "navbar", "nav", "breadcrumbs")), ("nav", named("menu"))))))
    page += [junk(False) for _ in range(rng.choice((0, 0, 1, 1, 2)))]
    wrap = rng.randrange(6)
    state = rng.choice(_ARTICLES)
    opening, closing = [(f"<article{state}>", "</article>"), ("<main><article>", "</article></main>"), ("<main>", "</main>"), (f'<div{named("content", "post", "entry-content", "article-body", "story")}>', "</div>"), ("<div><div>", "</div></div>"), ("<article>", "</article>")][wrap]
    page.append(opening)
    if rng.random() < 0.85:
        title = keep(rng.choice(("h1", "h1", "h2")), words(1, 9).capitalize())
        page.append(f"<header{rng.choice(_HEADERS)}>{title}</header>" if wrap in (0, 1) and rng.random() < 0.25 else title)
    closes = rng.random() < 0.8
    for _ in range(rng.choice((1, 2, 3, 4, 6, 10))):
        roll = rng.random()
        if roll < 0.06:
            page.append(keep(rng.choice(("h2", "h3")), words(1, 6).capitalize()))
        elif roll < 0.1:
            page.append(f"<ul>{''.join(keep('li', prose() if rng.random() < 0.5 else words(1, 8)) for _ in range(rng.randint(2, 4)))}</ul>")
        elif roll < 0.13:
            page.append(f"<blockquote>{keep('p', prose())}</blockquote>")
        elif roll < 0.16:
            page.append(keep("pre", words(2, 12)))
        else:
            page.append(keep("p", prose() if rng.random() < 0.92 else words(1, 4), closes))
        if rng.random() < 0.08:
            page.append(junk(True))
    if rng.random() < 0.25:
        page.append(junk(True))
    page.append(closing)
    page += [junk(False) for _ in range(rng.choice((0, 0, 1, 1, 2)))]
    foot = rng.randrange(4)
    if foot < 2:
        page.append(f"<footer>{rng.choice((words(2, 6), '© 2020 ' + words(1, 4), '<p>' + prose() + '</p>', listing('div', '')))}</footer>")
    elif foot == 2:
        page.append(f'<div{named("footer", "foot", "copyright")}>{words(2, 8)}</div>')
    page.append(_FRAMES[framed][1] if framed < len(_FRAMES) else "")
    if rng.random() < 0.8:
        page.append("</body></html>")
    return "".join(page), main


class Field:
    """A linear chain of two labels: a weight of each feature for the label 'main', and of each transition."""

    def __init__(self) -> None:
        self.weights, self.moves = np.zeros(len(INDEX)), np.zeros((2, 2))

    def train(self, pages: int = TRAINING_PAGES, steps: int = STEPS, seed: int = 5, penalty: float = 0.002) -> Field:
        rng = random.Random(seed)
        data = []
        for _ in range(pages):
            page, main = training_page(rng)
            own, left = blocks(page), list(main)
            y = []
            for b in own:  # blocks of main text come in order
                hit = bool(left) and b.text == left[0]
                y.append(int(hit))
                if hit:
                    left.pop(0)
            if own and not left:
                data.append((own, y))
        longest = max(len(y) for _, y in data)
        x = np.zeros((len(data), longest, len(INDEX)), np.float32)
        label, mask = np.zeros((len(data), longest), int), np.zeros((len(data), longest))
        for i, (own, y) in enumerate(data):
            for t, b in enumerate(own):
                x[i, t, feature_ids(b)] = 1
            label[i, : len(y)], mask[i, : len(y)] = y, 1
        m1, m2 = np.zeros(len(INDEX) + 4), np.zeros(len(INDEX) + 4)
        for step in range(1, steps + 1):
            g_w, g_m = self._gradient(x, label, mask)
            g = np.r_[g_w, g_m.ravel()] / len(data) - penalty * np.r_[self.weights, self.moves.ravel()]
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
            move = 0.15 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
            self.weights = self.weights + move[:-4]
            self.moves = self.moves + move[-4:].reshape(2, 2)
        return self

    def _gradient(self, x: np.ndarray, label: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the log-likelihood: seen minus expected counts, by the forward and backward passes over all pages at once."""
        n, longest, _ = x.shape
        score = np.zeros((n, longest, 2))
        score[:, :, 1] = x @ self.weights.astype(np.float32)
        fore, hind = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        fore[:, 0] = score[:, 0]
        for t in range(1, longest):
            nxt = np.logaddexp(*[fore[:, t - 1, k, None] + self.moves[k] for k in (0, 1)]) + score[:, t]
            fore[:, t] = np.where(mask[:, t, None] > 0, nxt, fore[:, t - 1])
        for t in range(longest - 2, -1, -1):
            nxt = np.logaddexp(*[self.moves[:, k] + (score[:, t + 1, k] + hind[:, t + 1, k])[:, None] for k in (0, 1)])
            hind[:, t] = np.where(mask[:, t + 1, None] > 0, nxt, 0)
        total = np.logaddexp(fore[:, -1, 0], fore[:, -1, 1])
        p_main = np.exp(fore[:, :, 1] + hind[:, :, 1] - total[:, None]) * mask
        g_w = np.einsum("nt,ntf->f", label * mask - p_main, x)
        g_m = np.zeros((2, 2))
        for a in (0, 1):
            for b in (0, 1):
                both = mask[:, 1:]
                p = np.exp(np.clip(fore[:, :-1, a] + self.moves[a, b] + score[:, 1:, b] + hind[:, 1:, b] - total[:, None], -60, 0)) * both
                seen = (label[:, :-1] == a) & (label[:, 1:] == b)
                g_m[a, b] = (seen * both - p).sum()
        return g_w, g_m

    def decode(self, own: list[Block]) -> list[int]:
        """The likeliest labels."""
        w, moves = self.weights, self.moves.tolist()
        best, back = [0.0, 0.0], []
        for t, b in enumerate(own):
            s = float(w[feature_ids(b)].sum())
            if t == 0:
                best = [0.0, s]
                continue
            step, new = [], []
            for k in (0, 1):
                a0, a1 = best[0] + moves[0][k], best[1] + moves[1][k]
                step.append(int(a1 > a0))
                new.append(max(a0, a1) + (s if k else 0.0))
            back.append(step)
            best = new
        if not own:
            return []
        labels = [int(best[1] > best[0])]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]

    def extract(self, page: str) -> str:
        own = blocks(page)
        return "\n".join(b.text for b, y in zip(own, self.decode(own), strict=True) if y)


def _extract(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for b in batches:
            texts = [field.extract(h) if h else "" for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return run


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", training_pages: int = TRAINING_PAGES) -> DataFrame:
    """Per row of pages: page_id, url, text, n_chars."""
    spark = pages.sparkSession
    arrow_limits(spark)
    shared = spark.sparkContext.broadcast(Field().train(training_pages))  # a few hundred weights
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return own.mapInArrow(_extract(shared), "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
