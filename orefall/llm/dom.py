"""A small forgiving HTML reader: text blocks of a page in order, each with the element it stands in.

Every step is linear in the page, whatever its markup: elements point to their parents and to what they inherit, end tags look
only as far as they close, and a quote or a raw element that never ends is looked for once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

import xxhash

NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-a-zA-Z0-9_:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
#: Elements whose content is no text of the page. The first are raw up to the page's end if they never end; a tag of the others
#: that never ends stands for nothing.
RAW, HIDDEN = frozenset("script style textarea iframe".split()), frozenset("noscript template svg canvas select".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark math object q rp rt ruby s samp small span strike strong sub sup time tt u var wbr mi mn mo ms mtext mrow msup msub mfrac".split())
#: A new element of the key ends the innermost open list or table part while that is one of these.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
PARTS = frozenset("li dt dd tr td th ul ol menu dl table".split())
SPACE = re.compile(r"\s+")
#: Elements and roles that are never part of an article (fixed word lists).
DROP_TAGS = frozenset("head nav footer aside form button menu dialog fieldset option".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Classes and ids that name such an element: made of words of the first list, and any of the second besides (fixed word lists).
DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adbox adslot banner promo promotion promotions sponsor sponsored nav navbar "
    "navigation menu breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice notices notification notifications popup modal "
    "overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comments comment commentlist "
    "disqus respond replies reply widget widgets pagination pager toolbar skip copyright".split()
)
PLAIN_WORDS = frozenset(
    "area bar body block box bottom buttons button card col column container content cta footer form global group header holder icons inner items item js "
    "left link links list main message outer page panel post posts primary right row secondary section site slot sticky strip text to top unit wrap "
    "wrapper".split()
)
CLASS_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def names_noise(token: str) -> bool:
    """Whether a class or id as a whole names an element of no article: `cookie-banner` does, `share-price` doesn't."""
    words = [w.lower() for w in CLASS_WORD.findall(token)]
    return any(w in DROP_WORDS for w in words) and all(w in DROP_WORDS or w in PLAIN_WORDS for w in words)


@dataclass(slots=True)
class Element:
    tag: str
    sign: str  # tag, classes and id without numbers: the element's style
    node: int  # of the chain of styles from the page's root to it
    parent: Element | None
    dropped: bool
    form: bool  # dropped for nothing but the form that it stands in
    main: bool  # inside a main part
    article: bool  # inside an article
    home: Element | None = None  # the element that text in it belongs to
    part: Element | None = None  # the innermost list or table part
    depth: int = 0
    inlines: dict[str, int] = field(default_factory=dict)  # open inline elements by tag, kept at their home


@dataclass(slots=True)
class Block:
    text: str
    place: Element | None


def node_of(parent: int, sign: str) -> int:
    """The integer of the chain that goes on from a parent's with one more style; 0 is the root's."""
    return xxhash.xxh64_intdigest(sign.encode("utf-8", "surrogatepass"), seed=parent & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


def _element(tag: str, raw: str, outer: Element | None) -> Element:
    at = {m[1].lower(): (m[2] or "").strip("\"'") for m in ATTRIBUTE.finditer(raw)} if raw and not raw.isspace() else {}
    tokens = f"{at.get('class', '')} {at.get('id', '')}".split()
    named = at.get("class", "").split() if tag in HEADINGS else tokens  # a heading's id is made of its text
    sign = tag + "." + re.sub(r"\d+", "", " ".join(sorted(tokens)).lower()) if tokens else tag
    inside = bool(outer and (outer.main or outer.article))
    frame = tag in ("html", "body", "main")
    role = at.get("role", "").lower()
    noise = not frame and (
        tag in DROP_TAGS and tag != "form" or tag == "header" and not inside or any(map(names_noise, named)) or role in DROP_ROLES and role != "form"
        or "hidden" in at or at.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", at.get("style", "")))
    )
    held = bool(outer and outer.dropped)
    form = not noise and (bool(outer and outer.form) if held else tag == "form" or role == "form" and not frame)
    dropped = held or noise or form
    is_main = tag == "main" or at.get("role", "").lower() == "main"
    e = Element(tag, sign, node_of(outer.node if outer else 0, sign), outer, dropped, form, is_main or bool(outer and outer.main), tag == "article" or bool(outer and outer.article))
    e.home = e if tag not in INLINE or dropped and not (outer and outer.dropped) else outer.home if outer else None
    e.part = e if tag in PARTS else outer.part if outer else None
    e.depth = outer.depth + 1 if outer else 0
    return e


class _Reader:
    def __init__(self, html: str) -> None:
        self.html = html
        self.out: list[Block] = []
        self.stack: list[Element] = []
        self.open: dict[str, int] = {}
        self.held: list[str] = []
        self.place: Element | None = None
        self.never: set[str] = set()  # end tags that don't come any more
        self.plain = False  # quotes don't pair any more

    def flush(self) -> None:
        if self.held:
            text = SPACE.sub(" ", unescape("".join(self.held))).strip()
            if text:
                self.out.append(Block(text, self.place))
            self.held.clear()

    def text(self, a: int, b: int) -> None:
        if b > a:
            if not self.held:
                self.place = self.stack[-1].home if self.stack else None
            self.held.append(self.html[a:b])

    def pop_to(self, depth: int) -> None:
        """Close all elements from a depth of the stack on."""
        while len(self.stack) > depth:
            e = self.stack.pop()
            self.open[e.tag] -= 1
            if e.tag in INLINE:
                home = self.stack[-1].home if self.stack else None
                if e.home is e:
                    self.flush()
                elif home:
                    home.inlines[e.tag] = home.inlines.get(e.tag, 1) - 1

    def push(self, tag: str, raw: str) -> None:
        e = _element(tag, raw, self.stack[-1] if self.stack else None)
        if tag in INLINE:
            if e.home is e:
                self.flush()
            elif e.home:
                e.home.inlines[tag] = e.home.inlines.get(tag, 0) + 1
        self.stack.append(e)
        self.open[tag] = self.open.get(tag, 0) + 1

    def tag_end(self, at: int) -> int:
        """Where the tag whose name ends at `at` has its >, quotes apart; -1 if nowhere."""
        html, i = self.html, at
        while not self.plain:
            close = html.find(">", i)
            if close < 0:
                return -1
            m = QUOTE.search(html, i, close)
            if not m:
                return close
            i = html.find(m[0], m.end()) + 1
            if i == 0:
                self.plain = True  # an open quote: from here on a tag ends at its first >
        return html.find(">", at)

    def close(self, tag: str) -> None:
        if not self.open.get(tag):
            return
        top = self.stack[-1]
        if tag in INLINE:
            home = top.home
            held = bool(home and home.tag == tag) or bool(home and home.inlines.get(tag, 0) > 0) or not home
            if not held:
                return
            k = len(self.stack) - 1
            while self.stack[k].tag != tag:
                if self.stack[k].tag not in INLINE:
                    return
                k -= 1
            self.pop_to(k)
        else:
            self.flush()
            k = len(self.stack) - 1
            while self.stack[k].tag != tag:
                k -= 1
            self.pop_to(k)

    def start(self, tag: str, raw: str) -> None:
        if tag in INLINE:
            if tag not in VOID:
                self.push(tag, raw)
            return
        self.flush()
        if tag in VOID:
            return
        home = self.stack[-1].home if self.stack else None
        if home and home.tag in ("p", "option"):  # both end where another block begins
            self.pop_to(home.depth)
        while self.stack and (part := self.stack[-1].part) and part.tag in ENDS.get(tag, ()):
            self.pop_to(part.depth)
        self.push(tag, raw)

    def read(self) -> list[Block]:
        html, at = self.html, 0
        while True:
            i = html.find("<", at)
            if i < 0:
                break
            self.text(at, i)
            at = self._markup(i)
        self.text(at, len(html))
        self.flush()
        return self.out

    def _markup(self, i: int) -> int:
        """Handle what stands at a <, and say where reading goes on."""
        html, n = self.html, len(self.html)
        if html.startswith("<!--", i):
            end = html.find("-->", i + 4)
            return n if end < 0 else end + 3
        slash = html.startswith("/", i + 1)
        m = NAME.match(html, i + 1 + slash)
        if not m:
            if html[i + 1 : i + 2] in ("!", "?", "/") and html[i + 1 : i + 2]:
                end = html.find(">", i)
                return n if end < 0 else end + 1
            self.text(i, i + 1)
            return i + 1
        end, tag = self.tag_end(m.end()), m[0].lower()
        if end < 0:
            return n  # a tag cut off by the page's end
        if slash:
            self.close(tag)
            return end + 1
        if tag in RAW or tag in HIDDEN:
            stop = -1 if tag in self.never else self._end_of(tag, end + 1)
            if stop >= 0:
                return stop
            self.never.add(tag)
            return n if tag in RAW else end + 1
        self.start(tag, html[m.end() : end].rstrip("/"))
        return end + 1

    def _end_of(self, tag: str, at: int) -> int:
        m = END_TAGS[tag].search(self.html, at)
        if not m:
            return -1
        end = self.html.find(">", m.end())
        return len(self.html) if end < 0 else end + 1


QUOTE = re.compile("[\"']")
END_TAGS = {t: re.compile(f"</{t}(?![a-zA-Z0-9:-])", re.I) for t in RAW | HIDDEN}


def blocks_of(html: str) -> list[Block]:
    """The non-empty text blocks in page order, with references decoded, white space collapsed and trimmed."""
    return _Reader(html).read()
