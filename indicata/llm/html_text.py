"""Main text of web pages from shallow features of flat text blocks.

A page becomes a flat list of text blocks: block-level tags end a block, inline tags
don't, and scripts, styles, comments, forms' controls and the head hold no text. Each
block has shallow features: words, link density and links, those of its neighbours, how much plain text
lies before and after it, the link density around it, whether it stands in the page's main column
(the innermost element that holds most plain words), and what its enclosing tags and their class and
id names say. A name denied (``no-sidebar``) says nothing, and a compound is named by its
last word (``related-work`` is work). What is named like a side part is none if it holds most of the page's
words and all of its articles, so wrappers lose nothing; forms and vague names count still less. Readers' comments are
also known by their title ("3 Comments") and by repeated links to reply. A decision tree, trained
here on the small labelled table ``EXAMPLES``, tells main text from the rest.

Scale: one pass, no shuffle; time and memory are linear in a page's length.

Edge cases: a null or empty page has an empty text; broken markup (tags that never
close, a cut entity) is read as far as it makes sense; text outside any tag is a
block. Repeated rows are each extracted.
"""

from __future__ import annotations

import html as _entities
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, texts_of

#: Fixed values of HTML: elements that don't end a block, that hold no page text, that never close.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SILENT = frozenset("script style head noscript template svg math iframe object canvas select textarea button title audio video map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title"))
RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
#: Elements that close an open element of the same kind (``p`` closes at any block).
SELF_CLOSING = frozenset("p li dt dd tr td th option".split())

#: Elements of a head, which any other one ends.
HEAD_TAGS = frozenset("base link meta title script style noscript template".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

MAIN_TAGS = frozenset(("article", "main"))
SIDE_TAGS = frozenset("nav header footer aside menu dialog".split())
MAIN_NAMES = frozenset("article content main post entry story body text".split())
#: Words that name parts beside the main text, and words that may also name parts of it.
SIDE_NAMES = frozenset(
    "ad ads advert advertisement adverts banner sponsor sponsored promo promotion sidebar aside widget menu nav navbar navigation breadcrumb breadcrumbs crumbs masthead footer foot cookie cookies consent notice gdpr popup modal overlay newsletter subscribe signup login share sharing social recommended teaser pagination pager comment comments disqus reply replies respond responses readers copyright disclaimer toolbar alert".split()
)
WEAK_NAMES = frozenset("form search legal tags side related discussion reader header rail".split())
#: Words of names for readers' comments.
READER_NAMES = frozenset("comment comments disqus reply replies respond responses readers".split())
#: Words that make a column of no other name one that may be a side part (``col-right``).
EDGES, COLUMNS = frozenset(("left", "right")), frozenset("bar block box col column container panel".split())
#: What titles of readers' comments say, without numbers, and the links below each of them.
READER_TITLES = frozenset(("comments", "comment", "responses", "replies", "reader comments", "readers comments", "readers' comments", "leave a comment", "leave a reply", "kommentare", "kommentar", "leserkommentare", "commentaires", "commentaire", "comentarios", "comentario"))
REPLY_WORDS = frozenset("reply antworten répondre responder".split())
#: Words after such a word that change nothing (``comments-list``), and those before it that deny it (``no-sidebar``).
PART_WORDS = frozenset("area bar block bottom box buttons col column container desktop fixed group holder inner item items left line link links list mobile module outer panel posts region right row section slot sticky title top unit widget wrap wrapper".split())
TEXT_WORDS = frozenset("body content text".split())
DENYING = frozenset("no not has have with without hide hides".split())
#: Share of a page's words, and number of them, with which an element that a name or a form marks is no side part; share that the main column holds.
MOST, MANY, COLUMN = 0.5, 30, 0.6
#: Share of its column's words that an article holds at least to be the main text by itself.
TEASER = 0.15
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HIDDEN_STYLE = re.compile(r"display\s*:\s*none", re.I)
#: Elements that don't stand for a part of the page by themselves.
NO_PART = frozenset("p li ul ol dl dt dd table thead tbody tfoot tr td th blockquote h1 h2 h3 h4 h5 h6".split()) | INLINE
#: Words of text before and after a block that are told apart.
FAR = 100
NAME_CUT = re.compile(r"[^a-z0-9]+")
SPACE = re.compile(r"\s+")
NAME = re.compile(r"[A-Za-z][^\s/>]*")
MARK = re.compile("[>\"']")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    links: int
    main: bool
    side: bool
    heading: bool
    item: bool
    column: int = 2  # 2 in the main column, 1 between the page's title and it, else 0
    around: float = 0.0
    before: int = 0
    after: int = 0


def _attributes(text: str) -> dict[str, str]:
    """Attributes by lower-case name; the first of equal names counts."""
    out: dict[str, str] = {}
    for name, double, single, bare in ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), double or single or bare)
    return out


def _hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true" or bool(HIDDEN_STYLE.search(attributes.get("style", "")))


def _kind(attributes: dict[str, str]) -> tuple[int, bool, bool]:
    """What class, id and role names say: 2 for a side part, 1 for what may be one, else 0; whether one is a main name, and one for readers' comments."""
    side, main, reader = 0, False, False
    for name in " ".join(attributes.get(a, "") for a in ("class", "id", "role")).split():
        words = [w for w in NAME_CUT.split(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w and not w.isdigit()]
        main |= not MAIN_NAMES.isdisjoint(words)
        if not words or not DENYING.isdisjoint(words):
            continue
        # a compound is named by its last word that means something
        k = len(words)
        while k > 1 and words[k - 1] in PART_WORDS and words[k - 1] not in SIDE_NAMES:
            k -= 1
        while k > 1 and words[k - 1] in TEXT_WORDS and words[k - 2] in SIDE_NAMES:
            k -= 1
        edge = not EDGES.isdisjoint(words) and not COLUMNS.isdisjoint(words) and PART_WORDS.issuperset(words)
        side = max(side, 2 if words[k - 1] in SIDE_NAMES else words[k - 1] in WEAK_NAMES or edge)
        reader |= words[k - 1] in READER_NAMES
    return side, main, reader


class _Tags:
    """The tags of a page, each once: linear in its length, however broken."""

    def __init__(self, page: str):
        self.page, self.quotes = page, {'"', "'"}

    def end(self, at: int) -> int:
        """Where the tag ends whose attributes start at ``at``, past its ``>``; -1 if it doesn't."""
        page, start = self.page, at
        while self.quotes:
            m = MARK.search(page, at)
            if m is None:
                # quotes that swallow the rest of a page are no quotes
                self.quotes = set()
                break
            if m[0] == ">":
                return m.end()
            at = m.end()
            if m[0] in self.quotes:
                close = page.find(m[0], at)
                if close < 0:
                    self.quotes = self.quotes - {m[0]}
                else:
                    at = close + 1
        return page.find(">", start) + 1 or -1

    def __iter__(self):
        """(start, end, name, closing, attributes) of tags, and (start, end, "", False, text) of comments and the like."""
        page, at = self.page, 0
        while (start := page.find("<", at)) >= 0:
            at = start + 1
            if page.startswith(("!", "?"), at):
                if page.startswith("!--", at):
                    close, text = page.find("-->", at + 3), ""
                    stop = close + 3
                elif page.startswith("![CDATA[", at):
                    close = page.find("]]>", at + 8)
                    stop, text = close + 3, page[at + 8 : close if close >= 0 else len(page)]
                else:
                    close, text = page.find(">", at), ""
                    stop = close + 1
                at = stop if close >= 0 else len(page)
                at = max(at, (yield start, at, "", False, text) or 0)
                continue
            closing = page.startswith("/", at)
            name = NAME.match(page, at + closing)
            if name is None:
                continue
            if (stop := self.end(name.end())) < 0:
                return  # no tag ends after this
            at = stop
            at = max(at, (yield start, at, name[0].lower(), closing, page[name.end() : stop - 1]) or 0)


class _Page:
    """Blocks of a page, and the elements that they stand in."""

    def __init__(self):
        self.blocks: list[tuple[str, int, int, int, str, bool, int]] = []  # text, words, linked words, links, tag, item, element
        self.above, self.side, self.main, self.tag, self.named, self.reader = [-1], [0], [False], [""], [False], [False]  # by element; the first is the page
        self.stack: list[tuple[str, int, int]] = []  # tag, element, whether it is silent
        self.open: dict[str, list[int]] = {}  # depths of open tags, by tag
        self.walls: list[int] = []  # depths of open tags that aren't inline
        self.silent = self.inside = self.anchors = 0
        self.parts: list[tuple[str, bool]] = []

    def say(self, text: str) -> None:
        if text and not self.silent:
            self.parts.append((_entities.unescape(text), bool(self.open.get("a"))))

    def flush(self) -> None:
        if self.parts:
            text = SPACE.sub(" ", "".join(t for t, _ in self.parts)).strip()
            if text:
                linked = sum(len(t.split()) for t, link in self.parts if link)
                top = self.stack[-1][:2] if self.stack else ("", 0)
                self.blocks.append((text, len(text.split()), linked, max(self.anchors, linked > 0), top[0], bool(self.open.get("li")), top[1]))
            self.parts.clear()
        self.anchors = 0

    def close(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag, element, silent = self.stack.pop()
            self.open[tag].pop()
            if self.walls and self.walls[-1] == len(self.stack):
                self.walls.pop()
            self.silent -= silent
            self.inside -= self.main[element] and tag not in INLINE

    def end(self, tag: str) -> None:
        at = self.open.get(tag)
        # an inline element is closed only within its block
        if at and (tag not in INLINE or not self.walls or at[-1] > self.walls[-1]):
            self.close(at[-1])

    def start(self, tag: str, attributes: str) -> None:
        if self.walls:
            # a block ends an open paragraph or one of its kind, and inline elements left open in it
            last = self.stack[self.walls[-1]][0]
            if tag not in INLINE and (last == "p" or tag in SELF_CLOSING and last == tag):
                self.close(self.walls[-1])
        if tag not in HEAD_TAGS and self.open.get("head"):
            self.close(self.open["head"][-1])
        given = _attributes(attributes) if attributes else {}
        side, named, reader = _kind(given) if given else (0, False, False)
        by_name = side == 2
        if tag in SIDE_TAGS and not (tag == "header" and self.inside):
            side, by_name = 2, False
        elif tag == "form":
            side = max(side, 1)
        if tag in ("body", "html", "main"):
            side = 0
        self.anchors += tag == "a"
        silent = tag in SILENT or bool(given) and _hidden(given)
        self.above.append(self.stack[-1][1] if self.stack else 0)
        self.side.append(side)
        self.main.append(tag in MAIN_TAGS or named and tag not in INLINE)
        self.tag.append(tag)
        self.named.append(by_name)
        self.reader.append(reader)
        self.open.setdefault(tag, []).append(len(self.stack))
        if tag not in INLINE:
            self.walls.append(len(self.stack))
        self.stack.append((tag, len(self.above) - 1, int(silent)))
        self.silent += silent
        self.inside += self.main[-1] and tag not in INLINE

    def _sums(self, values: list[int]) -> list[int]:
        """Sums over elements and all within them."""
        for e in range(len(values) - 1, 0, -1):
            values[self.above[e]] += values[e]
        return values

    def _within(self, flags: list[bool]) -> list[bool]:
        """Flags of elements, and of all within flagged ones."""
        for e in range(1, len(flags)):
            flags[e] = flags[e] or flags[self.above[e]]
        return flags

    def _beside(self, plain: list[int], titles: list[int]) -> list[bool]:
        """Elements that tags and names put beside the main text, once it is known what each of them holds."""
        n = len(self.above)
        articles = self._sums([int(self.tag[e] in MAIN_TAGS and self.side[e] < 2) for e in range(n)])
        mains = self._sums([int(t == "main") for t in self.tag])
        out = [False] * n
        for e in range(1, n):
            most = plain[e] >= MANY and plain[e] >= MOST * plain[0]
            if self.side[e] == 2:
                # a wrapper holds most of the page and no article is left outside; one named for readers' comments the title, too, or at least the article
                wrapper = self.named[e] and most and articles[e] == articles[0] and (not self.reader[e] or (titles[e] > 0 if titles[0] else articles[e] > 0))
                out[e] = not mains[e] and not wrapper
            elif self.side[e] == 1:
                out[e] = not articles[e] and not most
        return self._within(out)

    def _replies(self, titles: list[int]) -> list[bool]:
        """Elements of readers' comments that only links to reply tell."""
        n = len(self.above)
        count = [0] * n
        for text, words, linked, _, _, _, e in self.blocks:
            count[e] += linked == words and text.lower() in REPLY_WORDS
        count, out = self._sums(count), [False] * n
        if count[0] < 2:
            return out
        below: dict[int, list[int]] = {}
        for e in range(1, n):
            if count[e]:
                below.setdefault(self.above[e], []).append(e)
        top = 0
        while len(below.get(top, ())) == 1 and count[below[top][0]] == count[0]:
            top = below[top][0]
        # the innermost element of all replies, or its parts, if it holds more than readers' comments
        whole = top and self.tag[top] not in ("body", "html", *MAIN_TAGS) and not titles[top] and not self.main[top]
        for e in [top] if whole else below.get(top, []):
            out[e] = not titles[e]
        return self._within(out)

    def _titled(self, skip: list[bool]) -> list[bool]:
        """Blocks from a title of readers' comments on to the end of the element that it stands in."""
        last = list(range(len(self.above)))  # elements are numbered as they open, so those within one follow it
        for e in range(len(last) - 1, 0, -1):
            last[self.above[e]] = max(last[self.above[e]], last[e])
        out, until, said = [False] * len(self.blocks), None, 0
        for k, (text, words, linked, _, tag, _, e) in enumerate(self.blocks):
            if until is not None:
                if until <= e <= last[until]:
                    out[k] = True
                    continue
                until = None
            if tag in HEADINGS and said and " ".join(re.sub(r"[\d().,:|]+", " ", text).lower().split()) in READER_TITLES:
                until, out[k] = self.above[e], True
            said += 0 if skip[e] else words - linked
        return out

    def found(self) -> list[Block]:
        """The blocks, once it is known what each element holds."""
        n = len(self.above)
        plain, titles = [0] * n, [0] * n  # words outside links, titles of the page
        for _, words, linked, _, tag, _, element in self.blocks:
            plain[element] += words - linked
            titles[element] += tag == "h1"
        plain, titles = self._sums(plain), self._sums(titles)
        beside, main = self._beside(plain, titles), self._within(list(self.main))
        for e, out in enumerate(self._replies(titles)):
            beside[e] |= out
        titled = self._titled(beside)
        side = [beside[b[6]] or t for b, t in zip(self.blocks, titled)]

        # the innermost part that holds most of what isn't beside
        own, every, linked_in = [0] * n, [0] * n, [0] * n
        for (_, words, linked, _, _, _, e), out in zip(self.blocks, side):
            own[e] += 0 if out else words - linked
            every[e] += words
            linked_in[e] += linked
        own, every, linked_in = self._sums(own), self._sums(every), self._sums(linked_in)
        column = 0
        for e in range(1, n):
            if self.above[e] == column and self.tag[e] not in NO_PART and own[e] >= COLUMN * own[0] > 0:
                column = e
        # the only article in it is meant, where it isn't a mere teaser
        held = self._within([e == column for e in range(n)])
        for tag in ("main", "article"):
            only = [e for e in range(1, n) if self.tag[e] == tag and held[e] and not beside[e]]
            if len(only) == 1 and own[only[0]] >= TEASER * own[column]:
                column = only[0]
        inside = self._within([e == column for e in range(n)])
        part = list(range(n))
        for e in range(1, n):
            if self.tag[e] in NO_PART:
                part[e] = part[self.above[e]]

        first = next((k for k, b in enumerate(self.blocks) if inside[b[6]]), 0)
        head = [k for k, b in enumerate(self.blocks[:first]) if b[4] in HEADINGS and not side[k]]
        title = next((k for k in head if self.blocks[k][4] == "h1"), None)
        if title is None and head and not any(b[4] in HEADINGS for b in self.blocks if inside[b[6]]):
            title = head[-1]
        lead = range(first if title is None else title, first)
        text = np.array([0 if out or 2 * b[2] > b[1] or not (inside[b[6]] or k in lead) else b[1] - b[2] for k, (b, out) in enumerate(zip(self.blocks, side))], np.int64)
        before = np.cumsum(text) - text
        after = text.sum() - before - text
        out = []
        for k, (shown, words, linked, links, tag, item, e) in enumerate(self.blocks):
            place = 2 if inside[e] else int(k in lead)
            around = linked_in[part[e]] / every[part[e]] if every[part[e]] else 0.0
            out.append(Block(shown, words, linked, links, main[e], side[k], tag in HEADINGS, item, place, around, min(FAR, int(before[k])), min(FAR, int(after[k]))))
        return out


def blocks(page: str) -> list[Block]:
    out, tags, at = _Page(), iter(_Tags(page)), 0
    skip = None
    while True:
        try:
            start, stop, tag, closing, attributes = tags.send(skip)
        except StopIteration:
            break
        skip = None
        out.say(page[at:start])
        at = stop
        if not tag:
            out.say(attributes)
            continue
        if tag not in INLINE:
            out.flush()
        if closing:
            out.end(tag)
        elif tag not in VOID and not (attributes.endswith("/") and tag in ("script", "style", "svg", "math", "iframe")):
            out.start(tag, attributes)
            if tag in RAW:
                end = RAW_END[tag].search(page, at)
                out.end(tag)
                skip = at = end.end() if end else len(page)
    out.say(page[at:])
    out.flush()
    return out.found()


FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "main", "side", "heading", "item", "column", "around", "text_before", "text_after", "links")


def features(found: list[Block]) -> np.ndarray:
    words = np.array([0, *(b.words for b in found), 0], float)
    density = np.array([0, *(b.linked / b.words if b.words else 0 for b in found), 0], float)
    flags = np.array([[b.main, b.side, b.heading, b.item, b.column, b.around, b.before, b.after, b.links] for b in found], float).reshape(-1, 9)
    return np.column_stack([words[1:-1], density[1:-1], words[:-2], density[:-2], words[2:], density[2:], flags])


#: The labelled table: the first ten FEATURES, then 1 for main text. Made by hand from usual page layouts.
SHAPES = np.array(
    [
        # articles: headings, long and short paragraphs, lists, links in running text
        (8, 0.0, 9, 0.0, 60, 0.0, 1, 0, 1, 0, 1), (9, 0.0, 1, 1.0, 45, 0.0, 1, 0, 1, 0, 1), (60, 0.0, 8, 0.0, 75, 0.02, 1, 0, 0, 0, 1), (75, 0.02, 60, 0.0, 40, 0.0, 1, 0, 0, 0, 1),
        (40, 0.1, 75, 0.02, 3, 0.0, 1, 0, 0, 0, 1), (3, 0.0, 40, 0.1, 2, 0.0, 1, 0, 0, 0, 1), (2, 0.0, 3, 0.0, 1, 0.0, 1, 0, 0, 0, 1), (1, 0.0, 2, 0.0, 90, 0.0, 1, 0, 0, 0, 1),
        (1, 0.0, 0, 0.0, 0, 0.0, 1, 0, 0, 0, 1), (25, 0.0, 1, 0.0, 12, 0.0, 1, 0, 0, 1, 1), (6, 0.0, 25, 0.0, 5, 0.0, 1, 0, 0, 1, 1), (5, 0.2, 6, 0.0, 30, 0.0, 1, 0, 0, 1, 1),
        (4, 1.0, 30, 0.0, 35, 0.0, 1, 0, 0, 0, 1), (30, 0.0, 4, 1.0, 12, 0.0, 1, 0, 0, 0, 1), (12, 0.3, 30, 0.0, 8, 0.0, 1, 0, 0, 0, 1), (200, 0.0, 8, 0.0, 150, 0.0, 1, 0, 0, 0, 1),
        (15, 0.5, 120, 0.0, 80, 0.0, 1, 0, 0, 0, 1), (7, 0.0, 80, 0.0, 50, 0.0, 1, 0, 1, 0, 1), (4, 0.0, 50, 0.0, 6, 0.0, 1, 0, 0, 1, 1), (18, 0.0, 6, 0.0, 8, 0.0, 1, 0, 0, 0, 1),
        # the same on pages that mark no article
        (9, 0.0, 1, 1.0, 50, 0.0, 0, 0, 1, 0, 1), (50, 0.0, 9, 0.0, 60, 0.0, 0, 0, 0, 0, 1), (60, 0.05, 50, 0.0, 14, 0.0, 0, 0, 0, 0, 1), (14, 0.0, 60, 0.05, 70, 0.0, 0, 0, 0, 0, 1),
        (70, 0.0, 14, 0.0, 6, 0.0, 0, 0, 0, 0, 1), (25, 0.0, 70, 0.0, 7, 0.0, 0, 0, 0, 0, 1), (5, 0.0, 60, 0.0, 55, 0.0, 0, 0, 0, 0, 1), (11, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1),
        # menus and lists of links
        (1, 1.0, 0, 0.0, 1, 1.0, 0, 1, 0, 1, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 0, 1, 0), (1, 1.0, 1, 1.0, 9, 0.0, 0, 1, 0, 1, 0), (2, 1.0, 2, 1.0, 2, 1.0, 0, 0, 0, 1, 0),
        (3, 1.0, 2, 1.0, 4, 1.0, 0, 0, 0, 0, 0), (6, 1.0, 5, 1.0, 7, 1.0, 0, 0, 0, 1, 0), (8, 0.9, 6, 1.0, 6, 1.0, 0, 0, 0, 0, 0), (5, 1.0, 40, 0.0, 6, 1.0, 0, 0, 0, 0, 0),
        (4, 1.0, 30, 0.0, 5, 1.0, 1, 1, 0, 1, 0), (5, 1.0, 4, 1.0, 4, 1.0, 1, 1, 0, 1, 0), (12, 0.8, 3, 1.0, 2, 1.0, 0, 0, 0, 0, 0), (2, 0.0, 1, 1.0, 2, 1.0, 0, 0, 1, 0, 0),
        # headers, footers, sidebars
        (3, 0.0, 0, 0.0, 1, 1.0, 0, 1, 1, 0, 0), (8, 0.0, 60, 0.0, 0, 0.0, 0, 1, 0, 0, 0), (12, 0.1, 80, 0.0, 4, 1.0, 0, 1, 0, 0, 0), (25, 0.0, 50, 0.0, 0, 0.0, 0, 1, 0, 0, 0),
        (40, 0.0, 60, 0.0, 10, 0.0, 0, 1, 0, 0, 0), (3, 0.0, 60, 0.0, 20, 0.0, 0, 1, 1, 0, 0), (20, 0.2, 3, 0.0, 5, 1.0, 0, 1, 0, 0, 0), (5, 0.0, 20, 0.2, 0, 0.0, 0, 1, 0, 0, 0),
        (2, 0.5, 60, 0.0, 1, 1.0, 0, 0, 0, 0, 0), (4, 0.0, 3, 1.0, 2, 1.0, 0, 0, 0, 0, 0), (6, 0.0, 3, 1.0, 0, 0.0, 0, 0, 0, 0, 0),
        # adverts, notices, forms
        (10, 0.0, 1, 1.0, 9, 0.0, 0, 1, 0, 0, 0), (12, 0.0, 50, 0.0, 70, 0.0, 1, 1, 0, 0, 0), (30, 0.1, 0, 0.0, 1, 1.0, 0, 1, 0, 0, 0), (60, 0.0, 30, 0.0, 40, 0.0, 1, 1, 0, 0, 0),
        (3, 0.0, 40, 0.0, 4, 0.0, 1, 1, 0, 0, 0), (2, 0.0, 0, 0.0, 2, 0.0, 0, 1, 0, 0, 0), (90, 0.0, 0, 0.0, 3, 0.0, 0, 1, 0, 0, 0), (6, 0.0, 90, 0.0, 50, 0.0, 0, 1, 0, 0, 0),
        # readers' comments, within the article's element or beside it
        (35, 0.0, 70, 0.0, 2, 0.0, 1, 1, 0, 0, 0), (2, 0.5, 35, 0.0, 50, 0.0, 1, 1, 0, 0, 0), (50, 0.0, 2, 0.5, 1, 1.0, 1, 1, 0, 1, 0), (120, 0.0, 50, 0.0, 80, 0.0, 0, 1, 0, 0, 0),
        (80, 0.02, 120, 0.0, 0, 0.0, 0, 1, 0, 1, 0), (1, 0.0, 60, 0.0, 35, 0.0, 1, 1, 1, 0, 0),
        # long blocks of text before lists of links, on pages that mark an article and on others
        (200, 0.0, 60, 0.0, 2, 1.0, 0, 0, 0, 0, 1), (45, 0.0, 30, 0.0, 1, 1.0, 0, 0, 0, 0, 1), (20, 0.1, 40, 0.0, 3, 0.9, 0, 0, 0, 0, 1), (12, 0.0, 50, 0.0, 2, 1.0, 0, 0, 0, 0, 1),
        (90, 0.0, 2, 1.0, 2, 1.0, 0, 0, 0, 0, 1), (15, 0.0, 3, 1.0, 4, 1.0, 0, 0, 0, 0, 1), (30, 0.3, 20, 0.0, 1, 1.0, 0, 0, 0, 1, 1), (60, 0.0, 0, 0.0, 1, 1.0, 0, 0, 0, 0, 1),
        (80, 0.0, 60, 0.0, 1, 1.0, 1, 0, 0, 0, 1), (4, 0.0, 50, 0.0, 2, 1.0, 1, 0, 0, 0, 1), (3, 0.0, 4, 0.0, 3, 1.0, 1, 0, 0, 1, 1), (2, 0.0, 1, 1.0, 1, 1.0, 1, 0, 1, 0, 1),
        # short blocks amid text on pages that mark no article
        (4, 0.0, 50, 0.0, 6, 0.0, 0, 0, 0, 1, 1), (3, 0.0, 4, 0.0, 5, 0.0, 0, 0, 0, 1, 1), (5, 0.0, 3, 0.0, 12, 0.0, 0, 0, 0, 0, 1), (2, 0.0, 30, 0.0, 20, 0.0, 0, 0, 1, 0, 1),
        (1, 0.0, 5, 0.0, 4, 0.0, 0, 0, 0, 0, 1), (6, 0.0, 2, 1.0, 18, 0.0, 0, 0, 1, 0, 1), (3, 0.0, 0, 0.0, 9, 0.0, 0, 0, 1, 0, 1), (2, 0.0, 0, 0.0, 3, 0.0, 0, 0, 0, 0, 1),
        (2, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (3, 0.0, 2, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (5, 0.0, 30, 0.0, 0, 0.0, 0, 0, 0, 1, 1), (3, 0.0, 5, 0.0, 2, 1.0, 0, 0, 0, 1, 1), (4, 0.0, 20, 0.0, 1, 1.0, 0, 0, 0, 1, 1),
        # short titles and blocks after links
        (2, 0.0, 1, 1.0, 40, 0.0, 0, 0, 1, 0, 1), (3, 0.0, 1, 1.0, 20, 0.0, 0, 0, 1, 0, 1), (2, 0.0, 2, 1.0, 12, 0.0, 0, 0, 0, 0, 1), (1, 0.0, 1, 1.0, 60, 0.0, 0, 0, 1, 0, 1),
        (2, 0.0, 1, 1.0, 50, 0.0, 1, 0, 1, 0, 1), (3, 0.0, 2, 1.0, 30, 0.0, 1, 0, 0, 0, 1), (2, 0.0, 4, 1.0, 0, 0.0, 1, 0, 0, 0, 1), (3, 0.0, 2, 1.0, 2, 1.0, 1, 0, 0, 0, 1),
        (9, 0.0, 3, 1.0, 40, 0.0, 0, 0, 1, 0, 1), (30, 0.0, 3, 1.0, 20, 0.0, 0, 0, 0, 0, 1), (40, 0.0, 3, 1.0, 0, 0.0, 0, 0, 0, 0, 1), (2, 0.0, 3, 1.0, 5, 0.0, 0, 0, 1, 0, 1),
        (70, 0.0, 3, 1.0, 0, 0.0, 1, 0, 0, 0, 1), (4, 0.0, 3, 1.0, 0, 0.0, 1, 0, 0, 0, 1), (2, 0.0, 3, 1.0, 8, 0.0, 1, 0, 0, 1, 1), (12, 0.0, 3, 1.0, 0, 0.0, 0, 0, 0, 0, 1),
        # the last block of a page without a footer
        (50, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (14, 0.0, 25, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (120, 0.1, 2, 1.0, 0, 0.0, 0, 0, 0, 0, 1), (25, 0.0, 4, 0.0, 0, 0.0, 0, 0, 0, 1, 1),
        (40, 0.0, 60, 0.0, 0, 0.0, 1, 0, 0, 0, 1), (2, 0.0, 3, 0.0, 0, 0.0, 1, 0, 0, 0, 1), (5, 0.0, 80, 0.0, 0, 0.0, 1, 0, 0, 1, 1), (6, 0.0, 2, 1.0, 0, 0.0, 1, 0, 0, 0, 1),
        (2, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (3, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (2, 0.0, 0, 0.0, 0, 0.0, 1, 0, 0, 0, 1),
        # links before text, alone or the last of a menu, and at a page's end
        (1, 1.0, 1, 1.0, 40, 0.0, 0, 0, 0, 1, 0), (2, 1.0, 2, 1.0, 8, 0.0, 0, 0, 0, 0, 0), (3, 1.0, 0, 0.0, 60, 0.0, 0, 0, 0, 0, 0), (1, 1.0, 0, 0.0, 3, 0.0, 0, 0, 0, 0, 0),
        (2, 1.0, 50, 0.0, 6, 0.0, 0, 0, 0, 0, 0), (4, 1.0, 60, 0.0, 70, 0.0, 0, 0, 0, 0, 0), (15, 0.9, 5, 1.0, 30, 0.0, 0, 0, 0, 0, 0), (25, 1.0, 20, 1.0, 50, 0.0, 0, 0, 0, 1, 0),
        (3, 1.0, 4, 1.0, 0, 0.0, 0, 0, 0, 1, 0), (2, 1.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 0), (2, 1.0, 60, 0.0, 0, 0.0, 0, 0, 0, 0, 0), (8, 0.8, 12, 0.0, 0, 0.0, 0, 0, 0, 0, 0),
        # short blocks over or under lists of links: their titles, a line under a footer's links
        (2, 0.0, 50, 0.0, 3, 1.0, 0, 0, 1, 0, 0), (3, 0.0, 0, 0.0, 1, 1.0, 0, 0, 0, 0, 0), (4, 0.0, 60, 0.0, 2, 1.0, 0, 0, 0, 0, 0),
    ]
)


#: Where such blocks stand: column, around, text_before, text_after, links.
_TEXT_PLACES = ((2, 0.05, 0, 100), (2, 0.05, 100, 0), (2, 0.3, 100, 100), (2, 0.0, 40, 30))
_LINK_PLACES = ((0, 1.0, 0, 100), (0, 1.0, 100, 0), (0, 0.9, 100, 100), (2, 0.9, 0, 100), (2, 0.7, 100, 0), (2, 0.1, 0, 100), (2, 0.1, 100, 0))
_NOTE_PLACES = ((0, 0.8, 100, 0), (0, 0.6, 0, 100), (2, 0.5, 100, 0), (2, 0.05, 100, 0))
_SIDE_PLACES = ((0, 0.1, 0, 100), (0, 0.6, 100, 0), (2, 0.1, 100, 100), (2, 0.1, 100, 0), (2, 0.1, 0, 100))
#: Blocks whose place decides: all features.
PLACED = np.array(
    [
        # a paragraph that is one link, and a list of links under its heading, within running text
        *[(w, 1.0, b, 0.0, a, 0.0, m, 0, 0, 0, 2, r, x, y, 1, 1) for w in (2, 4, 9) for b, a, x, y in ((60, 50, 60, 80), (30, 8, 90, 40), (7, 40, 40, 60), (50, 3, 100, 30)) for m, r in ((0, 0.05), (1, 0.1), (0, 0.25))],
        *[(w, 1.0, b, d, a, e, m, 0, 0, 1, 2, 0.2, x, y, 1, 1) for w in (1, 3, 6) for b, d, a, e in ((2, 0.0, 3, 1.0), (3, 1.0, 3, 1.0), (3, 1.0, 50, 0.0)) for x, y in ((60, 60), (100, 40), (30, 100)) for m in (0, 1)],
        *[(w, 0.0, 60, 0.0, 3, 1.0, m, 0, h, 0, 2, 0.2, x, y, 0, 1) for w in (1, 3, 5) for x, y in ((60, 60), (100, 40), (30, 100)) for m, h in ((0, 1), (1, 1), (0, 0))],
        # links after the column's last text: more to read, or a foot
        *[(w, 1.0, b, 0.0, 0, 0.0, m, 0, 0, 0, 2, 0.05, 100, 0, n, 0) for w in (4, 7) for b in (20, 60) for m in (0, 1) for n in (1, 3, 5)],
        # the page's title and what leads in, outside the column
        *[(w, 0.0, b, d, a, 0.0, 0, 0, h, 0, 1, 0.05, 0, y, 0, 1) for w, h in ((6, 1), (3, 1), (25, 0), (12, 0)) for b, d in ((1, 1.0), (0, 0.0), (6, 0.0)) for a, y in ((50, 100), (12, 80))],
        # columns of no name beside the main one: short notes, titles over links, longer text
        *[(w, 0.0, b, d, a, e, 0, 0, h, i, 0, r, x, y, 0, 0) for w, h, i in ((2, 1, 0), (12, 0, 0), (30, 0, 0), (50, 0, 0), (6, 0, 1)) for b, d, a, e in ((60, 0.0, 3, 1.0), (3, 1.0, 0, 0.0), (20, 0.0, 25, 0.0)) for r, x, y in ((0.4, 100, 0), (0.1, 100, 0), (0.1, 0, 100))],
        # a menu of plain links before all text, in a page that marks no parts
        *[(w, 1.0, b, d, a, e, 0, 0, 0, i, 2, 0.05, 0, 100, n, 0) for w, n, i in ((5, 4, 0), (1, 1, 1), (2, 1, 1), (1, 1, 0)) for b, d, a, e in ((0, 0.0, 40, 0.0), (2, 1.0, 2, 1.0), (3, 0.0, 30, 0.0), (0, 0.0, 1, 1.0))],
    ]
)


def _placed(shapes: np.ndarray) -> np.ndarray:
    """Every shape in all places where its kind of block is found."""
    out = []
    for *shape, main in shapes.tolist():
        density, side = shape[1], shape[7]
        places = _TEXT_PLACES if main else _SIDE_PLACES if side else _LINK_PLACES if density >= 0.5 else _NOTE_PLACES
        if main and density >= 0.5:
            places = _TEXT_PLACES[2:]
        out += [(*shape, *place, int(density > 0), main) for place in places]
    return np.array(out)


EXAMPLES = np.concatenate([_placed(SHAPES), PLACED])


@dataclass
class Node:
    main: bool
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None


def grow(x: np.ndarray, y: np.ndarray, depth: int = 12, leaf: int = 1) -> Node:
    """A CART tree by Gini impurity; ties go to the earlier feature and the lower cut."""
    node = Node(main=bool(2 * y.sum() >= len(y)))
    if depth == 0 or y.min() == y.max():
        return node
    best = (len(y) * 2 * y.mean() * (1 - y.mean()) - 1e-9, -1, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] < cut
            if min(low.sum(), (~low).sum()) < leaf:
                continue
            loss = sum(2 * part.sum() * (1 - part.mean()) for part in (y[low], y[~low]))
            if loss < best[0] - 1e-12:
                best = (loss, f, float(cut))
    if best[1] < 0:
        return node
    low = x[:, best[1]] < best[2]
    node.feature, node.cut = best[1], best[2]
    node.low, node.high = grow(x[low], y[low], depth - 1, leaf), grow(x[~low], y[~low], depth - 1, leaf)
    return node


def classify(tree: Node, x: np.ndarray) -> list[bool]:
    out = []
    for row in x.tolist():
        node = tree
        while node.feature >= 0:
            node = node.low if row[node.feature] < node.cut else node.high
        out.append(node.main)
    return out


def train() -> Node:
    return grow(EXAMPLES[:, :-1], EXAMPLES[:, -1])


def printed(node: Node, depth: int = 0) -> str:
    """The tree as lines of tests, the branch where a test holds first."""
    pad = "  " * depth
    if node.feature < 0:
        return f"{pad}{'main' if node.main else 'rest'}\n"
    return f"{pad}{FEATURES[node.feature]} < {node.cut:g}\n" + printed(node.low, depth + 1) + printed(node.high, depth + 1)


def main_text(page: str, tree: Node) -> str:
    found = blocks(page)
    if not found:
        return ""
    return " ".join(b.text for b, keep in zip(found, classify(tree, features(found))) if keep)


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string"))
    kind = pages.schema["page_id"].dataType.simpleString()
    tree = train()

    def run(batches):
        for batch in pieces(batches, 2):
            texts = [main_text(t.decode(), tree) for t in texts_of(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
