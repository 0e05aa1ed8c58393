"""Leaf blocks of a page: runs of text between block elements, with the path of open elements.

A small tolerant reader: unclosed paragraphs, list items and cells end where the next one
begins, end tags without a start are passed over, raw elements (scripts, styles and the like)
and comments are no text, and what is cut off ends with the page. Time is linear in the page.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field
from html import unescape

#: Element names of HTML, by how they behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe noframes noembed title textarea svg math object".split())
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
#: A start tag ends the nearest open element of these names, unless one of the others is nearer.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "optgroup": ({"optgroup"}, {"select"}),
}
#: Unicode's white space.
WHITE = re.compile("[\\x20\\x09-\\x0D\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]+")

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=]+|=[^\s/>=]*)?(\s*=\s*)?")
_BARE = re.compile(r"[^\s>]*")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

PATH_BITS, NEAR = 1024, 3


@dataclass
class Blocks:
    """Of one page: texts, path of each, characters within links of each; bits of each path."""

    texts: list[str] = field(default_factory=list)
    paths: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    bits: list[int] = field(default_factory=list)


def bit(token: str) -> int:
    return 1 << (zlib.crc32(token.encode("utf-8", "replace")) % PATH_BITS)


def _start_tag(html: str, at: int, no_more: dict[str, bool]) -> tuple[str, list[str], int]:
    """Name, words of class, id and role, and the place after the tag; -1 where it doesn't end."""
    m = _NAME.match(html, at)
    name, at, words, size = m.group().lower(), m.end(), [], len(html)
    while at < size and html[at] != ">":
        m = _ATTRIBUTE.match(html, at)
        if m.end() == at:
            at += 1
            continue
        key, at = (m.group(1) or "").lower(), m.end()
        if not m.group(2):
            if key == "hidden":
                words.append("hidden")
            continue
        quote = html[at : at + 1]
        if quote and quote in "\"'" and not no_more.get(quote):
            end = html.find(quote, at + 1)
            if end < 0:  # no such quote is closed from here on: it is a plain character
                no_more[quote] = True
                end = _BARE.match(html, at).end()
                value, at = html[at:end], end
            else:
                value, at = html[at + 1 : end], end + 1
        else:
            end = _BARE.match(html, at).end()
            value, at = html[at:end], end
        if key in ("class", "id", "role"):
            words += [w.lower() for w in _WORDS.findall(value)]
    return name, words, at + 1 if at < size else -1


class _Reader:
    def __init__(self) -> None:
        self.out = Blocks(bits=[0])
        self.stack: list[tuple[str, int, tuple[str, ...]]] = []  # name, path, own tokens
        self.open: dict[str, int] = {}
        self.known: dict[tuple, int] = {}
        self.pieces: list[str] = []
        self.link = 0
        self.path = 0

    def end_block(self) -> None:
        if self.pieces:
            text = WHITE.sub(" ", "".join(self.pieces)).strip(" ")
            if text:
                o = self.out
                o.texts.append(text)
                o.paths.append(self.path)
                o.linked.append(min(self.link, len(text)))
        self.pieces, self.link = [], 0

    def text(self, raw: str) -> None:
        s = unescape(raw) if "&" in raw else raw
        if not self.pieces:
            if not WHITE.sub("", s):
                return
            self.path = self.leaf()
        self.pieces.append(s)
        if self.open.get("a"):
            self.link += len(WHITE.sub(" ", s))

    def leaf(self) -> int:
        """The path of the open elements, with its last one and what its last NEAR ones are named marked."""
        if not self.stack:
            return 0
        name, path, _ = self.stack[-1]
        return self.child(path, ("@" + name, *("^" + t for _, _, tokens in self.stack[-NEAR:] for t in tokens)))

    def child(self, path: int, tokens: tuple[str, ...]) -> int:
        k = (path, tokens)
        at = self.known.get(k)
        if at is None:
            at = self.known[k] = len(self.out.bits)
            b = self.out.bits[path]
            for t in tokens:
                b |= bit(t)
            self.out.bits.append(b)
        return at

    def pop(self, to: int) -> None:
        while len(self.stack) > to:
            self.open[self.stack.pop()[0]] -= 1

    def end_nearest(self, names: set[str], stops: set[str]) -> None:
        if any(self.open.get(n) for n in names):
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] in names:
                    return self.pop(i)
                if self.stack[i][0] in stops:
                    return None
        return None

    def start(self, name: str, words: list[str]) -> None:
        if name == "br":
            self.text(" ") if self.pieces else None
            return
        if name in BLOCK:
            self.end_block()
            self.end_nearest({"p"}, {"button", "table", "td", "th", "caption"})
            if name in ENDS:
                self.end_nearest(*ENDS[name])
        if name in VOID:
            return
        if name == "a" and self.open.get("a"):
            self.end("a")
        up = self.stack[-1][1] if self.stack else 0
        tokens = (name, *("." + w for w in words))
        self.stack.append((name, self.child(up, tokens), tokens))
        self.open[name] = self.open.get(name, 0) + 1

    def end(self, name: str) -> None:
        if name == "br":
            return self.start("br", [])
        if name in BLOCK:
            self.end_block()
        if not self.open.get(name):
            return None
        if name in BLOCK:
            stops = set() if name in ("table", "body", "html") else {"table"} if name in ("td", "th", "tr", "tbody", "thead", "tfoot") else {"td", "th", "table"}
            return self.end_nearest({name}, stops)
        for i in range(len(self.stack) - 1, -1, -1):  # an inline element ends without those opened in it
            if self.stack[i][0] == name:
                self.open[name] -= 1
                del self.stack[i]
                break
        return None


def blocks_of(html: str) -> Blocks:
    """The leaf blocks of a page in order."""
    r, at, size, no_more = _Reader(), 0, len(html), {}
    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            r.text(html[at:])
            break
        if lt > at:
            r.text(html[at:lt])
        c = html[lt + 1 : lt + 2]
        if c.isascii() and c.isalpha():
            name, words, end = _start_tag(html, lt + 1, no_more)
            if end < 0:  # cut off within a tag
                break
            at = end
            if name in RAW:
                m = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.IGNORECASE).search(html, at)
                if m is None:
                    break
                at = m.start()
                close = html.find(">", at)
                at = close + 1 if close >= 0 else size
            else:
                r.start(name, words)
        elif c == "/" and html[lt + 2 : lt + 3].isascii() and html[lt + 2 : lt + 3].isalpha():
            m = _NAME.match(html, lt + 2)
            close = html.find(">", m.end())
            r.end(m.group().lower())
            at = close + 1 if close >= 0 else size
        elif html.startswith("<!--", lt):
            close = html.find("-->", lt + 2)  # "<!-->" is a comment too
            at = close + 3 if close >= 0 else size
        elif c in ("!", "?", "/"):
            close = html.find(">", lt + 1)
            at = close + 1 if close >= 0 else size
        else:  # a sign, not a tag
            r.text("<")
            at = lt + 1
    r.end_block()
    return r.out
