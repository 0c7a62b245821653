"""Page structure: links with their text and surroundings, title, description and navigation.

``Tree`` holds the rules of nesting. It is fed in two ways that agree on every page: by a structural index, one
vectorised pass over the bytes of a batch that finds where tags begin and end and which of them are bare names, so
that Python sees tags only and text is decoded where it is wanted; and by the standard library's parser, which takes
the pages that hold anything but plain markup (``Odd``), for which the index makes no claim.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import numpy as np

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_CLOSES = {"li": {"li"}, "p": {"p"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_BLOCKS = {"address", "article", "aside", "blockquote", "div", "dl", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "pre", "section", "table", "ul"}
_ENDS = _CLOSES | {tag: {"p"} for tag in _BLOCKS if tag not in _CLOSES}
#: Void elements that end nothing and say nothing.
_NOTHING = _VOID - _BLOCKS - {"meta"}
_RAW = ("script", "style")
#: Elements that matter even with nothing but text inside.
_SPOKEN = {"a", "title", "nav", *_RAW, *_VOID}

#: Elements that may stand inside each other; deeper pages are given up, as a parser with a bounded stack does.
NESTING = 512


class TooDeep(ValueError):
    """Elements are nested deeper than NESTING."""


class Tree:
    """What a page's tags say. A mark is the number of stretches of text before a tag; ``text`` gives those between two."""

    def __init__(self) -> None:
        self.open: list[tuple[str, int, dict | None, list[dict]]] = [("", 0, None, [])]  # tag, mark, link, links right inside
        self.names: dict[str, int] = {}  # how often each is open
        self.links: list[dict] = []
        self.title: str | None = None
        self.description: str | None = None
        self.nav = False

    def text(self, first: int, last: int) -> str:
        raise NotImplementedError

    def start(self, tag: str, given: dict[str, str | None], mark: int) -> None:
        closed = _ENDS.get(tag)
        while closed and self.open[-1][0] in closed:
            self._pop(mark)
        if tag == "a" and self.names.get("a"):
            self.end("a", mark)
        link = None
        if tag == "a" and "href" in given:
            link = {"href": given["href"] or "", "text": "", "context": ""}
            self.links.append(link)
            self.open[-1][3].append(link)
        elif tag == "meta" and self.description is None and given.get("name") == "description":
            self.description = given.get("content") or ""
        elif tag == "nav":
            self.nav = True
        if tag not in _VOID:
            if len(self.open) > NESTING:
                raise TooDeep("elements nested too deep")
            self.open.append((tag, mark, link, []))
            self.names[tag] = self.names.get(tag, 0) + 1

    def end(self, tag: str, mark: int) -> None:
        if self.names.get(tag):
            while self.open[-1][0] != tag:
                self._pop(mark)
            self._pop(mark)

    def done(self, mark: int) -> None:
        while self.open:
            self._pop(mark)

    def _pop(self, mark: int) -> None:
        tag, first, link, inside = self.open.pop()
        if tag:
            self.names[tag] -= 1
        if link is None and not inside and tag != "title":
            return
        text = self.text(first, mark)
        if tag == "title" and self.title is None:
            self.title = text
        if link is not None:
            link["text"] = text
        if inside:
            raw = text.encode()
            context = (raw[:200].decode(errors="replace") + "..." if len(raw) > 200 else text).strip()
            for x in inside:
                x["context"] = context


class _Feed(HTMLParser):
    def __init__(self, page: Parsed) -> None:
        super().__init__(convert_charrefs=True)
        self.page = page

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.page.start(tag, dict(reversed(attrs)), len(self.page.texts))

    def handle_endtag(self, tag: str) -> None:
        self.page.end(tag, len(self.page.texts))

    def handle_data(self, data: str) -> None:
        self.page.texts.append(data)


class Parsed(Tree):
    """A page as the standard library's parser reads it."""

    def __init__(self, html: str) -> None:
        super().__init__()
        self.texts: list[str] = []
        feed = _Feed(self)
        feed.feed(html)
        feed.close()
        self.done(len(self.texts))

    def text(self, first: int, last: int) -> str:
        return "".join(self.texts[first:last])


class Odd(Exception):
    """The page holds something that the index leaves to the parser."""


_ATTRIBUTE = rb"""[ \t\n\r\f]+([a-zA-Z][a-zA-Z0-9:_-]*)(?:="([^"<>\x00]*)"|='([^'<>\x00]*)'|=([^ \t\n\r\f"'=<>`/\x00\x0b\x1c-\x1f\x80-\xff]+)(?=[ \t\n\r\f>])|(?=[ \t\n\r\f/>]))"""
_ATTRIBUTES = re.compile(_ATTRIBUTE)
_TAG = re.compile(rb"<([a-zA-Z][a-zA-Z0-9]*)((?:" + re.sub(rb"\((?!\?)", b"(?:", _ATTRIBUTE) + rb")*)[ \t\n\r\f]*(/?)>")
_END_RAW = {tag: re.compile(rb"(?i)</\s*" + tag.encode()) for tag in _RAW}
_BARE, _BARE_END, _OTHER = 0, 1, 2
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_LETTER = _ALNUM.copy()
_LETTER[48:58] = False


class Index:
    """Where the tags of a batch of pages begin and end: arrays over all pages' ``<``."""

    def __init__(self, pages: list[bytes]) -> None:
        self.raw = b"\n".join(pages) + b"\n\n\n"
        data = np.frombuffer(self.raw, np.uint8)
        sizes = np.array([len(p) + 1 for p in pages])
        self.first = np.cumsum(sizes) - sizes
        self.last = self.first + sizes - 1
        begin, end = np.flatnonzero(data == 60), np.flatnonzero(data == 62)
        after = np.searchsorted(end, begin)
        stop = np.append(end, len(data))[after]
        closing = data[begin + 1] == 47
        name = begin + 1 + closing
        # A bare tag is a name between its brackets: the next byte that is no letter or digit is its end.
        strange = np.flatnonzero(~_ALNUM[data])
        bare = (strange[np.searchsorted(strange, name)] == stop) & _LETTER[data[np.minimum(name, len(data) - 1)]]
        self.kind = [*np.where(bare, np.where(closing, _BARE_END, _BARE), _OTHER).tolist(), _OTHER]
        self.begin, self.stop = begin.tolist(), stop.tolist()
        self.bounds = np.searchsorted(begin, np.append(self.first, len(data))).tolist()
        self.names: dict[bytes, str] = {}
        nul = np.flatnonzero(data == 0)
        self.odd = np.diff(np.searchsorted(nul, np.append(self.first, len(data)))) > 0

    def page(self, n: int) -> Indexed:
        """The page of this number, or Odd."""
        if self.odd[n]:
            raise Odd
        return Indexed(self, n)


class Indexed(Tree):
    """A page of plain markup, read by an index. Text is decoded when it is asked for."""

    def __init__(self, index: Index, n: int) -> None:
        super().__init__()
        raw, begin, stop, kind = index.raw, index.begin, index.stop, index.kind
        self.raw, self.stretches, self.verbatim = raw, [], set()
        pos, last, bound = int(index.first[n]), int(index.last[n]), index.bounds[n + 1]
        stretches, start, end, pop, known = self.stretches, self.start, self.end, self._pop, index.names
        above = self.open
        i = index.bounds[n] - 1
        while (i := i + 1) < bound:
            a, b = begin[i], stop[i]
            if a < pos:  # inside a comment or a script
                continue
            if b >= last:
                raise Odd
            if a > pos:
                stretches.append((pos, a))
            pos = b + 1
            if kind[i] == _BARE_END:
                key = raw[a + 2 : b]
                end(known.get(key) or known.setdefault(key, key.decode().lower()), len(stretches))
                continue
            if kind[i] == _BARE:
                key = raw[a + 1 : b]
                tag, given = known.get(key) or known.setdefault(key, key.decode().lower()), {}
                if tag in _NOTHING:
                    continue
                if kind[i + 1] == _BARE_END and tag not in _SPOKEN and raw[begin[i + 1] + 2 : stop[i + 1]] == key and stop[i + 1] < last:
                    # Nothing inside but text: the element only ends what it ends.
                    closed = _ENDS.get(tag)
                    while closed and above[-1][0] in closed:
                        pop(len(stretches))
                    if len(above) > NESTING:
                        raise TooDeep("elements nested too deep")
                    i += 1
                    if begin[i] > pos:
                        stretches.append((pos, begin[i]))
                    pos = stop[i] + 1
                    continue
            elif raw.startswith(b"<!--", a):
                close = raw.find(b"-->", a + 4, last)
                if close < 0 or raw.find(b"--", a + 4, close + 2) != close or raw[a + 4 : a + 6] in (b"->", b"--") or raw[a + 4 : a + 5] == b">":
                    raise Odd
                pos = close + 3
                continue
            elif raw[a + 1 : a + 9].lower() == b"!doctype":
                if i + 1 < bound and begin[i + 1] < b:
                    raise Odd
                continue
            else:
                found = _TAG.match(raw, a, b + 1)
                if not found:
                    raise Odd
                tag = found[1].decode().lower()
                given = {}
                for m in _ATTRIBUTES.finditer(raw, found.start(2), b + 1):
                    value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4]
                    value = None if value is None else unescape(value.decode()) if b"&" in value else value.decode()
                    given.setdefault(m[1].decode().lower(), value)
                if found[3]:
                    if tag in _RAW:
                        raise Odd
                    start(tag, given, len(stretches))
                    end(tag, len(stretches))
                    continue
            start(tag, given, len(stretches))
            if tag in _RAW:
                close = _END_RAW[tag].search(raw, pos, last)
                if not close or raw[close.start() : close.start() + len(tag) + 3].lower() != b"</" + tag.encode() + b">":
                    raise Odd
                if close.start() > pos:
                    self.verbatim.add(len(stretches))
                    stretches.append((pos, close.start()))
                pos = close.start()
        if pos < last:
            stretches.append((pos, last))
        self.done(len(stretches))

    def text(self, first: int, last: int) -> str:
        parts = []
        for k in range(first, last):
            a, b = self.stretches[k]
            raw = self.raw[a:b]
            parts.append(unescape(raw.decode()) if b"&" in raw and k not in self.verbatim else raw.decode())
        return "".join(parts)


def parsed(pages: list[bytes]) -> Iterator[tuple[Tree | None, Exception | None]]:
    """Each page's tree, or what kept it from being parsed."""
    index = Index(pages)
    for n, html in enumerate(pages):
        try:
            try:
                yield index.page(n), None
            except Odd:
                yield Parsed(html.decode()), None
        except Exception as fault:  # noqa: BLE001  a page that breaks the parser is a row of its own, not a failed task
            yield None, fault
