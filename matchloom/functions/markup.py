"""Elements of captured pages: one pass over the characters, an element tree, simple selectors.

A selector is a list of compounds (``tag``, ``.class``, ``tag.class``) separated by blanks, each
one a descendant of the one before. Tags are read as browsers do: quotes count only where a
value begins, values may stand without them, elements whose end tag may be left out end by
themselves, and an end tag does not reach beyond the block or table cell it stands in. Character references
are replaced. A page of any length is read whole, in time that grows with its length.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
ATTRIBUTE = re.compile(
    r"""[\s/]*+(?:([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+)?+""")
# Fixed values of the markup language: elements without content, elements whose content is text, blocks that end
# an open paragraph, blocks that a list item's search for its predecessor stops at, and table parts.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
DROPPED = frozenset("script style".split())
RAW = frozenset("textarea title".split())
BLOCKS = frozenset(
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre search section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPES = frozenset("caption html object table td template th".split())
SPECIAL = BLOCKS | SCOPES | frozenset(
    "body button center dd dt head iframe li noscript optgroup option select summary tbody tfoot thead tr".split())
TABLE = frozenset("table template".split())
#: Start tags that end open elements: what they end, and what the search for it stops at.
ENDS = {
    "li": (frozenset({"li"}), SPECIAL - frozenset("address div p".split())),
    "dd": (frozenset({"dd", "dt"}), SPECIAL - frozenset("address div p".split())),
    "dt": (frozenset({"dd", "dt"}), SPECIAL - frozenset("address div p".split())),
    "option": (frozenset({"option"}), SPECIAL),
    "optgroup": (frozenset({"optgroup"}), frozenset("select datalist".split()) | SCOPES),
    "td": (frozenset({"td", "th"}), TABLE | {"tr"}),
    "th": (frozenset({"td", "th"}), TABLE | {"tr"}),
    "tr": (frozenset({"tr"}), TABLE),
    "tbody": (frozenset("tbody thead tfoot".split()), TABLE),
    "thead": (frozenset("tbody thead tfoot".split()), TABLE),
    "tfoot": (frozenset("tbody thead tfoot".split()), TABLE),
    "a": (frozenset({"a"}), SPECIAL),
}
PARAGRAPH = (frozenset({"p"}), SCOPES | {"button"})
DEPTH = 512  # deeper elements become siblings, as in browsers


@dataclass(slots=True, eq=False)
class Element:
    """``first`` and ``last`` delimit its texts, ``index`` and ``end`` it and what is below it."""

    tag: str
    attributes: dict[str, str]
    parent: Element | None
    first: int
    index: int
    last: int = -1
    end: int = -1
    classes: frozenset[str] = field(default_factory=frozenset)


def _attributes(source: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes from a place on, and where the tag ends; of repeated ones the first counts."""
    values: dict[str, str] = {}
    while True:
        found = ATTRIBUTE.match(source, at)
        at = found.end()
        if found[1] is None:
            return values, at + 1  # at the closing bracket, or the end of the page
        values.setdefault(found[1].lower(), html.unescape(found[2] or found[3] or found[4] or ""))


def marks(source: str) -> Iterator[tuple[int, int, str, bool, dict[str, str]]]:
    """Start and end tags as ``(from, to, tag, closing, attributes)``; comments and the like have tag ''."""
    at = 0
    while (at := source.find("<", at)) >= 0:
        name = NAME.match(source, at)
        if name:
            values, upto = _attributes(source, name.end())
            tag, closing = name[1].lower(), source[at + 1] == "/"
            if tag in DROPPED and not closing:
                upto = _past(source, tag, upto, True)
                tag = ""
            yield at, min(upto, len(source)), tag, closing, values
            at = upto if tag not in RAW or closing else _past(source, tag, upto, False)
        elif source.startswith("<!--", at):
            end = source.find("-->", at + 4)
            upto = len(source) if end < 0 else end + 3
            yield at, upto, "", False, {}
            at = upto
        elif source.startswith(("<!", "<?", "</"), at):
            end = source.find(">", at)
            upto = len(source) if end < 0 else end + 1
            yield at, upto, "", False, {}
            at = upto
        else:  # a mere character
            at += 1


def _past(source: str, tag: str, at: int, end_tag: bool) -> int:
    """Where the text content of ``tag`` ends, after or before its end tag."""
    found = re.compile(rf"</{tag}(?![^\s/>])[^>]*+>?", re.IGNORECASE).search(source, at)
    return len(source) if found is None else found.end() if end_tag else found.start()


class Page:
    """Elements in document order, and the texts between tags.

    One departure from browsers, where an article without end tag holds all that follow: it ends
    where the next article starts, so that a list of unclosed cards is a list.
    """

    def __init__(self, source: str | None):
        self.elements: list[Element] = []
        self.texts: list[str] = []
        self._open: list[Element] = []
        self._held: Counter[str] = Counter()  # open elements by tag
        source = source or ""
        found = list(marks(source))
        unclosed: set[int] = set()
        waiting: list[int] = []
        for i, (_, _, tag, closing, _) in enumerate(found):
            if tag == "article":
                if not closing:
                    waiting.append(i)
                elif waiting:
                    waiting.pop()
        unclosed.update(waiting)
        loose: set[int] = set()  # indexes of elements that the next article ends
        at = 0
        for i, (start, upto, tag, closing, values) in enumerate(found):
            self.texts.append(source[at:start])
            at = upto
            if not tag:
                continue
            if closing:
                self._end(tag)
                continue
            if tag == "article" and self._held[tag]:
                k = max(k for k, e in enumerate(self._open) if e.tag == tag)
                if self._open[k].index in loose:
                    self._close(k)
            self._make_room(tag)
            element = Element(tag, values, self._open[-1] if self._open else None, len(self.texts), len(self.elements),
                              classes=frozenset(values.get("class", "").split()))
            self.elements.append(element)
            if i in unclosed:
                loose.add(element.index)
            if tag in VOID:
                element.last, element.end = element.first, len(self.elements)
            else:
                self._open.append(element)
                self._held[tag] += 1
        self.texts.append(source[at:])
        self._close(0)

    def _close(self, k: int) -> None:
        """End the open elements from the k-th on."""
        for element in self._open[k:]:
            element.last, element.end = len(self.texts), len(self.elements)
            self._held[element.tag] -= 1
        del self._open[k:]

    def _find(self, tags: frozenset[str], stop: frozenset[str]) -> int | None:
        """The innermost open element with one of the tags, unless one to stop at is further in."""
        if any(self._held[t] for t in tags):
            for k in range(len(self._open) - 1, -1, -1):
                if self._open[k].tag in tags:
                    return k
                if self._open[k].tag in stop:
                    return None
        return None

    def _end(self, tag: str) -> None:
        """An end tag; without an open element in reach it is ignored, open ones inside end with it."""
        k = self._find(frozenset({tag}), SCOPES if tag in SPECIAL and tag not in SCOPES else TABLE if tag in SCOPES else SPECIAL)
        if k is not None:
            self._close(k)

    def _make_room(self, tag: str) -> None:
        """End what a start tag ends."""
        if tag in BLOCKS and (k := self._find(*PARAGRAPH)) is not None:
            self._close(k)
        if tag in HEADINGS and self._open and self._open[-1].tag in HEADINGS:
            self._close(len(self._open) - 1)
        if tag == "optgroup" and (k := self._find(*ENDS["option"])) is not None:
            self._close(k)
        if tag in ENDS and (k := self._find(*ENDS[tag])) is not None:
            self._close(k)
        if len(self._open) >= DEPTH:
            self._close(DEPTH - 1)

    def text(self, element: Element) -> str:
        return html.unescape("".join(self.texts[element.first:element.last])).strip()

    def matches(self, selector: Selector, within: Element | None = None) -> Iterator[Element]:
        """Matching elements in document order, of the page or below one element."""
        first, upto = (0, len(self.elements)) if within is None else (within.index + 1, within.end)
        return (e for e in (self.elements[i] for i in range(first, upto)) if selector.matches(e))

    def select(self, selector: Selector, within: Element | None = None) -> list[Element]:
        return list(self.matches(selector, within))

    def first(self, selector: Selector, within: Element | None = None) -> Element | None:
        return next(self.matches(selector, within), None)

    def first_text(self, selector: Selector, within: Element | None = None) -> str | None:
        found = self.first(selector, within)
        return self.text(found) if found else None

    def all_texts(self, selector: Selector, within: Element | None = None) -> list[str]:
        return [self.text(e) for e in self.matches(selector, within)]


class Selector:
    """A parsed selector."""

    def __init__(self, source: str):
        self.steps = []
        for part in source.split():
            tag, *classes = part.split(".")
            self.steps.append((tag.lower() if tag not in ("", "*") else None, frozenset(classes)))
        if not self.steps:
            raise ValueError("an empty selector matches nothing")

    def matches(self, element: Element) -> bool:
        *above, last = self.steps
        if not _fits(element, last):
            return False
        for step in reversed(above):
            element = element.parent
            while element is not None and not _fits(element, step):
                element = element.parent
            if element is None:
                return False
        return True


def _fits(element: Element, step: tuple[str | None, frozenset[str]]) -> bool:
    tag, classes = step
    return (tag is None or tag == element.tag) and classes <= element.classes
