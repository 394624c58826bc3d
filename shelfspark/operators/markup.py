"""Elements of stored HTML pages: a tokenizer's events as a table of nodes, and the fields of marked elements."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset(["script", "style"])


@dataclass(frozen=True)
class Rule:
    """An element by tag and by a pattern on its attributes; its whole text, or one attribute."""

    tag: str
    marker: str = ""
    attribute: str | None = None


def tag_text(tag: str, marker: str = "") -> Rule:
    """The text of the first such element, that of elements inside it included."""
    return Rule(tag, marker)


def tag_attr(tag: str, attribute: str, marker: str = "") -> Rule:
    return Rule(tag, marker, attribute)


@dataclass
class Node:
    tag: str
    raw: str  # the start tag as written
    attributes: dict[str, str | None]
    start: int
    texts: int  # pieces of text before it
    parent: Node | None
    end: int = -1  # behind its end tag, or where an element around it ends
    last_text: int = -1
    closed: bool = False


class Page(HTMLParser):
    """Nodes in document order. An end tag closes what is open inside its element; one without is ignored."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.html, self.nodes, self.texts = html, [], []
        self.open: list[Node] = []
        self.lines = [0, *(m.end() for m in re.finditer("\n", html))]
        self.feed(html)
        self.close()
        for node in self.open:
            node.end, node.last_text = len(html), len(self.texts)
        self.starts = [n.start for n in self.nodes]

    def _at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_starttag(self, tag, attrs):
        raw = self.get_starttag_text()
        first = dict(reversed(attrs))  # of equal names the first counts
        node = Node(tag, raw, first, self._at(), len(self.texts), self.open[-1] if self.open else None)
        self.nodes.append(node)
        if tag in VOID:
            node.end, node.last_text, node.closed = node.start + len(raw), len(self.texts), True
        else:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            node = self.open.pop()
            node.end, node.last_text, node.closed = node.start + len(node.raw), len(self.texts), True

    def handle_endtag(self, tag):
        if not any(n.tag == tag for n in self.open):
            return
        at = self._at()
        while self.open:
            node = self.open.pop()
            node.last_text, node.end = len(self.texts), at
            if node.tag == tag:
                end = self.html.find(">", at)
                node.end, node.closed = (len(self.html) if end < 0 else end + 1), True
                return

    def handle_data(self, data):
        if not (self.open and self.open[-1].tag in SILENT):
            self.texts.append(data)

    def between(self, start: int, end: int) -> list[Node]:
        """The nodes that start from ``start`` on and before ``end``."""
        return self.nodes[bisect_right(self.starts, start - 1):bisect_right(self.starts, end - 1)]

    def value(self, node: Node, rule: Rule, last_text: int) -> str:
        if rule.attribute is not None:
            return (node.attributes.get(rule.attribute) or "").strip()
        return "".join(self.texts[node.texts:min(node.last_text, last_text)]).strip()

    def hits(self, rule: Rule, nodes: list[Node], last_text: int) -> list[str]:
        """The values of the rule's elements, in order; the attribute is asked for if the rule names one."""
        return [self.value(n, rule, last_text) for n in nodes if re.fullmatch(rule.tag, n.tag)
                and (not rule.marker or re.search(rule.marker, n.raw))
                and (rule.attribute is None or rule.attribute in n.attributes)]

    def first(self, rules: list, nodes: list[Node], html: str, last_text: int) -> str | None:
        """The first value that is not blank: of the first element of each rule, or of a pattern on the source."""
        for rule in rules:
            if isinstance(rule, Rule):
                value = next(iter(self.hits(rule, nodes, last_text)), "")
            else:
                found = re.search(rule, html)
                value = found.group(1).strip() if found else ""
            if value:
                return value
        return None


def cards(html: str, rules) -> list[dict]:
    """The raw fields of each card of a page: an element that ``rules.card`` marks, up to the next card if
    one starts inside. ``rules.around``: the link and the image may also stand around or behind the card."""
    page = Page(html)
    marked = [n for n in page.nodes if re.match(rules.card, n.raw)]
    out = []
    for card, following in zip(marked, [*marked[1:], None]):
        limit = following.start if following else len(html)
        end = min(card.end, limit)
        last_text = min(card.last_text, following.texts if following else len(page.texts))
        source, nodes = html[card.start:end], page.between(card.start, end)

        def first(wanted, among=nodes, text=source, last=last_text):
            return page.first(wanted, among, text, last)
        link, image = first(rules.link), first(rules.image)
        if rules.around:
            ahead, node = [], card.parent
            while node is not None:
                ahead.append(node)
                node = node.parent
            later = page.between(end, limit)
            behind = [n for n in later if n.closed and n.end <= limit]
            link = first(rules.link, ahead) or link or first(rules.link, behind)
            image = image or first(rules.image, later)
        whole, cents = ([next(iter(page.hits(r, nodes, last_text)), None) for r in rules.price_parts]
                        if rules.price_parts else (None, None))
        out.append({
            "card": source, "title": first(rules.title), "link": link, "image": image,
            "card_id": first(rules.card_id), "quantity": first(rules.quantity), "whole": whole, "cents": cents,
            "prices": [v for r in rules.price for v in page.hits(r, nodes, last_text)]})
    return out
