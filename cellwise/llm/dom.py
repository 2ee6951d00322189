"""A forgiving HTML parser into flat arrays: elements and text blocks, each after its parent, in page order."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

#: Fixed values of HTML: elements without content, with raw text, never shown, inside lines of text, and implied ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("script style head title template noscript svg iframe object noembed noframes math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {
    "li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")),
    "th": ("td th", ("tr", "table")), "option": ("option", ("select",)), "optgroup": ("option optgroup", ("select",)), "tbody": ("tr td th thead tbody", ("table",)), "tfoot": ("tr td th tbody", ("table",)),
}

_MARKUP = re.compile(r"<!--(?:(?!>|->).*?(?:-->|--!>|\Z)|-?>)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_OPENS = re.compile(r"<(?:[!?]|/?[a-zA-Z])")
_NAME_ENDS, _STOPS = re.compile(r"[\s/>]|\Z"), re.compile(r"[>\"']|\Z")
_ATTRIBUTE = re.compile(r"(?<![^\s=/\"'<>])([^\s=/\"'<>]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")


class _Tags:
    """Markup of a text from left to right. What once failed to be a tag is remembered, so nothing is read over and over."""

    def __init__(self, html: str) -> None:
        self.html, self.failed, self.kept = html, set(), {}
        self.last = {c: html.rfind(c) for c in "<>\"'"}

    def _next(self, what: re.Pattern, at: int) -> int:
        """Where `what` is found from `at` on; positions only grow while the answer stays the same."""
        begin, found = self.kept.get(what, (0, -1))
        if not begin <= at <= found:
            found = what.search(self.html, at).start()
            self.kept[what] = at, found
        return found

    def _end(self, at: int) -> int:
        """Behind the > that ends the tag whose attributes begin at `at`; -1 for none."""
        seen = []
        while at <= self.last[">"]:
            stop = self._next(_STOPS, at)
            if stop >= len(self.html) or stop in self.failed:
                break
            if (c := self.html[stop]) == ">":
                return stop + 1
            seen.append(stop)
            if stop >= self.last[c]:
                break
            at = self.html.index(c, stop + 1) + 1
        self.failed.update(seen)
        return -1

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """The next markup from `at` on: begin, end, whether it is an end tag, tag (empty for comments and the like), attributes."""
        while at <= self.last["<"] and (m := _OPENS.search(self.html, at)):
            begin = m.start()
            if m[0][1] in "!?":
                return begin, _MARKUP.match(self.html, begin).end(), False, "", ""
            named = m.end() - 1
            name_end = self._next(_NAME_ENDS, named)
            end = self._end(name_end)
            if end < 0 and (quote := self._next(_STOPS, named)) < name_end:  # a quote in the name may open a value
                name_end, end = quote, self._end(quote)
            if end > 0:
                return begin, end, m[0][1] == "/", self.html[named:name_end], self.html[name_end : end - 1]
            at = m.end()
        return None


@dataclass
class Dom:
    """Parallel lists; `tag` is "" for a text block. `names`: class, id and role of an element. `text`, `linked`: a block's text and its characters in links."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)

    def add(self, parent: int, tag: str, names: str = "", text: str = "", linked: int = 0) -> int:
        self.parent.append(parent), self.tag.append(tag), self.names.append(names), self.text.append(text), self.linked.append(linked)
        return len(self.tag) - 1


def parse(html: str) -> Dom:
    """The tree under node 0. Character references are decoded, white space in a block becomes one space, blocks without text are left out."""
    dom = Dom()
    dom.add(-1, "html")
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements with the block-level node that they are, or lie in
    opened = Counter()  # how often each tag is on the stack, above its root
    links = unseen = 0
    run: list[str] = []
    in_link: list[str] = []

    def flush() -> None:
        if run:
            text = " ".join("".join(run).split())
            if text:
                dom.add(stack[-1][1], "", "", text, min(len(text), len(" ".join("".join(in_link).split()))))
            run.clear(), in_link.clear()

    def say(text: str) -> None:
        if text and not unseen:
            text = unescape(text)
            run.append(text)
            if links:
                in_link.append(text)

    def put(tag: str, node: int) -> None:
        stack.append((tag, node))
        opened[tag] += 1

    def close(count: int) -> None:
        nonlocal links, unseen
        for _ in range(count):
            tag = stack[-1][0]
            if tag not in INLINE and tag not in UNSEEN:
                flush()
            links -= tag == "a"
            unseen -= tag in UNSEEN
            opened[tag] -= 1
            stack.pop()

    def innermost(tag: str, inline_only: bool) -> int:
        """How many elements end with the innermost open `tag`; 0 if there is none (or a block-level one lies between)."""
        if opened[tag]:
            for k in range(1, len(stack)):
                if stack[-k][0] == tag:
                    return k
                if inline_only and stack[-k][0] not in INLINE:
                    break
        return 0

    def depth_of(tags: str, within: tuple[str, ...]) -> int:
        wanted = tags.split()
        found, left = 0, sum(opened[t] for t in wanted)
        for k in range(1, len(stack)):
            if not left:
                break
            tag = stack[-k][0]
            if tag in wanted:
                found = k
                left -= 1
            elif tag in within:
                break
        return found

    at, tags = 0, _Tags(html)
    while m := tags.next(at):
        begin, end, ends, tag, attributes = m
        say(html[at:begin])
        at, tag = end, tag.lower()
        if not tag:
            continue
        if ends:
            if tag == "br":
                run.append(" ") if not unseen else None
            elif n := innermost(tag, tag in INLINE):
                close(n)
            continue
        if tag in INLINE:
            if tag in VOID:
                run.append(" ") if tag == "br" and not unseen else None
                continue
            if tag == "a" and links and (n := innermost("a", True)):
                close(n)
            put(tag, stack[-1][1])
            links += tag == "a"
            continue
        if tag in RAW:
            at = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|\Z", re.I).search(html, at).end()
            continue
        if tag in UNSEEN:
            if not attributes.endswith("/"):
                put(tag, stack[-1][1])
                unseen += 1
            continue
        if tag in ("html", "body"):
            if tag == "body" and unseen and (n := depth_of("head", ())):
                close(n)
            if tag == "html" or opened["body"]:
                continue
        # A block-level element ends an open paragraph and what it implies.
        p = next((k for k in range(1, len(stack)) if stack[-k][0] == "p" or stack[-k][0] not in INLINE), 0)
        if p and stack[-p][0] == "p":
            close(p)
        if tag in CLOSES and (n := depth_of(*CLOSES[tag])):
            close(n)
        flush()
        names = " ".join(v for n, *values in _ATTRIBUTE.findall(attributes) if n.lower() in ("class", "id", "role") for v in values if v).lower() if attributes else ""
        node = stack[-1][1] if unseen else dom.add(stack[-1][1], tag, names)
        if tag not in VOID:
            put(tag, node)
    say(html[at:])
    close(len(stack) - 1)
    flush()
    return dom
