"""HTML extraction with wrappers: union-free regular expressions inferred for each host.

A page is cut into tokens: tags of containers (with their class and id words), blocks of text as slots. Menus, bold
text and the like inside a block are part of the slot. A wrapper is a row of tags and slots, optional groups ``(..)?``
and repeated groups ``(..)+``, without unions. It is inferred by aligning token rows: what two rows share stays, a mismatch
becomes an optional group, and equal neighbours fold into a repeated group. Pages first become distinct token rows
of their host (partial counts before the shuffle); rows are then merged in buckets of about BUCKET, and bucket
wrappers again, until a host has one. So a host with a third of all pages is no single task's work.

Each distinct token row is then parsed with its host's wrapper, so each of its texts has a slot: a place in the wrapper, in
or outside its optional and repeated groups, and the containers there. The slots are judged with what all pages of the host
put there, pages with equal texts counted once:

* A text that stands in a slot on (nearly) all of its pages, PAGES or more, is boilerplate, whatever it is called.
* A slot in a repeated group of the wrapper, or with several in one text, whose texts begin with an author and a date is
  one of reader comments, if content stands before it.
* Of the slots that vary: where a token row has an article (or main) element, those inside are content; else the container
  that holds most text outside links, with its ancestors below body while they add enough to it, and all texts elsewhere
  that are not mostly links. Token rows are judged one by one, so templates of a host don't exclude one another.
* Slots inside menus, headers and footers of the page, sidebars, notices, adverts, forms and the like are no content; but
  class words don't count on a container around the article, or around most of the text of a row that has nothing else.

Where nothing would be left, sameness does not count: the pages of the host may be copies. A page's main text is what it has
in the content slots of its token row: references decoded, white space of a block turned into one space, blocks joined by
a line break in page order.

Defined results: a null or empty html gives an empty text; a null url is a host of its own (the empty one); a page that
is cut off is read as far as it goes; repeated rows give a row each; of containers with equally much text the one whose
place sorts last is the heaviest; a very long page is one token row, aligned in time in proportion to tokens times
tokens / 64; an empty table gives an empty table; only page_id, url and html are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections.abc import Collection, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelake.llm import shared

BUCKET = 256
#: Content slots of all token rows are broadcast up to so many bytes, and joined by host and row beyond.
BROADCAST_BYTES = 32 << 20

#: Pages without which sameness says nothing, and the share of them that have a text of boilerplate.
PAGES, SAME = 3, 0.9
#: The share of a slot's blocks that begin with an author and a date, if it is one of comments.
BYLINES = 0.25

#: An ancestor of the heaviest container that adds this share of its text is the article's container.
ADDS = 0.2

#: Elements whose content is never text.
SILENT = {"script", "style", "noscript", "template", "iframe", "svg", "object", "canvas", "head", "title", "select", "textarea", "button", "math", "audio", "video"}
#: Those of them whose content has no tags and goes on to their literal end tag, or to the page's end.
RAW = {"script", "style", "title", "textarea", "iframe"}
#: Elements around content that is not the article.
CHROME = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
#: Words of class and id that mark the same.
CHROME_WORDS = {"nav", "navbar", "navigation", "menu", "header", "masthead", "footer", "sidebar", "aside", "ad", "ads", "advert", "adverts", "advertisement", "banner", "promo", "sponsor", "sponsored", "cookie", "cookies", "consent", "notice", "alert", "popup", "modal", "newsletter", "subscribe", "share", "sharing", "social", "related", "recommended", "breadcrumb", "breadcrumbs", "pagination", "comment", "comments", "disqus", "replies", "widget", "toolbar", "skip"}
#: Those that mark a container inside an article only if its text is mostly links.
SOFT_WORDS = {"share", "related", "alert", "notice", "banner", "ad"}
#: Those that count even around an article, as what they hold are articles of others.
OTHERS_WORDS = {"comment", "comments", "disqus", "replies", "related", "recommended"}
#: First words of a class that says what a container has or lacks, not what it is.
MODIFIERS = {"no", "not", "has", "have", "with", "without", "hide"}
#: Elements that hold blocks.
CONTAINERS = {"html", "body", "main", "article", "section", "div", "nav", "header", "footer", "aside", "form", "menu", "dialog", "ul", "ol", "dl", "table", "thead", "tbody", "tfoot", "figure", "fieldset", "details", "center"}
#: Elements that begin and end a block of text.
BLOCKS = CONTAINERS | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "blockquote", "pre", "tr", "td", "th", "br", "hr", "figcaption", "caption", "legend", "address", "summary", "option", "label"}
#: Elements without an end tag.
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for name in RAW}
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", re.I)

#: Ways to write a date or an age, and words around an author's name.
_DATE = re.compile(r"\b\d{4}-\d{1,2}-\d{1,2}\b|\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b|\b\d{1,2}(?:st|nd|rd|th|\.)?\s+(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\b|\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+\d{1,2}\b|\b\d+\s+(?:minute|hour|day|week|month|year)s?\s+ago\b|\byesterday\b|\b(?:says|wrote|replied):?$", re.I)
_FILLER = {"by", "posted", "written", "on", "at", "from"}

TEXT = "#text"


def byline(text: str) -> bool:
    """Whether a block is an author's name with a date, or with a word for saying."""
    if text.count(" ") > 11:
        return False
    found = _DATE.search(text)
    names = re.findall(r"[^\W\d_][\w.'-]*", text[: found.start()]) if found else []
    return any(x.lower() not in _FILLER for x in names) and len(names) < 7


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def _label(name: str, attributes: str) -> str:
    """A container's name with the words of its class, id and role; digits don't tell containers apart."""
    words = set()
    for m in _NAMED.finditer(attributes):
        for item in (m[2] or m[3] or m[4] or "").lower().split():
            parts = _WORD.findall(item)
            words.update(["-".join(parts)] if len(parts) > 1 and parts[0] in MODIFIERS else parts)
    return ".".join([name, *sorted(words)])


def tags(source: str) -> list[tuple[int, int, str, bool, str, int]]:
    """(start, end, name, whether an end tag, attributes, next) of the tags and comments. For a silent element ``end`` is
    where its content ends and ``next`` the number of the tag after; one without an end tag has no content, but a
    select has its options."""
    found: list[tuple[int, int, str, bool, str, int]] = []
    opened: dict[str, list[int]] = {}
    at = 0
    while m := _TAG.search(source, at):
        at, name, closing = m.end(), (m[2] or "").lower(), bool(m[1])
        empty = name in SILENT and not closing and m[3].rstrip().endswith("/")
        if name in RAW and not closing and not empty:
            end = _RAW_END[name].search(source, at)
            at = end.end() if end else len(source)
        elif name in SILENT and closing and opened.get(name):
            i = opened[name].pop()
            found[i] = (found[i][0], at, *found[i][2:5], len(found) + 1)
        elif name in SILENT and not closing and not empty:
            opened.setdefault(name, []).append(len(found))
        found.append((m.start(), at, name, closing, m[3] or "", len(found) + 1))
    for i in opened.get("select", ()):
        n = i + 1
        while n < len(found) and found[n][2] in ("", "option", "optgroup", "hr"):
            n += 1
        found[i] = (found[i][0], found[n][0] if n < len(found) else len(source), *found[i][2:5], n)
    return found


class Page:
    """Tokens of a page, and its blocks: (path of containers, text, characters inside links), with the token each is in."""

    def __init__(self, source: str):
        self.tokens: list[str] = []
        self.blocks: list[tuple[str, str, int]] = []
        self.places: list[int] = []
        self.stack: list[str] = []
        self.parts: list[str] = []
        self.links = 0
        anchors = at = i = 0
        found = tags(source)
        while i < len(found):
            start, end, name, closing, attributes, i = found[i]
            if start > at:
                self._text(source[at:start], anchors > 0)
            at = end
            if name in SILENT:
                self._flush()
                continue
            if name == "a":
                anchors = max(0, anchors + (-1 if closing else 1))
            if name in BLOCKS:
                self._flush()
            if name in CONTAINERS:
                self._container(name, attributes, closing)
        if at < len(source):
            self._text(source[at:], anchors > 0)
        self._flush()

    def _text(self, raw: str, linked: bool) -> None:
        self.parts.append(raw)
        if linked:
            self.links += len(raw)

    def _flush(self) -> None:
        if self.parts:
            text = " ".join(entities.unescape("".join(self.parts)).split())
            if text:
                self.blocks.append((">".join(self.stack), text, min(self.links, len(text))))
                if not self.tokens or self.tokens[-1] != TEXT:
                    self.tokens.append(TEXT)
                self.places.append(len(self.tokens) - 1)
            self.parts, self.links = [], 0

    def _container(self, name: str, attributes: str, closing: bool) -> None:
        if not closing:
            self.stack.append(_label(name, attributes))
            self.tokens.append("<" + self.stack[-1])
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].split(".")[0] == name:
                for label in reversed(self.stack[i:]):
                    self.tokens.append(">" + label)
                del self.stack[i:]
                return


# A wrapper element is ["t", token], ["?", elements] or ["+", elements]. While wrappers are merged, elements are numbers.

GROUP = 32


class Elements:
    """Wrapper elements as numbers: equal elements have one number, so that rows are compared as rows of numbers."""

    def __init__(self):
        self.numbers: dict[tuple, int] = {}
        self.items: list[tuple] = []
        self.bare: list[int] = []
        self.opens: list[int] = []

    def number(self, kind: str, value) -> int:
        found = self.numbers.get((kind, value))
        if found is None:
            found = self.numbers[kind, value] = len(self.items)
            self.items.append((kind, value))
            self.bare.append(found)
            self.opens.append({"<": 1, ">": -1}.get(value[0], 0) if kind == "t" else 0)
            if kind in "?+":  # without its quantifier, for the alignment: x, (x)? and (x)+ match one another
                self.bare[found] = self.bare[value[0]] if len(value) == 1 else self.number("(", tuple(self.bare[x] for x in value))
        return found

    def load(self, row: list) -> list[int]:
        return [self.number(kind, value if kind == "t" else tuple(self.load(value))) for kind, value in row]

    def dump(self, row) -> list:
        return [[kind, value if kind == "t" else self.dump(value)] for kind, value in (self.items[x] for x in row)]

    def fold(self, row: list[int]) -> list[int]:
        """Equal neighbouring groups become one repeated group; the shortest groups first, until nothing changes."""
        before = None
        while before != row:
            before = row
            row = self._absorb(row)
            for size in range(1, GROUP + 1):
                folded = self._folded(row, size)
                row = self._absorb(folded) if len(folded) < len(row) else row
        return row

    def _folded(self, row: list[int], size: int) -> list[int]:
        if 2 * size > len(row):
            return row
        held = np.array(row)
        same = np.concatenate([[0], np.cumsum(held[size:] == held[:-size])])
        again = same[size:] - same[:-size] == size  # a group of this size stands here and again behind itself
        if not again.any():
            return row
        opens = np.concatenate([[0], np.cumsum([self.opens[x] for x in row])])
        again &= (opens[size:] - opens[:-size])[: len(again)] == 0
        out, i = [], 0
        for at in np.flatnonzero(again).tolist():
            if at < i:
                continue
            out += row[i:at]
            i = at + size
            while row[i : i + size] == row[at : at + size]:
                i += size
            alone = size == 1 and self.items[row[at]][0] == "+"
            out.append(row[at] if alone else self.number("+", tuple(row[at : at + size])))
        return out + row[i:]

    def _absorb(self, row: list[int]) -> list[int]:
        """A group beside its own repeated group is one turn of it."""
        out: list[int] = []
        turns = lambda x: self.items[x][1] if self.items[x][0] == "+" else ()
        for element in row:
            out.append(element)
            while len(out) > 1:
                group = turns(out[-1])
                if group and tuple(out[-1 - len(group) : -1]) == group:
                    del out[-1 - len(group) : -1]
                elif group and out[-2] == out[-1]:
                    out.pop()
                else:
                    n = next((n for n in range(1, min(GROUP, len(out) - 1) + 1) if turns(out[-1 - n]) and turns(out[-1 - n]) == tuple(out[-n:])), 0)
                    if not n:
                        break
                    del out[-n:]
        return out

    def _core(self, element: int) -> tuple[bool, bool, tuple[int, ...]]:
        """Whether an element is optional and repeated, and the elements that its quantifiers hold."""
        optional = repeated = False
        while self.items[element][0] != "t":
            kind, value = self.items[element]
            optional, repeated = optional or kind == "?", repeated or kind == "+"
            if len(value) > 1:
                return optional, repeated, value
            element = value[0]
        return optional, repeated, (element,)

    def _both(self, a: int, b: int) -> int:
        """What matches either of two elements that are alike but for quantifiers."""
        if a == b:
            return a
        (maybe, many, left), (maybe_b, many_b, right) = self._core(a), self._core(b)
        inner = tuple(self._both(x, y) for x, y in zip(left, right, strict=True))
        if many or many_b:
            inner = (self.number("+", inner),)
        if maybe or maybe_b:
            return self.number("?", inner)
        return inner[0] if len(inner) == 1 else self.number("+", inner)

    def merge(self, a: list[int], b: list[int]) -> list[int]:
        """The wrapper of two rows: shared elements stay, mismatches become optional groups, repeats are folded."""
        out: list[int] = []
        i = j = 0
        maybe = lambda row: [x if self.items[x][0] == "?" else self.number("?", (x,)) for x in row]
        for k, m in [*common([self.bare[x] for x in a], [self.bare[x] for x in b]), (len(a), len(b))]:
            out += maybe(a[i:k]) + maybe(b[j:m])
            if k < len(a):
                out.append(self._both(a[k], b[m]))
            i, j = k + 1, m + 1
        return self.fold(out)


#: Bits of the longest-common-subsequence table that are held at a time.
TABLE_BITS = 1 << 28


def common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places (in a, in b) of a longest common subsequence, by rows of bits: a zero bit is where the length grows. A table
    over TABLE_BITS is halved at the place where the halves' lengths add up to most."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    ends = [(len(a) - hi + i, len(b) - hi + i) for i in range(hi)]
    x, y = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if not x or not y:
        middle = []
    elif len(x) * len(y) > TABLE_BITS and len(y) > 1:
        half = len(y) // 2
        head, tail = _lengths(x, y[:half]), _lengths(x[::-1], y[half:][::-1])[::-1]
        cut = int(np.argmax(head + tail))
        middle = common(x[:cut], y[:half]) + [(i + cut, j + half) for i, j in common(x[cut:], y[half:])]
    else:
        rows, middle, k, m = [*_rows(x, y)], [], len(x), len(y)
        while k and m:
            if x[k - 1] == y[m - 1]:
                k, m = k - 1, m - 1
                middle.append((k, m))
            elif rows[m - 1] >> (k - 1) & 1:
                k -= 1
            else:
                m -= 1
        middle.reverse()
    return [(i, i) for i in range(lo)] + [(lo + i, lo + j) for i, j in middle] + ends


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """For each place of b the bits of a."""
    every, at = (1 << len(a)) - 1, {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    row = every
    for x in b:
        met = row & at.get(x, 0)
        row = (row + met | row - met) & every
        yield row


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of b with every beginning of a."""
    last = (1 << len(a)) - 1
    for last in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(last.to_bytes((len(a) + 7) // 8, "little"), np.uint8), bitorder="little", count=len(a))
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def fold(row: list) -> list:
    held = Elements()
    return held.dump(held.fold(held.load(row)))


def merge(a: list, b: list) -> list:
    held = Elements()
    return held.dump(held.merge(held.load(a), held.load(b)))


def row_of(tokens: list[str]) -> list:
    return fold([["t", t] for t in tokens])


def as_regex(wrapper: list) -> str:
    return " ".join(e[1] if e[0] == "t" else f"({as_regex(e[1])}){e[0]}" for e in wrapper)


def program(wrapper: list) -> list[tuple]:
    """A wrapper as steps: ("t", token, group), or ("|", step, step) that goes on at either step, the first one first.
    ``group`` is the first step of the innermost repeated group of containers around a token, or -1."""
    steps: list[tuple] = []

    def add(elements: list, group: int) -> None:
        for kind, value in elements:
            at = len(steps)
            if kind == "t":
                steps.append(("t", value, group))
                continue
            if kind == "?":
                steps.append(())
                add(value, group)
                steps[at] = ("|", at + 1, len(steps))
            else:
                add(value, at if any(x != ["t", TEXT] for x in value) else group)
                steps.append(("|", at, len(steps) + 1))

    add(wrapper, -1)
    return steps


def parse(steps: list[tuple], tokens: list[str]) -> list[int] | None:
    """The steps that a token row's texts match, or None if the wrapper does not match the row. All ways through the
    wrapper are followed side by side, each step once a token, so time is bounded by tokens times steps."""

    def reach(step: int, trail: tuple | None, ways: list, seen: set[int]) -> None:
        todo = [step]
        while todo:
            step = todo.pop()
            if step in seen:
                continue
            seen.add(step)
            if step < len(steps) and steps[step][0] == "|":
                todo += (steps[step][2], steps[step][1])
            else:
                ways.append((step, trail))

    ways: list = []
    reach(0, None, ways, set())
    for token in tokens:
        after: list = []
        seen: set[int] = set()
        for step, trail in ways:
            if step < len(steps) and steps[step][1] == token:
                reach(step + 1, (trail, step) if token == TEXT else trail, after, seen)
        ways = after
    for step, trail in ways:
        if step == len(steps):
            found = []
            while trail:
                trail, at = trail
                found.append(at)
            return found[::-1]
    return None


def containers(tokens: list[str]) -> dict[int, list[tuple[int, str]]]:
    """For each text of a token row the open containers around it: (place of the start tag, label)."""
    stack: list[tuple[int, str]] = []
    found = {}
    for i, token in enumerate(tokens):
        if token == TEXT:
            found[i] = list(stack)
        elif token[0] == "<":
            stack.append((i, token[1:]))
        else:
            stack.pop()
    return found


def content_slots(tokens: list[str], weights: dict[int, tuple[float, float]], same: Collection[int] = (), comments: Collection[int] = ()) -> list[int]:
    """The texts of a token row that hold the article; ``weights`` has the characters and the linked characters that the
    host's pages have in the slot of each text, ``same`` the texts in slots that do not vary, ``comments`` those in slots
    that look like reader comments."""
    found = _named(tokens, weights, {*same, *comments})
    first = min((at for at in found if at not in same and at not in comments), default=None)
    if first is None:
        found = _named(tokens, weights, set()) if same or comments else found
        return found
    return [at for at in found if at not in same and not (at in comments and at > first)]


def _named(tokens: list[str], weights: dict[int, tuple[float, float]], without: Collection[int]) -> list[int]:
    """Content by elements, class words and the weights of texts; those of ``without`` weigh nothing."""

    every = containers(tokens)
    plain = {at: 0 if at in without else max(0, weights[at][0] - 2 * weights[at][1]) for at in every}
    linked: dict[int, float] = {}  # characters in links beyond half of a container's text
    for at, chain in every.items():
        for place, _ in chain:
            linked[place] = linked.get(place, 0) + 2 * weights[at][1] - weights[at][0]

    def chrome(chain: list[tuple[int, str]], free: set[int]) -> tuple[int, bool] | None:
        """The outermost container that marks a text as chrome, and whether it does by its class words."""
        inside = False
        for place, label in chain:
            name, *words = label.split(".")
            if name in CHROME and not (name == "header" and inside):
                return place, False
            marks = CHROME_WORDS & set(words) if name not in ("html", "body", "article", "main") and place not in free else set()
            if inside:
                marks -= {"header"} if linked[place] >= 0 else {"header"} | SOFT_WORDS
            if marks:
                return place, True
            inside = inside or name in ("article", "main")
        return None

    def around(chain: list[tuple[int, str]], name: str) -> set[int] | None:
        """Containers around the first element of a name whose class words don't count; None if there is no such element."""
        names = [label.split(".")[0] for _, label in chain]
        if name not in names:
            return None
        return {place for place, label in chain[: names.index(name)] if not OTHERS_WORDS & set(label.split(".")[1:])}

    def clear(free: set[int]) -> dict[int, list[tuple[int, str]]]:
        return {at: chain for at, chain in every.items() if not chrome(chain, free)}

    chains = clear(set())
    for name in ("article", "main"):
        held_by = {at: free for at, chain in every.items() if (free := around(chain, name)) is not None}
        inside = [at for at in held_by if at in chains]
        if inside:
            return inside
        inside = [at for at, free in held_by.items() if not chrome(every[at], free)]
        if inside and sum(plain[at] for at in inside) >= sum(plain[at] for at in chains):
            return inside
    free: set[int] = set()
    names = ("article", "main")
    bound = any(t[1:].split(".")[0] in names for t in tokens)
    while not chains:
        marked: dict[int, float] = {}
        for at, chain in every.items():
            place, by_word = chrome(chain, free) or (0, False)
            if by_word and (not bound or any(label.split(".")[0] in names for _, label in chain)):
                marked[place] = marked.get(place, 0) + plain[at]
        most = max(marked, key=lambda place: (marked[place], place), default=None)
        if most is None or 2 * marked[most] <= sum(plain.values()):
            break
        free.add(most)
        chains = clear(free)
    if not chains:
        return []
    own: dict[tuple, float] = {}
    held: dict[tuple, float] = {}
    for at, chain in chains.items():
        own[tuple(chain)] = own.get(tuple(chain), 0) + plain[at]
        for n in range(len(chain) + 1):
            held[tuple(chain[:n])] = held.get(tuple(chain[:n]), 0) + plain[at]
    best = max(own, key=lambda chain: (own[chain], chain))
    for n in range(len(best) - 1, 0, -1):
        if best[n - 1][1].split(".")[0] in ("html", "body"):
            break
        if held[best[:n]] - held[best] >= ADDS * held[best]:
            best = best[:n]
    return [at for at, chain in chains.items() if tuple(chain[: len(best)]) == best or plain[at] > 0]


def _shape(tokens: list[str]) -> str:
    return hashlib.blake2b(" ".join(tokens).encode(), digest_size=16).hexdigest()


ROWS = "host string, shape string, row string, page long, weights array<struct<at:int,chars:long,links:long,blocks:int,bylines:int,text:long>>"


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def token_rows(pages: DataFrame) -> DataFrame:
    """Of every page: its token row and a digest of it, a digest of its texts, and for each text of the row the characters,
    blocks and bylines, and a digest."""

    def run(batches):
        for batch in batches:
            hosts, shapes, rows, digests, weights = [], [], [], [], []
            for url, source in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                page, held = Page(source or ""), {}
                for at, (_, text, linked) in zip(page.places, page.blocks, strict=True):
                    held.setdefault(at, []).append((text, linked))
                hosts.append(host_of(url))
                shapes.append(_shape(page.tokens))
                rows.append(" ".join(page.tokens))
                digests.append(_digest("\n".join(text for _, text, _ in page.blocks)))
                weights.append(
                    [
                        {"at": at, "chars": sum(len(t) for t, _ in x), "links": sum(n for _, n in x), "blocks": len(x), "bylines": sum(byline(t) for t, _ in x), "text": _digest("\n".join(t for t, _ in x))}
                        for at, x in held.items()
                    ]
                )
            kind = pa.list_(pa.struct([("at", pa.int32()), ("chars", pa.int64()), ("links", pa.int64()), ("blocks", pa.int32()), ("bylines", pa.int32()), ("text", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(shapes, pa.string()), pa.array(rows, pa.string()), pa.array(digests, pa.int64()), pa.array(weights, kind)], names=["host", "shape", "row", "page", "weights"])

    return pages.select("url", "html").transform(shared.arrow, run, ROWS)


def _merged(group: pd.DataFrame) -> pd.DataFrame:
    held, wrapper = Elements(), None
    for row in sorted(group["row"]):
        row = held.load(json.loads(row))
        wrapper = row if wrapper is None else held.merge(wrapper, row)
    return pd.DataFrame({"host": [group["host"].iloc[0]], "row": [json.dumps(held.dump(wrapper))]})


def _folded(batches):
    for batch in batches:
        rows = [json.dumps(row_of(row.split())) for row in batch.column("row").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(rows, pa.string())], names=["host", "row"])


def _inferred(shapes: DataFrame) -> tuple[DataFrame, list[str]]:
    """(host, row): each host's wrapper as JSON, from its distinct token rows; and written tables."""
    level, at = shared.written(shapes.select("host", "row").transform(shared.arrow, _folded, "host string, row string").distinct(), "wrapper-rows")
    paths = [at]
    while level.groupBy("host").count().where("count > 1").take(1):
        sizes = level.groupBy("host").agg(F.ceil(F.count("*") / BUCKET).alias("buckets"))
        dealt = level.join(sizes, "host").withColumn("bucket", F.pmod(F.xxhash64("row"), F.col("buckets")))
        level, at = shared.written(dealt.select("host", "bucket", "row").groupBy("host", "bucket").applyInPandas(_merged, "host string, row string"), "wrapper-rows")
        paths.append(at)
    return level, paths


def _shapes(rows: DataFrame) -> tuple[DataFrame, str]:
    """(host, shape, row): the distinct token rows, written."""
    return shared.written(rows.groupBy("host", "shape").agg(F.first("row").alias("row")), "shapes")


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper): each host's wrapper as a regular expression."""

    def run(batches):
        for batch in batches:
            regexes = [as_regex(json.loads(row)) for row in batch.column("row").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(regexes, pa.string())], names=["host", "wrapper"])

    shapes, at = _shapes(token_rows(pages))
    level, paths = _inferred(shapes)
    out, _ = shared.written(level.transform(shared.arrow, run, "host string, wrapper string"), "wrappers")
    shared.remove(pages.sparkSession, at, *paths)
    return out


SLOTS = "host string, shape string, at int, slot int, repeated boolean, path string"


def _parsed(batches):
    last, steps = None, []
    for batch in batches:
        out: list[tuple] = []
        for host, shape, row, wrapper in zip(*(batch.column(c).to_pylist() for c in ("host", "shape", "row", "wrapper")), strict=True):
            if wrapper != last:
                last, steps = wrapper, program(json.loads(wrapper))
            tokens = row.split()
            chains = containers(tokens)
            # a wrapper matches all rows it was merged from; without a match a slot would be its containers alone
            found = parse(steps, tokens) or [-1] * len(chains)
            out += [(host, shape, at, slot, slot >= 0 and steps[slot][2] >= 0, ">".join(label for _, label in chain)) for (at, chain), slot in zip(chains.items(), found, strict=True)]
        types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=[x.split()[0] for x in SLOTS.split(", ")])


def _judged(batches):
    for batch in batches:
        keep = []
        for row, held in zip(batch.column("row").to_pylist(), batch.column("weights").to_pylist(), strict=True):
            weights = {x["at"]: (x["chars"], x["links"]) for x in held}
            keep.append(content_slots(row.split(), weights, {x["at"] for x in held if x["same"]}, {x["at"] for x in held if x["comment"]}))
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("shape"), pa.array(keep, pa.list_(pa.int32()))], names=["host", "shape", "keep"])


def slots(counted: DataFrame, parsed: DataFrame) -> DataFrame:
    """(host, shape, at, chars, links, same, comment): what the pages of a host have in the slot of each text of a token row.

    A text is common if it stands in a slot on (nearly) all pages that have the slot, in whatever turn of a repeated group. In
    a repeated group links are counted by turn, elsewhere by slot."""
    slot, place = ["host", "slot", "path"], ["host", "shape", "at"]
    sums = lambda *names: [F.sum(c).alias(c) for c in names]
    facts = ("n", "chars", "links", "blocks", "bylines")
    own = counted.groupBy(*place).agg(*sums(*facts)).join(parsed, place)
    # all pages of a token row have its slots, so pages are counted by row
    pages_of = own.groupBy(*slot, "shape").agg(F.max("n").alias("n")).groupBy(*slot).agg(F.sum("n").alias("pages")).where(F.col("pages") >= PAGES)
    texts = counted.join(parsed, place).groupBy(*slot, "shape", "text").agg(F.max("n").alias("n")).groupBy(*slot, "text").agg(*sums("n"))
    common = texts.join(pages_of, slot).where(F.col("n") >= SAME * F.col("pages")).select(*slot, "text")
    fixed = counted.join(parsed, place).join(common, [*slot, "text"]).groupBy(*place).agg(F.sum("n").alias("n_common"))
    pooled = own.groupBy(*slot).agg(*sums(*facts), F.max("repeated").alias("repeated"))
    many = F.col("repeated") | (F.col("bylines") > 1.5 * F.col("n"))
    pooled = pooled.select(*slot, (F.col("chars") / F.col("n")).alias("_chars"), (F.col("links") / F.col("n")).alias("_links"), ((F.col("bylines") >= BYLINES * F.col("blocks")) & many).alias("comment"))
    held = own.join(pooled, slot).join(fixed, place, "left")
    turn = lambda c: F.when(F.col("repeated"), F.col(c) / F.col("n")).otherwise(F.col("_" + c)).alias(c)
    return held.select(*place, turn("chars"), turn("links"), (F.coalesce("n_common", F.lit(0)) >= SAME * F.col("n")).alias("same"), "comment")


def _counted(rows: DataFrame) -> DataFrame:
    """(host, shape, at, text, n, ..): the texts of token rows, pages with equal texts counted once. Texts are counted by
    their digests, so one that all pages of a hot host have is one row a task."""
    each = rows.groupBy("host", "shape", "page").agg(F.first("weights").alias("weights")).select("host", "shape", F.inline("weights"))
    return each.groupBy("host", "shape", "at", "text").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("chars", "links", "blocks", "bylines")])


def plans(pages: DataFrame) -> DataFrame:
    """(host, shape, keep): the texts of each distinct token row that are in content slots of its host's wrapper."""
    rows, path = shared.written(token_rows(pages), "token-rows")
    shapes, at_shapes = _shapes(rows)
    level, paths = _inferred(shapes)
    parsed = shapes.join(level.select("host", F.col("row").alias("wrapper")), "host").transform(shared.arrow, _parsed, SLOTS)
    parsed, at_slots = shared.written(parsed, "slots")
    counted, at_counted = shared.written(_counted(rows), "counted")
    held = slots(counted, parsed).groupBy("host", "shape").agg(F.collect_list(F.struct("at", "chars", "links", "same", "comment")).alias("weights"))
    judged = shapes.join(held, ["host", "shape"]).transform(shared.arrow, _judged, "host string, shape string, keep array<int>")
    out, _ = shared.written(judged, "plans")
    shared.remove(pages.sparkSession, path, at_shapes, at_slots, at_counted, *paths)
    return out


BLOCKS_OF = "page_id long, url string, host string, shape string, blocks array<struct<at:int,text:string>>"


def extract(pages: DataFrame) -> DataFrame:
    """The main text of every page by its host's wrapper: (page_id, url, text, n_chars)."""

    def run(batches):
        for batch in batches:
            hosts, shapes, blocks = [], [], []
            for url, source in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                page = Page(source or "")
                hosts.append(host_of(url))
                shapes.append(_shape(page.tokens))
                blocks.append([{"at": at, "text": text} for at, (_, text, _) in zip(page.places, page.blocks, strict=True)])
            kind = pa.list_(pa.struct([("at", pa.int32()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(hosts, pa.string()), pa.array(shapes, pa.string()), pa.array(blocks, kind)], names=[x.split()[0] for x in BLOCKS_OF.split(", ")])

    found = plans(pages)
    size = found.agg(F.sum(F.length("host") + 4 * F.size("keep") + 64)).first()[0] or 0
    found = F.broadcast(found) if size <= BROADCAST_BYTES else found
    cut = pages.select(F.col("page_id").cast("long"), "url", "html").transform(shared.arrow, run, BLOCKS_OF)
    kept = F.filter("blocks", lambda block: F.array_contains(F.coalesce("keep", F.array().cast("array<int>")), block["at"]))
    text = F.array_join(F.transform(kept, lambda block: block["text"]), "\n")
    return cut.join(found, ["host", "shape"], "left").select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
