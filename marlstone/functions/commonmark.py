"""CommonMark with source positions: blocks by a container stack, inlines by a delimiter stack.

`parse` reads one text into blocks whose inline nodes know where in the source they stand, so that links, images,
tags and definitions can be judged by what a reader would see and edited where they are. `html_of` renders
it: links to http, https and mailto only, no images, no raw HTML (tags go, their words stay).
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

# Fixed values of CommonMark: ASCII punctuation, what may be escaped; elements that begin an HTML block.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
HTML_BLOCKS = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame "
    "frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table "
    "tbody td tfoot th thead title tr track ul"
).split()
SCHEMES = ("http", "https", "mailto")
MOST_DEPTH, MOST_LABEL = 64, 999

_ATTRIBUTE = r"\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?"
_TAG = re.compile(rf"<[A-Za-z][A-Za-z0-9-]*(?:{_ATTRIBUTE})*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>|<!--(?:>|->|.*?-->)|<\?.*?\?>|<![A-Za-z][^>]*>|<!\[CDATA\[.*?\]\]>", re.DOTALL)
_AUTOLINK = re.compile(r"<(?:([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>\x00-\x1f]*)|([A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*))>")
_ENTITY = re.compile(r"&(?:#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[A-Za-z][A-Za-z0-9]{1,31});")
_ESCAPE = re.compile(rf"\\([{re.escape(PUNCTUATION)}])")
_FENCE = re.compile(r"(`{3,})([^`]*)$|(~{3,})(.*)$")
_HEADING = re.compile(r"(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
_BREAK = re.compile(r"([*_-])[ \t]*(?:\1[ \t]*){2,}$")
_MARKER = re.compile(r"(?:([-+*])|(\d{1,9})([.)]))(?=[ \t]|$)")
_TITLE = r"(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\))"
_DEFINED = re.compile(rf"[ ]{{0,3}}\[((?:[^\[\]\\]|\\.){{1,{MOST_LABEL}}})\]:[ \t]*\n?[ \t]*(<(?:[^<>\n\\]|\\.)*>|[^\s<]\S*)(?:(?:[ \t]+|[ \t]*\n[ \t]*)({_TITLE}))?[ \t]*(?:\n|$)", re.DOTALL)
_DEFINED_BARE = re.compile(rf"[ ]{{0,3}}\[((?:[^\[\]\\]|\\.){{1,{MOST_LABEL}}})\]:[ \t]*\n?[ \t]*(<(?:[^<>\n\\]|\\.)*>|[^\s<]\S*)[ \t]*(?:\n|$)", re.DOTALL)
_HTML_ENDS = ((re.compile(r"<(?:script|pre|style|textarea)(?:\s|>|$)", re.IGNORECASE), re.compile(r"</(?:script|pre|style|textarea)>", re.IGNORECASE)), (re.compile("<!--"), re.compile("-->")), (re.compile(r"<\?"), re.compile(r"\?>")), (re.compile("<![A-Za-z]"), re.compile(">")), (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>")))
_HTML_NAMED = re.compile(rf"</?(?:{'|'.join(HTML_BLOCKS)})(?:\s|/?>|$)", re.IGNORECASE)
_HTML_ALONE = re.compile(rf"(?:<[A-Za-z][A-Za-z0-9-]*(?:{_ATTRIBUTE})*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>)\s*$")


@dataclass
class Block:
    """kind: document, quote, list, item, paragraph, heading, code, html or break. lines: (text, source places of its characters)."""

    kind: str
    children: list[Block] = field(default_factory=list)
    lines: list[tuple[str, list[int]]] = field(default_factory=list)
    level: int = 0
    info: str = ""
    marker: str = ""
    tight: bool = True
    nodes: list[Node] = field(default_factory=list)


@dataclass
class Node:
    """kind: text, code, soft, hard, tag, auto, link, image, strong, em; a run of * or _ or a bracket while it is open. [start, end) in the source."""

    kind: str
    start: int
    end: int
    text: str = ""
    children: list[Node] = field(default_factory=list)
    title: str = ""
    inner: tuple[int, int] = (0, 0)
    opens: bool = False
    closes: bool = False
    count: int = 0
    named: bool = False  # a link whose target a definition gives


@dataclass
class Definition:
    start: int
    end: int
    target: str
    title: str


def plain(text: str) -> str:
    """Without backslash escapes and entities."""
    parts = re.split(rf"(\\[{re.escape(PUNCTUATION)}])", text)
    return "".join(p[1] if k % 2 else _ENTITY.sub(lambda m: html.unescape(m[0]), p) for k, p in enumerate(parts))


def _label(text: str) -> str:
    return " ".join(text.casefold().split())


def _unwrapped(target: str) -> str:
    return target[1:-1] if target[:1] == "<" else target


class Blocks:
    """The block structure, read line by line."""

    def __init__(self, source: str) -> None:
        self.document = Block("document")
        self.open: list[Block] = []  # quotes and items
        self.leaf: Block | None = None
        self.blank = False
        self.definitions: dict[str, Definition] = {}
        self.all_definitions: list[Definition] = []
        self.lists: dict[int, Block] = {}  # of each item
        at = 0
        for raw in source.split("\n"):
            self.line(*_expanded(raw.removesuffix("\r"), at))
            at += len(raw) + 1
        self.close(0)

    def top(self) -> Block:
        return self.open[-1] if self.open else self.document

    def close(self, depth: int) -> None:
        """Close the leaf and the containers below this depth."""
        self.end_leaf()
        del self.open[depth:]

    def end_leaf(self) -> None:
        leaf, self.leaf = self.leaf, None
        if leaf is None:
            return
        if leaf.kind == "paragraph":
            self.take_definitions(leaf)
        elif leaf.kind == "code" and not leaf.marker:
            while leaf.lines and not leaf.lines[-1][0].strip():
                leaf.lines.pop()

    def take_definitions(self, leaf: Block) -> None:
        text, places = _joined(leaf.lines)
        at = 0
        while found := _DEFINED.match(text, at) or _DEFINED_BARE.match(text, at):
            if not found[1].strip() or found.end() == at:
                break
            title = found[3] if found.re is _DEFINED else None
            end = found.end()
            made = Definition(places[at], places[min(end, len(places)) - 1] + 1, _unwrapped(found[2]), plain((title or "  ")[1:-1]))
            self.definitions.setdefault(_label(found[1]), made)
            self.all_definitions.append(made)
            at = end
        if at:
            leaf.lines = [(text[at:], places[at:])] if at < len(text) else []

    def add(self, block: Block) -> Block:
        parent = self.top()
        if self.blank and parent.kind == "item" and parent.children:
            self.lists[id(parent)].tight = False
        parent.children.append(block)
        self.blank = False
        return block

    def add_item(self, marker: str, start: int, width: int) -> None:
        parent = self.top()
        last = parent.children[-1] if parent.children else None
        if last is None or last.kind != "list" or last.marker != marker:
            last = self.add(Block("list", marker=marker, level=start))
        elif self.blank:
            last.tight = False
        self.blank = False
        item = Block("item", level=width)
        last.children.append(item)
        self.lists[id(item)] = last
        self.open.append(item)

    def line(self, text: str, places: list[int]) -> None:
        i, depth = 0, 0
        for box in self.open:
            indent = len(text) - i - len(text[i:].lstrip(" "))
            if box.kind == "quote":
                if indent > 3 or text[i + indent : i + indent + 1] != ">":
                    break
                i += indent + 1
                i += text[i : i + 1] == " "
            elif not text[i:].strip():
                if not box.children and self.leaf is None:
                    break
            elif indent >= box.level:
                i += box.level
            else:
                break
            depth += 1
        whole = depth == len(self.open)
        if whole and self.leaf is not None and self.leaf.kind in ("code", "html") and self.leaf.marker:
            self.verbatim(text[i:], places[i:])
            return
        fresh = False
        while True:
            rest = text[i:].lstrip(" ")
            indent = len(text) - i - len(rest)
            paragraph = self.leaf is not None and self.leaf.kind == "paragraph" and not fresh
            if not rest.strip() or indent > 3 or len(self.open) >= MOST_DEPTH and not paragraph:
                break
            if rest[0] == ">":
                self.begin(depth, fresh)
                self.add(quote_ := Block("quote"))
                self.open.append(quote_)
                i += indent + 1
                i += text[i : i + 1] == " "
            elif paragraph and whole and re.fullmatch(r"(=+|-+)[ \t]*", rest) and self.underlined(rest):
                return
            elif found := _HEADING.match(rest):
                self.begin(depth, fresh)
                head = self.add(Block("heading", level=len(found[1])))
                a, b = (found.start(2), found.end(2)) if found[2] is not None else (0, 0)
                head.lines = [(rest[a:b], places[i + indent + a : i + indent + b])]
                return
            elif _BREAK.match(rest):
                self.begin(depth, fresh)
                self.add(Block("break"))
                return
            elif found := _FENCE.match(rest):
                self.begin(depth, fresh)
                self.leaf = self.add(Block("code", marker=found[1] or found[3], level=indent, info=plain((found[2] if found[1] else found[4]).strip())))
                return
            elif rest[0] == "<" and (kind := self.html_kind(rest, paragraph)) is not None:
                self.begin(depth, fresh)
                self.leaf = self.add(Block("html", marker=kind or "blank"))
                self.verbatim(text[i:], places[i:])
                return
            elif (found := _MARKER.match(rest)) and not (paragraph and whole and (not rest[found.end() :].strip() or found[2] not in (None, "1"))):
                after = rest[found.end() :]
                gap = len(after) - len(after.lstrip(" "))
                gap = 1 if not after.strip() or gap > 4 else gap
                self.begin(depth, fresh)
                self.add_item(found[1] or found[3], int(found[2] or 0), indent + found.end() + gap)
                i = min(i + indent + found.end() + gap, len(text))
            else:
                break
            depth, fresh, whole = len(self.open), True, True
        rest = text[i:]
        if not rest.strip():
            if self.leaf is not None and self.leaf.kind == "code" and whole:
                self.leaf.lines.append((rest[4:], places[i + 4 :]))
                self.blank = True
                return
            self.close(depth)
            self.blank = True
            return
        if self.leaf is not None and self.leaf.kind == "paragraph" and not fresh:
            self.leaf.lines.append((rest.lstrip(" "), places[len(text) - len(rest.lstrip(" ")) :]))
            return
        if len(rest) - len(rest.lstrip(" ")) > 3:
            if self.leaf is None or self.leaf.kind != "code" or not whole or fresh:
                self.begin(depth, fresh)
                self.leaf = self.add(Block("code"))
            self.leaf.lines.append((rest[4:], places[i + 4 :]))
            self.blank = False
            return
        self.begin(depth, fresh)
        self.leaf = self.add(Block("paragraph"))
        self.leaf.lines.append((rest.lstrip(" "), places[len(text) - len(rest.lstrip(" ")) :]))

    def begin(self, depth: int, fresh: bool) -> None:
        """Another block begins here: what the line didn't continue ends."""
        if fresh:
            self.end_leaf()
        else:
            self.close(depth)

    def underlined(self, rest: str) -> bool:
        """The open paragraph becomes a heading, unless only definitions are in it."""
        leaf = self.leaf
        self.take_definitions(leaf)
        if not leaf.lines:
            return False
        leaf.kind, leaf.level, self.leaf = "heading", 1 if rest[0] == "=" else 2, None
        return True

    def html_kind(self, rest: str, paragraph: bool) -> str | None:
        """How an HTML block that begins here ends: a number, or '' for a blank line; None where none begins."""
        for k, (begin, _) in enumerate(_HTML_ENDS):
            if begin.match(rest):
                return str(k)
        if _HTML_NAMED.match(rest) or (not paragraph and _HTML_ALONE.match(rest)):
            return ""
        return None

    def verbatim(self, text: str, places: list[int]) -> None:
        leaf = self.leaf
        if leaf.kind == "html":
            if leaf.marker == "blank" and not text.strip():
                self.end_leaf()
                self.blank = True
                return
            leaf.lines.append((text, places))
            if leaf.marker != "blank" and _HTML_ENDS[int(leaf.marker)][1].search(text):
                self.end_leaf()
            return
        bare = text.strip()
        if len(bare) >= len(leaf.marker) and set(bare) == {leaf.marker[0]} and len(text) - len(text.lstrip(" ")) < 4:
            self.end_leaf()
            return
        cut = min(leaf.level, len(text) - len(text.lstrip(" ")))
        leaf.lines.append((text[cut:], places[cut:]))


def _expanded(raw: str, at: int) -> tuple[str, list[int]]:
    """A line with tabs before its first other character as spaces, and the source place of each character."""
    lead = re.match(r"[ \t]*(?:(?:>|[-+*]|\d{1,9}[.)])[ \t]+)*", raw)[0]
    if "\t" not in lead:
        return raw, list(range(at, at + len(raw)))
    text, places = [], []
    for k, c in enumerate(raw):
        n = 4 - len(text) % 4 if c == "\t" and k < len(lead) else 1
        text += [" " if c == "\t" and k < len(lead) else c] * n
        places += [at + k] * n
    return "".join(text), places


def _joined(lines: list[tuple[str, list[int]]]) -> tuple[str, list[int]]:
    text, places = [], []
    for k, (line, own) in enumerate(lines):
        line, own = (line.rstrip(), own[: len(line.rstrip())]) if k == len(lines) - 1 else (line, own)
        text.append(line)
        places += own
        if k < len(lines) - 1:
            text.append("\n")
            places.append((own[-1] + 1) if own else (places[-1] + 1 if places else 0))
    return "".join(text), places


class Inlines:
    """The inline nodes of one run of text."""

    def __init__(self, text: str, places: list[int], definitions: dict[str, Definition]) -> None:
        self.text, self.definitions = text, definitions
        self.places = [*places, (places[-1] + 1) if places else 0]
        self.nodes: list[Node] = []
        self.brackets: list[tuple[int, int, bool]] = []  # (node, position after it, may still be a link)
        self.ticks: dict[int, list[int]] = {}
        for m in re.finditer("`+", text):
            self.ticks.setdefault(len(m[0]), []).append(m.start())
        self.read()
        self.nodes = self.emphasised(self.nodes)

    def put(self, kind: str, a: int, b: int, text: str = "") -> Node:
        node = Node(kind, self.places[a], self.places[b - 1] + 1 if b > a else self.places[a], text)
        self.nodes.append(node)
        return node

    def read(self) -> None:
        text, i = self.text, 0
        while i < len(text):
            c = text[i]
            if c == "\\" and text[i + 1 : i + 2] == "\n":
                self.put("hard", i, i + 2)
                i += 2
            elif c == "\\" and i + 1 < len(text) and text[i + 1] in PUNCTUATION:
                self.put("text", i, i + 2, text[i + 1])
                i += 2
            elif c == "`":
                i = self.code(i)
            elif c == "<" and (found := _AUTOLINK.match(text, i)):
                node = self.put("auto", i, found.end(), found[1] or found[2])
                node.title = "mailto:" if found[2] else ""
                i = found.end()
            elif c == "<" and (found := _TAG.match(text, i)):
                self.put("tag", i, found.end(), found[0])
                i = found.end()
            elif c == "&" and (found := _ENTITY.match(text, i)):
                self.put("text", i, found.end(), html.unescape(found[0]))
                i = found.end()
            elif c in "*_":
                i = self.run(i)
            elif (c == "[" or text.startswith("![", i)) and len(self.brackets) < MOST_DEPTH:
                size = 1 + (c == "!")
                self.put("bracket", i, i + size, text[i : i + size])
                i += size
                self.brackets.append((len(self.nodes) - 1, i, True))
            elif c == "]":
                i = self.bracket(i)
            elif c == "\n":
                hard = text[max(i - 2, 0) : i] == "  "
                if self.nodes and self.nodes[-1].kind == "text":
                    self.nodes[-1].text = self.nodes[-1].text.rstrip(" ")
                self.put("hard" if hard else "soft", i, i + 1)
                i += 1
            else:
                end = re.compile(r"[\\`<&*_!\[\]\n]").search(text, i + 1)
                j = end.start() if end else len(text)
                self.put("text", i, j, text[i:j])
                i = j

    def code(self, i: int) -> int:
        run = re.compile("`+").match(self.text, i)
        size = len(run[0])
        close = next((p for p in self.ticks.get(size, ()) if p >= run.end()), None)
        if close is None:
            self.put("text", i, run.end(), run[0])
            return run.end()
        inner = self.text[run.end() : close].replace("\n", " ")
        if inner.strip(" ") and inner[0] == inner[-1] == " ":
            inner = inner[1:-1]
        self.put("code", i, close + size, inner)
        self.ticks[size] = [p for p in self.ticks[size] if p > close]
        return close + size

    def run(self, i: int) -> int:
        c, j = self.text[i], i
        while self.text[j : j + 1] == c:
            j += 1
        before, after = self.text[i - 1 : i] or " ", self.text[j : j + 1] or " "
        mark = lambda x: x in PUNCTUATION or not (x.isalnum() or x.isspace()) and not x.isalpha()
        left = not after.isspace() and (not mark(after) or before.isspace() or mark(before))
        right = not before.isspace() and (not mark(before) or after.isspace() or mark(after))
        node = self.put("run", i, j, c)
        node.count = j - i
        node.opens = left if c == "*" else left and (not right or mark(before))
        node.closes = right if c == "*" else right and (not left or mark(after))
        return j

    def bracket(self, i: int) -> int:
        """A closing bracket: a link or image with the last open one, or a character."""
        if not self.brackets:
            self.put("text", i, i + 1, "]")
            return i + 1
        at, begin, active = self.brackets.pop()
        opener = self.nodes[at]
        target = self.target(begin, i) if active else None
        if target is None:
            opener.kind = "text"
            self.put("text", i, i + 1, "]")
            return i + 1
        url, title, end, named = target
        node = Node("image" if opener.text == "![" else "link", opener.start, self.places[end - 1] + 1, url, title=title)
        node.inner = (self.places[begin] if i > begin else opener.end, self.places[i])
        node.named = named
        node.children = self.emphasised(self.nodes[at + 1 :])
        self.nodes[at:] = [node]
        if node.kind == "link":  # no link in a link
            self.brackets = [(n, b, live and self.nodes[n].text == "![") for n, b, live in self.brackets]
        return end

    def target(self, begin: int, i: int) -> tuple[str, str, int, bool] | None:
        """Destination, title and end of what follows a bracketed text, and whether a definition gave them."""
        if self.text[i + 1 : i + 2] == "(" and (found := self.inline_target(i + 2)):
            return *found, False
        if i - begin <= MOST_LABEL:
            named = re.compile(rf"\[((?:[^\[\]\\]|\\.){{0,{MOST_LABEL}}})\]", re.DOTALL).match(self.text, i + 1)
            own = self.text[begin:i]
            name, end = (named[1], named.end()) if named and named[1].strip() else (own, named.end() if named and not named[1] else i + 1)
            if (made := self.definitions.get(_label(name))) and not re.search(r"(?<!\\)\[", name):
                return made.target, made.title, end, True
        return None

    def inline_target(self, i: int) -> tuple[str, str, int] | None:
        text = self.text
        i = re.compile(r"[ \t]*\n?[ \t]*").match(text, i).end()
        if text[i : i + 1] == "<":
            found = re.compile(r"<((?:[^<>\n\\]|\\.)*)>").match(text, i)
            if not found:
                return None
            url, i = found[1], found.end()
        else:
            depth, j = 0, i
            while j < len(text) and text[j] > " " and text[j] != "\x7f":
                if text[j] == "\\" and text[j + 1 : j + 2] in PUNCTUATION and j + 1 < len(text):
                    j += 1
                elif text[j] == "(":
                    depth += 1
                    if depth > 32:
                        return None
                elif text[j] == ")":
                    if not depth:
                        break
                    depth -= 1
                j += 1
            if depth:
                return None
            url, i = text[i:j], j
        titled = re.compile(rf"(?:[ \t]+|[ \t]*\n[ \t]*)({_TITLE})", re.DOTALL).match(text, i)
        title, i = (plain(titled[1][1:-1]), titled.end()) if titled else ("", i)
        i = re.compile(r"[ \t]*\n?[ \t]*").match(text, i).end()
        return (url, title, i + 1) if text[i : i + 1] == ")" else None

    def emphasised(self, nodes: list[Node]) -> list[Node]:
        """Runs paired from left to right, each closer with the nearest fitting opener; what is left is text."""
        out: list[Node] = []
        openers: list[int] = []  # places in out of runs that may open
        floor: dict[tuple, int] = {}
        for node in nodes:
            if node.kind != "run":
                out.append(node)
                continue
            while node.closes and node.count:
                kind = (node.text, node.opens, node.count % 3)
                fits = lambda o: o.text == node.text and o.count and (not (o.closes or node.opens) or (o.count + node.count) % 3 or not (o.count % 3 or node.count % 3))
                k = next((k for k in range(len(openers) - 1, floor.get(kind, 0) - 1, -1) if fits(out[openers[k]])), None)
                if k is None:
                    floor[kind] = len(openers)
                    break
                at, opener = openers[k], out[openers[k]]
                size = 2 if opener.count >= 2 and node.count >= 2 else 1
                made = Node("strong" if size == 2 else "em", opener.end - size, node.start + size, children=self.spoken(out[at + 1 :]))
                opener.count, node.count = opener.count - size, node.count - size
                opener.end, node.start = opener.end - size, node.start + size
                del openers[k + 1 :], out[at + 1 :]
                floor = {x: min(n, len(openers)) for x, n in floor.items()}
                out.append(made)
                if not opener.count:
                    openers.pop()
                    out.pop(at)
                    floor = {x: min(n, len(openers)) for x, n in floor.items()}
            if node.count:
                if node.opens and len(openers) < MOST_DEPTH:
                    openers.append(len(out))
                out.append(node)
        return self.spoken(out)

    def spoken(self, nodes: list[Node]) -> list[Node]:
        for node in nodes:
            if node.kind in ("run", "bracket"):
                node.kind, node.text = "text", node.text[0] * node.count if node.kind == "run" else node.text
        return nodes


@dataclass
class Document:
    root: Block
    definitions: list[Definition]

    def blocks(self) -> Iterator[Block]:
        waiting = [self.root]
        while waiting:
            block = waiting.pop()
            yield block
            waiting += reversed(block.children)

    def nodes(self) -> Iterator[Node]:
        """All inline nodes, outer ones before what they hold."""
        for block in self.blocks():
            waiting = list(reversed(block.nodes))
            while waiting:
                node = waiting.pop()
                yield node
                waiting += reversed(node.children)


def parse(source: str) -> Document:
    read = Blocks(source)
    made = Document(read.document, read.all_definitions)
    for block in made.blocks():
        if block.kind in ("paragraph", "heading"):
            block.nodes = Inlines(*_joined(block.lines), read.definitions).nodes
    return made


def _href(target: str) -> str | None:
    """A target as an attribute, if a reader may follow it."""
    url = plain(target)
    if url.partition(":")[0].lower() not in SCHEMES:
        return None
    return html.escape(quote(url, safe="!#$%&'()*+,-./:;=?@_~[]"))


def _inline_html(nodes: list[Node]) -> str:
    out = []
    for n in nodes:
        if n.kind == "text":
            out.append(html.escape(n.text))
        elif n.kind == "code":
            out.append(f"<code>{html.escape(n.text)}</code>")
        elif n.kind in ("soft", "hard"):
            out.append("<br>\n" if n.kind == "hard" else "\n")
        elif n.kind in ("em", "strong"):
            out.append(f"<{n.kind}>{_inline_html(n.children)}</{n.kind}>")
        elif n.kind == "image":
            out.append(re.sub("<[^>]*>", "", _inline_html(n.children)))
        elif n.kind == "link" or n.kind == "auto":
            words = html.escape(n.text) if n.kind == "auto" else _inline_html(n.children)
            href = _href((n.title if n.kind == "auto" else "") + n.text)
            title = f' title="{html.escape(n.title)}"' if n.kind == "link" and n.title else ""
            out.append(words if href is None else f'<a href="{href}"{title} rel="noopener noreferrer">{words}</a>')
    return "".join(out)


def html_of(block: Block, tight: bool = False) -> str:
    """A block as HTML; the paragraphs of a tight list stand bare."""
    inner = lambda t=False: "\n".join(filter(None, (html_of(b, t) for b in block.children)))
    if block.kind in ("document", "quote"):
        return inner() if block.kind == "document" else f"<blockquote>\n{inner()}\n</blockquote>"
    if block.kind == "paragraph":
        words = _inline_html(block.nodes)
        return "" if not block.lines else words if tight else f"<p>{words}</p>"
    if block.kind == "heading":
        return f"<h{block.level}>{_inline_html(block.nodes)}</h{block.level}>"
    if block.kind == "list":
        name = "ul" if block.marker in "-+*" else "ol"
        items = "\n".join(f"<li>{html_of(b, block.tight)}</li>" for b in block.children)
        return f"<{name}>\n{items}\n</{name}>"
    if block.kind == "item":
        return inner(tight)
    if block.kind == "code":
        return f"<pre><code>{html.escape(''.join(t + chr(10) for t, _ in block.lines))}</code></pre>"
    if block.kind == "html":
        text = "\n".join(t for t, _ in block.lines)
        text = re.sub(r"(?is)<(script|style)\b.*?(?:</\1\s*>|\Z)", "", text)
        return html.escape(html.unescape(re.sub(r"<[^<>]*>?", "", text)).strip())
    return "<hr>"
