"""Pages as tables of nodes, with selectors over them.

`element_tree` turns a page into a flat array of nodes in document order: each has its place (pre), the place
of its last descendant, its parent's, its rank among the elements and the like-named elements of its parent,
and its tag and attributes or its text. A node lies inside another if its place is between that one's place
and last descendant, so selectors and regions are native array expressions: no shuffle, no further Python.
`nodes` gives the same as rows.

Construction follows HTML's rules for implied parts: html, head and body are there even where a page leaves
them out; paragraphs, list items, terms, options, rows, cells and links end where the next one or a block
begins; void and raw-text elements hold no elements; an end tag without its start is left out and doesn't
reach beyond its table cell. Misnested emphasis isn't moved about: it ends with what it is in.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from marlstone.functions.text import BLOCK_TAGS, spans
from marlstone.session import ship

# Fixed values of HTML: elements without an end; what ends at the next one of its kind, and inside what;
# elements of a head; parts that hold no main text.
VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
ENDED_BY_NEXT = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")), "optgroup": (("option", "optgroup"), ("select",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)), "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)), "a": (("a",), ("td", "th", "table")),
}
ENDS_PARAGRAPH = frozenset(BLOCK_TAGS) - {"br", "dd", "dt", "li", "td", "th", "tr"} | {"details", "main", "nav", "fieldset", "form", "menu", "summary"}
SCOPES = frozenset(("caption", "table", "td", "th", "html"))
HEAD_TAGS = ("base", "link", "meta", "noscript", "script", "style", "template", "title")
BESIDE_TAGS = ("aside", "button", "footer", "form", "nav", "select", "textarea")
BESIDE_WORDS = frozenset("ad ads advert banner breadcrumb breadcrumbs comments consent cookie footer menu nav navbar navigation newsletter promo related share sidebar social sponsor".split())
MAIN_TAGS, HEADING_TAGS = ("article", "main"), ("h1", "h2", "h3", "h4", "h5", "h6")
_WORDS = re.compile(r"[^a-z]+")
#: Elements open at once; deeper ones become siblings, as browsers do.
MOST_DEPTH = 512
#: Pages whose nodes are in memory as Python objects at a time, each many times as large as its page.
PAGES_AT_ONCE = 16

_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
NODE = T.StructType().add("pre", "integer").add("last", "integer").add("parent", "integer").add("nth", "integer").add("of", "integer").add("type_nth", "integer").add("type_of", "integer").add("tag", "string").add("attrs", T.MapType(T.StringType(), T.StringType())).add("text", "string")
SEGMENT = T.StructType().add("text", "string").add("chars", "integer").add("link_chars", "integer").add("heading", "boolean").add("beside", "boolean").add("main", "boolean")
TREE = T.StructType().add("nodes", T.ArrayType(NODE)).add("segments", T.ArrayType(SEGMENT))
TEXT = "#text"


def composed(text: str) -> str:
    """Unicode normal form C."""
    return text if text.isascii() else unicodedata.normalize("NFC", text)


def attributes(text: str) -> dict[str, str]:
    """The attributes of a tag; the first of each name counts."""
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), composed(html.unescape(value.strip("\"'"))))
    return found


class Builder:
    """The node table of one page, filled in document order."""

    def __init__(self) -> None:
        self.rows: list[list] = []
        self.open: list[int] = []
        self.gap, self.edges = False, set()
        self.body = self.head = None
        self.open_element("html", {})

    def add(self, tag: str, attrs: dict | None, text: str | None) -> int:
        parent = self.open[-1] if self.open else -1
        self.rows.append([len(self.rows), -1, parent, 0, 0, 0, 0, tag, attrs, text])
        return len(self.rows) - 1

    def open_element(self, tag: str, attrs: dict) -> None:
        if len(self.open) >= MOST_DEPTH:
            self.close_top()
        self.open.append(self.add(tag, attrs, None))
        self.gap |= tag in BLOCK_TAGS

    def close_top(self) -> None:
        at = self.open.pop()
        self.rows[at][1] = len(self.rows) - 1
        self.gap |= self.tag(at) in BLOCK_TAGS

    def tag(self, at: int) -> str:
        return self.rows[at][7]

    def close_within(self, names: tuple[str, ...], barriers) -> None:
        """Close up to the outermost element of these names on this side of a barrier."""
        floor = next((k for k in range(len(self.open) - 1, -1, -1) if self.tag(self.open[k]) in barriers), 0)
        outer = next((k for k in range(floor + 1, len(self.open)) if self.tag(self.open[k]) in names), None)
        while outer is not None and len(self.open) > outer:
            self.close_top()

    def in_body(self) -> None:
        """What comes next belongs to the body."""
        if self.body is None:
            while len(self.open) > 1:
                self.close_top()
            self.open_element("body", {})
            self.body = self.open[-1]

    def merge(self, at: int, attrs: dict) -> None:
        self.rows[at][8] = attrs | self.rows[at][8]

    def start(self, tag: str, attrs: dict, closed: bool) -> None:
        if tag == "html":
            return self.merge(0, attrs)
        if tag == "head":
            if self.head is None and self.body is None:
                self.open_element("head", attrs)
                self.head = self.open[-1]
            return None
        if tag == "body":
            fresh = self.body is None
            self.in_body()
            return self.merge(self.body, attrs) if not fresh else self.rows[self.body].__setitem__(8, attrs)
        if self.body is None and tag in HEAD_TAGS:
            if self.head is None:
                self.open_element("head", {})
                self.head = self.open[-1]
        else:
            self.in_body()
        if tag in ENDED_BY_NEXT:
            self.close_within(*ENDED_BY_NEXT[tag])
        if tag in ENDS_PARAGRAPH or tag in ("li", "dd", "dt"):
            self.close_within(("p",), SCOPES | {"button"})
        self.open_element(tag, attrs)
        if tag in VOID_TAGS or closed:
            self.close_top()
        return None

    def end(self, tag: str) -> None:
        if tag in ("html", "body", "head"):
            if tag == "head" and self.head is not None and self.body is None:
                while len(self.open) > 1:
                    self.close_top()
            return
        if tag == "br":
            return self.start("br", {}, True)
        for k in range(len(self.open) - 1, 0, -1):
            name = self.tag(self.open[k])
            if name == tag:
                while len(self.open) > k:
                    self.close_top()
                return None
            if name in ("td", "th", "caption", "body") and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                return None
        return None

    def text(self, text: str) -> None:
        inside = self.tag(self.open[-1]) == "title"
        if not inside and self.body is None:
            if not text.strip():
                return
            self.in_body()
        at = self.add(TEXT, None, composed(" " + text if self.gap else text))
        if self.gap:
            self.edges.add(at)
        self.gap = False

    def finish(self) -> list[list]:
        self.in_body()
        while self.open:
            self.close_top()
        children: dict[int, list[int]] = {}
        for row in self.rows:
            if row[7] == TEXT:
                row[1] = row[0]
            else:
                children.setdefault(row[2], []).append(row[0])
        for mine in children.values():
            kinds: dict[str, int] = {}
            for k, at in enumerate(mine, 1):
                kinds[self.tag(at)] = kinds.get(self.tag(at), 0) + 1
                self.rows[at][3:6] = [k, len(mine), kinds[self.tag(at)]]
            for at in mine:
                self.rows[at][6] = kinds[self.tag(at)]
        return self.rows


def tree_rows(markup: str) -> tuple[list[list], set[int]]:
    """The nodes of a page as rows in the order of NODE, and the text nodes that follow a block's edge."""
    made = Builder()
    for kind, name, text in spans(markup):
        if kind == "text":
            made.text(text)
        elif kind == "open":
            bare = text.rstrip()
            made.start(name, attributes(bare.removesuffix("/")), name in ("noscript", "script", "style", "template"))
        else:
            made.end(name)
    return made.finish(), made.edges


def segment_rows(rows: list[list], edges: set[int]) -> Iterator[tuple]:
    """The body's text between block edges: text, characters, those in links, whether it is a heading, lies beside the main part or in it."""
    body = next(r for r in rows if r[7] == "body")
    known: dict[int, tuple[bool, ...]] = {}  # place of an element -> in a link, a heading, beside, in the main part
    outside = (False, False, False, False)
    run: list[str] = []
    linked, where = 0, outside

    def closed() -> Iterator[tuple]:
        words = " ".join(composed("".join(run)).split())
        if words:
            yield words, len(words), min(linked, len(words)), *where[1:]

    for row in rows[body[0] : body[1] + 1]:
        link, heading, beside, main = known.get(row[2], outside)
        if row[7] != TEXT:
            named = set(_WORDS.split(f"{row[8].get('class', '')} {row[8].get('id', '')}".lower()))
            aside = row[7] in BESIDE_TAGS or (row[7] != "body" and not BESIDE_WORDS.isdisjoint(named))
            known[row[0]] = (link or (row[7] == "a" and "href" in row[8]), heading or row[7] in HEADING_TAGS, beside or aside, main or row[7] in MAIN_TAGS)
            continue
        if row[0] in edges or (heading, beside, main) != where[1:]:
            yield from closed()
            run, linked = [], 0
        run.append(row[9])
        linked += link * len(" ".join(row[9].split()))
        where = (link, heading, beside, main)
    yield from closed()


def _trees_of(markup: pa.Array) -> pa.Array:
    made = []
    for page in markup.to_pylist():
        if page is None:
            made.append(None)
            continue
        rows, edges = tree_rows(page)
        segments = list(segment_rows(rows, edges))
        made.append(([(*r[:8], None if r[8] is None else list(r[8].items()), r[9]) for r in rows], segments))
    return pa.array(made, to_arrow_type(TREE))


@F.arrow_udf(TREE)
def element_tree(markup: pa.Array) -> pa.Array:
    """Nodes and text segments of each page; null stays null. Nodes are Python objects for `PAGES_AT_ONCE` pages only."""
    parts = [_trees_of(markup.slice(at, PAGES_AT_ONCE)) for at in range(0, len(markup), PAGES_AT_ONCE)]
    return pa.concat_arrays(parts) if parts else pa.array([], to_arrow_type(TREE))


def nodes(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """One row for each node of each page (key, html)."""
    ship(pages.sparkSession)
    return pages.select(key, F.explode(element_tree("html")["nodes"]).alias("n")).select(key, "n.*")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value made once."""
    return F.transform(F.array(value), use)[0]


def within(node: Column, outer: Column) -> Column:
    """Whether a node lies inside another one, or is it."""
    return node["pre"].between(outer["pre"], outer["last"])


_NAME = r"-?[A-Za-z_\u0080-￿][\w\u0080-￿-]*"
_SCAN = re.compile(
    rf"(?P<comma>\s*,\s*)|(?P<combinator>\s*[>+~]\s*|\s+)|(?P<tag>{_NAME}|\*)|#(?P<id>[\w\u0080-￿-]+)|\.(?P<class>{_NAME})"
    rf"|\[\s*(?P<attr>{_NAME})\s*(?:(?P<op>[~|^$*]?=)\s*(?P<value>\"[^\"]*\"|'[^']*'|[^\s\]\"']+)\s*(?P<flag>[iIsS])?\s*)?\]"
    r"|:(?P<pseudo>[a-z-]+)(?P<args>\()?"
)
_NTH = re.compile(r"\s*(?:(?P<word>odd|even)|(?P<a>[+-]?\d*)n\s*(?:(?P<sign>[+-])\s*(?P<b>\d+))?|(?P<only>[+-]?\d+))\s*", re.IGNORECASE)
Test = Callable[[Column], Column]


def _nth(text: str) -> Callable[[Column], Column]:
    """Whether a rank is one that an+b gives."""
    found = _NTH.fullmatch(text)
    if not found:
        raise ValueError(f"{text!r} is no position such as 2, odd or 3n+1")
    if found["only"]:
        a, b = 0, int(found["only"])
    elif found["word"]:
        a, b = 2, int(found["word"].lower() == "odd")
    else:
        a = int(found["a"] + "1") if found["a"] in ("", "+", "-") else int(found["a"])
        b = int((found["sign"] or "") + (found["b"] or "0"))
    return lambda rank: rank == b if a == 0 else (F.pmod(rank - b, F.lit(abs(a))) == 0) & ((rank - b) * (1 if a > 0 else -1) >= 0)


def _attribute(name: str, op: str | None, value: str | None, flag: str | None) -> Test:
    name, value = name.lower(), (value or "").strip("\"'")

    def test(n: Column) -> Column:
        have, want = F.try_element_at(n["attrs"], F.lit(name)), value
        if op is None:
            return have.isNotNull()
        if flag in ("i", "I"):
            have, want = F.lower(have), want.lower()
        tests = {
            "=": lambda: have == want, "~=": lambda: F.array_contains(F.split(have, r"\s+"), want) if want and not re.search(r"\s", want) else F.lit(False),
            "|=": lambda: (have == want) | have.startswith(want + "-"), "^=": lambda: have.startswith(want), "$=": lambda: have.endswith(want), "*=": lambda: have.contains(want),
        }
        return F.lit(False) if op in ("^=", "$=", "*=") and not want else tests[op]()

    return test


_RANKS: dict[str, Callable[[Column], Column]] = {
    "nth-child": lambda n: n["nth"], "nth-last-child": lambda n: n["of"] - n["nth"] + 1,
    "nth-of-type": lambda n: n["type_nth"], "nth-last-of-type": lambda n: n["type_of"] - n["type_nth"] + 1,
}
_PLAIN: dict[str, Test] = {
    "first-child": lambda n: n["nth"] == 1, "last-child": lambda n: n["nth"] == n["of"], "only-child": lambda n: n["of"] == 1,
    "first-of-type": lambda n: n["type_nth"] == 1, "last-of-type": lambda n: n["type_nth"] == n["type_of"], "only-of-type": lambda n: n["type_of"] == 1,
    "root": lambda n: n["parent"] == -1, "empty": lambda n: n["last"] == n["pre"],
}


def _compounds(text: str, at: int = 0, inner: bool = False) -> tuple[list[list[tuple[str, list[Test]]]], int]:
    """Alternatives, each a list of (combinator before it, tests), and where reading ended."""
    alternatives: list = [[("", [])]]
    bad = ValueError(f"selector {text!r} can't be read at {at}")

    def ended() -> None:
        if not alternatives[-1][-1][1]:
            raise bad

    while at < len(text):
        if inner and text[at] == ")":
            ended()
            return alternatives, at + 1
        found = _SCAN.match(text, at)
        if not found:
            raise bad
        at, tests = found.end(), alternatives[-1][-1][1]
        if found["comma"]:
            ended()
            alternatives.append([("", [])])
        elif found["combinator"]:
            if text[at : at + 1] == ")" or at == len(text) and found["combinator"].isspace():
                continue
            ended()
            alternatives[-1].append((found["combinator"].strip() or " ", []))
        elif found["tag"]:
            if tests:
                raise bad
            name = found["tag"].lower()
            tests.append((lambda n, name=name: n["tag"] == name) if name != "*" else lambda n: n["tag"] != TEXT)
        elif found["id"]:
            tests.append(_attribute("id", "=", found["id"], None))
        elif found["class"]:
            tests.append(_attribute("class", "~=", found["class"], None))
        elif found["attr"]:
            tests.append(_attribute(found["attr"], found["op"], found["value"], found["flag"]))
        elif found["pseudo"] in _PLAIN and not found["args"]:
            tests.append(_PLAIN[found["pseudo"]])
        elif found["pseudo"] in _RANKS and found["args"]:
            close = text.find(")", at)
            fits, rank = _nth(text[at : close if close >= 0 else len(text)]), _RANKS[found["pseudo"]]
            tests.append(lambda n, fits=fits, rank=rank: fits(rank(n)))
            at = (close if close >= 0 else len(text)) + 1
        elif found["pseudo"] in ("not", "is", "where") and found["args"]:
            some, at = _compounds(text, at, True)
            if any(len(x) > 1 for x in some):
                raise ValueError(f"selector {text!r} has a combinator inside :{found['pseudo']}()")
            wanted = found["pseudo"] != "not"
            tests.append(lambda n, some=some, wanted=wanted: _any(n, [x[0][1] for x in some]) == F.lit(wanted))
        else:
            raise ValueError(f"selector {text!r} has the unknown part {found[0]!r}")
    if inner:
        raise bad
    ended()
    return alternatives, at


def _all(n: Column, tests: list[Test]) -> Column:
    made = n["tag"] != TEXT
    for test in tests:
        made &= F.coalesce(test(n), F.lit(False))
    return made


def _any(n: Column, choices: list[list[Test]]) -> Column:
    made = F.lit(False)
    for tests in choices:
        made |= _all(n, tests)
    return made


_RELATED: dict[str, Callable[[Column, Column], Column]] = {
    " ": lambda n, a: (n["pre"] > a["pre"]) & (n["pre"] <= a["last"]),
    ">": lambda n, a: n["parent"] == a["pre"],
    "+": lambda n, a: (n["parent"] == a["parent"]) & (n["nth"] == a["nth"] + 1),
    "~": lambda n, a: (n["parent"] == a["parent"]) & (n["nth"] > a["nth"]),
}


def _chain(nodes_: Column, chain: list[tuple[str, list[Test]]]) -> Column:
    """Nodes that end the chain: the matches of all but its last compound are made once, then asked for each node."""
    combinator, tests = chain[-1]
    if len(chain) == 1:
        return F.filter(nodes_, lambda n: _all(n, tests))
    near = _RELATED[combinator]
    return let(_chain(nodes_, chain[:-1]), lambda before: F.filter(nodes_, lambda n: _all(n, tests) & F.exists(before, lambda a: near(n, a))))


def matched(nodes_: Column, selector: str) -> Column:
    """The nodes (array) that a selector matches, in document order.

    Tags, #id, .class, [attribute] in all its forms, :nth-child and its kin, :not, :is, :empty and :root, joined
    by the four combinators; alternatives are separated by commas. Anything else is a ValueError.
    """
    chains, _ = _compounds(selector.strip())
    found = [_chain(nodes_, chain) for chain in chains]
    if len(found) == 1:
        return found[0]
    places = F.flatten(F.array(*[F.transform(x, lambda n: n["pre"]) for x in found]))
    return let(places, lambda some: F.filter(nodes_, lambda n: F.array_contains(some, n["pre"])))


def node_text(nodes_: Column, outer: Column) -> Column:
    """The text inside a node as it stands; block edges separate words."""
    inside = F.slice(nodes_, outer["pre"] + 1, outer["last"] - outer["pre"] + 1)
    return F.array_join(F.transform(F.filter(inside, lambda n: n["tag"] == TEXT), lambda n: n["text"]), "")


def first_attribute(found: Column, name: str) -> Column:
    """An attribute of the first of some nodes; null where there is none."""
    return F.try_element_at(F.get(found, F.lit(0))["attrs"], F.lit(name))
