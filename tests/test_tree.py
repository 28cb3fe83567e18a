"""Node trees, selectors and main text against plain walks."""

import html.parser
import random

import pytest
from pyspark.sql import functions as F

from marlstone.functions.text import BLOCK_TAGS
from marlstone.plans import catalog
from marlstone.sources import pages, tree

DATA = "/root/testdata/sf0.001"


def shape(markup):
    """Nested brackets of a page's body, for reading."""
    rows, _ = tree.tree_rows(markup)
    kids = {}
    for r in rows:
        kids.setdefault(r[2], []).append(r)

    def show(row):
        return repr(row[9].strip()) if row[7] == tree.TEXT else f"{row[7]}({','.join(map(show, kids.get(row[0], [])))})"

    return show(next(r for r in rows if r[7] == "body"))


@pytest.mark.parametrize(
    ("markup", "want"),
    [
        ("<p>a<p>b<div>c</div>", "body(p('a'),p('b'),div('c'))"),
        ("<ul><li>a<ul><li>b</ul><li>c</ul>", "body(ul(li('a',ul(li('b'))),li('c')))"),
        ("<dl><dt>a<dd>b<dt>c</dl>", "body(dl(dt('a'),dd('b'),dt('c')))"),
        ("<table><tr><td>a<td>b</div><tr><td>c</table>d", "body(table(tr(td('a'),td('b')),tr(td('c'))),'d')"),
        ("<a href=x>a<a href=y>b</a>c", "body(a('a'),a('b'),'c')"),
        ("<div>a</p></span>b</div></div>c<br/>d<img src=x>e", "body(div('a','b'),'c',br(),'d',img(),'e')"),
        ("<title>t</title> <style>p{}</style>x<script>a<b</script>y", "body('x',script(),'y')"),
        ("", "body()"),
        ("<body class=k><p>a</body></html>b", "body(p('a','b'))"),
        ("<button><p>a</button>b", "body(button(p('a')),'b')"),
        ("<select><option>a<option>b</select>", "body(select(option('a'),option('b')))"),
    ],
)
def test_construction(markup, want):
    assert shape(markup) == want


def test_places_are_nested_intervals():
    r = random.Random(1)
    tags = ["div", "p", "ul", "li", "a", "b", "td", "table", "tr", "br", "x-y"]
    for _ in range(200):
        markup = "".join(r.choice([f"<{r.choice(tags)}>", f"</{r.choice(tags)}>", "t "]) for _ in range(60))
        rows, _ = tree.tree_rows(markup)
        assert [x[0] for x in rows] == list(range(len(rows))) and rows[0][7] == "html" and rows[0][1] == len(rows) - 1
        for x in rows[1:]:
            up = rows[x[2]]
            assert up[0] < x[0] <= x[1] <= up[1] and up[7] not in (tree.TEXT, *tree.VOID_TAGS)
    deep, _ = tree.tree_rows("<div>" * 5000 + "x")
    assert deep[-1][9].strip() == "x"


def naive(rows, step):
    """Places of the elements that fit a list of (combinator, test), by walking up from each."""
    def fits(at, k):
        if rows[at][7] == tree.TEXT or not step[k][1](rows[at]):
            return False
        if k == 0:
            return True
        up, comb = rows[at][2], step[k][0]
        if comb == ">":
            return up >= 0 and fits(up, k - 1)
        if comb == " ":
            while up >= 0:
                if fits(up, k - 1):
                    return True
                up = rows[up][2]
            return False
        before = [x for x in rows if x[2] == up and x[7] != tree.TEXT and x[0] < at]
        return any(fits(x[0], k - 1) for x in (before if comb == "~" else before[-1:]))

    return [r[0] for r in rows if fits(r[0], len(step) - 1)]


def test_selectors_equal_a_walk(spark):
    r = random.Random(7)
    made = []
    for _ in range(12):
        bits = []
        for _ in range(50):
            tag = r.choice(["div", "p", "span", "em"])
            bits.append(r.choice([f'<{tag} class="{r.choice(["a", "b", "a b", "A"])}" id={r.choice("xyz")} data-k="{r.choice(["one", "one-two", "two one"])}">', f"</{tag}>", "t"]))
        made.append("".join(bits))
    frame = spark.createDataFrame(list(enumerate(made)), "page_id long, html string").select("page_id", tree.element_tree("html")["nodes"].alias("n")).cache()
    tag = lambda t: lambda x: x[7] == t
    cls = lambda c: lambda x: c in x[8].get("class", "").split()
    attr = lambda f: lambda x: f(x[8].get("data-k"))
    cases = {
        "div": [("", tag("div"))],
        "div p": [("", tag("div")), (" ", tag("p"))],
        "DIV > span.a": [("", tag("div")), (">", lambda x: tag("span")(x) and cls("a")(x))],
        "p+em": [("", tag("p")), ("+", tag("em"))],
        ".a ~ .b": [("", cls("a")), ("~", cls("b"))],
        "#x  div .b>*": [("", lambda x: x[8].get("id") == "x"), (" ", tag("div")), (" ", cls("b")), (">", lambda x: True)],
        "[data-k|=one]": [("", attr(lambda v: v is not None and (v == "one" or v.startswith("one-"))))],
        "[data-k~='one']": [("", attr(lambda v: v is not None and "one" in v.split()))],
        "[data-k^=one][data-k$=two]": [("", attr(lambda v: v is not None and v.startswith("one") and v.endswith("two")))],
        '[data-k*="WO O" i]': [("", attr(lambda v: v is not None and "wo o" in v))],
        ":not(.a, span)": [("", lambda x: not cls("a")(x) and x[7] != "span")],
        ":is(p, em):nth-child(2n+1)": [("", lambda x: x[7] in ("p", "em") and x[3] % 2 == 1)],
        "span:nth-last-child(-n + 2)": [("", lambda x: x[7] == "span" and x[4] - x[3] + 1 <= 2)],
        "p:first-of-type": [("", lambda x: x[7] == "p" and x[5] == 1)],
        "em:last-child": [("", lambda x: x[7] == "em" and x[3] == x[4])],
        "body > :empty": [("", tag("body")), (">", lambda x: x[0] == x[1])],
    }
    for selector, step in cases.items():
        found = {x["page_id"]: x["p"] for x in frame.select("page_id", F.transform(tree.matched(F.col("n"), selector), lambda n: n["pre"]).alias("p")).collect()}
        for k, markup in enumerate(made):
            assert found[k] == naive(tree.tree_rows(markup)[0], step), (selector, k)
    both = frame.select(F.transform(tree.matched(F.col("n"), "em, div > p ,em"), lambda n: n["pre"]).alias("p")).collect()
    for k, x in enumerate(both):
        rows = tree.tree_rows(made[k])[0]
        assert x["p"] == sorted(set(naive(rows, cases["p:first-of-type"][:0] + [("", tag("em"))])) | set(naive(rows, [("", tag("div")), (">", tag("p"))])))
    for bad in ("", ">", "div >", "a,,b", "p:hover", "[", "div:not(", "a b:not(c d)", ":nth-child(x)", "p p$"):
        with pytest.raises(ValueError):
            tree.matched(F.col("n"), bad)


class Walk(html.parser.HTMLParser):
    """Text and links of a body, with no tree."""

    def __init__(self):
        super().__init__()
        self.parts, self.skip, self.head = [], 0, False

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        self.head |= tag == "title"
        self.parts.append(" " if tag in BLOCK_TAGS else "")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style")
        self.head &= tag != "title"
        self.parts.append(" " if tag in BLOCK_TAGS else "")

    def handle_data(self, data):
        if not self.skip and not self.head:
            self.parts.append(data)


def test_text_of_all_pages_equals_a_plain_walk(spark):
    table = spark.read.parquet(f"{DATA}/pages.parquet")
    found = {r["page_id"]: r["text"] for r in catalog.page_fingerprints(spark, DATA).collect()}
    for row in table.collect():
        walk = Walk()
        walk.feed(row["html"])
        assert found[row["page_id"]] == " ".join("".join(walk.parts).split())


def test_main_text_of_all_pages(spark):
    """Navigation, advertisements and footers go, all of the article stays."""
    table = spark.read.parquet(f"{DATA}/pages.parquet")
    found = {r["page_id"]: r for r in pages.extracted(table, least=1).collect()}
    for row in table.collect():
        inner = row["html"].partition("<article>")[2].partition("</article>")[0]
        walk = Walk()
        walk.feed(inner)
        want, got = "".join("".join(walk.parts).split()), found[row["page_id"]]
        assert "".join(got["text"].split()) == want and got["title"] and got["language"] in row["html"]


def test_main_text_without_an_article(spark):
    long = "It says so much about the matter, and then it goes on to say a good deal more about it. " * 3
    page = f'<html lang="de_AT"><div class="top-menu">Home News Contact</div><div><ul><li><a href=/1>{long}</a><li><a href=/2>Two</a></ul></div><h2>Heading</h2><p>{long}</p><p>Short one.</p><p>{long}</p><div>Share</div><div>Tweet</div><div>Print</div><footer>{long}</footer>'
    made = [(1, page), (2, "<p>tiny one"), (3, None), (4, "x" * 50), (5, "<p>" + "word " * 100)]
    frame = spark.createDataFrame([(i, "http://h.org/p", h, "extra") for i, h in made], "page_id long, url string, html string, nodes string")
    found = {r["page_id"]: r for r in pages.extracted(frame, least=5, most=303, most_input=2000).collect()}
    assert found[1]["text"] is not None and found[1]["truncated"]
    whole = pages.extracted(frame.where("page_id = 1"), least=5).first()
    assert whole["text"] == "\n".join(("Heading", long.strip(), "Short one.", long.strip())) and whole["language"] == "de" and whole["title"] == "http://h.org/p"
    assert (found[2]["text"], found[2]["problem"]) == ("tiny one", None) and found[3]["problem"] is None and found[3]["text"] is None
    assert found[5]["truncated"] and len(found[5]["text"]) == 299
    assert pages.extracted(frame.where("page_id = 5"), most_input=100).first()["problem"] == "too_large"
    assert pages.extracted(frame.where("page_id = 2")).first()["problem"] == "too_short"


def test_problem_of_a_selector_without_match_and_of_its_links(spark):
    frame = spark.createDataFrame([(1, "http://h.org/p", "<p><a href='/a'>a</a><nav><a href=/b>b</a></nav>"), (2, "http://h.org/q", None)], "page_id long, url string, html string")
    found = sorted(map(tuple, pages.page_fingerprints(frame, "main").collect()))
    assert found == [(1, None, None, "selector_not_found"), (2, None, None, None)]
    assert [r["link"] for r in pages.page_links(frame, selector="nav > a:first-child").collect()] == ["http://h.org/b"]
    assert tree.nodes(frame).where("tag = 'a' AND attrs['href'] = '/a'").count() == 1


def test_encodings():
    for label, text in (("x-gbk", "汉字"), ("windows-949", "한글"), ("x-sjis", "かな"), ("big5", "漢字"), ("ISO_8859-5", "ж"), ("cp1251", "ж"), ("x-cp1250", "ł"), ("iso8859-9", "ş"), ("latin2", "ł")):
        assert pages.decoded(text.encode(pages.web_encoding(label)), f"text/html; charset={label}") == text
    assert [pages.web_encoding(x) for x in ("utf-7", "idna", "rot13", "iso-8859-12", "", None)] == [None] * 6
    assert pages.decoded("﻿é".encode("utf-16-le"), "text/html; charset=latin1") == "é"
    assert pages.decoded(b"<meta charset=utf-16>\xc3\xa9", None).endswith("é")
    assert pages.decoded("é".encode("utf-16-le"), "text/html; charset=utf-16") == "é"
