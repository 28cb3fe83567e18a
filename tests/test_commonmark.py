"""Markdown as HTML by hand-checked cases, and the URL filter on random and hostile text."""

import random
import time

import pytest

from marlstone.functions import commonmark, markdown


def shown(text):
    return commonmark.html_of(commonmark.parse(text).root)


REL = ' rel="noopener noreferrer"'


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a\nb\n\nc", "<p>a\nb</p>\n<p>c</p>"),
        ("# A #\n###### b\n####### c", "<h1>A</h1>\n<h6>b</h6>\n<p>####### c</p>"),
        ("A\n===\nb\nc\n---", "<h1>A</h1>\n<h2>b\nc</h2>"),
        ("***\n- - -\n__", "<hr>\n<hr>\n<p>__</p>"),
        ("- a\n- b\n\n  c\n- d", "<ul>\n<li><p>a</p></li>\n<li><p>b</p>\n<p>c</p></li>\n<li><p>d</p></li>\n</ul>"),
        ("- a\n  - b\n    - c\n- d", "<ul>\n<li>a\n<ul>\n<li>b\n<ul>\n<li>c</li>\n</ul></li>\n</ul></li>\n<li>d</li>\n</ul>"),
        ("1. a\n2. b\n\n3) c", "<ol>\n<li>a</li>\n<li>b</li>\n</ol>\n<ol>\n<li>c</li>\n</ol>"),
        ("a\n- b\n2. c", "<p>a</p>\n<ul>\n<li>b</li>\n</ul>\n<ol>\n<li>c</li>\n</ol>"),
        ("> a\nb\n> c\n\n> d", "<blockquote>\n<p>a\nb\nc</p>\n</blockquote>\n<blockquote>\n<p>d</p>\n</blockquote>"),
        ("> - a\n>   b\n> - c", "<blockquote>\n<ul>\n<li>a\nb</li>\n<li>c</li>\n</ul>\n</blockquote>"),
        ("```py\n<a>\n\n  b\n```\nc", "<pre><code>&lt;a&gt;\n\n  b\n</code></pre>\n<p>c</p>"),
        ("~~~\na\n```\n~~~~", "<pre><code>a\n```\n</code></pre>"),
        ("    a\n\n      b\n\nc", "<pre><code>a\n\n  b\n</code></pre>\n<p>c</p>"),
        ("\tcode\n-\ta", "<pre><code>code\n</code></pre>\n<ul>\n<li>a</li>\n</ul>"),
        ("*a* **b** ***c*** _d_ __e__", "<p><em>a</em> <strong>b</strong> <em><strong>c</strong></em> <em>d</em> <strong>e</strong></p>"),
        ("a_b_c a*b*c * d * *(e)*", "<p>a_b_c a<em>b</em>c * d * <em>(e)</em></p>"),
        ("**a *b* c** *a **b** c* **a*", "<p><strong>a <em>b</em> c</strong> <em>a <strong>b</strong> c</em> *<em>a</em></p>"),
        ("*foo**bar**baz* *foo**bar*", "<p><em>foo<strong>bar</strong>baz</em> <em>foo**bar</em></p>"),
        ("`a *b*` `` `c` `` `d", "<p><code>a *b*</code> <code>`c`</code> `d</p>"),
        ("\\*a\\* &amp; &copy; &#35; &nope; \\q", "<p>*a* &amp; © # &amp;nope; \\q</p>"),
        ("a  \nb\\\nc", "<p>a<br>\nb<br>\nc</p>"),
        ("[a](http://h.org/x \"t\")", f'<p><a href="http://h.org/x" title="t"{REL}>a</a></p>'),
        ("[a [b]](<http://h.org/a b>) [c](javascript:x)", f'<p><a href="http://h.org/a%20b"{REL}>a [b]</a> c</p>'),
        ("[a](http://h.org/(x)) [b] [ b ][] [c][B]\n\n[b]: http://h.org/b", f'<p><a href="http://h.org/(x)"{REL}>a</a> <a href="http://h.org/b"{REL}>b</a> <a href="http://h.org/b"{REL}> b </a> <a href="http://h.org/b"{REL}>c</a></p>'),
        ("[a [b](http://h.org/b) c](http://h.org/c)", f'<p>[a <a href="http://h.org/b"{REL}>b</a> c](http://h.org/c)</p>'),
        ("*[a*](http://h.org/)", f'<p>*<a href="http://h.org/"{REL}>a*</a></p>'),
        ("![a *b*](http://h.org/i.png) c", "<p>a b c</p>"),
        ("<http://h.org/?a=1&b=2> <a@b.org> <b>x</b> <!-- c -->", f'<p><a href="http://h.org/?a=1&amp;b=2"{REL}>http://h.org/?a=1&amp;b=2</a> <a href="mailto:a@b.org"{REL}>a@b.org</a> x </p>'),
        ("<div>\n*a* <b>c</b>\n\n*d*", "*a* c\n<p><em>d</em></p>"),
        ("<script>x</script>\na", "<p>a</p>"),
        ("[b]: <http://h.org/b>\n  'a\n  title'\n[b]", f'<p><a href="http://h.org/b" title="a\ntitle"{REL}>b</a></p>'),
        ("- [b]: http://h.org/b\n\n[b]", f'<ul>\n<li></li>\n</ul>\n<p><a href="http://h.org/b"{REL}>b</a></p>'),
        ("", ""),
    ],
)
def test_rendered(text, want):
    assert shown(text) == want


A, B = "https://example.org/a", "https://example.org/b(c)"


@pytest.mark.parametrize(
    ("text", "want", "removed", "linked"),
    [
        (f"See [a]({A}) and note [1] (2024).", f"See [a]({A}) and note [1] (2024).", 0, [A]),
        ("see [the post](https://bad.org/x) now", "see the post now", 1, []),
        (f"x ![logo]({A}) y", "x logo y", 1, []),
        (f"[[a](https://bad.org)]({A})", f"[a]({A})", 1, [A]),
        ("[a [b]](https:bad.org)", "a [b]", 1, []),
        (f"[r]: {A}\n\n[r] and [q]\n\n- [q]: http://bad.org 'x'", f"[r]: {A}\n\n[r] and [q]\n\n- ", 1, [A]),
        (f"<{A}> <http://bad.org> <x@bad.org>", f"<{A}>  ", 2, [A]),
        (f"<a href='{A}'>w</a> <b>x</b> 1 < 2", "w x 1 < 2", 1, []),
        (f"{A}, {A}. ({B}) {A}x www.bad.org HTTP://h.org", f"{A}, {A}. ({B})   ", 3, []),
        (f"`http://bad.org` {A}", f"`` {A}", 1, []),
        (f"[w](<{B}>) [v]({B})", f"[w](<{B}>) [v]({B})", 0, [B]),
        ("[m](mailto:x@bad.org) [n](/rel) [o]()", "m n o", 2, []),
        (f"[a]({A} 'see http://bad.org')", f"[a]({A} 'see ')", 1, [A]),
        ("", "", 0, []),
    ],
)
def test_filtered_urls(text, want, removed, linked):
    got = markdown.filter_urls(text, {A, B})
    assert got == (want, removed, linked)
    assert markdown.filter_urls(want, {A, B})[0] == want


BITS = ["[", "]", "(", ")", "<", ">", "!", "*", "_", "`", "\n", "\n\n", "> ", "- ", "1. ", "    ", "\t", "# ", "a", " ", "\\", "\"", "'", ":", "/", "&#40;", "[a]: ", "http://bad.org/x", "www.bad.org", A, B, "https:bad.org", "mailto:q@bad.org", "<a href=", "<b>", "</p>", "<!--", "-->", "q@bad.org", "```\n", "<script>", "&"]


def test_only_allowed_urls_are_left_of_random_text():
    r = random.Random(11)
    for _ in range(3000):
        text = "".join(r.choice(BITS) for _ in range(r.randrange(1, 25)))
        kept, _, linked = markdown.filter_urls(text, {A, B})
        assert markdown.filter_urls(kept, {A, B})[0] == kept, text
        made = commonmark.parse(kept)
        targets = {commonmark.plain(n.text) for n in made.nodes() if n.kind == "link" or n.kind == "auto"}
        assert targets <= {A, B} and set(linked) == targets, (text, kept)
        assert not any(n.kind in ("image", "tag") for n in made.nodes()) and not any(b.kind == "html" for b in made.blocks())
        rest = kept.replace(A, "").replace(B, "")
        assert "bad.org/x" not in rest and "www.bad" not in rest, (text, kept)
        commonmark.html_of(made.root)


def test_places_are_those_of_the_source():
    r = random.Random(12)
    for _ in range(1500):
        text = "".join(r.choice([*BITS, f"[w]({A})", "<http://h.org/>"]) for _ in range(r.randrange(1, 25)))
        for n in commonmark.parse(text).nodes():
            if n.kind == "link":
                assert text[n.start] == "[" and text[n.end - 1] in ")]" and text[n.inner[1]] == "]"
            if n.kind == "auto":
                assert text[n.start : n.end] == f"<{n.text}>"


@pytest.mark.parametrize("bit", ["[", "![", "](", "*a ", "a* ", "**a* ", "`", "<", "<!--", "> ", "- ", "[a](", "[[a](http://bad.org)](", "&", "(", "\\", "[a]: ", "http://", "_a_", "````\n", "<b ", "***a "])
def test_floods_end(bit):
    began = time.time()
    text = bit * (20_000 // len(bit))
    markdown.filter_urls(text, {A})
    commonmark.html_of(commonmark.parse(text).root)
    assert time.time() - began < 20
