"""Markdown: text made safe for it, lists of entries, and a filter that leaves known URLs only."""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions import commonmark

MOST_PASSES = 16
CLOSER_LOOK = 3
# What ends a URL in running text, what may follow one, headings by language.
URL_STOPS = "<>\"'`()[]"
URL_TAILS = ".,;:!?"
HEADINGS = {"en": ("Worth a closer look", "More items", "(untitled)"), "de": ("Einen genaueren Blick wert", "Weitere Einträge", "(ohne Titel)")}
FALLBACKS = {
    "en": ("The automatic summary of this run could not be written. Here are all {count} items, most relevant first.", "All items"),
    "de": ("Die automatische Zusammenfassung dieses Laufs konnte nicht erstellt werden. Hier sind alle {count} Einträge, die relevantesten zuerst.", "Alle Einträge"),
}
ADDRESS_ATTRIBUTES = ("href", "src", "srcset", "action", "formaction", "poster", "data", "cite", "background")
#: A scheme and two slashes, or www., and what follows up to white space or a stop.
URL_RUN = rf"(?:[A-Za-z][A-Za-z0-9+.-]*://|[wW]{{3}}\.)[^\s{re.escape(URL_STOPS)}]*"
_MARK = re.compile(r"://|www\.", re.IGNORECASE)
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*\Z")
_AFTER = re.compile(rf"[^\s{re.escape(URL_STOPS)}]*")
_ADDRESSED = re.compile(rf"<(?:a|img)\b|\b(?:{'|'.join(ADDRESS_ATTRIBUTES)})\s*=", re.IGNORECASE)
FILTERED = T.StructType([T.StructField("text", T.StringType()), T.StructField("removed", T.LongType()), T.StructField("linked", T.ArrayType(T.StringType()))])
Edit = tuple[int, int, str, int]  # begin, end, what stands there instead, URLs that go


def _runs(text: str, allowed: list[str]) -> Iterator[tuple[int, int]]:
    """Where URLs stand in running text that aren't one of the allowed (longest first)."""
    at = 0
    while found := _MARK.search(text, at):
        begin = found.start()
        if found[0] == "://":
            scheme = _SCHEME.search(text, at, begin)
            if not scheme:
                at = found.end()
                continue
            begin = scheme.start()
        for url in allowed:
            if text.startswith(url, begin):
                tail = _AFTER.match(text, begin + len(url))
                if not tail[0].strip(URL_TAILS) and text[tail.end() : tail.end() + 1] not in ("(", "["):
                    at = tail.end()
                    break
        else:
            at = _AFTER.match(text, found.end()).end()
            yield begin, at


def _edits(text: str, allowed: list[str]) -> tuple[list[Edit], set[str]]:
    """What must go from a Markdown text as a reader would see it, and the allowed URLs that it links."""
    made = commonmark.parse(text)
    spelt = {url: url for url in allowed} | {commonmark.plain(url): url for url in allowed}
    edits: list[Edit] = []
    kept: list[tuple[int, int]] = []
    linked: set[str] = set()
    for d in made.definitions:
        if d.target in spelt:
            kept.append((d.start, d.end))
        else:
            edits.append((d.start, d.end, "", 1))
    for n in made.nodes():
        if n.kind in ("link", "auto") and (url := spelt.get(n.text)) and not n.title.startswith("mailto:"):
            linked.add(url)
            kept.append((n.inner[1] if n.kind == "link" else n.start, n.end))
        elif n.kind == "link" and n.named:
            continue  # its definition goes
        elif n.kind in ("link", "image"):
            edits.append((n.start, n.end, text[slice(*n.inner)], int(bool(n.text))))
        elif n.kind == "auto":
            edits.append((n.start, n.end, "", 1))
        elif n.kind == "tag":
            edits.append((n.start, n.end, "", int(bool(_ADDRESSED.search(n.text)))))
    for block in made.blocks():
        for line, places in block.lines if block.kind == "html" else ():
            for m in re.finditer(r"<[^<>]*>?", line):
                edits.append((places[m.start()], places[m.end() - 1] + 1, "", int(bool(_ADDRESSED.search(m[0])))))
    edits += [(a, b, "", 1) for a, b in _runs(text, allowed) if not any(x <= a and b <= y and text[a:b].rstrip(">)") in spelt for x, y in kept)]
    return edits, linked


def _edited(text: str, edits: list[Edit]) -> tuple[str, int]:
    """The text after the outermost edits; those inside them are left to the next reading."""
    out, at, gone = [], 0, 0
    for begin, end, instead, n in sorted(edits, key=lambda e: (e[0], -e[1])):
        if begin >= at:
            out += [text[at:begin], instead]
            at, gone = end, gone + n
    return "".join([*out, text[at:]]), gone


def filter_urls(text: str, allowed: Collection[str]) -> tuple[str, int, list[str]]:
    """The Markdown without any URL that isn't exactly allowed, how many went, and the targets still linked.

    The text is parsed as CommonMark, so links, images, definitions, autolinks and tags are judged as they
    would be rendered, wherever they stand; URLs in running text and in code are judged too. Links keep their
    words, images theirs; definitions, autolinks, tags and bare URLs go. All other characters, brackets too,
    stay. What is left may make a new construct, so readings repeat until nothing changes; if
    that takes more than `MOST_PASSES`, all brackets, tags and URLs go.
    """
    ordered, removed = sorted(set(allowed), key=len, reverse=True), 0
    for _ in range(MOST_PASSES):
        edits, linked = _edits(text, ordered)
        if not edits:
            return text, removed, sorted(linked)
        text, n = _edited(text, edits)
        removed += n
    text = text.translate(dict.fromkeys(map(ord, "[]<")))
    while edits := [(a, b, "", 1) for a, b in _runs(text, [])]:
        text, n = _edited(text, edits)
        removed += n
    return text, removed, []


@F.pandas_udf(FILTERED)
def filtered(texts: pd.Series, allowed: pd.Series) -> pd.DataFrame:
    """filter_urls of each row; a null text stays null, a null list allows nothing."""
    rows = [(None, 0, []) if t is None else filter_urls(t, () if a is None else list(a)) for t, a in zip(texts, allowed, strict=True)]
    return pd.DataFrame(rows, columns=["text", "removed", "linked"])


def escaped(text: Column) -> Column:
    """One line of text that opens no link, emphasis, code or HTML; what looks like a URL is left out."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, f"(?i){URL_RUN}", ""), r"(?U)\s+", " "))
    return F.regexp_replace(bare, r"([\\`*_\[\]<>&])", r"\\$1")


def destination(url: Column) -> Column:
    """A URL as a link's target."""
    plain = url
    for raw, coded in (("<", "%3C"), (">", "%3E"), (" ", "%20"), ("\r", "%0D"), ("\n", "%0A")):
        plain = F.replace(plain, F.lit(raw), F.lit(coded))
    return F.when(plain.rlike(r"[()]"), F.concat(F.lit("<"), plain, F.lit(">"))).otherwise(plain)


def bullet(title: Column, url: Column, text: Column, language: str = "en") -> Column:
    """`- [title](url) — text`."""
    named = F.coalesce(F.nullif(escaped(title), F.lit("")), F.lit(HEADINGS.get(language, HEADINGS["en"])[2]))
    said = F.coalesce(F.nullif(escaped(text), F.lit("")), F.lit(None).cast("string"))
    return F.concat(F.lit("- ["), named, F.lit("]("), destination(url), F.lit(")"), F.coalesce(F.concat(F.lit(" — "), said), F.lit("")))


def section(heading: Column | str, bullets: Column) -> Column:
    """A heading and its lines (an array in order)."""
    head = F.lit(heading) if isinstance(heading, str) else heading
    return F.concat(F.lit("## "), head, F.lit("\n"), F.array_join(bullets, "\n"))


def digest_sections(entries: DataFrame, key: str, language: str = "en") -> DataFrame:
    """Per digest its closing section (the first entries) and that of the entries the answer didn't link (null without any).

    entries: key, rank (from 1, in digest order), title, url, why_relevant, linked. A digest holds
    the items of one run, which its limit bounds.
    """
    closer, more, _ = HEADINGS.get(language, HEADINGS["en"])
    line = bullet(F.col("title"), F.col("url"), F.col("why_relevant"), language)
    lines = lambda test: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct(F.col("rank"), line.alias("line"))))), lambda x: x["line"])
    made = entries.groupBy(key).agg(lines(F.col("rank") <= CLOSER_LOOK).alias("first"), lines(~F.col("linked")).alias("left"))
    return made.select(key, section(closer, F.col("first")).alias("closing"), F.when(F.size("left") > 0, section(more, F.col("left"))).alias("more"))


def guarded(text: Column) -> Column:
    """A line that begins no heading, list, quote, rule or fence."""
    return F.regexp_replace(F.regexp_replace(text, r"^([#>+=~-])", r"\\$1"), r"^(\d{1,9})([.)])", r"$1\\$2")


def fallback_digests(entries: DataFrame, key: str, language: str = "en") -> DataFrame:
    """The digest of each key when no answer was usable: all entries with what they say, then the closing section.

    entries: key, rank (from 1, in digest order), title, url, headline, why_relevant. A digest holds the items
    of one run, which its limit bounds.
    """
    intro, heading = FALLBACKS.get(language, FALLBACKS["en"])
    why = guarded(escaped(F.col("why_relevant")))
    lines = F.struct(F.col("rank"), F.concat(bullet(F.col("title"), F.col("url"), F.col("headline"), language), F.lit("\n  "), why).alias("line"), bullet(F.col("title"), F.col("url"), F.col("why_relevant"), language).alias("short"))
    made = entries.groupBy(key).agg(F.array_sort(F.collect_list(lines)).alias("x"), F.count("*").alias("n"))
    told = F.replace(F.lit(intro), F.lit("{count}"), F.col("n").cast("string"))
    of = lambda some, name: F.transform(some, lambda x: x[name])
    closing = section(HEADINGS.get(language, HEADINGS["en"])[0], of(F.slice("x", 1, CLOSER_LOOK), "short"))
    return made.select(key, F.concat(told, F.lit("\n\n"), section(heading, of(F.col("x"), "line")), F.lit("\n\n"), closing).alias("text"))


def usable_url(url: Column) -> Column:
    """An http(s) URL that can stand in Markdown as it is."""
    return F.lower(url).rlike(r"^https?://") & ~url.rlike(r"[\s\x00-\x20\x7f<>\\]")


def without_fence(answer: Column) -> Column:
    """The inside of a text that is one fenced block, else the text."""
    inside = F.regexp_extract(answer, r"(?s)^\s*```(?:json|markdown|md)?[ \t]*\r?\n(.*?)\r?\n```[ \t]*\s*$", 1)
    return F.when(inside == "", answer).otherwise(inside)


def has_heading(text: Column) -> Column:
    """Whether a line is a heading, outside fences."""
    bare = F.regexp_replace(text, r"(?sm)^(```|~~~).*?(^\1|\z)", "")
    return bare.rlike(r"(?m)^ {0,3}#{1,6}[ \t]+\S")


def rendered(text: str) -> str:
    """Markdown as HTML that may be sent: no raw HTML, no images, links to http, https and mailto only."""
    return commonmark.html_of(commonmark.parse(text).root)


@F.pandas_udf(T.StringType())
def markdown_html(texts: pd.Series) -> pd.Series:
    return texts.map(rendered, na_action="ignore")
