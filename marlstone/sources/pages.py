"""Web pages: bytes to text, regions, links of a page as rows, and its text with a content hash."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.text import collapse, html_text, readable
from marlstone.functions.urls import canonical_url, fingerprint
from marlstone.session import ship
from marlstone.sources import tree

# Marks that tell an encoding; the labels that browsers read as each codec; the numbered families;
# the tags that HTML may begin with.
BYTE_ORDER_MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
LABELS = {
    "utf-8": "utf-8 utf8 unicode-1-1-utf-8 unicode11utf8 unicode20utf8 x-unicode20utf8",
    "utf-16-le": "utf-16 utf-16le ucs-2 unicode iso-10646-ucs-2 csunicode unicodefeff",
    "utf-16-be": "utf-16be unicodefffe",
    "cp1252": "ascii us-ascii ansi_x3.4-1968 latin1 l1 csisolatin1 iso-ir-100 ibm819 cp819",
    "cp1254": "latin5 l5 csisolatin5 iso-ir-148",
    "iso8859-2": "latin2 l2 csisolatin2", "iso8859-3": "latin3 l3 csisolatin3", "iso8859-4": "latin4 l4 csisolatin4",
    "iso8859-5": "cyrillic csisolatincyrillic", "iso8859-6": "arabic csisolatinarabic ecma-114 asmo-708",
    "iso8859-7": "greek greek8 csisolatingreek ecma-118 elot_928 sun_eu_greek", "iso8859-8": "hebrew visual logical csisolatinhebrew",
    "iso8859-10": "latin6 l6 csisolatin6", "iso8859-15": "l9 csisolatin9",
    "cp874": "tis-620 dos-874", "cp866": "866 ibm866 cp866 csibm866",
    "koi8-r": "koi8-r koi8_r koi8 koi cskoi8r", "koi8-u": "koi8-u koi8-ru",
    "mac-roman": "macintosh mac x-mac-roman csmacintosh", "mac-cyrillic": "x-mac-cyrillic x-mac-ukrainian",
    "gb18030": "gb18030 gbk x-gbk gb2312 gb_2312 gb_2312-80 chinese csgb2312 csiso58gb231280 iso-ir-58",
    "big5hkscs": "big5 big5-hkscs cn-big5 csbig5 x-x-big5",
    "euc_jp": "euc-jp x-euc-jp cseucpkdfmtjapanese", "iso2022_jp": "iso-2022-jp csiso2022jp",
    "cp932": "shift_jis shift-jis sjis x-sjis ms_kanji ms932 windows-31j csshiftjis",
    "cp949": "euc-kr euckr cseuckr korean csksc56011987 ks_c_5601-1987 ks_c_5601-1989 ksc5601 ksc_5601 windows-949 iso-ir-149",
}
_CODEC_OF = {label: codec for codec, labels in LABELS.items() for label in labels.split()}
_NUMBERED = re.compile(r"(?:windows-|cp|x-cp)(?P<page>125[0-8]|874)|iso[-_]?8859[-_]?(?P<part>[1-9]|1[013-6])(?:-[ei]|:\d{4})?")
HTML_STARTS = ("!doctype html", "html", "head", "script", "iframe", "h1", "div", "font", "table", "a", "style", "title", "b", "body", "br", "p", "!--")
#: A segment of so many characters has its full weight; one of less than this smoothed weight isn't main text.
FULL_CHARS, LEAST_WEIGHT = 200, 0.3


def chosen(nodes: Column, selector: str | None) -> Column:
    """The nodes whose text and links count: the body, or all that the selector matches."""
    return F.filter(nodes, lambda n: n["tag"] == "body") if selector is None else tree.matched(nodes, selector)


def region_text(nodes: Column, regions: Column) -> Column:
    """Readable text of the regions, joined by a space; a region inside another one counts with both."""
    return readable(F.array_join(F.transform(regions, lambda r: tree.node_text(nodes, r)), " "))


@F.pandas_udf(T.StringType())
def resolved(bases: pd.Series, hrefs: pd.Series) -> pd.Series:
    """The absolute http(s) address of a link; null for others and for what is no address."""

    def one(base: str | None, href: str | None) -> str | None:
        try:
            link = urljoin(base or "", (href or "").strip())
            return link if urlsplit(link).scheme in ("http", "https") and urlsplit(link).hostname else None
        except ValueError:  # such as an unclosed bracket
            return None

    return pd.Series([one(b, h) for b, h in zip(bases, hrefs, strict=True)], dtype=object)


def _trees(pages: DataFrame, *columns: str) -> DataFrame:
    ship(pages.sparkSession)
    return pages.select("page_id", *columns, tree.element_tree("html").alias("_t")).select("page_id", *columns, F.col("_t.nodes").alias("nodes"), F.col("_t.segments").alias("segments"))


def page_links(pages: DataFrame, url_pattern: str | None = None, selector: str | None = None) -> DataFrame:
    """Links of each page (page_id, url, html): canonical, the first place of each, not the page itself.

    With a pattern links of any host that it is found in, else those of the page's own host; with a selector
    only those in the regions it matches, which may be links themselves. The page's own base address counts.
    The fragment of a route (`#/...`, `#!...`) stays. A link without words has its address as title.
    """
    found = _trees(pages, "url").withColumn("regions", chosen(F.col("nodes"), selector))
    nodes, regions = F.col("nodes"), F.col("regions")
    anchors = F.filter(nodes, lambda n: (n["tag"] == "a") & F.map_contains_key(n["attrs"], "href") & F.exists(regions, lambda r: tree.within(n, r)))
    made = F.transform(anchors, lambda a: F.struct(F.try_element_at(a["attrs"], F.lit("href")).alias("href"), tree.node_text(nodes, a).alias("words")))
    base = tree.first_attribute(tree.matched(nodes, "base[href]"), "href")
    rows = found.select("page_id", "url", base.alias("base"), made.alias("anchors")).select("page_id", "url", "base", F.posexplode("anchors").alias("position", "a"))
    whole = rows.select("page_id", "url", F.col("position").cast("long").alias("position"), readable(F.col("a.words")).alias("title"), F.coalesce(resolved("url", "base"), F.col("url")).alias("base"), "a.href")
    linked = whole.select("page_id", "url", "position", "title", canonical_url(F.col("url")).alias("page_url"), resolved("base", "href").alias("raw"))
    if url_pattern is None:
        host = lambda c: F.lower(F.regexp_extract(c, r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
        linked = linked.where(host(F.col("raw")) == host(F.col("url")))
    route = F.regexp_extract("raw", r"#([/!].*)$", 0)
    links = linked.select("page_id", "position", "title", "page_url", F.concat(canonical_url(F.col("raw")), route).alias("link")).where("link <> page_url")
    if url_pattern is not None:
        links = links.where(F.col("link").rlike(url_pattern))
    first = links.groupBy("page_id", "link").agg(F.min(F.struct("position", "title")).alias("first"))
    return first.select("page_id", "link", "first.position", F.coalesce(F.nullif(F.col("first.title"), F.lit("")), F.col("link")).alias("title"))


def page_fingerprints(pages: DataFrame, selector: str | None = None) -> DataFrame:
    """Readable text of each page and its hash, by which a changed page is known; problem says why there is none.

    With a selector only of the regions that it matches; without a match the text is null and the problem
    selector_not_found. Empty text is valid.
    """
    found = _trees(pages).withColumn("regions", chosen(F.col("nodes"), selector))
    text = found.select("page_id", F.when(F.size("regions") > 0, region_text(F.col("nodes"), F.col("regions"))).alias("text"), (F.size("regions") == 0).alias("_none"))
    return text.select("page_id", "text", fingerprint(F.col("text")).alias("content_hash"), F.when(F.col("_none"), "selector_not_found").alias("problem"))


def page_title(html: Column, fallback: Column) -> Column:
    """The title of the document's head, else the fallback."""
    inner = html_text(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1))
    return F.coalesce(F.nullif(inner, F.lit("")), fallback)


def web_encoding(label: str | None) -> str | None:
    """The codec that browsers read an encoding's label as, or None for a label that the web doesn't know."""
    label = (label or "").strip().lower()
    if codec := _CODEC_OF.get(label):
        return codec
    numbered = _NUMBERED.fullmatch(label)
    if not numbered:
        return None
    if page := numbered["page"]:
        return f"cp{page}"
    return {"1": "cp1252", "9": "cp1254", "11": "cp874"}.get(numbered["part"], f"iso8859-{numbered['part']}")


def claims(content: bytes, content_type: str | None) -> Iterator[str]:
    """Codecs that a page may be in, the strongest claim first: byte order mark, header, the document's own word, UTF-8."""
    yield from (codec for mark, codec in BYTE_ORDER_MARKS if content[: len(mark)] == mark)
    if told := re.search(r"charset\s*=\s*[\"']?([^\s;\"']+)", content_type or "", re.IGNORECASE):
        yield from filter(None, [web_encoding(told[1])])
    if inner := re.search(r"<meta[^>]*charset\s*=\s*[\"']?([^\s;\"'/>]+)", content[:1024].decode("latin-1"), re.IGNORECASE):
        # A declaration that was read as ASCII can't be in UTF-16.
        yield from (codec for codec in [web_encoding(inner[1])] if codec and codec[:6] != "utf-16")
    yield "utf-8"


def decoded(content: bytes, content_type: str | None) -> str:
    """The page's text by its strongest claim; bytes that don't fit are replaced, a mark is left out."""
    return content.decode(next(claims(content, content_type)), "replace").removeprefix("\ufeff")


@F.pandas_udf(T.StringType())
def html_decoded(contents: pd.Series, content_types: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else decoded(bytes(c), t) for c, t in zip(contents, content_types, strict=True)], dtype=object)


def is_html(content_type: Column, text: Column) -> Column:
    """By the content type; without one, by how the text begins."""
    kind = F.lower(F.trim(F.substring_index(content_type, ";", 1)))
    starts = "|".join(re.escape(x) for x in HTML_STARTS)
    sniffed = F.lower(F.left(text, F.lit(1024))).rlike(rf"^[\s\x{{feff}}]*<(?:(?:{starts})[\s>]|!--)")
    return F.when(F.coalesce(kind, F.lit("")) != "", kind.isin("text/html", "application/xhtml+xml")).otherwise(sniffed)


def main_segments(segments: Column) -> Column:
    """The segments of a page that are its main text.

    Where articles hold at least half of the page's text, it is theirs, but for segments that are mostly links.
    Elsewhere each segment has a weight: its characters outside links, less those in links, up to
    `FULL_CHARS`; none beside the main text. The weight is smoothed with those of its neighbours, so short
    paragraphs between long ones stay and short lines among others go. A heading stays by its neighbours' weight.
    """
    clear = lambda s: F.greatest(s["chars"] - 2 * s["link_chars"], F.lit(0))
    total = lambda some: F.aggregate(some, F.lit(0), lambda n, s: n + clear(s))
    worded = lambda s: 2 * s["link_chars"] <= s["chars"]
    at = lambda w, i: F.coalesce(F.get(w, i), F.lit(0.0))

    def smooth(parts: Column, weights: Column) -> Column:
        around = lambda i: at(weights, i - 1) + at(weights, i + 1)
        enough = lambda s, i: F.when(s["heading"], around(i) >= 4 * LEAST_WEIGHT - 0.5).otherwise(around(i) + 2 * at(weights, i) >= 4 * LEAST_WEIGHT)
        return F.filter(parts, lambda s, i: worded(s) & enough(s, i))

    def judged(parts: Column) -> Column:
        inner = F.filter(parts, lambda s: s["main"])
        weights = F.transform(parts, lambda s: F.least(clear(s), F.lit(FULL_CHARS)) / FULL_CHARS)
        return F.when(2 * total(inner) >= F.greatest(total(parts), F.lit(1)), F.filter(inner, worded)).otherwise(tree.let(weights, lambda w: smooth(parts, w)))

    return tree.let(F.filter(segments, lambda s: ~s["beside"]), judged)


def extracted(pages: DataFrame, least: int = 200, most: int = 200_000, most_input: int = 4_000_000) -> DataFrame:
    """Main text, title, date and language of pages (page_id, url, html); problem says why there is no text.

    The text has a line for each segment of `main_segments`, or for all of the body's where none is one. One of
    fewer than `least` characters isn't a text (too_short), a longer one than `most` is cut at a word or line
    (truncated), and pages over `most_input` characters aren't read (too_large). The title is the one the page
    announces, else its head's, its first heading or the address; the date is midnight of the day that
    the page declares; the language its root's. A null page has nulls.
    """
    large = F.length("html") > most_input
    read = _trees(pages.select("page_id", "url", F.when(~large, F.col("html")).alias("html"), large.alias("_large")), "url", "_large")
    nodes, segments = F.col("nodes"), F.col("segments")
    lines = lambda some: F.array_join(F.transform(some, lambda s: s["text"]), "\n")
    words = read.withColumn("_main", main_segments(segments)).withColumn("_text", F.when(F.size("_main") > 0, lines(F.col("_main"))).otherwise(lines(segments)))
    head = F.left("_text", F.lit(most))
    cut = F.when(F.substring("_text", most + 1, 1).rlike(r"^\s"), head).otherwise(F.coalesce(F.nullif(F.regexp_extract(head, r"(?s)^(.+)[ \n]", 1), F.lit("")), head))
    long = F.length("_text") > most
    first = lambda selector: tree.let(tree.matched(nodes, selector), lambda x: tree.node_text(nodes, F.get(x, F.lit(0))))
    told = lambda selector, name: tree.first_attribute(tree.matched(nodes, selector), name)
    titles = [collapse(t) for t in (told("meta[property='og:title']", "content"), first("head > title"), first("h1"))]
    day = F.coalesce(*[F.try_to_timestamp(F.left(told(*x), F.lit(10)), F.lit("yyyy-MM-dd")) for x in (("meta[property='article:published_time']", "content"), ("time[datetime]", "datetime"))])
    language = F.lower(F.regexp_extract(told("html[lang]", "lang"), r"^\s*([A-Za-z]{2,3})(?:[-_].*)?\s*$", 1))
    short = F.length("_text") < least
    blank = lambda c: F.when(c != "", c)
    return words.select(
        "page_id", F.when(~short, F.when(long, F.rtrim(cut)).otherwise(F.col("_text"))).alias("text"),
        F.coalesce(*map(blank, titles), F.col("url")).alias("title"), day.alias("published"), blank(language).alias("language"),
        F.coalesce(long, F.lit(False)).alias("truncated"), F.when(F.col("_large"), "too_large").when(short, "too_short").alias("problem"),
    )
