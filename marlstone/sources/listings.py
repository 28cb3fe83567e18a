"""Feeds and sitemaps: XML bodies as rows of canonical links with their dates."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.text import collapse, html_text, teaser
from marlstone.functions.timing import clamp_age
from marlstone.functions.urls import VIDEO_ID, canonical_url, fingerprint
from marlstone.session import ship

MOST_ENTRIES = 500
# Titles and states of videos that can't be watched.
PLACEHOLDERS = ("[Private video]", "[Deleted video]")
HIDDEN = ("private", "premium_only", "subscriber_only", "needs_auth")
RSS = "channel STRUCT<item: ARRAY<STRUCT<title: STRING, link: STRING, description: STRING, pubDate: STRING>>>"
ATOM = "entry ARRAY<STRUCT<title: STRUCT<_VALUE: STRING, _type: STRING>, link: ARRAY<STRUCT<_href: STRING, _rel: STRING>>, published: STRING, updated: STRING, summary: STRUCT<_VALUE: STRING, _type: STRING>>>"
RDF = "item ARRAY<STRUCT<title: STRING, link: STRING, description: STRING, date: STRING>>"
JSON_FEED = "items ARRAY<STRUCT<id: STRING, url: STRING, external_url: STRING, title: STRING, summary: STRING, content_text: STRING, content_html: STRING, date_published: STRING, date_modified: STRING>>"
URLSET = "url ARRAY<STRUCT<loc: STRING, lastmod: STRING>>"
INDEX = "sitemap ARRAY<STRUCT<loc: STRING, lastmod: STRING>>"
_XML = {"attributePrefix": "_", "valueTag": "_VALUE", "mode": "PERMISSIVE", "ignoreNamespace": "true"}


@F.pandas_udf(T.StringType())
def resolved(links: pd.Series, bases: pd.Series) -> pd.Series:
    """Links against the address they stand at; null where that can't be."""

    def one(link, base):
        try:
            return urljoin(base or "", link.strip()) if link else None
        except ValueError:
            return None

    return pd.Series([one(a, b) for a, b in zip(links, bases, strict=True)], dtype=object)


def http_link(link: Column, base: Column) -> Column:
    """The canonical web address of a link, or null."""
    whole = canonical_url(resolved(link, base))
    host = r"^https?://(?:\[[0-9a-f:.]+\]|[^/?#:\[\]]+)"
    port = F.regexp_extract(whole, host + r":([^/?#]*)", 1)
    numbered = (port == "") | (port.rlike(r"^0*[1-9][0-9]{0,4}$") & (port.try_cast("int") <= 65535))
    return F.when(whole.rlike(host + r"(:[^/?#]*)?([/?#]|$)") & numbered, whole)


def w3c_date(text: Column) -> Column:
    """A year, a month or a full date or time; without an offset it is UTC. Null if none of these."""
    bare = F.trim(text)
    full = F.when(bare.rlike(r"^\d{4}$"), F.concat(bare, F.lit("-01-01"))).when(bare.rlike(r"^\d{4}-\d{2}$"), F.concat(bare, F.lit("-01"))).when(bare.rlike(r"^\d{4}-\d{2}-\d{2}"), bare)
    return F.try_to_timestamp(full)


def mail_date(text: Column) -> Column:
    """An RFC 822 date, with a zone of digits or GMT; null if it is none."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"^[A-Za-z]+,\s*", ""), r"\s+(GMT|UTC|UT|Z)$", " +0000")
    return F.coalesce(F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm Z")))


def first_of_each(entries: DataFrame, key: str) -> DataFrame:
    """The first entry of each link under its key, by position."""
    others = [c for c in entries.columns if c not in (key, "link")]
    return entries.groupBy(key, "link").agg(F.min_by(F.struct(*others), F.col("position")).alias("_first")).select(key, "link", "_first.*")


def sitemap_entries(maps: DataFrame, pattern: str | None = None, newer_than: Column | None = None, most: int = MOST_ENTRIES) -> DataFrame:
    """Entries of urlsets, from (map_id, base, body): map_id, position, link, lastmod.

    The pattern is searched before the age counts, both before repeats go, and the limit of kept
    entries comes last. Undated entries stay. A body that isn't XML has no entries.
    """
    ship(maps.sparkSession)
    rows = maps.select("map_id", "base", F.posexplode(F.from_xml(F.col("body"), URLSET, _XML)["url"]).alias("position", "e"))
    found = rows.select("map_id", "position", http_link(F.col("e.loc"), F.col("base")).alias("link"), w3c_date(F.col("e.lastmod")).alias("lastmod")).where("link IS NOT NULL")
    if pattern:
        found = found.where(F.col("link").rlike(pattern))
    if newer_than is not None:
        found = found.where(F.col("lastmod").isNull() | (F.col("lastmod") >= newer_than))
    kept = first_of_each(found, "map_id")
    # The entries of one map fit its body, so ranking them is a sort of bounded size.
    ranked = kept.selectExpr("*", "row_number() OVER (PARTITION BY map_id ORDER BY position) AS _rank")
    return ranked.where(F.col("_rank") <= most).drop("_rank").select("map_id", "position", "link", "lastmod")


def sitemap_children(maps: DataFrame) -> DataFrame:
    """The maps that index files name, from (map_id, base, body): map_id, position, link."""
    ship(maps.sparkSession)
    rows = maps.select("map_id", "base", F.posexplode(F.from_xml(F.col("body"), INDEX, _XML)["sitemap"]).alias("position", "e"))
    return first_of_each(rows.select("map_id", "position", http_link(F.col("e.loc"), F.col("base")).alias("link")).where("link IS NOT NULL"), "map_id").select("map_id", "position", "link")


def followed(maps: DataFrame, fetched: DataFrame, most_depth: int = 2, most_children: int = 50) -> DataFrame:
    """maps and the maps that their indexes lead to, by their bodies in fetched (url, body): map_id, base, body, depth.

    An index's first `most_children` children are followed, to `most_depth` levels; a map is read
    once for each map_id, and a child that wasn't fetched is skipped.
    """
    level = maps.select("map_id", "base", "body", F.lit(0).alias("depth"))
    every = level
    seen = level.select("map_id", F.col("base").alias("link"))
    for depth in range(1, most_depth + 1):
        # The children of one map fit its body, so ranking them is a sort of bounded size.
        children = sitemap_children(level).selectExpr("*", "row_number() OVER (PARTITION BY map_id ORDER BY position) AS _r").where(F.col("_r") <= most_children)
        new = children.select("map_id", "link").join(seen, ["map_id", "link"], "left_anti")
        level = new.join(fetched.select(F.col("url").alias("link"), "body"), "link").select("map_id", F.col("link").alias("base"), "body", F.lit(depth).alias("depth"))
        seen = seen.unionByName(new)
        every = every.unionByName(level)
    return every


def gunzipped(data: bytes, most: int) -> bytes | None:
    """The contents of all gzip members, one after another; None if one is damaged or they are larger than most."""
    import zlib

    out, rest = b"", data
    while rest.strip(b"\0"):
        member = zlib.decompressobj(31)
        try:
            out += member.decompress(rest, most + 1 - len(out))
        except zlib.error:
            return None
        if len(out) > most or not member.eof:
            return None
        rest = member.unused_data
    return out


def inflated(body: Column, most: int = 50 << 20) -> Column:
    """Text of a body that may be gzip, of any number of members; null if it is damaged or larger than `most` bytes."""

    @F.pandas_udf(T.StringType())
    def plain(bodies: pd.Series) -> pd.Series:
        def one(data: bytes) -> str | None:
            text = gunzipped(data, most) if data[:2] == b"\x1f\x8b" else data if len(data) <= most else None
            return None if text is None else text.decode("utf-8", "replace").removeprefix("\ufeff")

        return bodies.map(lambda b: one(bytes(b)), na_action="ignore")

    return plain(body)


def sitemap_description(maps: DataFrame) -> DataFrame:
    """Per map_id whether it is an index, its entries and newest date; bodies of neither kind are left out."""
    rows = maps.select("map_id", F.from_xml("body", URLSET, _XML)["url"].alias("u"), F.from_xml("body", INDEX, _XML)["sitemap"].alias("s"), F.col("body").rlike(r"<(\w+:)?sitemapindex\b").alias("is_index"), F.col("body").rlike(r"<(\w+:)?urlset\b").alias("is_set"))
    listed = F.filter(F.when(F.col("is_index"), F.col("s")).otherwise(F.col("u")), lambda e: F.coalesce(e["loc"], F.lit("")) != "")
    dates = F.transform(listed, lambda e: w3c_date(e["lastmod"]))
    return rows.where("is_index OR is_set").select("map_id", "is_index", F.coalesce(F.size(listed), F.lit(0)).cast("long").alias("entries"), F.array_max(dates).alias("newest"))


def feed_format(body: Column) -> Column:
    """rss, rdf, atom or json; null for what is no feed."""
    root = lambda name: body.rlike(rf"^\s*(?:<\?[^>]*\?>\s*|<!--(?s:.*?)-->\s*|<![A-Za-z][^>]*>\s*)*<(?:\w+:)?{name}[\s>]")
    return F.when(root("rss"), "rss").when(root("RDF"), "rdf").when(root("feed"), "atom").when(F.get_json_object(body, "$.version").startswith("https://jsonfeed.org/version/"), "json")


def feed_description(feeds: DataFrame) -> DataFrame:
    """What each feed (feed_id, base, body) is: format, broken (none, or nothing readable in it), entries and newest date."""
    per = feed_entries(feeds).groupBy("feed_id").agg(F.count("*").alias("entries"), F.max("published").alias("newest"))
    told = feeds.select("feed_id", feed_format(F.col("body")).alias("format"), F.from_xml(F.col("body"), RSS, _XML)["channel"].isNotNull().alias("_channel"))
    joined = told.join(per, "feed_id", "left")
    return joined.select("feed_id", "format", (F.col("format").isNull() | (F.col("entries").isNull() & ~((F.col("format") == "rss") & F.col("_channel")))).alias("broken"), F.coalesce("entries", F.lit(0)).alias("entries"), "newest")


def sitemap_summary(entries: DataFrame) -> DataFrame:
    return entries.groupBy("map_id").agg(F.count("*").alias("entries"), F.max("lastmod").alias("newest"))


def video_listing(entries: DataFrame, most: int) -> DataFrame:
    """Usable videos of each listing, newest first, then undated ones in their order, at most `most` of the listing's first.

    entries: listing_id, position, id, title, availability, published. Entries without a usable id
    or title, and hidden ones, are left out; the first of an id counts.
    """
    listed = entries.where(F.col("position") < most).withColumn("title", collapse(F.col("title")))
    known = listed.where(F.col("id").rlike(VIDEO_ID) & (F.col("title") != "") & ~F.col("title").isin(*PLACEHOLDERS) & ~F.coalesce(F.col("availability").isin(*HIDDEN), F.lit(False)))
    others = [c for c in known.columns if c not in ("listing_id", "id")]
    once = known.groupBy("listing_id", "id").agg(F.min_by(F.struct(*others), F.col("position")).alias("x")).select("listing_id", "id", "x.*")
    # A listing has at most `most` rows here.
    rank = F.expr("row_number() OVER (PARTITION BY listing_id ORDER BY published DESC NULLS LAST, position)")
    url = F.concat(F.lit("https://www.youtube.com/watch?v="), F.col("id"))
    return once.select("listing_id", rank.alias("rank"), "id", url.alias("url"), "title", "published")


def listing_summary(videos: DataFrame, shown: int = 5) -> DataFrame:
    """Per listing its videos, the newest date and the titles of the first ones."""
    titles = F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= shown, F.struct("rank", "title")))), lambda x: x["title"])
    return videos.groupBy("listing_id").agg(F.count("*").alias("videos"), F.max("published").alias("newest"), titles.alias("titles"))


def merged_sources(results: DataFrame, most_per_source: int) -> DataFrame:
    """Candidates of all sources of a job in the order of its sources, each source's first `most_per_source`."""
    rank = F.expr("row_number() OVER (PARTITION BY job_id, source_index ORDER BY position)")
    return results.withColumn("_r", rank).where(F.col("_r") <= most_per_source).drop("_r")


def feed_entries(feeds: DataFrame, now: Column | None = None, max_age_days: int | None = None) -> DataFrame:
    """Entries of RSS (1.0 too), Atom and JSON feeds, from (feed_id, base, body): feed_id, position, link, url_hash, title, published, teaser.

    A title or summary is HTML unless Atom says text. Without a title the link stands for it. The
    date is the published one, else the updated one. The first entry of each link counts.
    """
    ship(feeds.sparkSession)
    rss = feeds.select("feed_id", "base", F.posexplode(F.from_xml(F.col("body"), RSS, _XML)["channel"]["item"]).alias("position", "e"))
    plain = lambda part: F.when(F.coalesce(part["_type"], F.lit("text")) == "text", part["_VALUE"]).otherwise(html_text(part["_VALUE"]))
    items = rss.select("feed_id", "base", "position", F.col("e.link").alias("raw"), html_text(F.col("e.title")).alias("title"), mail_date(F.col("e.pubDate")).alias("published"), html_text(F.col("e.description")).alias("summary"))
    atom = feeds.select("feed_id", "base", F.posexplode(F.from_xml(F.col("body"), ATOM, _XML)["entry"]).alias("position", "e"))
    own = F.filter("e.link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    entries = atom.select("feed_id", "base", "position", F.get(own, F.lit(0))["_href"].alias("raw"), plain(F.col("e.title")).alias("title"), F.coalesce(w3c_date(F.col("e.published")), w3c_date(F.col("e.updated"))).alias("published"), plain(F.col("e.summary")).alias("summary"))
    rdf = feeds.where(feed_format(F.col("body")) == "rdf").select("feed_id", "base", F.posexplode(F.from_xml(F.col("body"), RDF, _XML)["item"]).alias("position", "e"))
    older = rdf.select("feed_id", "base", "position", F.col("e.link").alias("raw"), html_text(F.col("e.title")).alias("title"), w3c_date(F.col("e.date")).alias("published"), html_text(F.col("e.description")).alias("summary"))
    listed = feeds.where(feed_format(F.col("body")) == "json").select("feed_id", "base", F.posexplode(F.from_json("body", JSON_FEED)["items"]).alias("position", "e"))
    said = F.coalesce(F.col("e.summary"), F.col("e.content_text"), html_text(F.col("e.content_html")))
    json = listed.select("feed_id", "base", "position", F.coalesce(F.col("e.url"), F.col("e.external_url"), F.col("e.id")).alias("raw"), F.col("e.title").alias("title"), F.coalesce(w3c_date(F.col("e.date_published")), w3c_date(F.col("e.date_modified"))).alias("published"), said.alias("summary"))
    linked = items.unionByName(entries).unionByName(older).unionByName(json).withColumn("link", http_link(F.col("raw"), F.col("base"))).where("link IS NOT NULL")
    named = F.coalesce(F.nullif(collapse(F.col("title")), F.lit("")), F.col("link"))
    made = linked.select("feed_id", "position", "link", fingerprint(F.col("link")).alias("url_hash"), named.alias("title"), "published", teaser(F.col("summary")).alias("teaser"))
    found = first_of_each(made, "feed_id").select("feed_id", "position", "link", "url_hash", "title", "published", "teaser")
    if now is None or max_age_days is None:
        return found
    young, date = clamp_age(F.col("published"), now, max_age_days)
    return found.where(young).withColumn("published", date)
