"""Chunks, feeds, sitemaps, robots rules, transcripts and the candidate stream on small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from marlstone.functions import chunks, text
from marlstone.sources import listings, robots, transcripts
from marlstone.streaming import known


@pytest.mark.parametrize(("most", "overlap"), [(5, 0), (8, 3), (20, 5), (50, 49)])
def test_chunks_hold_all_words_within_the_limit(most, overlap):
    random.seed(most)
    body = "".join(random.choice(["word", "a", "x" * 90, ". ", " ", "\n\n", "\n", "ü! "]) for _ in range(400))
    made = chunks.split_text(body, most, overlap)
    assert all(0 < len(c) <= 4 * most for c in made)
    if not overlap:
        assert "".join("".join(made).split()) == "".join(body.split())


def test_chunks_cut_at_paragraphs_then_sentences_and_repeat_a_tail():
    assert chunks.split_text("One two.  Three four.\n\nFive.", 3) == ["One two.", "Three four.", "Five."]
    assert chunks.split_text("aaaa bbbb cccc dddd", 3, 1) == ["aaaa", "aaaa bbbb", "bbbb cccc", "cccc dddd"]
    assert chunks.split_text(" \n", 3) == [] and chunks.split_text(" a ", 3) == [" a "]
    with pytest.raises(ValueError, match="overlap"):
        chunks.split_text("a", 2, 2)


def test_chunk_rows(spark):
    frame = spark.createDataFrame([(1, "aaaa bbbb"), (2, None), (3, " ")], "id long, body string")
    assert [tuple(r) for r in chunks.chunks(frame, "id", "body", 1).collect()] == [(1, 0, "aaaa"), (1, 1, "bbbb")]


def test_text_columns(spark):
    frame = spark.createDataFrame([("Ünï  {date} & Co",), ("***",), (None,)], "t string")
    assert [r[0] for r in frame.select(text.slug(F.col("t"))).collect()] == ["uni-date-co", "job", None]
    assert frame.select(text.subject("{job_name}: {date} {x}", F.col("t"), F.lit("2026-01-02"))).first()[0] == "Ünï {date} & Co: 2026-01-02 {x}"
    tags = spark.createDataFrame([("<doc>a< /DOC x='1'>b<docs><b><doc",)], "t string")
    assert tags.select(text.neutral_tags(F.col("t"), ["doc"])).first()[0] == "‹doc›a‹ /DOC x='1'›b<docs><b>‹doc"


def test_robots(spark):
    body = "﻿User-agent: Reader/2.0\nUser-agent: b\nDisallow: /a\nAllow: /a/b\nCrawl-delay: x\nCrawl-delay: 2\n\nUser-agent: *\nDisallow: /\nSitemap: /s.xml\nUser-agent: reader\nDisallow: /*.pdf$ # no files\nDisallow: /a%7Eb\n"
    files = spark.createDataFrame([("https://h.org:443", body), ("https://all.org:443", "User-agent: *\nDisallow: /\nAllow: /\n"), ("https://no.org:443", "User-agent: *\nDisallow: /")], "origin string, body string")
    rules = robots.rules(files, "reader")
    want = {"https://h.org/": True, "https://h.org/a": False, "https://h.org/a/b?x": True, "https://h.org/x.pdf": False, "https://h.org/x.pdf?y": True, "https://h.org/q/x.PDF": True, "https://all.org/x": True, "https://no.org/x": False, "https://no.org/robots.txt": True, "https://other.org/": True, "https://h.org/A~b": True}
    found = robots.allowed(spark.createDataFrame([(u,) for u in want], "u string"), "u", rules)
    assert {r["u"]: r["allowed"] for r in found.collect()} == want
    assert rules.where("crawl_delay IS NOT NULL").select("origin", "crawl_delay").collect() == [("https://h.org:443", 2.0)]
    assert robots.sitemaps(files).select("link").collect() == [("/s.xml",)]


def test_sitemaps(spark):
    body = '<?xml version="1.0"?><urlset xmlns="http://x/0.9"><url><loc> /a?utm_x=1 </loc><lastmod>2024</lastmod></url><url><loc>http://b.org</loc></url><url><loc>/a</loc><lastmod>2025-01-01</lastmod></url><url><loc>mailto:x</loc></url></urlset>'
    maps = spark.createDataFrame([(1, "http://h.org/s.xml", body), (2, "http://h.org/", "no xml"), (3, None, None)], "map_id long, base string, body string")
    made = listings.sitemap_entries(maps)
    got = sorted((r["position"], r["link"], r["lastmod"] and str(r["lastmod"])) for r in made.withColumn("lastmod", F.date_format("lastmod", "yyyy-MM-dd")).collect())
    assert got == [(0, "http://h.org/a", "2024-01-01"), (1, "http://b.org/", None)]
    newer = listings.sitemap_entries(maps, newer_than=F.lit("2024-06-01").cast("timestamp"))
    assert sorted(r["link"] for r in newer.collect()) == ["http://b.org/", "http://h.org/a"]
    assert [r["link"] for r in listings.sitemap_entries(maps, pattern="b[.]org", most=1).collect()] == ["http://b.org/"]
    assert listings.sitemap_summary(made).select("entries").collect() == [(2,)]
    index = spark.createDataFrame([(1, "http://h.org/", "<sitemapindex><sitemap><loc>/1.xml</loc></sitemap><sitemap><loc>/1.xml</loc></sitemap></sitemapindex>")], "map_id long, base string, body string")
    assert listings.sitemap_children(index).collect() == [(1, 0, "http://h.org/1.xml")]


def test_feeds(spark):
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title type="html">A &lt;i&gt;b&lt;/i&gt;</title><link rel="self" href="/no"/><link href="/e1"/><updated>2024-02-01T00:00:00Z</updated><summary>plain &lt;x</summary></entry><entry><title/><link rel="alternate" href="/e2"/><published>2024-01-01T01:00:00+01:00</published><updated>2025-01-01T00:00:00Z</updated></entry></feed>'
    frame = spark.createDataFrame([(1, "http://h.org/f", atom)], "feed_id long, base string, body string")
    found = listings.feed_entries(frame).withColumn("published", F.date_format("published", "yyyy-MM-dd HH:mm")).orderBy("position").select("link", "title", "published", "teaser").collect()
    assert found == [("http://h.org/e1", "A b", "2024-02-01 00:00", "plain <x"), ("http://h.org/e2", "http://h.org/e2", "2024-01-01 00:00", None)]


def test_transcripts(spark):
    file = "﻿WEBVTT\n\nNOTE a --> b\nno\n\n1\n00:00 --> 00:01 align:left\nHi <c>there</c>\n\n00:01 --> 00:02\nHi there\nyou &amp; me\n \n"
    got = spark.createDataFrame([(file,), (None,)], "t string").select(transcripts.vtt_text("t")).collect()
    assert [r[0] for r in got] == ["Hi there you & me", None]
    tracks = [("v", 0, "fr", "fr", False, True), ("v", 1, "de", "de", True, False), ("v", 2, "en", "en", True, True), ("v", 3, "en-orig", "en", True, True), ("v", 4, "de", "de", False, True), ("v", 5, "fr", "fr", True, False)]
    frame = spark.createDataFrame(tracks, "video string, position long, key string, language string, automatic boolean, original boolean")
    assert [r["position"] for r in transcripts.ranked_tracks(frame, "de-AT", 9).orderBy("rank").collect()] == [4, 3, 2, 0, 1]


def test_stream_tells_new_changed_and_known_apart(spark, tmp_path):
    schema = "seq long, url_hash string, content_hash string"
    inbox, folder = str(tmp_path / "in"), f"file://{tmp_path}/state"
    for rows in ([(1, "a", "x"), (2, "a", "y"), (3, "b", None)], [(4, "a", "x"), (5, "b", "z"), (6, "c", "c")], [(7, "a", "q"), (8, "b", None)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
        known.follow(spark.readStream.schema(schema).parquet(inbox), folder).awaitTermination()
    got = {r["seq"]: r["kind"] for r in known.decisions(spark, folder).collect()}
    assert got == {1: "new", 3: "new", 4: "known", 5: "known", 6: "new", 7: "changed", 8: "known"}
