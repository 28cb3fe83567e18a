"""Queries of scoring, source files and smaller operators over the driver's tables, and their SQL."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text
from marlstone.operators import answers, archive, items, lifecycle, runs, scoring, statistics
from marlstone.plans.registry import query
from marlstone.session import shared_folder, ship, stored, table
from marlstone.sources import discovery, files, listings, pages

NOW = "2024-01-20 12:00:00"


def _length_score(name: str):
    """A scorer for want of a model: the score is the request's length mod 101; some requests meet trouble, by the number they begin with."""
    last: list = [None, -1]  # the last request and its turn: a request's tries follow one another

    def scorer(purpose: str, content: str) -> scoring.Reply:
        key = int(content.partition("\n")[0])
        last[:] = content, last[1] + 1 if content == last[0] else 0
        turn = last[1]
        if name == "main" and key % 11 == 0:
            raise RuntimeError("out of order")
        repaired = content.endswith("alone.")
        if name == "main" and key % 7 == 0 and turn < 2 and not repaired:
            raise scoring.Passing("busy")
        if key % 5 == 0 and (not repaired or key % 10 == 0):
            return scoring.Reply('{"score": "high"}', len(content), 1)
        score = len(content.split("\n\nYour last")[0]) % 101 / 100
        return scoring.Reply(f'{{"score": {score}, "reason": "length", "key_points": []}}', len(content), 2)

    return scoring.Line(name, f"{name}-model", scorer)


def _scored(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("relevance").alias("purpose"), F.concat(F.col("doc_id").cast("string"), F.lit("\n"), F.coalesce("text", F.lit(""))).alias("content"))
    return scoring.answered(rows, [_length_score("main"), _length_score("spare")])


@query("""
SELECT doc_id AS id, CASE WHEN doc_id % 10 <> 0 THEN CAST(round((length(CAST(doc_id AS VARCHAR)) + 1 + length(coalesce(text, ''))) % 101 / 100.0, 2) AS DOUBLE) END AS relevance,
  CASE WHEN doc_id % 10 = 0 THEN 'failed' WHEN (length(CAST(doc_id AS VARCHAR)) + 1 + length(coalesce(text, ''))) % 101 >= 60 THEN 'relevant' ELSE 'skipped_irrelevant' END AS status FROM documents""")
def scored_items(spark, d):
    """Every document scored; every fifth needs a repair, every tenth stays invalid, others meet passing trouble or a dead scorer."""
    found = answers.rated(_scored(spark, d), "answer", "0.60")
    return found.select("id", F.col("relevance").cast("double").alias("relevance"), "status")


@query("""
WITH k AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'spare' ELSE 'main' END AS provider FROM documents)
SELECT provider, sum(1 + CAST(doc_id % 5 = 0 AS INT)) AS calls, CAST(sum(CASE WHEN doc_id % 10 = 0 THEN 2 WHEN doc_id % 5 = 0 THEN 3 ELSE 2 END) AS BIGINT) AS output_tokens, sum(CASE WHEN doc_id % 10 = 0 THEN 2 WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END) AS invalid FROM k GROUP BY provider""")
def scoring_usage(spark, d):
    """Calls and tokens by provider, those of invalid answers too."""
    used = scoring.usage(_scored(spark, d))
    return used.groupBy("provider").agg(F.count("*").alias("calls"), F.sum("output_tokens").alias("output_tokens"), F.count_if(F.col("outcome") == "invalid").alias("invalid"))


@query("""
SELECT page_id, page_id % 5 AS kind, CASE WHEN page_id % 5 < 4 THEN 'http://h.org/' || page_id END AS link, CASE WHEN page_id % 5 IN (1, 3) THEN '2024-03-05 06:00:00' END AS newest,
  CASE page_id % 5 WHEN 0 THEN 'rss' WHEN 1 THEN 'rdf' WHEN 2 THEN 'atom' WHEN 3 THEN 'json' END AS format FROM pages""")
def feed_formats(spark, d):
    """Feeds of every format with the page's title, and pages that are none."""
    key = F.col("page_id")
    link = F.concat(F.lit("http://h.org/"), key.cast("string"))
    body = F.when(key % 5 == 0, F.concat(F.lit("<?xml version='1.0'?><rss><channel><item><link>"), link, F.lit("</link></item></channel></rss>")))
    body = body.when(key % 5 == 1, F.concat(F.lit('<rdf:RDF xmlns:rdf="r" xmlns="http://purl.org/rss/1.0/" xmlns:dc="d"><channel><title>x</title></channel><item><title>t</title><link>'), link, F.lit("</link><dc:date>2024-03-05T08:00:00+02:00</dc:date></item></rdf:RDF>")))
    body = body.when(key % 5 == 2, F.concat(F.lit('<feed xmlns="a"><entry><link href="'), link, F.lit('"/></entry></feed>')))
    body = body.when(key % 5 == 3, F.concat(F.lit('{"version": "https://jsonfeed.org/version/1.1", "items": [{"id": "'), link, F.lit('", "date_published": "2024-03-05T08:00:00+02:00", "content_html": "<p>x"}]}'))).otherwise(F.col("html"))
    feeds = table(spark, d, "pages").select(key.alias("feed_id"), F.lit("http://h.org/").alias("base"), body.alias("body"))
    told = listings.feed_description(feeds)
    links = listings.feed_entries(feeds).select("feed_id", "link")
    return told.join(links, "feed_id", "left").select(F.col("feed_id").alias("page_id"), (F.col("feed_id") % 5).alias("kind"), "link", F.date_format("newest", "yyyy-MM-dd HH:mm:ss").alias("newest"), "format")


#: A folder has so many files at most, and there are so many folders at least: Spark lists over 32 folders by all tasks.
FILES_IN_FOLDER, LEAST_FOLDERS = 1000, 64


def _page_files(rows: DataFrame, folder: str) -> None:
    """A gzip file for each row of page_id and value, under the shared folder.

    Tasks write their files themselves where Arrow knows the store: Spark's writer moves each file and, without Hadoop's
    native library, starts a process or more for each file's permissions.
    """
    named = rows.select(F.col("page_id").cast("string").alias("page_id"), "value")
    dealt = named.repartition(max(LEAST_FOLDERS, 4 * rows.sparkSession.sparkContext.defaultParallelism), "page_id")
    try:
        fs.FileSystem.from_uri(folder)
    except (pa.ArrowException, OSError):  # a store that only Spark opens; tasks move their own files into place there
        dealt.write.partitionBy("page_id").option("compression", "gzip").option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(folder)
        return

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(folder)
        own, n = f"{base}/{TaskContext.get().partitionId()}", 0
        for frame in frames:
            for key, value in zip(frame["page_id"], frame["value"], strict=True):
                if n % FILES_IN_FOLDER == 0:
                    store.create_dir(f"{own}-{n // FILES_IN_FOLDER}", recursive=True)
                with store.open_output_stream(f"{own}-{n // FILES_IN_FOLDER}/page_id={key}-{n}.xml.gz", compression=None) as out:
                    out.write(gzip.compress(f"{value or ''}\n".encode(), 6, mtime=0))
                n += 1
        yield pd.DataFrame({"files": [n]})

    # In order, so a task that runs again writes the same files.
    dealt.sortWithinPartitions("page_id", "value").mapInPandas(write, "files long").write.format("noop").mode("overwrite").save()


@query("""
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'http://h.org/a' END AS link, CASE page_id % 3 WHEN 1 THEN 'no sitemap' WHEN 2 THEN 'no sitemap' END AS message FROM pages""")
def sitemap_files(spark, d):
    """A file for each page, read back by Spark: a sitemap, one that breaks off, or the page itself."""
    key, folder = F.col("page_id"), shared_folder(spark)
    whole = F.lit("<urlset><url><loc>/a</loc></url></urlset>")
    body = F.when(key % 3 == 0, whole).when(key % 3 == 1, F.left(whole, F.lit(30))).otherwise(F.col("html"))
    rows = table(spark, d, "pages").select(key, F.regexp_replace(body, r"[\r\n]", " ").alias("value"))
    ship(spark)
    _page_files(rows, folder)
    # Spark reads 32 small files in a task; a task goes through many such groups and writes one file of bodies.
    bodies = files.bodies(spark, folder).coalesce(4 * spark.sparkContext.defaultParallelism)
    read = files.sitemaps(stored(bodies), F.lit("http://h.org/"))  # both sides below read it: files are opened once
    found = read.rows.select("path", "link", F.lit(None).cast("string").alias("message")).unionByName(read.problems.select("path", F.lit(None).cast("string").alias("link"), "message"))
    return found.select(F.regexp_extract("path", r"page_id=(\d+)", 1).cast("long").alias("page_id"), "link", "message")


@query("""
WITH t AS (SELECT doc_id, ' ' || regexp_replace(lower(coalesce(text, '')), '[^a-z]+', ' ', 'g') || ' ' AS t FROM documents)
SELECT doc_id, array_to_string(list_filter([CASE WHEN contains(t, ' the ') THEN 'The' END, CASE WHEN contains(t, ' und ') THEN 'und' END, CASE WHEN contains(t, ' que ') THEN 'que' END], lambda x: x IS NOT NULL), ',') AS hits FROM t""")
def keyword_hits(spark, d):
    ship(spark)
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]+", " ")
    hits = items.keyword_hits(plain, any_=["The", " ", "und"], all_=["the"], exclude=["que"])
    return table(spark, d, "documents").select("doc_id", F.array_join(hits, ",").alias("hits"))


@query("SELECT o_custkey AS id, string_agg(p, ',' ORDER BY first) AS recipients FROM (SELECT o_custkey, o_orderpriority AS p, min(o_orderkey) AS first FROM orders GROUP BY 1, 2) GROUP BY 1")
def recipients(spark, d):
    """The priorities of a customer's orders, each once where it first stands."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"])
    rows = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(listed.alias("all"))
    return rows.select("id", F.array_join(items.ordered_distinct(F.col("all")), ",").alias("recipients"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O'")
def unfinished_runs(spark, d):
    status = F.when(F.col("o_orderstatus") == "O", "running").otherwise("succeeded")
    return runs.unfinished(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"))).select("id")


@query("SELECT user_id AS run_id, 'fetch_sources' AS stage, 'FetchError' AS error_class, CAST(event_id AS VARCHAR) AS source, 'no answer' AS message FROM events WHERE event_type = 'error'")
def source_errors(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").cast("string").alias("source"), F.when(F.col("event_type") == "error", "FetchError").alias("error_class"), F.lit("no\nanswer\x07").alias("message"))
    return statistics.source_errors(rows).drop("item_id")


@query("SELECT page_id, page_id % 4 <> 1 AS by_type, page_id % 4 <> 2 AS sniffed FROM pages")
def html_pages(spark, d):
    key = F.col("page_id") % 4
    kind = F.when(key == 0, "text/HTML; charset=utf-8").when(key == 1, "application/json").when(key == 2, "application/xhtml+xml").otherwise("text/html")
    body = F.when(key == 2, F.lit('{"a": 1}')).when(key == 3, F.concat(F.lit(" \n<!-- c -->"), "html")).otherwise(F.col("html"))
    return table(spark, d, "pages").select("page_id", pages.is_html(kind, body).alias("by_type"), pages.is_html(F.lit(""), body).alias("sniffed"))


@query("SELECT page_id, page_id % 4 IN (0, 1, 2) AS is_comments FROM pages")
def comment_feeds(spark, d):
    key = F.col("page_id") % 4
    root = F.regexp_extract("url", r"^[^/]*//[^/]*", 0)
    url = F.concat(root, F.when(key == 0, "/comments/feed").when(key == 1, "/x/comments/?p=1").otherwise("/feed"))
    title = F.when(key == 2, F.lit("Comments on: x")).otherwise("Posts")
    return table(spark, d, "pages").select("page_id", discovery.is_comment_feed(url, title).alias("is_comments"))


@query("""
WITH v AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r, ts FROM events)
SELECT user_id AS listing_id, count(*) AS videos, strftime(max(CAST(ts AS DATE)), '%Y-%m-%d') AS newest, string_agg('v' || event_id, ',' ORDER BY r) FILTER (WHERE r <= 5) AS titles FROM v GROUP BY 1""")
def listing_summaries(spark, d):
    rank = F.expr("row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC)")
    rows = table(spark, d, "events").select(F.col("user_id").alias("listing_id"), rank.alias("rank"), F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("title"), F.to_date("ts").alias("published"))
    return listings.listing_summary(rows).select("listing_id", "videos", F.date_format("newest", "yyyy-MM-dd").alias("newest"), F.array_join("titles", ",").alias("titles"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN 'partial' WHEN o_orderstatus = 'F' THEN 'succeeded' ELSE 'failed' END AS status FROM orders")
def lowered_statuses(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "succeeded").otherwise("failed")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), runs.lowered(status, F.col("o_orderkey") % 2 == 0).alias("status"))


@query("SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderkey = 7")
def run_by_id(spark, d):
    return runs.by_id(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")), 7)


@query(f"SELECT event_id AS id, event_id % 3 + CAST(event_type = 'error' AS INT) AS attempts, CASE WHEN event_type = 'error' THEN '{NOW}' END AS last_attempt_at FROM events")
def begun_attempts(spark, d):
    notes = table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % 3).alias("attempts"), F.lit(None).cast("timestamp").alias("last_attempt_at"), "event_type")
    made = lifecycle.begin_attempt(notes, F.col("event_type") == "error", F.lit(NOW).cast("timestamp"))
    return made.select("id", "attempts", F.date_format("last_attempt_at", "yyyy-MM-dd HH:mm:ss").alias("last_attempt_at"))


@query("""
SELECT o_custkey AS directory, 'Job ' || o_custkey AS name, count(*) || CASE WHEN count(*) = 1 THEN ' page' ELSE ' pages' END || ' · latest ' || strftime(max(o_orderdate), '%Y-%m-%d %H:%M') || ' UTC' AS detail FROM orders GROUP BY o_custkey""")
def archive_index(spark, d):
    made = table(spark, d, "orders").select(F.col("o_custkey").alias("directory"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("id"))
    jobs = table(spark, d, "customer").select(F.col("c_custkey").alias("directory"), F.concat(F.lit("Job "), F.col("c_custkey").cast("string")).alias("name"))
    return archive.global_index(archive.index_entries(archive.page_names(made)), jobs)


@query("""
SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN '$0.00' WHEN 1 THEN '$0.' || lpad(CAST(event_id % 10000 AS VARCHAR), 4, '0') WHEN 2 THEN '≥ $0.' || lpad(CAST(event_id % 10000 AS VARCHAR), 4, '0') || ' (2 calls without price)' ELSE 'unknown' END AS cost,
  'in ' || format('{:,}', event_id * 7) || ' · out 3 · total ' || format('{:,}', event_id * 7 + 3) AS tokens, CASE WHEN event_id % 2 = 0 THEN (event_id % 100) || '.5 s' ELSE '—' END AS duration FROM events""")
def usage_texts(spark, d):
    key = F.col("event_id")
    cost = F.when(key % 4 != 3, (key % 10000 / 10000).cast("decimal(18,6)"))
    start = F.lit(NOW).cast("timestamp")
    end = F.when(key % 2 == 0, F.timestamp_micros(F.unix_micros(start) + (key % 100) * 1_000_000 + 500_000))
    return table(spark, d, "events").select(
        key.alias("id"), text.cost_text(F.when(key % 4 == 0, 0).otherwise(5), cost, key % 4 == 1, F.when(key % 4 == 2, 2)).alias("cost"),
        text.tokens_text(key * 7, F.lit(3), key * 7 + 3).alias("tokens"), text.duration_text(start, end).alias("duration"),
    )
