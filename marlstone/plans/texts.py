"""Queries of text, schedule, answer and source functions over the driver's tables, and their SQL."""

from __future__ import annotations

import importlib.util

from pyspark.sql import functions as F

from marlstone.functions import markdown, text, timing, urls
from marlstone.operators import answers, archive, items, runs, usage
from marlstone.plans import catalog
from marlstone.plans.registry import query
from marlstone.session import ship, table
from marlstone.sources import configs, discovery, listings, pages, transcripts

NOW = "2024-01-20 12:00:00"
#: Queries that read YAML are registered where its parser is installed.
with_yaml = query if importlib.util.find_spec("yaml") else (lambda sql: lambda f: f)
#: Usage rows, as catalog prices them.
_TOTAL = catalog._report_sql("model")


def _local(days: str, first: int, last: int, keep: str) -> str:
    """SQL for the first 07:30 in Berlin after a time, on the days that are kept."""
    return f"""SELECT event_id, CAST(min(timezone('Europe/Berlin', d + INTERVAL '7 hours 30 minutes') AT TIME ZONE 'UTC') AS VARCHAR) AS next_run FROM (
        SELECT event_id, timezone('UTC', ts) AS a, CAST({days} AS TIMESTAMP) AS d FROM (SELECT event_id, ts, CAST(timezone('Europe/Berlin', timezone('UTC', ts)) AS DATE) AS l FROM events), (SELECT unnest(range({first}, {last})) AS k)) WHERE {keep} AND timezone('Europe/Berlin', d + INTERVAL '7 hours 30 minutes') > a GROUP BY event_id"""


def _next(spark, d, made):
    return table(spark, d, "events").select("event_id", F.date_format(made(F.col("ts").cast("timestamp")), "yyyy-MM-dd HH:mm:ss").alias("next_run"))


@query(_local("l + CAST(k AS INTEGER)", -1, 9, "dayofweek(d) = 3"))
def next_run_weekly(spark, d):
    return _next(spark, d, lambda t: timing.next_weekly(t, 2, 7, 30, "Europe/Berlin"))


@query(_local("least(date_trunc('month', l - 1) + to_months(CAST(k AS INTEGER)) + INTERVAL 30 DAY, last_day(CAST(date_trunc('month', l - 1) + to_months(CAST(k AS INTEGER)) AS DATE)))", 0, 3, "TRUE"))
def next_run_monthly(spark, d):
    return _next(spark, d, lambda t: timing.next_monthly(t, 31, 7, 30, "Europe/Berlin"))


@query("SELECT event_id, CAST(CASE WHEN event_type = 'error' AND (event_id % 4 = 0 OR ts + to_hours(CAST(least(pow(2, least(event_id % 9 + 1, 6) - 1), 24) AS BIGINT)) < ts + INTERVAL 5 HOUR) THEN date_trunc('second', ts) + to_hours(CAST(least(pow(2, least(event_id % 9 + 1, 6) - 1), 24) AS BIGINT)) WHEN event_id % 4 <> 0 THEN date_trunc('second', ts) + INTERVAL 5 HOUR END AS VARCHAR) AS next_run FROM events")
def slot_or_retry(spark, d):
    done = F.date_trunc("second", F.col("ts").cast("timestamp"))
    status = F.when(F.col("event_type") == "error", "failed").otherwise("succeeded")
    regular = F.when(F.col("event_id") % 4 != 0, done + F.expr("interval 5 hours"))
    made = timing.slot_or_retry(status, done, regular, F.col("event_id") % 9 + 1)
    return table(spark, d, "events").select("event_id", F.date_format(made, "yyyy-MM-dd HH:mm:ss").alias("next_run"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(event_id % 100 AS DOUBLE) WHEN 1 THEN CAST(greatest(event_id % 60 - 30, 0) AS DOUBLE) WHEN 2 THEN 2.5 END AS seconds FROM events")
def retry_after(spark, d):
    key = F.col("event_id")
    now = F.lit(NOW).cast("timestamp")
    date = F.date_format(now + F.make_dt_interval(secs=(key % 60 - 30).cast("decimal(18,6)")), "EEE, dd MMM yyyy HH:mm:ss")
    header = F.when(key % 4 == 0, F.concat(F.lit(" "), (key % 100).cast("string"))).when(key % 4 == 1, F.concat(date, F.lit(" GMT"))).when(key % 4 == 2, "2.5").otherwise("soon")
    return table(spark, d, "events").select("event_id", timing.retry_after(header, now).alias("seconds"))


@query("SELECT event_id, CAST(CAST(timezone('Asia/Tokyo', timezone('UTC', ts)) AS DATE) AS VARCHAR) AS day FROM events")
def digest_dates(spark, d):
    return table(spark, d, "events").select("event_id", timing.local_day(F.col("ts").cast("timestamp"), "Asia/Tokyo").cast("string").alias("day"))


@query(f"""WITH r AS ({_TOTAL}) SELECT * FROM r UNION ALL SELECT NULL, CAST(sum(calls) AS BIGINT), CAST(sum(input_tokens) AS BIGINT), CAST(sum(output_tokens) AS BIGINT), sum(cost_usd), bool_and(cost_complete), array_to_string(list_sort(list(DISTINCT unpriced_models) FILTER (WHERE unpriced_models <> '')), ',') FROM r""")
def usage_report_total(spark, d):
    found = usage.with_total(usage.report(catalog._usage(spark, d), catalog._prices(spark), "model"), "model")
    return found.withColumns({"cost_usd": F.col("cost_usd").cast("double"), "unpriced_models": F.concat_ws(",", "unpriced_models")})


@query(f"WITH r AS ({_TOTAL}) SELECT model, '{{\"key\":\"' || model || '\",\"calls\":' || calls || ',\"input_tokens\":' || input_tokens || ',\"output_tokens\":' || output_tokens || ',\"cost_usd\":' || coalesce('\"' || CAST(CAST(cost_usd AS DECIMAL(28,6)) AS VARCHAR) || '\"', 'null') || ',\"cost_complete\":' || cost_complete || ',\"unpriced_models\":[' || CASE WHEN unpriced_models = '' THEN '' ELSE '\"' || unpriced_models || '\"' END || ']}}' AS document FROM r")
def usage_report_json(spark, d):
    return usage.report_json(usage.report(catalog._usage(spark, d), catalog._prices(spark), "model"), "model")


@query("SELECT p_partkey AS id, string_split(lower(p_name), ' ')[1] || '|' || lower(string_split(p_name, ' ')[2]) AS some, CASE WHEN lower(string_split(p_name, ' ')[1]) IN ('x') THEN '' ELSE 'x' END AS excluded FROM part")
def clean_keywords(spark, d):
    one, two = F.lower(F.split("p_name", " ")[0]), F.lower(F.split("p_name", " ")[1])
    some = F.array(F.concat(one, F.lit(" , "), F.upper(one)), F.concat(F.lit(" "), two), F.lit(" "))
    lists = items.clean_keywords(some, F.array().cast("array<string>"), F.array(F.upper(two), F.lit("x,X")))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), lists.alias("k"))
    return rows.select("id", F.array_join("k.any", "|").alias("some"), F.array_join("k.exclude", "|").alias("excluded"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'), ' ') AS line, replace(text, chr(10), chr(13)) IS NOT NULL AS known FROM documents")
def control_stripped(spark, d):
    dirty = F.concat(F.lit("\x1b[31m​"), F.replace("text", F.lit("\n"), F.lit("\r\x1b]0;t\x07")), F.lit("‮"))
    return table(spark, d, "documents").select("doc_id", text.strip_control(dirty).alias("line"), F.col("text").isNotNull().alias("known"))


@query("SELECT o_orderkey AS id, left(trim('Timeout: https://h.org/' || o_orderkey || ' key *** ' || repeat('x', CAST(o_orderkey % 700 AS INTEGER))), 500) AS error FROM orders")
def error_texts(spark, d):
    key = F.col("o_orderkey")
    said = F.concat(F.lit("https://u:p@h.org/"), key.cast("string"), F.lit("\n key sk-1 "), F.repeat(F.lit("x"), (key % 700).cast("int")))
    return table(spark, d, "orders").select(key.alias("id"), text.error_text(F.lit("Timeout"), said, ["sk-1"]).alias("error"))


@query("SELECT page_id, 'A title' AS title, left(regexp_replace(url, '[?#].*', ''), 500) AS shown FROM pages")
def item_references(spark, d):
    return table(spark, d, "pages").select("page_id", text.item_reference(F.lit(" A\n title "), F.concat(F.lit(""), F.col("url"))).alias("r")).select("page_id", "r.title", F.col("r.url").alias("shown"))


@query(r"SELECT doc_id, '<document>' || chr(10) || '<title>‹title›' || left(source, 493) || '</title>' || chr(10) || '<content>' || CASE WHEN length(text) > 4000 THEN left(text, 4000) || chr(10) || '[truncated]' ELSE text END || '</content>' || chr(10) || '</document>' AS message FROM documents WHERE text <> ''")
def rating_messages(spark, d):
    rows = table(spark, d, "documents").where("text <> ''")
    return rows.select("doc_id", text.document_message(F.lit(""), F.lit("")).alias("_"), F.concat(F.lit("<title>"), F.col("source")).alias("t"), "text").select("doc_id", text.rating_message(F.col("t"), F.lit(None).cast("string"), F.col("text")).alias("message"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '(?i)(?:[a-z][a-z0-9+.-]{0,31}://|www\.)[^\s<>\"''`()\[\]]*', '', 'g'), '[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'), '([\\`*_\[\]<>&])', '\\\1', 'g')) AS escaped FROM documents")
def markdown_escaped(spark, d):
    return table(spark, d, "documents").select("doc_id", markdown.escaped(F.col("text")).alias("escaped"))


@query("SELECT p_partkey AS id, '- [' || p_name || '](https://h.org/' || p_partkey || ') — ' || p_brand AS line FROM part")
def digest_bullets(spark, d):
    url = F.concat(F.lit("https://h.org/"), F.col("p_partkey").cast("string"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), markdown.bullet(F.col("p_name"), url, F.concat(F.col("p_brand"), F.lit(" www.x.y"))).alias("line"))


@query("""
WITH t AS (SELECT doc_id, doc_id % 6 AS k, 'https://h.org/' || doc_id AS url, 'x' || regexp_replace(coalesce(text, ''), '[^A-Za-z ]', ' ', 'g') AS plain FROM documents)
SELECT doc_id, plain || ' see [a](' || url || ') and note [1] (2024). ' || CASE k WHEN 0 THEN 'b' WHEN 1 THEN 'i' WHEN 2 THEN '' WHEN 3 THEN ' ' || url || '.' WHEN 4 THEN 'w' ELSE 'a [b]' END AS body,
  CAST(k <> 4 AS BIGINT) AS removed, TRUE AS is_linked FROM t""")
def filtered_urls(spark, d):
    """Whole texts with a link, a footnote beside a bracket, and one of six things that must go."""
    ship(spark)
    url, key = F.concat(F.lit("https://h.org/"), F.col("doc_id").cast("string")), F.col("doc_id") % 6
    plain = F.concat(F.lit("x"), F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z ]", " "))
    more = F.when(key == 0, "[b](http://bad.org/)").when(key == 1, F.concat(F.lit("![i]("), url, F.lit(")"))).when(key == 2, "<http://bad.org/>")
    more = more.when(key == 3, F.concat(url, F.lit("x "), url, F.lit("."))).when(key == 4, "<b>w</b>").otherwise("[a [b]](https:bad.org)")
    body = F.concat(plain, F.lit(" see [a]("), url, F.lit(") and note [1] (2024). "), more)
    found = table(spark, d, "documents").select("doc_id", markdown.filtered(body, F.array(url)).alias("f"), url.alias("url"))
    return found.select("doc_id", F.col("f.text").alias("body"), F.col("f.removed").alias("removed"), F.array_contains("f.linked", F.col("url")).alias("is_linked"))


@query("""
SELECT doc_id, '<h1>' || source || '</h1>' || chr(10) || '<p>x' || regexp_replace(coalesce(text, ''), '[^A-Za-z ]', ' ', 'g') || 'y <em>e</em> <strong>s</strong> <code>c</code> &lt;z</p>' || chr(10)
  || '<blockquote>' || chr(10) || '<p>q</p>' || chr(10) || '</blockquote>' || chr(10) || '<ol>' || chr(10) || '<li>a</li>' || chr(10) || '<li>b' || chr(10) || '<ul>' || chr(10) || '<li><a href="https://h.org/' || doc_id
  || '" rel="noopener noreferrer">' || source || '</a></li>' || chr(10) || '</ul></li>' || chr(10) || '</ol>' AS html FROM documents""")
def rendered_markdown(spark, d):
    """Whole texts as a paragraph among a heading, emphasis, code, a quote and nested lists."""
    ship(spark)
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z ]", " ")
    link = F.concat(F.lit("["), F.col("source"), F.lit("](https://h.org/"), F.col("doc_id").cast("string"), F.lit(")"))
    body = F.concat(F.lit("# "), F.col("source"), F.lit("\n\nx"), plain, F.lit("y *e* **s** `c` <z\n\n> q\n\n1. a\n2. b\n   - "), link, F.lit("\n"))
    return table(spark, d, "documents").select("doc_id", markdown.markdown_html(body).alias("html"))


@query("SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN CAST(round(event_id % 100 / 100.0, 2) AS DOUBLE) END AS relevance, CASE WHEN event_id % 5 <> 0 THEN 'failed' WHEN event_id % 100 >= 60 THEN 'relevant' ELSE 'skipped_irrelevant' END AS status FROM events")
def rated_items(spark, d):
    key = F.col("event_id")
    score = F.format_string("%.2f", (key % 100) / 100)
    good = F.concat(F.lit('```json\n{"score": '), score, F.lit(', "reason": " r ", "key_points": ["p"]}\n```'))
    bad = F.when(key % 5 == 1, '{"score": "0.9", "reason": "r", "key_points": []}').when(key % 5 == 2, '{"score": true, "reason": "r", "key_points": []}').when(key % 5 == 3, '{"score": 0.9, "reason": " ", "key_points": []}').otherwise("no")
    rows = table(spark, d, "events").select(key.alias("id"), F.when(key % 5 == 0, good).otherwise(bad).alias("answer"))
    return answers.rated(rows, "answer", "0.60").select("id", F.col("relevance").cast("double").alias("relevance"), "status")


@query("SELECT o_orderkey AS id, 'T' || o_orderkey AS headline, CAST(3 + o_orderkey % 4 AS BIGINT) AS bullets FROM orders WHERE o_orderkey % 8 < 4 AND o_orderkey % 3 <> 0")
def usable_entries(spark, d):
    key = F.col("o_orderkey")
    listed = F.array_join(F.transform(F.sequence(F.lit(1), (key % 8 + 3).cast("int")), lambda i: F.concat(F.lit('"b'), i.cast("string"), F.lit('"'))), ",")
    stored = F.concat(F.lit('{"headline": " T'), key.cast("string"), F.lit('", "why_relevant": "w", "bullets": ['), listed, F.lit("]}"))
    rows = table(spark, d, "orders").select(key.alias("id"), F.lit("summarized").alias("status"), stored.alias("summary"), F.when(key % 3 == 0, "ftp://h.org/").otherwise("https://h.org/a").alias("url"))
    found = answers.usable_entries(rows, "summary", markdown.usable_url(F.col("url")))
    return found.select("id", "entry.headline", F.size("entry.bullets").cast("long").alias("bullets"))


@query()
def summary_requests(spark, d):
    return answers.summary_requests(table(spark, d, "documents"), "doc_id", "text")


def _summarised(requests):
    """Requests with their answers: for want of a model, each word of the whole request once, where it first stands."""
    return requests.withColumn("summary", F.array_join(F.array_distinct(F.split("content", r"\s+")), " "))


@query()
def summary_groups(spark, d):
    """Each part's summary in groups to combine; every part of every document."""
    parts = _summarised(answers.summary_requests(table(spark, d, "documents"), "doc_id", "text", most=None))
    return answers.grouped_parts(parts, "doc_id", "part", "summary")


@query()
def combined_summaries(spark, d):
    """One summary of each whole document, made in rounds."""
    parts = _summarised(answers.summary_requests(table(spark, d, "documents"), "doc_id", "text", most=None))
    found, _ = answers.combined(parts, "doc_id", "part", "summary", _summarised)
    return found


@query("SELECT p_partkey AS id, 'h-' || CAST(p_partkey AS VARCHAR) AS youtube, CASE WHEN p_partkey % 2 = 0 THEN 'PL' || p_partkey END AS list, 'v' || p_partkey AS video FROM part")
def video_addresses(spark, d):
    key = F.col("p_partkey").cast("string")
    channel = urls.video_channel(F.concat(F.lit("https://www.youtube.com/@H-"), key, F.lit("/videos")))
    playlist = urls.video_playlist(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("https://youtube.com/playlist?list=PL"), key)).otherwise("https://other.org/?list=x"))
    video = urls.video_id(F.concat(F.lit("https://m.youtube.com/watch?t=1&v=v"), key))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.regexp_replace(channel, "^handle:", "").alias("youtube"), playlist.alias("list"), video.alias("video"))


@query("""SELECT user_id AS listing_id, event_id % 900 AS id, row_number() OVER (PARTITION BY user_id ORDER BY published DESC NULLS LAST, position) AS rank FROM (
    SELECT user_id, event_id, event_id AS position, CASE WHEN event_id % 7 <> 0 THEN CAST(ts AS DATE) END AS published, event_type FROM events WHERE event_type <> 'error' AND event_id % 13 <> 0)
    QUALIFY row_number() OVER (PARTITION BY user_id, event_id % 900 ORDER BY position) = 1""".replace("SELECT user_id AS listing_id, event_id % 900 AS id, row_number()", "WITH f AS (SELECT * FROM (SELECT user_id, event_id, event_id AS position, CASE WHEN event_id % 7 <> 0 THEN CAST(ts AS DATE) END AS published FROM events WHERE event_type <> 'error' AND event_id % 13 <> 0) QUALIFY row_number() OVER (PARTITION BY user_id, event_id % 900 ORDER BY position) = 1) SELECT user_id AS listing_id, CAST(event_id % 900 AS VARCHAR) AS id, row_number()").split(" FROM (\n")[0] + " FROM f")  # fmt: skip
def video_listings(spark, d):
    key = F.col("event_id")
    title = F.when(key % 13 == 0, " [Private   video] ").otherwise("A  title")
    hidden = F.when(F.col("event_type") == "error", "needs_auth").when(F.col("event_type") == "view", "public")
    rows = table(spark, d, "events").select(F.col("user_id").alias("listing_id"), key.alias("position"), (key % 900).cast("string").alias("id"), title.alias("title"), hidden.alias("availability"), F.when(key % 7 != 0, F.to_date("ts")).alias("published"))
    return listings.video_listing(rows, 10**9).select("listing_id", "id", "rank")


@query("SELECT user_id AS job_id, event_id % 3 AS source_index, event_id AS position FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY event_id) <= 4")
def merged_sources(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("job_id"), (F.col("event_id") % 3).alias("source_index"), F.col("event_id").alias("position"))
    return listings.merged_sources(rows, 4)


@query("SELECT user_id AS target_id, event_type AS kind_of, min(CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 4 END * 10000000 + event_id) % 10000000 AS position FROM events GROUP BY 1, 2")
def discovered_sources(spark, d):
    key = F.col("event_id")
    locator = F.concat(F.lit("https://H.org:443/"), F.col("event_type"), F.lit("?utm_source="), key.cast("string"))
    rows = table(spark, d, "events").select(F.col("user_id").alias("target_id"), F.lit("feed").alias("kind"), locator.alias("locator"), F.when(key % 3 == 0, "direct").when(key % 3 == 1, "probed").otherwise("robots").alias("origin"), key.alias("position"), F.lit("t").alias("title"))
    found = discovery.merged(rows)
    return found.select("target_id", F.regexp_extract("shown", r"([a-z]+)$", 1).alias("kind_of"), "position")


@query("SELECT page_id, 2 AS entries, CASE WHEN page_id % 2 = 0 THEN TRUE ELSE FALSE END AS is_index, CASE WHEN page_id % 2 = 1 THEN '2024-03-01 00:00:00' END AS newest FROM pages")
def sitemap_descriptions(spark, d):
    index = '<sitemapindex><sitemap><loc>http://a.org/1.xml</loc></sitemap><sitemap><loc>http://a.org/2.xml</loc></sitemap></sitemapindex>'
    entries = '<urlset><url><loc>http://a.org/1</loc><lastmod>2024-03</lastmod></url><url><loc>http://a.org/2</loc></url><url><lastmod>2025</lastmod></url></urlset>'
    maps = table(spark, d, "pages").select(F.col("page_id").alias("map_id"), F.when(F.col("page_id") % 2 == 0, index).otherwise(entries).alias("body"))
    return listings.sitemap_description(maps).select(F.col("map_id").alias("page_id"), "entries", "is_index", F.date_format("newest", "yyyy-MM-dd HH:mm:ss").alias("newest"))


@query("SELECT page_id, 'http://a.org/' || k AS link FROM pages, (SELECT unnest(range(0, 3)) AS k) WHERE k < 2 OR page_id % 2 = 0")
def followed_sitemaps(spark, d):
    one = "<urlset><url><loc>http://a.org/0</loc></url></urlset>"
    two = "<urlset><url><loc>http://a.org/1</loc></url></urlset>"
    three = "<urlset><url><loc>http://a.org/2</loc></url></urlset>"
    index = lambda *names: "<sitemapindex>" + "".join(f"<sitemap><loc>{n}</loc></sitemap>" for n in names) + "</sitemapindex>"
    bodies = [("http://a.org/one.xml", one), ("http://a.org/two.xml", two), ("http://a.org/three.xml", three), ("http://a.org/inner.xml", index("two.xml", "one.xml", "inner.xml")), ("http://a.org/deep.xml", index("deeper.xml")), ("http://a.org/deeper.xml", index("last.xml")), ("http://a.org/last.xml", one)]
    fetched = spark.createDataFrame(bodies, "url string, body string")
    top = F.when(F.col("page_id") % 2 == 0, index("inner.xml", "one.xml", "three.xml", "gone.xml")).otherwise(index("one.xml", "inner.xml", "deep.xml"))
    maps = table(spark, d, "pages").select(F.col("page_id").alias("map_id"), F.lit("http://a.org/sitemap.xml").alias("base"), top.alias("body"))
    return listings.sitemap_entries(listings.followed(maps, fetched).drop("depth")).select(F.col("map_id").alias("page_id"), "link")


@query("SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
def decoded_pages(spark, d):
    body = F.when(F.col("doc_id") % 3 == 0, F.encode("text", "UTF-8")).when(F.col("doc_id") % 3 == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE"))).otherwise(F.encode("text", "UTF-16LE"))
    kind = F.when(F.col("doc_id") % 3 == 2, "text/html; charset=utf-16").otherwise("text/html")
    ship(spark)
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", pages.html_decoded(body, kind).alias("text"))


@query("""
WITH a AS (
  SELECT event_id AS id, event_id % 5 AS k, event_id // 5 % 8 AS f, event_id * 37 % 256 AS o1, event_id * 101 % 256 AS o2, event_id * 7 % 256 AS o3 FROM events),
b AS (
  SELECT *, NOT (o1 IN (0, 10, 127) OR o1 >= 224 OR (o1 = 100 AND o2 BETWEEN 64 AND 127) OR (o1 = 169 AND o2 = 254) OR (o1 = 172 AND o2 BETWEEN 16 AND 31)
    OR (o1 = 192 AND (o2 = 168 OR (o2 = 0 AND o3 IN (0, 2)) OR (o2 = 88 AND o3 = 99))) OR (o1 = 198 AND (o2 IN (18, 19) OR (o2 = 51 AND o3 = 100)))
    OR (o1 = 203 AND o2 = 0 AND o3 = 113)) AS open FROM a)
SELECT id, CASE WHEN k < 3 THEN open WHEN k = 3 THEN f >= 6 ELSE FALSE END AS is_public FROM b""")
def public_addresses(spark, d):
    """IPv4 addresses all over the range, alone and inside IPv6, other IPv6 ones, and what is never public."""
    ship(spark)
    key = F.col("event_id")
    four = F.concat_ws(".", *[(key * k % 256).cast("string") for k in (37, 101, 7)], F.lit("8"))
    six = F.array(*map(F.lit, ("fec0::1", "5f00::1", "2001:db8::1", "fd00::1", "fe80::1", "ff02::1", "2001:4860:4860::8888", "2606:4700::1")))
    other = F.when(key % 2 == 0, F.concat(F.lit("192.88.99."), (key % 256).cast("string"))).otherwise(F.concat(F.lit("host"), key.cast("string")))
    ip = F.when(key % 5 == 0, four).when(key % 5 == 1, F.concat(F.lit("::ffff:"), four)).when(key % 5 == 2, F.concat(F.lit("64:ff9b::"), four)).when(key % 5 == 3, six[F.floor(key / 5) % 8]).otherwise(other)
    return table(spark, d, "events").select(key.alias("id"), discovery.public_address(ip).alias("is_public"))


@query("SELECT event_id AS id, CASE event_type WHEN 'error' THEN (event_id % 600 IN (408, 425, 429) OR event_id % 600 BETWEEN 500 AND 599) WHEN 'click' THEN TRUE ELSE FALSE END AS passing FROM events")
def passing_failures(spark, d):
    reason = F.when(F.col("event_type") == "error", "http_status").when(F.col("event_type") == "click", "timeout").otherwise("not_html")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), discovery.passing_failure(reason, F.when(F.col("event_type") == "error", F.col("event_id") % 600)).alias("passing"))


@query("SELECT doc_id, CASE WHEN b = '' THEN '' ELSE b END AS said FROM (SELECT doc_id, trim(regexp_replace(split_part(text, chr(10), 1), '\\s+', ' ', 'g')) AS b FROM documents WHERE text IS NOT NULL AND NOT contains(text, '<') AND NOT contains(text, '&') AND NOT contains(text, '-->'))")
def vtt_texts(spark, d):
    line = F.substring_index("text", "\n", 1)
    rows = table(spark, d, "documents").where("text IS NOT NULL AND NOT contains(text, '<') AND NOT contains(text, '&') AND NOT contains(text, '-->')")
    file = F.concat(F.lit("WEBVTT\n\nNOTE a\n00:00 --> 00:01\n\nNOTEBOOK-1\n00:00 --> 00:01\n<b>"), line, F.lit("</b>\n"), line, F.lit("\n\nSTYLE\nx\n\n00:02 --> 00:03\n"), line, F.lit("\n"))
    ship(spark)
    return rows.select("doc_id", transcripts.vtt_text(file).alias("said"))


@query("SELECT o_orderkey AS id, strftime(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP), '%Y-%m-%d-%H%M') || CASE WHEN n > 1 THEN '-' || n ELSE '' END || '.html' AS page, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, n DESC) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS n FROM orders))")
def archive_pages(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("directory"), F.to_date("o_orderdate").cast("timestamp").alias("created_at"))
    return archive.index_entries(archive.page_names(rows)).select("id", "page", "rank")


@query("SELECT n_name AS name, CASE n_nationkey % 2 WHEN 0 THEN 'nation' ELSE 'nation-' || left(sha256(n_name), 8) END AS directory FROM nation WHERE n_nationkey < 2")
def archive_directories(spark, d):
    # Two jobs whose names make one slug: the older keeps it.
    rows = table(spark, d, "nation").where("n_nationkey < 2").select(F.concat(F.lit("Nation!"), F.repeat(F.lit(" "), F.col("n_nationkey").cast("int"))).alias("name"), F.col("n_nationkey").alias("first_at"), F.col("n_name").alias("shown"))
    made = archive.job_directories(rows)
    own = F.when(F.col("directory") == "nation", "nation").otherwise(F.concat(F.lit("nation-"), F.left(F.sha2("shown", 256), F.lit(8))))
    return made.select(F.col("shown").alias("name"), F.when(F.col("directory").rlike("^nation(-[0-9a-f]{8})?$"), own).alias("directory"))


@query("""WITH e AS (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r, '- [' || p_name || '](https://h.org/' || p_partkey || ') — ' || p_type AS line, p_partkey % 3 = 0 AS linked FROM part)
    SELECT p_brand, '## Worth a closer look' || chr(10) || string_agg(line, chr(10) ORDER BY r) FILTER (WHERE r <= 3) AS closing, '## More items' || chr(10) || string_agg(line, chr(10) ORDER BY r) FILTER (WHERE NOT linked) AS more FROM e GROUP BY p_brand""")
def digest_sections(spark, d):
    rank = F.expr("row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)")
    url = F.concat(F.lit("https://h.org/"), F.col("p_partkey").cast("string"))
    rows = table(spark, d, "part").select("p_brand", rank.alias("rank"), F.col("p_name").alias("title"), url.alias("url"), F.col("p_type").alias("why_relevant"), (F.col("p_partkey") % 3 == 0).alias("linked"))
    return markdown.digest_sections(rows, "p_brand")


@query("""WITH e AS (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r, '- [' || p_name || '](https://h.org/' || p_partkey || ') — ' AS line, p_type, p_size FROM part)
    SELECT p_brand, 'The automatic summary of this run could not be written. Here are all ' || count(*) || ' items, most relevant first.' || chr(10) || chr(10) || '## All items' || chr(10)
      || string_agg(line || p_type || chr(10) || '  ' || CASE WHEN p_size % 2 = 0 THEN chr(92) || '# ' ELSE p_size || chr(92) || '. ' END || p_type, chr(10) ORDER BY r) || chr(10) || chr(10)
      || '## Worth a closer look' || chr(10) || string_agg(line || CASE WHEN p_size % 2 = 0 THEN '# ' ELSE p_size || '. ' END || p_type, chr(10) ORDER BY r) FILTER (WHERE r <= 3) AS text FROM e GROUP BY p_brand""")
def fallback_digests(spark, d):
    rank = F.expr("row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)")
    url = F.concat(F.lit("https://h.org/"), F.col("p_partkey").cast("string"))
    why = F.concat(F.when(F.col("p_size") % 2 == 0, "# ").otherwise(F.concat(F.col("p_size").cast("string"), F.lit(". "))), F.col("p_type"))
    rows = table(spark, d, "part").select("p_brand", rank.alias("rank"), F.col("p_name").alias("title"), url.alias("url"), F.col("p_type").alias("headline"), why.alias("why_relevant"))
    return markdown.fallback_digests(rows, "p_brand")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 'plain' ELSE '# ' || source END AS body, doc_id % 3 <> 2 AS heading FROM documents")
def unfenced_answers(spark, d):
    title = F.concat(F.lit("# "), F.col("source"))
    answer = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" ```markdown\n"), title, F.lit("\n``` \n"))).when(F.col("doc_id") % 3 == 1, title).otherwise("plain")
    body = markdown.without_fence(answer)
    return table(spark, d, "documents").select("doc_id", body.alias("body"), markdown.has_heading(body).alias("heading"))


EXTRACTED_SQL = """
WITH parts AS (
  SELECT page_id, url, page_id % 7 = 0 AS dated, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS language, html,
    regexp_extract(html, '<title>(.*?)</title>', 1) AS title, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS art FROM pages),
lines AS (
  SELECT *, list_transform(string_split(regexp_replace(regexp_replace(replace(art, chr(10), ' '), '</?(?:h1|p|br)>', chr(10), 'g'), '<[^>]*>', '', 'g'), chr(10)),
    lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(x, '&quot;', '"'), '&#x27;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[ \t\r]+', ' ', 'g'))) AS line FROM parts),
whole AS (SELECT *, array_to_string(list_filter(line, lambda x: x <> ''), chr(10)) AS text FROM lines)
SELECT page_id, CASE WHEN length(text) >= 200 THEN text END AS text, trim(replace(title, '&amp;', '&')) AS title,
  CASE WHEN dated THEN '2024-03-05 00:00:00' END AS published, language, CASE WHEN length(text) < 200 THEN 'too_short' END AS problem
FROM whole
"""


@query(EXTRACTED_SQL)
def extracted_texts(spark, d):
    """Every page; every seventh declares a date in its head."""
    dated = F.replace(F.col("html"), F.lit("</head>"), F.lit('<meta property="article:published_time" content="2024-03-05T08:00:00+02:00"></head>'))
    rows = table(spark, d, "pages").select("page_id", "url", F.when(F.col("page_id") % 7 == 0, dated).otherwise(F.col("html")).alias("html"))
    return pages.extracted(rows).select("page_id", "text", "title", F.date_format("published", "yyyy-MM-dd HH:mm:ss").alias("published"), "language", "problem")


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN 'Europe/Berlin' ELSE 'UTC' END AS zone FROM events")
def known_zones(spark, d):
    zone = F.when(F.col("event_type") == "view", "Europe/Berlin").when(F.col("event_type") == "click", "Mars/Base")
    zones = spark.createDataFrame([("Europe/Berlin",), ("UTC",)], "zone string")
    return runs.known_zones(table(spark, d, "events").select("event_id", zone.alias("zone")), "zone", zones)


@with_yaml("""
SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'schedule.weekday,sources' WHEN 2 THEN 'name,schedule.frequency,schedule.time,sources' END AS problems, c_custkey % 4 = 3 AS broken,
  CASE c_custkey % 4 WHEN 0 THEN '0' || c_custkey WHEN 1 THEN 'yes' END AS name FROM customer""")
def job_files(spark, d):
    """Names that look like octal numbers and truth values stay texts; repeated keys break a file."""
    key = F.col("c_custkey") % 4
    good = F.concat(F.lit("base: &b {frequency: monthly, day_of_month: 31}\nname: 0"), F.col("c_custkey").cast("string"), F.lit("\nschedule: {<<: *b, time: '07:30'}\nsources:\n  - {type: rss, url: http://h.org/}\n"))
    body = F.when(key == 0, good).when(key == 1, "name: yes\nschedule: {frequency: weekly, time: '07:30'}\n").when(key == 2, "other: 1\n").otherwise("name: a\nname: b\n")
    found = configs.jobs(table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("path"), body.alias("text")))
    return found.select(F.col("path").cast("long").alias("id"), F.array_join("problems", ",").alias("problems"), F.col("problem").isNotNull().alias("broken"), F.get_json_object("document", "$.name").alias("name"))


@with_yaml("""
SELECT 'n' || c_custkey AS provider, CASE c_custkey % 5 WHEN 0 THEN 'm' || c_custkey WHEN 2 THEN 'm' || c_custkey WHEN 3 THEN 'shared' END AS model,
  CASE WHEN c_custkey % 5 = 0 THEN CAST(c_custkey + 0.25 AS DOUBLE) END AS price, CASE WHEN c_custkey % 5 = 0 THEN CAST(1000 AS BIGINT) END AS context, c_custkey % 5 <> 0 AS wrong FROM customer""")
def model_files(spark, d):
    """Registry files: a right one, another's name, a negative price, an id that other files have, a repeated key."""
    key = F.col("c_custkey") % 5
    name = F.concat(F.lit("n"), F.col("c_custkey").cast("string"))
    model = F.when(key == 3, "shared").otherwise(F.concat(F.lit("m"), F.col("c_custkey").cast("string")))
    price = F.when(key == 2, "-1").otherwise((F.col("c_custkey") + 0.25).cast("string"))
    entry = F.concat(F.lit("models:\n  "), model, F.lit(": {output_price_per_mtok: 2, context_window: 1000, input_price_per_mtok: "), price, F.lit("}\n"))
    body = F.concat(F.lit("schema_version: 1\nprovider: "), F.when(key == 1, "other").otherwise(name), F.lit("\n"), entry, F.when(key == 4, "models: {}\n").otherwise(""))
    found = configs.models(table(spark, d, "customer").select(F.concat(F.lit("/models.d/"), name, F.lit(".yaml")).alias("path"), body.alias("text")))
    return found.select("provider", "model", F.col("input_price_per_mtok").cast("double").alias("price"), F.col("context_window").alias("context"), F.col("problem").isNotNull().alias("wrong"))