"""Queries over the driver's tables, one for each operator, and their SQL where SQL can express them.

The tables stand in for the pipeline's own: events for usage and runs (user_id is the job,
event_type the model or status), orders for jobs and items, documents for candidates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import chunks, text, timing, urls
from marlstone.operators import items, runs, usage
from marlstone.plans.registry import REGISTRY, query
from marlstone.session import shared_folder, ship, table
from marlstone.sources import listings, pages, robots, transcripts
from marlstone.streaming import known

#: model, provider, price in, price out; 'error' has no price, 'view' only from another provider
PRICES = (("click", "a", "1.00", "2.00"), ("purchase", "b", "3.00", "9.50"), ("signup", "b", "0.25", "1.25"), ("view", "b", "0.10", "0.40"))
NOW = "2024-01-20 12:00:00"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from marlstone.plans import lifecycle, stages, texts  # noqa: F401  (they register their queries)

    return {name: f for name, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    queries()
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}


def _usage(spark, d):
    e = table(spark, d, "events")
    tokens = F.floor(F.coalesce("value", F.lit(0.0)) * 10).cast("long")
    return e.select(F.col("user_id").alias("job_id"), F.when(F.col("event_type").isin("purchase", "signup"), "b").otherwise("a").alias("provider"), F.col("event_type").alias("model"), F.to_date("ts").cast("string").alias("day"), tokens.alias("input_tokens"), (F.col("event_id") % 7).alias("output_tokens"))


_USAGE = "SELECT user_id AS job_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'b' ELSE 'a' END AS provider, event_type AS model, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(floor(coalesce(value, 0) * 10) AS BIGINT) AS input_tokens, event_id % 7 AS output_tokens FROM events"
_PRICES = "SELECT * FROM (VALUES " + ", ".join(f"('{m}', '{p}', CAST('{a}' AS DECIMAL(10,2)), CAST('{b}' AS DECIMAL(10,2)))" for m, p, a, b in PRICES) + ") v(model, provider, price_in, price_out)"


def _prices(spark):
    return spark.createDataFrame(list(PRICES), "model string, provider string, price_in string, price_out string").select("model", "provider", *[F.col(c).cast("decimal(10,2)").alias(c) for c in ("price_in", "price_out")])


def _report_sql(key: str) -> str:
    keys = ", ".join(dict.fromkeys([key, "provider", "model"]))
    return f"""WITH u AS ({_USAGE}), p AS ({_PRICES}),
    g AS (SELECT {keys}, count(*) AS calls, sum(input_tokens) AS i, sum(output_tokens) AS o FROM u GROUP BY {keys}),
    c AS (SELECT g.*, round((CAST(i AS DECIMAL(18,0)) * price_in + CAST(o AS DECIMAL(18,0)) * price_out) * CAST(0.000001 AS DECIMAL(7,6)), 6) AS cost FROM g LEFT JOIN p USING (provider, model))
    SELECT {key}, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, CAST(sum(cost) AS DOUBLE) AS cost_usd,
           bool_and(cost IS NOT NULL) AS cost_complete, coalesce(array_to_string(list_sort(list(DISTINCT model) FILTER (WHERE cost IS NULL)), ','), '') AS unpriced_models
    FROM c GROUP BY {key}"""


def _report(spark, d, key):
    found = usage.report(_usage(spark, d), _prices(spark), key)
    return found.withColumns({"cost_usd": F.col("cost_usd").cast("double"), "unpriced_models": F.concat_ws(",", "unpriced_models")})


@query(_report_sql("model"))
def usage_by_model(spark, d):
    return _report(spark, d, "model")


@query(_report_sql("day"))
def usage_by_day(spark, d):
    return _report(spark, d, "day")


@query(_report_sql("job_id"))
def usage_by_job(spark, d):
    return _report(spark, d, "job_id")


@query(f"SELECT count(*) AS calls, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens FROM ({_USAGE})")
def usage_totals(spark, d):
    return usage.totals(_usage(spark, d))


_JOBS = "SELECT o_orderkey AS id, o_custkey AS job_id, o_orderstatus <> 'P' AS enabled, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END AS next_run_at, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 5 END AS run_id, CASE o_orderstatus WHEN 'O' THEN 'new' WHEN 'F' THEN 'failed' ELSE 'summarized' END AS status, o_orderkey % 4 AS attempts, o_totalprice FROM orders"


def _jobs(spark, d):
    key = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "O", "new").when(F.col("o_orderstatus") == "F", "failed").otherwise("summarized")
    return table(spark, d, "orders").select(key.alias("id"), F.col("o_custkey").alias("job_id"), (F.col("o_orderstatus") != "P").alias("enabled"), F.when(key % 11 != 0, F.col("o_orderdate")).alias("next_run_at"), F.when(key % 3 == 0, key % 5).alias("run_id"), status.alias("status"), (key % 4).alias("attempts"), "o_totalprice")


@query(f"SELECT id, job_id, CAST(next_run_at AS VARCHAR) AS next_run_at FROM ({_JOBS}) WHERE enabled AND next_run_at IS NOT NULL AND next_run_at <= TIMESTAMP '1997-01-01 00:00:00'")
def due_jobs(spark, d):
    return runs.due(_jobs(spark, d), F.lit("1997-01-01 00:00:00").cast("timestamp_ntz")).select("id", "job_id", F.col("next_run_at").cast("string").alias("next_run_at"))


_PENDING = f"SELECT *, CASE WHEN run_id = 3 THEN NULL WHEN status = 'new' AND attempts = 0 THEN 'waiting' WHEN attempts < 3 AND (status = 'failed' OR (status = 'new' AND attempts >= 1)) THEN 'retryable' END AS kind FROM ({_JOBS})"


def _pending(spark, d):
    return _jobs(spark, d).withColumn("kind", runs.pending_kind(F.col("run_id"), F.col("status"), F.col("attempts"), F.lit(3)))


@query(f"SELECT id, kind FROM ({_PENDING}) WHERE kind IS NOT NULL ORDER BY next_run_at DESC NULLS LAST, id LIMIT 100")
def pending_topk(spark, d):
    return runs.newest(_pending(spark, d).where("kind IS NOT NULL"), "next_run_at", "id").limit(100).select("id", "kind")


@query(f"SELECT job_id, count(*) FILTER (WHERE kind = 'waiting') AS waiting, count(*) FILTER (WHERE kind = 'retryable') AS retryable FROM ({_PENDING}) GROUP BY job_id")
def pending_counts(spark, d):
    return _pending(spark, d).groupBy("job_id").agg(F.count_if(F.col("kind") == "waiting").alias("waiting"), F.count_if(F.col("kind") == "retryable").alias("retryable"))


_RUNS = "SELECT event_id AS id, user_id AS job_id, ts AS started_at, CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'failed' WHEN 'purchase' THEN 'succeeded' WHEN 'signup' THEN 'partial' ELSE 'running' END AS status, event_id % 9 = 0 AS dry_run FROM events"


def _runs(spark, d):
    kind = F.col("event_type")
    status = F.when(kind.isin("error", "click"), "failed").when(kind == "purchase", "succeeded").when(kind == "signup", "partial").otherwise("running")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("job_id"), F.col("ts").alias("started_at"), status.alias("status"), (F.col("event_id") % 9 == 0).alias("dry_run"))


@query(f"SELECT job_id, status FROM ({_RUNS}) QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY started_at DESC, id DESC) = 1")
def latest_status_per_job(spark, d):
    return runs.latest_status(_runs(spark, d))


@query(f"""WITH r AS (SELECT * FROM ({_RUNS}) WHERE status <> 'running' QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY started_at DESC, id DESC) <= 50),
    s AS (SELECT *, sum(CASE WHEN status <> 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY started_at DESC, id DESC ROWS UNBOUNDED PRECEDING) AS o FROM r WHERE NOT dry_run)
    SELECT job_id, least(count(*) FILTER (WHERE o = 0 AND status = 'failed'), 6) AS streak FROM s GROUP BY job_id""")
def failure_streak(spark, d):
    return runs.failure_streak(_runs(spark, d))


@query("SELECT o_orderkey AS run_id, c_name AS job, c_mktsegment AS zone, o_orderstatus AS status FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def run_list_join(spark, d):
    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(20).select(F.col("o_orderkey").alias("run_id"), F.col("c_name").alias("job"), F.col("c_mktsegment").alias("zone"), F.col("o_orderstatus").alias("status"))


@query("SELECT event_id AS id FROM events WHERE event_type = 'error' OR (event_type = 'view' AND ts < TIMESTAMP '2024-01-20 11:00:00')")
def retryable_notifications(spark, d):
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "pending").otherwise("sent")
    notes = table(spark, d, "events").select(F.col("event_id").alias("id"), status.alias("status"), F.col("ts").alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("last_attempt_at"))
    return runs.retryable_notifications(notes, F.lit(NOW).cast("timestamp_ntz")).select("id")


@query("SELECT sha256(text) AS url_hash, source, doc_id FROM documents WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY source, doc_id) = 1")
def first_occurrence(spark, d):
    candidates = table(spark, d, "documents").where("text IS NOT NULL").select(urls.fingerprint(F.col("text")).alias("url_hash"), "source", "doc_id")
    return items.first_occurrence(candidates, "url_hash", "source", "doc_id")


_KNOWN = "SELECT CAST(doc_id AS VARCHAR) AS h, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN 'old' ELSE sha256(text) END AS c, CASE WHEN doc_id % 6 < 2 THEN 'new' WHEN doc_id % 6 < 4 THEN 'failed' ELSE 'summarized' END AS s, doc_id % 5 AS a, CASE WHEN doc_id % 7 = 0 THEN 3 END AS r FROM documents WHERE doc_id % 3 <> 0"


@query(f"""SELECT CASE WHEN h IS NULL THEN 'new' WHEN c IS NOT NULL AND c <> sha256(text) THEN 'changed' WHEN r = 3 THEN 'dropped' WHEN s = 'new' AND a = 0 THEN 'waiting' WHEN a < 3 AND (s = 'failed' OR (s = 'new' AND a >= 1)) THEN 'retryable' ELSE 'dropped' END AS kind, count(*) AS items
    FROM documents LEFT JOIN ({_KNOWN}) k ON CAST(doc_id AS VARCHAR) = h GROUP BY 1""")
def known_join_classify(spark, d):
    docs, key = table(spark, d, "documents"), F.col("doc_id")
    content = urls.fingerprint(F.col("text"))
    status = F.when(key % 6 < 2, "new").when(key % 6 < 4, "failed").otherwise("summarized")
    known = docs.where(key % 3 != 0).select(key.cast("string").alias("url_hash"), F.when(key % 4 == 0, None).when(key % 4 == 1, "old").otherwise(content).alias("content_hash"), status.alias("status"), (key % 5).alias("attempts"), F.when(key % 7 == 0, 3).cast("long").alias("run_id"))
    candidates = docs.select(key.cast("string").alias("url_hash"), content.alias("content_hash"))
    return items.classify(candidates, known, 3).groupBy("kind").agg(F.count("*").alias("items"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def unknown_candidates(spark, d):
    known = table(spark, d, "orders").where("o_orderstatus = 'P'")
    return table(spark, d, "customer").join(known, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def jobs_with_success(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT source, doc_id, 'new' AS kind FROM documents WHERE doc_id % 4 <> 0 QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 5 UNION ALL SELECT source, doc_id, 'waiting' FROM documents WHERE doc_id % 4 = 0")
def baseline_topn_per_source(spark, d):
    kind = F.when(F.col("doc_id") % 4 == 0, "waiting").otherwise("new")
    rows = table(spark, d, "documents").select("source", "doc_id", "n_chars", kind.alias("kind"))
    return items.newest_new_per_source(rows, "source", 5, F.desc("n_chars"), F.col("doc_id")).select("source", "doc_id", "kind")


@query("SELECT 0 AS origin, o_orderkey AS id, CAST(o_orderdate AS VARCHAR) AS published FROM orders UNION ALL SELECT 1, event_id, CAST(date_trunc('second', ts) AS VARCHAR) FROM events ORDER BY published DESC, origin, id LIMIT 200")
def newest_first_topk(spark, d):
    reported = table(spark, d, "orders").select(F.lit(0).alias("origin"), F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("published"))
    stored = table(spark, d, "events").select(F.lit(1).alias("origin"), F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("published"))
    return runs.newest(reported.unionByName(stored), "published", "origin", "id").limit(200)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def unprocessed_items(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


_CANON = r"""CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN
    lower(regexp_extract(url, '^([^:]+):', 1)) || '://' || regexp_replace(lower(regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), '^.*@', '')), CASE lower(regexp_extract(url, '^([^:]+):', 1)) WHEN 'http' THEN ':0*80$' ELSE ':0*443$' END, '')
    || CASE WHEN regexp_extract(url, '://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '://[^/?#]*([^?#]*)', 1) END
    || CASE WHEN q = '' THEN '' ELSE '?' || q END ELSE url END"""


_QUERY = "array_to_string(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT (lower(split_part(p, '=', 1)) LIKE 'utm\\_%' ESCAPE '\\' OR lower(split_part(p, '=', 1)) IN ('dclid', 'fbclid', 'gbraid', 'gclid', 'igshid', 'mc_cid', 'mc_eid', 'msclkid', 'wbraid', 'yclid'))), '&')"


@query(f"""SELECT page_id, {_CANON} AS canonical FROM (SELECT page_id, url, {_QUERY} AS q FROM pages)""")
def canonical_url(spark, d):
    return table(spark, d, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical"))


@query(r"SELECT page_id, regexp_replace(url, '[?#].*', '') AS plain, sha256(url) AS url_hash FROM pages")
def redacted_url(spark, d):
    return table(spark, d, "pages").select("page_id", urls.without_query(urls.redact(F.col("url"))).alias("plain"), urls.fingerprint(F.col("url")).alias("url_hash"))


@query("SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def estimate_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", text.estimate_tokens(F.col("text")).cast("long").alias("tokens"))


@query(r"""SELECT doc_id, CASE WHEN f = '' THEN NULL WHEN length(f) <= 500 THEN f ELSE rtrim(CASE WHEN regexp_extract(left(f, 499), '(?s)^(.+) [^ ]*$', 1) <> '' THEN regexp_extract(left(f, 499), '(?s)^(.+) [^ ]*$', 1) ELSE left(f, 499) END, ' ') || '…' END AS teaser
    FROM (SELECT doc_id, trim(regexp_replace(text, '[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'), ' ') AS f FROM documents)""")
def teaser(spark, d):
    return table(spark, d, "documents").select("doc_id", text.teaser(F.col("text")).alias("teaser"))


@query(r"SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^\pL\pN_\pM])(the|und)([^\pL\pN_\pM]|$)') AND NOT regexp_matches(lower(text), '(^|[^\pL\pN_\pM])les([^\pL\pN_\pM]|$)')")
def keyword_filter(spark, d):
    ship(spark)
    return table(spark, d, "documents").where(items.keyword_match(F.col("text"), any_=["the", "und", " "], exclude=["les"])).select("doc_id")


@query("SELECT event_id, CAST(least(ts, TIMESTAMP '2024-01-20 12:00:00') AS DATE)::VARCHAR AS published FROM events WHERE ts >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 7 DAY")
def age_clamp(spark, d):
    young, date = timing.clamp_age(F.col("ts"), F.lit(NOW).cast("timestamp_ntz"), 7)
    return table(spark, d, "events").where(young).select("event_id", F.to_date(date).cast("string").alias("published"))


@query("SELECT event_id, CAST(r AS DOUBLE) AS relevance FROM (SELECT event_id, round(CAST(CAST(value AS VARCHAR) AS DECIMAL(30,12)) * CAST(0.01 AS DECIMAL(3,2)), 2) AS r FROM events WHERE value IS NOT NULL) WHERE r >= 0.6")
def relevance_gate(spark, d):
    scored = table(spark, d, "events").where("value IS NOT NULL").select("event_id", (F.col("value").cast("string").cast("decimal(30,12)") / 100).alias("score"))
    return items.relevance_gate(scored, "score", "0.6").select("event_id", F.col("relevance").cast("double").alias("relevance"))


@query("SELECT source, doc_id, used_before FROM (SELECT source, doc_id, CAST(coalesce(sum(ceil(n_chars / 4.0)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS used_before FROM documents) WHERE used_before <= 20000")
def budget_stop(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", F.ceil(F.col("n_chars") / 4).cast("long").alias("tokens"))
    return usage.within_budget(docs, "source", "doc_id", "tokens", 20000).select("source", "doc_id", "used_before")


@query("SELECT d.doc_id AS id, l.q AS relevance FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1) l USING (doc_id) ORDER BY q DESC NULLS LAST, n_chars DESC NULLS LAST, d.doc_id LIMIT 100")
def digest_order(spark, d):
    score = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("relevance"))
    docs = table(spark, d, "documents").join(score, "doc_id", "left").select(F.col("doc_id").alias("id"), "relevance", F.col("n_chars").alias("published_at"))
    return items.digest_order(docs).limit(100).select("id", "relevance")


@query("SELECT source, CASE WHEN (s > 0 AND fs = s) OR (n > 0 AND f = n) THEN 'failed' WHEN fs > 0 OR f > 0 THEN 'partial' ELSE 'succeeded' END AS status, n AS attempted, f AS failed FROM (SELECT source, 1 AS s, 0 AS fs, count(DISTINCT d.doc_id) AS n, count(DISTINCT CASE WHEN toxic = 1 THEN d.doc_id END) AS f FROM documents d JOIN labels l USING (doc_id) GROUP BY source)")
def run_status(spark, d):
    per = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").groupBy("source").agg(F.countDistinct("doc_id").alias("attempted"), F.countDistinct(F.when(F.col("toxic") == 1, F.col("doc_id"))).alias("failed"))
    status = runs.run_status(F.lit(1), F.lit(0), F.col("attempted"), F.col("failed"), F.lit(False))
    return per.select("source", status.alias("status"), "attempted", "failed")


@query("SELECT event_id, CAST((CASE WHEN timezone('Europe/Berlin', CAST(l AS DATE) + INTERVAL '7 hours 30 minutes') > a THEN timezone('Europe/Berlin', CAST(l AS DATE) + INTERVAL '7 hours 30 minutes') ELSE timezone('Europe/Berlin', CAST(l AS DATE) + INTERVAL '1 day 7 hours 30 minutes') END) AT TIME ZONE 'UTC' AS VARCHAR) AS next_run FROM (SELECT event_id, timezone('UTC', ts) AS a, timezone('Europe/Berlin', timezone('UTC', ts)) AS l FROM events)")
def next_run(spark, d):
    after = F.col("ts").cast("timestamp")
    return table(spark, d, "events").select("event_id", F.date_format(timing.next_daily(after, 7, 30, "Europe/Berlin"), "yyyy-MM-dd HH:mm:ss").alias("next_run"))


@query("SELECT event_id, CAST(least(pow(2, least(event_id % 9 + 1, 6) - 1), 24) AS BIGINT) AS hours, CASE WHEN event_id % 90 > 60 THEN NULL ELSE least(60.0, greatest(pow(2.0, event_id % 8), CAST(event_id % 90 AS DOUBLE))) END AS wait FROM events")
def retry_delays(spark, d):
    key = F.col("event_id")
    return table(spark, d, "events").select("event_id", timing.retry_hours(key % 9 + 1).alias("hours"), timing.call_wait(key % 8 + 1, (key % 90).cast("double")).alias("wait"))


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) WHERE b IS NULL OR role IS NULL OR role <> b")
def adjacent_dedupe(spark, d):
    return items.drop_adjacent_repeats(table(spark, d, "conversations"), "conv_id", "turn", "role").select("conv_id", "turn")


@query("SELECT p_brand, arg_min(p_partkey, (p_retailprice, p_partkey)) AS cheapest, arg_min(p_partkey, (-p_retailprice, p_partkey)) AS dearest FROM part GROUP BY p_brand")
def cheapest_model(spark, d):
    return usage.cheapest(table(spark, d, "part"), "p_brand", "p_partkey", "p_retailprice")


@query("SELECT doc_id, nfc_normalize(text) AS text FROM documents")
def nfc_text(spark, d):
    return table(spark, d, "documents").select("doc_id", text.nfc("text").alias("text"))


@query(r"""
WITH a AS (
  SELECT page_id, regexp_extract(url, '^https?://[^/?#]+') AS root, regexp_extract_all(html, '<a href="([^"]*)">', 1) AS h, regexp_extract_all(html, '(?s)<a href="[^"]*">(.*?)</a>', 1) AS t FROM pages),
e AS (SELECT page_id, root || h[i] AS link, CAST(i - 1 AS BIGINT) AS position, replace(t[i], '&amp;', '&') AS title FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM a))
SELECT page_id, link, min(position) AS position, arg_min(title, position) AS title FROM e GROUP BY page_id, link""")
def page_links(spark, d):
    return pages.page_links(table(spark, d, "pages"))


@query(r"""
WITH t AS (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?s)^.*?</head>', ''), '(?s)<!--.*?-->|<(?:script|style)\b.*?</(?:script|style)>', '', 'g'), '</?(?:h1|p|br|ul|li|div|article|footer)\b[^>]*>', ' ', 'g') AS b FROM pages),
u AS (SELECT page_id, replace(replace(replace(replace(regexp_replace(b, '<[^>]*>', '', 'g'), '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&') AS b FROM t),
w AS (SELECT page_id, trim(regexp_replace(nfc_normalize(b), '\s+', ' ', 'g')) AS text FROM u)
SELECT page_id, text, sha256(text) AS content_hash, CAST(NULL AS VARCHAR) AS problem FROM w""")
def page_fingerprints(spark, d):
    return pages.page_fingerprints(table(spark, d, "pages"))


@query("SELECT doc_id, nfc_normalize(replace(lower(text), 'ß', 'ss')) AS folded FROM documents")
def folded_text(spark, d):
    ship(spark)
    return table(spark, d, "documents").select("doc_id", text.fold("text").alias("folded"))


@query()
def text_chunks(spark, d):
    return chunks.chunks(table(spark, d, "documents"), "doc_id", "text", 200, 20)


@query(r"SELECT page_id, regexp_replace(regexp_replace(html, '<(\s*(?:/\s*)?(?:script|title)\b[^<>]*)>', '‹\1›', 'gi'), '<(\s*(?:/\s*)?(?:script|title)\b[^<>]*)', '‹\1', 'gi') AS html FROM pages")
def neutral_tags(spark, d):
    return table(spark, d, "pages").select("page_id", text.neutral_tags(F.col("html"), ["script", "title"]).alias("html"))


@query("SELECT p_partkey, coalesce(nullif(trim(left(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-'), 48), '-'), ''), 'job') AS slug FROM part")
def job_slugs(spark, d):
    return table(spark, d, "part").select("p_partkey", text.slug(F.col("p_name")).alias("slug"))


@query("SELECT o_orderkey, 'News for ' || o_orderpriority || ' on ' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS subject FROM orders")
def subjects(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.subject("News  for {job_name} on {date}\n", F.col("o_orderpriority"), F.to_date("o_orderdate").cast("string")).alias("subject"))


@query(r"SELECT page_id, NOT contains(rest, '?') OR contains(rest, 'utm_source=') AS allowed FROM (SELECT page_id, regexp_extract(url, '^[^:]+://[^/?#]*([^#]*)', 1) AS rest FROM pages)")
def robots_allowed(spark, d):
    found = table(spark, d, "pages").select("page_id", "url")
    hosts = found.select(urls.origin(F.col("url")).alias("origin")).distinct().where("origin IS NOT NULL")
    files = hosts.withColumn("body", F.lit("User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /*? # queries\nAllow: /*utm_source=\nDisallow:\n"))
    return robots.allowed(found, "url", robots.rules(files, "reader")).select("page_id", "allowed")


@query(f"SELECT page_id, {_CANON} AS link, CASE page_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '2024-03-01 00:00:00' ELSE '2024-03-05 06:00:00' END AS lastmod FROM (SELECT page_id, url, {_QUERY} AS q FROM pages)")
def sitemap_entries(spark, d):
    escaped = F.replace("url", F.lit("&"), F.lit("&amp;"))
    date = F.when(F.col("page_id") % 3 == 0, "<lastmod>soon</lastmod>").when(F.col("page_id") % 3 == 1, "<lastmod>2024-03</lastmod>").otherwise("<lastmod>2024-03-05T08:00:00+02:00</lastmod>")
    body = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>'), escaped, F.lit("</loc>"), date, F.lit("</url><url><loc> "), escaped, F.lit(" </loc></url><url><loc>mailto:a@b</loc></url></urlset>"))
    maps = table(spark, d, "pages").select(F.col("page_id").alias("map_id"), F.lit("http://base.org/").alias("base"), body.alias("body"))
    return listings.sitemap_entries(maps).select(F.col("map_id").alias("page_id"), "link", F.date_format("lastmod", "yyyy-MM-dd HH:mm:ss").alias("lastmod"))


@query("SELECT doc_id, 'https://feeds.example.org/d/' || doc_id AS link, sha256('https://feeds.example.org/d/' || doc_id) AS url_hash, source AS title, '2024-02-06 08:30:00' AS published FROM documents WHERE source IS NOT NULL AND source <> ''")
def feed_entries(spark, d):
    item = F.concat(F.lit("<item><title>&lt;b&gt;"), F.col("source"), F.lit("&lt;/b&gt;</title><link>/d/"), F.col("doc_id"), F.lit("?utm_source=rss</link><pubDate>Tue, 06 Feb 2024 09:30:00 +0100</pubDate></item>"))
    body = F.concat(F.lit('<rss version="2.0"><channel><title>x</title>'), item, item, F.lit("<item><title>no link</title></item></channel></rss>"))
    feeds = table(spark, d, "documents").where("source <> ''").select(F.col("doc_id").alias("feed_id"), F.lit("https://Feeds.example.org/rss").alias("base"), body.alias("body"))
    return listings.feed_entries(feeds).select(F.col("feed_id").alias("doc_id"), "link", "url_hash", "title", F.date_format("published", "yyyy-MM-dd HH:mm:ss").alias("published"))


@query("""SELECT video, position, tier, row_number() OVER (PARTITION BY video ORDER BY tier, CASE WHEN NOT automatic THEN 0 WHEN original THEN 1 ELSE 2 END, position) AS rank FROM (
    SELECT user_id AS video, event_id AS position, event_id % 2 = 1 AS automatic, event_id % 3 = 0 AS original,
           CASE WHEN automatic AND NOT original THEN CASE event_type WHEN 'click' THEN 7 END ELSE CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 3 ELSE 5 END + CASE WHEN automatic THEN 1 ELSE 0 END END AS tier FROM events)
    WHERE tier IS NOT NULL QUALIFY rank <= 4""")
def transcript_tracks(spark, d):
    key = F.col("event_id")
    language = F.when(F.col("event_type") == "click", "de").when(F.col("event_type") == "view", "en").otherwise(F.lit("fr"))
    tracks = table(spark, d, "events").select(F.col("user_id").alias("video"), key.alias("position"), F.concat(F.lit("track"), key).alias("key"), language.alias("language"), (key % 2 == 1).alias("automatic"), (key % 3 == 0).alias("original"))
    return transcripts.ranked_tracks(tracks, "de-AT").select("video", "position", "tier", "rank")


@query("SELECT sha256(text) AS url_hash, min(doc_id) AS seq, 'new' AS kind FROM documents WHERE text IS NOT NULL GROUP BY 1")
def streamed_candidates(spark, d):
    # A pattern, since the table may be one file, and a stream's plain path must be a folder.
    docs = spark.readStream.schema(table(spark, d, "documents").schema).parquet(f"{d}/documents.*")
    folder = shared_folder(spark)
    known.follow(docs.select(F.col("doc_id").alias("seq"), F.sha2("text", 256).alias("url_hash"), F.sha2("text", 256).alias("content_hash")).where("url_hash IS NOT NULL"), folder).awaitTermination()
    return known.decisions(spark, folder).select("url_hash", "seq", "kind")
