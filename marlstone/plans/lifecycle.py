"""Queries of item and job state over the driver's tables, and their SQL.

lineitem stands for what sources report, orders for stored items, events for runs, notifications
and usage. Every query covers its whole tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import dedupe, items, lifecycle, runs, statistics, usage
from marlstone.plans.registry import query
from marlstone.session import shared_folder, table
from marlstone.state import Store
from marlstone.streaming import items as stream

NOW = "2024-01-20 12:00:00"
JOBS, BASELINE, MOST = 50, 5, 40

_CANDIDATES = f"""SELECT l_orderkey % {JOBS} AS job_id, l_linenumber % 3 AS source_index, (l_orderkey * 100000 + l_partkey) * 10000 + l_suppkey * 10 + l_linenumber AS position,
    CASE WHEN l_linenumber % 4 = 0 THEN 'v' ELSE 'u' END || CAST(l_orderkey AS VARCHAR) AS url_hash, CASE WHEN l_suppkey % 9 <> 0 THEN CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END AS published_at,
    CASE WHEN l_suppkey % 3 <> 0 THEN 'c' || CAST(l_suppkey % 2 AS VARCHAR) END AS content_hash FROM lineitem"""
_ITEMS = f"""SELECT o_orderkey AS id, o_orderkey % {JOBS} AS job_id, 'u' || CAST(o_orderkey AS VARCHAR) AS url_hash, CASE o_orderkey % 6 WHEN 0 THEN 'summarized' WHEN 1 THEN 'failed' WHEN 2 THEN 'relevant' ELSE 'new' END AS status,
    o_orderkey % 4 AS attempts, CASE WHEN o_orderkey % 7 = 0 THEN 3 WHEN o_orderkey % 7 = 1 THEN 2 END AS run_id, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS published_at,
    CASE WHEN o_orderkey % 5 <> 0 THEN 'c' || CAST(o_orderkey % 2 AS VARCHAR) END AS content_hash FROM orders WHERE o_orderkey % 13 <> 0"""
_DEDUPE = f"""WITH cand AS ({_CANDIDATES}), it AS ({_ITEMS}),
    u AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY job_id, url_hash ORDER BY source_index, position) = 1),
    j AS (SELECT coalesce(u.job_id, it.job_id) AS job_id, coalesce(u.url_hash, it.url_hash) AS url_hash, u.url_hash IS NOT NULL AS reported, coalesce(u.job_id, it.job_id) % 4 = 0 AS baseline,
          source_index, position, it.id, status, attempts, run_id, u.published_at AS cp, it.published_at AS ip, u.content_hash AS cc, it.content_hash AS ic,
          CASE WHEN it.id IS NULL THEN 'new' WHEN u.content_hash <> it.content_hash THEN 'changed' WHEN run_id = 3 THEN NULL WHEN status = 'new' AND attempts = 0 THEN 'waiting'
               WHEN attempts < 3 AND (status = 'failed' OR (status = 'new' AND attempts >= 1)) THEN 'retryable' END AS kind
          FROM u FULL JOIN it ON u.job_id = it.job_id AND u.url_hash = it.url_hash),
    k AS (SELECT *, CASE WHEN kind IN ('new', 'changed') THEN cp ELSE ip END AS published_at FROM j),
    b AS (SELECT *, coalesce(baseline AND kind = 'new' AND row_number() OVER (PARTITION BY job_id, source_index, coalesce(kind, '') ORDER BY published_at DESC NULLS LAST, position) > {BASELINE}, FALSE) AS rejected FROM k),
    e AS (SELECT job_id, url_hash, row_number() OVER (PARTITION BY job_id ORDER BY published_at DESC NULLS LAST, reported DESC, coalesce(source_index, 0), CASE WHEN reported THEN position ELSE id END) AS r FROM b WHERE kind IS NOT NULL AND NOT rejected),
    s AS (SELECT b.*, e.r AS rank FROM b LEFT JOIN e ON b.job_id = e.job_id AND b.url_hash = e.url_hash AND e.r <= {MOST}) """


def _candidates(spark, d):
    key, text = F.col("l_orderkey"), lambda c: c.cast("string")
    return table(spark, d, "lineitem").select(
        (key % JOBS).alias("job_id"), (F.col("l_linenumber") % 3).alias("source_index"), ((key * 100000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("position"),
        F.concat(F.when(F.col("l_linenumber") % 4 == 0, "v").otherwise("u"), text(key)).alias("url_hash"),
        F.when(F.col("l_suppkey") % 9 != 0, F.to_date("l_shipdate").cast("string")).alias("published_at"),
        F.when(F.col("l_suppkey") % 3 != 0, F.concat(F.lit("c"), text(F.col("l_suppkey") % 2))).alias("content_hash"),
        *[F.lit(None).cast("string").alias(c) for c in ("url", "type", "title", "teaser")],
    )


def _items(spark, d):
    key = F.col("o_orderkey")
    status = F.when(key % 6 == 0, "summarized").when(key % 6 == 1, "failed").when(key % 6 == 2, "relevant").otherwise("new")
    return table(spark, d, "orders").where(key % 13 != 0).select(
        key.cast("long").alias("id"), (key % JOBS).alias("job_id"), F.concat(F.lit("u"), key.cast("string")).alias("url_hash"), status.alias("status"), (key % 4).cast("long").alias("attempts"),
        F.when(key % 7 == 0, 3).when(key % 7 == 1, 2).cast("long").alias("run_id"), F.when(key % 11 != 0, F.to_date("o_orderdate").cast("string")).alias("published_at"),
        F.when(key % 5 != 0, F.concat(F.lit("c"), (key % 2).cast("string"))).alias("content_hash"),
        F.when(key % 6 == 2, F.lit(0.9)).alias("relevance"), *[F.lit(None).cast("string").alias(c) for c in ("last_error", "url", "type", "title", "teaser")],
    )


def _deduplicated(spark, d):
    batch = spark.range(JOBS).select(F.col("id").alias("job_id"), F.lit(3).cast("long").alias("this_run"), (F.col("id") % 4 == 0).alias("baseline"))
    return dedupe.deduplicate(_candidates(spark, d), _items(spark, d), batch, BASELINE, MOST)


@query(_DEDUPE + "SELECT job_id, url_hash, rank, kind AS reason, published_at, CAST(CASE WHEN kind IN ('new', 'changed') THEN 1 ELSE attempts + 1 END AS BIGINT) AS attempts FROM s WHERE rank IS NOT NULL")
def dedupe_selected(spark, d):
    return _deduplicated(spark, d).selected.select("job_id", "url_hash", "rank", "reason", "published_at", "attempts")


@query(_DEDUPE + """SELECT job_id, count(*) FILTER (WHERE reported) AS found, count(*) FILTER (WHERE kind = 'new') AS new, count(*) FILTER (WHERE kind = 'changed') AS changed, count(*) FILTER (WHERE kind = 'retryable') AS retried,
    count(*) FILTER (WHERE kind = 'waiting') AS waiting, count(*) FILTER (WHERE reported AND kind IS NULL) AS dropped, count(*) FILTER (WHERE rejected) AS baseline_skipped,
    count(*) FILTER (WHERE kind IS NOT NULL AND NOT rejected AND rank IS NULL) AS limit_cut, count(rank) AS selected, count(*) FILTER (WHERE NOT reported AND kind IS NOT NULL) AS stored_only, bool_or(baseline) AS baseline FROM s GROUP BY job_id""")  # fmt: skip
def dedupe_statistics(spark, d):
    return _deduplicated(spark, d).statistics


@query(_DEDUPE + """, l AS (SELECT max(id) AS last FROM it) SELECT coalesce(id, last + row_number() OVER (PARTITION BY id IS NULL ORDER BY job_id, source_index, position)) AS id, job_id, url_hash,
    CASE WHEN rejected THEN 'skipped_baseline' WHEN kind IN ('new', 'changed') THEN 'new' ELSE status END AS status, CAST(CASE WHEN kind IN ('new', 'changed') THEN 0 ELSE attempts END + CASE WHEN rank IS NULL THEN 0 ELSE 1 END AS BIGINT) AS attempts,
    CASE WHEN rank IS NOT NULL THEN 3 WHEN kind IN ('new', 'changed') THEN NULL ELSE run_id END AS run_id, CASE WHEN kind IN ('new', 'changed') THEN cc ELSE coalesce(ic, cc) END AS content_hash FROM s, l""")  # fmt: skip
def dedupe_items(spark, d):
    return _deduplicated(spark, d).items.select("id", "job_id", "url_hash", "status", "attempts", "run_id", "content_hash")


@query(f"SELECT id, CASE WHEN job_id % 2 = 0 THEN CASE WHEN status = 'failed' THEN 'failed' ELSE 'new' END ELSE status END AS status, CASE WHEN job_id % 2 = 0 THEN greatest(attempts - 1, 0) ELSE attempts END AS attempts, CASE WHEN job_id % 2 <> 0 THEN run_id END AS run_id FROM ({_ITEMS})")
def released_items(spark, d):
    rows = _items(spark, d)
    return lifecycle.release(rows, rows.where("job_id % 2 = 0")).select("id", "status", "attempts", "run_id")


@query(f"SELECT id, CASE WHEN attempts = 2 THEN 'skipped_keyword' ELSE status END AS status, CASE WHEN attempts = 2 THEN 9 ELSE run_id END AS run_id, CASE WHEN attempts = 2 THEN 3 ELSE attempts END AS attempts FROM ({_ITEMS})")
def taken_items(spark, d):
    rows = _items(spark, d)
    ids = rows.where("attempts = 2").select("id")
    return lifecycle.mark_taken(lifecycle.set_status(rows, ids, "skipped_keyword"), ids, 9).select("id", "status", "run_id", "attempts")


@query(f"SELECT id, coalesce(q, status) AS status FROM ({_ITEMS}) LEFT JOIN (SELECT l_orderkey AS id, CASE WHEN max(l_quantity) > 40 THEN 'summarized' END AS q FROM lineitem GROUP BY 1) USING (id)")
def updated_items(spark, d):
    values = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.when(F.max("l_quantity") > 40, "summarized").alias("status"))
    return lifecycle.updated(_items(spark, d), values).select("id", "status")


@query(f"SELECT id, url_hash FROM ({_ITEMS}) i WHERE EXISTS (SELECT 1 FROM ({_CANDIDATES}) c WHERE c.job_id = i.job_id AND c.url_hash = i.url_hash AND c.source_index = 1)")
def known_items(spark, d):
    return items.known_items(_items(spark, d), _candidates(spark, d).where("source_index = 1")).select("id", "url_hash")


@query(f"SELECT id, status FROM ({_ITEMS}) WHERE job_id = 7 AND status = 'new'")
def items_of_job(spark, d):
    return items.of_job(_items(spark, d), 7, "new").select("id", "status")


@query("SELECT 1500000000 + row_number() OVER (ORDER BY page_id) AS id, page_id FROM pages")
def inserted_rows(spark, d):
    known = spark.createDataFrame([(1500000000,)], "id long")
    return lifecycle.insert(known, table(spark, d, "pages").select("page_id"), "page_id")


_LOCKED = "SELECT c_custkey AS id, c_name AS name, c_acctbal > 0 AS enabled, TIMESTAMP '2024-01-01' + to_days(CAST(c_custkey % 40 AS INTEGER)) AS next_run_at, CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '2024-01-10' + to_days(CAST(c_custkey % 20 AS INTEGER)) END AS locked_until FROM customer"


def _locked(spark, d):
    key = F.col("c_custkey")
    day = lambda start, n: F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(days=n.cast("int"))
    return table(spark, d, "customer").select(key.alias("id"), F.col("c_name").alias("name"), (F.col("c_acctbal") > 0).alias("enabled"), day("2024-01-01", key % 40).alias("next_run_at"), F.when(key % 3 == 0, day("2024-01-10", key % 20)).alias("locked_until"))


def _at(moment: str):
    return F.lit(moment).cast("timestamp_ntz")


@query(f"SELECT id, CAST(CASE WHEN enabled AND next_run_at <= TIMESTAMP '{NOW}' AND (locked_until IS NULL OR locked_until <= TIMESTAMP '{NOW}') THEN TIMESTAMP '2024-01-20 14:00:00' ELSE locked_until END AS VARCHAR) AS locked_until FROM ({_LOCKED})")
def claimed_jobs(spark, d):
    claimed = lifecycle.claim(_locked(spark, d), F.lit(True), _at(NOW), _at("2024-01-20 14:00:00"), still_due=True)
    return claimed.select("id", F.date_format("locked_until", "yyyy-MM-dd HH:mm:ss").alias("locked_until"))


@query(f"SELECT id, CAST(CASE WHEN locked_until = TIMESTAMP '2024-01-13 00:00:00' THEN NULL ELSE locked_until END AS VARCHAR) AS locked_until, CAST(CASE WHEN locked_until = TIMESTAMP '2024-01-13 00:00:00' THEN TIMESTAMP '2024-02-01' ELSE next_run_at END AS VARCHAR) AS next_run_at FROM ({_LOCKED})")
def released_jobs(spark, d):
    freed = lifecycle.release_lock(_locked(spark, d), F.lit(True), _at("2024-01-13 00:00:00"), _at("2024-02-01 00:00:00"))
    return freed.select("id", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("locked_until", "next_run_at")])


@query(f"""WITH d AS (SELECT *, coalesce(locked_until > TIMESTAMP '{NOW}', FALSE) AS busy FROM ({_LOCKED}) WHERE enabled AND next_run_at <= TIMESTAMP '{NOW}'),
    r AS (SELECT id, row_number() OVER (ORDER BY next_run_at, id) AS r FROM d WHERE NOT busy) SELECT id, CASE WHEN busy THEN 'busy' WHEN r <= 20 THEN 'run' ELSE 'deferred' END AS outcome FROM d LEFT JOIN r USING (id)""")
def due_selection(spark, d):
    return runs.selected_due(_locked(spark, d), _at(NOW), 20).select("id", "outcome")


@query(f"""WITH d AS (SELECT *, coalesce(locked_until > TIMESTAMP '{NOW}', FALSE) AS busy FROM ({_LOCKED}) WHERE enabled AND next_run_at <= TIMESTAMP '{NOW}')
    SELECT count(*) AS due, least(count(*) FILTER (WHERE NOT busy), 20) AS run, count(*) FILTER (WHERE busy) AS busy, greatest(count(*) FILTER (WHERE NOT busy) - 20, 0) AS deferred FROM d""")
def due_report(spark, d):
    return runs.due_report(runs.selected_due(_locked(spark, d), _at(NOW), 20))


@query(f"SELECT count(*) AS affected FROM ({_LOCKED}) WHERE name = 'Customer#000000012' AND locked_until > TIMESTAMP '2024-01-15 00:00:00'")
def cleared_lock_count(spark, d):
    return lifecycle.affected(_locked(spark, d), (F.col("name") == "Customer#000000012") & (F.col("locked_until") > _at("2024-01-15 00:00:00")))


@query(f"SELECT id, name, CAST(locked_until AS VARCHAR) AS locked_until, locked_until > TIMESTAMP '{NOW}' AS locked FROM ({_LOCKED})")
def lock_states(spark, d):
    return _locked(spark, d).orderBy("name").select("id", "name", F.date_format("locked_until", "yyyy-MM-dd HH:mm:ss").alias("locked_until"), (F.col("locked_until") > _at(NOW)).alias("locked"))


@query("SELECT count(*) AS jobs, count(DISTINCT c_nationkey) AS nations FROM customer")
def restored_counts(spark, d):
    return table(spark, d, "customer").agg(F.count("*").alias("jobs"), F.countDistinct("c_nationkey").alias("nations"))


_NOTES = "SELECT event_id AS id, user_id AS job_id, event_id % 500 AS run_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'pending' WHEN 'click' THEN 'skipped' ELSE 'sent' END AS status, event_id % 6 AS attempts, ts AS created_at, CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 30 MINUTE END AS last_attempt_at FROM events"


def _notes(spark, d):
    kind, key = F.col("event_type"), F.col("event_id")
    status = F.when(kind == "error", "failed").when(kind == "view", "pending").when(kind == "click", "skipped").otherwise("sent")
    return table(spark, d, "events").select(key.alias("id"), F.col("user_id").alias("job_id"), (key % 500).alias("run_id"), status.alias("status"), (key % 6).alias("attempts"), F.col("ts").alias("created_at"), F.when(key % 3 == 0, F.col("ts") + F.expr("interval 30 minutes")).alias("last_attempt_at"), F.lit(None).cast("string").alias("error"))


_STALE = f"coalesce(last_attempt_at, created_at) < TIMESTAMP '{NOW}' - INTERVAL 1 HOUR"


@query(f"SELECT id, CASE WHEN status = 'failed' OR (status = 'pending' AND {_STALE}) THEN 'pending' ELSE status END AS status, CASE WHEN status = 'failed' OR (status = 'pending' AND {_STALE}) THEN attempts + 1 ELSE attempts END AS attempts FROM ({_NOTES})")
def notifications_claimed(spark, d):
    return lifecycle.claim_for_retry(_notes(spark, d), _at(NOW)).select("id", "status", "attempts")


@query(f"SELECT id, CASE WHEN status = 'pending' AND attempts >= 5 AND {_STALE} THEN 'skipped' ELSE status END AS status, CASE WHEN status = 'pending' AND attempts >= 5 AND {_STALE} THEN 'gave up' END AS error FROM ({_NOTES})")
def notifications_given_up(spark, d):
    return lifecycle.give_up_stale(_notes(spark, d), _at(NOW), 5, "gave up").select("id", "status", "error")


@query(f"SELECT run_id, count(*) FILTER (WHERE status = 'sent') AS sent, count(*) FILTER (WHERE status <> 'sent') AS not_sent FROM ({_NOTES}) GROUP BY run_id")
def delivery_counts(spark, d):
    return runs.delivery_counts(_notes(spark, d))


@query(f"SELECT id, status FROM ({_NOTES}) WHERE status IN ('failed', 'pending', 'skipped')")
def notifications_to_look_at(spark, d):
    return _notes(spark, d).where(F.col("status").isin("failed", "pending", "skipped")).orderBy("id").select("id", "status")


@query(f"SELECT id, CASE WHEN status = 'skipped' AND id % 2 = 0 THEN 'failed' ELSE status END AS status, CASE WHEN status = 'skipped' AND id % 2 = 0 THEN 0 ELSE attempts END AS attempts FROM ({_NOTES})")
def notifications_reset(spark, d):
    return lifecycle.changed(_notes(spark, d), (F.col("status") == "skipped") & (F.col("id") % 2 == 0), status=F.lit("failed"), attempts=F.lit(0)).select("id", "status", "attempts")


@query(f"SELECT status, count(*) AS outcomes FROM ({_NOTES}) GROUP BY status")
def outcome_counts(spark, d):
    return runs.outcome_counts(_notes(spark, d), "status")


@query(f"SELECT n.id, c_name AS job, o_orderstatus AS run_status FROM ({_NOTES}) n LEFT JOIN customer ON n.job_id = c_custkey LEFT JOIN orders ON n.run_id = o_orderkey")
def notification_details(spark, d):
    jobs = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    listed = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    digests = listed.select("id", F.lit("t").alias("title"))
    notes = _notes(spark, d).withColumn("digest_id", F.col("run_id"))
    return runs.notification_details(notes, digests, listed, jobs).select("id", "job", "run_status")


@query("""SELECT 'jobs' AS name, count(*) FILTER (WHERE c_custkey % 5 <> 0) AS rows, 0 AS orphans FROM customer UNION ALL SELECT 'items', count(*) FILTER (WHERE o_custkey % 5 <> 0), 0 FROM orders
    UNION ALL SELECT 'usage', count(*), count(*) FILTER (WHERE user_id % 5 = 0 AND user_id IN (SELECT c_custkey FROM customer)) FROM events""")
def deleted_jobs(spark, d):
    jobs = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    children = {"items": table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("job_id"))}
    orphans = {"usage": table(spark, d, "events").select("event_id", F.col("user_id").alias("job_id"))}
    left = lifecycle.delete_jobs(jobs, children, orphans, jobs.where("id % 5 = 0"))
    counts = [left[n].agg(F.lit(n).alias("name"), F.count("*").alias("rows"), (F.count_if(F.col("job_id").isNull()) if n == "usage" else F.lit(0)).alias("orphans")) for n in ("jobs", "items", "usage")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


_BOTH = "SELECT o_orderkey % 200 AS run_id, l_partkey AS item_id, CASE WHEN l_linenumber = 1 THEN 'failed' WHEN l_linenumber = 2 THEN 'skipped_irrelevant' ELSE 'relevant' END AS status FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
_SUMS = "SELECT o_orderkey % 200 AS run_id, l_partkey AS item_id, CASE WHEN l_linenumber = 3 THEN 'failed' ELSE 'summarized' END AS status FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber >= 3"


def _outcomes(spark, d):
    line, run = F.col("l_linenumber"), (F.col("l_orderkey") % 200).alias("run_id")
    rows = table(spark, d, "lineitem")
    rated = rows.select(run, F.col("l_partkey").alias("item_id"), F.when(line == 1, "failed").when(line == 2, "skipped_irrelevant").otherwise("relevant").alias("status"))
    return rated, rows.where(line >= 3).select(run, F.col("l_partkey").alias("item_id"), F.when(line == 3, "failed").otherwise("summarized").alias("status"))


@query(f"""WITH b AS (SELECT *, 0 AS stage FROM ({_BOTH}) UNION ALL SELECT *, 1 FROM ({_SUMS})) SELECT run_id, count(*) FILTER (WHERE stage = 0 AND status = 'relevant') AS relevant, count(*) FILTER (WHERE stage = 1 AND status = 'summarized') AS summarized,
    count(DISTINCT CASE WHEN status = 'failed' THEN item_id END) AS failed, count(DISTINCT item_id) AS processed FROM b GROUP BY run_id""")
def run_statistics(spark, d):
    return statistics.run_statistics(statistics.outcomes(*_outcomes(spark, d)))


_TAKEN = "SELECT DISTINCT (l_orderkey + 1) % 200 AS run_id, l_partkey AS item_id, CASE WHEN l_partkey % 5 = 0 THEN 'skipped_keyword' ELSE 'new' END AS status FROM lineitem"


@query(f"""SELECT run_id, item_id FROM ({_TAKEN}) t WHERE status <> 'skipped_keyword' AND item_id % 7 <> 0 AND NOT EXISTS (SELECT 1 FROM ({_BOTH}) r WHERE r.run_id = t.run_id AND r.item_id = t.item_id AND r.status IN ('skipped_irrelevant', 'failed'))
    AND NOT EXISTS (SELECT 1 FROM ({_SUMS}) s WHERE s.run_id = t.run_id AND s.item_id = t.item_id)""")
def unprocessed_of_runs(spark, d):
    """Items taken by another run than the one that has their outcomes, where they meet."""
    key = ((F.col("l_orderkey") + 1) % 200).alias("run_id")
    taken = table(spark, d, "lineitem").select(key, F.col("l_partkey").alias("item_id"), F.when(F.col("l_partkey") % 5 == 0, "skipped_keyword").otherwise("new").alias("status")).distinct()
    return statistics.unprocessed(taken, *_outcomes(spark, d), taken.where("item_id % 7 = 0")).select("run_id", "item_id")


@query(f"""WITH e AS (SELECT l_orderkey % 200 AS run_id, l_partkey AS item_id, count(*) AS n FROM lineitem WHERE l_linenumber > 2 GROUP BY 1, 2), s AS (SELECT DISTINCT run_id, item_id FROM ({_SUMS}) WHERE status = 'summarized')
    SELECT run_id, item_id, CASE WHEN n > 1 THEN 'duplicate' WHEN item_id % 9 = 0 THEN 'not taken' ELSE 'not summarized' END AS reason FROM e LEFT JOIN s USING (run_id, item_id) WHERE n > 1 OR item_id % 9 = 0 OR s.item_id IS NULL""".replace("LEFT JOIN s USING (run_id, item_id)", "LEFT JOIN (SELECT run_id, item_id, 1 AS done FROM s) s USING (run_id, item_id)").replace("s.item_id IS NULL", "done IS NULL"))
def digest_problems(spark, d):
    entries = table(spark, d, "lineitem").where("l_linenumber > 2").select((F.col("l_orderkey") % 200).alias("run_id"), F.col("l_partkey").alias("item_id"))
    return statistics.digest_problems(entries, entries.where("item_id % 9 <> 0"), _outcomes(spark, d)[1])


_LEDGER = "SELECT event_id % 300 AS run_id, CAST(floor(coalesce(value, 0) * 10) AS BIGINT) AS input_tokens, event_id % 7 AS output_tokens, CASE WHEN event_id % 11 <> 0 THEN CAST(event_id % 1000 AS DECIMAL(18,6)) / 1000000 END AS cost_usd FROM events"


def _ledger(spark, d):
    key = F.col("event_id")
    cost = F.when(key % 11 != 0, (key % 1000).cast("decimal(18,6)") / 1000000)
    return table(spark, d, "events").select((key % 300).alias("run_id"), F.floor(F.coalesce("value", F.lit(0.0)) * 10).cast("long").alias("input_tokens"), (key % 7).alias("output_tokens"), cost.cast("decimal(18,6)").alias("cost_usd"))


@query(f"""SELECT run_id, coalesce(n, 0) AS llm_calls, coalesce(u, 0) AS llm_calls_unpriced, CAST(coalesce(i, 0) AS BIGINT) AS input_tokens, CAST(coalesce(o, 0) AS BIGINT) AS output_tokens, CAST(coalesce(i, 0) + coalesce(o, 0) AS BIGINT) AS tokens,
    CAST(CAST(coalesce(c, 0) AS DECIMAL(28,6)) AS VARCHAR) AS estimated_cost_usd, coalesce(u, 0) = 0 AS cost_complete, 900 AS budget_limit, run_id % 2 = 0 AS budget_exceeded, coalesce(i, 0) + coalesce(o, 0) > 900 AS over_budget
    FROM (SELECT unnest(range(0, 310)) AS run_id) LEFT JOIN (SELECT run_id, count(*) AS n, count(*) FILTER (WHERE cost_usd IS NULL) AS u, sum(input_tokens) AS i, sum(output_tokens) AS o, sum(CAST(cost_usd AS DECIMAL(18,6))) AS c FROM ({_LEDGER}) GROUP BY run_id) USING (run_id)""")
def ledger_statistics(spark, d):
    limits = spark.range(310).select(F.col("id").alias("run_id"), F.lit(900).alias("budget_limit"), (F.col("id") % 2 == 0).alias("budget_exceeded"))
    return usage.ledger_statistics(_ledger(spark, d), limits)


@query(f"SELECT count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(CAST(sum(CAST(cost_usd AS DECIMAL(18,6))) AS DECIMAL(28,6)) AS VARCHAR) AS cost_usd FROM ({_LEDGER})")
def usage_cost_totals(spark, d):
    return usage.totals(_ledger(spark, d)).withColumn("cost_usd", F.col("cost_usd").cast("string"))


@query("SELECT e.event_id AS id, c_name AS job FROM events e JOIN customer ON user_id = c_custkey WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'")
def usage_of_jobs(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("job_id"), F.col("ts").alias("created_at"))
    jobs = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return usage.of_jobs(rows.withColumnRenamed("id", "usage_id"), jobs, _at("2024-01-15 00:00:00")).select(F.col("usage_id").alias("id"), "job")


@query("""WITH e AS (SELECT DISTINCT user_id % 100 AS run_id, CASE event_type WHEN 'view' THEN 'fetch_sources' WHEN 'click' THEN 'summarize_item' WHEN 'error' THEN 'score_relevance' ELSE 'finalize' END AS stage, 'E' || CAST(event_id % 3 AS VARCHAR) AS error_class,
        CASE WHEN event_type IN ('click', 'error') THEN event_id % 40 END AS item_id, CASE WHEN event_type = 'view' THEN CAST(event_id % 4 AS VARCHAR) END AS source FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY CASE stage WHEN 'fetch_sources' THEN 2 WHEN 'score_relevance' THEN 6 WHEN 'summarize_item' THEN 7 ELSE 11 END, coalesce(item_id, -1), coalesce(source, ''), error_class) AS p, count(*) OVER (PARTITION BY run_id) AS n FROM e)
    SELECT run_id, p - 1 AS position, stage, item_id, source, CASE WHEN source IS NOT NULL THEN error_class || ': source failed' WHEN stage = 'summarize_item' AND item_id % 2 = 0 THEN 'no answer' ELSE error_class END AS message, greatest(n - 20, 0) AS omitted FROM r WHERE p <= 20""")
def stored_errors(spark, d):
    kind, key = F.col("event_type"), F.col("event_id")
    stage = F.when(kind == "view", "fetch_sources").when(kind == "click", "summarize_item").when(kind == "error", "score_relevance").otherwise("finalize")
    errors = table(spark, d, "events").select((F.col("user_id") % 100).alias("run_id"), stage.alias("stage"), F.concat(F.lit("E"), (key % 3).cast("string")).alias("error_class"), F.when(kind.isin("click", "error"), key % 40).alias("item_id"), F.when(kind == "view", (key % 4).cast("string")).alias("source"))
    failures = errors.where("stage = 'summarize_item' AND item_id % 2 = 0").select("run_id", "item_id", "stage", F.lit("no answer").alias("error"))
    listed = spark.range(40).select(F.col("id").alias("item_id"), F.lit("t").alias("title"), F.lit("u").alias("url"))
    found = statistics.stored_errors(errors, failures, listed, 20)
    return found.select("run_id", F.posexplode("errors").alias("position", "e"), "omitted").select("run_id", "position", "e.stage", "e.item_id", "e.source", "e.message", "omitted")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 90 END AS found, CASE WHEN o_orderkey % 4 = 0 THEN 'S' END AS stage, CASE WHEN o_orderkey % 4 = 0 THEN '<unreadable>' END AS second FROM orders")
def stat_counts(spark, d):
    key = F.col("o_orderkey")
    number = (key % 90).cast("string")
    good = F.concat(F.lit('{"found": '), number, F.lit(', "errors": [{"stage": "S", "error_class": "E", "message": "m", "item_id": 4}, {"stage": 7}]}'))
    stats = F.when(key % 4 == 0, good).when(key % 4 == 1, F.lit('{"found": true}')).when(key % 4 == 2, F.lit('{"found": 1.5, "errors": 3}')).otherwise(F.lit("none"))
    rows = table(spark, d, "orders").select(key.alias("id"), stats.alias("stats"))
    views = statistics.error_views(F.col("stats"))
    return rows.select("id", statistics.stat_count(F.col("stats"), "found").alias("found"), F.get(views, F.lit(0))["stage"].alias("stage"), F.get(views, F.lit(1))["message"].alias("second"))


@query("""SELECT o_orderkey AS id, c_name AS job, CASE c_custkey % 3 WHEN 0 THEN 'Europe/Berlin' ELSE 'UTC' END AS zone FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey IN (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20)""")
def runs_with_zones(spark, d):
    config = F.when(F.col("c_custkey") % 3 == 0, '{"schedule": {"timezone": "Europe/Berlin"}}').when(F.col("c_custkey") % 3 == 1, '{"schedule": {"timezone": "Mars/Base"}}').otherwise('{"schedule": 3}')
    jobs = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), config.alias("config"))
    zones = spark.createDataFrame([("Europe/Berlin",), ("UTC",)], "zone string")
    listed = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("job_id"), F.col("o_orderdate").alias("started_at"))
    return runs.run_list(listed, jobs, zones, 20).select("id", "job", "zone")


@query("SELECT c_custkey AS id, max_by(o_orderstatus, (o_orderdate, o_orderkey)) AS latest_status FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def jobs_with_latest_status(spark, d):
    listed = table(spark, d, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("started_at"), F.col("o_orderstatus").alias("status"))
    return runs.with_latest_status(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), listed)


@query("SELECT user_id AS run_id, arg_min(event_type, event_id) AS error FROM events GROUP BY user_id")
def first_errors(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("error"))
    return runs.first_error(rows, "run_id", "seq", "error")


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def newest_digest(spark, d):
    return runs.newest_of(table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'failed' ELSE 'running' END AS status FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'succeeded' FROM orders WHERE o_orderkey % 2 = 1")
def finished_runs(spark, d):
    """Runs saved as a snapshot, a dry run that leaves the items alone, then killed runs marked failed."""
    key = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(key.alias("id"), F.when(key % 2 == 0, "running").otherwise("succeeded").alias("status"), *[F.lit(None).cast(t).alias(c) for c, t in (("stats", "string"), ("error", "string"), ("finished_at", "timestamp_ntz"))])
    store = Store(spark, shared_folder(spark))
    store.save({"runs": rows})
    killed = rows.where("id % 3 = 0").select("id", F.lit("failed").alias("status"), "stats", F.lit("killed").alias("error"), _at(NOW).alias("finished_at"))
    store.save_run({"runs": lifecycle.finish_run(store.read("runs"), killed)}, dry_run=True)
    return store.read("runs").select("id", "status")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey = 5 THEN '2024-02-01 01:00:00' END AS locked_until FROM customer")
def claims_of_jobs(spark, d):
    """A job claimed twice, of which the first wins, and one claimed and released by its own token only."""
    jobs = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit(True).alias("enabled"), _at(NOW).alias("next_run_at"), F.lit(None).cast("timestamp_ntz").alias("locked_until"))
    store = Store(spark, shared_folder(spark))
    store.save({"jobs": jobs})
    now, tokens = _at("2024-02-01 00:00:00"), [_at(f"2024-02-01 0{k}:00:00") for k in (1, 2)]
    outcome = [store.claim(5, now, tokens[0], still_due=True), store.claim(5, now, tokens[1]), store.claim(6, now, tokens[1]), store.release(6, tokens[0]), store.release(6, tokens[1])]
    if outcome != [True, False, True, False, True]:
        raise RuntimeError(f"locks were given out wrongly: {outcome}")
    return store.read("jobs").select("id", F.date_format("locked_until", "yyyy-MM-dd HH:mm:ss").alias("locked_until"))


@query("""
SELECT o_custkey AS job_id, CAST(o_orderkey AS VARCHAR) AS url_hash, CAST(o_orderkey AS BIGINT) AS seq, 'new' AS kind, CAST(1 AS BIGINT) AS attempts FROM orders UNION ALL
SELECT o_custkey, CAST(o_orderkey AS VARCHAR), 1000000000000 + o_orderkey, CASE o_orderkey % 4 WHEN 1 THEN 'retryable' WHEN 3 THEN 'changed' ELSE 'dropped' END, CASE WHEN o_orderkey % 4 = 1 THEN 2 ELSE 1 END FROM orders""")
def streamed_items(spark, d):
    """Reports, then outcomes of most items, then all reports again, some of another version; the stream is started three times."""
    key = F.col("o_orderkey")
    orders, folder = table(spark, d, "orders"), shared_folder(spark)
    base = [F.col("o_custkey").alias("job_id"), key.cast("string").alias("url_hash")]
    content = F.concat(F.lit("c"), (key % 2).cast("string"))
    outcome = F.when(key % 4 == 0, "summarized").when(key % 2 == 1, "failed")
    first = orders.select(*base, key.cast("long").alias("seq"), F.lit(stream.REPORTED).alias("event"), content.alias("content_hash"))
    then = orders.where(key % 4 != 2).select(*base, (key + 500_000_000_000).alias("seq"), outcome.alias("event"), F.lit(None).cast("string").alias("content_hash"))
    again = orders.select(*base, (key + 1_000_000_000_000).alias("seq"), F.lit(stream.REPORTED).alias("event"), F.when(key % 4 == 3, "z").otherwise(content).alias("content_hash"))
    for part in (first, then, again):
        part.write.mode("append").parquet(f"{folder}/events")
        stream.follow(spark.readStream.schema(stream.EVENTS).parquet(f"{folder}/events"), folder).awaitTermination()
    return stream.decisions(spark, folder)


@query("""
WITH a AS (SELECT o_custkey AS job_id, o_orderdate AS day, min(o_orderkey) AS first FROM orders WHERE o_orderkey % 3 > 0 GROUP BY ALL),
b AS (SELECT o_custkey AS job_id, o_orderdate AS day, min(o_orderkey) AS first FROM orders GROUP BY ALL),
n AS (SELECT b.*, row_number() OVER (ORDER BY first) AS r FROM b ANTI JOIN a ON a.job_id = b.job_id AND a.day = b.day)
SELECT row_number() OVER (ORDER BY first) AS id, job_id, strftime(day, '%Y-%m-%d') AS url_hash FROM a UNION ALL SELECT (SELECT count(*) FROM a) + r, job_id, strftime(day, '%Y-%m-%d') FROM n""")
def inserted_by_bucket(spark, d):
    """Two batches put into a keyed table; the second holds the first again."""
    store = Store(spark, shared_folder(spark))
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("job_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("url_hash"), F.col("o_orderkey").alias("seq"))
    store.create_keyed("items", rows.drop("seq").schema, ["job_id", "url_hash"])
    store.insert_absent("items", rows.where("seq % 3 > 0"), "seq")
    store.insert_absent("items", rows, "seq")
    return store.read("items")


@query(f"SELECT id, name FROM ({_LOCKED}) WHERE name = 'Customer#000000012'")
def job_by_name(spark, d):
    return runs.by_name(_locked(spark, d), "Customer#000000012").select("id", "name")


@query(f"SELECT id, name FROM ({_LOCKED}) WHERE enabled")
def enabled_jobs(spark, d):
    return runs.listed(_locked(spark, d), enabled_only=True).select("id", "name")


@query(f"SELECT id, status FROM ({_NOTES}) WHERE run_id = 7 AND status <> 'x'")
def notifications_of_run(spark, d):
    return runs.notifications_of(_notes(spark, d), "run_id", 7).select("id", "status")
