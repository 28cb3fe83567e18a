"""The stream of items against a plain loop over its events and against the batch classification, and its timers."""

import random
import time

from pyspark.sql import functions as F

from marlstone.operators import archive, items, ordering
from marlstone.session import shared_folder
from marlstone.streaming import items as stream


def put(spark, rows, folder, **options):
    spark.createDataFrame(rows, stream.EVENTS).repartition(3).write.mode("append").parquet(f"{folder}/events")
    stream.follow(spark.readStream.schema(stream.EVENTS).parquet(f"{folder}/events"), folder, **options).awaitTermination()


def test_batches_with_restarts_equal_a_loop_and_the_batch_operator(spark):
    r = random.Random(3)
    folder, state, want, seq = shared_folder(spark), {}, [], 0
    for _ in range(3):
        rows = []
        for _ in range(60):
            seq += 1
            key = (r.choice([1, 2, None]), f"u{r.randrange(12)}")
            event = r.choice([stream.REPORTED] * 3 + ["summarized", "failed"])
            rows.append((*key, seq, event, r.choice(["a", "b", None]) if event == stream.REPORTED else None))
        for job, url, n, event, content in rows:
            old = state.get((job, url))
            if event != stream.REPORTED:
                if old:
                    old.update(status=event, taken=False)
                continue
            if old is None:
                kind, old = "new", {"hash": content, "status": "new", "attempts": 1, "taken": True}
            elif content and old["hash"] and content != old["hash"]:
                kind = "changed"
                old.update(hash=content, status="new", attempts=1, taken=True)
            else:
                old["hash"] = old["hash"] or content
                kind = "retryable" if not old["taken"] and old["status"] == "failed" and old["attempts"] < 3 else "dropped"
                if kind == "retryable":
                    old.update(attempts=old["attempts"] + 1, taken=True)
            state[job, url] = old
            want.append((job, url, n, kind, old["attempts"]))
        r.shuffle(rows)
        if len(want) > 60:  # before the last batch, the stored items as the batch operator takes them
            known = spark.createDataFrame([(f"{j}{u}", s["hash"], s["status"], s["attempts"], 3 if s["taken"] else None) for (j, u), s in state.items()], "url_hash string, content_hash string, status string, attempts long, run_id long")
        put(spark, rows, folder)
    assert sorted(map(tuple, stream.decisions(spark, folder).collect()), key=repr) == sorted(want, key=repr)
    reports = [(f"{j}{u}", r.choice(["a", "b", None])) for j, u in state] + [("9new", "a")]
    batch = items.classify(spark.createDataFrame(reports, "url_hash string, content_hash string"), known, 3)
    single = {x["url_hash"]: x["kind"] for x in batch.collect()}
    kinds = {}
    for name, content in reports:
        s = next((v for (j, u), v in state.items() if f"{j}{u}" == name), None)
        kinds[name] = stream.reported(s and (s["hash"], s["status"], s["attempts"], s["taken"]), content)[0]
    assert single == kinds


def test_timers_give_another_attempt_and_then_give_up(spark):
    folder = shared_folder(spark)
    spark.createDataFrame([(1, "u", 1, stream.REPORTED, "a"), (1, "v", 2, stream.REPORTED, "a"), (1, "v", 3, "summarized", None)], stream.EVENTS).write.parquet(f"{folder}/events")
    running = stream.follow(spark.readStream.schema(stream.EVENTS).parquet(f"{folder}/events"), folder, stale_after=300, every="1 second")
    try:
        for _ in range(60):
            time.sleep(1)
            found = sorted((x["url_hash"], x["attempts"], x["kind"]) for x in stream.decisions(spark, folder).collect()) if running.lastProgress else []
            if len(found) == 5:
                break
    finally:
        running.stop()
    assert found == [("u", 1, "new"), ("u", 2, "retryable"), ("u", 3, "given_up"), ("u", 3, "retryable"), ("v", 1, "new")]


def test_state_and_calls_are_as_many_as_buckets(spark):
    folder, jobs = shared_folder(spark), [1, None, 2**53 + 1]
    for batch in range(2):
        rows = [(job, f"u{n}", 2**53 + 1 + n, stream.REPORTED, "ab"[batch]) for job in jobs for n in range(40)]
        spark.createDataFrame(rows, stream.EVENTS).write.mode("append").parquet(f"{folder}/events")
        query = stream.follow(spark.readStream.schema(stream.EVENTS).parquet(f"{folder}/events"), folder, buckets=5)
        query.awaitTermination()
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 5
    want = [(job, f"u{n}", 2**53 + 1 + n, kind, 1) for job in jobs for n in range(40) for kind in ("new", "changed")]
    assert sorted(map(tuple, stream.decisions(spark, folder).collect()), key=repr) == sorted(want, key=repr)


def test_archive_is_never_overwritten(spark, tmp_path):
    folder = f"file://{tmp_path}/archive"
    assert archive.archived(spark, folder) is None
    made = spark.createDataFrame([("d", "2024-01-01 10:00:05", k) for k in (1, 2)] + [("e", "2024-01-01 10:00:05", 3)], "directory string, t string, id long").withColumn("created_at", F.col("t").cast("timestamp"))
    first = archive.page_names(made).withColumn("html", F.col("id").cast("string"))
    for _ in range(2):
        archive.write_archive(first, folder)
    again = archive.page_names(made.withColumn("id", F.col("id") + 10), archive.archived(spark, folder)).withColumn("html", F.col("id").cast("string"))
    archive.write_archive(again, folder)
    found = sorted((x["directory"], x["page"], x["html"]) for x in archive.archived(spark, folder).collect())
    assert found == [("d", "2024-01-01-1000-2.html", "2"), ("d", "2024-01-01-1000-3.html", "11"), ("d", "2024-01-01-1000-4.html", "12"), ("d", "2024-01-01-1000.html", "1"), ("e", "2024-01-01-1000-2.html", "13"), ("e", "2024-01-01-1000.html", "3")]
    ranks = {x["page"]: x["rank"] for x in archive.index_entries(archive.archived(spark, folder)).where("directory = 'd'").collect()}
    assert ranks == {"2024-01-01-1000-4.html": 1, "2024-01-01-1000-3.html": 2, "2024-01-01-1000-2.html": 3, "2024-01-01-1000.html": 4}


def test_the_row_before_in_a_hot_group(spark):
    r = random.Random(8)
    rows = [(r.choice(["hot", "hot", "x", None]), n, r.choice(["a", "b", None])) for n in range(400)]
    found = ordering.previous(spark.createDataFrame(rows, "g string, o long, v string").repartition(4), "before", "v", ["g"], "o").collect()
    last = {}
    want = {}
    for g, o, v in rows:
        want[o] = last.get(g)
        last[g] = v
    assert {x["o"]: x["before"] for x in found} == want
