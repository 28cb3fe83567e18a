"""Items as a stream: the state of each (job_id, url_hash) decides what a report of it means.

Events are reports of candidates and outcomes of items. Keys are dealt by hash into `BUCKETS` buckets; Spark keeps the
state of a bucket's keys as one value in its state store, each key once, however many batches there were. So Python is
called once for a bucket and batch, not for each key, and a batch reads and writes the buckets of its events only. A key
is taken by the decision that selects it; if no outcome comes within `stale_after`, a processing-time timer, the
earliest of its bucket, gives it another attempt, or gives it up after `MOST_ATTEMPTS`. Checkpoint and decisions lie in
the shared folder: a stream that is started again goes on where it stopped, and a batch that is tried again writes its
decisions once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marlstone.operators.runs import MOST_ATTEMPTS
from marlstone.session import ship

STALE_AFTER = 3_600_000
#: A call of Python takes some milliseconds, so a full batch pays for so many calls at most, whatever its size.
BUCKETS = 4_096
REPORTED = "reported"
EVENTS = "job_id long, url_hash string, seq long, event string, content_hash string"
#: A bucket's keys as JSON: job_id, url_hash, content_hash, status, attempts, taken, and when its timer runs out.
STATE = "items string"
#: Python sees numbers as texts: in a frame, a column of them with nulls would lose digits.
TEXTS = ("job_id", "url_hash", "seq", "event", "content_hash")
DECISIONS = "job_id long, url_hash string, seq long, kind string, attempts long"


def reported(old: tuple | None, content_hash: str | None) -> tuple[str, tuple]:
    """The kind of a report (new, changed, retryable or dropped) and the state after it."""
    if old is None:
        return "new", (content_hash, "new", 1, True)
    known, status, attempts, taken = old
    if content_hash is not None and known is not None and content_hash != known:
        return "changed", (content_hash, "new", 1, True)
    known = content_hash if known is None else known
    if not taken and status in ("failed", "new") and attempts < MOST_ATTEMPTS:
        return "retryable", (known, status, attempts + 1, True)
    return "dropped", (known, status, attempts, taken)


def finished(old: tuple | None, status: str) -> tuple | None:
    """The state after an outcome; one of an unknown item changes nothing."""
    return None if old is None else (old[0], status, old[2], False)


def overdue(old: tuple) -> tuple[str, tuple]:
    """What becomes of an item that was taken and has no outcome in time."""
    known, status, attempts, _ = old
    if attempts < MOST_ATTEMPTS:
        return "retryable", (known, status, attempts + 1, True)
    return "given_up", (known, "failed", attempts, False)


def decide(events: DataFrame, stale_after: int = STALE_AFTER, buckets: int = BUCKETS) -> DataFrame:
    """Decisions of a stream of events, one for each report and for each timer that ran out.

    Events of a key count in the order of seq within a batch, those without one first. Null hashes are unknown; a null
    key part is a key. Further columns aren't read. A stream must keep the number of buckets that it began with.
    """
    ship(events.sparkSession)

    def step(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        known = {(job, url): (tuple(old), due) for job, url, *old, due in json.loads(state.get[0])} if state.exists else {}
        rows = [] if state.hasTimedOut else [row for frame in frames for row in zip(*(frame[c].tolist() for c in TEXTS), strict=True)]
        made, touched = [], {}
        for job, url, seq, event, content_hash in sorted(((*r[:2], None if r[2] is None else int(r[2]), *r[3:]) for r in rows), key=lambda r: (r[2] is not None, r[2])):
            key = job, url
            old = touched[key] if key in touched else known.get(key, (None,))[0]
            if event == REPORTED:
                kind, old = reported(old, content_hash)
                made.append((job, url, seq, kind, old[2]))
            else:
                old = finished(old, event)
            touched[key] = old
        for (job, url), (old, due) in known.items():
            if due is not None and due <= now and (job, url) not in touched:
                kind, old = overdue(old)
                made.append((job, url, None, kind, old[2]))
                touched[job, url] = old
        known |= {key: (old, now + stale_after if old[3] else None) for key, old in touched.items() if old is not None}
        if known:
            if touched:
                state.update((json.dumps([(*key, *old, due) for key, (old, due) in known.items()]),))
            timers = [due for _, due in known.values() if due is not None]
            if timers:
                state.setTimeoutDuration(max(1, min(timers) - now))
        made = [(None if job is None else int(job), *rest) for job, *rest in made]
        yield pd.DataFrame(made, columns=["job_id", "url_hash", "seq", "kind", "attempts"], dtype=object)

    key = [F.col("job_id").cast("string").alias("job_id"), "url_hash"]
    rows = events.select(F.pmod(F.xxhash64("job_id", "url_hash"), F.lit(buckets)).alias("bucket"), *key, F.col("seq").cast("string").alias("seq"), "event", "content_hash")
    return rows.groupBy("bucket").applyInPandasWithState(step, DECISIONS, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def follow(events: DataFrame, folder: str, stale_after: int = STALE_AFTER, every: str | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """Decide a stream of events (EVENTS) into folder/decisions: what it holds now, or on with a batch `every` so often.

    Timers run out in batches: with `every` at any time, else together with the next events.
    """
    writer = decide(events, stale_after, buckets).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/progress")
    if every is not None:
        return writer.trigger(processingTime=every).start(f"{folder}/decisions")
    conf, name = events.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, "false")  # open timers would ask for empty batches without end
    try:
        return writer.trigger(availableNow=True).start(f"{folder}/decisions")
    finally:
        conf.set(name, before)


def decisions(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(DECISIONS).parquet(f"{folder}/decisions")


def counts(found: DataFrame) -> DataFrame:
    """How many decisions of each kind there were for each job."""
    return found.groupBy("job_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("new", "changed", "retryable", "dropped", "given_up")])
