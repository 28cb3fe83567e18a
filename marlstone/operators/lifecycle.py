"""Changes to stored rows: each takes a snapshot of a table and gives the next one.

A change names its rows by a frame of ids (joined, never collected) or by a condition, and leaves
all other rows as they are. `affected` counts what a conditional change would match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.ordering import numbered
from marlstone.operators.runs import retryable


def changed(table: DataFrame, where: Column, **values: Column) -> DataFrame:
    """Rows that meet the condition get new values."""
    hit = F.coalesce(where, F.lit(False))
    return table.withColumns({name: F.when(hit, value).otherwise(F.col(name)).cast(table.schema[name].dataType) for name, value in values.items()})


def changed_by_id(table: DataFrame, ids: DataFrame, **values: Column) -> DataFrame:
    """Rows whose id is in ids (id) get new values."""
    marked = table.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    return changed(marked, F.col("_hit"), **values).drop("_hit").select(*table.columns)


def affected(table: DataFrame, where: Column) -> DataFrame:
    return table.agg(F.count_if(where).alias("affected"))


def mark_taken(items: DataFrame, ids: DataFrame, run_id: int) -> DataFrame:
    """Items go to a run, with one more attempt."""
    return changed_by_id(items, ids, run_id=F.lit(run_id), attempts=F.col("attempts") + 1)


def release(items: DataFrame, ids: DataFrame) -> DataFrame:
    """Items go back: the attempt is undone; what isn't failed is new again, without relevance."""
    kept = F.col("status") == "failed"
    relevance = F.when(kept, F.col("relevance"))
    return changed_by_id(items, ids, run_id=F.lit(None), attempts=F.greatest(F.col("attempts") - 1, F.lit(0)), status=F.when(kept, "failed").otherwise("new"), relevance=relevance)


def set_status(items: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    return changed_by_id(items, ids, status=F.lit(status))


def updated(items: DataFrame, values: DataFrame) -> DataFrame:
    """Values from a frame of id and new columns (status, relevance, summary, teaser, ...); null means keep."""
    names = [c for c in values.columns if c != "id"]
    boxed = values.select("id", *[F.col(c).alias(f"_{c}") for c in names])
    joined = items.join(boxed, "id", "left")
    return joined.withColumns({c: F.coalesce(f"_{c}", c) for c in names}).select(*items.columns)


def insert(table: DataFrame, rows: DataFrame, *order: str) -> DataFrame:
    """rows with ids that follow the table's largest, in the given order; to be appended."""
    last = table.agg(F.max("id")).first()[0] or 0
    return numbered(rows, "id", *order).select((F.col("id") + last).alias("id"), *rows.columns)


def free_lock(now: Column, still_due: bool = False) -> Column:
    """Whether a job may be claimed: not locked, or its lock has run out; with still_due also enabled and due."""
    free = F.col("locked_until").isNull() | (F.col("locked_until") <= now)
    due = F.col("enabled") & F.col("next_run_at").isNotNull() & (F.col("next_run_at") <= now)
    return free & due if still_due else free


def claim(jobs: DataFrame, where: Column, now: Column, until: Column, still_due: bool = False) -> DataFrame:
    """Jobs that are free get a lock, whose end is its token."""
    return changed(jobs, where & free_lock(now, still_due), locked_until=until)


def release_lock(jobs: DataFrame, where: Column, token: Column, next_run_at: Column | None = None) -> DataFrame:
    """The lock goes if the token is still its own; the next run is set with it, if one is given."""
    mine = where & (F.col("locked_until") == token)
    slot = {} if next_run_at is None else {"next_run_at": next_run_at}
    return changed(jobs, mine, **slot, locked_until=F.lit(None))


def finish_run(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Runs that are still running get status, stats, error and end from results (id, status, stats, error, finished_at)."""
    names = ["status", "stats", "error", "finished_at"]
    new = results.select("id", *[F.col(c).alias(f"_{c}") for c in names])
    joined = runs.join(new, "id", "left")
    ends = (F.col("status") == "running") & F.col("_status").isNotNull()
    # One projection, so each test sees the old status.
    made = [F.when(ends, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in runs.columns]
    return joined.select(*made)


def with_errors(stats: Column, errors: Column, omitted: Column) -> Column:
    """A JSON object with the stored errors put in beside what it holds."""
    known = F.coalesce(F.from_json(stats, "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    rest = F.map_filter(known, lambda k, _: ~k.isin("errors", "errors_omitted"))
    own = F.create_map(F.lit("errors"), F.parse_json(errors), F.lit("errors_omitted"), F.parse_json(omitted.cast("string")))
    return F.to_json(F.map_concat(rest, own))


def begin_attempt(notes: DataFrame, where: Column, now: Column) -> DataFrame:
    return changed(notes, where, attempts=F.col("attempts") + 1, last_attempt_at=now)


def mark_notification(notes: DataFrame, where: Column, status: str, now: Column, error: str | None = None) -> DataFrame:
    """Status and error; sent ones get the time."""
    sent = {"sent_at": now} if status == "sent" else {}
    return changed(notes, where, status=F.lit(status), error=F.lit(error), **sent)


def claim_for_retry(notes: DataFrame, now: Column) -> DataFrame:
    """Retryable notifications become pending with one more attempt."""
    hit = F.coalesce(retryable(now), F.lit(False))
    new = {"status": F.lit("pending"), "attempts": F.col("attempts") + 1, "last_attempt_at": now}
    return notes.select(*[F.when(hit, new[c]).otherwise(F.col(c)).cast(notes.schema[c].dataType).alias(c) if c in new else F.col(c) for c in notes.columns])


def give_up_stale(notes: DataFrame, now: Column, most_attempts: int, error: str) -> DataFrame:
    """Pending notifications that are stale and used their attempts are skipped."""
    stale = F.coalesce("last_attempt_at", "created_at") < now - F.expr("interval 1 hour")
    hit = F.coalesce((F.col("status") == "pending") & (F.col("attempts") >= most_attempts) & stale, F.lit(False))
    new = {"status": F.lit("skipped"), "error": F.lit(error)}
    return notes.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in notes.columns])


def delete_jobs(jobs: DataFrame, children: dict[str, DataFrame], orphans: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Without the jobs in gone (id): children go with them, orphans stay with a null job_id."""
    ids = gone.select("id").distinct()
    out = {"jobs": jobs.join(ids, "id", "left_anti")}
    keyed = ids.withColumnRenamed("id", "job_id")
    out |= {name: table.join(keyed, "job_id", "left_anti").select(*table.columns) for name, table in children.items()}
    for name, table in orphans.items():
        marked = table.join(keyed.withColumn("_gone", F.lit(True)), "job_id", "left")
        out[name] = marked.withColumn("job_id", F.when(F.col("_gone").isNull(), F.col("job_id"))).select(*table.columns)
    return out
