"""Jobs, runs and notifications: what is due, what waits, and how runs went."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCANNED_RUNS = 50
MOST_ATTEMPTS = 3


def due(jobs: DataFrame, now: Column) -> DataFrame:
    """Enabled jobs whose time has come, earliest first."""
    return jobs.where(F.col("enabled") & F.col("next_run_at").isNotNull() & (F.col("next_run_at") <= now)).orderBy("next_run_at", "id")


def pending_kind(run_id: Column, status: Column, attempts: Column, this_run: Column | int | None) -> Column:
    """'waiting', 'retryable', or null for what is finished or taken by this run."""
    free = run_id.isNull() | ~run_id.eqNullSafe(this_run)
    waiting = (status == "new") & (attempts == 0)
    retry = (attempts < MOST_ATTEMPTS) & ((status == "failed") | ((status == "new") & (attempts >= 1)))
    return F.when(free & waiting, "waiting").when(free & retry, "retryable")


def selected_due(jobs: DataFrame, now: Column, limit: int) -> DataFrame:
    """Due jobs with outcome: busy (locked), run (the first `limit` others) or deferred."""
    listed = due(jobs, now).withColumn("_busy", F.coalesce(F.col("locked_until") > now, F.lit(False)))
    first = listed.where("NOT _busy").orderBy("next_run_at", "id").limit(limit).select("id", F.lit(True).alias("_run"))
    outcome = F.when(F.col("_busy"), "busy").when(F.col("_run"), "run").otherwise("deferred")
    return listed.join(F.broadcast(first), "id", "left").withColumn("outcome", outcome).drop("_busy", "_run")


def due_report(selected: DataFrame) -> DataFrame:
    """One row: jobs due, to run, busy and deferred."""
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in ("run", "busy", "deferred")]
    return selected.agg(F.count("*").alias("due"), *counts)


def newest(items: DataFrame, date: str, *ties: str) -> DataFrame:
    """Dated items newest first, then undated ones; ties by the given columns."""
    return items.orderBy(F.col(date).desc_nulls_last(), *ties)


def latest_status(runs: DataFrame) -> DataFrame:
    """Of each job the status of its newest run: one aggregation, no sort of the runs."""
    return runs.groupBy("job_id").agg(F.max_by("status", F.struct("started_at", "id")).alias("status"))


def failure_streak(runs: DataFrame, cap: int = 6, exclude_run_id: int | None = None) -> DataFrame:
    """Failures since the last success among a job's newest finished runs, dry runs aside."""
    recent = Window.partitionBy("job_id").orderBy(F.desc("started_at"), F.desc("id"))
    finished = runs.where("status <> 'running'")
    if exclude_run_id is not None:
        finished = finished.where(F.col("id") != exclude_run_id)
    scanned = finished.withColumn("_n", F.row_number().over(recent)).where(F.col("_n") <= SCANNED_RUNS)
    open_ = F.sum((F.col("status") != "failed").cast("int")).over(recent.rowsBetween(Window.unboundedPreceding, 0))
    counted = scanned.where(~F.coalesce(F.col("dry_run"), F.lit(False))).withColumn("_open", open_)
    failed = F.count_if((F.col("_open") == 0) & (F.col("status") == "failed"))
    return counted.groupBy("job_id").agg(F.least(failed, F.lit(cap).cast("long")).alias("streak"))


def retryable(now: Column) -> Column:
    """Failed notifications, and pending ones untouched for an hour."""
    touched = F.coalesce("last_attempt_at", "created_at")
    return (F.col("status") == "failed") | ((F.col("status") == "pending") & (touched < now - F.expr("interval 1 hour")))


def retryable_notifications(notes: DataFrame, now: Column) -> DataFrame:
    return notes.where(retryable(now)).orderBy("id")


def run_status(sources: Column, failed_sources: Column, attempted: Column, failed: Column, exceeded: Column, fallback: Column | bool = False) -> Column:
    """failed if every source failed, or every attempted item and the budget held; partial after any failure,
    a budget stop or a fallback digest; else succeeded."""
    none = ((sources > 0) & (failed_sources == sources)) | (~exceeded & (attempted > 0) & (failed == attempted))
    some = (failed_sources > 0) | (failed > 0) | exceeded | F.lit(fallback) if isinstance(fallback, bool) else (failed_sources > 0) | (failed > 0) | exceeded | fallback
    return F.when(none, "failed").when(some, "partial").otherwise("succeeded")


def lowered(status: Column, trouble: Column) -> Column:
    """A succeeded run is partial after a fallback digest or an undelivered notification."""
    return F.when((status == "succeeded") & trouble, "partial").otherwise(status)


def delivery_counts(notes: DataFrame) -> DataFrame:
    """Per run: sent, and everything else."""
    sent = F.coalesce(F.col("status") == "sent", F.lit(False))
    return notes.groupBy("run_id").agg(F.count_if(sent).alias("sent"), F.count_if(~sent).alias("not_sent"))


def outcome_counts(outcomes: DataFrame, kind: str) -> DataFrame:
    return outcomes.groupBy(kind).agg(F.count("*").alias("outcomes"))


def with_latest_status(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Jobs with the status of their newest run, null without one."""
    latest = latest_status(runs).select(F.col("job_id").alias("_job"), F.col("status").alias("latest_status"))
    return jobs.join(latest, F.col("id") == F.col("_job"), "left").drop("_job")


def newest_of(table: DataFrame, key: str, *order: str) -> DataFrame:
    """The newest row of each key, such as the latest digest of a run."""
    others = [c for c in table.columns if c != key]
    row = F.max_by(F.struct(*others), F.struct(*order)).alias("_row")
    return table.groupBy(key).agg(row).select(key, "_row.*").select(*table.columns)


def run_list(runs: DataFrame, jobs: DataFrame, zones: DataFrame, limit: int) -> DataFrame:
    """The newest runs with their job's name and time zone.

    The zone is schedule.timezone of the job's config (JSON text), or UTC if zones (zone) doesn't
    have it. Only the chosen runs are joined.
    """
    chosen = runs.orderBy(F.desc("started_at"), F.desc("id")).limit(limit)
    named = jobs.select(F.col("id").alias("job_id"), F.col("name").alias("job"), F.get_json_object("config", "$.schedule.timezone").alias("_zone"))
    known = zones.select(F.col("zone").alias("_zone"), F.lit(True).alias("_known"))
    joined = F.broadcast(chosen).join(named, "job_id").join(F.broadcast(known), "_zone", "left")
    zone = F.when(F.col("_known"), F.col("_zone")).otherwise("UTC")
    return joined.withColumn("zone", zone).drop("_zone", "_known")


def notification_details(notes: DataFrame, digests: DataFrame, runs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Notifications with their digest's title, run's status and job's name; missing ones are null."""
    d = digests.select(F.col("id").alias("digest_id"), F.col("title").alias("digest_title"))
    r = runs.select(F.col("id").alias("run_id"), F.col("status").alias("run_status"))
    j = jobs.select(F.col("id").alias("job_id"), F.col("name").alias("job"))
    return notes.join(d, "digest_id", "left").join(r, "run_id", "left").join(j, "job_id", "left")


def first_error(errors: DataFrame, key: str, seq: str, error: str) -> DataFrame:
    """The error that was reported first."""
    return errors.groupBy(key).agg(F.min_by(error, seq).alias(error))


def unfinished(runs: DataFrame) -> DataFrame:
    """Runs that are still running, or were killed, by id."""
    return runs.where(F.col("status") == "running").orderBy("id")


def by_name(jobs: DataFrame, name: str) -> DataFrame:
    """The job of exactly this name."""
    return jobs.where(F.col("name") == name)


def listed(jobs: DataFrame, enabled_only: bool = False) -> DataFrame:
    return (jobs.where("enabled") if enabled_only else jobs).orderBy("name")


def by_id(table: DataFrame, id_: int) -> DataFrame:
    return table.where(F.col("id") == id_)


def notifications_of(notes: DataFrame, key: str, value: int, status: str | None = None) -> DataFrame:
    """Notifications of a job or run (key), by id, of one status or all."""
    mine = notes.where(F.col(key) == value)
    return (mine if status is None else mine.where(F.col("status") == status)).orderBy("id")


def known_zones(rows: DataFrame, zone: str, zones: DataFrame) -> DataFrame:
    """Rows whose zone isn't one of zones (zone) get UTC."""
    known = F.broadcast(zones.select(F.col("zone").alias("_zone")).distinct())  # some hundreds of names
    return rows.join(known, F.col(zone) == F.col("_zone"), "left").withColumn(zone, F.coalesce("_zone", F.lit("UTC"))).drop("_zone")
