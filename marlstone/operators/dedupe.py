"""Deduplication against stored items: what a run selects, the items afterwards, and the counts.

All jobs of a batch are handled at once; job_id is part of every key. One full outer join of the
reported candidates with the stored items classifies both sides; its result is stored and everything else is
made from it. Rankings are windows whose row limit Spark applies before the shuffle, so a hot job or
source sends a bounded number of rows, and what they keep is all that is joined back.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.items import changed_version, first_occurrence
from marlstone.operators.ordering import numbered
from marlstone.operators.runs import pending_kind
from marlstone.session import bounded, stored

VERSIONED = ["url", "type", "title", "teaser", "published_at", "content_hash"]
REASONS = ("new", "changed", "retryable", "waiting")


def _joined(candidates: DataFrame, items: DataFrame, runs: DataFrame) -> DataFrame:
    """Reported candidates (as c) and stored items (as i) of the jobs in runs, with the kind of each."""
    unique = first_occurrence(candidates, ["job_id", "url_hash"], "source_index", "position")
    boxed = unique.select("job_id", "url_hash", F.struct(*unique.columns).alias("c"))
    old = items.select("job_id", "url_hash", F.struct(*items.columns).alias("i"))
    both = boxed.join(old, ["job_id", "url_hash"], "full_outer").join(runs, "job_id")
    i = F.col("i")
    pending = pending_kind(i["run_id"], i["status"], i["attempts"], F.col("this_run"))
    kind = F.when(F.col("i").isNull(), "new").when(changed_version(F.col("c.content_hash"), i["content_hash"]), "changed").otherwise(pending)
    return both.withColumn("kind", kind).withColumn("reported", F.col("c").isNotNull())


def _order(published: Column) -> list[Column]:
    """Dated first, newest first, reported before stored, source order, then position or id."""
    tie = F.when(F.col("reported"), F.col("c.position")).otherwise(F.col("i.id"))
    return [published.desc_nulls_last(), F.col("reported").desc(), F.coalesce("c.source_index", F.lit(0)), tie]


class Deduplicated:
    """selected: items to process with `reason`; items: the whole table afterwards; statistics: a row for each job.

    Each is made when it is asked for. selected has the ids of stored items; new ones have theirs in items.
    """

    def __init__(self, rows: DataFrame, items: DataFrame, runs: DataFrame, baseline_items: int, max_items: int) -> None:
        self._rows, self._table, self._runs = rows, items, runs
        order = _order(F.col("published_at"))
        first = Window.partitionBy("job_id", "c.source_index").orderBy(*order)
        at_first = F.col("baseline") & (F.col("kind") == "new")
        kept = rows.where(at_first).withColumn("r", F.row_number().over(first)).where(F.col("r") <= baseline_items).drop("r")
        others = rows.where(F.col("kind").isNotNull() & ~at_first)
        best = Window.partitionBy("job_id").orderBy(*order)
        ranked = others.unionByName(kept).withColumn("rank", F.row_number().over(best))
        self._kept, self._chosen = kept, ranked.where(F.col("rank") <= max_items)

    @property
    def selected(self) -> DataFrame:
        i, kind = F.col("i"), F.col("kind")
        version, attempts = _version(kind, i)
        values = {"id": i["id"], **version, "attempts": (attempts + 1).cast("long"), "reason": kind}
        wanted = ["id", "url", "type", "title", "published_at", "teaser", "content_hash", "attempts", "reason"]
        made = self._chosen.select("job_id", "rank", "url_hash", *[values[c].alias(c) for c in wanted])
        return made.select("job_id", "rank", "id", "url", "url_hash", "type", "title", "published_at", "teaser", "content_hash", "attempts", "reason")

    @cached_property
    def items(self) -> DataFrame:
        marks = self._kept.select("job_id", "url_hash", F.lit(True).alias("_kept"), F.lit(None).cast("int").alias("rank"))
        marks = marks.unionByName(self._chosen.select("job_id", "url_hash", F.lit(None).cast("boolean").alias("_kept"), "rank"))
        flags = bounded(stored(marks.groupBy("job_id", "url_hash").agg(F.max("_kept").alias("_kept"), F.max("rank").alias("rank"))))
        rows = self._rows.join(flags, ["job_id", "url_hash"], "left")
        rejected = F.col("baseline") & (F.col("kind") == "new") & F.col("_kept").isNull()
        after = _after(rows.withColumn("rejected", F.coalesce(rejected, F.lit(False))), self._table)
        rest = self._table.join(self._runs.select("job_id"), "job_id", "left_anti")
        return after.select(*self._table.columns).unionByName(rest.select(*self._table.columns))

    @property
    def statistics(self) -> DataFrame:
        """Counts of each job; new + changed + retried + waiting + dropped = found + stored_only, and
        selected + limit_cut + baseline_skipped = new + changed + retried + waiting."""
        kind, reported = F.col("kind"), F.col("reported")
        count = lambda test, name: F.count_if(test).alias(name)
        whole = self._rows.groupBy("job_id").agg(
            count(reported, "found"),
            count(kind == "new", "new"),
            count(kind == "changed", "changed"),
            count(kind == "retryable", "retried"),
            count(kind == "waiting", "waiting"),
            count(reported & kind.isNull(), "dropped"),
            count(F.col("baseline") & (kind == "new"), "_first"),
            count(kind.isNotNull(), "_pending"),
            count(~reported & kind.isNotNull(), "stored_only"),
            F.bool_or("baseline").alias("baseline"),
        )
        n = lambda some, name: some.groupBy("job_id").agg(F.count("*").alias(name))
        both = whole.join(n(self._kept, "_kept"), "job_id", "left").join(n(self._chosen, "selected"), "job_id", "left").fillna(0, ["_kept", "selected"])
        skipped = F.col("_first") - F.col("_kept")
        both = both.withColumns({"baseline_skipped": skipped, "limit_cut": F.col("_pending") - skipped - F.col("selected")})
        return both.select("job_id", "found", "new", "changed", "retried", "waiting", "dropped", "baseline_skipped", "limit_cut", "selected", "stored_only", "baseline")


def deduplicate(candidates: DataFrame, items: DataFrame, runs: DataFrame, baseline_items: int, max_items: int) -> Deduplicated:
    """One run of each job in runs (job_id, this_run, baseline).

    candidates: job_id, source_index, position, url_hash and the versioned columns. items: id,
    job_id, url_hash, status, attempts, run_id, relevance, last_error and the versioned columns.
    baseline says that the job has no successful run yet: then only the newest `baseline_items` new
    items of each source go on. Repeating a call with its own result changes nothing.
    """
    few = bounded(stored(runs))
    # A stored item keeps its date unless its new version brings another.
    published = F.when(F.col("kind").isin("new", "changed"), F.col("c.published_at")).otherwise(F.col("i.published_at"))
    rows = stored(_joined(candidates, items, few).withColumn("published_at", published))
    return Deduplicated(rows, items, few, baseline_items, max_items)


def _version(kind: Column, i: Column) -> tuple[dict[str, Column], Column]:
    """The versioned columns of a row after the run, and its attempts before it."""
    new = F.coalesce(kind.isin("new", "changed"), F.lit(False))
    version = {name: F.when(new, F.col(f"c.{name}")).otherwise(i[name]) for name in VERSIONED}
    version["content_hash"] = F.when(new, F.col("c.content_hash")).otherwise(F.coalesce(i["content_hash"], F.col("c.content_hash")))
    return version, F.when(new, 0).otherwise(i["attempts"])


def _after(rows: DataFrame, items: DataFrame) -> DataFrame:
    """The items of the jobs after the run."""
    i, kind, was_taken = F.col("i"), F.col("kind"), F.col("rank").isNotNull()
    new_version = F.coalesce(kind.isin("new", "changed"), F.lit(False))
    version, attempts = _version(kind, i)
    status = F.when(F.col("rejected"), "skipped_baseline").when(new_version, "new").otherwise(i["status"])
    run = F.when(was_taken, F.col("this_run")).when(~new_version, i["run_id"])
    made = rows.select(
        "job_id", "url_hash", i["id"].alias("id"), F.col("c.source_index").alias("_source"), F.col("c.position").alias("_position"),
        *[value.alias(name) for name, value in version.items()],
        status.alias("status"), (attempts + F.when(was_taken, 1).otherwise(0)).cast("long").alias("attempts"), run.cast("long").alias("run_id"),
        i["relevance"].alias("relevance"), F.when(~new_version, i["last_error"]).alias("last_error"),
    )
    # New ids follow the input order, after the largest id there is.
    last = items.agg(F.max("id")).first()[0] or 0
    fresh = numbered(made.where("id IS NULL").drop("id"), "id", "job_id", "_source", "_position").withColumn("id", F.col("id") + last)
    return made.where("id IS NOT NULL").unionByName(fresh).drop("_source", "_position")
