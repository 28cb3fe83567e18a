"""Read models of a run: item counts, unfinished items, digest checks and stored errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import strip_control

MOST_ERRORS, MOST_MESSAGE_CHARS = 100, 500
# The stages of a run, in order.
STAGES = ("load_job", "fetch_sources", "deduplicate", "keyword_prefilter", "extract_text", "score_relevance", "summarize_item", "synthesize_digest", "persist", "notify", "finalize")


def outcomes(relevance: DataFrame, summaries: DataFrame) -> DataFrame:
    """Both stages' outcomes (run_id, item_id, status) as one bag, with their stage."""
    return relevance.select("run_id", "item_id", "status", F.lit("relevance").alias("stage")).unionByName(summaries.select("run_id", "item_id", "status", F.lit("summary").alias("stage")))


def run_statistics(both: DataFrame) -> DataFrame:
    """Per run: relevant and summarised outcomes, and distinct items that failed or were processed in either stage."""
    of = lambda stage, status: F.count_if((F.col("stage") == stage) & (F.col("status") == status))
    per_item = both.groupBy("run_id", "item_id").agg(of("relevance", "relevant").alias("relevant"), of("summary", "summarized").alias("summarized"), F.bool_or(F.col("status") == "failed").alias("failed"))
    return per_item.groupBy("run_id").agg(
        F.sum("relevant").alias("relevant"), F.sum("summarized").alias("summarized"), F.count_if("failed").alias("failed"), F.count("*").alias("processed")
    )


def unprocessed(taken: DataFrame, relevance: DataFrame, summaries: DataFrame, deferred: DataFrame) -> DataFrame:
    """Taken items (run_id, item_id, status) without a final outcome: not skipped by keywords, rated out or
    failed, summarised, or deferred. An item that is only rated relevant counts as unprocessed."""
    key = ["run_id", "item_id"]
    final = relevance.where(F.col("status").isin("skipped_irrelevant", "failed")).select(*key).unionByName(summaries.where(F.col("status").isin("summarized", "failed")).select(*key)).unionByName(deferred.select(*key))
    return taken.where(~(F.col("status").eqNullSafe("skipped_keyword"))).join(final.distinct(), key, "left_anti")


def digest_problems(entries: DataFrame, taken: DataFrame, summaries: DataFrame) -> DataFrame:
    """Entries (run_id, item_id) of a digest that may not stand in it, with the reason: duplicate, not taken, not summarized."""
    key = ["run_id", "item_id"]
    counted = entries.groupBy(*key).agg(F.count("*").alias("_n"))
    mine = taken.select(*key).distinct().withColumn("_taken", F.lit(True))
    done = summaries.where("status = 'summarized'").select(*key).distinct().withColumn("_done", F.lit(True))
    joined = counted.join(mine, key, "left").join(done, key, "left")
    reason = F.when(F.col("_n") > 1, "duplicate").when(F.col("_taken").isNull(), "not taken").when(F.col("_done").isNull(), "not summarized")
    return joined.select(*key, reason.alias("reason")).where("reason IS NOT NULL")


def source_errors(fetches: DataFrame) -> DataFrame:
    """Errors of sources that failed, from fetches (run_id, source, error_class, message; null class: none), as `stored_errors` takes them."""
    failed = fetches.where(F.col("error_class").isNotNull())
    return failed.select("run_id", F.lit("fetch_sources").alias("stage"), "error_class", F.lit(None).cast("long").alias("item_id"), "source", strip_control(F.col("message"), MOST_MESSAGE_CHARS).alias("message"))


def stage_number(stage: Column) -> Column:
    """The place of a stage in a run; unknown ones come last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, STAGES)), stage), F.lit(0)), F.lit(len(STAGES) + 1))


def stored_errors(errors: DataFrame, failures: DataFrame, items: DataFrame, most: int = MOST_ERRORS) -> DataFrame:
    """Per run its stored errors as an array in order, and how many were left out.

    errors: run_id, stage, error_class, item_id, source. failures: run_id, item_id, stage (as in
    errors), error: what a failed outcome said. items: item_id, title, url. Equal errors count
    once. Each entry: stage, error_class, message, item_id, title, url, source.
    """
    once = errors.select("run_id", "stage", "error_class", "item_id", "source").distinct()
    said = failures.groupBy("run_id", "item_id", "stage").agg(F.min("error").alias("_said"))
    joined = once.join(said, ["run_id", "item_id", "stage"], "left").join(items.select("item_id", "title", "url"), "item_id", "left")
    source = F.concat("error_class", F.lit(": source failed"))
    message = F.when(F.col("source").isNotNull(), source).otherwise(F.coalesce(F.nullif("_said", F.lit("")), "error_class"))
    key = F.struct(stage_number(F.col("stage")).alias("s"), F.coalesce("item_id", F.lit(-1)).alias("i"), F.coalesce("source", F.lit("")).alias("o"), F.col("error_class").alias("c"))
    entry = F.struct("stage", "error_class", F.left(message, F.lit(MOST_MESSAGE_CHARS)).alias("message"), "item_id", "title", "url", "source")
    rows = joined.select("run_id", key.alias("key"), entry.alias("entry"))
    ranked = rows.selectExpr("*", "row_number() OVER (PARTITION BY run_id ORDER BY key) AS _r").where(F.col("_r") <= most)
    kept = ranked.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("key", "entry"))).alias("found"))
    total = once.groupBy("run_id").agg(F.count("*").alias("total"))
    left = F.greatest(F.col("total") - most, F.lit(0)).alias("omitted")
    return kept.join(total, "run_id").select("run_id", F.transform("found", lambda x: x["entry"]).alias("errors"), left)


def stat_count(stats: Column, name: str) -> Column:
    """The whole number under a name of a JSON object; null for booleans, fractions and text."""
    raw = F.try_variant_get(F.try_parse_json(stats), f"$.{name}", "variant")
    return F.when(F.schema_of_variant(raw) == "BIGINT", F.try_variant_get(raw, "$", "bigint"))


def error_views(stats: Column) -> Column:
    """Stored errors read back; entries that lack stage, class or message are unreadable. Null without a list."""
    text = lambda e, name: F.when(F.schema_of_variant(F.try_variant_get(e, f"$.{name}", "variant")) == "STRING", F.try_variant_get(e, f"$.{name}", "string"))
    number = lambda e: F.when(F.schema_of_variant(F.try_variant_get(e, "$.item_id", "variant")) == "BIGINT", F.try_variant_get(e, "$.item_id", "bigint"))
    good = lambda e: (F.coalesce(text(e, "stage"), F.lit("")) != "") & (F.coalesce(text(e, "error_class"), F.lit("")) != "") & text(e, "message").isNotNull()

    def view(e: Column) -> Column:
        named = lambda name, bad: F.when(good(e), text(e, name)).otherwise(bad).alias(name)
        rest = [F.when(good(e), text(e, name)).alias(name) for name in ("title", "url", "source")]
        return F.struct(named("stage", F.lit("unknown")), named("error_class", F.lit("unknown")), named("message", F.lit("<unreadable>")), F.when(good(e), number(e)).alias("item_id"), *rest)

    listed = F.try_variant_get(F.try_parse_json(stats), "$.errors", "array<variant>")
    return F.transform(listed, view)
