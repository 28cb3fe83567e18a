"""Token usage: totals, grouped sums and priced reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.timing import cost_usd
from marlstone.operators.ordering import running_total


def totals(usage: DataFrame) -> DataFrame:
    """One row: calls and summed tokens, 0 over nothing; with a cost column its sum to six places too."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens")]
    if "cost_usd" in usage.columns:
        cost = F.coalesce(F.sum(F.col("cost_usd").cast("decimal(18,6)")), F.lit(0)).cast("decimal(28,6)")
        sums.append(cost.alias("cost_usd"))
    return usage.agg(F.count("*").alias("calls"), *sums)


def of_jobs(usage: DataFrame, jobs: DataFrame, since: Column | None = None) -> DataFrame:
    """Usage rows of existing jobs, with their name, from `since` on."""
    rows = usage if since is None else usage.where(F.col("created_at") >= since)
    return rows.join(jobs.select(F.col("id").alias("job_id"), F.col("name").alias("job")), "job_id")


def grouped(usage: DataFrame, *keys: str) -> DataFrame:
    """Calls and tokens by key; summed before any dimension is joined, so little is shuffled."""
    return usage.groupBy(*keys).agg(F.count("*").alias("calls"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens")])


def report(usage: DataFrame, prices: DataFrame, key: str) -> DataFrame:
    """Per key: calls, tokens, cost, whether all of it has a price, and the models without one.

    prices (provider, model, price_in, price_out) is a dimension of a few thousand models. Sums of a
    key, provider and model are priced once; a key whose parts all lack a price costs null.
    """
    parts = grouped(usage, *dict.fromkeys([key, "provider", "model"]))
    known = prices.select(F.col("provider").alias("_p"), F.col("model").alias("_m"), "price_in", "price_out")
    priced = parts.join(known, (F.col("provider") == F.col("_p")) & (F.col("model") == F.col("_m")), "left")
    priced = priced.withColumn("cost", cost_usd(F.col("input_tokens"), F.col("output_tokens"), F.col("price_in"), F.col("price_out")))
    missing = F.array_sort(F.collect_set(F.when(F.col("cost").isNull(), F.col("model"))))
    return priced.groupBy(key).agg(F.sum("calls").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost").alias("cost_usd"), F.bool_and(F.col("cost").isNotNull()).alias("cost_complete"), missing.alias("unpriced_models"))


def with_total(report: DataFrame, key: str) -> DataFrame:
    """A report and its total row (null key): the cost is the sum of the groups' rounded costs.

    It is null if no group with calls has a price, and complete if every group is.
    """
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("calls", "input_tokens", "output_tokens")]
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_set("unpriced_models"))))
    total = report.agg(
        *sums, F.sum("cost_usd").alias("cost_usd"), F.coalesce(F.bool_and("cost_complete"), F.lit(True)).alias("cost_complete"), names.alias("unpriced_models")
    )
    cost = F.when(F.col("calls") == 0, F.lit(0)).otherwise(F.col("cost_usd"))
    empty = F.lit(None).cast(report.schema[key].dataType)
    return report.unionByName(total.withColumns({key: empty, "cost_usd": cost.cast(report.schema["cost_usd"].dataType)}))


def ledger_statistics(ledger: DataFrame, limits: DataFrame) -> DataFrame:
    """Per run: calls, calls without a price, tokens, cost as exact text, and the budget's flags.

    ledger: run_id, input_tokens, output_tokens, cost_usd (null: no price). limits: run_id,
    budget_limit, budget_exceeded (a per-item call was stopped). Runs without calls have a row.
    """
    cost = F.coalesce(F.sum(F.col("cost_usd").cast("decimal(18,6)")), F.lit(0)).cast("decimal(28,6)")
    sums = ledger.groupBy("run_id").agg(
        F.count("*").alias("calls"), F.count_if(F.col("cost_usd").isNull()).alias("unpriced"),
        F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o"), cost.alias("cost"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    tokens = zero(F.col("i")) + zero(F.col("o"))
    return limits.join(sums, "run_id", "left").select(
        "run_id", zero(F.col("calls")).alias("llm_calls"), zero(F.col("unpriced")).alias("llm_calls_unpriced"),
        zero(F.col("i")).alias("input_tokens"), zero(F.col("o")).alias("output_tokens"), tokens.alias("tokens"),
        F.coalesce(F.col("cost"), F.lit(0).cast("decimal(28,6)")).cast("string").alias("estimated_cost_usd"),
        (zero(F.col("unpriced")) == 0).alias("cost_complete"), "budget_limit", "budget_exceeded",
        (tokens > F.col("budget_limit")).alias("over_budget"),
    )


def report_json(report: DataFrame, key: str) -> DataFrame:
    """Each row of a report as a JSON document; costs are exact decimal text or null."""
    names = ["calls", "input_tokens", "output_tokens", "cost_usd", "cost_complete", "unpriced_models"]
    fields = [F.col(c).cast("string").alias(c) if c == "cost_usd" else F.col(c) for c in names]
    document = F.to_json(F.struct(F.col(key).cast("string").alias("key"), *fields), {"ignoreNullFields": "false"})
    return report.select(F.col(key), document.alias("document"))


def within_budget(items: DataFrame, group: str, order: str, tokens: str, limit: int) -> DataFrame:
    """Items that are called before their group's tokens exceed the limit: checked before each call, never reopened."""
    return running_total(items, "used_before", tokens, [group], order).where(F.col("used_before") <= limit)


def cheapest(models: DataFrame, provider: str, model: str, price: str) -> DataFrame:
    """The cheapest and the dearest model of each provider, ties to the smaller id."""
    return models.groupBy(provider).agg(F.min_by(model, F.struct(price, model)).alias("cheapest"), F.min_by(model, F.struct(-F.col(price), F.col(model))).alias("dearest"))
