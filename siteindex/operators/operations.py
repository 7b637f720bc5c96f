"""Costs, run logs and job queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: US dollars a million tokens, prompt and completion. Fixed values.
RATES = {
    "gpt-4o": (2.50, 10.00),
    "gpt-4o-mini": (0.15, 0.60),
    "gpt-4.1": (2.00, 8.00),
    "gpt-4.1-mini": (0.40, 1.60),
    "gpt-4.1-nano": (0.10, 0.40),
    "o3": (2.00, 8.00),
    "o4-mini": (1.10, 4.40),
}
SERP_CALL_USD = 0.0025


def rate_for(model: Column, rates: dict[str, tuple[float, float]] | None = None) -> Column:
    """(prompt, completion) of the model, by its longest listed prefix; null where none is listed."""
    rates = rates or RATES
    tests = [F.when(model.startswith(k), F.struct(F.lit(a).alias("prompt"), F.lit(b).alias("completion"))) for k, (a, b) in sorted(rates.items(), key=lambda x: -len(x[0]))]
    return F.coalesce(*tests)


def run_costs(usage: DataFrame, calls: DataFrame) -> DataFrame:
    """(run, prompt, completion, llm_usd, serp_usd, unpriced_tokens, unpriced_models) over (run, model, prompt, completion) and (run, serp_calls)."""
    priced = usage.withColumn("rate", rate_for(F.col("model")))
    usd = F.col("prompt") / 1e6 * F.col("rate.prompt") + F.col("completion") / 1e6 * F.col("rate.completion")
    none = F.col("rate").isNull()
    g = priced.groupBy("run").agg(
        F.sum("prompt").alias("prompt"),
        F.sum("completion").alias("completion"),
        F.coalesce(F.sum(usd), F.lit(0.0)).alias("llm_usd"),
        F.coalesce(F.sum(F.when(none, F.col("prompt") + F.col("completion"))), F.lit(0)).alias("unpriced_tokens"),
        F.array_sort(F.collect_set(F.when(none, F.col("model")))).alias("unpriced_models"),
    )
    return g.join(calls, "run", "left").withColumn("serp_usd", F.coalesce(F.col("serp_calls"), F.lit(0)) * SERP_CALL_USD).drop("serp_calls")


def cost_totals(costs: DataFrame) -> DataFrame:
    """One row: all spend; the average divides it by priced runs alone."""
    total = F.sum(F.col("llm_usd") + F.col("serp_usd"))
    priced = F.count_if(F.size("unpriced_models") == 0)
    return costs.agg(F.count(F.lit(1)).alias("runs"), priced.alias("priced_runs"), total.alias("total_usd"), F.when(priced > 0, total / priced).alias("usd_per_run"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("unpriced_models")))), ",").alias("unpriced_models"))


def eligible_jobs(jobs: DataFrame) -> DataFrame:
    """Waiting jobs of which none with the same lock runs or stands before them (priority, then id).

    One pass of windows over each lock instead of a correlated anti-join.
    """
    by = W.Window.partitionBy("lock")
    before = by.orderBy(F.desc("priority"), "id").rowsBetween(W.Window.unboundedPreceding, -1)
    running = F.max((F.col("status") == "doing").cast("int")).over(by) == 1
    ahead = F.coalesce(F.max((F.col("status") == "todo").cast("int")).over(before), F.lit(0)) == 1
    free = F.col("lock").isNull()
    marked = jobs.where(~free).withColumn("blocked", running | ahead).unionByName(jobs.where(free).withColumn("blocked", F.lit(False)))
    return marked.where((F.col("status") == "todo") & ~F.col("blocked")).drop("blocked")


def next_job(jobs: DataFrame) -> DataFrame:
    return eligible_jobs(jobs).orderBy(F.desc("priority"), "id").limit(1)
