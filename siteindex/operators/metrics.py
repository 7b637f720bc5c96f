"""Search metrics: merged by canonical URL, joined to the site's URLs, rolled up to verdicts.

Absent is not zero: a null click count means "not measured" all the way through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


@dataclass(frozen=True)
class Thresholds:
    """Numbers a verdict depends on. Fixed values by default."""

    coverage_include: float = 0.40
    coverage_exclude: float = 0.05
    concentration: float = 0.70
    large_group: int = 500
    least_clicks: int = 50
    least_exemplar_clicks: int = 10
    facet_impressions: int = 10_000
    facet_ctr: float = 0.002


def merge(rows: DataFrame, strict_nulls: bool = False) -> DataFrame:
    """One row for each ``key``: the first row's other fields, clicks and impressions summed.

    A lone null stays null; nulls that meet another row count as zero, unless
    ``strict_nulls`` asks that a sum of nulls alone stays null.
    """

    def total(c: str) -> Column:
        many = F.sum(c) if strict_nulls else F.sum(F.coalesce(c, F.lit(0)))
        return F.when(F.count(F.lit(1)) > 1, many).otherwise(F.min_by(c, "ord")).alias(c)

    first = [F.min_by(c, "ord").alias(c) for c in ("url", "ctr", "position", "source")]
    return rows.groupBy("key").agg(total("clicks"), total("impressions"), *first)


def join_report(known: DataFrame, metrics: DataFrame, sample: int = 20) -> DataFrame:
    """One row on how many metric keys match no key of the site, with the orphans of most clicks."""
    marked = metrics.join(known.select("key").distinct().withColumn("known_", F.lit(True)), "key", "left")
    orphan = F.col("known_").isNull()
    clicks = F.coalesce(F.col("clicks"), F.lit(0))
    counted = marked.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(orphan).alias("orphan_rows"),
        F.coalesce(F.sum(F.when(orphan, clicks)), F.lit(0)).alias("orphan_clicks"),
        F.coalesce(F.sum(clicks), F.lit(0)).alias("total_clicks"),
    )
    top = marked.where(orphan).orderBy(clicks.desc(), "key").limit(sample)
    listed = top.agg(F.transform(F.array_sort(F.collect_list(F.struct((-clicks).alias("a"), "key", "url"))), lambda x: x["url"]).alias("orphan_sample"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    out = counted.join(F.broadcast(listed), F.lit(True))  # one row each
    out = out.withColumn("joined_rows", F.col("total_rows") - F.col("orphan_rows")).withColumn("orphan_share", share("orphan_rows", "total_rows")).withColumn("orphan_click_share", share("orphan_clicks", "total_clicks"))
    return out.withColumn("looks_broken", (F.col("orphan_share") > 0.10) | (F.col("orphan_click_share") > 0.10))


def measured(members: DataFrame, metrics: DataFrame) -> DataFrame:
    """``members`` (group, url, key, ord) with clicks, impressions and whether they were measured at all."""
    both = members.join(metrics.select("key", "clicks", "impressions"), "key", "left")
    return both.withColumn("known", F.col("clicks").isNotNull() | F.col("impressions").isNotNull())


def rollup(joined: DataFrame, exemplars: int = 5, t: Thresholds = Thresholds()) -> DataFrame:
    """Group sums, median, exclusive 90th percentile, head share, exemplars, confidence.

    Quantiles and head share come from the histogram of click counts of a group, so
    that a group of millions of URLs is never one list.
    """
    c = F.coalesce(F.col("clicks"), F.lit(0))
    sums = joined.groupBy("group").agg(
        F.count(F.lit(1)).alias("url_count"),
        F.count_if("known").alias("known_count"),
        F.coalesce(F.sum(F.when(F.col("known"), c)), F.lit(0)).alias("total_clicks"),
        F.coalesce(F.sum(F.when(F.col("known"), F.col("impressions"))), F.lit(0)).alias("total_impressions"),
        F.count_if(F.col("known") & (c > 0)).alias("urls_with_clicks"),
        F.coalesce(F.max(F.when(F.col("known"), c)), F.lit(0)).alias("best_clicks"),
    )
    hist = joined.where("known").groupBy("group", c.alias("c")).agg(F.count(F.lit(1)).alias("n"))
    by = W.Window.partitionBy("group")
    up = by.orderBy("c").rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)
    down = by.orderBy(F.desc("c")).rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)
    h = hist.withColumn("upto", F.sum("n").over(up)).withColumn("before", F.col("upto") - F.col("n")).withColumn("above", F.sum("n").over(down) - F.col("n"))
    h = h.withColumn("size", F.sum("n").over(by)).withColumn("earners", F.coalesce(F.sum(F.when(F.col("c") > 0, F.col("n"))).over(by), F.lit(0)))
    at = lambda i: F.sum(F.when((F.col("before") <= i) & (i < F.col("upto")), F.col("c")))
    size, j = F.col("size"), F.col("j")
    h = h.withColumn("j", F.least(size - 1, F.greatest(F.lit(1), F.expr("9 * (size + 1) div 10")))).withColumn("d", 9 * (size + 1) - 10 * F.col("j"))
    h = h.withColumn("cut", F.greatest(F.lit(1), F.expr("earners div 10")))
    head = F.sum(F.when(F.col("c") > 0, F.col("c") * F.greatest(F.lit(0), F.least(F.col("n"), F.col("cut") - F.col("above")))))
    shape = h.groupBy("group").agg(
        ((at(F.expr("(size - 1) div 2")) + at(F.expr("size div 2"))) / 2).alias("median_clicks"),
        F.when(F.first("size") >= 10, (at(j - 1) * (10 - F.first("d")) + at(j) * F.first("d")) / 10).otherwise(F.max("c").cast("double")).alias("p90_clicks"),
        F.when((F.sum(F.col("c") * F.col("n")) > 0) & (F.first("earners") >= F.greatest(F.lit(1), F.expr("first(size) div 10"))), head / F.sum(F.col("c") * F.col("n"))).alias("head_share"),
    )
    best = W.Window.partitionBy("group").orderBy(c.desc(), "ord")
    top = joined.where("known").withColumn("rank_", F.row_number().over(best)).where((F.col("rank_") <= exemplars) & (c >= t.least_exemplar_clicks))
    listed = top.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank_", "url"))), lambda x: x["url"]).alias("exemplars"))
    out = sums.join(shape, "group", "left").join(listed, "group", "left")
    share = F.col("known_count") / F.col("url_count")
    return out.withColumns(
        {
            "median_clicks": F.coalesce("median_clicks", F.lit(0.0)),
            "p90_clicks": F.coalesce("p90_clicks", F.lit(0.0)),
            "exemplars": F.coalesce("exemplars", F.array().cast("array<string>")),
            "coverage": F.col("urls_with_clicks") / F.col("url_count"),
            "mean_ctr": F.when(F.col("total_impressions") > 0, F.col("total_clicks") / F.col("total_impressions")).otherwise(0.0),
            "confidence": F.when(share >= 0.8, "high").when(share >= 0.4, "medium").otherwise("low"),
        }
    )


def verdicts(groups: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """``groups`` plus the base verdict of the numbers alone (and the confidence it leaves)."""
    material = (F.col("total_clicks") >= t.least_clicks) & (F.col("best_clicks") >= t.least_exemplar_clicks)
    unshaped = F.col("head_share").isNull() & material
    covered = F.col("coverage") >= t.coverage_include
    concentrated = (F.col("head_share") >= t.concentration) & material
    verdict = (
        F.when(F.col("known_count") == 0, "review")
        .when(covered, "include_group")
        .when(concentrated, "promote_exemplars")
        .when(unshaped, "review")
        .when(F.col("coverage") >= t.coverage_exclude, "review")
        .when(F.col("url_count") > t.large_group, "exclude")
        .otherwise("review")
    )
    low = (F.col("known_count") == 0) | (~covered & unshaped)
    return groups.withColumn("verdict", verdict).withColumn("confidence", F.when(low, "low").otherwise(F.col("confidence")))


def overridden(judged: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Overrides over flags ``embargo``, ``identity``, ``valuable``, ``noise`` (patterns or null; identity is boolean).

    In order: nothing measured is left alone; embargo excludes for good; identity pages
    cannot be excluded; facets without exemplars are excluded; a low confidence does not
    exclude. Then the brief: valuable is a floor, noise a ceiling.
    """
    measured_, exemplars = F.col("known_count") > 0, F.size("exemplars") > 0
    embargo = measured_ & F.col("embargo").isNotNull()
    facet = (
        ~exemplars
        & (F.col("verdict") != "exclude")
        & (F.col("total_impressions") >= t.facet_impressions)
        & (F.col("mean_ctr") < t.facet_ctr)
        & (F.col("url_count") > t.large_group)
    )
    first = (
        F.when(~measured_, F.col("verdict"))
        .when(embargo, "exclude")
        .when(F.col("identity"), F.when(F.col("verdict") == "exclude", "include_group").otherwise(F.col("verdict")))
        .when(facet, "exclude")
        .when((F.col("verdict") == "exclude") & (F.col("confidence") == "low"), "review")
        .otherwise(F.col("verdict"))
    )
    out = judged.withColumn("first_", first)
    kept = F.when(exemplars, "promote_exemplars").otherwise("review")
    open_ = measured_ & F.col("embargo").isNull()
    floor = open_ & (F.col("first_") == "exclude") & F.col("valuable").isNotNull()
    ceiling = open_ & (F.col("first_") == "include_group") & F.col("noise").isNotNull()
    final = F.when(floor | ceiling, kept).otherwise(F.col("first_"))
    declared = F.when(embargo, F.col("embargo")).when(floor, F.col("valuable")).when(ceiling, F.col("noise"))
    changed = (F.col("first_") != F.col("verdict")) | embargo | floor | ceiling
    return out.withColumn("declared", declared).withColumn("overridden", changed).withColumn("verdict", final).drop("first_")


def best_source(rows: DataFrame) -> DataFrame:
    """For each (domain, url) the source of most clicks; ties go to the least id."""
    order = W.Window.partitionBy("domain", "url").orderBy(F.coalesce("clicks", F.lit(0)).desc(), "id")
    return rows.withColumn("rank_", F.row_number().over(order)).where("rank_ = 1").drop("rank_")
