"""Duplicate, thin and near-duplicate filters over page entries, each with what it removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import ranking
from ..functions.order import numbered_within


def marked_duplicates(entries: DataFrame, part: tuple[str, ...] = ()) -> DataFrame:
    """``entries`` plus ``removed``: another canonical that is present, or a content hash seen before.

    Of equal hashes the first entry by ``ord`` stays, counting only entries that the
    canonical rule keeps.
    """
    present = entries.select(*part, F.col("url").alias("canonical")).distinct().withColumn("present_", F.lit(True))
    known = entries.join(present, [*part, "canonical"], "left")
    elsewhere = (F.col("canonical") != "") & (F.col("canonical") != F.col("url")) & F.col("present_").isNotNull()
    known = known.withColumn("elsewhere_", elsewhere)
    # Entries without a hash are dealt apart, so that they make no hot window.
    key = F.when(F.col("content_hash") == "", F.concat(F.lit("#"), F.col("ord").cast("string"))).otherwise(F.concat(F.lit("="), F.col("content_hash")))
    seen = W.Window.partitionBy(*part, key, "elsewhere_").orderBy("ord")
    again = (F.col("content_hash") != "") & (F.row_number().over(seen) > 1)
    return known.withColumn("removed", F.col("elsewhere_") | again).drop("present_", "elsewhere_")


def is_thin(least: int = 50) -> Column:
    return F.col("word_count").between(1, least - 1)


def protect_floor(entries: DataFrame) -> DataFrame:
    """One row: the unique inlinks at the end of the first tenth, largest first."""
    counted = entries.groupBy("unique_inlinks").agg(F.count(F.lit(1)).alias("n"))
    upto = W.Window.partitionBy(F.lit(0)).orderBy(F.desc("unique_inlinks"))
    whole = W.Window.partitionBy(F.lit(0))
    ranked = counted.select("unique_inlinks", F.sum("n").over(upto).alias("upto"), F.sum("n").over(whole).alias("total"))
    return ranked.where(F.col("upto") > F.expr("total div 10")).agg(F.max("unique_inlinks").alias("floor_"))


def marked_near_duplicates(entries: DataFrame, threshold: float = 90.0) -> DataFrame:
    """``entries`` plus ``removed``: similar to another page and not among the most linked tenth."""
    floor = F.broadcast(protect_floor(entries))  # one row
    both = entries.join(floor, F.lit(True), "left")
    protected = (F.col("floor_") > 0) & (F.col("unique_inlinks") >= F.col("floor_"))
    return both.withColumn("removed", (F.col("closest_similarity") >= threshold) & ~protected).drop("floor_")


def filter_chain(entries: DataFrame, near: bool = False, thin: bool = False, threshold: float = 90.0, least: int = 50) -> tuple[DataFrame, DataFrame]:
    """The entries that stay, and (stage, removed) counts of each stage in turn."""
    marked = marked_duplicates(entries)
    reports = [marked.agg(F.lit("duplicates").alias("stage"), F.count_if("removed").alias("removed"))]
    kept = marked.where("not removed").drop("removed")
    if near:
        marked = marked_near_duplicates(kept, threshold)
        reports.append(marked.agg(F.lit("near duplicates").alias("stage"), F.count_if("removed").alias("removed")))
        kept = marked.where("not removed").drop("removed")
    if thin:
        reports.append(kept.agg(F.lit("thin content").alias("stage"), F.count_if(is_thin(least)).alias("removed")))
        kept = kept.where(~is_thin(least))
    report = reports[0]
    for r in reports[1:]:
        report = report.unionByName(r)
    return kept, report


def by_importance(entries: DataFrame) -> DataFrame:
    """``entries`` plus ``score`` and ``place``; ties keep the input order."""
    scored = entries.withColumn("score", ranking.importance())
    ranked = numbered_within(scored, ("site",), [F.desc("score"), F.col("ord")], "place")
    return ranked.withColumn("place", (F.col("place") + 1).cast("int"))
