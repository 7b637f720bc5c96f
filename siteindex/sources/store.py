"""Writes of tables by key: replaced partitions, latest-wins merges, clones and cascading deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def replace_by_key(rows: DataFrame, path: str, key: str) -> None:
    """Writes ``rows`` so that they replace what ``path`` holds for their keys; other keys stay. A rerun gives the same table."""
    rows.repartition(key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key: of the greatest ``order``, a new one before an old one of the same."""
    both = old.withColumn("new_", F.lit(0)).unionByName(new.withColumn("new_", F.lit(1)))
    first = F.row_number().over(W.Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("new_")))
    return both.withColumn("n_", first).where("n_ = 1").drop("n_", "new_")


def clone_runs(tables: dict[str, DataFrame], runs: DataFrame, run: str = "run") -> dict[str, DataFrame]:
    """Every table with copies of the rows of ``runs`` (run, clone) under the clone's key."""
    out = {}
    for name, rows in tables.items():
        copies = rows.join(runs, run).drop(run).withColumnRenamed("clone", run)
        out[name] = rows.unionByName(copies)
    return out


def delete_runs(tables: dict[str, DataFrame], gone: DataFrame, run: str = "run") -> dict[str, DataFrame]:
    """Every table without the rows of the runs in ``gone`` (run)."""
    return {name: rows.join(gone, run, "left_anti") for name, rows in tables.items()}


#: Policy pages by what their address holds, in order of precedence. Fixed values.
POLICIES = (
    ("privacy", "Privacy"), ("terms", "Terms"), ("refund", "Refunds"), ("returns", "Returns"), ("shipping", "Shipping"),
    ("delivery", "Delivery"), ("cookie", "Cookies"), ("accessibility", "Accessibility"), ("disclaimer", "Disclaimer"),
)


def split_links(pages: DataFrame, contact: Column, limit: int = 12) -> DataFrame:
    """(scope, ord, url, kind, label) of pages (scope, ord, url, title): the first of each policy, the first contact page, ``limit`` others.

    A policy page is nothing else; further contact pages count among the others.
    """
    low = F.lower("url")
    policy = F.coalesce(*[F.when(low.contains(k), F.lit(v)) for k, v in POLICIES])
    rows = pages.withColumns({"policy": policy, "contact_": contact})
    first = lambda *by: F.row_number().over(W.Window.partitionBy(*by).orderBy("ord"))
    named = rows.where("policy is not null").withColumn("n", first("scope", "policy")).where("n = 1")
    rest = rows.where("policy is null").withColumn("n", first("scope", "contact_")).withColumn("is_contact", F.col("contact_") & (F.col("n") == 1))
    others = rest.where("not is_contact").withColumn("m", first("scope")).where(F.col("m") <= limit)
    shape = lambda df, kind, label: df.select("scope", "ord", "url", F.lit(kind).alias("kind"), label.alias("label"))
    label = F.when(F.coalesce("title", F.lit("")) == "", F.col("url")).otherwise(F.col("title"))
    return shape(named, "policy", F.col("policy")).unionByName(shape(rest.where("is_contact"), "contact", F.lit("Contact"))).unionByName(shape(others, "read", label))
