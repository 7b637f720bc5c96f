"""Numbers in an order, of all rows or of each key's, without one task that sorts them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..lineage import written


def numbered(rows: DataFrame, order: list[Column], name: str, partitions: int | None = None) -> DataFrame:
    """``rows`` plus ``name``: each row's place, from 0, in the order of the columns ``order``.

    Ranges of the order are ranked each on its own; what is summed in one task is one
    count for each range. Rows of equal order may take their places in any order.
    """
    ranged = rows.repartitionByRange(*([partitions] if partitions else []), *order)
    # Written, as the ranges are read twice and a sample decides on them.
    held = written(ranged.withColumn("range_", F.spark_partition_id()))
    counts = held.groupBy("range_").agg(F.count(F.lit(1)).alias("rows_"))
    ahead = W.Window.partitionBy(F.lit(0)).orderBy("range_")
    starts = counts.select("range_", (F.sum("rows_").over(ahead) - F.col("rows_")).alias("start_"))
    inside = F.row_number().over(W.Window.partitionBy("range_").orderBy(*order)) - 1
    return held.withColumn(name, inside).join(F.broadcast(starts), "range_").withColumn(name, (F.col(name) + F.col("start_")).cast("bigint")).drop("range_", "start_")


def numbered_within(rows: DataFrame, part: tuple[str, ...], order: list[Column], name: str, total: str | None = None, partitions: int | None = None) -> DataFrame:
    """``rows`` plus ``name``: each row's place, from 0, among the rows of equal ``part``, and ``total``, their number.

    Ranges go by key and order, so that a key of many rows takes many ranges. Each range
    ranks its own rows of a key; what is summed is one count for each key and range. Null
    keys are keys. Rows of equal order may take their places in any order.
    """
    ranged = rows.repartitionByRange(*([partitions] if partitions else []), *[F.col(c) for c in part], *order)
    held = written(ranged.withColumn("range_", F.spark_partition_id()))  # as above
    counts = held.groupBy(*part, "range_").agg(F.count(F.lit(1)).alias("rows_"))
    key = W.Window.partitionBy(*part)
    starts = counts.select(
        *[F.col(c).alias(f"{c}_key_") for c in part],
        F.col("range_").alias("range_key_"),
        (F.sum("rows_").over(key.orderBy("range_")) - F.col("rows_")).alias("start_"),
        F.sum("rows_").over(key).alias("total_"),
    )
    inside = F.row_number().over(W.Window.partitionBy("range_", *part).orderBy(*order)) - 1
    same = F.col("range_") == F.col("range_key_")
    for c in part:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_key_"))
    out = held.withColumn(name, inside).join(starts, same).withColumn(name, (F.col(name) + F.col("start_")).cast("bigint"))
    if total:
        out = out.withColumn(total, F.col("total_"))
    return out.select(*rows.columns, name, *([total] if total else []))
