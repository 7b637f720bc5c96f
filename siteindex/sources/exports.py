"""CSV exports: files of different headers and languages, archives, and files too large for one task.

A file is read as lines, in splits. Quotes before a line, summed over its split and the
splits before it, tell whether the line begins a record, so that quoted line breaks
survive any split. Every file's first record is its own header; fields are looked up in
it row by row, so that one read may mix files of different columns.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import text
from .crawl import ALIASES, METRIC_HEADERS, WRONG_DIMENSION

#: One cell and the comma after it.
CELL = r'(?s)\s*"(?:[^"]|"")*"[^,]*,|[^,]*,'


def csv_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, value): lines of text files; ``block`` is where a split begins, ``at`` orders its lines."""
    rows = spark.read.text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def zip_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the first pages CSV in each archive; an archive without one gives no line.

    Archives can't be split, so that one is one task's work; downloads are some megabytes.
    """

    def unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as bundle:
                    name = next((n for n in bundle.namelist() if "page" in n.lower() and n.lower().endswith(".csv")), None)
                    body = bundle.read(name).decode("utf-8-sig", errors="replace") if name else None
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([body], pa.string())], names=["file", "body"])

    files = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(unzip, "file string, body string")
    rows = files.where("body is not null").select("file", F.posexplode(F.split("body", "\r?\n")).alias("at", "value"))
    return rows.select("file", F.lit(0).cast("bigint").alias("block"), F.col("at").cast("bigint").alias("at"), "value")


def csv_records(lines: DataFrame) -> DataFrame:
    """(file, ord, header, cells): records after the header, ``ord`` from 0 in file order; blank lines are none."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    rows = lines.withColumn("quotes", quotes)
    ahead = W.Window.partitionBy("file").orderBy("block").rowsBetween(W.Window.unboundedPreceding, -1)
    splits = rows.groupBy("file", "block").agg(F.sum("quotes").alias("n"))
    offsets = splits.select("file", "block", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("offset"))
    inside = W.Window.partitionBy("file", "block").orderBy("at")
    so_far = inside.rowsBetween(W.Window.unboundedPreceding, -1)
    rows = rows.join(offsets, ["file", "block"]).withColumn("before", F.coalesce(F.sum("quotes").over(so_far), F.lit(0)) + F.col("offset"))
    begins = (F.col("before") % 2 == 0) & (F.trim("value") != "")
    rows = rows.where((F.col("before") % 2 == 1) | begins).withColumn("begins", begins)
    # Records are numbered through the file; a line that continues one has its number, even in a later split.
    counted = rows.groupBy("file", "block").agg(F.count_if("begins").alias("n"))
    starts = counted.select("file", "block", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    upto = inside.rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)
    rows = rows.join(starts, ["file", "block"]).withColumn("record", F.sum(F.col("begins").cast("bigint")).over(upto) + F.col("start") - 1)
    open_ = (F.col("quotes") % 2 == 1) | ~F.col("begins")
    whole = rows.where(~open_).select("file", "record", "value")
    # Only records of several lines are put together.
    broken = rows.where(open_).groupBy("file", "record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "value"))), lambda x: x["value"]), "\n").alias("value"))
    records = whole.unionByName(broken)
    cell = F.regexp_extract_all(F.concat("value", F.lit(",")), F.lit(CELL), F.lit(0))
    bare = F.transform(cell, lambda x: F.trim(F.left(x, F.length(x) - 1)))
    cells = F.transform(bare, lambda x: F.when(x.startswith('"'), F.replace(F.regexp_replace(x, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(x))
    records = records.select("file", "record", cells.alias("cells"))
    headers = records.where("record = 0").select("file", F.transform("cells", lambda h: F.lower(F.trim(F.regexp_replace(h, "^﻿", "")))).alias("header"))
    return records.where("record > 0").join(headers, "file").select("file", (F.col("record") - 1).alias("ord"), "header", "cells")


def _cell(at: Column) -> Column:
    """The cell at a place (from 1; 0 or null: none)."""
    return F.when(at > 0, F.get("cells", (at - 1).cast("int")))


def crawl_fields(records: DataFrame) -> DataFrame:
    """(file, ord and one column for each field of a crawl export): the first alias with a value, stripped, or ""."""
    fields = {}
    for name, aliases in ALIASES.items():
        found = [F.nullif(_cell(F.array_position("header", a)), F.lit("")) for a in aliases]
        fields[name] = F.trim(F.coalesce(*found, F.lit("")))
    return records.select("file", "ord", *[c.alias(n) for n, c in fields.items()])


def _place(words: tuple[str, ...]) -> Column:
    """Place from 1 of the first header that contains one of ``words``; 0 for none."""
    hits = F.transform("header", lambda h: h.rlike("|".join(words)))
    return F.array_position(hits, F.lit(True))


def problem(header: Column) -> Column:
    """Why a search-metrics export can't be read by its header, or null."""
    wrong = F.coalesce(*[F.when(F.array_contains(header, w), F.concat(F.lit(f"this is an export of {kind}, not of pages (column '{w}')"))) for w, kind in WRONG_DIMENSION.items()])
    unnamed = F.when(_place(METRIC_HEADERS["url"]) == 0, F.concat(F.lit("no URL column among "), F.array_join(header, ", ")))
    empty = F.when((_place(METRIC_HEADERS["clicks"]) == 0) & (_place(METRIC_HEADERS["impressions"]) == 0), "neither clicks nor impressions: nothing to rank on")
    return F.coalesce(wrong, unnamed, empty)


def refused_files(records: DataFrame) -> DataFrame:
    """(file, problem) of exports that are no pages exports."""
    return records.groupBy("file").agg(F.first("header").alias("header")).withColumn("problem", problem(F.col("header"))).where("problem is not null").select("file", "problem")


def metric_rows(records: DataFrame, source: str = "upload") -> DataFrame:
    """(file, ord, url, clicks, impressions, ctr, position, source) of rows with an absolute URL in files that can be read."""
    value = lambda f: text.locale_number(_cell(_place(METRIC_HEADERS[f])))
    url = F.trim(_cell(_place(METRIC_HEADERS["url"])))
    rows = records.where(problem(F.col("header")).isNull()).withColumn("url", url).where(F.col("url").rlike("^https?://"))
    return rows.select("file", "ord", "url", value("clicks").cast("bigint").alias("clicks"), value("impressions").cast("bigint").alias("impressions"), value("ctr").alias("ctr"), value("position").alias("position"), F.lit(source).alias("source"))
