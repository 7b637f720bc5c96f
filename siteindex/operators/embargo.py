"""Embargo: everything that an embargoed address left behind, out of every table that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns

#: Addresses in running text. Fixed value.
ADDRESS = r'https?://[^\s<>")\]]+'


def _named(url: Column, globs: tuple[str, ...]) -> Column:
    return patterns.first_match(url, globs).isNotNull()


def mentions(text: Column, globs: tuple[str, ...]) -> Column:
    """Whether a text holds an embargoed address anywhere."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({ADDRESS})"), F.lit(1))
    return F.exists(found, lambda u: _named(u, globs))


def without_lines(text: Column, globs: tuple[str, ...]) -> Column:
    """The text without the lines that mention an embargoed address; all else stays to the byte."""
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~mentions(x, globs)), "\n")


def removed_lines(text: Column, globs: tuple[str, ...]) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: mentions(x, globs)))


def purged(tables: dict[str, DataFrame], globs: tuple[str, ...]) -> dict[str, DataFrame]:
    """The tables without what the embargo names, under their names.

    ``pages`` and ``metrics`` (url) lose rows; ``runs`` and ``revisions`` (index_text,
    full_text) lose lines of index texts, and full texts, which have no safe place to be
    cut, are emptied.
    """
    out = {}
    for name in ("pages", "metrics"):
        if name in tables:
            out[name] = tables[name].where(~F.coalesce(_named(F.col("url"), globs), F.lit(False)))
    for name in ("runs", "revisions"):
        if name in tables:
            full = F.when(mentions(F.col("full_text"), globs), F.lit("")).otherwise(F.col("full_text"))
            out[name] = tables[name].withColumns({"index_text": without_lines(F.col("index_text"), globs), "full_text": full})
    return out


def purge_report(tables: dict[str, DataFrame], globs: tuple[str, ...]) -> DataFrame:
    """(table, rows, index_lines, full_texts): what :func:`purged` takes out of each table; rows are those it drops or alters."""
    parts = []
    for name in ("pages", "metrics"):
        gone = F.count_if(_named(F.col("url"), globs))
        parts.append(tables[name].agg(F.lit(name).alias("table"), gone.alias("rows"), F.lit(0).cast("bigint").alias("index_lines"), F.lit(0).cast("bigint").alias("full_texts")))
    for name in ("runs", "revisions"):
        lines, full = removed_lines(F.col("index_text"), globs), mentions(F.col("full_text"), globs)
        parts.append(tables[name].agg(F.lit(name).alias("table"), F.count_if((lines > 0) | full).alias("rows"), F.coalesce(F.sum(lines), F.lit(0)).cast("bigint").alias("index_lines"), F.count_if(full).alias("full_texts")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
