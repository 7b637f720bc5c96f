"""A corpus pipeline over ``documents``: quality, near duplicates, decontamination, mixture, shards.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept; all
but the last return the columns of ``documents``. Documents that the rules reject go,
one document of each near-duplicate class stays, contaminated documents go, the
mixture repeats and drops documents to reach the sources' target weights, and the last
stage gives each row its shard and slot.

Defined cases, in every stage: null ids, texts, languages and sources are values like
others (a null text has no words: the quality rules reject it); rows that repeat count as
often as they stand, but for near duplicates, of which one row of a class stays; ties go
by the operators' seeded or least keys, so that reruns agree; very long texts are read
whole; an empty table stays empty; further columns, whatever their names, come back as
they were, but that shard and slot replace columns of these names.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteindex.lineage import settled
from siteindex.llm import decontaminate, mixing, near_duplicates, quality_rules
from siteindex.llm.common import set_apart, table

SHARDS = 40

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def own_columns(stage: Stage) -> Stage:
    """Runs a stage on tables with any extra columns, which come back as they were."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        plain, names = set_apart(docs)
        out = stage(spark, plain, sf_dir)
        made = [c for c in out.columns if c not in plain.columns]
        return out.select(*[F.col(c).alias(names.get(c, c)) for c in plain.columns if names.get(c) not in made], *made)

    return run_stage


@own_columns
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and keep enough lines that are not their host's furniture; texts stay whole."""
    return quality_rules.accepted(docs)


@own_columns
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one of least id."""
    return near_duplicates.one_of_each_class(docs)


@own_columns
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lie in benchmark windows."""
    return decontaminate.clean_rows(docs, table(spark, sf_dir, "benchmark"))


@own_columns
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (its words taken over its words)."""
    return mixing.repeated_rows(docs)


@own_columns
def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` plus shard and slot."""
    return mixing.sharded_rows(docs, SHARDS)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixture),
    ("sharding", sharding),
]

#: Near duplicates and exact containment over hashed signatures have no SQL form; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet and reread as the next one's input.

    What a stage wrote on its way is deleted when its result is written.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settled(spark, functools.partial(stage, spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
