"""Weighted fair queueing over sources, and proportional stratified sharding.

Both need running sums or ranks over whole sources, of which one may hold a third of
all rows. Rows are therefore dealt into fine buckets of a seeded hash; windows run
inside a bucket, and the offsets of buckets come from a small grouped table. No key
is ever one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..lineage import written
from .common import any_columns, words_of

ROWS_IN_BUCKET = 4096


def _source_key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("s:"), F.col(source)), F.lit("null"))


def _uniform(seed: int, *keys: Column) -> Column:
    """A double in [0, 1) from a seeded hash."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _phase(seed: int) -> Column:
    """A share in (0, 1] for each ``source_key``."""
    return 1 - _uniform(seed, F.lit("phase"), F.col("source_key"))


def _running(rows: DataFrame, part: str, measure: str, buckets: int) -> DataFrame:
    """``rows`` (with ``u``, ``tie``) plus ``before``: the measure's sum ahead of each row of ``part``.

    Order: (u, tie). Also ``part_total``, the measure's sum over the part.
    """
    rows = rows.withColumn("bucket", F.floor(F.col("u") * buckets).cast("long"))
    sums = rows.groupBy(part, "bucket").agg(F.sum(measure).alias("bucket_sum"))
    by_part = W.Window.partitionBy(part).orderBy("bucket")
    offsets = sums.select(
        part,
        "bucket",
        (F.sum("bucket_sum").over(by_part) - F.col("bucket_sum")).alias("offset"),
        F.sum("bucket_sum").over(W.Window.partitionBy(part)).alias("part_total"),
    )
    inside = W.Window.partitionBy(part, "bucket").orderBy("u", "tie").rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)
    local = rows.withColumn("before", F.sum(measure).over(inside) - F.col(measure))
    return local.join(offsets, [part, "bucket"]).withColumn("before", F.col("before") + F.col("offset")).drop("offset", "bucket")


def source_targets(sizes: DataFrame, budget: Column | None = None, weights: tuple[int, ...] = (5, 2, 1), epochs: int = 3) -> DataFrame:
    """Water filling: ``sizes`` (source, source_size) plus weight, target and the stopping time.

    Sources in code point order, null last, take the weights in turn. Virtual time V
    solves sum(min(weight * V, epochs * size)) = budget (all sizes by default).
    """
    everything = W.Window.partitionBy(F.lit(0))
    named = sizes.withColumn("n", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("n") - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(epochs))
    w = named.withColumn("weight", weight).withColumn("cap", cap).withColumn("ends", F.col("cap") / F.col("weight"))
    order = everything.orderBy("ends", "n")
    upto = order.rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)
    onward = order.rowsBetween(W.Window.currentRow, W.Window.unboundedFollowing)
    total = budget if budget is not None else F.sum("source_size").over(everything)
    w = w.withColumn("time", (total - (F.sum("cap").over(upto) - F.col("cap"))) / F.sum("weight").over(onward))
    w = w.withColumn("stop", F.min(F.when(F.col("time") <= F.col("ends"), F.struct("ends", "n", "time"))).over(everything)["time"])
    w = w.withColumn("target", F.least(F.col("cap"), F.col("weight") * F.col("stop")))
    return w.select("source", "source_size", "weight", "target", "stop")


def tie_of(docs: DataFrame) -> Column:
    """A row's own key: a hash of id, source and text. Only rows that repeat share it, so ranks agree in every run."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for c in ("doc_id", "source", "text") if c in docs.columns]
    return F.xxhash64(*parts)


def _met(docs: DataFrame, made: DataFrame, columns: list[str]) -> DataFrame:
    """``docs``, whole, with ``columns`` of ``made``: to the rows of one tie go, in any order, the rows of that tie.

    Texts are shuffled once; rows that repeat share a list as long as they repeat.
    """
    lists = written(made.groupBy("tie").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("places_")))
    joined = docs.withColumn("tie", tie_of(docs)).join(lists, "tie")
    turn = F.row_number().over(W.Window.partitionBy("tie").orderBy("tie"))
    return joined.withColumn("place_", F.element_at("places_", turn)).select(*docs.columns, *[F.col("place_")[c].alias(c) for c in columns])


@any_columns
def fair_queue_mix(docs: DataFrame, source: str = "source", weights: tuple[int, ...] = (5, 2, 1), epochs: int = 3, seed: int = 9) -> DataFrame:
    """``docs`` without its text, plus size, source_size, target and taken (words the mix takes, repeats counted).

    Each source's documents stand in a seeded order; a document's virtual finish time
    is its source's cumulative words over the source's weight, of its own words a seeded
    share (one for each source, so that small sources of equal sizes don't all finish at
    one time), later epochs following on the same order. All copies are ranged by finish time and the mix ends where the
    budget of all words is spent. Only the time slice in which the budget runs out
    needs a running sum; slices before it are taken whole. Words are counted once: what
    is ranked is a written table of sizes.

    Defined cases: null text has size 0 and is taken as 0; null source is a source of
    its own, last in order; rows that repeat or have equal ids count separately; rows of
    null id are told apart by their texts; an empty table gives an empty result.
    """
    return _queued(docs, source, weights, epochs, seed).drop("tie")


def repeated_rows(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs``, whole, each as often as the mix takes it."""
    named = docs.select(*[c for c in docs.columns if c in ("doc_id", "source", "text")])
    mixed = _queued(named, "source", **parameters).withColumn("copies", F.when(F.col("size") > 0, F.expr("cast(taken div size as int)")).otherwise(0))
    met = _met(docs, mixed.select("tie", "copies"), ["copies"]).where("copies > 0")
    return met.withColumn("copy_", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(docs.columns)


def _queued(docs: DataFrame, source: str, weights: tuple[int, ...] = (5, 2, 1), epochs: int = 3, seed: int = 9) -> DataFrame:
    tie = tie_of(docs)
    sized = docs.withColumns({"size": F.size(words_of(F.col("text"))).cast("long"), "source_key": _source_key(source), "tie": tie, "u": _uniform(seed, tie)})
    sized = written(sized.drop("text"))
    sizes = sized.groupBy(F.col(source).alias("source")).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs_in_source"))
    sizes = written(sizes)
    head = sizes.agg(F.sum("docs_in_source").alias("n"), F.sum("source_size").alias("words")).first()
    rows, budget = head["n"] or 0, head["words"] or 0
    targets = source_targets(sizes.drop("docs_in_source"), weights=weights, epochs=epochs).withColumn("source_key", _source_key("source")).drop("source")
    buckets = max(1, -(-rows // ROWS_IN_BUCKET))
    queued = _running(sized, "source_key", "size", buckets).drop("part_total", "u")
    slices = max(64, buckets)
    finish = lambda e: (F.col("source_size") * F.lit(e) + F.col("before") + F.col("size") * _phase(seed)) / F.col("weight")
    slot = lambda v: F.when(F.col("stop") > 0, F.floor(v / F.col("stop") * slices)).otherwise(F.lit(0)).cast("long")
    copies = F.array(*[F.struct(F.lit(e).alias("epoch"), finish(e).alias("finish"), slot(finish(e)).alias("slice")) for e in range(epochs)])
    queued = written(queued.join(written(targets), "source_key").withColumn("copies", copies))
    times = queued.where("size > 0").select("tie", "source_key", "size", F.explode("copies").alias("c")).select("tie", "source_key", "size", "c.*")
    sums = times.groupBy("slice").agg(F.sum("size").alias("slice_size"))
    running = sums.withColumn("end", F.sum("slice_size").over(W.Window.partitionBy(F.lit(0)).orderBy("slice")))
    cut = running.where(F.col("end") > budget).orderBy("slice").first()
    whole, spent = (cut["slice"], cut["end"] - cut["slice_size"]) if cut else (1 << 62, budget)
    last = times.where(F.col("slice") == whole)
    order = W.Window.partitionBy("slice").orderBy("finish", "source_key", "tie", "epoch").rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)
    edge = last.withColumn("at", F.sum("size").over(order) + F.lit(spent)).where(F.col("at") <= budget)
    edge = edge.groupBy("tie", "source_key").agg(F.max("finish").alias("upto"))
    early = F.size(F.filter("copies", lambda c: c["slice"] < whole))
    late = F.size(F.filter("copies", lambda c: (c["slice"] == whole) & (c["finish"] <= F.col("upto"))))
    joined = queued.join(edge, ["tie", "source_key"], "left")
    taken = F.col("size") * (early + F.when(F.col("upto").isNotNull(), late).otherwise(F.lit(0)))
    return joined.withColumn("taken", taken.cast("long")).drop("copies", "upto", "before", "weight", "stop", "source_key")


@any_columns
def stratified_shards(docs: DataFrame, shards: int = 40, source: str = "source", seed: int = 7) -> DataFrame:
    """``docs`` without its text, plus shard and slot by proportional stratified interleaving.

    Rows of a source stand in a seeded order and get the fractional rank
    (rank - phase) / rows of the source, the phase being seeded in [0, 1) for each source,
    so that sources of one row lie anywhere and not all in the middle; in the order of that fraction the table is cut
    into ``shards`` runs whose row counts differ by one at most, so that each run has
    the table's mixture. What is ranked is a written table without texts.

    Defined cases: null source is a source of its own; null text changes nothing; rows
    that repeat or have equal or null ids are separate rows; an empty table gives an
    empty result.
    """
    return _placed(docs, shards, source, seed).drop("tie")


def sharded_rows(docs: DataFrame, shards: int = 40, **parameters) -> DataFrame:
    """``docs``, whole, plus shard and slot."""
    named = docs.select(*[c for c in docs.columns if c in ("doc_id", "source", "text")])
    return _met(docs, _placed(named, shards, **parameters), ["shard", "slot"])


def _placed(docs: DataFrame, shards: int, source: str = "source", seed: int = 7) -> DataFrame:
    keyed = docs.withColumns({"source_key": _source_key(source), "one": F.lit(1).cast("long"), "tie": tie_of(docs)})
    keyed = written(keyed.withColumn("u", _uniform(seed, F.col("tie"))).drop("text"))
    rows = keyed.count()
    buckets = max(1, -(-rows // ROWS_IN_BUCKET))
    ranked = _running(keyed, "source_key", "one", buckets)
    ranked = ranked.withColumn("u", (F.col("before") + _phase(seed)) / F.col("part_total")).withColumn("order", F.xxhash64(F.lit(seed), F.col("tie"))).drop("before", "part_total")
    # Every bucket of the fraction holds its share of every source; a bucket is one window.
    ranked = written(ranked.withColumn("bucket", F.least(F.floor(F.col("u") * buckets), F.lit(buckets - 1)).cast("long")))
    sums = ranked.groupBy("bucket").agg(F.count(F.lit(1)).alias("in_bucket"))
    offsets = sums.select("bucket", (F.sum("in_bucket").over(W.Window.partitionBy(F.lit(0)).orderBy("bucket")) - F.col("in_bucket")).alias("offset"))
    inside = W.Window.partitionBy("bucket").orderBy("u", "order", "tie")
    placed = ranked.withColumn("local", F.row_number().over(inside) - 1).join(offsets, "bucket").withColumn("at", F.col("local") + F.col("offset"))
    n = max(1, rows)
    placed = placed.withColumn("shard", F.expr(f"(at * {shards}) div {n}").cast("int"))
    first = F.expr(f"(cast(shard as bigint) * {n} + {shards - 1}) div {shards}")
    return placed.withColumn("slot", F.col("at") - first).drop("one", "u", "order", "bucket", "local", "offset", "at", "source_key")
