"""Near-duplicate classes by ProbMinHash signatures, banding and exact verification.

Signature. A text's shingles (five words each) are weighted by their counts. Every
shingle sends a Poisson process of arrivals whose rate is its weight, at exponential
gaps, each arrival hitting a uniform register; a register keeps the shingle of its
earliest arrival. Arrivals stop once they come later than the latest register
(early termination), so that a text costs about as many draws as it has shingles plus
registers. Two texts agree in a register with their probability Jaccard similarity.

Weights are counts to the power ``power``: 1 by default, so that a text that repeats a
passage differs from one that does not. At 0, and where all of a text's shingles occur
equally often, the probability Jaccard is the Jaccard of the shingle sets.

Banding. Only distinct texts are banded. Every text meets a few texts of its buckets;
members of one component are never paired again, so a group of near copies costs about
its size. What is then still apart inside a bucket, such as short texts around one
common line, is compared by way of shared rare shingles, which loses no link and makes
no list of all pairs. No bucket is capped.

Verification. A link needs a similarity of ``threshold``, computed exactly from the two
texts' shingles. Classes are the connected components of the links.

Defined cases: a text of one to four words is one shingle; null and wordless texts have
none and are alone unless their text repeats exactly (nulls are each alone); rows that
repeat are in one class; a class is named by its least document id.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from ..lineage import written
from .common import POWERS, Hashes, any_columns, arrow, mix, texts_as_bytes, word_hashes

WIDTH = 5
#: Cells of a text's mass, and the whole mass in them.
CELLS, WHOLE = 128, 32767


def shingle_hashes(text: bytes, width: int = WIDTH) -> np.ndarray:
    """One hash for each run of ``width`` words (lower-cased A-Z; whitespace separates words)."""
    words = word_hashes(text.lower())
    starts = np.arange(len(words) - min(width, len(words)) + 1) if len(words) else np.zeros(0, np.int64)
    return Hashes(words, POWERS[1]).of(starts, starts + min(width, len(words)))


def _unit(state: np.ndarray) -> np.ndarray:
    """Doubles in (0, 1] from mixed 64-bit states."""
    return ((state >> np.uint64(11)).astype(np.float64) + 1) / float(1 << 53)


def prob_minhash(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, docs: int, registers: int) -> np.ndarray:
    """Signatures (docs x registers) of weighted shingles given as parallel arrays.

    Arrival k of a shingle has its gap and register from hashes of (shingle, k) alone,
    so equal shingles send equal arrivals in every text, scaled by their weight. The
    register's value is the shingle's hash. A text without shingles has zeros.
    """
    best = np.full(docs * registers, np.inf)
    owner = np.zeros(docs * registers, np.uint64)
    time = np.zeros(len(doc))
    total = np.bincount(doc, weight, docs)
    rate = weight / total[doc]
    live = np.arange(len(doc))
    k = 0
    while len(live):
        # Few shingles must fill all registers: several arrivals a round for them.
        each = max(1, int(2 * registers * docs / max(len(live), 1)) if k else 1)
        for _ in range(min(each, 64)):
            k += 1
            state = mix(shingle[live] + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            time[live] -= np.log(_unit(state)) / rate[live]
            slot = doc[live] * registers + (mix(state) % np.uint64(registers)).astype(np.int64)
            t = time[live]
            np.minimum.at(best, slot, t)
            won = best[slot] == t
            owner[slot[won]] = shingle[live[won]]
        limit = best.reshape(docs, registers).max(1)
        live = live[time[live] < limit[doc[live]]]
    return owner.reshape(docs, registers)


def signatures(docs: DataFrame, bands: int, rows: int, width: int = WIDTH, power: float = 1.0, block: int = 200_000) -> DataFrame:
    """``docs`` without its text plus ``buckets``: one hash for each band, or null without shingles."""
    registers = bands * rows
    names = [c for c in docs.columns if c != "text"]

    def keys(parts: list[np.ndarray]) -> np.ndarray:
        doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        hashes = np.concatenate(parts)
        order = np.lexsort((hashes, doc))
        doc, hashes = doc[order], hashes[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
        first = np.flatnonzero(new)
        weight = np.diff(np.append(first, len(doc))).astype(np.float64) ** power
        sig = prob_minhash(doc[first], hashes[first], weight, len(parts), registers)
        key = np.tile(np.arange(bands, dtype=np.uint64), (len(parts), 1))
        for r in range(rows):
            key = mix(key * np.uint64(31) + sig[:, r::rows])
        return key.view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[np.ndarray | None] = []
            at: list[int] = []
            parts: list[np.ndarray] = []
            size = 0

            def flush(at: list[int], parts: list[np.ndarray], out: list) -> None:
                for i, k in zip(at, keys(parts) if parts else (), strict=True):
                    out[i] = k

            for i, text in enumerate(texts_as_bytes(batch.column(batch.num_columns - 1))):
                hashes = shingle_hashes(text, width)
                out.append(None)
                if len(hashes):
                    at.append(i)
                    parts.append(hashes)
                    size += len(hashes)
                if size >= block:
                    flush(at, parts, out)
                    at, parts, size = [], [], 0
            flush(at, parts, out)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.list_(pa.int64()))], names=[*batch.schema.names[:-1], "buckets"])

    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField("buckets", T.ArrayType(T.LongType()))])
    return arrow(docs.select(*names, "text"), run, schema)


def similarity(a: np.ndarray, b: np.ndarray, power: float = 1.0) -> float:
    """Probability Jaccard of two shingle lists, shingles weighing their count to a power (0: sets' Jaccard)."""
    x, nx = np.unique(a, return_counts=True)
    y, ny = np.unique(b, return_counts=True)
    _, ix, iy = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if power == 0:
        return len(ix) / max(len(x) + len(y) - len(ix), 1)
    # Sum over shared shingles of 1 / sum(max(x'/x, y'/y)); sorted by y/x the inner sum splits in two.
    wx, wy = nx.astype(np.float64) ** power, ny.astype(np.float64) ** power
    wx, wy = wx / wx.sum(), wy / wy.sum()
    p, q = wx[ix], wy[iy]
    only_x, only_y = 1 - p.sum(), 1 - q.sum()
    ratio = q / p
    order = np.argsort(ratio, kind="stable")
    p, q, ratio = p[order], q[order], ratio[order]
    upto = np.searchsorted(ratio, ratio, "right")
    low = np.concatenate([[0], np.cumsum(p)])[upto] + only_x
    high = q.sum() - np.concatenate([[0], np.cumsum(q)])[upto] + only_y
    return float((1 / (low / p + high / q)).sum())


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, width: int = WIDTH, power: float = 1.0) -> DataFrame:
    """``pairs`` (a, b) of text ids whose similarity reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, np.ndarray] | None = None
        for batch in batches:
            keep = []
            for x, y in zip(texts_as_bytes(batch.column(2)), texts_as_bytes(batch.column(3)), strict=True):
                if last is None or last[0] != y:
                    last = (y, shingle_hashes(y, width))
                keep.append(similarity(shingle_hashes(x, width), last[1], power) >= threshold)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    mine = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = mine.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return arrow(both.select("a", "b", "text_a", "text_b"), run, "a long, b long")


def linked(buckets: DataFrame, texts_of: Callable[[DataFrame], DataFrame], threshold: float, width: int = WIDTH, power: float = 1.0, tries: int = 3) -> DataFrame:
    """``id``, ``root``: the component, named by its least id, of every linked text but that one.

    ``buckets`` has (id, band, bucket); ``texts_of`` gives (id, text) for a table of ids.
    First every text meets the most central text of its buckets, then every text outside the
    largest component of a bucket meets up to ``tries`` members of such components. What is
    still apart in a bucket is compared exactly, by way of shared prefix shingles.
    """
    crowd = written(buckets.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    members = written(buckets.join(crowd, ["band", "bucket"]))
    texts = written(texts_of(members.select("id").distinct()))
    # An original shares more buckets with its copies than they do with each other: it leads.
    central = members.groupBy("id").agg(F.sum("n").alias("weight"))
    ranked = members.join(central, "id").withColumn("rank", F.struct("weight", "id"))
    leaders = ranked.groupBy("band", "bucket").agg(F.max("rank").alias("leader"))
    first = members.join(leaders, ["band", "bucket"]).groupBy(F.col("id").alias("a")).agg(F.max("leader")["id"].alias("b")).where("a <> b")
    roots = components(written(verified(first, texts, threshold, width, power)))
    open_ = _apart(members.drop("n"), roots)
    pairs = _pairs_with_home(open_, tries)
    roots = merged(roots, written(verified(pairs, texts, threshold, width, power)))
    open_ = _apart(open_.select("id", "band", "bucket"), roots)
    rest = open_.select("id").distinct()
    return _linked_exactly(prefix_buckets(texts.join(rest, "id"), threshold, width, power), texts, roots, threshold, width, power)


def _pairs_with_home(open_: DataFrame, tries: int) -> DataFrame:
    """(a, b): each text ``a`` outside the largest component of a bucket, with up to ``tries`` members of those of its buckets."""
    salts = range(tries)
    inner = [F.when(F.col("root") == F.col("largest"), F.struct(F.xxhash64(F.lit(salt), "id").alias("h"), "id")) for salt in salts]
    partners = open_.groupBy("band", "bucket").agg(F.array(*[F.min(x)["id"] for x in inner]).alias("partners"))
    outside = open_.where("root <> largest").join(partners, ["band", "bucket"])
    picked = [F.min_by(F.get("partners", F.lit(salt)), F.xxhash64(F.lit(salt), "bucket")) for salt in salts]
    met = outside.groupBy(F.col("id").alias("a")).agg(F.array_distinct(F.array(*picked)).alias("met"))
    return met.select("a", F.explode("met").alias("b"))


def _apart(members: DataFrame, roots: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """Members of buckets that hold two components or more, with ``root`` and the root ``largest`` of the bucket's home.

    The home is the largest component, named by a member ``home``; ``held`` (band, bucket,
    home, upto) keeps it and tells which buckets still count and up to which id members have taken turns.
    """
    named = members.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    sizes = named.groupBy("band", "bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("band", "bucket").agg(F.max_by("root", F.struct("n", "root")).alias("largest"), F.count(F.lit(1)).alias("parts")).where("parts > 1").drop("parts")
    if held is None:
        largest = largest.withColumns({"home": F.col("largest"), "upto": F.lit(None).cast("bigint")})
    else:
        now = held.join(roots.select(F.col("id").alias("home"), F.col("root").alias("home_root")), "home", "left")
        largest = largest.drop("largest").join(now.select("band", "bucket", "home", "upto", F.coalesce("home_root", "home").alias("largest")), ["band", "bucket"])
    return written(named.join(written(largest), ["band", "bucket"]))


def prefix_buckets(texts: DataFrame, threshold: float, width: int, power: float) -> DataFrame:
    """(id, band, bucket): each text's rarest shingles, until their mass passes 1 - threshold.

    Texts of similarity ``threshold`` share that much mass, so the rarest shingle they
    share lies in both prefixes: no link is lost, and what many texts have in common is
    in few prefixes. ``before`` is the mass ahead of the shingle in that order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, mass = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), texts_as_bytes(batch.column(1)), strict=True):
                h, n = np.unique(shingle_hashes(text, width), return_counts=True)
                w = n.astype(np.float64) ** power
                ids.append(np.full(len(h), i))
                hashes.append(h.view(np.int64))
                mass.append(w / w.sum())
            cols = [np.concatenate(x) if x else np.zeros(0, k) for x, k in ((ids, np.int64), (hashes, np.int64), (mass, np.float64))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["id", "bucket", "mass"])

    rows = written(arrow(texts.select("id", "text"), run, "id long, bucket long, mass double"))
    shared = written(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    rarest = W.Window.partitionBy("id").orderBy("n", "bucket").rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)
    ranked = rows.join(shared, "bucket", "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn("before", F.sum("mass").over(rarest) - F.col("mass"))
    return written(ranked.where((F.col("before") <= 1 - threshold + 1e-9) & (F.col("n") > 1)).select("id", F.lit(0).alias("band"), "bucket", "before"))


def sketches(texts: DataFrame, width: int = WIDTH, power: float = 1.0) -> DataFrame:
    """``id``, ``size`` (distinct shingles), ``units`` (total weight over the least), ``parity``: one bit for each of 512 cells, odd or even shingles in it, and ``cells``: the mass in each of ``CELLS`` cells, rounded down."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, units, parity, cells = [], [], [], []
            for text in texts_as_bytes(batch.column(1)):
                h, n = np.unique(shingle_hashes(text, width), return_counts=True)
                w = n.astype(np.float64) ** power
                sizes.append(len(h))
                units.append(float(w.sum() / w.min()) if len(w) else 0.0)
                parity.append(np.packbits(np.bincount((h >> np.uint64(40) & np.uint64(511)).astype(np.int64), minlength=512).astype(np.uint8) & 1).view(np.int64))
                mass = np.bincount((h >> np.uint64(20) & np.uint64(CELLS - 1)).astype(np.int64), w / w.sum() if len(w) else w, CELLS)
                cells.append((mass * WHOLE).astype(np.int16))
            columns = [pa.array(sizes, pa.int64()), pa.array(units, pa.float64()), pa.array(parity, pa.list_(pa.int64())), pa.array(cells, pa.list_(pa.int16()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "size", "units", "parity", "cells"])

    return arrow(texts.select("id", "text"), run, "id long, size long, units double, parity array<long>, cells array<smallint>")


def _may_link(threshold: float) -> Column:
    """False only where a member and a leader that meet in a prefix shingle can't reach the threshold.

    Every shingle that only one of two texts has flips one parity bit, so that they differ
    in at least as many shingles as bits. Probability Jaccard is at most the mass that two
    texts have in common, so that either has at most 1 - threshold of its mass, and as many
    of its units, in shingles of its own. Two texts of even weights are sets: their own
    shingles are at most (1 - threshold) / (1 + threshold) of both sizes, and if they meet
    in the rarest shingle they share, the overlap is at most what either has from there on.
    Masses of cells differ, summed, by no more than masses of shingles do, and those by at
    most twice 1 - threshold: texts around one repeated passage fail this.
    """
    both = F.col("size") + F.col("leader_size")
    even = (F.col("units") <= F.col("size") + 1e-6) & (F.col("leader_units") <= F.col("leader_size") + 1e-6)
    shared = F.least(F.col("size") * (1 - F.col("before")), F.col("leader_size") * (1 - F.col("leader_before")))
    bits = [F.bit_count(F.get("parity", i).bitwiseXOR(F.get("leader_parity", i))) for i in range(8)]
    differ = functools.reduce(Column.__add__, bits)
    of_sets = (shared + 1e-6 >= both * F.lit(threshold / (1 + threshold))) & (differ <= both * F.lit((1 - threshold) / (1 + threshold)) + 1e-6)
    near = F.when(even, of_sets).otherwise(differ <= (F.col("units") + F.col("leader_units")) * F.lit(1 - threshold) + 1e-6)
    gaps = F.zip_with("cells", "leader_cells", lambda a, b: F.abs(a.cast("int") - b.cast("int")))
    # Rounding adds at most one to each cell's gap.
    return near & (F.aggregate(gaps, F.lit(0), lambda a, x: a + x) <= F.lit(2 * (1 - threshold) * WHOLE + CELLS))


def _linked_exactly(members: DataFrame, texts: DataFrame, roots: DataFrame, threshold: float, width: int, power: float, leaders: int = 64) -> DataFrame:
    """``roots`` after every two members of a bucket are in one component or can't be, or have been compared.

    Members outside a bucket's home take turns by id to meet every member of another
    component that exact bounds leave, ``leaders`` at first and sixteen times as many each
    round. Components only grow, so that a member of the home stays one; a bucket is done
    when a round had turns for all who waited.
    """
    traits = ["before", "size", "units", "parity", "cells"]
    members = members.join(sketches(texts.join(members.select("id").distinct(), "id"), width, power), "id")
    bucket = W.Window.partitionBy("band", "bucket")
    held = None
    while True:
        open_ = _apart(members, roots, held)
        waiting = (F.col("root") != F.col("largest")) & (F.col("upto").isNull() | (F.col("id") > F.col("upto")))
        turns = open_.where(waiting).withColumn("turn", F.row_number().over(bucket.orderBy("id"))).where(F.col("turn") <= leaders)
        turns = written(turns.select("band", "bucket", "home", F.col("id").alias("leader"), F.col("root").alias("leader_root"), *[F.col(c).alias(f"leader_{c}") for c in traits]))
        if turns.isEmpty():
            return roots
        met = open_.drop("home").join(turns, ["band", "bucket"]).where((F.col("root") != F.col("leader_root")) & _may_link(threshold))
        pairs = met.select(F.greatest("id", "leader").alias("a"), F.least("id", "leader").alias("b")).distinct()
        roots = merged(roots, written(verified(pairs, texts, threshold, width, power)))
        held = turns.groupBy("band", "bucket").agg(F.first("home").alias("home"), F.max("leader").alias("upto"), F.count(F.lit(1)).alias("n"))
        held = written(held.where(F.col("n") == leaders).drop("n"))
        if held.isEmpty():
            return roots
        leaders *= 16
        members = open_.select("id", "band", "bucket", *traits)


def merged(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """``roots`` after the links ``edges`` (a, b): the components' own components, then relabelled."""
    if edges.isEmpty():
        return roots
    named = edges
    for c in ("a", "b"):
        named = named.join(roots.select(F.col("id").alias(c), F.col("root").alias(f"root_{c}")), c, "left").withColumn(f"root_{c}", F.coalesce(f"root_{c}", c))
    new = components(named.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
    every = roots.unionByName(new.select("id", F.col("id").alias("root"))).groupBy("id").agg(F.min("root").alias("root"))
    relabelled = every.join(new.select(F.col("id").alias("root"), F.col("root").alias("top")), "root", "left")
    return written(relabelled.select("id", F.coalesce("top", "root").alias("root")))


def components(edges: DataFrame) -> DataFrame:
    """``id``, ``root`` of every vertex of ``edges`` (a, b) that is not its component's least id: that id.

    Alternating star contractions: larger neighbours, then smaller ones, are linked to
    the least neighbour, until every component is a star.
    """
    current = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    while True:
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(current.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        current = written(small)
        # Done when every vertex is a leaf of one root, or a root and no leaf.
        ends = current.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(current.select(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("root")))
        ends = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
        if ends.where("up > 1 or (up = 1 and root = 1)").isEmpty():
            return current.select(F.col("a").alias("id"), F.col("b").alias("root"))


def _classes_of_texts(docs: DataFrame, threshold: float = 0.8, bands: int = 28, rows: int = 5, width: int = WIDTH, power: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` with ``text_id`` and buckets for their text; ``text_id``, ``first`` and ``root`` of each text that has shingles.

    ``first`` is the least document id of the text's rows, in a struct that puts null last.
    """
    signed = written(signatures(docs.withColumn("text_id", F.xxhash64("text")), bands, rows, width, power))
    worded = signed.where("buckets is not null")
    reps = worded.groupBy("text_id").agg(F.min(F.struct("doc_id", "buckets")).alias("one"))
    reps = written(reps.select(F.col("text_id").alias("id"), F.col("one.doc_id").alias("doc_id"), F.col("one.buckets").alias("buckets")))
    buckets = reps.select("id", F.posexplode("buckets").alias("band", "bucket"))

    def texts_of(ids: DataFrame) -> DataFrame:
        wanted = reps.join(ids, "id").select("id", F.col("doc_id").alias("rep"))
        at = F.col("doc_id").eqNullSafe(F.col("rep")) & (F.xxhash64("text") == F.col("id"))
        # Rows that repeat are one text.
        return docs.select("doc_id", "text").join(wanted, at).select("id", "text").dropDuplicates(["id"])

    roots = linked(buckets, texts_of, threshold, width, power)
    least = worded.groupBy("text_id").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id")).alias("first"))
    return signed, least.join(roots.withColumnRenamed("id", "text_id"), "text_id", "left").withColumn("root", F.coalesce("root", "text_id"))


@any_columns
def near_duplicate_classes(docs: DataFrame, threshold: float = 0.8, bands: int = 28, rows: int = 5, width: int = WIDTH, power: float = 1.0) -> DataFrame:
    """``docs`` without its text, plus class_id: the least document id of the row's class."""
    names = [c for c in docs.columns if c != "text"]
    signed, named = _classes_of_texts(docs, threshold, bands, rows, width, power)
    named = written(named)
    # Written, so that the joins of a large class and of a text of many copies can be split.
    firsts = written(named.groupBy("root").agg(F.min("first")["doc_id"].alias("class_id")))
    classes = written(named.join(firsts, "root").select("text_id", "class_id"))
    out = signed.withColumn("text_id", F.when(F.col("buckets").isNotNull(), F.col("text_id"))).join(classes, "text_id", "left")
    return out.select(*names, F.coalesce("class_id", "doc_id").alias("class_id"))


def one_of_each_class(docs: DataFrame, **parameters) -> DataFrame:
    """One row of ``docs`` for each class: of least id (null last), then of least text id.

    Classes are told apart by their texts, so documents of equal or null ids are lost only
    to their own class. A row without shingles is dropped only for one of its id and text;
    rows with neither id nor text all stay.
    """
    signed, named = _classes_of_texts(docs.select("doc_id", "text"), **parameters)
    best = named.groupBy("root").agg(F.min(F.struct("first", "text_id")).alias("one"))
    best = best.select(F.col("one.first.doc_id").alias("keep_id"), F.col("one.text_id").alias("keep_text"))
    bare = signed.where("buckets is null").select(F.col("doc_id").alias("keep_id"), F.col("text_id").alias("keep_text")).distinct()
    void = F.col("doc_id").isNull() & F.col("text").isNull()
    keyed = docs.where(~void).withColumn("text_id_", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("text_id_") == F.col("keep_text"))
    kept = keyed.join(best.unionByName(bare), same, "left_semi")
    order = W.Window.partitionBy("doc_id", "text_id_").orderBy(F.lit(0))
    one = kept.withColumn("copy_", F.row_number().over(order)).where("copy_ = 1").drop("copy_", "text_id_")
    return one.unionByName(docs.where(void))
