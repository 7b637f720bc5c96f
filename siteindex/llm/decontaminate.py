"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

An item's windows are its runs of 13 words (an item of fewer words is one window). A
window occurs in a document only if all its shingles (three words, or the whole of a
shorter window) do, in place; a required overlap of all shingles leaves a prefix of one,
the rarest by document frequency over all documents. Documents send the occurrences of
prefix shingles with the words around them; the join on the shingle's hash applies the
position and length bounds and compares the words exactly. All of it are grouped tables
and joins: nothing passes through the driver but filters of fixed size, which are
broadcast and which let other shingles through the more, the fuller they are.

Documents of equal text have equal hits; hits come back to rows by a hash of the text.

Defined cases: null or wordless texts have no words and no hits; items that repeat or
share windows are each listed; a wordless item is never found; null item ids are
skipped; documents' rows that repeat, or of equal or null ids, stay rows; empty tables
give no rows or no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lineage import written
from .common import any_columns, arrow, block_word_hashes, texts_as_bytes, utf8, word_hashes
from .grams import Filter, grams

#: Lower-cases A-Z; every other ASCII byte but 0-9 and a-z becomes a space.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
SHINGLE = 3


def _shingles(hashes: np.ndarray, sizes: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of a text's word hashes, for each of the shingle sizes: first words' positions and the shingles' hashes."""
    for n, (ends, whole) in enumerate(grams(hashes, np.zeros(len(hashes), np.int64), max(sizes, default=0)), 1):
        if n in sizes:
            yield ends - (n - 1), whole[ends]


def _blocks(column: pa.Array, size: int = 1 << 18) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Consecutive texts of about ``size`` bytes, hashed together.

    The first text's number, the texts as words and spaces with a space after each, where the
    words begin and end in that, their hashes, and each text's first word (and the end).
    """
    at, data = utf8(column)
    a = 0
    while a < len(at) - 1:
        b = max(a + 1, int(np.searchsorted(at, at[a] + size, "right")) - 1)
        whole = memoryview(data)
        plain = b" ".join([*(bytes(whole[x:y]) for x, y in zip(at[a:b].tolist(), at[a + 1 : b + 1].tolist(), strict=True)), b""]).translate(WORDS)
        begin, end, hashes = block_word_hashes(plain)
        starts = at[a : b + 1] - at[a] + np.arange(b - a + 1)
        yield a, plain, begin, end, hashes, np.searchsorted(begin, starts)
        a = b


def item_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """``item_id`` (string) and ``words`` (joined by spaces) of each distinct window."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for item, text in zip(batch.column(0).to_pylist(), texts_as_bytes(batch.column(1)), strict=True):
                words = text.translate(WORDS).split()
                for i in range(max(1, len(words) - width + 1) if words else 0):
                    ids.append(item)
                    out.append(b" ".join(words[i : i + width]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(out, pa.string())], names=["item_id", "words"])

    rows = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    return arrow(rows, cut, "item_id string, words string").distinct()


def window_shingles(windows: DataFrame) -> DataFrame:
    """``words``, ``at``, ``key``: the shingles of each window (of its own size where it has fewer words)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows = batch.column(0).to_pylist()
            each = [next(_shingles(word_hashes(x.encode()), (min(SHINGLE, x.count(" ") + 1),))) for x in windows]
            names = [x for x, (at, _) in zip(windows, each, strict=True) for _ in at]
            at, keys = (np.concatenate([x[k] for x in each]) if each else np.zeros(0, np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(at, pa.int32()), pa.array(keys.view(np.int64))], names=["words", "at", "key"])

    return arrow(windows.select("words"), cut, "words string, at int, key long")


def document_frequency(docs: DataFrame, shingles: DataFrame, sizes: tuple[int, ...], filter_bits: int) -> DataFrame:
    """``key``, ``n``: in how many documents each shingle occurs; the filter may let others through."""
    sent = docs.sparkSession.sparkContext.broadcast(Filter(shingles.select("key").distinct(), filter_bits))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            found = []
            for _, _, _, _, own, first in _blocks(batch.column(0)):
                row = np.repeat(np.arange(len(first) - 1), np.diff(first))
                for n, (ends, whole) in enumerate(grams(own, first[row], max(sizes, default=0)), 1):
                    if n in sizes:
                        ends = ends[known.holds(whole[ends])]
                        keys, rows = whole[ends], row[ends]
                        order = np.lexsort((keys, rows))
                        keys, rows = keys[order], rows[order]
                        # Once for each document.
                        found.append(keys[np.concatenate([[True], (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])])[: len(keys)]])
            keys, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], names=["key", "n"])

    return arrow(docs.select("text"), count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def prefixes(shingles: DataFrame, frequency: DataFrame) -> DataFrame:
    """``words``, ``length``, ``key``, ``at``: the rarest shingle of each window all of whose shingles occur somewhere."""
    ranked = shingles.join(frequency, "key", "left").groupBy("words").agg(F.min(F.when(F.col("n") > 0, F.struct("n", "key", "at"))).alias("least"), F.count("n").alias("found"), F.count(F.lit(1)).alias("shingles"))
    return ranked.where("found = shingles").select("words", (F.length("words") - F.length(F.replace("words", F.lit(" "))) + 1).alias("length"), "least.key", "least.at")


OCCURRENCE = pa.struct([("key", pa.int64()), ("at", pa.int32()), ("lead", pa.int32()), ("around", pa.string())])


def occurrences(docs: DataFrame, keys: DataFrame, sizes: tuple[int, ...], width: int, filter_bits: int) -> DataFrame:
    """``docs`` without its text, plus n_words and ``found``: where its shingles pass the filter of ``keys``, with up to width - 1 words on both sides."""
    names = [c for c in docs.columns if c != "text"]
    sent = docs.sparkSession.sparkContext.broadcast(Filter(keys.select("key").distinct(), filter_bits))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            counts, out = [], [[] for _ in range(batch.num_rows)]
            for text, plain, begin, end, own, first in _blocks(batch.column(batch.num_columns - 1)):
                counts.append(np.diff(first))
                row = np.repeat(np.arange(len(first) - 1), np.diff(first))
                for n, (ends, whole) in enumerate(grams(own, first[row], max(sizes, default=0)), 1):
                    if n in sizes:
                        ends = ends[known.holds(whole[ends])]
                        spot = ends - (n - 1)
                        low, high = first[row[ends]], first[row[ends] + 1]
                        lead, after = np.minimum(spot - low, width - 1), np.minimum(spot + width, high)
                        for r, p, k, x, y, key in zip(row[ends].tolist(), (spot - low).tolist(), lead.tolist(), begin[spot - lead].tolist(), end[after - 1].tolist(), whole[ends].view(np.int64).tolist(), strict=True):
                            out[text + r].append({"key": key, "at": p, "lead": k, "around": b" ".join(plain[x:y].split()).decode()})
            counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            extra = [pa.array(counts, pa.int64()), pa.array(out, pa.list_(OCCURRENCE))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *extra], names=[*batch.schema.names[:-1], "n_words", "found"])

    made = T.StructType.fromDDL("n_words bigint, found array<struct<key:bigint,at:int,lead:int,around:string>>")
    return arrow(docs.select(*names, "text"), find, T.StructType([*(docs.schema[c] for c in names), *made.fields]))


def text_hash(docs: DataFrame) -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


@any_columns
def benchmark_hits(docs: DataFrame, benchmark: DataFrame, width: int = 13, filter_bits: int = 1 << 26) -> DataFrame:
    """Rows of ``docs`` without their text, plus text_id, n_words, spans (start, end in words; merged) and items."""
    windows = written(item_windows(benchmark, width))
    shingles = written(window_shingles(windows.select("words").distinct()))
    spaces = F.length("words") - F.length(F.replace("words", F.lit(" ")))
    sizes = tuple(sorted(r[0] for r in windows.select(F.least(F.lit(SHINGLE), spaces + 1)).distinct().collect()))
    prefix = written(prefixes(shingles, document_frequency(docs, shingles, sizes, filter_bits)))
    base = written(occurrences(docs.withColumn("text_id", text_hash(docs)), prefix, sizes, width, filter_bits))
    each = base.where(F.size("found") > 0).select("text_id", F.explode("found").alias("x")).select("text_id", "x.key", F.col("x.at").alias("spot"), "x.lead", F.split("x.around", " ").alias("around"))
    met = each.join(prefix, "key").where((F.col("lead") >= F.col("at")) & (F.size("around") - F.col("lead") >= F.col("length") - F.col("at")))
    met = met.where(F.array_join(F.slice("around", F.col("lead") - F.col("at") + 1, F.col("length").cast("int")), " ") == F.col("words"))
    start = (F.col("spot") - F.col("at")).cast("long")
    hits = written(met.select("text_id", "words", F.struct(start.alias("start"), (start + F.col("length")).alias("end")).alias("span")).distinct())
    spans = hits.groupBy("text_id").agg(F.collect_set("span").alias("spans"))
    items = hits.select("text_id", "words").distinct().join(windows, "words").groupBy("text_id").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    found = written(spans.join(items, "text_id").withColumn("spans", _united(F.col("spans"))))
    none = [F.coalesce(c, F.array().cast(found.schema[c].dataType)).alias(c) for c in ("spans", "items")]
    return base.drop("found").join(found, "text_id", "left").select(*base.drop("found").columns, *none)


def clean_rows(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs``, whole, that are not contaminated."""
    hits = contamination(benchmark_hits(docs.select("text"), benchmark, **parameters))
    bad = written(hits.where("contaminated").select(F.col("text_id").alias("text_id_")).distinct())
    return docs.withColumn("text_id_", text_hash(docs)).join(bad, "text_id_", "left_anti").select(docs.columns)


def _united(spans):
    start = F.struct(F.array().cast("array<struct<start:bigint,end:bigint>>").alias("done"), F.lit(-1).cast("long").alias("a"), F.lit(-1).cast("long").alias("b"))

    def step(s, x):
        apart = x["start"] > s["b"]
        done = F.when(apart & (s["b"] >= 0), F.concat(s["done"], F.array(F.struct(s["a"].alias("start"), s["b"].alias("end"))))).otherwise(s["done"])
        return F.struct(done.alias("done"), F.when(apart, x["start"]).otherwise(s["a"]).alias("a"), F.greatest(s["b"], x["end"]).alias("b"))

    return F.aggregate(F.array_sort(spans), start, step, lambda s: F.when(s["b"] >= 0, F.concat(s["done"], F.array(F.struct(s["a"].alias("start"), s["b"].alias("end"))))).otherwise(s["done"]))


def contamination(hits: DataFrame) -> DataFrame:
    """``hits`` with n_hit, n_items, items_sha256 and contaminated (a twentieth of the words or more)."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    out = hits.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long"))
    out = out.withColumn("items_sha256", F.sha2(F.array_join(F.array_sort("items"), ","), 256))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
