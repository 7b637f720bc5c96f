"""Divergence of sources within a language, exact, without visiting the terms that a source lacks.

Each group (language and source) gives each kept term of its language the probability
p = 1 + floor(scale (count + smoothing) / (N + smoothing V)). Two groups' divergence is the
sum of abs(p - q) over all V kept terms. By inclusion and exclusion over the supports A and
B, with p0 and q0 for a count of zero,

    sum over A of abs(p - q0)  +  sum over B of abs(p0 - q)
    + sum over A and B of abs(p - q) - abs(p - q0) - abs(p0 - q) + abs(p0 - q0)
    + (V - |A| - |B|) abs(p0 - q0).

The first two are priced from a histogram of the group's counts, the third by a join of the
terms' postings (term, group, count), the last is a constant of the two groups. No pair of
a group and an absent term is made.

Texts are split in Arrow batches whose counts are summed by group and term before anything
is shuffled, so that a source with most rows is spread over all tasks. The result has a row
for each ordered pair of sources of a language; postings pair up only by shared terms.

Defined cases: null text, language and source are ''; texts without terms still make their
group; a language without kept terms has divergences of 0 and no term rows; rows that
repeat count as often as they stand; ties in value are ranked by the item's UTF-8 bytes;
very long texts are split in blocks of whole texts; an empty table gives an empty result;
further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..lineage import written
from .common import arrow
from .terms import LETTER_TERMS, run_starts, taken, terms_of, text_blocks

SCALE, SMOOTHING = 1_000_000_000, 5


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])


class _Tally:
    """Counts by group and term of one task's texts, until they are sent."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.entries = 0

    def add(self, rows: list[tuple[str, str]], texts: list[bytes]) -> None:
        # Texts of a group stand together, so that a term's tokens, in order, do so too.
        number = [self.groups.setdefault(r, len(self.groups)) for r in rows]
        order = sorted(range(len(texts)), key=number.__getitem__)
        group_of = np.array([number[k] for k in order])
        found = terms_of([texts[k] for k in order], LETTER_TERMS)
        by_term = np.argsort(found.hashes, kind="stable")
        hashes, text = found.hashes[by_term], found.text[by_term]
        first = run_starts(hashes, text)  # one for each term of a text
        times = np.diff(np.append(first, len(hashes)))
        hashes, group = hashes[first], group_of[text[first]]
        row = run_starts(hashes, group)
        if len(row):
            shown = by_term[first[row]]
            letters, offsets = taken(np.frombuffer(found.data, np.uint8), found.begins[shown], found.ends[shown])
            self.parts.append((hashes[row], group[row], np.add.reduceat(times, row), np.diff(np.append(row, len(hashes))), np.diff(offsets), letters))
            self.entries += len(row)

    def sent(self, rows: int = 100_000) -> Iterator[pa.RecordBatch]:
        """All counts so far, each group and term once."""
        if not self.parts:
            return
        hashes, group, n, documents, sizes, letters = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        ends = np.cumsum(sizes)
        order = np.lexsort((group, hashes))
        first = run_starts(hashes[order], group[order])
        n, documents, shown = np.add.reduceat(n[order], first), np.add.reduceat(documents[order], first), order[first]
        names = [pa.array([g[k] for g in self.groups], pa.string()) for k in (0, 1)]
        for a in range(0, len(first), rows):
            part = shown[a : a + rows]
            data, offsets = taken(letters, ends[part] - sizes[part], ends[part])
            term = pa.StringArray.from_buffers(len(part), pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes()))
            lang, source = (x.take(pa.array(group[part])) for x in names)
            yield pa.RecordBatch.from_arrays([lang, source, term, pa.array(n[a : a + rows]), pa.array(documents[a : a + rows])], names=["lang", "source", "term", "n", "documents"])
        self.parts, self.entries = [], 0


def term_counts(docs: DataFrame, block_bytes: int = 1 << 20, held_entries: int = 1_000_000) -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` (occurrences), ``documents`` that hold the term, in one row or more; dealt out by language and term.

    A task sums ``held_entries`` counts before it sends them.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()
        for rows, texts in text_blocks(batches, block_bytes):
            tally.add(rows, texts)
            if tally.entries >= held_entries:
                yield from tally.sent()
        yield from tally.sent()

    rows = arrow(_named(docs), count, "lang string, source string, term string, n long, documents long")
    return rows.repartition("lang", "term")


def kept_postings(docs: DataFrame, min_documents: int) -> DataFrame:
    """``lang``, ``term``, ``source``, ``n`` and ``lang_n`` of the terms in at least ``min_documents`` documents of their language."""
    counts = term_counts(docs).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    # A term has a row for each source at most, in the partition where it is.
    whole = W.Window.partitionBy("lang", "term")
    sums = counts.select("lang", "term", "source", "n", F.sum("n").over(whole).alias("lang_n"), F.sum("documents").over(whole).alias("in_documents"))
    return sums.where(F.col("in_documents") >= min_documents).drop("in_documents")


def _share(count: Column | str, total: str, kept: str) -> Column:
    """1 + floor(SCALE (count + SMOOTHING) / (total + SMOOTHING kept)), in decimals so that no count overflows."""
    whole = F.col(total) + SMOOTHING * F.col(kept)
    count = F.col(count) if isinstance(count, str) else count
    # decimal(29) over decimal(20): their quotient's integer part is exact.
    scaled = (F.lit(SCALE).cast("decimal(10,0)") * (count + SMOOTHING).cast("decimal(19,0)")).cast("decimal(29,0)")
    return 1 + F.call_function("div", scaled, whole.cast("decimal(20,0)"))


def _groups(docs: DataFrame, posted: DataFrame, languages: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``total``, ``support``, ``kept`` and ``p0`` (null without kept terms) of every group."""
    sums = posted.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("support"))
    every = _named(docs).select("lang", "source").distinct()
    rows = every.join(languages.select("lang", "kept"), "lang", "left").join(sums, ["lang", "source"], "left").na.fill(0, ["kept", "total", "support"])
    return rows.withColumn("p0", F.when(F.col("kept") > 0, _share(F.lit(0).cast("long"), "total", "kept")))


def pair_divergence(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``item`` (another source) and ``value``, for every ordered pair of sources of a language."""
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("support").alias("item_support"))
    # One-sided terms: as many prices as a group has different counts.
    histogram = shares.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("terms"))
    priced = histogram.join(other.select("lang", "item", "q0"), "lang").where("source <> item")
    one_sided = priced.groupBy("lang", "source", "item").agg(F.sum(F.col("terms") * F.abs(F.col("p") - F.col("q0"))).alias("own"))
    # Shared terms: postings that meet, each pair once.
    a = shares.select("lang", "term", "source", "p", "p0")
    b = shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    p, q, p0, q0 = (F.col(c) for c in ("p", "q", "p0", "q0"))
    corrected = F.abs(p - q) - F.abs(p - q0) - F.abs(p0 - q) + F.abs(p0 - q0)
    met = a.join(b, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(corrected).alias("shared"))
    turned = met.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "shared")
    pairs = groups.join(other, "lang").where("source <> item")
    key = ["lang", "source", "item"]
    back = one_sided.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("own").alias("others"))
    pairs = pairs.join(met.unionByName(turned), key, "left").join(one_sided, key, "left").join(back, key, "left").na.fill(0, ["shared", "own", "others"])
    absent = (F.col("kept") - F.col("support") - F.col("item_support")) * F.abs(p0 - q0)
    return pairs.select(*key, F.coalesce(F.col("own") + F.col("others") + F.col("shared") + absent, F.lit(0)).cast("long").alias("value"))


def divergence_audit(docs: DataFrame, min_documents: int = 30, most_terms: int = 50) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank``.

    Part `pair`: every other source of the language by its divergence. Part `term`: the
    ``most_terms`` terms that a source holds most above its language's probability.
    """
    posted = written(kept_postings(docs, min_documents))
    languages = posted.select("lang", "term", "lang_n").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"))
    groups = written(_groups(docs, posted, languages))
    known = posted.join(groups.select("lang", "source", "total", "kept", "p0"), ["lang", "source"]).join(languages.select("lang", "lang_total"), "lang")
    shares = written(known.select("lang", "source", "term", _share("n", "total", "kept").alias("p"), "p0", _share("lang_n", "lang_total", "kept").alias("q")))
    pairs = pair_divergence(shares, groups).withColumn("part", F.lit("pair"))
    terms = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"), F.lit("term").alias("part"))
    order = W.Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [pairs.withColumn("rank", F.row_number().over(order)), terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most_terms)]
    return ranked[0].unionByName(ranked[1]).select("lang", "source", "part", "item", "value", "rank")
