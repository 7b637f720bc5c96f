"""Ranked lexical search with a block-max index.

Index. Documents are dealt into segments. A segment holds, for each of its terms, the
places of the documents that hold it and how often they do, in blocks of ``BLOCK`` postings: a block
is compressed to the fewest bytes its gaps and frequencies need, and its first and last place and its
maximum impact stand beside it uncompressed.

Search is Block-Max WAND, with a run of places between two block bounds as the pivot: the
shallow pointers of an item's lists move from block bound to block bound, and the sum of
the weighted maxima of the blocks they stand in bounds the score of every document of the
run. Runs whose bound is below the item's threshold are skipped with their blocks still
compressed. The others are visited from the highest bound on, their blocks decompressed
and scored exactly; the threshold, the k-th best score so far, rises as they are. A bound
equal to the threshold is visited, so that ties are complete.

A part of the segments is searched first. Its k-th best scores are thresholds for all
others, which then return few rows. Items are searched in blocks of at most
``block_terms`` terms (or one item), which are what is broadcast; segments have at most about
``segment_postings`` postings and are one row group of a task each.

A term is known by a 64-bit hash of its bytes. Scores are 64-bit integers.

Defined cases: null texts and texts without terms are not ranked; items without terms find
nothing; items that repeat are ranked each; rows that repeat are ranked each; equal scores
go by ascending doc_id, nulls last; very long texts are one document of a segment; empty
tables give an empty result; other columns of ``docs`` are not read, those of ``items``
are kept, but for results of the same name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .. import ship
from ..lineage import written
from .common import arrow
from .terms import ALNUM_TERMS, run_starts, terms_of, text_blocks

BLOCK = 64
#: Impacts are tf * IMPACT / (1000 tf + 20 m), rounded down.
IMPACT = 1_000_000_000
#: One of LEAD segments is searched before the others.
LEAD = 16


def corpus_size(docs: DataFrame, block_bytes: int = 1 << 20) -> tuple[int, int]:
    """Documents with a term, and all their terms with repeats."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for _, texts in text_blocks(batches, block_bytes):
            text = terms_of(texts, ALNUM_TERMS).text
            n, total = n + len(run_starts(text)), total + len(text)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.int64())], names=["n", "total"])

    head = arrow(docs.select("text"), count, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    return head[0] or 0, head[1] or 0


def length_part(sizes: np.ndarray, n_documents: int, n_terms: int) -> np.ndarray:
    """m of documents with so many terms."""
    return 100 - 50 + (50 * sizes * n_documents) // max(n_terms, 1)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (IMPACT * tf) // (1000 * tf + 20 * m)


def _bytes_needed(most: np.ndarray) -> np.ndarray:
    """0, 1, 2 or 4 bytes for values up to ``most``."""
    return np.select([most == 0, most < 1 << 8, most < 1 << 16], [0, 1, 2], 4)


def _packed(out: np.ndarray, at: np.ndarray, widths: np.ndarray, values: np.ndarray) -> None:
    """Writes each value into ``out`` at its place in its width, low byte first."""
    for k in range(4):
        wide = widths > k
        out[at[wide] + k] = (values[wide] >> (8 * k)) & 255


class Postings:
    """Postings of a segment in compressed blocks, as Arrow columns; they are sorted by term, then place."""

    def __init__(self, hashes: np.ndarray, places: np.ndarray, tf: np.ndarray, m: np.ndarray) -> None:
        first = run_starts(hashes)
        sizes = np.diff(np.append(first, len(hashes)))
        within = np.arange(len(hashes)) - np.repeat(first, sizes)
        begin = np.flatnonzero(within % BLOCK == 0)
        counts = np.diff(np.append(begin, len(hashes)))
        gaps = np.diff(places, prepend=0)
        gaps[begin] = 0
        more = tf - 1
        gap_width, tf_width = (_bytes_needed(np.maximum.reduceat(x, begin)) for x in (gaps, more))
        length = counts * (gap_width + tf_width)
        offset = np.cumsum(length) - length
        inside = np.arange(len(hashes)) - np.repeat(begin, counts)
        data = np.zeros(int(length.sum()), np.uint8)
        wide = np.repeat(gap_width, counts)
        _packed(data, np.repeat(offset, counts) + inside * wide, wide, gaps)
        wide = np.repeat(tf_width, counts)
        _packed(data, np.repeat(offset + counts * gap_width, counts) + inside * wide, wide, more)
        blocks = np.append(np.searchsorted(begin, first), len(begin))
        bounds = np.append(offset, len(data))[blocks]

        def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(blocks, pa.int32()), pa.array(values, kind))

        self.columns = {
            "term": pa.array(hashes[first].view(np.int64)),
            "n": pa.array(sizes, pa.int32()),
            "firsts": lists(places[begin], pa.int32()),
            "lasts": lists(places[begin + counts - 1], pa.int32()),
            "tops": lists(np.maximum.reduceat(impacts(tf, m[places]), begin), pa.int32()),
            "forms": lists(8 * gap_width + tf_width, pa.int8()),
            "data": pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())]),
        }


INDEX = "segment long, term long, n int, firsts array<int>, lasts array<int>, tops array<int>, forms array<tinyint>, data binary, ids array<long>, sizes array<int>"


def build_index(docs: DataFrame, n_documents: int, n_terms: int, segment_postings: int = 3_000_000, block_bytes: int = 1 << 20) -> DataFrame:
    """The index as a written table: a row for each segment and term, and one without a term that lists the segment's documents."""

    def segment_rows(segment: int, parts: list[tuple[np.ndarray, ...]], ids: list, sizes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        hashes, places, tf = (np.concatenate(x) for x in zip(*parts, strict=True))
        lengths = np.concatenate(sizes)
        order = np.argsort(hashes, kind="stable")
        found = Postings(hashes[order], places[order], tf[order], length_part(lengths, n_documents, n_terms)).columns
        rows = len(found["term"])
        nothing = {"ids": pa.nulls(rows, pa.list_(pa.int64())), "sizes": pa.nulls(rows, pa.list_(pa.int32()))}
        columns = {"segment": pa.array(np.full(rows, segment)), **found, **nothing}
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
        own = {"segment": pa.array([segment], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int64())), "sizes": pa.array([lengths.tolist()], pa.list_(pa.int32()))}
        yield pa.RecordBatch.from_arrays([own[c] if c in own else pa.nulls(1, columns[c].type) for c in columns], names=list(columns))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = TaskContext.get().partitionId() << 32
        parts: list[tuple[np.ndarray, ...]] = []
        ids: list = []
        sizes: list[np.ndarray] = []
        postings = 0
        for rows, texts in text_blocks(batches, block_bytes):
            found = terms_of(texts, ALNUM_TERMS)
            order = np.argsort(found.hashes, kind="stable")
            hashes, text = found.hashes[order], found.text[order]
            first = run_starts(hashes, text)
            times = np.diff(np.append(first, len(hashes)))
            parts.append((hashes[first], text[first] + len(ids), times))
            ids += [r[0] for r in rows]
            sizes.append(np.bincount(found.text, minlength=len(texts)))
            postings += len(first)
            if postings >= segment_postings:
                yield from segment_rows(segment, parts, ids, sizes)
                segment, parts, ids, sizes, postings = segment + 1, [], [], [], 0
        if postings:
            yield from segment_rows(segment, parts, ids, sizes)

    return written(arrow(docs.select(F.col("doc_id").cast("long"), "text"), build, INDEX))


class _List:
    """One term's list in a segment. Blocks are decompressed when they are first visited."""

    def __init__(self, row: dict, m: np.ndarray) -> None:
        self.firsts, self.lasts, self.tops = (np.array(row[c], np.int64) for c in ("firsts", "lasts", "tops"))
        self.data, self.m, n = row["data"], m, row["n"]
        form = np.array(row["forms"], np.int64)
        self.widths = form >> 3, form & 7
        self.counts = np.minimum(BLOCK, n - BLOCK * np.arange(len(form)))
        length = self.counts * (self.widths[0] + self.widths[1])
        self.offset = np.cumsum(length) - length
        self.ready = np.zeros(len(form), bool)
        self.places, self.impacts = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def _values(self, at: int, n: int, width: int) -> np.ndarray:
        return np.frombuffer(self.data, f"<u{width}", n, at).astype(np.int64) if width else np.zeros(n, np.int64)

    def postings(self, visited: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and impacts of the blocks marked in ``visited``."""
        for b in np.flatnonzero(visited & ~self.ready).tolist():
            n, at, here = int(self.counts[b]), int(self.offset[b]), slice(b * BLOCK, b * BLOCK + int(self.counts[b]))
            gaps, tf = (int(w[b]) for w in self.widths)
            self.places[here] = self.firsts[b] + np.cumsum(self._values(at, n, gaps))
            self.impacts[here] = impacts(self._values(at + n * gaps, n, tf) + 1, self.m[self.places[here]])
        self.ready |= visited
        if visited.all():
            return self.places, self.impacts
        chosen = np.repeat(visited, self.counts)
        return self.places[chosen], self.impacts[chosen]


def _best(ids: np.ndarray, null: np.ndarray, places: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best by score, then doc_id, nulls last."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        fine = scores >= least
        places, scores = places[fine], scores[fine]
        order = np.lexsort((ids[places], null[places], -scores))[:k]
        places, scores = places[order], scores[order]
    return places, scores


def best_of_segment(lists: dict[int, _List], ids: np.ndarray, null: np.ndarray, terms: list[int], weights: list[int], floor: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the item's k best documents here that score ``floor`` at least."""
    mine = [(lists[t], w) for t, w in zip(terms, weights, strict=True) if t in lists and w > 0]
    places, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not mine:
        return places, scores
    # Shallow moves: at a block's first place its weighted maximum joins the bound, after its last one it leaves.
    bounds = [x.tops * w for x, w in mine]
    turns = np.concatenate([*(x.firsts for x, _ in mine), *(x.lasts + 1 for x, _ in mine)])
    steps = np.concatenate([*bounds, *(-b for b in bounds)])
    order = np.argsort(turns, kind="stable")
    turns = turns[order]
    begins = run_starts(turns)
    bound = np.add.accumulate(np.add.reduceat(steps[order], begins))[:-1]
    edges = turns[begins]
    floor, size, total = max(floor, 1), len(ids), np.zeros(len(ids), np.int64)
    runs = np.flatnonzero(bound >= floor)
    runs = runs[np.argsort(-bound[runs], kind="stable")]
    at, take = 0, 4 * k
    while at < len(runs) and bound[runs[at]] >= floor:
        covered = np.cumsum(edges[runs[at:] + 1] - edges[runs[at:]])
        chosen = runs[at : at + 1 + int(np.searchsorted(covered, take))]
        chosen = chosen[bound[chosen] >= floor]
        inside = np.zeros(size + 1, np.int64)
        np.add.at(inside, edges[chosen], 1)
        np.add.at(inside, edges[chosen + 1], -1)
        inside = np.cumsum(inside)[:size] > 0
        before = np.concatenate([[0], np.cumsum(inside)])
        for x, w in mine:
            visited = before[x.lasts + 1] > before[x.firsts]
            if visited.any():
                where, impact = x.postings(visited)
                here = inside[where]
                total[where[here]] += w * impact[here]  # a document stands once in a list
        found = np.flatnonzero(inside)
        found = found[total[found] >= floor]
        places, scores = _best(ids, null, np.concatenate([places, found]), np.concatenate([scores, total[found]]), k)
        if len(scores) == k:
            floor = max(floor, int(scores.min()))
        at, take = at + len(chosen), 4 * take
    return places, scores


def _searched(rows: DataFrame, size: tuple[int, int], items: list[tuple[int, list[int], list[int]]], floors: dict[int, int], k: int) -> DataFrame:
    """``item_row``, ``doc_id``, ``score``: each segment's best, at least the item's floor."""
    spark = rows.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast((items, floors))

    def search(table: pa.Table) -> pa.Table:
        wanted, least = sent.value
        lists: list[dict] = []
        ids, sizes, null = None, None, None
        for batch in table.to_batches():
            for row in batch.to_pylist():
                if row["ids"] is not None:
                    ids = np.array([0 if i is None else i for i in row["ids"]], np.int64)
                    null = np.array([i is None for i in row["ids"]], bool)
                    sizes = np.array(row["sizes"], np.int64)
                else:
                    lists.append(row)
        m = length_part(sizes, *size)
        known = {row["term"]: _List(row, m) for row in lists}
        item_rows, docs, scores = [], [], []
        for item, terms, weights in wanted:
            places, found = best_of_segment(known, ids, null, terms, weights, least.get(item, 1), k)
            item_rows += [item] * len(places)
            docs += [None if null[p] else int(ids[p]) for p in places]
            scores += found.tolist()
        return pa.table({"item_row": pa.array(item_rows, pa.int64()), "doc_id": pa.array(docs, pa.int64()), "score": pa.array(scores, pa.int64())})

    return rows.groupBy("segment").applyInArrow(search, "item_row long, doc_id long, score long")


def _item_blocks(items: DataFrame, block_terms: int) -> Iterator[list[tuple[int, list[int]]]]:
    """Row id and distinct terms of items, in blocks of at most ``block_terms`` terms or one item."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_blocks(batches, 1 << 20):
            found = terms_of(texts, ALNUM_TERMS)
            by_text = np.searchsorted(found.text, np.arange(len(texts) + 1))
            terms = [np.unique(found.hashes[a:b].view(np.int64)).tolist() for a, b in zip(by_text[:-1], by_text[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(terms, pa.list_(pa.int64()))], names=["item_row", "terms"])

    block: list[tuple[int, list[int]]] = []
    held = 0
    for r in arrow(items.select("item_row", "text"), split, "item_row long, terms array<long>").toLocalIterator():
        if block and held + len(r["terms"]) > block_terms:
            yield block
            block, held = [], 0
        if r["terms"]:
            block.append((r["item_row"], list(r["terms"])))
            held += len(r["terms"])
    if block:
        yield block


def search_index(index: DataFrame, n_documents: int, n_terms: int, items: DataFrame, k: int = 50, block_terms: int = 500_000) -> DataFrame:
    """``item_row``, ``rank``, ``doc_id`` and ``score`` of the ``k`` best documents of each item (``item_row``, ``text``)."""
    spark = index.sparkSession
    found = None
    for block in _item_blocks(items, block_terms):
        terms = spark.createDataFrame(pa.table({"term": pa.array(sorted({t for _, x in block for t in x}), pa.int64())}))
        wanted = F.broadcast(terms)  # of one block
        df = dict(index.join(wanted, "term").groupBy("term").agg(F.sum("n")).toLocalIterator())
        weight = {t: math.floor(1000 * math.log((2 * n_documents + 2) / (2 * n + 1))) for t, n in df.items()}
        asked = [(item, x := [t for t in terms_ if t in weight], [weight[t] for t in x]) for item, terms_ in block]
        rows = index.join(wanted, "term", "left_semi").select(*index.columns).unionByName(index.where("term is null"))
        lead = F.pmod(F.xxhash64("segment"), F.lit(LEAD)) == 0
        floors: dict[int, int] = {}
        parts = []
        for chosen in (lead, ~lead):
            parts.append(written(_searched(rows.where(chosen), (n_documents, n_terms), asked, floors, k)))
            if not floors:
                floors = {r[0]: r[1] for r in _ranked(parts[0], k).where(F.col("rank") == k).select("item_row", "score").toLocalIterator()}
        both = parts[0].unionByName(parts[1])
        found = both if found is None else found.unionByName(both)
    if found is None:
        return spark.createDataFrame([], "item_row long, doc_id long, score long, rank int")
    return _ranked(found, k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.Window.partitionBy("item_row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, segment_postings: int = 3_000_000) -> DataFrame:
    """``items`` without their texts, with ``rank``, ``doc_id`` and ``score`` of the ``k`` best documents of each."""
    size = corpus_size(docs)
    index = build_index(docs, *size, segment_postings=segment_postings)
    names = [c for c in items.columns if c not in ("text", "rank", "doc_id", "score", "item_row")]
    numbered = written(items.select(*[F.col(f"`{c}`") for c in names], "text").withColumn("item_row", F.monotonically_increasing_id()))
    found = search_index(index, *size, numbered, k)
    return numbered.select("item_row", *[F.col(f"`{c}`") for c in names]).join(found, "item_row").drop("item_row")
