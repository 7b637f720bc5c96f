"""Removal of long repeated byte strings by bounded, externally sorted suffix induction.

A byte goes if a string of ``length`` bytes that covers it starts at two places. Sorting
the suffixes at every byte of a corpus moves many times the corpus, so the suffixes are
sampled and the rest is induced, bounded by ``length``:

* Sample. The start p of each window of ``length`` bytes belongs to the anchor
  a = its first minimizer (the least hashed ``gram`` bytes that start in [p, p + span)).
  Equal windows have anchors at equal offsets, whatever surrounds them. Every anchor
  gets a name: the hash of its core, the bytes [a, a + length - span + 1) that all
  windows of the anchor contain.
* Reduce. Only names that occur twice go on; an anchor whose whole stretch of windows
  recurs is settled by a second, independent hash of the stretch, by grouped counts.
* Recurse. The other anchors of a name carry their suffix tuples: bytes left of the
  anchor and right of the core. A window that starts o bytes left of the anchor needs o
  equal bytes on the left and span - 1 - o on the right. A name with more than
  ``members`` tuples is not gathered: its offsets are halved, and the tuples are named
  anew by the bytes that all windows of a half contain. This recursion ends with groups
  that fit in a task or with single offsets, whose windows are settled by their names.
* Induce. Spark's external sort orders a group's tuples by (name, right bytes). Then, for
  offset 1, 2, ..., the order of suffixes one byte further left is induced from the order
  so far by a stable sort on the byte in front, and the common prefix of neighbours is
  the byte's one plus the least common prefix between them. A window recurs where a
  neighbour's common prefix reaches its end.

Spark's sorted, spilling shuffles stand for the disk-backed priority queues: they hold
the tuples in order on disk, and a task only ever holds groups of ``members``.

Passages are counted too, and not removed: words in a run of ``passage`` words that also
starts anywhere else, by the same sampling over words instead of bytes; windows of
anchors that are not settled whole are named one by one.

Defined cases: null text is empty; texts shorter than ``length`` keep all bytes; rows
that repeat are separate places, so their long strings are repeated; matches never
cross rows; a null id is an id; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lineage import written
from .common import BYTES, POWERS, Hashes, any_columns, arrow, mix, text_key, utf8, word_hashes, words_of_rows

#: Symbols of a block, few enough for a core's cache.
BLOCK = 1 << 17
#: place: first window, the anchor's distance from it and the windows after it, packed.
PLACE_BITS = 9


@dataclass(frozen=True)
class Scale:
    """Windows of ``length`` symbols, sampled by the least hashed ``gram`` symbols of ``span`` starts."""

    length: int
    gram: int
    span: int

    @property
    def core(self) -> int:
        return self.length - self.span + 1


def bytes_scale(length: int) -> Scale:
    if length < 272:
        raise ValueError("length must be 272 or more")
    return Scale(length, 16, 256)


def words_scale(length: int) -> Scale:
    if length < 8:
        raise ValueError("passage must be 8 or more")
    return Scale(length, max(1, length // 6), min(256, length * 2 // 3))


def segments(lengths: np.ndarray, length: int) -> Iterator[list[tuple[int, int, int]]]:
    """Blocks of (row, first symbol, end) whose windows together are all windows of all rows; each about BLOCK / 2 symbols."""
    held: list[tuple[int, int, int]] = []
    size, room = 0, BLOCK // 2
    for row, n in enumerate(lengths.tolist()):
        for a in range(0, max(0, n - length + 1), room):
            b = min(n, a + room + length - 1)
            if held and size + b - a > BLOCK - 1024:
                yield held
                held, size = [], 0
            held.append((row, a, b))
            size += b - a
    if held:
        yield held


def anchors(hashes: Hashes, starts: np.ndarray, scale: Scale) -> tuple[np.ndarray, ...]:
    """(anchor, first window, last window) as positions in a block whose segments begin at ``starts``."""
    n = len(hashes.sums) - 1
    shift = np.uint64(20)
    keys = hashes.each(scale.gram) >> shift << shift
    keys |= np.arange(len(keys), dtype=np.uint64)
    width = 1
    while width < scale.span:
        step = min(width, scale.span - width)
        keys = np.minimum(keys[: len(keys) - step], keys[step:])
        width += step
    windows = n - scale.length + 1
    anchor = (keys[:windows] & np.uint64((1 << 20) - 1)).view(np.int64)
    new = np.ones(windows, bool)
    np.not_equal(anchor[1:], anchor[:-1], out=new[1:])
    # A segment's windows begin at its start and end where one would leave it.
    beyond = np.maximum(starts[1:] - scale.length + 1, starts[:-1])
    for at in (starts, beyond):
        new[at[at < windows]] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], windows) - 1
    keep = first + scale.length <= starts[np.searchsorted(starts, first, "right")]
    return anchor[first[keep]], first[keep], last[keep]


def _blocks(batch: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of the batch's last column: bytes as symbols, segment starts, and each segment's row and first byte."""
    at, data = utf8(batch.column(batch.num_columns - 1))
    for parts in segments(np.diff(at), length):
        starts = np.cumsum([0, *(b - a for _, a, b in parts)])
        block = np.concatenate([data[at[row] + a : at[row] + b] for row, a, b in parts])
        yield BYTES[block], starts, np.array([x[0] for x in parts]), np.array([x[1] for x in parts])


def _word_blocks(batch: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The same with words as symbols; a text's words are held while the text is."""
    at, data = utf8(batch.column(batch.num_columns - 1))
    rows = words_of_rows(at, data)
    for parts in segments(np.array([len(r) for r in rows], np.int64), length):
        starts = np.cumsum([0, *(b - a for _, a, b in parts)])
        yield np.concatenate([rows[row][a:b] for row, a, b in parts]), starts, np.array([x[0] for x in parts]), np.array([x[1] for x in parts])


BLOCKS: dict[str, Callable] = {"bytes": _blocks, "words": _word_blocks}


def names(docs: DataFrame, scales: dict[str, Scale]) -> DataFrame:
    """``words``, ``core``, ``n``: how often a block has an anchor of that name; a name has a row for each of its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit, scale in scales.items():
                for symbols, starts, _, _ in BLOCKS[unit](batch, scale.length):
                    hashes = Hashes(symbols, POWERS[0])
                    a = anchors(hashes, starts, scale)[0]
                    core, n = np.unique(hashes.of(a, a + scale.core).view(np.int64), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.full(len(core), unit == "words"), core, n)], names=["words", "core", "n"])

    return arrow(docs.select("text"), run, "words boolean, core long, n long")


def sample(docs: DataFrame, scales: dict[str, Scale]) -> DataFrame:
    """Anchors: ``words`` (are symbols words or bytes), ``uid``, the names ``core`` and ``stretch``, and ``places`` in the text that share them.

    A text that repeats itself many times so gives few rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids = batch.column(0).to_numpy()
            for unit, scale in scales.items():
                for symbols, starts, rows, begin in BLOCKS[unit](batch, scale.length):
                    hashes = Hashes(symbols, POWERS[0])
                    a, lo, hi = anchors(hashes, starts, scale)
                    segment = np.searchsorted(starts, lo, "right") - 1
                    core = hashes.of(a, a + scale.core).view(np.int64)
                    shape = ((a - lo) << PLACE_BITS | (hi - lo)).astype(np.uint64)
                    stretch = mix(Hashes(symbols, POWERS[1]).of(lo, hi + scale.length) + shape * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                    place = (begin[segment] + lo - starts[segment]) << (2 * PLACE_BITS) | shape.astype(np.int64)
                    row = rows[segment]
                    order = np.lexsort((stretch, core, row))
                    row, core, stretch = row[order], core[order], stretch[order]
                    new = np.ones(len(row), bool)
                    new[1:] = (row[1:] != row[:-1]) | (core[1:] != core[:-1]) | (stretch[1:] != stretch[:-1])
                    first = np.flatnonzero(new)
                    places = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), pa.array(place[order], pa.int64()))
                    columns = [np.full(len(first), unit == "words"), uids[row[first]], core[first], stretch[first]]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), places], names=["words", "uid", "core", "stretch", "places"])

    return arrow(docs.select("uid", "text"), run, "words boolean, uid long, core long, stretch long, places array<long>")


def _unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, anchor, last window."""
    first = place >> (2 * PLACE_BITS)
    mask = (1 << PLACE_BITS) - 1
    return first, first + (place >> PLACE_BITS & mask), first + (place & mask)


OPEN = "words boolean, uid long, place long, core long, before binary, after binary, position long, name long, other long"


def _opened(batches: Iterator[pa.RecordBatch], byte: Scale, word: Scale) -> Iterator[pa.RecordBatch]:
    """Suffix tuples of a text's open byte anchors (bytes left of the anchor, nearest first, and right of the core); names of its open word windows."""
    kinds = [field.split()[0] for field in OPEN.split(", ")]
    for batch in batches:
        at, data = utf8(batch.column(batch.num_columns - 1))
        for row, (uid, places) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            text = data[at[row] : at[row + 1]]
            tuples, windows = [], []
            for x in places:
                first, anchor, last = (int(v) for v in _unpacked(np.int64(x["place"])))
                if x["words"]:
                    windows.append(np.arange(first, last + 1))
                else:
                    tuples.append((x["place"], x["core"], text[first:anchor][::-1].tobytes(), text[anchor + byte.core : last + byte.length].tobytes()))
            if tuples:
                place, core, before, after = zip(*tuples, strict=True)
                m = len(place)
                made = [[False] * m, [uid] * m, place, core, before, after, [None] * m, [None] * m, [None] * m]
                yield _record(made, kinds)
            if windows:
                words = word_hashes(text.tobytes())
                position = np.unique(np.concatenate(windows))
                m = len(position)
                names = [Hashes(words, p).of(position, position + word.length).view(np.int64) for p in POWERS]
                yield _record([[True] * m, [uid] * m, [None] * m, [None] * m, [None] * m, [None] * m, position, *names], kinds)


def _record(columns: list, names: list[str]) -> pa.RecordBatch:
    types = [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _padded(strings: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(len(strings), width)


def induce(core: np.ndarray, least: np.ndarray, most: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Which windows recur: a boolean for each member and offset of the window before the anchor.

    Members come in groups of equal ``core``, ordered by ``after``. Member i's own
    offsets are least[i] to most[i].
    """
    m, width = after.shape
    recurs = np.zeros((m, width + 1), bool)
    order = np.arange(m)
    same = core[1:] == core[:-1]
    differ = after[1:] != after[:-1]
    common = np.where(same, np.where(differ.any(1), differ.argmax(1), width), -1)
    for offset in range(width + 1):
        if offset:
            # Only members with windows this far left go on; between two that stay, the least common prefix holds.
            order, common = _kept(order, common, most[order] >= offset)
            if len(order) < 2:
                break
            front = before[order, offset - 1]
            group = np.concatenate([[0], np.cumsum(common < 0)])
            by = np.argsort(group * 256 + front, kind="stable")
            least_between = _range_min(common, by[:-1], by[1:])
            joined = (front[by[1:]] == front[by[:-1]]) & (group[by[1:]] == group[by[:-1]])
            split = np.where(joined, least_between + 1, 0)
            split[group[by[1:]] != group[by[:-1]]] = -1
            order, common = order[by], split
        # Only members whose own windows start at this offset are compared: the others' bytes may lack the end.
        own = least[order] <= offset
        inside, between = _kept(order, common, own)
        full = between >= width
        hit = np.zeros(len(inside), bool)
        hit[1:] |= full
        hit[:-1] |= full
        recurs[inside[hit], offset] = True
        # A member whose common prefixes cannot grow to a window's length any more is done.
        near = np.maximum(np.append(common, -1), np.concatenate([[-1], common]))
        order, common = _kept(order, common, near + (most[order] - offset) >= width)
        if len(order) < 2:
            break
    return recurs


def _kept(order: np.ndarray, common: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The members to keep, and the common prefix of those that are then neighbours."""
    if keep.all():
        return order, common
    at = np.flatnonzero(keep)
    if len(at) < 2:
        return order[at], common[:0]
    return order[at], np.minimum.reduceat(common, at[:-1])[: len(at) - 1] if at[-1] == len(order) - 1 else np.minimum.reduceat(common[: at[-1]], at[:-1])


def _range_min(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least of values[min:max] of each pair of positions (a sparse table)."""
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    levels = [values]
    while (1 << len(levels)) <= len(values):
        prev, step = levels[-1], 1 << (len(levels) - 1)
        levels.append(np.minimum(prev[:-step], prev[step:]))
    level = np.frexp((hi - lo).astype(np.float64))[1] - 1
    out = np.empty(len(lo), values.dtype)
    for k in np.unique(level):
        at = level == k
        out[at] = np.minimum(levels[k][lo[at]], levels[k][hi[at] - (1 << k)])
    return out


def _induced(batches: Iterator[pa.RecordBatch], members: int, width: int) -> Iterator[pa.RecordBatch]:
    """Runs ``induce`` over complete groups of a stream sorted by (name, other, after)."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count >= max(members, 20_000):
            whole = pa.Table.from_batches(held).combine_chunks()
            group = _groups(whole)
            cut = int(np.searchsorted(group, group[-1]))
            if cut:
                yield from _recurring(whole.slice(0, cut), group[:cut], width)
            held, count = whole.slice(cut).to_batches(), len(group) - cut
    if count:
        whole = pa.Table.from_batches(held).combine_chunks()
        yield from _recurring(whole, _groups(whole), width)


def _groups(rows: pa.Table) -> np.ndarray:
    """Numbers, growing from group to group, of rows in the order of (name, other)."""
    name, other = (rows.column(c).to_numpy() for c in ("name", "other"))
    new = np.zeros(len(name), np.int64)
    new[1:] = (name[1:] != name[:-1]) | (other[1:] != other[:-1])
    return np.cumsum(new)


def _recurring(rows: pa.Table, group: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    first, anchor, last = _unpacked(rows.column("place").to_numpy())
    least = np.maximum(anchor - last, rows.column("lo").to_numpy())
    most = np.minimum(anchor - first, rows.column("hi").to_numpy())
    found = induce(group, least, most, _padded(rows.column("before").to_pylist(), width), _padded(rows.column("after").to_pylist(), width))
    # Offsets grow to the left: reversed, each run of recurring windows is a run of positions.
    member, offset = np.nonzero(found[:, ::-1])
    yield _runs(rows.column("uid").to_numpy()[member], anchor[member] - (width - offset))


def _runs(uid: np.ndarray, position: np.ndarray) -> pa.RecordBatch:
    """Runs of consecutive positions as (uid, first, last)."""
    if len(uid):
        new = np.ones(len(uid), bool)
        new[1:] = (uid[1:] != uid[:-1]) | (position[1:] != position[:-1] + 1)
        at = np.flatnonzero(new)
        ends = np.append(at[1:], len(uid)) - 1
        uid, lo, hi = uid[at], position[at], position[ends]
    else:
        lo = hi = position
    return pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], names=["uid", "lo", "hi"])


def _halves(tuples: DataFrame, width: int) -> DataFrame:
    """Each tuple under the names of the halves of its offsets in which it has windows."""
    mask = F.lit((1 << PLACE_BITS) - 1)
    most = F.shiftright("place", PLACE_BITS).bitwiseAND(mask)
    least = most - F.col("place").bitwiseAND(mask)
    middle = F.floor((F.col("lo") + F.col("hi")) / 2)
    halves = F.array(F.struct(F.col("lo").alias("lo"), middle.alias("hi")), F.struct((middle + 1).alias("lo"), F.col("hi").alias("hi")))
    halved = tuples.withColumn("half", F.explode(halves)).withColumns({"lo": F.col("half.lo"), "hi": F.col("half.hi")})
    halved = halved.where((most >= F.col("lo")) & (least <= F.col("hi")))
    shared = [F.col("core"), F.col("lo"), F.col("hi"), F.expr("substring(before, 1, cast(lo as int))"), F.expr(f"substring(after, 1, cast({width} - hi as int))")]
    return halved.withColumns({"name": F.xxhash64(F.lit(1), *shared), "other": F.xxhash64(F.lit(2), *shared)}).drop("half")


def _induced_groups(tuples: DataFrame, width: int, members: int) -> DataFrame:
    """``uid``, ``lo``, ``hi``: runs of recurring windows of suffix tuples, by recursion and induction."""
    level = tuples.select("uid", "place", "core", "before", "after", F.lit(0).cast("long").alias("lo"), F.lit(width).cast("long").alias("hi"), F.col("core").alias("name"), F.lit(0).cast("long").alias("other"))
    found, small = [], []
    group = ["name", "other"]
    while True:
        sizes = written(level.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        level = written(level.join(sizes, group))
        small.append(level.where((F.col("n") <= members) & (F.col("lo") < F.col("hi"))).drop("n"))
        # A single offset: all tuples of a name are one window.
        position = (F.shiftright("place", 2 * PLACE_BITS) + F.shiftright("place", PLACE_BITS).bitwiseAND(F.lit((1 << PLACE_BITS) - 1)) - F.col("lo")).alias("lo")
        found.append(level.where("lo = hi").select("uid", position, position.alias("hi")))
        level = level.where((F.col("n") > members) & (F.col("lo") < F.col("hi"))).drop("n")
        if level.isEmpty():
            break
        level = written(_halves(level, width))
    rows = small[0]
    for part in small[1:]:
        rows = rows.unionByName(part)
    ordered = rows.repartition(*group).sortWithinPartitions(*group, "after")
    runs = arrow(ordered, lambda b: _induced(b, members, width), "uid long, lo long, hi long")
    for part in found:
        runs = runs.unionByName(part)
    return runs


def repeated_windows(docs: DataFrame, length: int = 400, passage: int = 50, members: int = 256) -> DataFrame:
    """``words``, ``uid``, ``lo``, ``hi``: runs of window starts that recur, of ``docs`` with ``uid`` and ``text``.

    Windows are of ``length`` bytes or, where ``words`` holds, of ``passage`` words.
    """
    byte, word = bytes_scale(length), words_scale(passage)
    name = ["words", "core"]
    scales = {"bytes": byte, "words": word}
    # Counts are written before they are joined, so that a join of a hot name can be split.
    # Anchors are found twice, at first their names alone: to write them takes more disk than all else.
    twice = written(names(docs, scales).groupBy(*name).agg(F.sum("n").alias("n")).where("n > 1").select(*name))
    held = written(sample(docs, scales).join(twice, name))
    n = F.sum(F.size("places")).alias("n")
    stretches = written(held.groupBy(*name, "stretch").agg(n, F.min(F.struct("uid", F.element_at("places", 1).alias("place"))).alias("one")))
    again = written(stretches.where("n > 1").select(*name, "stretch"))
    first = F.shiftright("place", 2 * PLACE_BITS)
    last = first + F.col("place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    whole = held.join(again, [*name, "stretch"], "left_semi").select("words", "uid", F.explode("places").alias("place"))
    settled = whole.select("words", "uid", first.alias("lo"), last.alias("hi"))
    mixed = written(stretches.groupBy(*name).agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(*name))
    open_ = stretches.join(mixed, name).select(F.col("one.uid").alias("uid"), F.struct("words", F.col("one.place").alias("place"), "core").alias("x"))
    listed = open_.groupBy("uid").agg(F.collect_list("x").alias("places"))
    # Rows that repeat share a uid and give a tuple twice; all their windows are settled above, and no other's verdict changes.
    opened = written(arrow(listed.join(docs.select("uid", "text"), "uid").select("uid", "places", "text"), lambda b: _opened(b, byte, word), OPEN))
    induced = _induced_groups(opened.where("not words").select("uid", "place", "core", "before", "after"), byte.span - 1, members)
    windows = opened.where("words").select("uid", "position", "name", "other")
    recurring = written(windows.groupBy("name", "other").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name", "other"))
    passages = windows.join(recurring, ["name", "other"], "left_semi").select("uid", F.col("position").alias("lo"), F.col("position").alias("hi"))
    return settled.unionByName(induced.withColumn("words", F.lit(False))).unionByName(passages.withColumn("words", F.lit(True)))


def _union(runs: list[tuple[int, int]]) -> list[list[int]]:
    spans: list[list[int]] = []
    for lo, hi in sorted(runs):
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = max(hi, spans[-1][1])
        else:
            spans.append([lo, hi])
    return spans


@any_columns
def remove_repeats(docs: DataFrame, length: int = 400, passage: int = 50, members: int = 256) -> DataFrame:
    """``docs`` with ``kept`` (the bytes that stay), n_bytes, n_removed, n_spans, kept_sha256 and n_passage_words.

    ``n_passage_words`` counts words of passages (``passage`` words or more) that recur; they stay unless ``length`` bytes of them do.
    """
    keyed = docs.withColumn("uid", text_key(F.col("doc_id"), F.col("text")))
    runs = repeated_windows(keyed.select("uid", "text"), length, passage, members).groupBy("uid").agg(F.collect_set(F.struct("words", "lo", "hi")).alias("runs"))
    names = [c for c in docs.columns if c != "text"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, data = utf8(batch.column(batch.num_columns - 1))
            kept, stats = [], []
            for row, found in enumerate(batch.column(batch.num_columns - 2).to_pylist()):
                text = data[at[row] : at[row + 1]]
                spans = _union([(x["lo"], x["hi"] + length) for x in found or () if not x["words"]])
                words = sum(b - a for a, b in _union([(x["lo"], x["hi"] + passage) for x in found or () if x["words"]]))
                parts, end = [], 0
                for lo, hi in spans:
                    parts.append(text[end:lo].tobytes())
                    end = hi
                parts.append(text[end:].tobytes())
                rest = b"".join(parts)
                kept.append(rest)
                stats.append((len(text), len(text) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), words))
            n, r, s, h, w = zip(*stats, strict=True) if stats else ((),) * 5
            extra = [pa.array(kept, pa.binary()), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(s, pa.int64()), pa.array(h, pa.string()), pa.array(w, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *extra], names=[*batch.schema.names[:-2], "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words"])

    made = T.StructType.fromDDL("kept binary, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_passage_words bigint")
    schema = T.StructType([*(docs.schema[c] for c in names), *made.fields])
    return arrow(keyed.join(runs, "uid", "left").select(*names, "runs", "text"), cut, schema)
