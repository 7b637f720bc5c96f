"""Language model scoring with a probabilistic suffix tree over words.

Training, level by level over the whole corpus: the next symbols of every context of d
words that occurs ``min_context`` times are counted; those seen ``min_symbol`` times are
listed with discounted frequencies, and the freed mass goes to the parent's distribution
(the context without its first word), down to the root, which is the add-one distribution
of all tokens. A context is retained as a state if its distribution diverges from its
parent's: the log-likelihood gain must reach ``gain_per_symbol`` for each listed symbol.
A token is scored in the state of the longest retained suffix of what precedes it. The
floors are counts, so that the tree grows with the corpus; ``max_depth`` is its order.

A word is a 64-bit hash and an n-gram the hash of its two (n-1)-grams, so that an n-gram
knows its context (the first) and itself in the parent (the second). Counts, states and
listed symbols are tables, joined by these hashes.

Scoring is a sum over n-grams. A listed symbol adds log p - log p(parent), an unlisted one
adds its state's log of freed mass; so with weight(n-gram) = what it adds as a listed
symbol beyond the freed mass + the freed mass of the state that it is, a text's score is
its root score plus the weights of all its n-grams. Texts are taken in blocks of whole
texts, about ``block`` tokens each. A block asks for each of its distinct n-grams once: the
questions meet the entries in ``PARTS`` parts, and the answers meet the block again, which
has kept where its n-grams stand. So what is sent goes with the tokens, however large the
tree is; an n-gram in every text is one question a block. ``ROUNDS`` rounds take a share of
the texts each, and let go of what was sent before the next one begins.

Bounds: broadcast are entries that stand ``OFTEN`` times in a block on average, at most
``hot_entries`` of them; Bloom filters of ``filter_bits`` bits; and the contexts that make
up a thousandth of all tokens each, a thousand at most. Full filters let more through and
change no result. A part holds its share of the entries and of the questions in one task.

Defined cases: null and blank texts are one end token; rows with null ids train; rows
that repeat count as often as they stand; an empty table gives an empty result, and
with no training rows every token is unknown.
"""

from __future__ import annotations

import collections
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from ..lineage import release, settled, written
from .common import any_columns, arrow, mix, most_frequent, text_key, utf8, words_of_rows
from .grams import Filter, grams

#: The end token's hash, a value like any other.
END = 0x5851F42D4C957F2D
#: A context with so many of all tokens has its symbols counted in SALTS parts.
HOT_SHARE, SALTS = 1000, 64
#: Entries and questions meet in so many parts, by the last bits of the n-gram.
PART_BITS = 10
PARTS = 1 << PART_BITS
#: Texts are scored in so many rounds, each with its share of questions on disk.
ROUNDS = 3
#: An entry is broadcast that stands so many times in a block on average.
OFTEN = 4
#: Bytes with A-Z lower-cased.
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
#: Texts of a block at most, so that 16 bits tell them apart.
MOST_TEXTS = 1 << 15


def tokens_of_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words (A-Z only) of all texts of a column, an end token after each, and how many each text has."""
    at, data = utf8(column)
    words = words_of_rows(at - at[0], LOWER[data[at[0] : at[-1]]])
    sizes = np.array([len(x) + 1 for x in words], np.int64)
    tokens = np.full(sizes.sum(), END, np.uint64)
    if len(tokens):
        is_word = np.ones(len(tokens), bool)
        is_word[np.cumsum(sizes) - 1] = False
        tokens[is_word] = np.concatenate(words)
    return tokens, sizes


def _token_blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tokens of whole texts, about ``block`` at a time, and for each where its text starts."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            held.append(tokens_of_rows(batch.column(0).slice(a, 256)))
            size += len(held[-1][0])
            if size >= block:
                yield _concatenated(held)
                held, size = [], 0
    if held:
        yield _concatenated(held)


def _concatenated(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.concatenate([x for _, x in held])
    return np.concatenate([x for x, _ in held]), np.repeat(np.cumsum(sizes) - sizes, sizes)


def _runs(sizes: np.ndarray, most: int, texts: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about equal size, up to about ``most`` tokens together and ``texts`` texts."""
    upto = np.cumsum(sizes)
    most = -(-int(upto[-1]) // (int(upto[-1]) // most + 1)) if len(sizes) else most
    a = 0
    while a < len(sizes):
        before = upto[a - 1] if a else 0
        b = min(int(np.searchsorted(upto, before + most)) + 1, a + texts, len(sizes))
        yield a, b
        a = b


def held_out(doc_id: Column, modulus: int = 7, remainder: int = 2) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def vocabulary(training: DataFrame, block: int = 2_000_000) -> DataFrame:
    """``key`` (the token's hash) and ``n`` over all training texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, _ in _token_blocks(batches, block):
            keys, n = np.unique(tokens.view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n, pa.int64())], names=["key", "n"])

    return arrow(training.select("text"), count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def next_counts(training: DataFrame, contexts: DataFrame, listed: DataFrame, depth: int, n_tokens: int, filter_bits: int, parts: int = 4096, block: int = 2_000_000) -> DataFrame:
    """``ctx``, ``up``, ``n``: how often each symbol follows each of ``contexts`` (key, total), a context of ``depth`` words.

    ``up`` is the n-gram without its first word, one of ``listed`` (key): a rarer one can't
    reach the floor. A task sends its counts in ``parts`` rows, dealt out by context (the
    hottest also by symbol); the filters may let others through.
    """
    spark = training.sparkSession
    hot = contexts.where(F.col("total") * HOT_SHARE >= n_tokens).select("key").toArrow().column(0).to_numpy()
    sent = spark.sparkContext.broadcast((Filter(contexts, filter_bits), Filter(listed, filter_bits), np.sort(hot)))

    def rows_of(ctx: np.ndarray, up: np.ndarray, salt: np.ndarray) -> pa.RecordBatch:
        part = (mix(ctx.view(np.uint64) + salt.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((up, ctx, part))
        part, ctx, up = part[order], ctx[order], up[order]
        first = np.flatnonzero(np.concatenate([[True], (ctx[1:] != ctx[:-1]) | (up[1:] != up[:-1])]))
        n = np.diff(np.append(first, len(ctx)))
        part, ctx, up = part[first], ctx[first], up[first]
        group = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        offsets = pa.array(np.append(group, len(ctx)), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (ctx, up, n.astype(np.int32))]
        return pa.RecordBatch.from_arrays([pa.array(part[group], pa.int32()), *lists], names=["part", "ctxs", "ups", "ns"])

    def found(tokens: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known, fine, _ = sent.value
        ends, whole = collections.deque(grams(tokens, starts, depth), 1).pop()
        # An n-gram of ``depth`` words that ends before the text does is a context of the next token.
        at = ends[tokens[ends] != np.uint64(END)]
        at = at[known.holds(whole[at])] + 1
        at = at[fine.holds(whole[at])]
        return whole[at - 1].view(np.int64), whole[at].view(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = sent.value[2]
        for tokens, starts in _token_blocks(batches, block):
            ctx, up = found(tokens, starts)
            del tokens, starts
            salt = np.where(np.isin(ctx, often), up & (SALTS - 1), 0) if len(often) else np.zeros(len(ctx), np.int64)
            if len(ctx):
                yield rows_of(ctx, up, salt)

    rows = arrow(training.select("text"), count, "part int, ctxs array<long>, ups array<long>, ns array<int>")
    each = rows.repartition("part").select("part", F.explode(F.arrays_zip("ctxs", "ups", "ns")).alias("x"))
    return each.groupBy("part", F.col("x.ctxs").alias("ctx"), F.col("x.ups").alias("up")).agg(F.sum("x.ns").alias("n")).drop("part")


def level(counts: DataFrame, contexts: DataFrame, parents: DataFrame, min_symbol: int, discount: float, gain_per_symbol: float) -> DataFrame:
    """The listed symbols of a level: ``key`` (the n-gram), ``ctx``, ``n``, ``log_q``, ``ends``, ``total``, ``stays``, ``log_left``, ``parent``.

    ``parents`` (key, log_q, ends) has the log probability of the symbol in the parent, for
    each n-gram of the level below; ``log_q`` is that of this level, the parent's where the
    context is not retained. Rows of a context are its distinct listed symbols.
    """
    listed = counts.where(F.col("n") >= min_symbol).join(parents.select(F.col("key").alias("up"), F.col("log_q").alias("parent"), "ends"), "up")
    rows = listed.join(contexts.select(F.col("key").alias("ctx"), "total"), "ctx")
    p = (F.col("n") - F.lit(discount)) / F.col("total")
    by = W.Window.partitionBy("ctx")
    rows = rows.withColumns({"left": 1 - F.sum(p).over(by), "listed_n": F.sum("n").over(by), "listed": F.count(F.lit(1)).over(by)})
    log_p = F.log(p + F.col("left") * F.exp("parent"))
    gain = F.sum(F.col("n") * (log_p - F.col("parent"))).over(by) + (F.col("total") - F.col("listed_n")) * F.log("left")
    rows = rows.withColumn("stays", gain >= F.lit(gain_per_symbol) * F.col("listed"))
    return rows.select(F.xxhash64("ctx", "up").alias("key"), "ctx", "n", F.when(F.col("stays"), log_p).otherwise(F.col("parent")).alias("log_q"), "ends", "total", "stays", F.log("left").alias("log_left"), "parent")


def train(training: DataFrame, vocab: DataFrame, n_tokens: int, n_distinct: int, max_depth: int = 3, min_context: int = 64, min_symbol: int = 8, discount: float = 0.6, gain_per_symbol: float = 2.0, filter_bits: int = 1 << 26) -> DataFrame:
    """``key``, ``n``, ``weight`` (natural log) of the tree's n-grams; a key may have several rows, all with its count."""
    weights = None
    parents = vocab.select("key", "n", F.log((F.col("n") + 1) / F.lit(float(n_tokens + n_distinct + 1))).alias("log_q"), (F.col("key") == F.lit(END)).alias("ends"))
    contexts = vocab.where((F.col("n") >= min_context) & (F.col("key") != F.lit(END))).select("key", F.col("n").alias("total"))
    for depth in range(1, max_depth + 1):
        if contexts.isEmpty():
            break
        counts = next_counts(training, contexts, parents.where(F.col("n") >= min_symbol).select("key"), depth, n_tokens, filter_bits)
        here = written(level(counts, contexts, parents, min_symbol, discount, gain_per_symbol), drop_shuffles=True)
        del counts
        release(training.sparkSession)  # a level's counts are done with
        kept = here.where("stays")
        symbols = kept.select("key", "n", (F.col("log_q") - F.col("parent") - F.col("log_left")).alias("weight"))
        states = kept.groupBy(F.col("ctx").alias("key")).agg(F.first("total").alias("n"), F.first("log_left").alias("weight"))
        weights = symbols.unionByName(states) if weights is None else weights.unionByName(symbols).unionByName(states)
        parents = here.select("key", "n", "log_q", "ends")
        contexts = here.where((F.col("n") >= min_context) & ~F.col("ends")).select("key", F.col("n").alias("total"))
    if weights is None:
        return vocab.select("key", "n", F.lit(0.0).alias("weight")).where(F.lit(False))
    return weights


def questions(docs: DataFrame, sent: Broadcast, max_depth: int, block: int) -> DataFrame:
    """Blocks of ``docs`` (any columns, then text): what they ask for, and one row of their own each.

    A question row has ``block``, ``part`` and ``keys``, the block's distinct n-grams of that
    part in order of ``_turned``. The block's own row has ``docs``, its texts' other columns
    with n_tokens and the sums over ``hot`` n-grams, ``asked``, the number of its keys, and
    ``places``: for each place of each key in that order, the number of its text, inverted
    at a key's first place. ``sent`` has the hot n-grams in order, their sums, and a filter
    of the tree's n-grams.
    """
    made = T.StructType.fromDDL("n_tokens bigint, hot_known double, hot_base double, hot_weight double")
    each = _nullable(T.StructType([*docs.schema.fields[:-1], *made.fields]))
    schema = T.StructType.fromDDL("block bigint, part int, keys array<bigint>, asked bigint, places array<smallint>").add("docs", T.ArrayType(each))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (hot_keys, *values), maybe = sent.value
        block_id = TaskContext.get().partitionId() << 32
        for batch in batches:
            tokens, sizes = tokens_of_rows(batch.column(batch.num_columns - 1))
            upto = np.append(0, np.cumsum(sizes))
            for a, b in _runs(sizes, block, MOST_TEXTS):
                row = np.repeat(np.arange(b - a, dtype=np.int16), sizes[a:b])
                starts = np.repeat(upto[a:b] - upto[a], sizes[a:b])
                sums = np.zeros((3, b - a))
                rare, places = [], []
                for n, (ends, whole) in enumerate(grams(tokens[upto[a] : upto[b]], starts, max_depth + 1), 1):
                    if n > 1:
                        ends = ends[maybe.holds(whole[ends])]
                    keys, at = whole[ends], row[ends]
                    found = np.minimum(np.searchsorted(hot_keys, keys), max(len(hot_keys) - 1, 0))
                    hit = hot_keys[found] == keys if len(hot_keys) else np.zeros(len(keys), bool)
                    for k, v in enumerate(values):
                        sums[k] += np.bincount(at[hit], v[found[hit]], b - a)
                    rare.append(_turned(keys[~hit]))
                    places.append(at[~hit])
                turned, at = np.concatenate(rare), np.concatenate(places)
                del rare, places
                order = np.argsort(turned)
                turned, at = turned[order], at[order]
                del order
                first = np.concatenate([[True], turned[1:] != turned[:-1]]) if len(turned) else np.zeros(0, bool)
                turned = turned[first]
                part = (turned >> np.uint64(64 - PART_BITS)).astype(np.int32)
                cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
                keys = (turned << np.uint64(PART_BITS)) | (turned >> np.uint64(64 - PART_BITS))
                own = [*(c.slice(a, b - a) for c in batch.columns[:-1]), pa.array(sizes[a:b]), *(pa.array(x) for x in sums)]
                own = pa.StructArray.from_arrays(own, names=each.names)
                # The questions, then the block's own row.
                n_rows, own_part = len(cuts) + 1, int(mix(np.array([block_id], np.uint64))[0]) % PARTS
                last = lambda n: pa.array(np.append(np.zeros(n_rows), n), pa.int32())  # noqa: E731  offsets of lists, empty but the last
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n_rows, block_id)),
                        pa.array(np.append(part[cuts], own_part), pa.int32()),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([cuts, [len(keys), len(keys)]]), pa.int32()), pa.array(keys.view(np.int64))),
                        pa.array(np.append(np.zeros(n_rows - 1), len(keys)), pa.int64()),
                        pa.ListArray.from_arrays(last(len(at)), pa.array(np.where(first, ~at, at))),
                        pa.ListArray.from_arrays(last(b - a), own),
                    ],
                    names=schema.names,
                )
                block_id += 1

    return arrow(docs, ask, schema)


def _nullable(kind: T.DataType) -> T.DataType:
    """The type with nulls allowed throughout, as grouped Arrow functions compare types to the letter."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _nullable(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_nullable(kind.elementType))
    if isinstance(kind, T.MapType):
        return T.MapType(_nullable(kind.keyType), _nullable(kind.valueType))
    return kind


def _turned(keys: np.ndarray) -> np.ndarray:
    """Keys with their part as the first bits."""
    return (keys >> np.uint64(PART_BITS)) | (keys << np.uint64(64 - PART_BITS))


def _answers(asked: pa.Table, entries: pa.Table) -> pa.Table:
    """``asked`` of one part with ``ns`` and ``weights`` of its keys instead of these; 0 where there is no entry."""
    keys, at = np.unique(entries.column("key").to_numpy(), return_inverse=True)
    n = np.zeros(len(keys) + 1, np.int64)
    np.add.at(n, at, entries.column("n").to_numpy())
    weight = np.bincount(at, entries.column("weight").to_numpy(), len(keys) + 1).astype(float)
    lists = asked.column("keys").combine_chunks()
    wanted = lists.flatten().to_numpy()
    found = np.searchsorted(keys, wanted)
    if len(keys):
        found[keys[np.minimum(found, len(keys) - 1)] != wanted] = len(keys)
    offsets = pa.array(np.append(0, np.cumsum(lists.value_lengths().to_numpy())), pa.int32())
    of = {"ns": pa.ListArray.from_arrays(offsets, pa.array(n[found])), "weights": pa.ListArray.from_arrays(offsets, pa.array(weight[found]))}
    return pa.table({c: asked.column(c) for c in ("block", "part")} | of | {c: asked.column(c) for c in ("asked", "places", "docs")})


def _summed(block: pa.Table) -> pa.Table:
    """One block's texts with the sums over its answers."""
    block = block.sort_by("part")
    n, weight = (block.column(c).combine_chunks().flatten().to_numpy() for c in ("ns", "weights"))
    places, docs = (block.column(c).combine_chunks().flatten() for c in ("places", "docs"))
    places = places.to_numpy()
    if len(n) != sum(block.column("asked").to_pylist()):
        raise RuntimeError("a block's answers are not those it asked for")
    key = np.cumsum(places < 0) - 1
    row = np.where(places < 0, ~places, places)
    out = {docs.type.field(i).name: c for i, c in enumerate(docs.flatten())}
    for name, values in (("rare_known", (n > 0).astype(float)), ("rare_base", np.log10(n + 1.0)), ("rare_weight", weight)):
        out[name] = pa.array(np.bincount(row, values[key], len(docs)).astype(float))
    return pa.table(out)


def _scored(docs: DataFrame, rare: DataFrame, sent: Broadcast, max_depth: int, block: int) -> DataFrame:
    """``docs`` (any columns, then text) with the sums over hot and over rare n-grams instead of the text."""
    asked = questions(docs, sent, max_depth, block)
    entries = rare.select(F.col("key").bitwiseAND(F.lit(PARTS - 1)).cast("int").alias("part"), "key", F.when(F.col("known") == 1, F.col("n")).otherwise(0).alias("n"), "weight")
    answered = T.StructType([*T.StructType.fromDDL("block bigint, part int, ns array<bigint>, weights array<double>").fields, *(asked.schema[c] for c in ("asked", "places", "docs"))])
    answers = asked.groupBy("part").cogroup(entries.groupBy("part")).applyInArrow(_answers, answered)
    sums = T.StructType.fromDDL("rare_known double, rare_base double, rare_weight double")
    return answers.groupBy("block").applyInArrow(_summed, T.StructType([*asked.schema["docs"].dataType.elementType.fields, *sums.fields]))


@any_columns
def score(docs: DataFrame, hot_entries: int = 1_000_000, max_depth: int = 3, filter_bits: int = 1 << 26, block: int = 2_000_000, **parameters) -> DataFrame:
    """``docs`` without its text, plus held_out, n_tokens, n_known, train_tokens, base_score and score."""
    spark = docs.sparkSession
    training = docs.where(~held_out(F.col("doc_id")))
    totals: list[int] = []

    def build() -> DataFrame:
        vocab = written(vocabulary(training), drop_shuffles=True)
        head = vocab.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
        totals.extend((head["n"] or 0, head["v"]))
        release(spark)
        tree = train(training, vocab, *totals, max_depth, filter_bits=filter_bits, **parameters)
        tree = tree.select("key", "n", F.lit(0).alias("known"), (F.col("weight") / F.lit(float(np.log(10)))).alias("weight"))
        return tree.unionByName(vocab.select("key", "n", F.lit(1).alias("known"), F.lit(0.0).alias("weight")))

    # The levels' own tables go once the entries are written.
    entries = settled(spark, build)
    n_tokens, n_distinct = totals
    release(spark)
    log_total = float(np.log10(n_tokens + n_distinct + 1))
    # A product of two literals would be one of 32-bit integers, which 2^29 tokens overflow.
    often = most_frequent(entries.where(F.col("n") * block >= OFTEN * n_tokens), "n", hot_entries)
    top = often.groupBy("key").agg(F.max("n"), F.sum("known"), F.sum("weight")).toArrow()
    keys, n, known, weight = (c.to_numpy() for c in top.columns)
    order = np.argsort(keys.view(np.uint64))
    hot = [keys.view(np.uint64)[order], known[order].astype(float), np.where(known > 0, np.log10(n + 1.0), 0.0)[order], weight[order]]
    names = [c for c in docs.columns if c != "text"]
    sent = spark.sparkContext.broadcast((hot, Filter(entries.where("known = 0").select("key"), filter_bits)))
    rare = entries.where(F.col("n") < F.lit(int(n.min()))) if len(n) else entries
    rounds = []
    for k in range(ROUNDS):
        share = docs.select(*names, "text").where(F.pmod(text_key(F.col("doc_id"), F.col("text")), F.lit(ROUNDS)) == k)
        rounds.append(written(_scored(share, rare, sent, max_depth, block), drop_shuffles=True))
        release(spark)  # a round's questions and answers are done with
    out = functools.reduce(DataFrame.unionByName, rounds)
    root = F.col("hot_base") + F.col("rare_base") - F.col("n_tokens") * F.lit(log_total)
    return out.select(
        *names,
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("hot_known") + F.col("rare_known")).cast("long").alias("n_known"),
        F.lit(n_tokens).cast("long").alias("train_tokens"),
        root.alias("base_score"),
        (root + F.col("hot_weight") + F.col("rare_weight")).alias("score"),
    )
