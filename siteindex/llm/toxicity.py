"""Toxicity of texts whose words may be disguised: restore them through a noisy channel, then classify.

Source. A character language model of order 4 over a-z, other letters and word bounds:
counts of all character 4-grams of the texts that are not held out, each order smoothed by the next
lower one. The alphabet bounds the table (28^4 counts), whatever the corpus.

Channel. A writer keeps a letter, writes a digit or sign for it (leetspeak), repeats it, or puts a
separator between letters. Spans that look like it (leet signs among letters, single letters
with separators, letters three times in a row, three doubled letters in a row) become a
lattice: each sign may be any of its letters or a bound, each repetition may be dropped,
each separator may be dropped or be a bound. Viterbi finds the likeliest path; its states
are the last three characters, all of them, without a beam. The restored letters take the
place of the span. Other text stays as it is.

Score. Logistic regression over the restored text's words (to 10 bytes) and word beginnings
(3 to 8 bytes), each as present, twice and four times or more. Features are told apart by
62-bit hashes. Those whose classes clearly differ in the labelled rows are used; the model
is fitted by Spark on labelled rows that are not held out, at most about ``max_labelled``
(a hash threshold), and at most ``max_features`` features.

Labels teach only by rows that are not held out; language, source and id are no features.

Bounds: broadcast are the language model and ``max_features`` weights. Restored spans of a
task are remembered, ``remembered`` of them.

Defined cases: null and blank texts have the score of the model's intercept; rows that
repeat are scored each; labels that repeat count as often as they stand, labels other than 0 and 1 and null
ids are ignored; without labelled rows of both classes every score is the smoothed base rate (0.5
without any); equally likely paths go by the order of the options; very long texts and spans are read
whole; an empty table gives an empty result; columns other than doc_id and text are kept and not read.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lineage import written
from .common import BYTES, POWERS, Hashes, any_columns, arrow, mix, most_frequent
from .terms import LETTER_TERMS, run_starts, terms_of, text_blocks

#: Letters that a digit or sign stands for. Fixed values of common use.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t",
}
#: What the channel costs, in nats: a letter for a sign, a sign as a bound, a dropped repetition or separator, a separator as a bound, a kept repetition.
SIGN, SIGN_BOUND, REPEATED, DROPPED, SEPARATED, KEPT_REPEAT = 1.0, 4.0, 0.5, 0.2, 1.0, 0.5
SEPARATORS = " ._*~-"
#: Symbols of the language model: 0 a bound, 1 to 26 the letters, 27 any other letter.
ORDER, SYMBOLS, OTHER = 4, 28, 27
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[ord("a") : ord("z") + 1] = _SYMBOL[ord("A") : ord("Z") + 1] = np.arange(1, 27)
_SYMBOL[128:] = OTHER

#: Spans that may be disguised words, in lower-cased text.
SUSPECT = re.compile(
    rb"(?<![a-z0-9@$!|+\x80-\xff])(?:"
    rb"(?:[a-z0-9@$|+!][ ._*~-]){2,}[a-z0-9@$|+!](?![a-z0-9@$|+!\x80-\xff])"  # letters with separators
    rb"|[a-z0-9@$|+]{1,2}(?:[._*~-][a-z0-9@$|+!]{1,2}){2,}(?![a-z0-9@$|+!\x80-\xff])"  # short pieces
    rb"|(?=[0-9@$|+!]*[a-z])(?=[a-z!]*[0-9@$|+]|[a-z]+![a-z])[a-z0-9@$|+!]{2,}[a-z0-9@$|+]"  # signs among letters
    rb")|[a-z]*([a-z])\1\1[a-z]*|[a-z]*([a-z])\2([a-z])\3([a-z])\4[a-z]*"  # repetitions
)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def gram_counts(texts: list[bytes]) -> np.ndarray:
    """Counts of the character 4-grams of whole texts; every text and word begins and ends with a bound."""
    data = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    data = data[(data & 0xC0) != 0x80]  # one symbol for each character
    s = _SYMBOL[data]
    s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]
    s = np.concatenate([[0, 0], s])  # the first word, too, follows three bounds or a bound and a word
    code = ((s[:-3] * SYMBOLS + s[1:-2]) * SYMBOLS + s[2:-1]) * SYMBOLS + s[3:]
    return np.bincount(code, minlength=SYMBOLS**ORDER)


def language_model(counts: np.ndarray, trust: float = 4.0) -> np.ndarray:
    """Cost in nats of a symbol after three others: an array of SYMBOLS^4. ``trust`` is the weight of the lower order in counts."""
    n = counts.reshape((SYMBOLS,) * ORDER).astype(float)
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for order in range(1, ORDER + 1):
        c = n.sum(axis=tuple(range(ORDER - order)))
        p = (c + trust * p) / (c.sum(axis=-1, keepdims=True) + trust)
    return -np.log(p).reshape(-1)


class Restorer:
    """Viterbi decoding of disguised spans."""

    def __init__(self, cost: np.ndarray, remembered: int = 200_000) -> None:
        self.cost = cost.tolist()
        self.decode = functools.lru_cache(remembered)(self._decode)

    def options(self, span: str) -> list[list[tuple[str, float]]]:
        """For each character of a span what it may stand for ('' nothing, ' ' a bound) and at which cost."""
        out = []
        for k, c in enumerate(span):
            before = span[k - 1] if k else ""
            if c in LEET:
                choices = [(x, SIGN) for x in LEET[c]] + [(" ", SIGN_BOUND)]
            elif "a" <= c <= "z":
                choices = [(c, 0.0)]
            else:
                choices = [("", DROPPED), (" ", SEPARATED)]
            if c == before and c not in SEPARATORS:
                choices = [(x, w + KEPT_REPEAT) for x, w in choices] + [("", REPEATED + choices[0][1])]
            out.append(choices)
        return out

    def _decode(self, span: str) -> str:
        """The likeliest restored text of a lower-case span between bounds."""
        cost = self.cost
        states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        for choices in self.options(span):
            new: dict[int, tuple[float, tuple | None]] = {}
            for past, (total, way) in states.items():
                for text, price in choices:
                    if not text:
                        to, worth, road = past, total + price, way
                    else:
                        symbol = 0 if text == " " else ord(text) - 96
                        if symbol == 0 and past % SYMBOLS == 0:
                            to, worth, road = past, total + price, way  # bounds run together
                        else:
                            to = past * SYMBOLS + symbol
                            worth, road = total + price + cost[to], (way, text)
                            to %= SYMBOLS ** (ORDER - 1)
                    if to not in new or worth < new[to][0]:
                        new[to] = worth, road
            states = new
        ends = [(total + (cost[past * SYMBOLS] if past % SYMBOLS else 0.0), k, way) for k, (past, (total, way)) in enumerate(states.items())]
        way, letters = min(ends, key=lambda e: e[:2])[2], []
        while way is not None:
            way, text = way
            letters.append(text)
        return "".join(reversed(letters)).strip()

    def restore(self, text: bytes) -> bytes:
        """The lower-cased text (A-Z) with its disguised spans restored."""

        def restored(found: re.Match) -> bytes:
            span = found[0]
            if not re.search(rb"[a-z]", span):
                return span
            return self.decode(span.decode("ascii")).encode()

        return SUSPECT.sub(restored, text.lower())

    def restore_all(self, texts: list[bytes]) -> list[bytes]:
        flagged = may_be_disguised(texts)
        return [self.restore(t) if f else t.lower() for t, f in zip(texts, flagged.tolist(), strict=True)]


def _class_of(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters.encode())] = True
    return out


_LETTER, _SIGN, _BANG, _APART, _MARK = (_class_of(x) for x in ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789@$|+", "!", SEPARATORS, SEPARATORS.replace(" ", "")))


def may_be_disguised(texts: list[bytes]) -> np.ndarray:
    """False for texts in which ``SUSPECT`` finds nothing, from neighbouring characters alone."""
    data = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n" * 6, np.uint8)
    size = len(data) - 6
    at = lambda x, k: x[k : k + size]
    letter, sign, bang, apart, mark = _LETTER[data], _SIGN[data], _BANG[data], _APART[data], _MARK[data]
    piece = letter | sign | bang
    same = np.append(letter[:-1] & ((data[:-1] | 32) == (data[1:] | 32)), False)
    among = at(letter | bang, 0) & at(sign, 1) | at(sign, 0) & at(letter | bang, 1) | at(bang, 0) & at(letter, 1)
    single = ~at(piece, 0) & at(piece, 1) & at(apart, 2) & at(piece, 3) & at(apart, 4) & at(piece, 5) & ~at(piece, 6)
    pieces = at(mark, 0) & at(piece, 1) & (at(mark, 2) | at(piece, 2) & at(mark, 3))
    again = at(same, 0) & at(same, 1) | at(same, 0) & at(same, 2) & at(same, 4)
    ends = np.cumsum([len(t) + 1 for t in texts])
    out = np.zeros(len(texts) + 1, bool)
    out[np.searchsorted(ends, np.flatnonzero(among | single | pieces | again), "right")] = True
    return out[:-1]


#: A text has a feature at level 0, 1, 2 if it holds it so often.
LEVELS = (1, 2, 4)
#: Longer words count by their beginnings alone.
WORD = 10


def bases_of(texts: list[bytes], among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words and beginnings of restored texts: the text's place, the hash (its last two bits zero) and how often it stands there, once each.

    With ``among`` (a table of 2^20 flags by the hash's next bits) others may be left out.
    """
    found = terms_of(texts, LETTER_TERMS)
    sizes = found.ends - found.begins
    sums = Hashes(BYTES[np.frombuffer(found.data, np.uint8)], POWERS[0])
    text, keys = [], []
    for n in (0, 3, 4, 5, 6, 7, 8):
        fine = np.flatnonzero(sizes > n if n else sizes <= WORD)
        hashes = found.hashes[fine] if not n else mix(sums.of(found.begins[fine], found.begins[fine] + n))  # a beginning is no word
        hashes = hashes & ~np.uint64(3)
        if among is not None:
            known = among[(hashes >> np.uint64(2)) & np.uint64((1 << 20) - 1)]
            fine, hashes = fine[known], hashes[known]
        text.append(found.text[fine])
        keys.append(hashes)
    rows, hashes = np.concatenate(text), np.concatenate(keys)
    order = np.argsort(hashes, kind="stable")
    order = order[np.argsort(rows[order], kind="stable")]
    rows, hashes = rows[order], hashes[order]
    first = run_starts(rows, hashes)
    return rows[first], hashes[first], np.diff(np.append(first, len(rows)))


class Known:
    """Finds the features that a model has; ``keys`` are sorted, a hash plus its level each."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.among = np.zeros(1 << 20, bool)
        self.among[(keys >> np.uint64(2)) & np.uint64((1 << 20) - 1)] = True

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Each text's place and the place of each of its features in ``keys``."""
        rows, hashes, times = bases_of(texts, self.among)
        place, at = [], []
        for level, least in enumerate(LEVELS):
            often = times >= least
            keys = hashes[often] + np.uint64(level)
            found = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
            hit = self.keys[found] == keys if len(self.keys) else np.zeros(len(keys), bool)
            place.append(rows[often][hit])
            at.append(found[hit])
        place, at = np.concatenate(place), np.concatenate(at)
        order = np.argsort(place, kind="stable")
        return place[order], at[order]


def train_language_model(texts: DataFrame) -> np.ndarray:
    """The language model of all ``texts`` (a column ``text``)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**ORDER, np.int64)
        for _, block in text_blocks(batches, 1 << 20):
            total += gram_counts(block)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], names=["gram", "n"])

    table = arrow(texts.select("text"), count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SYMBOLS**ORDER, np.int64)
    counts[table.column(0).to_numpy()] = table.column(1).to_numpy()
    return language_model(counts)


def _labelled(docs: DataFrame, labels: DataFrame, label: str, max_labelled: int) -> DataFrame:
    """``y`` and ``text`` of labelled rows that are not held out; a share of them by hash if there are more than ``max_labelled``."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).select(F.col("doc_id").alias("label_id"), F.col(label).cast("long").alias("y")).where(~held_out(F.col("label_id")))
    n = marked.count()
    if n > max_labelled:
        share = 1 << 20
        marked = marked.where(F.pmod(F.xxhash64("label_id"), F.lit(share)) < F.lit(int(share * max_labelled / n)))
    # About max_labelled ids, so that no text is shuffled.
    return docs.join(F.broadcast(marked), F.col("doc_id") == F.col("label_id")).select("y", "text")


def _feature_counts(labelled: DataFrame, held: int = 300_000) -> DataFrame:
    """``key`` (a hash and its level), ``a`` and ``b``: labelled rows of class 0 and 1 that have the feature. A task sums ``held`` keys before it sends them."""
    names = [f"{c}{k}" for k in range(len(LEVELS)) for c in "ab"]

    def sent(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        hashes, *counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(hashes, kind="stable")
        first = run_starts(hashes[order])
        sums = [np.add.reduceat(c[order], first) for c in counts]
        return pa.RecordBatch.from_arrays([pa.array(hashes[order][first].view(np.int64)), *(pa.array(c, pa.int64()) for c in sums)], names=["hash", *names])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for rows, texts in text_blocks(batches, 1 << 20):
            y = np.array([r[0] for r in rows], np.int64)
            text, hashes, times = bases_of(texts)
            y = y[text]
            parts.append((hashes, *((times >= n) & (y == c) for n in LEVELS for c in (0, 1))))
            parts[-1] = (hashes, *(x.astype(np.int64) for x in parts[-1][1:]))
            size += len(hashes)
            if size >= held:
                yield sent(parts)
                parts, size = [], 0
        if parts:
            yield sent(parts)

    rows = arrow(labelled.select("y", "text"), count, "hash long, " + ", ".join(f"{n} long" for n in names))
    sums = rows.groupBy("hash").agg(*[F.sum(n).alias(n) for n in names])
    levels = F.array(*[F.struct((F.col("hash") + k).alias("key"), F.col(f"a{k}").alias("a"), F.col(f"b{k}").alias("b")) for k in range(len(LEVELS))])
    return sums.select(F.explode(levels).alias("x")).select("x.*")


def train(docs: DataFrame, labels: DataFrame, label: str, max_labelled: int, max_features: int, remembered: int, min_documents: int = 3, min_z: float = 2.5, min_odds: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """The language model, the features (sorted keys), their weights and the intercept."""
    from pyspark.ml.classification import LogisticRegression  # here, as workers that only score need none of it
    from pyspark.ml.feature import CountVectorizerModel

    spark = docs.sparkSession
    model = train_language_model(docs.where(~held_out(F.col("doc_id"))))
    sent = spark.sparkContext.broadcast(model)

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(sent.value, remembered)
        for rows, texts in text_blocks(batches, 1 << 20):
            restored = pa.array(restorer.restore_all(texts), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), restored], names=["y", "text"])

    labelled = written(arrow(_labelled(docs, labels, label, max_labelled), restore, "y long, text string"))
    head = labelled.agg(F.sum("y"), F.count(F.lit(1))).first()
    n, n1 = head[1], head[0] or 0
    n0 = n - n1
    nothing = np.zeros(0, np.uint64), np.zeros(0)
    base = math.log((n1 + 0.5) / (n0 + 0.5))
    if not n1 or not n0:
        return model, *nothing, base
    a, b = F.col("a"), F.col("b")
    odds = F.log((b + 0.5) / (n1 + 1.0)) - F.log((a + 0.5) / (n0 + 1.0))
    z = F.abs(odds) / F.sqrt(1 / (b + 0.5) + 1 / (a + 0.5))
    strong = _feature_counts(labelled).where((a + b >= min_documents) & (F.abs(odds) >= min_odds) & (z >= min_z)).select("key", F.floor(64 * z).alias("z"))
    keys = np.array([r["key"] for r in most_frequent(written(strong), "z", max_features).toLocalIterator()], np.int64).view(np.uint64)
    if not len(keys):
        return model, *nothing, base
    known = spark.sparkContext.broadcast(Known(np.sort(keys)))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_blocks(batches, 1 << 20):
            place, at = known.value.of(texts)
            offsets = np.searchsorted(place, np.arange(len(texts) + 1))
            words = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(at).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([float(r[0]) for r in rows]), words], names=["label", "words"])

    points = written(arrow(labelled, extract, "label double, words array<string>"))
    vectors = CountVectorizerModel.from_vocabulary([str(k) for k in range(len(keys))], "words", "features").setBinary(True)
    # A few features for each of at most max_labelled rows: few tasks, each of which sends one gradient a step.
    fitted = LogisticRegression(maxIter=60, regParam=0.5 / n, standardization=False).fit(vectors.transform(points.coalesce(4)).select("label", "features"))
    return model, known.value.keys, fitted.coefficients.toArray(), float(fitted.intercept)


@any_columns
def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_labelled: int = 50_000, max_features: int = 20_000, remembered: int = 200_000, **parameters) -> DataFrame:
    """``docs`` without its text plus ``held_out`` and ``score``, the probability that the label is 1."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(train(docs, labels, label, max_labelled, max_features, remembered, **parameters))
    names = [c for c in docs.columns if c != "text"]

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, keys, weights, intercept = sent.value
        restorer, known = Restorer(model, remembered), Known(keys)
        for batch in batches:
            out: list[np.ndarray] = []
            for _, texts in text_blocks(iter([batch.select([batch.num_columns - 1])]), 1 << 20):
                place, at = known.of(restorer.restore_all(texts))
                sums = intercept + np.bincount(place, weights[at], len(texts))
                out.append(1 / (1 + np.exp(-np.clip(sums, -30, 30))))
            scores = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores)], names=[*batch.schema.names[:-1], "score"])

    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField("score", T.DoubleType())])
    rated = arrow(docs.select(*names, "text"), rate, schema)
    return rated.select(*names, held_out(F.col("doc_id")).alias("held_out"), "score")
