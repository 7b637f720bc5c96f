"""Helpers shared by the training-data operators: inputs, the shared folder, words."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .. import ship

#: One or more of space, tab, newline, vertical tab, form feed, carriage return.
BLANKS = r"[ \t\n\x0B\f\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` with this package at hand on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up), 1 << 16)
            for name, base in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                p = np.full(n, np.uint64(base))
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def upto(self, n: int) -> np.ndarray:
        self._grow(n)
        return self.up[:n]

    def inverses(self, n: int) -> np.ndarray:
        self._grow(n)
        return self.down[:n]

    def inverse(self, at: np.ndarray) -> np.ndarray:
        self._grow(int(at.max(initial=0)) + 1)
        return self.down[at]


class Hashes:
    """Hashes of any stretch of an array of 64-bit symbols."""

    def __init__(self, symbols: np.ndarray, powers: Powers) -> None:
        self.powers = powers
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * powers.upto(len(symbols)), out=self.sums[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.powers.inverse(a) + (b - a).astype(np.uint64))

    def each(self, width: int) -> np.ndarray:
        """Hashes of all stretches of ``width`` symbols, those of ``of``."""
        sums = self.sums[width:] - self.sums[: len(self.sums) - width]
        return mix(sums * self.powers.inverses(len(sums)) + np.uint64(width))


#: Values of the 256 bytes as symbols.
BYTES = np.random.default_rng(505).integers(0, 1 << 64, 256, np.uint64)
POWERS = (Powers(0x9E3779B97F4A7C15), Powers(0xD6E8FEB86659FD93))


_BLANK = np.zeros(256, np.int8)
_BLANK[[9, 10, 11, 12, 13, 32]] = 1


def word_hashes(text: bytes) -> np.ndarray:
    """One hash for each word of a text (white space separates words)."""
    return block_word_hashes(text)[2]


def block_word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word of a text begins and ends, and its hash; several texts can be one, apart by white space."""
    data = np.frombuffer(text, np.uint8)
    # Words begin and end where blank turns to not blank and back.
    edges = np.flatnonzero(np.diff(_BLANK[data], prepend=np.int8(1), append=np.int8(1)))
    begin, end = edges[::2], edges[1::2]
    return begin, end, Hashes(BYTES[data], POWERS[0]).of(begin, end)


def words_of_rows(at: np.ndarray, data: np.ndarray, block: int = 1 << 17) -> list[np.ndarray]:
    """``word_hashes`` of each text of a column, given as offsets and bytes, hashed in blocks of whole texts."""
    out: list[np.ndarray] = []
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + block, "right")) - 1)
        part, edges = data[at[i] : at[j]], at[i : j + 1] - at[i]
        word = _BLANK[part] == 0
        # A word begins or ends at blanks and at the edges of its text.
        before, after = np.zeros(len(part), bool), np.zeros(len(part), bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        before[edges[edges < len(part)]] = False
        after[edges[edges > 0] - 1] = False
        begin, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        hashes = Hashes(BYTES[part], POWERS[0]).of(begin, end)
        cuts = np.searchsorted(begin, edges).tolist()
        out += [hashes[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        i = j
    return out


#: Columns of ``documents`` that operators read by name.
READ = ("doc_id", "text", "source", "lang")


def set_apart(docs: DataFrame, keep: tuple[str, ...] = READ) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` whose columns beyond ``keep`` have names that clash with nothing, and their own names."""
    names = {f"own_{i}_": c for i, c in enumerate(docs.columns) if c not in keep}
    back = {c: n for n, c in names.items()}
    return docs.select(*[F.col(f"`{c}`").alias(back.get(c, c)) for c in docs.columns]), names


def any_columns(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Lets an operator take tables with any extra columns; a result column replaces one of its name."""

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **named) -> DataFrame:
        asked = [x for x in (*args, *named.values()) if isinstance(x, str) and x in docs.columns]
        plain, names = set_apart(docs, (*READ, *asked))
        out = operator(plain, *args, **named)
        made = {c for c in out.columns if c not in names}
        return out.select(*[F.col(c).alias(names.get(c, c)) for c in out.columns if names.get(c) not in made])

    return run


def most_frequent(counted: DataFrame, count: str, most: int) -> DataFrame:
    """The rows of the largest counts, as many whole counts as fit ``most`` rows.

    A count is the threshold, found in the histogram of counts, so that no task gathers
    every partition's best rows.
    """
    counts = counted.groupBy(count).agg(F.count(F.lit(1)).alias("rows_"))
    order = W.Window.partitionBy(F.lit(0)).orderBy(F.desc(count))
    least = counts.withColumn("upto", F.sum("rows_").over(order)).where(F.col("upto") <= most).agg(F.min(count)).first()[0]
    return counted.where(F.col(count) >= least) if least is not None else counted.where(F.lit(False))


def words_of(text: Column) -> Column:
    """Whitespace-separated words of a text, natively; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def text_key(doc_id: Column, text: Column) -> Column:
    """Key of a row: rows that repeat both values share it, and null ids have one."""
    return F.xxhash64(doc_id, F.coalesce(text, F.lit("")))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an Arrow string column (nulls count as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return at, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def texts_as_bytes(column: pa.Array) -> Iterator[bytes]:
    """Each text as UTF-8 bytes, one at a time."""
    at, data = utf8(column)
    whole = memoryview(data)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield bytes(whole[a:b])
