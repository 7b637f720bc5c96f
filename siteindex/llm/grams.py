"""Hashes of n-grams, the same in numpy and in Spark, and filters of such hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _xxhash(x: np.ndarray, seed: np.ndarray | np.uint64) -> np.ndarray:
    """XXH64 of 8 bytes."""
    p1, p2, p3, p4, p5 = (np.uint64(v) for v in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    h = (seed + p5 + np.uint64(8)) ^ (_rotated(x * p2, 31) * p1)
    h = _rotated(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the n-gram whose first and last (n-1)-grams are a and b: ``xxhash64(a, b)``."""
    with np.errstate(over="ignore"):
        return _xxhash(b, _xxhash(a, np.uint64(42)))


def grams(tokens: np.ndarray, starts: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 1, ..., most: positions at which an n-gram of one text ends, and a hash for each position."""
    positions = np.arange(len(tokens))
    whole = tokens
    for n in range(1, most + 1):
        if n > 1:
            longer = np.empty_like(whole)
            longer[:1] = 0
            longer[1:] = joined(whole[:-1], whole[1:])
            whole = longer
        yield positions[positions - starts >= n - 1], whole


class Filter:
    """A Bloom filter of 64-bit keys, two bits each."""

    def __init__(self, keys: DataFrame, bits: int) -> None:
        words = bits // 64
        spots = F.array(F.pmod("key", F.lit(bits)), F.pmod(F.xxhash64("key"), F.lit(bits)))
        spot = keys.select(F.explode(spots).alias("spot")).select(F.floor(F.col("spot") / 64).alias("word"), F.expr("shiftleft(1L, cast(spot % 64 as int))").alias("bit"))
        found = spot.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
        self.bits = bits
        self.words = np.zeros(words, np.int64)
        self.words[found.column(0).to_numpy()] = found.column(1).to_numpy()

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """False only for keys that were not put in; ``keys`` are unsigned."""
        signed = keys.view(np.int64)
        out = self._bit(np.mod(signed, self.bits))
        at = np.flatnonzero(out)
        out[at] = self._bit(np.mod(_xxhash(keys[at], np.uint64(42)).view(np.int64), self.bits))
        return out

    def _bit(self, spot: np.ndarray) -> np.ndarray:
        return (self.words[spot >> 6] >> (spot & 63) & 1).astype(bool)
