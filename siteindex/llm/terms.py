"""Terms of many texts at once: where they stand, in which text, and their hashes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from .common import BYTES, POWERS, Hashes, texts_as_bytes


def folding(in_terms: str) -> bytes:
    """Translation table: A-Z to lower case, ASCII characters that are not ``in_terms`` to a blank."""
    fine = set(in_terms.encode()) | set(range(128, 256))
    lower = [b + 32 if 65 <= b <= 90 else b for b in range(256)]
    return bytes(b if b in fine else 32 for b in lower)


LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Terms of letters and of letters and digits; every character beyond ASCII belongs to a term.
LETTER_TERMS, ALNUM_TERMS = folding(LETTERS), folding(LETTERS + "0123456789")


class Terms(NamedTuple):
    """Terms of a list of texts in order: bytes, begin and end of each term in them, its text's place in the list, its hash."""

    data: bytes
    begins: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    hashes: np.ndarray


def terms_of(texts: list[bytes], table: bytes) -> Terms:
    data = b" ".join(texts).translate(table)
    symbols = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.diff(symbols != 32, prepend=False, append=False))
    begins, ends = edges[::2], edges[1::2]
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    text = np.searchsorted(np.cumsum(sizes), begins, "right")
    return Terms(data, begins, ends, text, Hashes(BYTES[symbols], POWERS[0]).of(begins, ends))


def text_blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[list, list[bytes]]]:
    """Rows of whole texts, about ``block_bytes`` at a time: the other columns' values, and the texts (the last column)."""
    rows: list[tuple] = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        others = [c.to_pylist() for c in batch.columns[:-1]]
        for k, text in enumerate(texts_as_bytes(batch.column(batch.num_columns - 1))):
            rows.append(tuple(c[k] for c in others))
            texts.append(text)
            size += len(text)
            if size >= block_bytes:
                yield rows, texts
                rows, texts, size = [], [], 0
    if texts:
        yield rows, texts


def taken(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``data`` one after the other, and the offset of each and of the end."""
    sizes = ends - begins
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    return data[np.arange(offsets[-1]) + np.repeat(begins - offsets[:-1], sizes)], offsets


def run_starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new run of equal keys begins in sorted arrays."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)
