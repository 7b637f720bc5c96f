"""Token counts: pieces once per distinct pre-token, joined to documents' pre-token counts.

1. One pass splits every text into pre-tokens and counts them over the corpus.
2. The library counts the pieces of each distinct pre-token once.
3. A second pass turns each text into pre-token counts. The most frequent pre-tokens
   (a fixed number of bounded length) are joined from a broadcast table, all others by
   a shuffle join on their hash, and documents sum what they get. No token id is made.

Defined cases: null text is empty (0 tokens); special strings inside a text count as
the library counts them by default, one token each; rows with equal ids stay rows.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lineage import written
from .common import any_columns, arrow, most_frequent

#: White space as the tokenizer's own regular expressions see it. Fixed values.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The tokenizer file's split pattern, with that white space. Fixed values.
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"
#: Strings that the tokenizer file declares special. Fixed values.
SPECIAL = r"<\|startoftext\|>|<\|endoftext\|>"


#: What a tokenizer file must say for the split above to be its own. Fixed values.
EXPECTED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}
SPECIALS = {"<|startoftext|>", "<|endoftext|>"}


def check_file(path: str) -> None:
    """An error if a tokenizer file splits texts in another way than this operator."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    wrong = [k for k, v in EXPECTED.items() if said.get(k) != v]
    added = said.get("added_tokens") or []
    if {t["content"] for t in added} != SPECIALS or any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        wrong.append("added_tokens")
    if wrong:
        raise ValueError(f"{path} has another {', '.join(wrong)} than this operator splits by")


@lru_cache(maxsize=2)
def _library(path: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
_ANY = regex.compile(PIECES)
_SPECIAL = re.compile(SPECIAL)
#: Above these code points the library itself normalises and splits.
_PLAIN = re.compile("[^\\x00-ɏ‐-‧€]")


def _pretokens(text: str, path: str) -> list[str]:
    """Pre-tokens of a text without special strings, as the tokenizer file defines them."""
    if text.isascii():
        return _ASCII.findall(text.lower())
    if not _PLAIN.search(text):
        return _ANY.findall(unicodedata.normalize("NFC", text).lower())
    tok = _library(path)
    plain = tok.normalizer.normalize_str(text)
    return [plain[a:b] for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(plain)]


def split_text(text: str | None, path: str) -> tuple[Counter, int]:
    """Pre-token counts of a text, and how many special strings it holds."""
    if not text:
        return Counter(), 0
    if "<|" not in text:
        return Counter(_pretokens(text, path)), 0
    parts = _SPECIAL.split(text)
    counts: Counter = Counter()
    for part in parts:
        counts.update(_pretokens(part, path))
    return counts, len(parts) - 1


def _key(piece: str) -> int:
    return xxhash.xxh64_intdigest(piece.encode()) - (1 << 63)


def distinct_pretokens(docs: DataFrame, path: str) -> DataFrame:
    """``piece``, ``n``: every pre-token of the corpus and how often it occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                held.update(split_text(text.as_py(), path)[0])
                if len(held) > 400_000:
                    yield pa.RecordBatch.from_pydict({"piece": list(held), "n": list(held.values())})
                    held = Counter()
        yield pa.RecordBatch.from_pydict({"piece": pa.array(held, pa.string()), "n": pa.array(held.values(), pa.int64())})

    return arrow(docs.select("text"), count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def piece_counts(pretokens: DataFrame, path: str) -> DataFrame:
    """``pretokens`` with ``key`` and ``pieces``: tokens that the library makes of each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _library(path)
        for batch in batches:
            names = batch.column(0).to_pylist()
            sizes = [len(tok.encode(x, add_special_tokens=False)) for x in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([_key(x) for x in names], pa.int64()), pa.array(sizes, pa.int32())], names=["piece", "n", "key", "pieces"])

    return arrow(pretokens.select("piece", "n"), count, "piece string, n long, key long, pieces int")


@any_columns
def token_counts(docs: DataFrame, path: str, hot_entries: int = 400_000, hot_chars: int = 40) -> DataFrame:
    """``docs`` without its text, plus n_bytes and n_tokens.

    Up to ``hot_entries`` pre-tokens of up to ``hot_chars`` characters form the broadcast
    table: at most 16 million characters whatever the corpus.
    """
    check_file(path)
    spark = docs.sparkSession
    pieces = written(piece_counts(distinct_pretokens(docs, path), path))
    hot = most_frequent(pieces.where(F.length("piece") <= hot_chars), "n", hot_entries)
    known = spark.sparkContext.broadcast({r["piece"]: r["pieces"] for r in hot.select("piece", "pieces").toLocalIterator()})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.value.get
        for batch in batches:
            totals, keys, times, sizes = [], [], [], []
            for text in batch.column(batch.num_columns - 1):
                text = text.as_py()
                counts, special = split_text(text, path)
                total, ks, ns = special, [], []
                for piece, n in counts.items():
                    if (size := get(piece)) is not None:
                        total += n * size
                    else:
                        ks.append(_key(piece))
                        ns.append(n)
                totals.append(total)
                keys.append(ks)
                times.append(ns)
                sizes.append(len(text.encode()) if text else 0)
            extra = [pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "n_bytes", "hot_tokens", "rare_keys", "rare_times"])

    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL("n_bytes bigint, hot_tokens bigint, rare_keys array<bigint>, rare_times array<int>").fields])
    names = [c for c in docs.columns if c != "text"]
    ordered = T.StructType([*(docs.schema[c] for c in names), docs.schema["text"], *schema.fields[len(docs.columns) :]])
    split = arrow(docs.select(*names, "text"), count, ordered).drop("text").withColumn("row_id", F.monotonically_increasing_id())
    base = written(split)
    rare = base.select("row_id", F.explode(F.arrays_zip("rare_keys", "rare_times")).alias("r")).select("row_id", F.col("r.rare_keys").alias("key"), F.col("r.rare_times").alias("times"))
    sums = rare.join(pieces.select("key", "pieces"), "key").groupBy("row_id").agg(F.sum(F.col("times") * F.col("pieces")).alias("rare_tokens"))
    out = base.join(sums, "row_id", "left").withColumn("n_tokens", F.col("hot_tokens") + F.coalesce("rare_tokens", F.lit(0)))
    return out.select(*names, "n_bytes", F.col("n_tokens").cast("long").alias("n_tokens"))
