"""Quality rules from word statistics and cross-document line frequency (native).

A line that more than ``min_documents`` distinct documents of a host contain, and more
than ``max_host_share`` of the host's documents, is site furniture: it is removed, and a
document left with too little is rejected. Everything is DataFrame functions; no Python
runs on executors, and no shuffle carries a text: statistics and line hashes are written
once, lines are counted and met by (host, line), and what a document loses comes back
under the hash of its host and text.

Defined cases: null or blank text has no words and fails the base rules; a null host is
a host of its own; documents of one host and equal text are one document for the counts,
so that copies alone make no line frequent; a line repeated inside one document counts
once for frequency but every occurrence is removed; exact ties with a limit are not
above it; rows that repeat stay rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import written
from .common import BLANKS, any_columns, words_of


def _lines(text: Column) -> Column:
    """(hash of the normalised line, its words) for each line that has a word."""
    raw = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    plain = F.transform(raw, lambda x: F.btrim(F.regexp_replace(F.lower(x), BLANKS, " ")))
    return F.transform(plain, lambda x: F.struct(F.xxhash64(x).alias("h"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("w")))


def _host_key(host: Column) -> Column:
    return F.coalesce(F.concat(F.lit("h:"), host), F.lit("null"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 5-word window found twice or more.

    Windows are compared by hash. Only a text with a repeated window sorts them; the
    covered words are then the union of the repeated windows' intervals.
    """
    at = lambda i: F.get(words, i)
    starts = F.slice(words, 1, F.greatest(F.size(words) - 4, F.lit(0)))
    windows = F.transform(starts, lambda w, i: F.xxhash64(w, at(i + 1), at(i + 2), at(i + 3), at(i + 4)))

    def covered(ordered: Column) -> Column:
        same = lambda i, x: F.coalesce(F.get(ordered, i)["h"] == x["h"], F.lit(False))
        marked = F.transform(ordered, lambda x, i: F.when(same(i - 1, x) | same(i + 1, x), x["i"]))
        starts = F.array_sort(F.filter(marked, lambda i: i.isNotNull()))
        state = F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last"))
        return F.aggregate(starts, state, lambda a, p: F.struct((a["n"] + F.least(F.lit(5), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])

    def count(found: Column) -> Column:
        placed = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0)).otherwise(_let(placed, covered))

    return _let(windows, count)


def word_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and line structs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lined = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    by_word = _let(
        words_of(F.col("text")),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeat_words(w).cast("long").alias("n_repeat_words")),
    )
    by_line = _let(lined, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    symbols = F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long")
    counted = docs.withColumns({"by_word_": by_word, "n_symbols": symbols, "n_dup_lines": by_line, "lines": _lines(F.col("text"))})
    return counted.withColumns({c: F.col("by_word_")[c] for c in ("n_words", "word_chars", "n_repeat_words")}).drop("by_word_")


def _page(host: Column) -> Column:
    """Key of a host's text: documents that share it are one document."""
    return F.xxhash64(_host_key(host), F.coalesce(F.col("text"), F.lit("")))


def document_lines(paged: DataFrame) -> DataFrame:
    """``page``, ``host_key``, ``h``, ``w`` (words), ``n`` (occurrences): each distinct line of each distinct document."""
    each = paged.select("page", "host_key", F.posexplode("lines").alias("at", "line"))
    return each.groupBy("page", "host_key", F.col("line.h").alias("h")).agg(F.max("line.w").alias("w"), F.size(F.collect_set("at")).alias("n"))


def frequent_lines(lines: DataFrame, hosts: DataFrame, max_host_share: float, min_documents: int) -> DataFrame:
    """``host_key``, ``h`` of the lines above both limits; ``hosts`` has host_key and host_documents."""
    counted = lines.groupBy("host_key", "h").agg(F.count(F.lit(1)).alias("documents")).where(F.col("documents") > min_documents)
    return counted.join(hosts, "host_key").where(F.col("documents") > F.col("host_documents") * F.lit(max_host_share)).select("host_key", "h")


def _lines_and_frequent(paged: DataFrame, max_host_share: float, min_documents: int) -> tuple[DataFrame, DataFrame]:
    lines = written(document_lines(paged))
    hosts = written(paged.select("host_key", "page").distinct().groupBy("host_key").agg(F.count(F.lit(1)).alias("host_documents")))
    return lines, written(frequent_lines(lines, hosts, max_host_share, min_documents))


@any_columns
def quality_rules(docs: DataFrame, host: str = "source", max_host_share: float = 0.01, min_documents: int = 10, min_words: int = 10, min_left_share: float = 0.3) -> DataFrame:
    """``docs`` without its text, plus page, statistics and verdicts: base_failed, removed_lines, words_left, kept.

    A document is depleted when the lines below the limits leave it fewer than
    ``min_words`` words or less than ``min_left_share`` of its words. ``text_left`` is not
    built here; see ``without_frequent_lines``.
    """
    keyed = docs.withColumns({"host_key": _host_key(F.col(host)), "page": _page(F.col(host))})
    stats = written(word_statistics(keyed).drop("text"))
    lines, frequent = _lines_and_frequent(stats, max_host_share, min_documents)
    met = lines.join(frequent, ["host_key", "h"])
    # Written, so that the join of a page that many rows share can be split.
    cut = written(met.groupBy("page").agg(F.sum("n").cast("long").alias("cut_lines"), F.sum(F.col("n") * F.col("w")).cast("long").alias("cut_words")))
    none = F.lit(0).cast("long")
    joined = stats.join(cut, "page", "left").withColumns({"removed_lines": F.coalesce("cut_lines", none), "words_left": F.col("n_words") - F.coalesce("cut_words", none)})
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    depleted = (F.col("words_left") < min_words) | (F.col("words_left") < F.col("n_words") * F.lit(min_left_share))
    return joined.withColumn("base_failed", base).withColumn("kept", ~(base | depleted)).drop("lines", "host_key", "cut_lines", "cut_words")


def accepted(docs: DataFrame, host: str = "source", **parameters) -> DataFrame:
    """The rows of ``docs``, whole, that ``quality_rules`` keeps."""
    kept = quality_rules(docs.select(*dict.fromkeys([host, "text"])), host, **parameters).where("kept").select(F.col("page").alias("page_")).distinct()
    return docs.withColumn("page_", _page(F.col(host))).join(written(kept), "page_", "left_semi").select(docs.columns)


def without_frequent_lines(docs: DataFrame, host: str = "source", max_host_share: float = 0.01, min_documents: int = 10) -> DataFrame:
    """``docs`` whose texts have lost the lines above the limits of their host."""
    keyed = docs.withColumns({"host_key": _host_key(F.col(host)), "page": _page(F.col(host))})
    lines, frequent = _lines_and_frequent(keyed.select("host_key", "page", _lines(F.col("text")).alias("lines")), max_host_share, min_documents)
    cut = written(lines.join(frequent, ["host_key", "h"]).groupBy("page").agg(F.collect_set("h").alias("cut")))
    plain = lambda x: F.xxhash64(F.btrim(F.regexp_replace(F.lower(x), BLANKS, " ")))
    kept = F.array_join(F.filter(F.split(F.col("text"), "\n"), lambda x: ~F.array_contains("cut", plain(x))), "\n")
    return keyed.join(cut, "page", "left").withColumn("text", F.when(F.col("cut").isNull(), F.col("text")).otherwise(kept)).select(docs.columns)
