"""The training-data queries: thin digests over the operators, on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, divergence, host_classifier, lexical_search, licenses, mixing, near_duplicates, quality_rules, repeats, suffix_tree, token_counts, toxicity
from .common import table

SHARDS = 40
#: Tokens above which a document is over the limit.
TOKEN_LIMIT = 2048
#: Score from which a document is predicted toxic.
TOXIC = 0.7
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates.near_duplicate_classes(docs).select("doc_id", "class_id")


def op2_line_frequency_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_lines", "words_left")


def op3_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = host_classifier.classify(docs, table(spark, sf_dir, "labels"))
    low, toxic = F.col("quality_probability") < 0.5, F.col("toxic_probability") >= 0.5
    return out.select("doc_id", "quality_probability", "toxic_probability", "quality_path_rate", "toxic_path_rate", low.alias("low_quality"), toxic.alias("toxic"), (~low & ~toxic).alias("kept"))


def op4_suffix_tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.contamination(decontaminate.benchmark_hits(docs, table(spark, sf_dir, "benchmark")))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op7_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text", (F.octet_length(data) + 16).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    out = mixing.stratified_shards(docs, SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_sentences", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


def op9_fair_queue_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.fair_queue_mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op10_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words")


def op11_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = lexical_search.ranked_search(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return out.select("item_id", "rank", "doc_id", "score")


def op12_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence_audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_near_duplicates,
        op2_line_frequency_quality,
        op3_host_quality,
        op4_suffix_tree_score,
        op5_decontaminate,
        op6_token_counts,
        op7_stratified_shards,
        op8_license_scan,
        op9_fair_queue_mix,
        op10_remove_repeats,
        op11_block_max_search,
        op12_noisy_channel_toxicity,
        op13_source_divergence,
    )
}

WORDS_SQL = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

QUALITY_SQL = rf"""
with d as (select row_number() over () as row_id, doc_id, source, coalesce(text, '') as text from documents),
s as (select *, {WORDS_SQL} as words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
begins as (select row_id, words, unnest(range(1, greatest(len(words) - 3, 1))) as p from s),
win as (select row_id, p, words[p:p + 4] as w from begins),
again as (select row_id, p from (select *, count(*) over (partition by row_id, w) as n from win) where n > 1),
covered as (select row_id, count(distinct q) as n from (select row_id, unnest(range(p, p + 5)) as q from again) group by row_id),
paged as (select s.*, dense_rank() over (order by source, text) as page from s),
line as (select page, source, trim(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') as x from (select page, source, unnest(lines) as x from (select distinct page, source, lines from paged))),
per_page as (select page, source, x, count(*) as n, any_value(len(string_split(x, ' '))) as w from line group by page, source, x),
hosts as (select source, count(distinct page) as host_documents from paged group by source),
counted as (select source, x, count(*) as documents from per_page group by source, x having count(*) > 10),
frequent as (select c.source, c.x from counted c join hosts h on c.source is not distinct from h.source where c.documents > h.host_documents * 0.01),
cut as (select page, sum(n) as lines_cut, sum(n * w) as words_cut from per_page p join frequent f on p.source is not distinct from f.source and p.x = f.x group by page),
verdict as (
  select doc_id, cast(len(words) as bigint) as n_words, cast(length(array_to_string(words, '')) as bigint) as word_chars,
    cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
    cast(coalesce(covered.n, 0) as bigint) as n_repeat_words, cast(coalesce(lines_cut, 0) as bigint) as removed_lines, cast(len(words) - coalesce(words_cut, 0) as bigint) as words_left
  from paged left join covered using (row_id) left join cut using (page))
select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words or words_left < 10 or words_left < n_words * 0.3) as kept
from verdict"""

LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SEARCH_SQL = rf"""
with docs as (select row_number() over () as row_id, doc_id, regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
sized as (select row_id, doc_id, len(terms) as n from docs where len(terms) > 0),
corpus as (select count(*) as n_docs, cast(sum(n) as bigint) as n_terms from sized),
tf as (select row_id, term, count(*) as tf from (select row_id, unnest(terms) as term from docs) group by row_id, term),
df as (select term, count(*) as df from tf group by term),
items as (select row_number() over () as item_row, item_id, list_distinct(regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as terms from benchmark),
asked as (select item_row, item_id, unnest(terms) as term from items),
weighed as (select item_row, item_id, term, cast(floor(1000 * ln(cast(2 * n_docs + 2 as double) / cast(2 * df + 1 as double))) as bigint) as w from asked join df using (term), corpus),
scored as (
  select item_row, item_id, row_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms)))) as bigint) as score
  from weighed join tf using (term) join sized using (row_id), corpus group by item_row, item_id, row_id, doc_id),
ranked as (select item_id, doc_id, score, row_number() over (partition by item_row order by score desc, doc_id nulls last) as rank from scored where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from ranked where rank <= 50"""

DIVERGENCE_SQL = rf"""
with d as (select row_number() over () as row_id, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all({LOWER_SQL}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
words as (select row_id, lang, source, unnest(terms) as term from d),
kept as (select lang, term, count(*) as lang_n from words group by lang, term having count(distinct row_id) >= 30),
voc as (select lang, count(*) as v, cast(sum(lang_n) as hugeint) as total from kept group by lang),
tf as (select lang, source, term, count(*) as n from words join kept using (lang, term) group by lang, source, term),
grp as (select g.lang, g.source, coalesce(sum(n), 0) as total from (select distinct lang, source from d) g left join tf on g.lang = tf.lang and g.source = tf.source group by g.lang, g.source),
share as (
  select g.lang, g.source, k.term, coalesce(n, 0) as n, 1 + (1000000000 * (coalesce(n, 0) + 5)::hugeint) // (g.total + 5 * v) as p, 1 + (1000000000 * (lang_n + 5)::hugeint) // (voc.total + 5 * v) as q
  from grp g join kept k on g.lang = k.lang join voc on voc.lang = g.lang left join tf on tf.lang = g.lang and tf.source = g.source and tf.term = k.term),
apart as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from share a join share b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source),
rows_ as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value from grp a join grp b on a.lang = b.lang and a.source <> b.source left join apart x on x.lang = a.lang and x.source = a.source and x.item = b.source
  union all select lang, source, 'term', term, p - q from share where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from rows_)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank from ranked where part = 'pair' or rank <= 50"""

ORACLE_SQL: dict[str, str] = {"op2_line_frequency_quality": QUALITY_SQL, "op11_block_max_search": SEARCH_SQL, "op13_source_divergence": DIVERGENCE_SQL}

