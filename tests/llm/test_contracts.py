"""The ten queries and the pipeline against plain versions, on small tables with hard rows."""

import itertools
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siteindex.llm import common, decontaminate, grams, host_classifier, licenses, mixing, near_duplicates, quality_rules, queries, repeats, suffix_tree, token_counts

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ("key", "n", "id", "bucket", "uid", "runs", "row_id", "words", "lines", "size", "u", "tie", "kept", "band", "h")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{int(rng.paretovariate(0.6)) % vocabulary}{rng.choice(['', '.', ','])}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [prose(rng, rng.choice([3, 12, 60, 300])) for _ in range(40)]
    passage = prose(rng, 120, 5000)
    out = [(i, t) for i, t in enumerate(base)]
    out += [(100 + i, base[3] if i % 2 else base[5]) for i in range(6)]  # exact copies
    long = prose(rng, 400, 9000)
    out += [(200 + i, long.replace(long.split()[7 * i + 3], f"changed{i}", 1)) for i in range(8)]  # near copies
    out += [(300 + i, prose(rng, 50) + "\n" + passage + "\n" + prose(rng, 40)) for i in range(5)]
    out += [(400, None), (401, ""), (402, " \n\t "), (403, "ab " * 900), (404, "a" * 2000), (405, "line one is here\n" * 30), (406, "É" * 500 + " ß ΑΣ σΣ x")]
    out += [(407, "<|endoftext|> hi <|startoftext|>you're 12 o'clock"), (408, "tab\tsep\x0bwords\x0chere\r\nnext"), (409, base[3]), (409, base[3]), (410, prose(rng, 30000))]
    out += [(411, "x #$% & | <b>\nsame\nsame\n  same")]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    full = [(i, t, "en" if i % 3 else None, None if i % 11 == 0 else f"s{i % 4}", None) for i, t in rows]
    df = spark.createDataFrame(full, SCHEMA).repartition(3)
    for c in EXTRA:
        df = df.withColumn(c, F.lit("own"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_quality_base_counts(docs, rows):
    got = collected(quality_rules.quality_rules(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == sorted(((i, *brute.base_quality(t)) for i, t in rows), key=repr)


def test_frequent_lines_are_removed_and_depleted_documents_rejected(spark):
    body = "these ten words make up the body of page number"
    site = [(i, f"Site menu and links\n{body} {i}", "en", "a", 1) for i in range(30)]
    bare = [(50, "Site menu and links\n" * 5, "en", "a", 1)]
    other = [(60 + i, f"Site menu and links\n{body} {i}", "en", "b", 1) for i in range(10)]
    none = [(80 + i, f"Site menu and links\n{body} {i}", "en", None, 1) for i in range(11)]
    copies = [(100 + i, f"one text of many copies\n{body}", "en", "c", 1) for i in range(40)]
    df = spark.createDataFrame(site + bare + other + none + copies, SCHEMA)
    out = {r["doc_id"]: r for r in quality_rules.quality_rules(df).collect()}
    assert out[3]["removed_lines"] == 1 and out[3]["kept"]
    assert out[50]["removed_lines"] == 5 and not out[50]["kept"]
    assert out[61]["removed_lines"] == 0  # ten documents are not above the limit of ten
    assert out[81]["removed_lines"] == 1  # a null host is a host
    assert out[101]["removed_lines"] == 0 and out[101]["kept"]  # copies are one document
    assert sorted(r["doc_id"] for r in quality_rules.accepted(df).collect()) == sorted(i for i, r in out.items() if r["kept"])
    assert quality_rules.accepted(df).columns == df.columns
    text = {r["doc_id"]: r["text"] for r in quality_rules.without_frequent_lines(df).collect()}
    assert text[3] == f"{body} 3" and text[50] == "" and text[61] == f"Site menu and links\n{body} 1"


def test_share_of_a_host_is_a_limit_too(spark):
    rows = [(i, ("often\n" if i < 30 else "") + f"line {i} of its own", "en", "a", 1) for i in range(300)]
    out = quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA), max_host_share=0.1)
    assert out.where("removed_lines > 0").count() == 0  # 30 of 300 is a tie with a tenth
    out = quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA), max_host_share=0.09)
    assert out.where("removed_lines > 0").count() == 30


def test_quality_rules_equal_their_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    result = con.execute(queries.QUALITY_SQL)
    columns = [d[0] for d in result.description]
    got = queries.op2_line_frequency_quality(spark, sf_dir)
    assert collected(got, *columns) == sorted(result.fetchall(), key=repr)


def test_near_duplicate_classes(docs, rows):
    got = dict(collected(near_duplicates.near_duplicate_classes(docs), "doc_id", "class_id"))
    assert got == brute.near_classes([(i, t) for i, t in rows])


def test_probability_jaccard_weighs_counts():
    import numpy as np

    a = np.array([1] * 80 + [2] * 20, np.uint64)
    b = np.array([1] * 60 + [2] * 20 + [3] * 20, np.uint64)
    x, y = {1: 0.8, 2: 0.2}, {1: 0.6, 2: 0.2, 3: 0.2}
    want = sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in (1, 2, 3)) for d in (1, 2))
    assert near_duplicates.similarity(a, b, power=1) == pytest.approx(want)
    assert near_duplicates.similarity(a, b, power=0) == pytest.approx(2 / 3)


def test_weighted_shingles_tell_texts_of_one_set_apart(spark):
    """Texts of the same shingles in other shares, and bounds that lose no weighted link."""
    rng = random.Random(6)
    base = [f"u{i}" for i in range(60)]
    part = base[10:22]
    texts = [(1, " ".join(base)), (2, " ".join(base + part * 30)), (3, " ".join(base + part * 28)), (4, " ".join(base * 2)), (5, " ".join(base * 3))]
    for k in range(30):  # around one common passage, repeated at different rates
        own = [f"k{k % 6}x{i}" for i in range(90)]
        own[rng.randrange(90)] = f"z{k}"
        texts.append((10 + k, " ".join(own + part * rng.choice([1, 2, 3]))))
    got = dict(collected(near_duplicates.near_duplicate_classes(spark.createDataFrame(texts * 2, "doc_id long, text string"), rows=1), "doc_id", "class_id"))
    assert got == brute.near_classes(texts)
    assert got[2] == got[3] != got[1]


def test_signatures_estimate_probability_jaccard():
    import numpy as np

    rng = np.random.default_rng(1)
    shingles = rng.integers(0, 1 << 63, 100).astype(np.uint64)
    doc = np.repeat([0, 1], 80)
    both = np.concatenate([shingles[:80], shingles[20:]])
    sig = near_duplicates.prob_minhash(doc, both, np.ones(160), 2, 4000)
    assert (sig[0] == sig[1]).mean() == pytest.approx(0.6, abs=0.04)


def test_links_of_a_hot_bucket_are_complete(spark):
    rng = random.Random(2)
    words = [f"v{i}" for i in range(400)]
    texts = []
    for i in range(60):
        own = list(words)
        for k in rng.sample(range(400), 9):
            own[k] = f"c{i}x{k}"
        texts.append((i, " ".join(own)))
    got = dict(collected(near_duplicates.near_duplicate_classes(spark.createDataFrame(texts, "doc_id long, text string")), "doc_id", "class_id"))
    assert got == brute.near_classes(texts)


@pytest.mark.parametrize("leaders", [64, 1])
def test_rows_that_repeat_lose_no_link_of_a_hot_bucket(spark, monkeypatch, leaders):
    """Twenty families around one passage; with one leader a round, members take many turns."""
    import functools

    monkeypatch.setattr(near_duplicates, "_linked_exactly", functools.partial(near_duplicates._linked_exactly, leaders=leaders))
    word = lambda kind, n: [f"{kind}x{i}" for i in range(n)]
    texts = [(10 * f + k, " ".join(word("common", 120) + word(f"f{f}", 66) + word(f"f{f}k{k}", 14))) for f in range(20) for k in range(2)]
    df = spark.createDataFrame(texts * 6, "doc_id long, text string")
    got = dict(collected(near_duplicates.near_duplicate_classes(df, rows=1), "doc_id", "class_id"))
    assert got == brute.near_classes(texts)


def test_texts_outside_the_home_of_a_bucket_meet_several_of_it_in_one_pass(spark):
    """Rounds of a few links each cost more in stages than in rows."""
    rows = [(i, 0, 7, 1 if i <= 5 else i, 1) for i in range(1, 8)] + [(6, 1, 9, 6, 2), (2, 1, 9, 2, 2)]
    open_ = spark.createDataFrame(rows, "id long, band int, bucket long, root long, largest long")
    met = near_duplicates._pairs_with_home(open_, 3).groupBy("a").agg(F.collect_list("b").alias("b")).collect()
    met = {r["a"]: r["b"] for r in met}
    assert set(met) == {6, 7} and all(set(b) <= {1, 2, 3, 4, 5} and 1 <= len(set(b)) == len(b) <= 3 for b in met.values())


def test_documents_of_null_or_equal_ids_are_lost_to_their_own_class_only(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(100)) for x in "abcd")
    rows = [(None, a), (None, b), (None, a), (7, c), (7, d), (7, c), (8, c + " more"), (9, b), (7, ""), (7, ""), (None, None), (None, None), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(None, a), (9, b), (7, c), (7, d), (7, ""), (None, None), (None, None), (5, None)]
    assert collected(near_duplicates.one_of_each_class(df), "doc_id", "text") == sorted(want, key=repr)


def test_texts_around_a_repeated_passage_are_told_apart_by_bounds_that_lose_no_link(spark):
    rng = random.Random(5)
    passage = prose(rng, 12)
    texts = [" ".join([passage] * 6 + [f"own{i}_{k}" for k in range(rng.randrange(25, 40))]) for i in range(30)]
    for i in range(30):  # near copies, on both sides of the threshold
        words = texts[i].split()
        texts.append(" ".join(w if rng.random() > 0.004 * i else f"x{i}" for w in words))
    made = near_duplicates.sketches(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).withColumn("before", F.lit(0.0))
    led = made.select(F.col("id").alias("leader"), *[F.col(c).alias(f"leader_{c}") for c in ("before", "size", "units", "parity", "cells")])
    met = {(r["id"], r["leader"]) for r in made.join(led, F.col("id") < F.col("leader")).where(near_duplicates._may_link(0.8)).select("id", "leader").collect()}
    hashes = [near_duplicates.shingle_hashes(t.encode()) for t in texts]
    alike = {p for p in itertools.combinations(range(len(texts)), 2) if near_duplicates.similarity(hashes[p[0]], hashes[p[1]]) >= 0.8}
    assert len(alike) >= 5 and alike <= met
    assert len(met) < 100  # of 1,770 pairs


@pytest.mark.parametrize("size", [1, 7, 40, 1 << 18])
def test_texts_hashed_in_blocks_have_their_own_words(size):
    texts = [None, "", "A b-c", "--", "é1 x", " lead trail ", "one", "A b C d e f g", None, "end."]
    column = pa.array(["cut off", *texts])[1:]
    got = {}
    for at, plain, begin, end, hashes, first in decontaminate._blocks(column, size):
        for i, (x, y) in enumerate(itertools.pairwise(first.tolist())):
            got[at + i] = ([plain[a:b] for a, b in zip(begin[x:y], end[x:y], strict=True)], hashes[x:y].tolist())
    want = [(t or "").encode().translate(decontaminate.WORDS) for t in texts]
    assert got == {i: (t.split(), common.word_hashes(t).tolist()) for i, t in enumerate(want)}


def test_decontamination(spark, docs, rows):
    texts = [t for _, t in rows if t and len(t.split()) > 60]
    items = [(1, " ".join(texts[0].split()[5:25])), (2, " ".join(texts[1].split()[:13]).upper()), (3, "w1"), (4, None), (5, "!!"), (6, " ".join(texts[0].split()[5:25])), (None, "w2"), (10, "not in any document at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.contamination([(i, t) for i, t in rows], [x for x in items if x[0] is not None])
    for bits in (1 << 26, 64):
        out = decontaminate.contamination(decontaminate.benchmark_hits(docs, bench, filter_bits=bits))
        got = collected(out, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
        assert got == sorted(((i, *want[i]) for i, _ in rows), key=repr)


def test_hits_of_rows_of_equal_ids_stay_apart(spark):
    items = [(i, " ".join(f"i{i}x{k}" for k in range(15))) for i in range(4)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [(i, t) for i in (None, 7) for t in (items[0][1], f"own {items[1][1]} {items[2][1]}", "a clean text", "a clean text", None)]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in texts], SCHEMA)
    want = sorted(((i, *brute.contamination([(0, t)], items)[0]) for i, t in texts), key=repr)
    out = decontaminate.contamination(decontaminate.benchmark_hits(docs, bench))
    assert collected(out, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want
    clean = decontaminate.clean_rows(docs, bench)
    assert clean.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in clean.collect()) == Counter((i, t) for i, t in texts if t in ("a clean text", None))


@pytest.mark.parametrize("hot", [400_000, 3])
def test_scores(docs, rows, hot):
    floors = {"max_depth": 5, "min_context": 3, "min_symbol": 2, "gain_per_symbol": 0.5}
    out = suffix_tree.score(docs, hot_entries=hot, **floors)
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in out.collect()), key=repr)
    base = brute.unigram_scores(rows)
    assert got == sorted((x[:5] for x in base), key=repr)
    want = sorted((repr(i), b, s) for (i, *_, b), s in zip(base, brute.tree_scores(rows, 5, 3, 2, 0.6, 0.5), strict=True))
    assert any(s - b > 1 for _, b, s in want)
    for r, (_, b, s) in zip(sorted((repr(r["doc_id"]), r["base_score"], r["score"]) for r in out.collect()), want, strict=True):
        assert r[1] == pytest.approx(b) and r[2] == pytest.approx(s, abs=1e-6)


def test_gram_hashes_are_spark_hashes(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    a, b = rng.integers(-(1 << 63), 1 << 63, (2, 50))
    got = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b, strict=True)], "a long, b long").select(F.xxhash64("a", "b")).collect()
    assert [r[0] for r in got] == grams.joined(a.view(np.uint64), b.view(np.uint64)).view(np.int64).tolist()


def test_a_small_filter_changes_no_score(spark, docs):
    floors = {"min_context": 3, "min_symbol": 2}
    one = {r["doc_id"]: r["score"] for r in suffix_tree.score(docs, filter_bits=64, **floors).collect()}
    for r in suffix_tree.score(docs, **floors).collect():
        assert r["score"] == pytest.approx(one[r["doc_id"]])


def test_held_out_text_scores_better_with_contexts(spark, sf_dir):
    r = queries.op4_suffix_tree_score(spark, sf_dir).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


def test_token_counts(docs, rows):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok = Tokenizer.from_file(path)
    for hot in (400_000, 20):
        got = collected(token_counts.token_counts(docs, path, hot_entries=hot), "doc_id", "n_bytes", "n_tokens")
        assert got == sorted(((i, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in rows), key=repr)


@pytest.mark.parametrize("part", ["normalizer", "pre_tokenizer", "added_tokens", "post_processor"])
def test_files_that_split_otherwise_are_refused(spark, docs, tmp_path, part):
    import json

    said = json.loads(open(queries.tokenizer_path(), encoding="utf-8").read())
    said[part] = {"normalizer": {"type": "NFC"}, "pre_tokenizer": {"type": "Whitespace"}, "added_tokens": said["added_tokens"][:1], "post_processor": {"type": "ByteLevel"}}[part]
    path = tmp_path / "other.json"
    path.write_text(json.dumps(said))
    with pytest.raises(ValueError, match=part):
        token_counts.token_counts(docs, str(path))


@pytest.mark.parametrize("text", ["naïve café — “quoted” … 10½ ﬁ", "ΑΣ ΟΔΟΣ Σ", "İstanbul I", "é Å", "\x1c\x1f\x85 a b", "漢字 かな ไทย हिन्दी", "’s it's IT'S 'll"])
def test_pretokens_of_other_scripts(text):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok = Tokenizer.from_file(path)
    counts, special = token_counts.split_text(text, path)
    assert special + sum(n * len(tok.encode(p, add_special_tokens=False).ids) for p, n in counts.items()) == len(tok.encode(text, add_special_tokens=False).ids)


def test_shards(docs, rows):
    out = mixing.stratified_shards(docs, 7).select("doc_id", "source", "shard", "slot").collect()
    sizes = Counter(r["shard"] for r in out)
    assert len(out) == len(rows) and max(sizes.values()) - min(sizes.values()) <= 1
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    share = Counter(r["source"] for r in out)
    for shard in sizes:
        for s, n in share.items():
            assert abs(sum(r["shard"] == shard and r["source"] == s for r in out) - n / 7) <= 2


def plain_shares(spark, docs, seed):
    """Each row's source, keys and size, and each source's phase, as the operators hash them."""
    key = mixing._source_key("source")
    tie = mixing.tie_of(docs.select("doc_id", "source", "text"))
    words = F.size(mixing.words_of(F.col("text")))
    return docs.select("doc_id", key.alias("source_key"), tie.alias("tie"), mixing._uniform(seed, tie).alias("u"), F.xxhash64(F.lit(seed), tie).alias("order"), words.alias("size")).withColumn("phase", mixing._phase(seed)).collect()


@pytest.mark.parametrize("shards", [7, 40])
def test_shards_equal_a_plain_sort(spark, docs, shards):
    by = defaultdict(list)
    for r in plain_shares(spark, docs, 7):
        by[r["source_key"]].append(r)
    ranked = []
    for own in by.values():
        own.sort(key=lambda r: (r["u"], r["tie"]))
        ranked += [((i + r["phase"]) / len(own), r["order"], r["tie"], r["doc_id"]) for i, r in enumerate(own)]
    ranked.sort(key=lambda x: x[:3])
    want, slots = Counter(), Counter()
    for i, (*_, doc) in enumerate(ranked):
        shard = i * shards // len(ranked)
        want[doc, shard, slots[shard]] += 1
        slots[shard] += 1
    got = Counter(map(tuple, mixing.stratified_shards(docs, shards).select("doc_id", "shard", "slot").collect()))
    assert got == want


def test_mix_equals_a_plain_queue(spark, docs):
    rows = plain_shares(spark, docs, 9)
    by = defaultdict(list)
    for r in rows:
        by[r["source_key"]].append(r)
    name = lambda k: None if k == "null" else k[2:]
    weights = {k: (5, 2, 1)[i % 3] for i, k in enumerate(sorted(by, key=lambda k: (name(k) is None, name(k) or "")))}
    times, budget = [], sum(r["size"] for r in rows)
    for key, own in by.items():
        own.sort(key=lambda r: (r["u"], r["tie"]))
        whole, before = sum(r["size"] for r in own), 0
        for r in own:
            times += [((whole * e + before + r["size"] * r["phase"]) / weights[key], key, r["tie"], e, r["size"], r["doc_id"]) for e in range(3) if r["size"]]
            before += r["size"]
    times.sort(key=lambda x: x[:4])
    taken, spent = Counter(), 0
    for *_, size, doc in times:
        if spent + size > budget:
            break
        taken[doc] += size
        spent += size
    got = Counter()
    for r in mixing.fair_queue_mix(docs).collect():
        got[r["doc_id"]] += r["taken"]
    assert +got == taken


def test_many_small_sources_share_every_shard_with_a_large_one(spark):
    rows = [(i, "a b c", "en", f"s{i}", 1) for i in range(4000)] + [(10_000 + i, f"d e {i}", "en", "big", 1) for i in range(4000)]
    out = mixing.stratified_shards(spark.createDataFrame(rows, SCHEMA).repartition(4), 40)
    for r in out.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("source") == "big").alias("big")).collect():
        assert r["n"] == 200 and abs(r["big"] - 100) <= 30
    queued = mixing._queued(spark.createDataFrame(rows, SCHEMA), "source")
    assert abs(queued.where("source = 'big'").agg(F.sum("taken")).first()[0] - queued.where("source = 'big'").first()["target"]) <= 30


def test_whole_rows_are_mixed_and_sharded_like_their_ranks(spark, docs, rows):
    taken = Counter()
    for r in mixing.fair_queue_mix(docs).collect():
        taken[r["doc_id"]] += r["taken"] // r["size"] if r["size"] else 0
    out = mixing.repeated_rows(docs)
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.collect()) == +taken
    whole = mixing.sharded_rows(docs, 7)
    assert whole.columns == [*docs.columns, "shard", "slot"]
    assert collected(whole, "doc_id", "shard", "slot") == collected(mixing.stratified_shards(docs, 7), "doc_id", "shard", "slot")
    assert Counter((r["doc_id"], r["text"]) for r in whole.collect()) == Counter(rows)


def test_rows_of_null_or_equal_ids_and_texts_are_ranked_apart(spark):
    rows = [(None, "a b c", "en", "s", 1)] * 5 + [(7, "a b", "en", None, 1), (7, "c d e f", "en", None, 1), (None, None, None, None, None), (8, " \n", "en", "t", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    shards = mixing.stratified_shards(df, 4).collect()
    assert len({(r["shard"], r["slot"]) for r in shards}) == 9
    runs = [collected(mixing.fair_queue_mix(df.repartition(k)), "doc_id", "size", "source_size", "target", "taken") for k in (1, 4)]
    assert runs[0] == runs[1] and len(runs[0]) == 9
    assert all(r[4] == 0 for r in runs[0] if r[1] == 0)


def test_mix_reaches_its_targets(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(0, 40), "en", rng.choice(["a", "b", "c", "d", None]), 1) for i in range(3000)]
    out = mixing.fair_queue_mix(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    sizes = defaultdict(int)
    for _, t, _, s, _ in rows:
        sizes[s] += len(t.split())
    want = brute.targets(sizes)
    taken = defaultdict(int)
    for r in out:
        assert r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 80
    assert sum(taken.values()) <= sum(sizes.values())
    again = mixing.fair_queue_mix(spark.createDataFrame(rows, SCHEMA).repartition(2)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in out) == sorted((r["doc_id"], r["taken"]) for r in again)


@pytest.mark.parametrize("members", [256, 5, 1])
def test_repeats(docs, rows, members):
    out = repeats.remove_repeats(docs, members=members)
    got = collected(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(brute.repeats(rows), key=repr)
    assert collected(out, "doc_id", "n_passage_words") == sorted(brute.passages(rows), key=repr)


def test_hot_core_is_split_and_exact(spark):
    """One passage in many different surroundings, cut at different places: one core, many stretches."""
    rng = random.Random(11)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    x = noise(900)
    rows = [(i, noise(rng.randint(0, 30)) + x[rng.randint(0, 120) : 900 - rng.randint(0, 120)] + noise(rng.randint(0, 30))) for i in range(150)]
    rows += [(200 + i, noise(3) + x[40 * i : 40 * i + 390 + i] + noise(3)) for i in range(12)]
    for members in (256, 16):
        got = collected(repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), members=members), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert got == sorted(brute.repeats(rows), key=repr)


def test_repeats_of_periodic_and_edge_texts(spark):
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    x = noise(450)
    rows = [(1, "z" * 900), (2, "z" * 401), (3, x + noise(30)), (4, noise(10) + x), (5, x[:399]), (6, noise(5) + x[20:420] + "!"), (7, x[1:401]), (8, "ab" * 210 + x[:400]), (None, x), (9, noise(600_000))]
    got = collected(repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(brute.repeats(rows), key=repr)


def test_toxic_words_are_learnt_and_others_left_alone(spark, sf_dir):
    out = queries.op3_host_quality(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("y"))
    both = out.join(labels, "doc_id").groupBy("toxic", "y").count().collect()
    n = {(r["toxic"], r["y"]): r["count"] for r in both}
    assert n.get((True, 0), 0) <= 2


def plain_rates(counts):
    """Host and path rates of {(host, path): (n, y)}, level by level."""

    def rho(groups, means, unit):  # groups: per parent, its children's (n, y); means: the parents' means and v
        variance = expected = error2 = spread = 0.0
        for children, (m, v) in zip(groups, means, strict=True):
            children = [c for c in children if c[0]]
            n = sum(c[0] for c in children)
            if not n:
                continue
            variance += sum(c[0] * (c[1] / c[0] - m) ** 2 for c in children)
            expected += v * (len(children) - 1)
            error2 += 2 * v * v * (len(children) - 1)
            spread += v * (n - sum(c[0] ** 2 for c in children) / n - (len(children) - 1))
        if spread <= 0:
            return 0.0
        d, e = (variance - expected) / spread, error2**0.5 / spread
        return min((d + (d * d + 4 * e * e) ** 0.5) / 2, spread / (spread + unit))

    hosts = defaultdict(list)
    for (h, _), c in counts.items():
        hosts[h].append(c)
    sums = {h: (sum(c[0] for c in x), sum(c[1] for c in x)) for h, x in hosts.items()}
    n, y = sum(c[0] for c in sums.values()), sum(c[1] for c in sums.values())
    rate = (y + 0.5) / (n + 1)
    v = rate * (1 - rate)
    top = rho([list(sums.values())], [(y / n, v)], v)
    host = {h: (top * c[1] + (1 - top) * rate) / (top * c[0] + 1 - top) for h, c in sums.items()}
    own = rho(list(hosts.values()), [(sums[h][1] / max(sums[h][0], 1), host[h] * (1 - host[h])) for h in hosts], v)
    return host, {k: (own * c[1] + (1 - own) * host[k[0]]) / (own * c[0] + 1 - own) for k, c in counts.items()}


@pytest.mark.parametrize("effect", [0.0, 0.4])
def test_rates_equal_plain_empirical_bayes(spark, effect):
    rng = random.Random(8)
    counts = {}
    for h in range(12):
        for p in range(rng.choice([1, 3])):
            n = rng.choice([0, 1, 5, 40])
            counts[f"h{h}", f"p{p}"] = n, sum(rng.random() < 0.5 + effect * (-1) ** h for _ in range(n))
    df = spark.createDataFrame([(*k, n, y) for k, (n, y) in counts.items()], "host_ string, path_ string, n_quality long, y_quality long")
    host, path = plain_rates(counts)
    rows, _ = host_classifier.posteriors(df, "quality")
    for r in rows.collect():
        assert r["quality_host_rate"] == pytest.approx(host[r["host_"]])
        assert r["quality_path_rate"] == pytest.approx(path[r["host_"], r["path_"]])
    spread = max(path.values()) - min(path.values())
    assert effect == 0 or spread > 0.5


def test_hosts_improve_held_out_scores(spark):
    """Texts say little, hosts much: the hierarchy must score better than the text alone."""
    import math

    rng = random.Random(12)
    rows, labels = [], []
    for i in range(1500):
        h = rng.randrange(10)
        y = int(rng.random() < (0.15 if h % 2 else 0.85))
        rows.append((i, " ".join(rng.choice("abcdefghij") for _ in range(8)) + (" good" if y and rng.random() < 0.1 else ""), "en", None if h == 9 else f"s{h}", 1))
        labels.append((i, y, 0))
    train = spark.createDataFrame([x for x in labels if x[0] % 3], "doc_id long, quality int, toxic int")
    out = host_classifier.classify(spark.createDataFrame(rows, SCHEMA), train).collect()
    truth = {i: y for i, y, _ in labels}
    loss = lambda p, y: -math.log(p if y else 1 - p)
    held = [r for r in out if r["doc_id"] % 3 == 0]
    flat = sum(loss(1 / (1 + math.exp(-r["quality_evidence"])), truth[r["doc_id"]]) for r in held)
    full = sum(loss(r["quality_probability"], truth[r["doc_id"]]) for r in held)
    assert full < 0.75 * flat


def test_classifier_on_hard_rows(spark, docs, rows):
    labels = spark.createDataFrame([(i, k % 2, None if k % 3 else 1) for k, (i, _) in enumerate(rows)] + [(None, 1, 1), (0, 7, 0)], "doc_id long, quality int, toxic int")
    out = host_classifier.classify(docs, labels)
    assert Counter(r["doc_id"] for r in out.collect()) == Counter(i for i, _ in rows)
    assert out.where("quality_probability is null or toxic_probability is null or quality_path_rate not between 0 and 1").count() == 0
    assert out.select("key").distinct().collect()[0][0] == "own"


def test_classifier_learns_from_a_share_of_many_labels(spark, docs, rows):
    labels = spark.createDataFrame([(i, k % 2, 1) for k, (i, _) in enumerate(rows)], "doc_id long, quality int, toxic int")
    assert host_classifier.classify(docs, labels, max_labelled=30).count() == len(rows)


def test_classifier_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = host_classifier.classify(docs, none)
    assert out.count() == docs.count()


def wrapped(text, width=60, mark=""):
    import textwrap

    return "\n".join(mark + x for x in textwrap.wrap(text, width))


def told(name):
    """A known sentence with a holder in its slot."""
    return licenses.SENTENCES[name].replace("{}", "Example, Inc. and 2 others")


@pytest.mark.parametrize("name", sorted(licenses.SENTENCES))
def test_every_sentence_is_found_whole_and_wrapped(name):
    table = licenses.Sentences(licenses.SENTENCES)
    text = told(name)
    for shown in (text, text.upper(), wrapped(text), wrapped(text, 30, "# "), f"Some words before. {text.rstrip('.:;')}. And after.", f"no mark before\n{text}\nno mark after"):
        assert table.find(shown.encode())[0] == [name]
    assert table.find(f"words {text.rstrip('.:;')} words".encode())[0] == []


@pytest.mark.parametrize("name", sorted(licenses.RULES))
def test_every_rule_shows_its_license_alone(spark, name):
    rows = [(k, "\n\n".join(wrapped(told(s)) for s in sequence)) for k, sequence in enumerate(licenses.RULES[name])]
    for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r["licenses"] == [name]


def text_of(*names, holder="Example Inc."):
    return f"Copyright 2020 {holder} All rights reserved.\n\n" + "\n\n".join(wrapped(licenses.SENTENCES[n].replace("{}", holder)) for n in names)


BSD = ("bsd-redistribution", "bsd-source", "bsd-binary")
TEXTS = [
    (text_of(*BSD, "bsd-as-is", holder="THE COPYRIGHT HOLDERS AND CONTRIBUTORS"), ["BSD-2-Clause"]),
    (text_of(*BSD, "bsd-endorse", "bsd-as-is"), ["BSD-3-Clause"]),
    (text_of(*BSD, "bsd-endorse-name", "bsd-as-is"), ["BSD-3-Clause"]),
    (text_of(*BSD, "bsd-advertise", "bsd-endorse"), ["BSD-4-Clause"]),
    (text_of("isc-grant", "isc-disclaims"), ["ISC"]),
    (text_of("mit-title", "mit-grant", "mit-kept", "mit-as-is", "mit-liable"), ["MIT"]),
    ("Released under the MIT License.\nAll rights reserved.", ["MIT"]),
    (text_of("gpl3-free", "gpl-hope", "gpl-see"), ["GPL-3.0"]),
    (text_of("lgpl21-free", "lgpl-hope"), ["LGPL-2.1"]),
    (text_of("mit-title", "mit-grant", "mit-kept", "mit-as-is") + "\n\n" + text_of(*BSD, "bsd-endorse"), ["BSD-3-Clause", "MIT"]),
    ("All rights reserved.", ["proprietary"]),
    ("Licensed under the Example Licence 7.", ["unknown"]),
    ("SPDX-License-Identifier: Example-1.0", ["unknown"]),
    ("SPDX-License-Identifier: MIT", ["MIT"]),
    ("the MIT License is nice, licensed under no law", []),
    ("Redistributions in binary form are fine. " + "word " * 50, []),
]


def test_one_license_for_each_text_that_has_one(spark):
    out = licenses.scan_licenses(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TEXTS)], "doc_id long, text string"))
    assert {r["doc_id"]: r["licenses"] for r in out.collect()} == {i: x for i, (_, x) in enumerate(TEXTS)}


def test_license_scan_of_hard_rows(spark, docs, rows):
    grant = licenses.SENTENCES["mit-grant"]
    cases = [(1, "Intro.\nReleased under the MIT License."), (2, f"MIT License\n\n{grant}"), (3, f"{grant}\nMIT License"), (4, "licensed under the apache license, version 2.0!\nAll Rights Reserved"), (5, None), (6, "the MIT License is nice"), (7, ""), (8, "SPDX-License-Identifier: GPL-3.0-only\n" * 2), (8, "word " * 50_000 + "\nAll rights reserved."), (None, "Licensed under CC BY-NC 4.0.")]
    df = spark.createDataFrame(cases + cases[:1], "doc_id long, text string").withColumn("licenses", F.lit("own")).withColumn("sentence_ids", F.lit("own"))
    got = Counter((r["doc_id"], *r["licenses"]) for r in licenses.scan_licenses(df).collect())
    assert got == Counter([(1, "MIT"), (1, "MIT"), (2, "MIT"), (3,), (4, "Apache-2.0"), (5,), (6,), (7,), (8, "GPL-3.0"), (8, "proprietary"), (None, "CC-BY-NC-4.0")])
    assert licenses.scan_licenses(docs).count() == len(rows)


def plain_licenses(ids, unknown):
    """Rules as in the operator's definition, by trying every way to place each rule."""
    from itertools import combinations

    rules = [(n, s) for n, x in licenses.RULES.items() for s in x] + [(x.removesuffix("-only").removesuffix("-or-later"), (f"spdx-{x.lower()}",)) for x in licenses.SPDX]
    left, out = list(range(len(ids))), set()
    while True:
        ways = sorted((-len(s), at, n) for n, s in rules for at in combinations(left, len(s)) if tuple(ids[i] for i in at) == s)
        if not ways:
            break
        _, at, name = ways[0]
        out.add(name)
        left = [i for i in left if i not in at]
    return sorted(out) if out else ["proprietary"] if "reserved" in ids else ["unknown"] if unknown else []


def test_licenses_equal_a_plain_assignment():
    rng = random.Random(4)
    rules = [(n, s) for n, x in licenses.RULES.items() for s in x] + [(x.removesuffix("-only").removesuffix("-or-later"), (f"spdx-{x.lower()}",)) for x in licenses.SPDX]
    names = [*BSD, "bsd-endorse", "mit-title", "mit-grant", "mit-kept", "mit-as-is", "mit-notice", "gpl-title", "gpl-version-3", "reserved", "spdx-mit"]
    for _ in range(300):
        ids = [rng.choice(names) for _ in range(rng.randrange(9))]
        unknown = rng.random() < 0.5
        assert licenses.met_licenses(ids, unknown, rules) == plain_licenses(ids, unknown)


def test_license_scan_equals_plain_search(spark, sf_dir):
    """Each known sentence searched as a regular expression between bounds."""
    import re

    gap = r"[^a-z0-9]+"
    part = lambda x: gap.join(w.decode() for w in licenses.normalised(x))
    slot = rf"{gap}(?:[a-z0-9]+{gap}){{1,{licenses.SLOT}}}?"
    patterns = {n: re.compile(r"(?:^|\n|[.;:!?]\s)[^a-z0-9\n]*" + slot.join(map(part, t.split("{}"))) + r"(?=[^a-z0-9]*?(?:$|\n|[.;:!?](?:\s|$)))") for n, t in licenses.SENTENCES.items()}
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: {n for n, p in patterns.items() if p.search((r["text"] or "").lower())} for r in texts}
    got = {r["doc_id"]: set(r["sentence_ids"].split(",")) - {""} for r in queries.op8_license_scan(spark, sf_dir).collect()}
    assert got == want and any(got.values())


def test_empty_tables(spark, empty):
    path = queries.tokenizer_path()
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    outs = [
        quality_rules.quality_rules(empty),
        near_duplicates.near_duplicate_classes(empty),
        decontaminate.benchmark_hits(empty, bench),
        suffix_tree.score(empty),
        token_counts.token_counts(empty, path),
        mixing.stratified_shards(empty),
        mixing.fair_queue_mix(empty),
        repeats.remove_repeats(empty),
        host_classifier.classify(empty, labels),
        licenses.scan_licenses(empty),
    ]
    assert [o.count() for o in outs] == [0] * len(outs)


def test_pipeline_stages(spark, docs, rows, sf_dir):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality rules", "near dedup", "decontamination", "mixing", "sharding"]
    kept = p.quality(spark, docs, sf_dir)
    assert kept.columns == docs.columns and kept.select("kept").distinct().collect()[0][0] == "own"
    fine = Counter(i for i, t in rows if not brute.base_quality(t)[-1])
    assert Counter(r["doc_id"] for r in kept.collect()) == fine
    one = p.near_dedup(spark, docs, sf_dir)
    classes = brute.near_classes([(i, t) for i, t in rows])
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(set(classes.values()))
    assert p.decontamination(spark, docs, sf_dir).columns == docs.columns
    mixed = p.mixture(spark, docs, sf_dir)
    assert mixed.columns == docs.columns and max(Counter(r["doc_id"] for r in mixed.where("doc_id <> 409").collect()).values()) <= 3
    sharded = p.sharding(spark, docs, sf_dir)
    assert sharded.columns == [*docs.columns, "shard", "slot"]


def test_decontamination_stage_keeps_what_a_plain_scan_keeps(spark, docs, rows, tmp_path):
    import corpus_pipeline as p

    texts = [t for _, t in rows if t and len(t.split()) > 60]
    items = [(k, " ".join(t.split()[3:40])) for k, t in enumerate(texts[:5])]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = brute.contamination([(k, t) for k, (_, t) in enumerate(rows)], items)
    kept = Counter((r["doc_id"], r["text"]) for r in p.decontamination(spark, docs, str(tmp_path)).collect())
    assert kept == Counter(r for k, r in enumerate(rows) if not want[k][-1]) and len(kept) < len(rows)


@pytest.mark.parametrize("stage", range(5))
def test_pipeline_stages_on_hard_tables(spark, stage, empty, sf_dir):
    """An empty table, and rows of nulls and repeated rows with columns whose names clash."""
    import corpus_pipeline as p

    name, run = p.STAGES[stage]
    added = ["shard", "slot"] if name == "sharding" else []
    none = run(spark, empty, sf_dir)
    assert none.columns == [*empty.columns, *added] and none.count() == 0
    words = " ".join(f"w{i}" for i in range(40))
    hard = [(None, None, None, None, None), (None, words, None, None, 1), (5, "", "en", "s", 0), (5, words + " x", "en", "s", 1), (6, words + " 6 of its own kind " * 3, "fr", None, 1)]
    df = spark.createDataFrame(hard * 2, SCHEMA)
    for c in ("page", "tie", "kept", "text_id", "copies", "root"):
        df = df.withColumn(c, F.lit("own"))
    out = run(spark, df, sf_dir)
    assert out.columns == [*df.columns, *added] and out.select("page", "root").distinct().count() <= 1
    seen = {(r["doc_id"], r["text"], r["lang"], r["source"]) for r in out.collect()}
    assert seen <= {h[:4] for h in hard}
    if name == "sharding":
        assert out.count() == len(hard) * 2


def test_pipeline_runs(spark, sf_dir):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, sf_dir)
    n = out.count()
    assert n > 0 and out.select("shard", "slot").distinct().count() == n


def test_blocks_of_texts_give_the_words_and_windows_of_each_text():
    import numpy as np

    texts = ["a bb", "", "cc  d", " ", "e", "f\n", "x" * 300_000, "g h", "é ü", ""]
    at, data = common.utf8(pa.array(texts))
    for block in (1, 6, 1 << 17):
        got = common.words_of_rows(at, data, block)
        assert [g.tolist() for g in got] == [common.word_hashes(t.encode()).tolist() for t in texts]
    hashes = common.Hashes(common.BYTES[data[:2000]], common.POWERS[0])
    place = np.arange(2000 - 16 + 1)
    assert (hashes.each(16) == hashes.of(place, place + 16)).all()


@pytest.mark.parametrize("block", [40, 1000])
def test_scores_in_small_blocks_without_broadcast(docs, rows, block):
    floors = {"max_depth": 3, "min_context": 3, "min_symbol": 2, "gain_per_symbol": 0.5}
    got = sorted((repr(r["doc_id"]), r["base_score"], r["score"]) for r in suffix_tree.score(docs, hot_entries=0, block=block, **floors).collect())
    want = sorted((repr(i), b, s) for (i, *_, b), s in zip(brute.unigram_scores(rows), brute.tree_scores(rows, 3, 3, 2, 0.6, 0.5), strict=True))
    for r, (_, b, s) in zip(got, want, strict=True):
        assert r[1] == pytest.approx(b) and r[2] == pytest.approx(s, abs=1e-6)


def test_scores_where_the_share_of_all_tokens_passes_32_bits(monkeypatch, docs):
    floors = {"min_context": 3, "min_symbol": 2}
    want = {(r["doc_id"], r["n_tokens"]): r["score"] for r in suffix_tree.score(docs, **floors).collect()}
    monkeypatch.setattr(suffix_tree, "OFTEN", 1 << 30)  # as 2^28 times the tokens would
    for r in suffix_tree.score(docs, **floors).collect():
        assert r["score"] == pytest.approx(want[r["doc_id"], r["n_tokens"]])


def test_a_write_drops_its_shuffle_files(spark):
    import glob
    import tempfile

    from siteindex import lineage

    local = spark.sparkContext.getConf().get("spark.local.dir") or tempfile.gettempdir()
    files = lambda: set(glob.glob(f"{local}/blockmgr-*/*/shuffle_*.data"))
    counted = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    was, before = spark.conf.get(lineage.DROP_SHUFFLES), files()
    assert lineage.written(counted, drop_shuffles=True).count() == 7
    between = files() - before
    assert lineage.written(counted).count() == 7
    # The count of the table read back has a shuffle of its own.
    assert len(between) < len(files() - before - between)
    assert spark.conf.get(lineage.DROP_SHUFFLES) == was


def test_a_block_asks_for_each_of_its_ngrams_once(spark):
    import numpy as np

    texts = spark.createDataFrame([(i, "the same words in every text") for i in range(500)], "doc_id long, text string").coalesce(1)
    every = suffix_tree.Filter(spark.createDataFrame([(0,)], "key long"), 64)
    every.words[:] = -1
    none = [np.zeros(0, np.uint64), *[np.zeros(0)] * 3]
    asked = suffix_tree.questions(texts, spark.sparkContext.broadcast((none, every)), 3, 1_000_000)
    # Six words and an end token: 7 + 6 + 5 + 4 n-grams of up to four words.
    assert asked.agg(F.sum(F.size("keys")), F.sum("asked"), F.sum(F.size("places"))).first() == (22, 22, 500 * 22)
