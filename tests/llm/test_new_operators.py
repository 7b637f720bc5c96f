"""Ranked search, toxicity and divergence against plain versions, on hard rows."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteindex.llm import divergence, lexical_search, queries, terms, toxicity

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
HARD = [None, "", " \n\t ", "!?.", "É é ÉCOLE École ß", "a" * 3000, "x1 X1 x1. 1 2 3", "tab\tsep\x0bwords\x00here\r\nnext", "word " * 4000]


def prose(rng, n, vocabulary=300):
    return " ".join(f"W{int(rng.paretovariate(0.6)) % vocabulary}{rng.choice(['', '.', ',', '-x'])}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [(i, prose(rng, rng.choice([3, 20, 80, 300]))) for i in range(260)]
    out += [(300 + i, t) for i, t in enumerate(HARD)] + [(400 + i, out[3][1]) for i in range(70)]  # ties beyond k
    out += [(7, out[7][1]), (7, "w1 other"), (None, out[3][1]), (None, None), (500, prose(rng, 20_000))]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    full = [(i, t, "en" if (i or 0) % 3 else None, None if (i or 0) % 11 == 0 else f"s{(i or 0) % 4}", None) for i, t in rows]
    df = spark.createDataFrame(full, SCHEMA).repartition(3)
    for c in ("rank", "score", "term", "segment", "n", "p", "y", "keys", "held_out"):
        df = df.withColumn(c, F.lit("own"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_term_positions_and_hashes():
    texts = ["Ab c-d".encode(), b"", "  é1 ab".encode()]
    found = terms.terms_of(texts, terms.ALNUM_TERMS)
    assert [found.data[a:b].decode() for a, b in zip(found.begins, found.ends, strict=True)] == ["ab", "c", "d", "é1", "ab"]
    assert found.text.tolist() == [0, 0, 0, 2, 2]
    assert found.hashes[0] == found.hashes[4] and len(set(found.hashes.tolist())) == 4
    assert terms.terms_of([b"A1 b"], terms.LETTER_TERMS).data == b"a  b"


@pytest.mark.parametrize(("postings", "k"), [(3_000_000, 50), (500, 50), (500, 3)])
def test_search_equals_scoring_every_document(spark, docs, rows, postings, k):
    rng = random.Random(1)
    items = [(i, prose(rng, rng.choice([1, 5, 40]))) for i in range(25)]
    items += [(90, None), (91, "..."), (92, "nowhere else"), (93, rows[0][1]), (93, "w1"), (None, "w2 w3"), (94, "x1 É école"), (95, next(t for i, t in rows if i == 3))]
    df = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("own"))
    got = [tuple(r) for r in lexical_search.ranked_search(docs, df, k=k, segment_postings=postings).select("item_id", "rank", "doc_id", "score").collect()]
    want = [x[1:] for x in brute.search(rows, items, k)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_blocks_keep_their_postings_and_maxima():
    rng = np.random.default_rng(4)
    n = 5000
    m = rng.integers(50, 300, n)
    lists = {7: np.arange(n), 9: np.sort(rng.choice(n, 130, False)), 12: np.array([4999])}
    tf = {7: rng.integers(1, 300, n), 9: np.where(np.arange(130) == 77, 70_000, 1), 12: np.array([1])}
    hashes = np.concatenate([np.full(len(x), h, np.uint64) for h, x in lists.items()])
    columns = lexical_search.Postings(hashes, np.concatenate(list(lists.values())), np.concatenate(list(tf.values())), m).columns
    for i, h in enumerate(lists):
        row = {c: v[i].as_py() for c, v in columns.items()}
        held = lexical_search._List(row, m)
        places, impacts = held.postings(np.ones(len(held.firsts), bool))
        want = lexical_search.impacts(tf[h], m[lists[h]])
        assert places.tolist() == lists[h].tolist() and impacts.tolist() == want.tolist()
        for b, top in enumerate(held.tops):
            assert top == want[b * lexical_search.BLOCK : (b + 1) * lexical_search.BLOCK].max()


def test_blocks_below_the_threshold_stay_compressed():
    """A rare term decides; the blocks of the frequent one that can't reach the threshold aren't decompressed."""
    n = 64 * 200
    m = np.full(n, 100)
    rare = np.arange(10)
    hashes = np.concatenate([np.full(n, 1, np.uint64), np.full(10, 2, np.uint64)])
    columns = lexical_search.Postings(hashes, np.concatenate([np.arange(n), rare]), np.ones(n + 10, np.int64), m).columns
    lists = {i + 1: lexical_search._List({c: v[i].as_py() for c, v in columns.items()}, m) for i in range(2)}
    places, scores = lexical_search.best_of_segment(lists, np.arange(n), np.zeros(n, bool), [1, 2], [10, 5000], 1, 10)
    assert sorted(places.tolist()) == list(range(10)) and len(set(scores.tolist())) == 1
    assert lists[1].ready.sum() <= 2 and lists[2].ready.all()


def test_thresholds_of_a_first_part_leave_few_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    one = sorted(map(tuple, lexical_search.ranked_search(docs, items).collect()))
    many = sorted(map(tuple, lexical_search.ranked_search(docs, items, segment_postings=300).collect()))
    assert one == many


@pytest.mark.parametrize("least", [30, 2, 10_000])
def test_divergence_equals_a_sum_over_all_terms(docs, rows, least):
    named = [("en" if (i or 0) % 3 else None, None if (i or 0) % 11 == 0 else f"s{(i or 0) % 4}", t) for i, t in rows]
    got = divergence.divergence_audit(docs, min_documents=least)
    assert sorted(map(tuple, got.collect())) == sorted(brute.divergence(named, least))
    assert got.schema["value"].dataType.simpleString() == "bigint" and got.schema["rank"].dataType.simpleString() == "int"


def test_divergence_of_one_hot_source_and_counts_sent_in_parts(spark, rows):
    texts = [(t, "en", "hot" if k % 10 else f"s{k % 3}") for k, (_, t) in enumerate(rows)] + [(None, "xx", None), ("", "xx", "t")]
    df = spark.createDataFrame(texts, "text string, lang string, source string").repartition(4)
    counts = divergence.term_counts(df, block_bytes=500, held_entries=50).groupBy("lang", "source", "term").agg(F.sum("n"), F.sum("documents"))
    once = divergence.term_counts(df).groupBy("lang", "source", "term").agg(F.sum("n"), F.sum("documents"))
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, once.collect()))
    got = divergence.divergence_audit(df, min_documents=5)
    assert sorted(map(tuple, got.collect())) == sorted(brute.divergence([(x, s, t) for t, x, s in texts], 5))


def test_shares_of_huge_counts_are_exact(spark):
    rows = [(8_000_000_000_000, 9_000_000_000_000_000, 40_000), (0, 17, 3), (10**17, 10**18, 9)]
    df = spark.createDataFrame(rows, "n long, total long, kept long").select("n", "total", "kept", divergence._share("n", "total", "kept").alias("p"))
    for r in df.collect():
        assert r["p"] == 1 + 10**9 * (r["n"] + 5) // (r["total"] + 5 * r["kept"])


@pytest.fixture(scope="module")
def restorer():
    rng = random.Random(3)
    words = "the of and thing with stupid idiot pathetic clown trash moron loser worthless again other small".split()
    return toxicity.Restorer(toxicity.language_model(toxicity.gram_counts([" ".join(rng.choice(words) for _ in range(4000)).encode()])))


@pytest.mark.parametrize(
    ("seen", "meant"),
    [("you 1d10t go", "you idiot go"), ("i d i o t", "idiot"), ("S.T.U.P.I.D", "stupid"), ("cl0wn!", "clown!"), ("m-o-r-0-n", "moron"), ("stuuupid", "stupid"), ("tr@sh, 7r4$h", "trash, trash"), ("p4th3t1c", "pathetic"), ("ttrraasshh", "trash"), ("l o s e r c l o w n", "loser clown"), ("plain words 2024 12:30", "plain words 2024 12:30"), ("", "")],
)
def test_disguises_are_undone(restorer, seen, meant):
    assert restorer.restore(seen.encode()) == meant.encode()


def test_viterbi_finds_the_cheapest_path(restorer):
    """Against every path through the lattice of short spans."""
    s, rng = toxicity.SYMBOLS, random.Random(9)
    cost = np.array(restorer.cost)

    def worth(path):
        past, total = 0, 0.0
        for text, price in path:
            total += price
            if not text or text == " " and past % s == 0:
                continue
            past = past * s + (0 if text == " " else ord(text) - 96)
            total += cost[past]
            past %= s**3
        return total + (cost[past * s] if past % s else 0.0)

    for _ in range(150):
        span = "".join(rng.choice("abis015$.- o") for _ in range(rng.randrange(1, 7)))
        best = min((worth(p), k, p) for k, p in enumerate(itertools.product(*restorer.options(span))))
        text = " ".join("".join(x for x, _ in best[2]).split())
        got = " ".join(restorer._decode(span).split())
        assert got == text or worth_of(restorer, span, got) == pytest.approx(best[0])


def worth_of(restorer, span, text):
    paths = [p for p in itertools.product(*restorer.options(span)) if " ".join("".join(x for x, _ in p).split()) == text]
    cost, s = np.array(restorer.cost), toxicity.SYMBOLS
    out = []
    for path in paths:
        past, total = 0, 0.0
        for t, price in path:
            total += price
            if t and not (t == " " and past % s == 0):
                past = past * s + (0 if t == " " else ord(t) - 96)
                total += cost[past]
                past %= s**3
        out.append(total + (cost[past * s] if past % s else 0.0))
    return min(out)


def test_texts_that_are_not_flagged_hold_no_disguise(restorer, rows):
    rng = random.Random(6)
    texts = [(t or "").encode() for _, t in rows] + ["".join(rng.choice("ab c1$!.-*éx@A \n") for _ in range(rng.randrange(30))).encode() for _ in range(3000)]
    assert restorer.restore_all(texts) == [restorer.restore(t) for t in texts]
    assert not all(toxicity.may_be_disguised(texts)) and any(toxicity.may_be_disguised(texts))


def test_very_long_spans(restorer):
    assert restorer.restore(b"a " * 20_000 + b"b") and restorer.restore(b"1a" * 30_000)


def test_language_model_counts_characters():
    counts = toxicity.gram_counts(["ab é".encode(), b"ab"]).reshape((28,) * 4)
    assert counts[0, 0, 0, 1] + counts[2, 0, 0, 1] >= 1 and counts.sum() > 0
    p = np.exp(-toxicity.language_model(toxicity.gram_counts([b"abc abd"]))).reshape((28,) * 4)
    assert np.allclose(p.sum(axis=-1), 1)


def labelled(rng, n, disguise):
    words = "the of and thing with again other small river house".split()
    bad = "idiot clown moron trash".split()
    leet = str.maketrans("oiat", "01@7")
    rows, labels = [], []
    for i in range(n):
        y = i % 5 == 0
        text = [rng.choice(words) for _ in range(30)]
        for _ in range(3 if y else 0):
            w = rng.choice(bad)
            held = zlib.crc32(str(i).encode()) % 3 == 1
            if disguise and held:
                w = rng.choice([w.translate(leet), " ".join(w), w[:2] + w[1] * 3 + w[2:]])
            text.insert(rng.randrange(len(text)), w)
        rows.append((i, " ".join(text)))
        labels.append((i, int(y)))
    return rows, labels


@pytest.mark.parametrize("disguise", [False, True])
def test_held_out_toxic_texts_are_found_even_if_disguised(spark, disguise):
    rows, labels = labelled(random.Random(2), 900, disguise)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = toxicity.score(df, spark.createDataFrame(labels, "doc_id long, toxic long")).where("held_out").collect()
    truth = dict(labels)
    caught = [r["score"] >= 0.7 for r in out if truth[r["doc_id"]]]
    false = [r["score"] >= 0.7 for r in out if not truth[r["doc_id"]]]
    assert sum(caught) >= 0.95 * len(caught) and sum(false) <= 0.01 * len(false)


def test_labels_of_held_out_rows_teach_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = ({r["doc_id"]: r["score"] for r in toxicity.score(docs, x).collect()} for x in (labels, turned))
    assert one == pytest.approx(two)


def test_hard_rows_and_few_labels(spark, docs, rows, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = toxicity.score(docs, none)
    assert out.count() == len(rows) and {r["score"] for r in out.collect()} == {0.5}
    assert out.select("rank").distinct().collect()[0][0] == "own"
    some = spark.createDataFrame([(i, (i or 0) % 2) for i, _ in rows] + [(None, 1), (3, None), (4, 7)], "doc_id long, toxic int")
    scores = toxicity.score(docs, some).collect()
    assert len(scores) == len(rows) and all(0 <= r["score"] <= 1 for r in scores)
    assert toxicity.score(docs, some, max_labelled=40).count() == len(rows)


def test_empty_tables(spark, empty):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    full = spark.createDataFrame([(1, "a b", "en", "s", 1)], SCHEMA)
    outs = [lexical_search.ranked_search(empty, items), lexical_search.ranked_search(full, none), toxicity.score(empty, labels), divergence.divergence_audit(empty)]
    assert [o.count() for o in outs] == [0] * len(outs)


@pytest.mark.parametrize("name", ["op11_block_max_search", "op13_source_divergence"])
def test_queries_equal_their_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    result = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    got = queries.QUERIES[name](spark, sf_dir).select(*columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(result.fetchall(), key=repr)


def test_toxicity_query(spark, sf_dir):
    out = queries.op12_noisy_channel_toxicity(spark, sf_dir)
    assert [f.dataType.simpleString() for f in out.schema] == ["bigint", "boolean", "double", "int"]
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [r for r in out.collect() if r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert sum(r["predicted"] for r in rows if not labels[r["doc_id"]]) <= 1
