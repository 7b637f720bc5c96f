"""Semantics that engines and languages disagree on, and properties of single operators."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siteindex.functions import order, patterns, ranking, text, urls
from siteindex.operators import inventory, metrics, recon, review, sections
from siteindex.sources import crawl


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "want"), [("12.9", 12), ("-3.99", -3), ("1d", 0), ("1_000", 0), ("inf", 0), ("", 0), (" 7 ", 7), ("1e3", 1000)])
def test_safe_int(spark, raw, want):
    assert one(spark, text.safe_int(F.col("v")), v=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("1,200", 1200.0), ("2.67%", 0.0267), ("1 234", 1234.0), ("n/a", None), ("", None)])
def test_locale_number(spark, raw, want):
    assert one(spark, text.locale_number(F.col("v")), v=raw) == pytest.approx(want)


def test_title_case_raises_after_any_non_letter(spark):
    assert one(spark, text.unslug(F.col("v")), v="foo-bar 3d") == "Foo Bar 3D"


def test_truncation_prefers_sentences(spark):
    long = "One short sentence that is long enough to keep going. " + "word " * 40
    assert one(spark, text.truncate_text(F.col("v")), v=long) == "One short sentence that is long enough to keep going."
    assert one(spark, text.truncate_title(F.col("v")), v="Page | Brand") == "Page"


PAIRS = [
    ("http://x.com/a", "https://x.com/a"),
    ("https://www.x.com/a/", "https://x.com/a"),
    ("https://x.com:443/a", "https://x.com/a"),
    ("https://x.com/A", "https://x.com/a"),
    ("https://x.com/a?utm_source=g", "https://x.com/a"),
    ("https://x.com/a?b=2&a=1", "https://x.com/a?a=1&b=2"),
    ("https://x.com/a?a=1&a=1", "https://x.com/a?a=1"),
    ("https://x.com/a#top", "https://x.com/a"),
    ("https://x.com/caf%C3%A9/", "https://x.com/café"),
    ("https://x.com", "https://x.com/"),
]


@pytest.mark.parametrize(("left", "right"), PAIRS)
def test_canonical_urls_merge(spark, left, right):
    key = urls.canonical(F.col("v"))
    a, b = one(spark, key, v=left), one(spark, key, v=right)
    assert a == b
    assert one(spark, key, v=a) == a


@pytest.mark.parametrize(("left", "right"), [("https://x.com/a?page=2", "https://x.com/a"), ("https://x.com/a?q=S", "https://x.com/a?q=s"), ("https://x.com/a", "https://y.com/a")])
def test_canonical_urls_stay_apart(spark, left, right):
    key = urls.canonical(F.col("v"))
    assert one(spark, key, v=left) != one(spark, key, v=right)


@pytest.mark.parametrize(("glob", "url", "hit"), [("/guides/**", "https://x.com/guides/a/b", True), ("AllNew_*", "AllNew_Make", True), ("/a?c/", "https://x.com/abc", True), ("/A*", "https://x.com/abc", True), ("/b*", "https://x.com/abc", False)])
def test_globs(spark, glob, url, hit):
    assert (one(spark, patterns.first_match(F.col("v"), (glob,)), v=url) == glob) is hit


def test_fold_change(spark):
    fold = patterns.fold_change(F.col("a"), F.col("b"))
    assert one(spark, fold, a=4000, b=200) == 20.0
    assert one(spark, fold, a=0, b=0) == 1.0
    assert one(spark, fold, a=0, b=3) == float("inf")


@pytest.mark.parametrize(("depth", "words"), [(0, 250), (1, 250), (2, 310), (3, 70), (4, 0), (1, 1), (2, 999)])
def test_score_without_a_link_graph_has_the_doubles_of_its_sql(spark, depth, words):
    page = spark.createDataFrame([(depth, "https://x/", words, 0, 0)], "crawl_depth long, url string, word_count long, link_score long, unique_inlinks long")
    depth_value, content_value = max(0.0, 100 - depth * 20.0), min(words / 10, 100.0) if words else 50.0
    assert page.select(ranking.importance().alias("s")).first()["s"] == depth_value * (0.2 / 0.3) + content_value * (0.1 / 0.3)


def test_run_stages_stop_for_good_and_sort_no_stages(spark):
    stages = [(1, 1, 10), (1, 2, 20), (1, 2, 5), (1, 3, 1), (1, None, 1), (2, 1, 99), (3, None, 50), (3, 7, 1), (4, 1, None), (None, 1, 5)]
    out = review.run_stages(spark.createDataFrame(stages, "run long, seq int, started long"), spark.createDataFrame([(1, 20), (1, 30), (3, 40), (4, 0), (None, 0)], "run long, at long"))
    assert {r["run"]: (r["done"], r["status"]) for r in out.collect()} == {1: (1, "cancelled"), 2: (1, "done"), 3: (1, "cancelled"), 4: (1, "done"), None: (1, "done")}
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" in plan


def test_wrong_dimension_is_refused():
    with pytest.raises(ValueError, match="queries"):
        crawl.metric_columns(["Query", "Clicks"])
    with pytest.raises(ValueError, match="neither"):
        crawl.metric_columns(["Top pages", "Position"])
    assert crawl.metric_columns(["Top pages", "Clicks", "CTR"])["url"] == "Top pages"


METRIC = "key string, ord long, url string, clicks long, impressions long, ctr double, position double, source string"


def test_merged_metrics_keep_a_lone_null(spark):
    rows = [("a", 0, "u", None, 5, None, None, "s"), ("b", 1, "v", None, None, None, None, "s"), ("b", 2, "w", None, 1, None, None, "s")]
    got = {r["key"]: r for r in metrics.merge(spark.createDataFrame(rows, METRIC)).collect()}
    assert got["a"]["clicks"] is None and got["b"]["clicks"] == 0 and got["b"]["url"] == "v"
    strict = {r["key"]: r for r in metrics.merge(spark.createDataFrame(rows, METRIC), strict_nulls=True).collect()}
    assert strict["b"]["clicks"] is None and strict["b"]["impressions"] == 1


MEMBER = "`group` string, url string, ord long, clicks long, impressions long, known boolean"


def group(spark, clicks):
    rows = [("g", f"u{i}", i, c, None if c is None else 40 * c, c is not None) for i, c in enumerate(clicks)]
    return metrics.rollup(spark.createDataFrame(rows, MEMBER)).first()


def test_exclusive_percentile(spark):
    assert group(spark, list(range(1, 11)))["p90_clicks"] == pytest.approx(9.9)
    assert group(spark, [1, 5])["p90_clicks"] == 5.0


def test_head_share_needs_enough_earners(spark):
    assert group(spark, [100] * 60 + [0] * 940)["head_share"] is None
    assert group(spark, [0] * 20)["head_share"] is None
    assert group(spark, [90] + [10] * 9)["head_share"] == pytest.approx(0.5)


def test_unmeasured_group_is_left_for_review(spark):
    rolled = metrics.verdicts(metrics.rollup(spark.createDataFrame([("g", "u", 0, None, None, False)], MEMBER)))
    assert rolled.first()["verdict"] == "review" and rolled.first()["confidence"] == "low"


def test_mutual_canonicals_drop_both(spark):
    rows = [(0, "a", "b", ""), (1, "b", "a", ""), (2, "c", "gone", "h"), (3, "d", "", "h")]
    marked = inventory.marked_duplicates(spark.createDataFrame(rows, "ord long, url string, canonical string, content_hash string"))
    assert {r["url"]: r["removed"] for r in marked.collect()} == {"a": True, "b": True, "c": False, "d": True}


@pytest.mark.parametrize(("n", "size"), [(10, 3), (7, 7), (3, 5), (1000, 13), (101, 100)])
def test_even_sample_positions(spark, n, size):
    got = recon.even_sample(spark.range(n).select(F.lit("s").alias("site"), F.col("id").alias("ord")), ("site",), F.lit(size)).where("picked")
    want = list(range(n)) if n <= size else [int(i * (n / size)) for i in range(size)]
    assert sorted(r["ord"] for r in got.collect()) == want


def test_places_inside_a_hot_key(spark):
    """One key has nine tenths of the rows: its places are right, and they were ranked in many ranges."""
    rng = random.Random(4)
    rows = [("hot" if k % 10 else rng.choice(["a", None]), v) for k, v in enumerate(rng.sample(range(10_000), 3000))]
    df = spark.createDataFrame(rows, "site string, ord long").repartition(3)
    got = order.numbered_within(df, ("site",), [F.col("ord").desc()], "place", "n", partitions=20)
    want = []
    for key in ("hot", "a", None):
        mine = sorted((o for s, o in rows if s == key), reverse=True)
        want += [(key, o, i, len(mine)) for i, o in enumerate(mine)]
    assert sorted(map(tuple, got.select("site", "ord", "place", "n").collect()), key=repr) == sorted(want, key=repr)
    held = spark.read.parquet(got.inputFiles()[0].rpartition("/")[0])  # the ranges that were ranked
    sizes = [r["count"] for r in held.groupBy("range_", "site").count().collect()]
    assert max(sizes) < len(rows) / 10 and len(sizes) >= 20


@pytest.mark.parametrize("folded", [3, 10_000])
def test_greedy_texts_equal_a_plain_pass(spark, folded):
    """Few rows to a fold, so that most is decided by running sums; one site where tiny blocks stand between large ones."""
    rng = random.Random(8)
    rows = [("a", i, f"t{i}", f"https://a/{i}", "x" * rng.choice([1, 5, 40, 200, 900, 5000]), float(rng.randrange(30))) for i in range(200)]
    rows += [("b", i, "t", "u", "y" * (1 if i % 2 else 400 - i), 0.0) for i in range(60)] + [("c", 0, "t", "u", "z" * 9000, 1.0), ("c", 1, "t", "u", "", 1.0), ("d", 0, "t", "u", "", 1.0)]
    df = spark.createDataFrame(rows, "site string, ord long, display_title string, url string, markdown string, score double").repartition(5)
    got = {r["site"]: (r["body"], r["omitted"]) for r in sections.greedy_full(df, 3000, folded=folded).collect()}
    want = {}
    for site in "abc":
        body, omitted = f"# {site}\n", 0
        for _, _, title, url, text, _ in sorted((r for r in rows if r[0] == site and r[4]), key=lambda r: (-r[5], r[1])):
            block = f"\n---\n\n## {title}\n\nSource: {url}\n\n{text}\n"
            body, omitted = (body + block, omitted) if len(body + block) <= 3000 else (body, omitted + 1)
        want[site] = body + (f"\n---\n\n*{omitted} lower-priority page(s) omitted to keep this file under 3,000 characters.*\n" if omitted else ""), omitted
    assert got == want


def test_trie_descent_finds_every_match(spark):
    rng = random.Random(6)
    parts = ["a", "b", "{slug}", "{id}", "c", "{"]
    templates = sorted({"/" + "/".join(rng.choice(parts) for _ in range(rng.randrange(5))) for _ in range(120)})
    urls_ = [f"https://x.example/{'/'.join(rng.choice('abcd{') for _ in range(rng.randrange(6)))}?q={i}" for i in range(300)]
    members = spark.createDataFrame([(f"s{i % 2}", u, i) for i, u in enumerate(urls_)], "site string, url string, ord long")
    plan = spark.createDataFrame([(f"s{k}", t) for t in templates for k in (0, 1) if k or rng.random() < 0.7], "site string, template string")
    got = Counter((r["site"], r["ord"], r["template"]) for r in recon.matches(members, plan).collect())
    want = Counter()
    for site, template in map(tuple, plan.collect()):
        t = [x for x in template.split("/") if x]
        for i, u in enumerate(urls_):
            s = [x for x in u.partition("?")[0].split("/")[3:] if x]
            if site == f"s{i % 2}" and len(s) == len(t) and all(b[0] == "{" or a == b for a, b in zip(s, t, strict=True)):
                want[site, i, template] += 1
    assert got == want and len(want) > 200


def test_clustering_does_not_depend_on_partitions(spark):
    rows = [("s", f"https://x.com/blog/post-{i}", i) for i in range(40)] + [("s", f"https://x.com/docs/{d}", 40 + i) for i, d in enumerate("abc")]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "site string, url string, ord long")
    results = [sorted((r["template"], r["count"]) for r in recon.templates(df.repartition(n)).collect()) for n in (1, 7)]
    assert results[0] == results[1]
    assert ("/blog/{slug}", 40) in results[0] and ("/docs/a", 1) in results[0]


def test_stream_of_events(spark, sf_dir, tmp_path):
    from siteindex import streaming

    src = tmp_path / "in"
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.limit(200).write.parquet(str(src))
    stream = streaming.read_events(spark, str(src), events.schema)
    streaming.write_log(stream, str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination(60)
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 200
    assert streaming.windowed_counts(log).groupBy().sum("n").first()[0] == 200


def test_fingerprints_are_blake2b_of_folded_texts(spark):
    from hashlib import blake2b

    long = "STRASSE und Straße, ΣΑΣ  " * 20
    want = blake2b(" ".join(long.split()).casefold().encode(), digest_size=16).hexdigest()
    for raw, expected in ((long, want), (f"\n {long.lower()}\t", want), ("short", ""), (None, ""), ("x" * 199, ""), ("x" * 200, blake2b(b"x" * 200, digest_size=16).hexdigest())):
        df = spark.createDataFrame([(raw,)], "v string").select(text.fingerprint(F.col("v")).alias("x"))
        assert df.first()["x"] == expected


def test_tables_on_the_way_to_a_settled_one_are_deleted(spark):
    from pathlib import Path

    from siteindex.lineage import settled, shared_folder, written

    folder = Path(shared_folder(spark)) / "siteindex" / spark.sparkContext.applicationId
    before = set(folder.iterdir()) if folder.exists() else set()
    out = settled(spark, lambda: written(spark.range(5)).join(written(spark.range(3)), "id"))
    made = set(folder.iterdir()) - before
    assert len(made) == 1 and out.count() == 3

    def fails():
        written(spark.range(1))
        raise ValueError("no")

    with pytest.raises(ValueError, match="no"):
        settled(spark, fails)
    assert set(folder.iterdir()) - before == made
