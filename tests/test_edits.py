"""Ordered edits: each case of refusal, a plain fold beside the grouped one, and the stream."""

import pytest
from pyspark.sql import functions as F

from siteindex.operators import edits
from siteindex.plans import site as plans

DOCS, BLOG = "https://example.com/docs/quickstart", "https://example.com/blog/post"
PAGES = f"doc long, url string, {edits.PAGE}"


def run(spark, *operations, description="Some writing about things.", optional=False):
    pages = [(1, DOCS, 0, "Quick Start", "Get running in five minutes.", "Docs", False, True), (1, BLOG, 1, "A Post", description, "Blog", optional, True)]
    rows = [(1, k, o.get("op"), o.get("url"), o.get("section"), o.get("text"), o.get("title"), o.get("description"), o.get("flag"), o.get("sections")) for k, o in enumerate(operations)]
    sites = spark.createDataFrame([(1, "Example", "The platform.", "")], "doc long, site_name string, site_summary string, notes string")
    out = edits.edited(spark.createDataFrame(pages, PAGES), sites, spark.createDataFrame(rows, edits.OPERATION)).collect()
    held = {r["url"]: r for r in out if r["kind"] == "page"}
    reasons = [r["reason"] for r in sorted((r for r in out if r["kind"] == "operation"), key=lambda r: r["seq"])]
    return held, next(r for r in out if r["kind"] == "site"), reasons


def test_unknown_urls_are_refused_and_never_made(spark):
    long = "https://example.com/" + "a" * 80
    pages, _, reasons = run(spark, {"op": "set_page_copy", "url": "https://example.com/new", "title": "x"}, {"op": "exclude_page", "url": DOCS + "/"}, {"op": "include_page"}, {"op": "set_optional", "url": long, "flag": True})
    assert set(pages) == {DOCS, BLOG} and pages[DOCS]["included"]
    assert reasons == [f"{u} is not a page in this run" for u in ("https://example.com/new", DOCS + "/", "(blank)", long[:67] + "...")]


def test_copy_needs_a_description_in_the_end(spark):
    pages, _, reasons = run(spark, {"op": "set_page_copy", "url": DOCS, "title": "Guide", "description": "Install it."}, {"op": "set_page_copy", "url": BLOG, "title": "Renamed"}, {"op": "set_page_copy", "url": BLOG}, description=" ")
    assert (pages[DOCS]["title"], pages[DOCS]["description"]) == ("Guide", "Install it.")
    assert reasons == [None, edits.NO_DESCRIPTION, edits.NOTHING]


def test_site_values(spark):
    _, site, reasons = run(spark, {"op": "set_site_name", "text": "Inc"}, {"op": "set_site_name"}, {"op": "set_site_summary", "text": ""}, {"op": "set_notes", "text": "fine\n  ## not"}, {"op": "set_notes", "text": "v3 is current."})
    assert (site["site_name"], site["site_summary"], site["notes"]) == ("Inc", "The platform.", "v3 is current.")
    assert reasons == [None, edits.NO_NAME, edits.NO_SUMMARY, edits.HEADING_IN_NOTES, None]


def test_renames_reach_later_operations_and_the_order(spark):
    pages, site, reasons = run(spark, {"op": "reorder_sections", "sections": ["Blog"]}, {"op": "rename_section", "section": "Docs", "text": "Manual"}, {"op": "rename_section", "section": "Docs", "text": "x"}, {"op": "rename_section", "section": "Blog"}, {"op": "reorder_sections", "sections": ["Manual", "Docs"]})
    assert pages[DOCS]["section"] == "Manual" and pages[BLOG]["section"] == "Blog"
    assert site["section_order"] == ["Blog", "Manual"] and site["renames"] == {"Docs": "Manual"}
    assert reasons == [None, None, "no section named 'Docs'", edits.NO_NAMES, "unknown section(s): Docs"]


def test_pages_move_and_come_and_go(spark):
    pages, _, reasons = run(spark, {"op": "move_page", "url": BLOG, "section": "Docs"}, {"op": "move_page", "url": DOCS}, {"op": "exclude_page", "url": DOCS}, {"op": "set_optional", "url": DOCS, "flag": True}, {"op": "include_page", "url": DOCS}, {"op": "exclude_page", "url": BLOG}, {"op": "delete_everything"}, optional=True)
    assert (pages[BLOG]["section"], pages[BLOG]["optional"], pages[BLOG]["included"]) == ("Docs", False, False)
    assert (pages[DOCS]["optional"], pages[DOCS]["included"]) == (True, True)
    assert reasons == [None, edits.NO_TARGET, None, None, None, None, edits.UNSUPPORTED]


def plain(pages, log):
    """The same edits on lists, written for reading rather than for Spark."""
    state = {}
    for p in pages:
        state.setdefault(p["doc"], {})[p["url"]] = dict(p.asDict())
    refused = {}
    for o in sorted(log, key=lambda o: (o["doc"], o["seq"])):
        held = state[o["doc"]]
        op, page = o["op"], held.get(o["url"])
        names = {p["section"] for p in held.values()} - {"", None}
        fine = True
        if op in ("set_site_name", "set_site_summary"):
            fine = bool(o["text"])
        elif op == "set_notes":
            fine = not any(x.strip().startswith("#") for x in o["text"].splitlines())
        elif op == "rename_section":
            fine = bool(o["section"] and o["text"] and o["section"] in names)
            for p in held.values() if fine else ():
                p["section"] = o["text"] if p["section"] == o["section"] else p["section"]
        elif op == "reorder_sections":
            fine = set(o["sections"]) <= names
        elif op == "delete_everything" or page is None:
            fine = False
        elif op == "move_page":
            fine = bool(o["section"])
            if fine:
                page["section"], page["optional"] = o["section"], False
        elif op == "set_page_copy":
            page["title"] = o["title"] or page["title"]
            page["description"] = o["description"] or page["description"]
            fine = bool((o["title"] or o["description"]) and page["description"].strip())
        elif op == "set_optional":
            page["optional"] = o["flag"]
        else:
            page["included"] = op == "include_page"
        refused[o["doc"], o["seq"]] = not fine
    return {(d, u): tuple(p[c] for c in ("title", "description", "section", "optional", "included")) for d, x in state.items() for u, p in x.items()}, refused


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    return [t.cache() for t in plans._edits(spark, sf_dir)]


def shown(rows):
    return {(r["doc"], r["url"]): tuple(r[c] for c in ("title", "description", "section", "optional", "included")) for r in rows}


def test_fold_equals_the_plain_one(tables):
    pages, sites, log = tables
    out = edits.edited(pages, sites, log).collect()
    state, refused = plain(pages.collect(), log.collect())
    assert shown(r for r in out if r["kind"] == "page") == state
    assert {(r["doc"], r["seq"]): r["reason"] is not None for r in out if r["kind"] == "operation"} == refused
    assert set(refused.values()) == {True, False}


def test_stream_equals_batch(spark, tables, tmp_path):
    pages, sites, log = tables
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k in range(3):  # operations arrive in three batches
            log.where((F.col("seq") >= 4 * k) & ((F.col("seq") < 4 * k + 4) | F.lit(k == 2))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = edits.edit_stream(spark.readStream.schema(log.schema).parquet(str(tmp_path / "in")), pages, sites)
            stream.writeStream.outputMode("update").foreachBatch(lambda rows, _: rows.write.mode("append").parquet(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    done = spark.read.parquet(str(tmp_path / "out"))
    batch = edits.edited(pages, sites, log).collect()
    assert shown(edits.latest_state(done, pages).collect()) == shown(r for r in batch if r["kind"] == "page")
    key = lambda rows: sorted((r["doc"], r["seq"], r["op"], r["reason"] or "") for r in rows if r["kind"] == "operation")
    assert key(done.collect()) == key(batch)
    last = {r["doc"]: r for r in sorted((r for r in done.collect() if r["kind"] == "site"), key=lambda r: r["seq"])}
    for r in (r for r in batch if r["kind"] == "site"):
        assert [last[r["doc"]][c] for c in ("site_name", "notes", "section_order", "renames")] == [r[c] for c in ("site_name", "notes", "section_order", "renames")]
