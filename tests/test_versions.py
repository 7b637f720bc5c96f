"""Tables that change together, and the embargo over all of them."""

import pytest
from pyspark.sql import functions as F

from siteindex.operators import embargo
from siteindex.sources import store, versions

GLOBS = ("/clients/nda-2026/*",)
INDEX = "# Example\n\n> An example site.\n\n## Services\n\n- [SEO](https://x.com/services/seo/): Search work.\n- [NDA project](https://x.com/clients/nda-2026/brief/): Confidential.\n- [PR](https://x.com/services/pr/): Links.\n"


def held(spark):
    secret = "https://x.com/clients/nda-2026/brief/"
    return {
        "pages": spark.createDataFrame([(1, "https://x.com/a"), (1, secret), (2, None)], "run long, url string"),
        "metrics": spark.createDataFrame([(secret, 3), ("https://x.com/a", 4)], "url string, clicks long"),
        "runs": spark.createDataFrame([(1, INDEX, f"prose about [it]({secret}): inline"), (2, "", "fine"), (3, None, None)], "run long, index_text string, full_text string"),
        "revisions": spark.createDataFrame([(1, 1, INDEX, "old"), (1, 2, "# x\n", f"see {secret}.")], "run long, revision long, index_text string, full_text string"),
    }


def rows(tables):
    return {n: sorted(map(tuple, t.collect()), key=repr) for n, t in tables.items()}


def test_embargo_reaches_every_table(spark, tmp_path):
    root = str(tmp_path)
    versions.commit(spark, root, held(spark), 0)
    report = {r["table"]: tuple(r)[1:] for r in embargo.purge_report(versions.tables(spark, root), GLOBS).collect()}
    assert report == {"pages": (1, 0, 0), "metrics": (1, 0, 0), "runs": (1, 1, 1), "revisions": (2, 1, 1)}
    assert versions.change(spark, root, lambda t: embargo.purged(t, GLOBS)) == 2
    got = rows(versions.tables(spark, root))
    line = "- [NDA project](https://x.com/clients/nda-2026/brief/): Confidential.\n"
    assert got["pages"] == sorted([(1, "https://x.com/a"), (2, None)], key=repr) and got["metrics"] == [("https://x.com/a", 4)]
    assert got["runs"] == sorted([(1, INDEX.replace(line, ""), ""), (2, "", "fine"), (3, None, None)], key=repr)
    assert got["revisions"] == [(1, 1, INDEX.replace(line, ""), "old"), (1, 2, "# x\n", "")]


def test_nothing_embargoed_changes_no_byte(spark):
    tables = held(spark)
    assert rows(embargo.purged(tables, ("/nothing-here/*",))) == rows(tables)


def test_a_change_that_fails_between_writes_leaves_the_old_state(spark, tmp_path):
    root = str(tmp_path)
    versions.commit(spark, root, held(spark), 0)
    before = rows(versions.tables(spark, root))

    def breaks(tables):
        out = embargo.purged(tables, GLOBS)
        out["runs"] = out["runs"].withColumn("full_text", F.raise_error(F.lit("lost on the way")).cast("string"))
        return out  # pages and metrics are written before it fails

    with pytest.raises(Exception, match="lost on the way"):
        versions.change(spark, root, breaks)
    assert versions.state(spark, root)[0] == 1 and rows(versions.tables(spark, root)) == before
    assert versions.change(spark, root, lambda t: embargo.purged(t, GLOBS)) == 2
    assert versions.discard_old(spark, root) == 7  # four old versions and three of the failed change
    assert len(rows(versions.tables(spark, root))["pages"]) == 2


def test_of_two_changes_of_one_state_the_later_is_refused(spark, tmp_path):
    root = str(tmp_path)
    versions.commit(spark, root, held(spark), 0)
    one = versions.tables(spark, root)
    versions.change(spark, root, lambda t: {"metrics": t["metrics"].where("clicks > 3")})
    with pytest.raises(versions.Conflict):
        versions.commit(spark, root, {"metrics": one["metrics"].where("clicks < 0")}, 1)
    assert rows(versions.tables(spark, root))["metrics"] == [("https://x.com/a", 4)]
    assert len(one["metrics"].collect()) == 2  # a reader keeps its version


def test_clones_and_deletes_are_whole(spark, tmp_path):
    root = str(tmp_path)
    versions.commit(spark, root, {k: v for k, v in held(spark).items() if k in ("runs", "revisions")}, 0)
    named = spark.createDataFrame([(1, 10)], "run long, clone long")
    versions.change(spark, root, lambda t: store.clone_runs(t, named))
    versions.change(spark, root, lambda t: store.delete_runs(t, spark.createDataFrame([(1,)], "run long")))
    assert {n: sorted({r[c] for r in map(lambda x: x.asDict(), t.collect()) for c in ("run",)}) for n, t in versions.tables(spark, root).items()} == {"runs": [2, 3, 10], "revisions": [10]}
