"""Export files: splits, quoted breaks, headers of each file, archives, refusals."""

import csv
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from siteindex.sources import crawl, exports


def written(rows):
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(rows)
    return out.getvalue()


@pytest.mark.parametrize("size", ["200", "128m"])
def test_records_equal_a_csv_reader_in_any_split(spark, tmp_path, size):
    rng = random.Random(3)
    files = {}
    for k in range(3):
        width = 3 + k
        cells = ["", "plain", "a,b", 'say "hi"', "two\nlines", "\n\nthree", " edge "[1:], "1,200", "é"]
        files[f"f{k}.csv"] = [[f"H{i} of {k}" for i in range(width)], *[["x", *(rng.choice(cells) for _ in range(width - 1))] for _ in range(60)]]
        (tmp_path / f"f{k}.csv").write_text(("﻿" if k == 1 else "") + written(files[f"f{k}.csv"]) + "\n", encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = {}
        for r in exports.csv_records(exports.csv_lines(spark, str(tmp_path))).collect():
            got.setdefault(r["file"].rpartition("/")[2], []).append((r["ord"], r["header"], r["cells"]))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for name, (header, *rows) in files.items():
        assert [c for _, _, c in sorted(got[name])] == [[x.strip() if not x.startswith("\n") and '"' not in x and "," not in x and "\n" not in x else x for x in r] for r in rows]
        assert [o for o, _, _ in sorted(got[name])] == list(range(60)) and got[name][0][1] == [h.lower() for h in header]


def test_crawl_export(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Address,Status Code,Content Type,Title 1,Word Count\nhttps://x.com/,200,text/html,"A, quoted",120\nhttps://x.com/b,404,text/html,B,1\nhttps://x.com/c,200,application/pdf,C,1\n\n')
    (tmp_path / "b.csv").write_text("Url,Title,Crawl Depth\nhttps://y.com/,Other columns,3\n,no address,1\n")
    fields = exports.crawl_fields(exports.csv_records(exports.csv_lines(spark, str(tmp_path))))
    got = crawl.entries_of(fields).select("url", "title", "word_count", "crawl_depth").collect()
    assert sorted(map(tuple, got)) == [("https://x.com/", "A, quoted", 120, -1), ("https://y.com/", "Other columns", 0, 3)]


def test_archives_of_several_languages(spark, tmp_path, monkeypatch):
    def archive(name, **files):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for n, body in files.items():
                z.writestr(f"{n}.csv", body)

    archive("a.zip", Queries="Query,Clicks\nq,1\n", Pages='Top pages,Clicks,CTR\nhttps://x.com/,"1,200",2.67%\nnot a url,3,1%\n')
    archive("b.zip", Pages="﻿Seite,Klicks,Impressionen\r\nhttps://x.de/,7,n/a\r\n")
    archive("c.zip", Pages="Query,Clicks\nhttps://x.com/,1\n")
    archive("d.zip", Pages="Top pages,Position\nhttps://x.com/,1\n")
    archive("e.zip", Countries="Country,Clicks\nx,1\n")
    records = exports.csv_records(exports.zip_lines(spark, str(tmp_path)))
    rows = exports.metric_rows(records).collect()
    assert sorted((r["file"][-5:], r["ord"], r["url"], r["clicks"], r["impressions"], r["ctr"]) for r in rows) == [("a.zip", 0, "https://x.com/", 1200, None, pytest.approx(0.0267)), ("b.zip", 0, "https://x.de/", 7, None, None)]
    refused = {r["file"][-5:]: r["problem"] for r in exports.refused_files(records).collect()}
    assert refused["c.zip"].startswith("this is an export of queries") and refused["d.zip"].startswith("neither clicks") and set(refused) == {"c.zip", "d.zip"}


def test_wrong_headers(spark):
    rows = [(1, ["country", "clicks"]), (2, ["title", "clicks"]), (3, ["page", "impressions"])]
    got = spark.createDataFrame(rows, "id long, header array<string>").select("id", exports.problem(F.col("header")).alias("p")).collect()
    assert [(r["id"], (r["p"] or "")[:11]) for r in got] == [(1, "this is an "), (2, "no URL colu"), (3, "")]
