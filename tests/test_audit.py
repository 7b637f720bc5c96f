"""The rules of index and full documents against a plain auditor, on documents that break each of them."""

import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from siteindex import catalog
from siteindex.operators import audit
from siteindex.operators import documents as d
from siteindex.plans import documents as plans

LINK = re.compile(r"^\s*-\s+\[([^\]]*)\]\(([^)\s]*)\)\s*(?:(?::|[-–—])\s*(.*))?$")


def headings(lines):
    fenced = False
    for n, x in enumerate(lines):
        if x.lstrip()[:3] in ("```", "~~~"):
            fenced = not fenced
        elif not fenced and (m := re.match(r"^(#{1,6})\s+(.*)$", x)):
            yield n, len(m[1]), m[2].strip()


def plain_index(text, profile=None, bounds=(), status=None):
    """{rule: (count, examples)} of the rules that fail; None for a skipped one."""
    lines = text.splitlines()
    heads = list(headings(lines))
    h1, h2 = [h for h in heads if h[1] == 1], [h for h in heads if h[1] == 2]
    stop = h2[0][0] if h2 else len(lines)
    start = h1[0][0] + 1 if h1 else 0
    quote = next((n for n in range(start, stop) if lines[n].strip().startswith(">")), None)
    sections, links = [], []
    for k, (n, _, name) in enumerate(h2):
        end = h2[k + 1][0] if k + 1 < len(h2) else len(lines)
        mine = []
        for i in range(n + 1, end):
            x = lines[i].strip()
            if x[:1] not in ("-", "*") or "](" not in x or re.match(r"^\s*([-*_])(?:\s*\1){2,}\s*$", lines[i]) or re.match(r"^\s*([*_])(?!\s).*\1\s*$", lines[i]):
                continue
            m = LINK.match(lines[i])
            mine.append((i, *(m[1].strip(), m[2].strip(), (m[3] or "").strip()), False, lines[i]) if m else (i, "", "", "", True, lines[i]))
        sections.append((n, name, mine))
        links += mine
    fine = [x for x in links if not x[4]]
    urls_ = [x[2] for x in fine]
    out = {}

    def fails(rule, count, examples=()):
        if count:
            out[rule] = count, [str(e)[:160] for e in list(examples)[:5]]

    if len(h1) != 1:
        fails("IDX-001", max(1, len(h1)), [h[2] for h in h1])
    else:
        fails("IDX-001", int(h1[0][0] != next(n for n, x in enumerate(lines) if x.strip())))
    fails("IDX-002", int(quote is None or bool(h1) and quote > h1[0][0] + 3))
    stray = [h[2] for h in heads if (quote + 1 if quote is not None else start) <= h[0] < stop]
    fails("IDX-003", len(stray), stray)
    names = [s[1].lower() for s in sections]
    fails("IDX-004", int("optional" in names and names[-1] != "optional"))
    if sections:
        last = sections[-1]
        tail = [x.strip() for x in lines[(last[2][-1][0] if last[2] else last[0]) + 1 :] if x.strip()]
        footer = [bool(re.match(r"^\s*(?:---+|\*[^*].*\*|_[^_].*_|<!--.*-->)\s*$", x)) for x in tail]
        fails("IDX-005", footer.count(False), [x for x, f in zip(tail, footer, strict=True) if not f])
    fails("IDX-006", len(links) - len(fine), [x[5].strip() for x in links if x[4]])
    relative, insecure = [u for u in urls_ if not re.match("https?://", u)], [u for u in urls_ if u.startswith("http://")]
    paths = [re.sub(r"^https?://[^/?#]*", "", u).partition("#")[0].partition("?")[0] for u in urls_]
    dirs = [p.endswith("/") for p in paths if p not in ("", "/") and "." not in p.rsplit("/", 1)[-1]]
    least = min(dirs.count(True), dirs.count(False))
    fails("IDX-007", len(relative) or len(insecure) or (least if dirs and least / len(dirs) > 0.05 else 0), relative or insecure)
    twice = [u for u, n in Counter(urls_).items() if n > 1]
    titles = [t for t, n in Counter(x[1].lower() for x in fine).items() if t and n > 1]
    fails("IDX-008", len(twice) + len(titles), [*twice, *(f"'{t}'" for t in titles)])
    if profile:
        size = len(text.encode())
        fails("IDX-009", size if size > profile[0] else 0)
        if not profile[2] <= len(links) <= profile[1]:
            out["IDX-010"] = len(links), []
    else:
        out |= {"IDX-009": None, "IDX-010": None}
    sizes = {s[1]: len(s[2]) for s in sections}
    odd = [f"{n}: {sizes.get(n, 0)} < {a}" for n, a, _ in bounds if a is not None and sizes.get(n, 0) < a] + [f"{n}: {sizes.get(n, 0)} > {b}" for n, _, b in bounds if b is not None and sizes.get(n, 0) > b]
    fails("IDX-011", len(odd), odd)
    if not bounds:
        out["IDX-011"] = None
    fails("IDX-012", sum(not x[3] for x in fine), [x[2] for x in fine if not x[3]])
    best = [f"{m} — {x[3][:70]}" for x in fine for m in re.findall(r"(?i)\b(?:" + "|".join(d.SUPERLATIVES) + r")\b", x[3])]
    fails("IDX-013", len(best), best)
    calls = [x[3][:70] for x in fine if x[3].lower().startswith(d.OPENERS)]
    fails("IDX-014", len(calls), calls)
    counted = [(a, len(re.findall(rf"\b{a}", text.lower())), b, len(re.findall(rf"\b{b}", text.lower()))) for a, b in d.LOCALE_PAIRS]
    mixed = [f"{a} x{n} / {b} x{k}" for a, n, b, k in counted if n and k]
    fails("IDX-015", len(mixed), mixed)
    asks = [bool(u.partition("#")[0].partition("?")[2]) for u in urls_]
    suspect = [f"parameterised: {u}" if q else f"auth-gated: {u}" for u, p, q in zip(urls_, paths, asks, strict=True) if q or any(a in p.lower() for a in d.AUTH)]
    fails("IDX-016", len(suspect), suspect)
    optional = next((s[2] for s in sections if s[1].lower() == "optional"), [])
    lost = [x[2] for x in optional if any(p in x[2].lower() for p in d.IDENTITY)]
    fails("IDX-017", len(lost), lost)
    images, tags = len(re.findall(r"!\[[^\]]*\]\([^)]*\)", text)), len(re.findall(r"(?i)<(?:div|span|p|img|script|style|br|table|iframe)\b", text))
    hygiene = ["YAML front matter"] * bool(re.match(r"\A\s*---\s*\n.*?\n---\s*\n", text, re.S)) + [f"{images} image(s)"] * bool(images) + [f"{tags} raw HTML tag(s)"] * bool(tags)
    fails("IDX-018", len(hygiene), hygiene)
    if status is None:
        out["IDX-020"] = None
    else:
        bad = [f"{u} ({status.get(u) or 'unchecked'})" for u in urls_ if not status.get(u) or status[u] >= 400]
        fails("IDX-020", len(bad), bad)
    return out


def plain_full(text):
    lines = text.splitlines()
    heads = list(headings(lines))
    cites = [bool(re.match(r"^Source:\s*\S+\s*$", x)) for x in lines]
    h1, h2 = [h for h in heads if h[1] == 1], [h for h in heads if h[1] == 2]
    starts = [h for h in h2 if any(cites[h[0] + 1 : h[0] + 7])]
    bodies = [(h[2], h[0], lines[h[0] + 1 : starts[k + 1][0] if k + 1 < len(starts) else len(lines)]) for k, h in enumerate(starts)]
    out = {}

    def fails(rule, bad, count, examples=()):
        if bad:
            out[rule] = count, [str(e)[:160] for e in list(examples)[:5]]

    fails("FULL-001", len(h1) != 1, max(1, len(h1)))
    fails("FULL-002", not len(h2) == sum(cites) == len(starts), abs(len(h2) - sum(cites)))
    orphans = [h[2] for h in h2 if h not in starts]
    inside = len(orphans) + sum(h[0] > starts[0][0] for h in h1 if starts)
    fails("FULL-003", inside, inside, orphans)
    fails("FULL-004", not starts, 1)
    blocks = Counter()
    for _, _, body in bodies:
        blocks.update(list(dict.fromkeys(b for x in re.split(r"\n\s*\n", "\n".join(body)) if len(b := re.sub(r"\s+", " ", x.strip())) >= 200)))
    again = sorted(((b, n) for b, n in blocks.items() if n > 3), key=lambda x: -x[1])
    fails("FULL-005", again, len(again), [f"x{n}: {b[:90]}" for b, n in again])
    runs = len(re.findall("b{3,}", "".join("x" if x.strip() else "b" for x in lines)))
    spaced = [bool(re.search(r"[ \t]+$", x)) for x in lines].count(True)
    fails("FULL-006", runs + spaced, runs + spaced)
    bold = [x.strip() for x in lines if re.match(r"^#{1,6}\s+[*_]", x)]
    fails("FULL-007", bold, len(bold), bold)
    thin = [f"{t} ({len(chr(10).join(b))} chars)" for t, _, b in bodies if 0 < len("\n".join(b)) < 3000]
    fails("FULL-008", thin, len(thin), thin)
    fails("FULL-009", len(text) // 4 > 200_000, len(text) // 4)
    return out


LINKS = "\n".join(f"- [Page {i}](https://x.example/docs/{i}): Says what page {i} holds" for i in range(9))
INDEX = {
    "clean": f"# Site\n\n> What it is.\n\n## Docs\n\n{LINKS}\n",
    "empty": "Not a heading at all.\n",
    "titles": "# A\n> q\n# B\n## Docs\n- [a](https://x/a): b\n",
    "late": "\n\ntext\n# A\n\n\n\n\n> far\n### in\n## optional\n- [a](https://x/About/): b\n## After\n- [b](https://x/b): c\n## Optional\n- [c](https://x/team): d\n",
    "between": "# A\n> q\n## Optional\n- [a](https://x/a): b\n## Other\n- [b](https://x/b): c\n",
    "tail": "# A\n> q\n## D\n- [a](https://x/a): b\n\n---\n*made today*\nloose\n  more\n" + "_note_\n" * 3,
    "no links last": "# A\n> q\n## D\n- [a](https://x/a): b\n## Last\nwords here\n",
    "malformed": "# A\n> q\n## D\n- [a](https://x/a b): c\n- [broken](https://x\n* [star](https://x/s)\n- plain bullet\n- [ok](/rel): d\n- [http](http://x/y) - e\n",
    "insecure": "# A\n> q\n## D\n- [http](http://x/y) – e\n- [b](https://x/z/): f\n",
    "slashes": "# A\n> q\n## D\n- [a](https://x/a/): b\n- [c](https://x/c): d\n- [e](https://x/e.html): f\n- [r](https://x/): g\n",
    "twice": "# A\n> q\n## D\n- [Same](https://x/a): b\n- [same](https://x/a): c\n- [T](https://x/a): d\n- [t](https://x/u): e\n- [ T ](https://x/v): f\n",
    "words": "# A\n> q\n## D\n- [a](https://x/a): The Best and leading colour, color and colors\n- [b](https://x/b): Learn more " + "x" * 90 + "\n- [c](https://x/c)\n- [d](https://x/d): discover\n",
    "gated": "# A\n> q\n## D\n- [a](https://x/Login): b\n- [c](https://x/p?page=2): d\n- [e](https://x/p?): f\n- [g](https://x/p#a?b): h\n",
    "hygiene": "---\ntitle: x\n---\n# A\n> q\n## D\n- [a](https://x/a): b ![i](j) ![k](l)\n<div><BR> <spanner>\n",
    "fenced": "# A\n> q\n```\n# no\n## no\n```\n## D\n- [a](https://x/a): b\n~~~\n## x\n~~~\n",
    "many": "# A\n> q\n## D\n" + "\n".join(f"- [p{i}](https://x/{i})" for i in range(40)) + "\n### sub\n- [z](https://x/404): see [full](https://x/llms-full.txt)\n",
}


def got(found):
    out = {}
    for r in found.collect():
        mine = out.setdefault(r["doc"], {})
        if r["outcome"] == "skipped":
            mine[r["rule_id"]] = None
        elif r["outcome"] == "fail":
            mine[r["rule_id"]] = r["count"], r["examples"]
            assert r["message"]
        assert len(r["examples"]) <= 5 and all(len(e) <= 160 for e in r["examples"])
    return out


def test_index_rules_equal_the_plain_auditor(spark):
    docs = spark.createDataFrame(list(INDEX.items()), "doc string, text string")
    plain = {k: plain_index(t) for k, t in INDEX.items()}
    found = got(audit.index_findings(docs))
    for k in INDEX:
        # Without a network, companions are skipped where there are any.
        assert found[k].pop("IDX-019", "none") == ("none" if "llms-full" not in INDEX[k] else None)
        assert found[k] == plain[k], k
    failed = {r for x in plain.values() for r, v in x.items() if v}
    assert failed >= {f"IDX-{i:03}" for i in (1, 2, 3, 4, 5, 6, 7, 8, 12, 13, 14, 15, 16, 17, 18)}


def test_index_rules_with_profile_bounds_and_network(spark):
    docs = spark.createDataFrame(list(INDEX.items()), "doc string, text string")
    bounds = [("D", 2, 3), ("Gone", 1, None)]
    status = {f"https://x/{i}": 200 if i % 3 else 404 for i in range(30)} | {"https://x/a": None}
    profile = docs.select("doc", F.lit(300).alias("max_bytes"), F.lit(8).alias("max_links"), F.lit(2).alias("min_links"))
    rows = docs.select("doc").join(spark.createDataFrame([(*b, i) for i, b in enumerate(bounds)], "section string, least int, most int, ord int"))
    table = spark.createDataFrame(list(status.items()), "url string, status int")
    found = got(audit.index_findings(docs, profile, rows, table))
    for k, t in INDEX.items():
        companions = found[k].pop("IDX-019", None)
        assert (companions is not None) == ("llms-full" in t)
        assert found[k] == plain_index(t, (300, 8, 2), bounds, status), k


def test_a_url_with_several_statuses_counts_for_each_bad_one(spark):
    text = "# A\n> q\n## D\n- [a](https://x/a): b\n- [c](https://x/c): d\n- [e](https://x/e): f\n"
    table = spark.createDataFrame([("https://x/a", 404), ("https://x/a", 404), ("https://x/a", 200), ("https://x/a", None), ("https://x/c", 200)], "url string, status int")
    rows = audit.index_findings(spark.createDataFrame([(1, text)], "doc long, text string"), status=table).where("rule_id = 'IDX-020'").collect()
    assert [(r["outcome"], r["count"]) for r in rows] == [("fail", 4)]
    assert rows[0]["examples"] == ["https://x/a (404)", "https://x/a (unchecked)", "https://x/e (unchecked)"]


@pytest.mark.parametrize("name", ["idx_020_links_resolve", "idx_rules"])
def test_pages_that_share_a_url_equal_the_sql(spark, sf_dir, tmp_path, name):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    first = pages.orderBy("page_id").limit(1).select("url").first()["url"]
    # Statuses 404, null and 200 for one URL.
    pages.withColumn("url", F.when(F.col("page_id").isin(8, 9, 10, 72), first).otherwise(F.col("url"))).coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    df = catalog.queries()[name](spark, str(tmp_path))
    result = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(map(tuple, df.select(columns).collect())) == sorted(result.fetchall())


@pytest.mark.parametrize("name", ["idx_rules", "a20_rule_score", "idx_019_companions"])
@pytest.mark.parametrize("most", [51, 151, 200])
def test_a_document_whose_text_is_null_equals_the_sql(spark, sf_dir, tmp_path, name, most):
    # The last document lacks a part.
    spark.read.parquet(f"{sf_dir}/pages.parquet").where(F.col("page_id") <= most).coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    df = catalog.queries()[name](spark, str(tmp_path))
    result = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(map(repr, map(tuple, df.select(columns).collect()))) == sorted(map(repr, result.fetchall()))


def test_index_rules_of_the_pages_table(spark, sf_dir):
    docs = plans._docs(spark, sf_dir)
    found = got(audit.index_findings(docs))
    assert found == {r["doc"]: plain_index(r["text"]) for r in docs.collect()}


PAGE = "Source: https://x/{}\n\n{}\n\n"
SHARED, OTHER = "boilerplate " * 30, "another  block\nof words " * 12
FULL = {
    "clean": "# T\n\n" + "".join(f"## P{i}\n" + PAGE.format(i, f"own{i} " * 700) for i in range(3)),
    "none": "no headings\n\n\n\nand runs  \n\n\n\n",
    "repeats": "# T\n" + "".join(f"## P{i}\n" + PAGE.format(i, SHARED if i % 2 else OTHER + f"\n \n{SHARED}\n\n{SHARED}") for i in range(9)),
    "inside": "# T\n## A\nSource: https://x\n# B\n## **bold**\n## C\n\n\nSource: https://y\n### *sub*\ntext \t\n \n\n\nend\n## late\n1\n2\n3\n4\n5\n6\nSource: z\n",
    "no title": "## A\nSource: https://x\ntext\n",
    "long": "# T\n## A\nSource: https://x\n" + "word " * 170_000,
}


def test_full_rules_equal_the_plain_auditor(spark):
    docs = spark.createDataFrame(list(FULL.items()), "doc string, text string")
    plain = {k: plain_full(t) for k, t in FULL.items()}
    assert got(audit.full_findings(docs).where("true")) == {k: v for k, v in plain.items()}
    assert {r for x in plain.values() for r in x} == {f"FULL-{i:03}" for i in range(1, 10)}


def test_scores(spark):
    docs = spark.createDataFrame([(k, INDEX[k]) for k in ("clean", "empty", "twice")], "doc string, text string")
    score = {r["doc"]: (r["score"], r["capped_by"]) for r in d.report(audit.index_findings(docs)).collect()}
    assert score["clean"] == (100, None) and score["empty"][0] < 50 and score["empty"][1] == "error"
    assert score["twice"][1] == "warning" and score["twice"][0] <= 79


@pytest.mark.parametrize("n", [1, 106])
def test_findings_aggregate(spark, n):
    text = "# A\n> q\n## D\n" + "\n".join(f"- [p{i}](https://x/{i}): Learn about {i}" for i in range(n))
    found = got(audit.index_findings(spark.createDataFrame([(1, text)], "doc long, text string")))
    assert found[1]["IDX-014"] == (n, [f"Learn about {i}" for i in range(min(n, 5))])
