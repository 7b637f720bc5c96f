"""The pattern index against trying every pattern, and shards with expired copies."""

import json
import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from siteindex.operators import fingerprints


@pytest.mark.parametrize(
    ("pattern", "literal"),
    [
        (r"cdn\.shop\.example", "cdn.shop.example"),
        (r"/(?:wp|x)-content/plugins?/Foo", "-content/plugin"),
        (r"a|b", ""),
        (r"jquery[.-](\d+)\.js", "jquery"),
        (r"^/[^/]]+abc{2}def", "def"),
        (r"x*yz+w", "yz"),
        (r"(shop)?", ""),
        (r"\bword\b\.min", "word"),
        ("", ""),
    ],
)
def test_required_literals(pattern, literal):
    assert fingerprints.required_literal(pattern) == literal


def test_literals_are_in_every_match():
    rng = random.Random(2)
    for _ in range(3000):
        pattern = "".join(rng.choice(["a", "B", "cd", r"\.", "x?", "y*", "z+", "(e|f)", "[gh]", r"\d", ".", "w{2}"]) for _ in range(rng.randrange(1, 6)))
        literal = fingerprints.required_literal(pattern)
        for m in re.finditer(pattern, "".join(rng.choice("aBcd.xyzefgh1w") for _ in range(300)), re.I):
            assert literal in m[0].lower()


def test_index_finds_what_every_pattern_tried_finds(spark):
    rng = random.Random(7)
    names = [f"{rng.choice(['cdn', 'static', 'assets'])}.lib{i}" for i in range(400)]
    forms = [lambda n: re.escape(n), lambda n: rf"{re.escape(n)}\.(?:min\.)?js", lambda n: rf"/{n[-4:]}[-./]", lambda n: "js|css", lambda n: rf"^https?://{re.escape(n)}"]
    specs = [(f"T{i}", json.dumps({"cats": [1], rng.choice(["scriptSrc", "url"]): [rng.choice(forms)(n)]})) for i, n in enumerate(names)]
    table = fingerprints.pattern_table(spark.createDataFrame(specs, "name string, spec string"))
    responses = []
    for i in range(200):
        scripts = "".join(f'<script src="https://{rng.choice(names).upper() if i % 7 == 0 else rng.choice(names)}.{rng.choice(["js", "min.js", "css"])}"></script>' for _ in range(rng.randrange(4)))
        responses.append((i, f"https://{rng.choice(names)}/x", {}, scripts))
    df = spark.createDataFrame(responses, "id long, url string, headers map<string,string>, html string")
    got = sorted((r["id"], r["name"], r["surface"]) for r in fingerprints.detect(df, table).collect())
    want = {}
    patterns = [(r["name"], r["surface"], re.compile(r["pattern"], re.I)) for r in table.collect()]
    for i, url, _, html in responses:
        texts = {"script": " ".join(re.findall('src="([^"]+)"', html)), "url": url}
        for name, surface, p in patterns:
            if p.search(texts[surface]):
                want[i, name] = min(want.get((i, name), surface), surface)
    assert got == sorted((i, n, s) for (i, n), s in want.items()) and len(got) > 300


def test_expired_shards_count_only_for_what_no_fresh_one_has(spark, tmp_path):
    for name, days, entries in (("a", 1, {"One": {"cats": [1]}, "Two": {"cats": [2]}}), ("b", 30, {"Two": {"cats": [99]}, "Three": {"url": "x"}})):
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(entries))
        os.utime(path, (time.time() - days * 86400,) * 2)
    got = {r["name"]: json.loads(r["spec"]) for r in fingerprints.load_shards(spark, str(tmp_path)).collect()}
    assert got == {"One": {"cats": [1]}, "Two": {"cats": [2]}, "Three": {"url": "x"}}
    later = F.current_timestamp() + F.expr("interval 90 days")  # all are expired, none is lost
    assert {r["name"] for r in fingerprints.load_shards(spark, str(tmp_path), later).collect()} == {"One", "Two", "Three"}
