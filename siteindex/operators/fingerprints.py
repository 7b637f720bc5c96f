"""Technology fingerprints: a pattern table from JSON shards, matched on five surfaces of a response.

A technology's patterns become rows (surface, key, pattern). Responses become rows of
the same surfaces (header, cookie and meta by name; script sources and the URL as one
text each), so that named surfaces meet by an equality join on (surface, key) and only
patterns of that name are tried. Script and URL patterns have no name. They meet texts by
an index of character grams: a text that matches must contain the pattern's longest
certain literal, hence the gram of that literal that fewest texts hold; the expression is
tried on those texts alone. Patterns without such a literal are tried on every text.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship
from ..lineage import written

#: Surfaces in order of trust, categories that decide a profile, and what finds tags. Fixed values.
SURFACES = ("header", "cookie", "meta", "script", "url")
FIELDS = {"headers": "header", "cookies": "cookie", "meta": "meta", "scriptSrc": "script", "url": "url"}
ECOMMERCE, CMS, BLOG = 6, 1, 11
META_NAME = r"""(?i)<meta[^>]+name=["']([^"']+)["'][^>]+content=["'][^"']*["']"""
META_CONTENT = r"""(?i)<meta[^>]+name=["'][^"']+["'][^>]+content=["']([^"']*)["']"""
SCRIPT_SRC = r"""(?i)<script[^>]+src=["']([^"']+)["']"""


#: Length of the grams of the index.
GRAM = 4


def load_shards(spark: SparkSession, folder: str, now: Column | None = None, days: int = 7) -> DataFrame:
    """(name, spec) of every technology in a folder of JSON shards, one object of technologies in each file.

    Shards not modified for ``days`` are expired: a technology that only they have is still
    taken, so that a failed refresh loses nothing.
    """
    text = spark.read.option("wholetext", True).text(folder)
    old = expired(F.col("_metadata.file_modification_time"), F.current_timestamp() if now is None else now, days)
    rows = text.select(old.alias("old"), F.explode(F.from_json("value", "map<string,string>")).alias("name", "spec"))
    part = lambda c: rows.where(c).select("name", "spec")
    return with_fallback(part(~F.col("old")), part(F.col("old")))


def with_fallback(fresh: DataFrame, stale: DataFrame) -> DataFrame:
    """(name, spec): all of ``fresh``, and what only ``stale`` has."""
    return fresh.unionByName(stale.join(fresh.select("name"), "name", "left_anti"))


def expired(modified: Column, now: Column, days: int = 7) -> Column:
    """Whether a shard's copy has outlived its time."""
    return modified + F.expr(f"interval {days} days") < now


def pattern_table(technologies: DataFrame) -> DataFrame:
    """(name, categories, surface, key, pattern) from (name, spec as JSON); what follows ``\\;`` is no part of a pattern."""

    def named(field: str, surface: str) -> Column:
        found = F.coalesce(F.from_json(F.get_json_object("spec", f"$.{field}"), "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>"))
        return F.transform(F.map_entries(found), lambda e: F.struct(F.lit(surface).alias("surface"), F.lower(e["key"]).alias("key"), e["value"].alias("raw")))

    def listed(field: str, surface: str) -> Column:
        value = F.get_json_object("spec", f"$.{field}")
        many = F.when(value.startswith("["), F.from_json(value, "array<string>")).when(value.isNotNull(), F.array(value)).otherwise(F.array().cast("array<string>"))
        return F.transform(many, lambda x: F.struct(F.lit(surface).alias("surface"), F.lit("").alias("key"), x.alias("raw")))

    rows = technologies.select("name", F.coalesce(F.from_json(F.get_json_object("spec", "$.cats"), "array<int>"), F.array().cast("array<int>")).alias("categories"), F.explode(F.concat(*[(named if s in ("header", "cookie", "meta") else listed)(f, s) for f, s in FIELDS.items()])).alias("x"))
    body = F.element_at(F.split("x.raw", r"\\;"), 1)
    return rows.select("name", "categories", "x.surface", "x.key", F.coalesce(body, F.lit("")).alias("pattern")).where("key <> '' or pattern <> ''")


def surfaces(responses: DataFrame) -> DataFrame:
    """(id, surface, key, value) of responses (id, url, headers as a map of lower-case names, html)."""
    pairs = F.transform(F.map_entries("headers"), lambda e: F.struct(F.lit("header").alias("surface"), e["key"].alias("key"), e["value"].alias("value")))
    chunks = F.transform(F.split(F.coalesce(F.try_element_at("headers", F.lit("set-cookie")), F.lit("")), ","), lambda c: F.element_at(F.split(F.trim(c), ";"), 1))
    cookies = F.transform(F.filter(chunks, lambda c: c.contains("=") & (F.trim(F.substring_index(c, "=", 1)) != "")), lambda c: F.struct(F.lit("cookie").alias("surface"), F.lower(F.trim(F.substring_index(c, "=", 1))).alias("key"), F.trim(F.regexp_replace(c, "^[^=]*=", "")).alias("value")))
    metas = F.zip_with(F.regexp_extract_all("html", F.lit(META_NAME), F.lit(1)), F.regexp_extract_all("html", F.lit(META_CONTENT), F.lit(1)), lambda n, v: F.struct(F.lit("meta").alias("surface"), F.lower(n).alias("key"), v.alias("value")))
    scripts = F.array_join(F.regexp_extract_all("html", F.lit(SCRIPT_SRC), F.lit(1)), " ")
    whole = F.array(F.struct(F.lit("script").alias("surface"), F.lit("").alias("key"), scripts.alias("value")), F.struct(F.lit("url").alias("surface"), F.lit("").alias("key"), F.col("url").alias("value")))
    return responses.select("id", F.explode(F.concat(pairs, cookies, metas, whole)).alias("x")).select("id", "x.*")


def required_literal(pattern: str) -> str:
    """The longest run of characters that every match of a regular expression contains, in lower case; "" if none is certain."""
    runs, run, depth, i = [], "", 0, 0

    def end() -> None:
        nonlocal run
        runs.append(run)
        run = ""

    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "|" and depth == 0:
            return ""
        if c == "\\" and i < len(pattern):
            c, i = pattern[i], i + 1
            if depth == 0 and not c.isalnum():
                run += c
            else:
                end()
        elif c == "[":  # a class; what stands in it is no certain character
            end()
            i += pattern[i : i + 1] == "^"
            i += pattern[i : i + 1] == "]"
            while i < len(pattern) and pattern[i] != "]":
                i += 1 + (pattern[i] == "\\")
            i += 1
        elif c in "()":
            depth += 1 if c == "(" else -1
            end()
        elif c in "?*{":  # what stands before it may be absent
            run = run[:-1]
            end()
            if c == "{":
                i = pattern.find("}", i) + 1 or len(pattern)
        elif c in ".^$+":
            end()
        elif depth == 0:
            run += c.lower()
    end()
    return max(runs, key=len)


def _grams(text: Column) -> Column:
    count = F.length(text) - GRAM + 1
    return F.when(count > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), count), lambda i: F.substr(text, i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


def _fits() -> Column:
    return F.expr("pattern = '' or rlike(value, concat('(?i)', pattern))")


def unnamed_hits(values: DataFrame, patterns: DataFrame, salts: int = 16) -> DataFrame:
    """(surface, value, name, categories) of the texts (surface, value) that patterns (surface, name, categories, pattern) match."""
    ship(values.sparkSession)

    @F.pandas_udf("string")
    def literal(expressions: pd.Series) -> pd.Series:
        return expressions.map(required_literal)

    known = written(patterns.select("surface", "name", "categories", "pattern").distinct().withColumn("literal", literal("pattern")))
    low = F.lower("value")
    steps = known.select("surface", "name", "pattern", F.explode(_grams(F.col("literal"))).alias("gram"))
    used = steps.select("surface", "gram").distinct()
    held = values.select("surface", "value", F.explode(_grams(low)).alias("gram")).join(used, ["surface", "gram"])
    held = written(held)
    texts = held.groupBy("surface", "gram").agg(F.count(F.lit(1)).alias("texts"))
    # Each pattern is found by the gram that fewest texts hold.
    best = steps.join(texts, ["surface", "gram"], "left").groupBy("surface", "name", "pattern").agg(F.min_by("gram", F.struct(F.coalesce("texts", F.lit(0)), "gram")).alias("gram"))
    keyed = best.join(known, ["surface", "name", "pattern"])
    candidates = held.join(keyed, ["surface", "gram"]).where(F.contains(low, F.col("literal")))
    # The others meet all texts of their surface, which are dealt out by a salt.
    rest = known.where(F.length("literal") < GRAM).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    every = values.select("surface", "value", F.pmod(F.xxhash64("value"), F.lit(salts)).cast("int").alias("salt")).join(rest, ["surface", "salt"])
    columns = ["surface", "value", "name", "categories", "pattern"]
    return candidates.select(columns).unionByName(every.select(columns)).where(_fits()).select(columns[:-1]).distinct()


def detect(responses: DataFrame, patterns: DataFrame) -> DataFrame:
    """(id, name, categories, surface): each technology once, by its most trusted surface."""
    seen = surfaces(responses)
    # Each different value meets patterns once.
    values = written(seen.select("surface", "key", "value").distinct())
    named = values.where("key <> ''").join(patterns, ["surface", "key"]).where(_fits()).select("surface", "key", "value", "name", "categories")
    unnamed = unnamed_hits(values.where("key = ''").select("surface", "value"), patterns.where("key = ''")).select("surface", F.lit("").alias("key"), "value", "name", "categories")
    rank = F.array_position(F.array(*[F.lit(s) for s in SURFACES]), F.col("surface"))
    met = seen.join(named.unionByName(unnamed), ["surface", "key", "value"])
    return met.groupBy("id", "name").agg(F.first("categories").alias("categories"), F.min_by("surface", rank).alias("surface"))


def summary(found: DataFrame) -> DataFrame:
    """(id, ecommerce, cms, other): names of each group, in order."""
    shop = F.array_contains("categories", ECOMMERCE)
    cms = ~shop & (F.array_contains("categories", CMS) | F.array_contains("categories", BLOG))
    names = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("name"))))
    return found.groupBy("id").agg(names(shop).alias("ecommerce"), names(cms).alias("cms"), names(~shop & ~cms).alias("other"))
