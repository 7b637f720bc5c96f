"""Globs, prefixes, fold changes and size tiers."""

from __future__ import annotations

import fnmatch
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls

#: Size tiers: most URLs, name, suggested page cap (0: none). Fixed values.
TIERS = ((100, "small", 0), (1_000, "medium", 400), (10_000, "large", 1_000), (1_000_000_000, "huge", 1_500))


def glob_regex(pattern: str) -> str:
    """An anchored Java regular expression for a shell pattern; ``**`` is ``*``."""
    while "**" in pattern:
        pattern = pattern.replace("**", "*")
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif close > 0:
            body = pattern[i + 1 : close]
            out += "[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\") + "]"
            i = close
        else:
            out += "\\" + c if c in r"\.^$+{}()|[]" else c
        i += 1
    return f"(?s)^{out}$"


def first_match(url: Column, patterns: Sequence[str]) -> Column:
    """The first pattern, in list order, that matches the URL or its path, in either case; else null."""
    where = urls.path(url)
    forms = [url, where, F.regexp_replace(where, "/+$", ""), F.concat(F.regexp_replace(where, "/+$", ""), F.lit("/"))]
    tests = []
    for p in patterns:
        regex = glob_regex(p.strip())
        hit = None
        for form in forms:
            test = form.rlike(regex) | F.lower(form).rlike(glob_regex(p.strip().lower()))
            hit = test if hit is None else hit | test
        tests.append(F.when(hit, F.lit(p)))
    return F.coalesce(*tests) if tests else F.lit(None).cast("string")


def python_glob(pattern: str, text: str) -> bool:
    """The same match in Python, for small driver-side lists."""
    while "**" in pattern:
        pattern = pattern.replace("**", "*")
    return fnmatch.fnmatchcase(text, pattern)


def fold_change(a: Column, b: Column) -> Column:
    """How many times the larger is the smaller; 1 for two zeros, infinite for one."""
    hi, lo = F.greatest(F.abs(a), F.abs(b)).cast("double"), F.least(F.abs(a), F.abs(b)).cast("double")
    return F.when(hi == 0, 1.0).when(lo == 0, F.lit(float("inf"))).otherwise(hi / lo)


def size_tier(n: Column) -> Column:
    tiers = [F.when(n < most, F.lit(name)) for most, name, _ in TIERS]
    return F.coalesce(*tiers, F.lit(TIERS[-1][1]))


def suggested_cap(n: Column) -> Column:
    tiers = [F.when(n < most, F.lit(cap)) for most, _, cap in TIERS]
    return F.coalesce(*tiers, F.lit(TIERS[-1][2]))


def page_cap(n: Column, requested: Column, default: int = 500) -> Column:
    """A request wins; else the smaller of suggestion and default; a small site has no cap but its own size."""
    s = suggested_cap(n)
    small = F.when(n > 0, n).otherwise(F.lit(default))
    return F.when(requested > 0, requested).when(s == 0, small).otherwise(F.least(s, F.lit(default)))
